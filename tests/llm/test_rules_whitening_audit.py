"""Quality rules, whitening and the filter audit against brute force and on hard small cases."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import filter_audit, quality_rules, whitening

WORD = re.compile("[^\x20\x09-\x0d]+")
TEXTS = [
    None, "", " \n\t", "a", "a a a a a", "one two three four one two three", "x y z\nx y z\n \n \nx y z", "ß 漢字 😀\x0bé\x1cb\x85c d",
    "# $$ % | <b> & *", "ALL CAPS HERE!!", "w " * 250, " ".join(f"w{i}" for i in range(260)), "long" * 60_000, "a b c " * 30_000, "\n\n\n", "a\r\nb\r\na\r\n",
]


def _counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, held = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            held |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(held), len(lines)


def test_counts_equal_brute_force():
    rng = random.Random(5)
    more = ["".join(rng.choice("ab \n\t|é") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    for text in TEXTS[:12] + TEXTS[14:] + more:
        assert quality_rules.counts(text or "") == _counts(text), text


def test_binomial_and_sequences():
    for n, p in ((20, 0.1), (300, 0.05), (7, 0.5)):
        for k in range(int(n * p)):
            want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert quality_rules.at_most(k, n, p) == pytest.approx(want, rel=1e-9)
    assert quality_rules.at_most(0, 0, 0.1) == 1.0
    assert quality_rules.certified([0, 0, 9], 86, 0.05, 0.0125) == 1 and quality_rules.certified([0], 85, 0.05, 0.0125) == -1
    # A level after a failed one is not tested.
    assert quality_rules.certified([0, 80, 0], 100, 0.05, 0.05) == 0
    cuts = quality_rules.proposed(np.array([0.0, 1.0, 2.0]), np.array([98, 2, 0]), np.array([0, 40, 60]))
    assert cuts == [1.0] * 6 + [0.0] * 2 and sorted(cuts, reverse=True) == cuts
    assert set(quality_rules.proposed(np.array([0.0, 3.0]), np.array([5, 1]), np.array([5, 1]))) == {math.inf}


def _labelled(n, seed, lang="en"):
    """Good texts, and bad ones full of symbols."""
    rng = random.Random(seed)
    said = lambda: [rng.choice("abcdefgh") * rng.randint(2, 8) + str(rng.randint(0, 999)) for _ in range(60)]
    return [(" ".join(w + ("##" if i % 4 == 0 else "") for w in said()), lang, int(i % 4 > 0)) for i in range(n)]


def test_rules_reject_bad_texts_and_are_certified(spark):
    rows = _labelled(1200, 1) + _labelled(40, 2, "few") + _labelled(600, 3, None)
    docs = spark.createDataFrame([(i, t, lang, "x") for i, (t, lang, _) in enumerate(rows)] + [(None, "no id", "en", "y")], "doc_id bigint, text string, lang string, rule_symbols string")
    labels = spark.createDataFrame([(i, q, 0) for i, (*_, q) in enumerate(rows) if i % 5] + [(None, 0, 0), (10**9, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.quality(docs, labels).collect()}
    assert len(got) == len(rows) + 1 and not got[None].kept and got[None].base_failed
    verdicts = {lang: Counter((bool(q), got[i].kept) for i, (_, l, q) in enumerate(rows) if l == lang) for lang in ("en", "few", None)}
    for lang in ("en", None):
        v = verdicts[lang]
        assert v[False, True] == 0 and v[True, False] <= 0.05 * (v[True, True] + v[True, False])
    # Too few labels: no certificate, nothing rejected.
    assert verdicts["few"][False, False] == verdicts["few"][True, False] == 0
    assert all(r.kept != r.base_failed for r in quality_rules.quality(docs, labels.limit(0)).collect())
    assert quality_rules.quality(docs.limit(0), labels).count() == 0


def test_rules_without_use_reject_nothing(spark):
    rng = random.Random(9)
    text = lambda: " ".join(str(rng.randint(0, 10**6)) for _ in range(60))
    docs = spark.createDataFrame([(i, text(), "en") for i in range(1500)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1500)], "doc_id bigint, quality int, toxic int")
    rejected = quality_rules.quality(docs, labels).filter("NOT kept").count()
    assert rejected <= 0.05 * 1500


def _white(x):
    n = len(x)
    s = x.sum(axis=0)
    c = x - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)
    return n, s, c, e[order], v[:, order]


@pytest.mark.parametrize("bound", [4096, 7])
def test_whitening_equals_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(whitening, "PAIRS", bound)
    rng = np.random.default_rng(4)
    raw = (rng.standard_normal((300, 10)) * np.arange(1, 11)).astype(np.float32)
    rows = [(i, v.tolist(), "n") for i, v in enumerate(raw)]
    hard = [(1000, None, "n"), (1001, [1.0] * 9 + [None], "n"), (1002, [float("nan")] * 10, "n"), (1003, [float("inf")] * 10, "n"), (1004, [1.0] * 9, "n"), (1005, [], "n")]
    frame = spark.createDataFrame(rows + hard, "vec_id bigint, embedding array<float>, n string").repartition(7)
    got = whitening.whitened(frame, k=4).collect()
    x = np.floor(1024 * raw.astype(np.float64)).astype(np.int64) + 100_000
    n, s, c, e, v = _white(x)
    assert len(got) == 1200 and {r.n for r in got} == {300}
    w = np.zeros((300, 4))
    for r in got:
        w[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[r.vec_id], s, strict=True))
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9) and r.identity_error < 1e-9
    want = c @ v[:, :4] / np.sqrt(e[:4])
    for j in range(4):
        assert min(np.abs(w[:, j] - want[:, j]).max(), np.abs(w[:, j] + want[:, j]).max()) < 1e-8


def test_whitening_of_few_equal_and_extreme_vectors(spark):
    make = lambda *vs: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vs)], "vec_id bigint, embedding array<double>")
    assert whitening.whitened(make()).count() == 0
    one = whitening.whitened(make((1, 2, 3))).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(i, 0, None, 0.0, None) for i in (1, 2, 3)]
    two = whitening.whitened(make((1, 2, 3), (1, 2, 5), (1, 2, 5))).collect()
    assert {r.whitened is None for r in two if r.component > 1} == {True} and {round(abs(r.whitened), 6) for r in two if r.component == 1} == {1.414214, 0.707107}
    far = whitening.whitened(make((1e30, 0), (-1e30, 1), (0, 7))).collect()
    top = (1 << 53) + 100_000
    x = [[top, 100_000], [-(1 << 53) + 100_000, 101_024], [100_000, 107_168]]
    s = [sum(c) for c in zip(*x, strict=True)]
    assert {r.vec_id: int(r.deviation) for r in far} == {i: sum((3 * a - b) ** 2 for a, b in zip(v, s, strict=True)) for i, v in enumerate(x)}


def test_whitening_plans_stay_small(spark, monkeypatch):
    """Driver and executors compile each expression; before, 64 dimensions had 2,080 in one plan."""
    from pyspark.sql import GroupedData

    sizes, rng = [], np.random.default_rng(6)
    agg = GroupedData.agg
    monkeypatch.setattr(GroupedData, "agg", lambda self, *e: sizes.append(len(e)) or agg(self, *e))
    for d in (64, 7):
        raw = rng.standard_normal((200, d))
        frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(raw)], "vec_id bigint, embedding array<double>").repartition(3)
        x, width = whitening.usable(frame, "vec_id", "embedding")
        fit = whitening.Whitening.fit(x, width)
        _, _, c, e, _ = _white(np.floor(1024 * raw).astype(np.int64) + 100_000)
        assert np.allclose(fit.vectors * fit.values @ fit.vectors.T, c.T @ c / 200) and np.allclose(fit.values, e)
    assert max(sizes) <= 128
    monkeypatch.setattr(whitening, "PAIRS", 5)
    assert np.allclose(whitening.Whitening.fit(x, width).values, e)


def _audit(rows, labels):
    """All 120 orders, row by row."""
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    parts = {}
    for i, t, lang in rows:
        t = t or ""
        words = WORD.findall(t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum(c.isascii() and c.isupper() for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t],
        }
        parts.setdefault(lang or "", []).append(({c for c in fails if fails[c]}, i))
    out = []
    for part, docs in parts.items():
        share = Counter()
        for order in itertools.permutations("ABCDE"):
            for fails, _ in docs:
                share[next((c for c in order if c in fails), None)] += 1
        for order in itertools.permutations("ABCDE"):
            for k, c in enumerate(order):
                before = set(order[:k])
                gone = [(f, i) for f, i in docs if c in f and not f & before]
                kept = sum(not f & (before | {c}) for f, _ in docs)
                redundant, alone = sum(c in f and bool(f & before) for f, _ in docs), sum(f == {c} for f, _ in docs)
                out.append((part, "".join(order), k + 1, kept, len(gone), redundant, alone, sum(i in good for _, i in gone), sum(i in toxic for _, i in gone), share[c]))
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("weak", [False, True])
def test_audit_equals_brute_force(spark, weak):
    rng = random.Random(8)
    texts = TEXTS + [" ".join(rng.choice(["a", "B", "c#", "dd"]) for _ in range(rng.randint(100, 300))) for _ in range(30)]
    texts += [t[:-1] + "Z" for t in texts if t] + ["q" * 5000 + c + "r" * 100 for c in "xyz"] * 2
    rows = [(rng.randint(0, 90), t, rng.choice(["en", "de", None, ""])) for t in texts for _ in range(rng.choice([1, 1, 2, 5]))] + [(None, "a", "en"), (None, None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 90, 2)] + [(4, 1, 1), (None, 1, 1), (4, 0, 0)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string, mask string").repartition(6)
    said = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    more = {"hashed": lambda c: F.lit(1).cast("bigint")} if weak else {}
    got = filter_audit.audit(docs, said, **more)
    assert sorted(map(tuple, got.select(COLUMNS).collect())) == _audit(rows, labels)
    assert filter_audit.audit(docs.limit(0), said, **more).count() == 0


def test_refinement_drops_singletons_block_by_block(spark):
    a, b = "x" * 600, "x" * 599 + "y"  # apart in their second block
    rows = spark.createDataFrame([(t,) for t in (a, b, a + "c" * 4000, "x" * 599 + "z", b, "short")], "text string")
    found = filter_audit.refined(filter_audit._keyed(rows, F.xxhash64).select("chars", "hashes")).collect()
    assert [(r.key[0], r.n) for r in found] == [(600, 2)]
    assert filter_audit.refined(filter_audit._keyed(rows.limit(0), F.xxhash64).select("chars", "hashes")).count() == 0

"""The corpus operators against brute force and on hard small cases."""

import gc
import hashlib
import math
import pickle
import random
import re
import unicodedata
import weakref
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import batched, bytebpe, chat, components, embedding_dedup, exact_dedup, html_extract, language, packing, runtime, simhash, token_count, toxicity, wordbpe

DOCS = "doc_id bigint, text string, lang string, source string, kept boolean, n bigint"
HARD = [None, "", " \n", "a", "the cat", "the cat", "ab" * 5000, "ß É İ ﬁ 漢字 😀", "'s ll  x\t\ty <|endoftext|>!", "the  cat\n"]
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioulrstn") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 400))) for _ in range(60)]
    texts += [t.replace(words[0], words[1]) for t in texts[:20]] + texts[:10] + HARD
    rows = [(i, t, "x" if i % 3 else None, None, None, None) for i, t in enumerate(texts)] + [(None, "no id", None, None, None, None), (5, texts[5], None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


def _find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 1)]
    found = components.classes(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in found} == {i: 0 for i in range(21)} | {i: 100 for i in range(100, 140)}


@pytest.mark.parametrize(("block", "calm"), [(2048, 64), (4, 2)])
def test_simhash_classes_equal_brute_force(spark, block, calm):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, 3))) for _ in range(6)]))
    parent = {int(x): int(x) for x in fps.view(np.int64)}
    signed = fps.view(np.int64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 4):
            a, b = _find(parent, int(signed[i])), _find(parent, int(signed[j]))
            parent[max(a, b)] = min(a, b)
    rows = spark.createDataFrame([(int(x),) for x in signed], "fp bigint")
    found = {r.node: r.root for r in components.classes(simhash.links(rows, block=block, calm=calm)).collect()}
    assert all(found.get(x, x) == _find(parent, x) for x in parent)


def _fingerprint(text):
    """Bit by bit, as the definition says."""
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(rows, near):
    """Least name of each row's class; rows are (name, value)."""
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if near(rows[i][1], rows[j][1]):
                a, b = _find(parent, i), _find(parent, j)
                parent[max(a, b)] = min(a, b)
    members = {}
    for i in range(len(rows)):
        members.setdefault(_find(parent, i), []).append(i)
    return [members[_find(parent, i)] for i in range(len(rows))]


def test_simhash_equals_brute_force(docs):
    rows = [(r.doc_id, _fingerprint(r.text)) for r in docs.collect()]
    groups = _classes(rows, lambda a, b: (a ^ b).bit_count() <= 4)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    want = sorted((repr(i), fp, least([rows[k][0] for k in g])) for (i, fp), g in zip(rows, groups, strict=True))
    found = simhash.simhash_classes(docs.withColumns({"fp": F.lit(1), "n": F.lit(2), "id": F.lit(3)})).collect()
    assert sorted((repr(r.doc_id), r.fingerprint % (1 << 64), r.component_id) for r in found) == want
    assert simhash.simhash_classes(docs.limit(0)).count() == simhash.keep_one(docs.limit(0)).count() == 0


def test_simhash_keeps_one_row_of_each_class(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("aeioulrstn") for _ in range(5)) for _ in range(200)]
    a, b, c, d = (" ".join(rng.choice(words) for _ in range(200)) for _ in range(4))
    rows = [(1, a, "x"), (1, a, "x"), (1, b, "y"), (2, a, "z"), (3, b, "z"), (None, b, "n"), (None, c, "n"), (None, c, "m"), (4, d, None), (5, None, "e"), (6, "", "e"), (7, "w", "e"), (7, "v", "e")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, fp string").repartition(4)
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert got == sorted([(1, a), (1, b), (None, c), (4, d), (5, None), (7, "v"), (7, "w")], key=repr)


def test_lookups_spread_or_broadcast_alike(spark):
    rows = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then 7 when id % 11 = 0 then null else id end as k")
    table = rows.groupBy("k").agg(F.count("*").alias("n")).filter("k % 2 = 1").withColumn("v", F.col("k") * 10)
    want = sorted((r.id, r.k * 10 if r.k is not None and r.k % 2 else None) for r in rows.collect())
    for bound in (500_000, 20):
        got = runtime.looked_up(rows, table, "k", "n", bound=bound, hot=100)
        assert sorted((r.id, r.v) for r in got.collect()) == want


def test_exact_duplicates_equal_brute_force(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    plain = lambda t: "".join(c for c in t if c not in " \t\n\r\x0b\x0c")
    groups = {}
    for i, t in rows:
        groups.setdefault(plain(t), []).append((-len(t), i is None, i))
    found = {r.doc_id: r for r in exact_dedup.duplicates(docs, digest=True).collect()}
    for i, t in rows:
        keep = min(groups[plain(t)])[2]
        assert (found[i].keep_id, found[i].group_size, found[i].kept) == (keep, len(groups[plain(t)]), keep == i)
        assert found[i].text_sha256 == hashlib.sha256(plain(t).encode()).hexdigest()
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(repr((r.doc_id, r.text or "")) for r in kept.collect()) == sorted(repr((min(g)[2], next(t for i, t in rows if i == min(g)[2] and len(t) == -min(g)[0] and plain(t) == key))) for key, g in groups.items())
    assert exact_dedup.duplicates(docs.limit(0)).count() == exact_dedup.keep_one(docs.limit(0)).count() == 0
    early = {r.doc_id: r.text_sha256 for r in exact_dedup.duplicates(docs).collect()}
    assert all((early[i] is not None) == (len(groups[plain(t)]) > 1) for i, t in rows if t[:1] != "a")


def test_exact_duplicates_of_texts_that_begin_with_white_space(spark):
    gap, body = " \n" * 1000, "the same words after it " * 40
    rows = [(1, gap + body), (2, body), (3, body[:900] + "x" + body[901:]), (4, gap), (5, None), (6, "ab"), (6, "a b"), (6, "a b"), (None, "ab")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit(1))
    assert sorted(((r.doc_id, r.text) for r in exact_dedup.keep_one(frame).collect()), key=repr) == sorted([(1, gap + body), (3, rows[2][1]), (4, gap), (6, "a b")], key=repr)
    found = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.duplicates(frame).collect()}
    assert found == {(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True), (4, 4, 2, True), (5, 4, 2, False), (6, 6, 4, True), (None, 6, 4, False)}


def test_byte_bpe_equals_library_and_round_trips(docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {t: i for i, t in enumerate(bytebpe.read_ranks(path))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    which = (path, public_tokenizers.PATTERN)
    rows = docs.select("text", bytebpe.encode(F.col("text"), *which).alias("ids")).withColumn("back", bytebpe.decode(F.col("ids"), *which)).collect()
    for r in rows:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.back) == (r.text or "").encode()
    bpe, rng = bytebpe.byte_bpe(*which), random.Random(1)
    pool = [*"aAbhtein \n\t\r\x0b\x1c\x85\xa0\u3000\u2009'sS.,!09ªİßé漢😀", "  ", "'ll", " the", "ing"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(5000)] + ["", " ", "ab" * 30_000, "x y " * 30_000]
    for most in (batched.SLICE, 500):
        got = []
        for _, some in batched.slices(pa.array(texts), most):
            ids, ends = bpe.encode(some)
            got += [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]
        assert got == [library.encode_ordinary(t) for t in texts]
    clash = docs.select("text", F.lit(1).alias("ids")).limit(0).withColumn("ids", bytebpe.encode(F.col("text"), *which))
    assert clash.withColumn("back", bytebpe.decode(F.col("ids"), *which)).collect() == []
    with pytest.raises(ValueError):
        bpe.decode(pa.array([[len(bpe.tokens)]], pa.list_(pa.int32())))
    lists = pa.array([[5, 6], None, [], [7]], pa.list_(pa.int32()))
    assert bpe.decode(lists).to_pylist() == bpe.decode(lists.slice(1)).to_pylist()[:0] + [bpe.tokens[5] + bpe.tokens[6], None, b"", bpe.tokens[7]]
    assert bpe.decode(lists.slice(1)).to_pylist() == [None, b"", bpe.tokens[7]] and bpe.decode(lists.slice(1, 2)).to_pylist() == [None, b""]
    other = bytebpe.ByteBpe(bytebpe.read_ranks(path), public_tokenizers.PATTERN + "|x")  # not the known pattern
    assert other.encode(pa.array(texts))[0].tolist() == bpe.encode(pa.array(texts))[0].tolist() and bpe.plain and not other.plain


def test_word_tokens_equal_library(docs, monkeypatch):
    library, ours, rng = Tokenizer.from_file(WORDS), wordbpe.word_tokens(WORDS), random.Random(1)
    pool = [*"aAbZ \n\t\x0b\x1c\x85\xa0'sS.,!09①ªİßΣς̱éÅ漢😀<|>K", "<|endoftext|>", "'ll", "the ", "hello", "123", "...", "Wörter,", "x" * 300]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(5000)] + [None, "", " " * 99, "ab " * 50_000]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(ours, "_ids", type(ours._ids)(ours._ids.make, 50))
    for most in (batched.SLICE, 1000):
        got = []
        for _, some in batched.slices(pa.array(texts), most):
            ids, ends = ours.ids(some)
            got += [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]
        assert got == want
    assert ours.counts(pa.array(texts)).tolist() == [*map(len, want)] and ours.counts(pa.array([], pa.string())).tolist() == []
    for r in token_count.count_tokens(docs, WORDS, 20).collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.over_limit, r.n_bytes) == (n, n > 20, len((r.text or "").encode()))
    clash = docs.withColumns({"n_bytes": F.lit("x"), "n_tokens": F.lit("y")})
    assert token_count.count_tokens(clash, WORDS, 20).count() == docs.count() and token_count.count_tokens(docs.limit(0), WORDS, 20).count() == 0


def test_packing_places_every_token_once_without_padding(docs):
    library = Tokenizer.from_file(WORDS)
    pieces = packing.pack(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), WORDS, capacity=256).collect()
    texts = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for i, ps in by_doc.items():
        assert np.frombuffer(b"".join(bytes(p.ids) for p in sorted(ps, key=lambda p: p.start)), "<u4").tolist() == texts[i]
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256 and at & (at - 1) == 0
    assert packing.pack(docs.limit(0), WORDS).count() == 0
    assert {r.ids for r in packing.pack(docs.filter("doc_id is null or text is null"), WORDS).filter("length = 1").collect()} == {(2).to_bytes(4, "little")}


def test_packing_bins_hold_a_fixed_number_of_whole_documents():
    rng = random.Random(4)
    lengths = [rng.choice([rng.randint(1, 40), rng.randint(1, 300), rng.randint(1, 1500)]) for _ in range(3000)]
    bins, placed = packing.Bins(1024, 0, classes=8), []
    for i, n in enumerate(lengths):
        placed += bins.add(i, bytes(4 * n))
    full = {p[5] for p in placed}
    tail = bins.close()
    by_sequence = {}
    for p in placed:
        by_sequence.setdefault(p[5], []).append(p)
    cut = {(p[0], p[1]) for p in placed + tail if p[1] + p[2] < p[4] and p[2] < 1024}
    for ps in by_sequence.values():
        assert sum(p[2] for p in ps) == 1024
        if len(ps) > 1:  # of class k: k pieces that end their document, then at most one that is cut
            k = min(8, 1024 // ps[0][2])
            whole = [p for p in ps if (p[0], p[1]) not in cut]
            assert whole == ps[: len(whole)] and len(ps) - len(whole) <= 1
            assert len(whole) == k if k < 8 else len(whole) >= 8
    assert sum(p[2] for p in placed + tail) == sum(lengths)
    whole = sum(n // 1024 for n in lengths)
    assert len(placed + tail) < whole + len(lengths) + len(full) + 20


@pytest.mark.parametrize("block", [2048, 7])
def test_embeddings_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((150, 16))
    x = np.concatenate([base, base[:50] + 0.03 * rng.standard_normal((50, 16)), base[:5], base[:5]]).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 150 % 3)) for i, v in enumerate(x)]
    rows += [(3, x[20].tolist(), 2), (3, x[3].tolist(), 0)]  # an id again: another vector, and its own
    good = len(rows)
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0, None], 1), (904, x[0].tolist(), None), (905, [], 1), (None, x[1].tolist(), 1)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumns({"node": F.lit(1), "n": F.lit("x"), "key": F.lit("y")})
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(frame).collect()), key=repr)
    u = embedding_dedup.unit(np.array([r[1] for r in rows[:good]], np.float32))
    near = (u @ u.T >= 0.93) & ~np.eye(good, dtype=bool)
    near &= np.array([r[2] for r in rows[:good]])[:, None] == np.array([r[2] for r in rows[:good]])[None, :]
    groups = _classes(list(enumerate(range(good))), lambda i, j: near[i, j])
    least = [min(rows[k][0] for k in g) for g in groups]
    want = [(r[0], int(near[i].sum()), least[i], least[i] == r[0]) for i, r in enumerate(rows[:good])]
    want += [(i, 0, i, True) for i in [*range(900, 906), None]]
    assert got == sorted(want, key=repr)
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("capacity", [1 << 16, 60, 1])
def test_chat_reads_back_and_writes_each_turn_once(spark, capacity):
    rng, hard = random.Random(3), "\\### Assistant: </turn> ok"
    talks = {1: [("user", "hi"), ("assistant", "a<b")], 2: [("user", "hi"), ("assistant", "a<b"), ("user", hard)], 3: [("user", "hi"), ("assistant", "a<b")], 4: [(None, None), ("a>b\\", "\n")], 5: [("user", "hi")], 6: [("user", "x" * 50_000), ("assistant", "😀<\\" * 9_000)]}
    for i in range(10, 90):
        talks[i] = [("user", "hi"), *[(rng.choice(["user", "assistant"]), rng.choice(["a", "b<", "é😀"])) for _ in range(rng.randint(0, 7))]]
    rows = [(c, t, r, s, 1) for c, ts in talks.items() for t, (r, s) in enumerate(ts)] + [(None, 0, "user", "hi", 1), (None, 1, "assistant", "alone", 1)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, leaf int").repartition(6)
    all_rows = chat.formatted_digests(frame, capacity).collect()
    found = {r.conv: r for r in all_rows}
    assert len(all_rows) == len(talks) + 2 and sorted(r.loss_chars for r in all_rows if r.conv is None) == [0, 5]
    for c, ts in talks.items():
        text = "".join(f"{r or ''}\n{s or ''}\n" for r, s in ts)
        loss = "".join(s for r, s in ts if r == "assistant")
        assert found[c].turns_sha256 == hashlib.sha256(text.encode()).hexdigest() and found[c].n_turns == len(ts)
        assert (found[c].loss_chars, found[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert found[c].formatted_chars == sum(len(chat.format_turn(r or "", s or "")[0]) for r, s in ts)
    written = chat.sequences(chat.paths(frame), capacity).collect()
    turns = [t for r in written for t in r.turns]
    different = {tuple(ts[: k + 1]) for ts in [*talks.values(), [("assistant", "alone")]] for k in range(len(ts))}
    assert len(turns) == len({t.node for t in turns}) == len(different)
    assert sum(len(r.text) for r in written) == sum(len(chat.format_turn(p[-1][0] or "", p[-1][1] or "")[0]) for p in different)
    assert sum(t.ends for t in turns) == len(talks) + 2
    line = {t.node: (t.parent, t.length, t.position) for t in turns}
    for r in written:
        assert len(r.text) <= capacity or len(r.turns) == 1
        assert len(chat.position_ids([t.asDict() for t in r.turns])) == len(r.text)
        for t in r.turns:
            assert t.position == (0 if t.parent is None else line[t.parent][1] + line[t.parent][2])
            assert t.position == sum(line[n][1] for n in r.context[: t.above]) + sum(a.end - a.start for a in t.ancestors)
    assert chat.formatted_digests(frame.limit(0)).count() == 0


def test_language_profiles(spark):
    rows = [(i, "the house and the garden with the tree " * 3 if i % 2 else "das haus und der garten mit dem baum " * 3, "en" if i % 2 else "de") for i in range(40)]
    rows += [(100, None, "en"), (101, "123 !!", "de"), (None, "the tree", None)]
    found = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert all(found[i].lang_pred == ("en" if i % 2 else "de") for i in range(40))
    assert found[100].lang_pred == found[101].lang_pred == "und" and found[None].lang_pred == "en"
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())


def test_toxicity_finds_misspellings_and_spares_quotes(spark):
    rng = random.Random(5)
    plain = ["".join(rng.choice("aeioulrstn") for _ in range(6)) for _ in range(400)]
    said = lambda bad: " ".join([rng.choice(plain) for _ in range(40)] + [rng.choice(["blockhead", "numskull"]) for _ in range(3)] * bad)
    rows = [(i, said(i % 5 == 0), int(i % 5 == 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(500, None), (501, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(999, 1), (3, None)], "doc_id bigint, toxic int")
    lexicon = toxicity.learned(docs, labels)
    assert {"blockhead", "numskull"} <= set(lexicon.words)
    assert lexicon.near("blokhead") == ("blockhead", 1) and lexicon.near("bkohed") is None
    whole = " ".join(plain[:40])
    assert lexicon.score(f"{whole} blockhead numskull blockhead") > 0.3 > lexicon.score(whole)
    assert lexicon.score(f'{whole} the word "blockhead" is old') < lexicon.score(f"{whole} blockhead is old")
    found = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    assert found[500].score == found[501].score == 0.0
    assert all(found[i].predicted == t for i, _, t in rows)
    assert toxicity.score_documents(docs, labels.limit(0)).agg(F.max("score")).first()[0] == 0.0


def test_levenshtein_automaton_equals_brute_force():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    terms, rng = ["abca", "abcab", "bcabca", "cabcabcab"], random.Random(2)
    automaton = toxicity.Automaton(terms)
    for _ in range(4000):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(0, 11)))
        near = [distance(w, t) for t in terms if distance(w, t) <= toxicity.edits(t)]
        found = automaton.match(w)
        assert (found is None) == (not near) and (found is None or found[1] == min(near))


def test_html_hard_cases(spark):
    article = "<nav>menu</nav><article><h1>T &amp; t</h1><p>one<br>two <b>three<p>four\n  five<div class='comments'>no</div><form>no</form></article><footer>f"
    rows = [(1, "http://h.example/a", article), (2, None, None), (3, "::bad", ""), (4, "http://h.example/b", "<p>loose text</p><script>var t='</p>';</script>")]
    rows += [(10 + i, "http://s.example/x", f"<div class=box>Same on each page</div><div><p>Text {i} of its own</p></div>") for i in range(8)]
    found = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert found[1] == "T & t\n\none two three\n\nfour five" and found[2] == found[3] == "" and found[4] == "loose text"
    assert all(found[10 + i] == f"Text {i} of its own" for i in range(8))


def test_lexicons_share_bounded_memory_and_free_it(monkeypatch):
    rng = random.Random(5)
    some = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    lexicon = toxicity.Lexicon({"abcab": 1.0, "cabcabcab": 2.0}, {"bbbb": 1.5})
    before = [lexicon.known[w] for w in some]
    again = pickle.loads(pickle.dumps(lexicon))
    assert again == lexicon and again.known is lexicon.known
    monkeypatch.setattr(toxicity, "MOST_MOVES", 5)
    lexicon.known.clear()
    assert [lexicon.known[w] for w in some] == before
    gc.disable()
    try:
        gone = weakref.ref(lexicon.near)
        del lexicon, again
        toxicity.Lexicon({"other": 1.0}, {})
        assert gone() is None
    finally:
        gc.enable()


def test_html_copies_count_as_one_page(spark):
    many = "".join(f"<div><p>Paragraph {i} of the copied page</p></div>" for i in "abcdefghij")
    rows = [(i, "http://c.example/x", many) for i in range(60)] + [(100, "http://c.example/y", "<div><p>Only here</p></div>")]
    rows += [(200 + i, "http://s.example/", "<div><p>A page by itself</p></div>") for i in range(9)]
    found = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)).collect()}
    assert found[100] == "Only here" and all(found[i].count("Paragraph") == 10 for i in range(60))
    assert all(found[200 + i] == "A page by itself" for i in range(9))


def test_html_tree_decides_inside_articles(spark):
    unlisted = "<div class=hint-box>Read our other stories</div>"
    rows = [(i, "http://a.example/x", f"<article><p>Story {i} of its own</p>{unlisted}</article>") for i in range(9)]
    rows += [(100 + i, "http://b.example/x", f"<main>We bake</main><div><p>Story {i} of its own</p></div>") for i in range(9)]
    rows += [(200 + i, "http://c.example/x", f"<nav>{i}</nav><article>The same on each</article>") for i in range(9)]
    found = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(found[i] == found[100 + i] == f"Story {i} of its own" for i in range(9))
    assert all(found[200 + i] == "The same on each" for i in range(9))


@pytest.mark.parametrize(
    "html",
    [
        "<body class='has-sidebar'><main class='no-comments'>It stays</main>",
        "<body class='sidebar'><article class='post share'><p>It stays</p><div class='share'>no</div></article>",
        "<div id='search-results'><p>It stays</p></div>",
        "<div class='sidebar widget'><header>no</header><div><main>It stays</main></div></div>",
        "<div class=overlay><article>It stays</article></div>",
        "<article>It stays</article><div class='related'><article>no</article></div>",
        "<main><p>It stays</p><ol class='comments'><li><article>no</article></ol></main>",
    ],
)
def test_html_class_words_spare_the_main_text(html):
    assert html_extract.Page(html).main_text() == "It stays"


def test_toxicity_learns_terms_of_a_small_language_among_many_toxic_texts(spark):
    rng = random.Random(6)
    large, small = [["".join(rng.choice(letters) for _ in range(6)) for _ in range(200)] for letters in ("aeioulrstn", "kmpqvwxyz")]
    said = lambda words, bad: " ".join([rng.choice(words) for _ in range(30)] + [bad] * 2)
    rows = [(said(large, "blockhead"), 1) for _ in range(400)] + [(said(large, ""), 0) for _ in range(800)]
    rows += [(said(small, "zurriago"), 1) for _ in range(10)] + [(said(small, ""), 0) for _ in range(40)]
    lexicon = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    assert {"blockhead", "zurriago"} <= set(lexicon.words)
    assert lexicon.score(said(small, "zurriago")) > 0.3 > lexicon.score(said(small, ""))


def test_toxicity_lexicon_has_no_largest_size(spark, monkeypatch):
    """2,500 words of toxic texts are all terms; few nodes in memory change no match."""
    rng = random.Random(11)
    words = sorted({"".join(rng.choice("bcdfghklmnprstvz") for _ in range(9)) for _ in range(2_500)})
    plain = ["the house by the lake is old", "we met at noon and ate bread", "rain fell all over the town"]
    orders = [rng.sample(words, len(words)) for _ in range(8)]
    dealt = [order[i::50] for order in orders for i in range(50)]  # each word in eight texts that share no run
    rows = [(" ".join(text), 1) for text in dealt] + [(f"{rng.choice(plain)} {i} {rng.random()}", 0) for i in range(3000)]
    lexicon = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    assert all(lexicon.near(w) is not None for w in words) and len(lexicon.words) + len(lexicon.stems) > 2_000
    some = [w[:4] + "a" + w[5:] for w in words[:60]]
    before = [lexicon.near(w) for w in some]
    monkeypatch.setattr(toxicity, "MOST_NODES", 50)
    assert [toxicity.Lexicon(lexicon.words, lexicon.stems, lexicon.ordinary).near(w) for w in some] == before


def test_toxicity_stems_and_short_terms_match_within_edits():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    lexicon = toxicity.Lexicon({"scum": 2.0}, {"bomente": 4.0, "boco": 3.0}, frozenset(["slum", "momentenahe"]))
    weighs = {"scum": 2.0, "skum": 1.0, "slum": 0.0, "bomentera": 4.0, "bomemtera": 2.0, "bomenera": 2.0, "momentenahe": 0.0, "bocora": 3.0, "bokora": 0.0, "b0m3ntera": 4.0}
    assert {w: lexicon.known[w] for w in weighs} == weighs
    terms, rng = ["abca", "bcabca", "cabcabcab", "abbcc-", "cccabca-", "abab-"], random.Random(2)
    automaton = toxicity.Automaton(terms)
    for _ in range(4000):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(0, 11)))
        reach = lambda t: min(distance(w[:k], t[:-1]) for k in range(len(w) + 1)) if t.endswith("-") else distance(w, t)  # noqa: E731, B023
        near = [reach(t) for t in terms if reach(t) <= toxicity.edits(t)]
        found = automaton.match(w)
        assert (found is None) == (not near) and (found is None or (found[1] == min(near) == reach(found[0])))


def test_toxicity_counts_near_copies_once(spark):
    rng = random.Random(8)
    plain = ["".join(rng.choice("aeioulrstn") for _ in range(6)) for _ in range(300)]
    said = lambda bad: " ".join([rng.choice(plain) for _ in range(30)] + [bad] * 2)
    rows = [(said("blockhead"), 1) for _ in range(60)] + [(said(""), 0) for _ in range(300)]
    copied = " ".join(f"{rng.choice(plain)}kq" for _ in range(300))
    rows += [(f"{copied} blockhead number{i}", 1) for i in range(20)]
    lexicon = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    assert "blockhead" in lexicon.words and not any(w in copied for w in [*lexicon.words, *lexicon.stems])


def test_language_filter_keeps_texts_when_nothing_is_learned(spark):
    rows = spark.createDataFrame([(1, "some text", None), (2, None, None), (3, "12 - 3", None), (4, "другой", None)], "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in language.keep_identified(rows).collect()) == [1, 4]


def _grams(text):
    """Padded words' n-grams by plain counting, most frequent first."""
    words, counts = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower()).split(), Counter()
    for w in words:
        padded = f" {w} "
        for n in (1, 2, 3):
            counts.update(g for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) != " ")
    return counts


def test_language_equals_brute_force(spark):
    rng = random.Random(12)
    letters = {"aa": "abcdeé", "bb": "cdefgñ", "cc": "efghiß"}
    said = lambda lang: " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 7))) + rng.choice(["", ",", " 12", "İ", "é"]) for _ in range(rng.randint(1, 60)))
    rows = [(i, said(lang), lang if i % 7 else None, "x") for i in range(200) for lang in [rng.choice(list(letters))]]
    rows += [(300, "g" * 100_000, None, "x"), (301, "", "aa", None), (302, "d", None, None), (303, None, "aa", None), (None, "abc abc", "aa", None), (5, rows[5][1], rows[5][2], "x")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string").repartition(4)
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    totals = {}
    for i, t, lang, _ in rows:
        if t is not None and lang is not None and not out(i):
            totals.setdefault(lang, Counter()).update(_grams(t))
    rank = lambda c: sorted(c, key=lambda g: (-c[g], [ord(x) for x in g.ljust(3, "\0")]))[: language.PROFILE]
    profiles = {lang: {g: i for i, g in enumerate(rank(c))} for lang, c in totals.items()}
    want = []
    for i, t, _, _ in rows:
        own = rank(_grams(t or ""))
        d = sorted((sum(min(abs(p[g] - k), language.PROFILE) if g in p else language.PROFILE for k, g in enumerate(own)), lang) for lang, p in profiles.items())
        want.append((i, out(i), d[0][1], (d[1][0] - d[0][0]) / d[1][0]) if own else (i, out(i), "und", 0.0))
    got = [(r.doc_id, r.held_out, r.lang_pred, r.score) for r in language.identify(frame).collect()]
    key = lambda r: repr(r[:3])
    assert [r[:3] for r in sorted(got, key=key)] == [r[:3] for r in sorted(want, key=key)]
    assert [r[3] for r in sorted(got, key=key)] == pytest.approx([r[3] for r in sorted(want, key=key)])
    assert language.identify(frame.limit(0)).count() == 0 and language.keep_identified(frame).columns == frame.columns


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_toxicity_scores_equal_brute_force(spark):
    rng = random.Random(21)
    lexicon = toxicity.Lexicon({"scum": 2.0, "blockhead": 3.0, "idiot": 1.5}, {"bomente": 4.0}, frozenset(["slum"]), (-2.0, 0.8, -0.1, 0.3))
    pool = ["the", "house", "scum", "skum", "slum", "blockhead", "blokhaed", "idiot", "id1ot", "bomentera", "bonentes", "word", "said", '"', "\u201c", "\u201d", "\n", ".", "tree " * 12]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 30))) for _ in range(400)] + [None, "", "..", "scum " * 20_000, "x" * 100_000]

    def weight(word):
        best = []
        for w in dict.fromkeys([word, word if word.isalpha() else word.translate(str.maketrans("013457@$", "oieastas"))]):
            if not best:
                best = [(d, t) for t in lexicon.words if (d := _distance(w, t)) <= toxicity.edits(t)]
                best += [(d, s + "-") for s in lexicon.stems if (d := min(_distance(w[:k], s) for k in range(min(len(w), 20) + 1))) <= toxicity.edits(s + "-")]
        if not best or (min(best)[0] and word in lexicon.ordinary):
            return 0.0
        d, t = min(best)
        return (lexicon.words | {s + "-": x for s, x in lexicon.stems.items()})[t] / 2**d

    def score(text):
        lower, total, n = (text or "").lower(), 0.0, 0
        for m in toxicity.WORD.finditer(lower):
            n += 1
            if len(m.group()) < 40 and (found := weight(m.group())):
                total += found * toxicity.context(lower, m.start(), m.end())
        if not n:
            return 0.0
        x = min(total, 40.0), math.log1p(n), min(100 * total / n, 40.0)
        return 1 / (1 + math.exp(-(lexicon.model[0] + sum(a * b for a, b in zip(lexicon.model[1:], x, strict=True)))))

    frame = spark.createDataFrame(list(enumerate(texts)), "i bigint, text string").repartition(3)
    got = {r.i: r.s for r in frame.select("i", toxicity.toxicity(F.col("text"), lexicon).alias("s")).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx([score(t) for t in texts])


def test_toxicity_hard_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 1, "x"), (1, "a b", 2, "y"), (None, None, 3, "z"), (2, "scum " * 30_000, 4, None)], "doc_id bigint, text string, score int, id string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (7, 1)], "doc_id bigint, toxic int")
    assert toxicity.score_documents(docs, labels).count() == 4 and toxicity.keep_clean(docs, labels).columns == docs.columns
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<div class="post"><p>The story.</p></div><div id="comments"><h3>3</h3><article class="comment-body"><p>rant</p></article></div>', "The story."),
        ('<div class="post"><p>The story.</p></div><section class="replies"><article><p>rant</p></article></section>', "The story."),
        ('<article><p>Story.</p><div class="reader-comments"><p>rant</p></div><div class="comment-thread"><p>x</p></div><div class="advert-box">buy</div></article>', "Story."),
        ('<article><p>Story.</p><section class="related"><p>Also real.</p></section></article>', "Story.\n\nAlso real."),
        ('<article><p>Story.</p><section class="related"><p><a href="/x">Another title</a></p></section></article>', "Story."),
        ("<div class=post><p>" + "The story. " * 30 + "</p></div><div><article><a>T</a><p>blurb</p></article><article><a>U</a><p>blurb</p></article></div>", ("The story. " * 30).strip()),
        ('<article class="post has-comments"><p>Story.</p><article class="comment"><p>nested</p></article></article>', "Story."),
        ('<body class="comments-open"><div class="sidebar-layout"><article><p>Story.</p></article></div><p>other</p>', "Story."),
        ('<main><article><p>Story.</p></article><section id="comments"><article><p>rant</p></article></section></main>', "Story."),
        ('<div class="teasers"><article class="teaser"><p>a</p></article></div><article><h1>Title</h1><p>Story.</p></article>', "Title\n\nStory."),
    ],
)
def test_html_articles_that_are_not_the_page(html, want):
    assert html_extract.Page(html).main_text() == want


def test_html_blog_with_comments_as_articles(spark):
    talk = "".join(f'<article class="comment" id="c{i}"><header>reader {i}</header><p>rant {i}</p></article>' for i in range(9))
    page = lambda i: f'<nav>Home</nav><div id="content"><h1>Post {i}</h1><div class="entry"><p>Said {i} of it.</p></div></div><section class="comments">{talk}</section><footer>f</footer>'
    rows = spark.createDataFrame([(i, f"http://blog.example/{i}", page(i)) for i in range(12)], "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in html_extract.main_text(rows).collect()} == {i: f"Post {i}\n\nSaid {i} of it." for i in range(12)}


def test_html_tree_equals_brute_force(spark):
    rng = random.Random(31)

    def page(i):
        part = lambda: rng.choice(["<p>Fixed words</p>", f"<p>Own {i} {rng.random()}</p>", "<div class=hint>Tip</div>", f"<div class='x{chr(97 + i % 26)}{chr(97 + i // 26)}'>rare {i}</div>"])
        inner = "".join(part() for _ in range(rng.randint(0, 4)))
        deep = "<div><section>" + rng.choice(["Everywhere", "Everywhere", "Here or there", f"Own {i}"]) + "</section></div>"
        return f"<body><div class=top>{rng.choice(['Menu', 'Menu', 'Other'])}</div>{deep}<article>{inner}</article></body>"

    pages = [(i, f"http://{'ab'[i % 3 == 0]}.example/{i}", page(i)) for i in range(90)]
    pages += [(200 + i, *pages[i][1:]) for i in range(30)] + [(300, None, None), (301, "http://a.example", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    by_host = {}
    for _, url, html in pages:
        by_host.setdefault(html_extract.host(url), {})[html or ""] = html_extract.Page(html or "")
    low = {}
    for host, seen in by_host.items():
        have, shown, texts, below = {}, {}, {}, {}
        for key, p in seen.items():
            for place, up in p.parent.items():
                have.setdefault(place, set()).add(key)
                below.setdefault(up, set()).add(place)
            for place, f in p.shown:
                shown.setdefault(place, {}).setdefault(f, set()).add(key)
            for place, t, _, _ in p.blocks:
                texts.setdefault(place, {}).setdefault(t, set()).add(key)

        def weigh(place):
            m = len(have[place])
            if m < html_extract.LEAST_PAGES:
                return 1.0
            own = [1 - math.log(len(x)) / math.log(m) for x in texts.get(place, {}).values()]
            content = sum(own) / len(own) if own else 0.0
            kids = {c: weigh(c) for c in below.get(place, ())}  # noqa: B023
            if not kids:
                return content
            n = [len(x) for x in shown.get(place, {}).values()]
            varied = -sum(x / sum(n) * math.log(x / sum(n)) for x in n) / math.log(m)
            share, pages_of = html_extract.GAMMA ** len(kids), {c: len(have[c]) for c in kids}  # noqa: B023
            inner = sum(kids[c] * pages_of[c] for c in kids) / sum(pages_of.values())
            return max((1 - share) * min(1.0, varied) + share * inner, content, *kids.values())

        low[host] = {p for p in have if len(have[p]) >= html_extract.LEAST_PAGES and weigh(p) < html_extract.LEAST}
    assert any(low.values())
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumns({"host": F.lit(1), "n": F.lit(2), "places": F.lit(3)}).repartition(4)
    trees = {r.host: set(r.places) for r in html_extract.style_trees(frame).collect()}
    assert trees == {h: x for h, x in low.items() if x}
    got = {r.page_id: r.text for r in html_extract.main_text(frame).collect()}
    want = {i: by_host[html_extract.host(u)][h or ""].main_text(frozenset(low[html_extract.host(u)])) for i, u, h in pages}
    assert got == want and any(t != html_extract.Page(h or "").main_text() for (i, _, h), t in zip(pages, want.values(), strict=True))
    assert got[301] == "deep" and html_extract.main_text(frame.limit(0)).count() == 0

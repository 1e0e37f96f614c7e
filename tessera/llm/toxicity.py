"""Toxicity by a learned lexicon, matched within an edit distance.

Matching. The terms form a trie. Levenshtein automata of all terms are run
over it at once: a state is the set of trie nodes that can be reached, each
with the fewest edits, and states are made deterministic as texts need them.
A word is read letter by letter and dropped once its state is empty. Terms
match within one or two edits, up to three letters exactly. A stem is a node
that accepts whatever follows, with the same edits, so a word matches that
begins nearly like it; stems of four letters must match exactly, since within
an edit of three to five letters begins a good part of all words.

Context. What a hit weighs depends on a window around it: inside quotation
marks, or after a word of reporting or of mention, it weighs less, since the
text then speaks about the term. A logistic model turns the weighted hits, the
length and the density of hits into the score.

Fit. Labelled rows, at most ``FIT_ROWS`` of them in hash order of their ids,
give for each word and each stem how many toxic and other texts hold it, and
how often; copies of a text count once, near copies too, or each word of a
copied text would seem to be shared by many: n texts of a label with the same
least hash over their runs of five words count 1/n each. Terms are what toxic texts share and others
hold far less: a fixed ratio, and so often that at most one term of all would
be expected to by chance (log-likelihood ratio). The bar on texts does not grow
with the toxic rows, so a small language keeps its terms among large ones. A
term weighs the logarithm of its ratio. The logistic model is fitted on the
same rows. A near miss of a term
that texts labelled 0 hold is remembered as a word of its own and does not count.

Scale. Scoring is one narrow pass. All terms that pass the tests are in the
lexicon; at most ``FIT_ROWS`` texts bear them, at least ``LEAST_TEXTS`` each. An
automaton forgets its states once they hold ``MOST_NODES`` trie nodes, so a
large lexicon costs time and not memory. Only ids and labels are ordered to
find the rows to fit on. These, at most ``FIT_ROWS``, are read from the
documents once and checkpointed; their texts enter no shuffle, and terms are
pre-aggregated.

Defined cases. A null or blank text scores 0. Rows without a label teach
nothing, nor do labels without a row; of several labels of an id the highest
counts. Without any toxic row, or in an empty table, all scores are 0. Whole
texts are read. Repeated rows score alike. Other columns are ignored, whatever
their names; ``keep_clean`` passes them through.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tessera.llm.memory import Memory
from tessera.llm.runtime import checkpointed, joinable

#: Labelled rows that the lexicon is fitted on, at most.
FIT_ROWS = 40_000
#: A term is in at least so many toxic texts.
LEAST_TEXTS = 4
#: How many times more frequent in toxic texts than in others, at least.
LEAST_RATIO = 6.0
STEMS = range(4, 9)
#: Characters on either side of a hit that its context is read from.
WINDOW = 48
#: Where the weighted hits of a text and their density level off.
MOST_HITS = 40.0
QUOTED, MENTIONED = 0.25, 0.5
#: Words in each generation of a worker's memory, and moves of its automaton and trie nodes of its states, before they are found anew.
KNOWN, MOST_MOVES, MOST_NODES = 30_000, 100_000, 1_000_000
#: Words in a run that near copies share.
RUN = 5
WORD = re.compile(r"[^\W_]+(?:[0-9@$]+[^\W_]+)*")
#: Digits and signs that stand for letters.
_LOOKALIKE = str.maketrans("013457@$", "oieastas")
_PAIRS = {'"': '"', "“": "”", "«": "»", "„": "“"}
_MENTION = re.compile(
    r"\b(?:words?|terms?|slurs?|insults?|said|says|wrote|called|quotes?|quoted|quoting|mot|terme|insulte|wort|begriff|zitat|palabra|término|insulto)\b"
)


def edits(term: str) -> int:
    """Edits within which a term still matches; a stem ends with a hyphen."""
    if term.endswith("-"):
        return 0 if len(term) < 6 else 1
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


class Automaton:
    """Deterministic union of the terms' Levenshtein automata over their trie.

    A term with a hyphen at its end is a stem: it accepts as soon as it is read.
    """

    def __init__(self, terms: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.reach = [0]  # most edits of any term below
        for t in terms:
            node = 0
            self.reach[0] = max(self.reach[0], edits(t))
            for c in t.removesuffix("-"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.stem.append(None)
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], edits(t))
            (self.stem if t.endswith("-") else self.term)[node] = t
        self._forget()

    def _forget(self) -> None:
        """Back to the two states that are always there."""
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.nodes = 0  # in all sets
        self.moves: dict[tuple[int, str], int] = {}
        self.hits: list[tuple[str, int] | None] = []
        self.begun: list[tuple[str, int] | None] = []  # the nearest stem that a word may go on from
        self.dead = self._number({})
        self.start = self._number({0: 0})

    def _number(self, nodes: dict[int, int]) -> int:
        """The state with these nodes and what follows them by left-out letters."""
        queue = list(nodes.items())
        while queue:
            node, e = queue.pop()
            if nodes.get(node, 99) < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.reach[child] and e + 1 < nodes.get(child, 99):
                    nodes[child] = e + 1
                    queue.append((child, e + 1))
        key = tuple(sorted(nodes.items()))
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.nodes += len(key)
            for ends, hits in ((self.term, self.hits), (self.stem, self.begun)):
                found = [(e, ends[n]) for n, e in key if ends[n] is not None and e <= edits(ends[n])]
                hits.append((min(found)[1], min(found)[0]) if found else None)
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        out: dict[int, int] = {}
        for node, e in self.sets[state]:
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.reach[child] and cost < out.get(child, 99):
                    out[child] = cost
            if e + 1 <= self.reach[node] and e + 1 < out.get(node, 99):
                out[node] = e + 1
        return self._number(out)

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its edits, and how many it took."""
        if len(self.moves) > MOST_MOVES or self.nodes > MOST_NODES:  # bounded on any text
            self._forget()
        state, dead, moves, best = self.start, self.dead, self.moves, None
        for c in word:
            to = moves.get((state, c))
            if to is None:
                to = moves[(state, c)] = self._step(state, c)
            if to == dead:
                return best
            state = to
            if (stem := self.begun[state]) and (best is None or stem[1] < best[1]):
                best = stem
                if not best[1]:
                    return best
        end = self.hits[state]
        return end if best is None or (end and end[1] < best[1]) else best


@lru_cache(maxsize=1)
def _matching(words: tuple[tuple[str, float], ...], stems: tuple[tuple[str, float], ...], ordinary: frozenset[str]) -> tuple[Callable, Memory]:
    """What finds the nearest term of a word, and a memory of what words weigh.

    A worker's tasks share them while they score by the same lexicon. Nothing
    here refers back to its holder, so another lexicon frees them at once.
    """
    weights = dict(words) | {s + "-": w for s, w in stems}
    automaton = Automaton(sorted(weights))

    def near(word: str) -> tuple[str, int] | None:
        """The nearest term within its edits, and how many it took."""
        found = automaton.match(word)
        if found is None and not word.isalpha():
            found = automaton.match(word.translate(_LOOKALIKE))
        return found

    def weight(word: str) -> float:
        found = near(word)
        if found is None or (found[1] and word in ordinary):
            return 0.0
        return weights[found[0]] / 2 ** found[1]

    return near, Memory(weight, KNOWN)


@dataclass
class Lexicon:
    """Words and stems that mark toxic texts, and ordinary words near them."""

    words: dict[str, float]
    stems: dict[str, float]
    ordinary: frozenset[str] = frozenset()
    #: Bias, and factors of hits, log length and hits per hundred words.
    model: tuple[float, float, float, float] = (-3.0, 0.7, 0.0, 0.0)
    near: Callable[[str], tuple[str, int] | None] = field(init=False, repr=False, compare=False)
    known: Memory = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        self.near, self.known = _matching(tuple(self.words.items()), tuple(self.stems.items()), self.ordinary)

    def __getstate__(self) -> tuple:
        return self.words, self.stems, self.ordinary, self.model

    def __setstate__(self, state: tuple) -> None:
        self.words, self.stems, self.ordinary, self.model = state
        self.__post_init__()

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Weighted hits, log length and hits per hundred words."""
        lower = (text or "").lower()
        found = WORD.findall(lower)
        if not found:
            return 0.0, 0.0, 0.0
        total = 0.0
        if any(map(self.known.__getitem__, found)):
            for m in WORD.finditer(lower):
                if weight := self.known[m.group()]:
                    total += weight * context(lower, m.start(), m.end())
        return min(total, MOST_HITS), math.log1p(len(found)), min(100.0 * total / len(found), MOST_HITS)

    def score(self, text: str | None) -> float:
        """From 0 to 1, higher for texts likelier to be toxic."""
        x = self.features(text)
        if not x[1] or not (self.words or self.stems):
            return 0.0
        z = self.model[0] + sum(b * v for b, v in zip(self.model[1:], x, strict=True))
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


def context(text: str, start: int, end: int) -> float:
    """1 for plain use, less where the window shows quotation or mention."""
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    before, after = before.rsplit("\n", 1)[-1], after.split("\n", 1)[0]
    for left, right in _PAIRS.items():
        inside = before.count(left) % 2 == 1 if left == right else before.rfind(left) > before.rfind(right)
        if inside and right in after:
            return QUOTED
    return MENTIONED if _MENTION.search(before[-20:]) else 1.0


def _terms(words: set[str]) -> set[str]:
    """Words, and their proper prefixes marked with a hyphen."""
    return words | {w[:k] + "-" for w in words for k in STEMS if len(w) > k}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Bias and factors of a ridge-penalised logistic regression."""
    middle, spread = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([np.ones(len(x)), (x - middle) / spread])
    b = np.zeros(z.shape[1])
    penalty = ridge * np.diag([0.0] + [1.0] * x.shape[1]) + 1e-6 * np.eye(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ b)
        b = b + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    factors = b[1:] / spread
    return np.concatenate([[b[0] - (factors * middle).sum()], factors])


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """A model in which more and denser hits never lower a score, nor length raises it."""
    use = [0, 1, 2]
    while True:
        b = logistic(x[:, use], y)
        wrong = [c for c, f in zip(use, b[1:], strict=True) if (f > 0 if c == 1 else f < 0)]
        if not wrong:
            break
        use = [c for c in use if c not in wrong]
    out = np.zeros(4)
    out[0], out[[1 + c for c in use]] = b[0], b[1:]
    return tuple(map(float, out))


def least_run(text: str) -> int:
    """The least hash over the text's runs of words: near copies mostly share it, other texts hardly ever do."""
    words = WORD.findall(text.lower())
    codes = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    runs = max(1, len(codes) - RUN + 1)
    mixed = np.zeros(runs, np.uint64)
    for i in range(min(RUN, len(codes))):
        mixed = (mixed + codes[i : i + runs] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return int((mixed >> np.uint64(1)).min())


def shared(rows: DataFrame) -> DataFrame:
    """``rows`` (text, label), read once, with the share that each text counts."""

    @arrow_udf("bigint")
    def run_of(texts: pa.Array) -> pa.Array:
        return pa.array([least_run(t.as_py()) for t in texts], pa.int64())

    named = checkpointed(rows.withColumn("run", run_of("text")))
    copies = named.groupBy("run", "label").agg(F.count("*").alias("copies")).filter("copies > 1")
    return named.join(joinable(copies), ["run", "label"], "left").select("text", "label", F.coalesce(1.0 / F.col("copies"), F.lit(1.0)).alias("share"))


def likelihood_ratio(toxic: int, others: int) -> Column:
    """Twice the log-likelihood ratio of ``t`` of so many toxic and ``o`` of so many other texts against one rate for both."""
    rate = (F.col("t") + F.col("o")) / (toxic + others)
    x_log_x = lambda n, mean: F.when(n > 0, n * F.ln(n / mean)).otherwise(0.0)
    cells = [(F.col("t"), toxic), (F.col("o"), others)]
    return 2.0 * sum((x_log_x(n, rate * m) + x_log_x(m - n, (1 - rate) * m) for n, m in cells), F.lit(0.0))


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """The lexicon that rows with text and label (0 or 1) show."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["t", "o", "tn", "on"]
        sums = {n: Counter() for n in names}

        def emit() -> pa.RecordBatch:
            keys = sorted(set().union(*sums.values()))
            columns = [pa.array([sums[n][k] for k in keys], pa.float64()) for n in names]
            for c in sums.values():
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *columns], names=["term", *names])

        for part in batches:
            for text, label, share in zip(part.column("text"), *[part.column(c).to_pylist() for c in ("label", "share")], strict=True):
                words = Counter(WORD.findall(text.as_py().lower()))
                texts, times = (sums["t"], sums["tn"]) if label else (sums["o"], sums["on"])
                texts[""] += share
                times[""] += words.total()
                for term in _terms(set(words)):
                    texts[term] += share
                for w, n in words.items():
                    times[w] += n
                    for k in STEMS:
                        if len(w) > k:
                            times[w[:k] + "-"] += n
                if len(sums["t"]) + len(sums["o"]) > 80_000:
                    yield emit()
        yield emit()

    rows = shared(labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label")).dropna())
    names = ["t", "o", "tn", "on"]
    # Rounded, for the order of adding up shares is not fixed.
    counted = rows.mapInArrow(tally, "term string, t double, o double, tn double, on double").groupBy("term").agg(*[F.round(F.sum(n), 6).alias(n) for n in names])
    sums = checkpointed(counted)
    total = sums.filter("term = ''").first()
    if total is None or not total.t:
        return Lexicon({}, {})
    ratio = (F.col("t") + 0.5) / (total.t + 1) / ((F.col("o") + 0.5) / (total.o + 1))
    tried = sums.filter((F.col("term") != "") & (F.col("t") + F.col("o") >= LEAST_TEXTS))
    chance = NormalDist().inv_cdf(1 - 1 / max(2, tried.count())) ** 2
    found = tried.filter((F.col("t") >= LEAST_TEXTS) & (ratio >= LEAST_RATIO) & (likelihood_ratio(total.t, total.o) >= chance))
    top = found.collect()  # bounded by the texts that are fitted on
    weigh = lambda r: math.log((r.tn + 0.5) / (total.tn + 1) / ((r.on + 0.5) / (total.on + 1)))
    lexicon = _chosen({r.term: (r.t, max(0.0, weigh(r))) for r in top}, sums)
    seen = rows.select("label", features(F.col("text"), lexicon).alias("x")).select("label", "x.*").collect()
    x, y = np.array([list(r[1:]) for r in seen]), np.array([float(r[0] > 0) for r in seen])
    return replace(lexicon, model=calibrate(x, y))


def _chosen(terms: dict[str, tuple[int, float]], sums: DataFrame) -> Lexicon:
    """Of a word and the stems it begins with, the plainest that says as much."""
    words = {w: t for w, (t, _) in terms.items() if not w.endswith("-")}
    stems = {w[:-1]: t for w, (t, _) in terms.items() if w.endswith("-")}
    begins = lambda w, least: [w[:k] for k in STEMS if k <= len(w) - least]
    # The most texts of a word that begins with a stem, and of a longer stem that does.
    of_words, of_stems = Counter(), Counter()
    for w, t in words.items():
        for s in begins(w, 0):
            of_words[s] = max(of_words[s], t)
    # A stem must say clearly more than any one word, and than a longer stem.
    use = {s for s, t in stems.items() if t >= 1.3 * of_words[s]}
    for x in use:
        for s in begins(x, 1):
            of_stems[s] = max(of_stems[s], stems[x])
    use = {s for s in use if of_stems[s] < 0.95 * stems[s]}
    use = {s for s in use if use.isdisjoint(begins(s, 1))}
    kept = {w for w in words if use.isdisjoint(begins(w, 0))}
    lexicon = Lexicon({w: terms[w][1] for w in sorted(kept)}, {s: terms[s + "-"][1] for s in sorted(use)})
    if not kept and not use:
        return lexicon

    @arrow_udf("boolean")
    def close(found: pa.Array) -> pa.Array:
        return pa.array([bool((m := lexicon.near(w)) and m[1]) for w in found.to_pylist()])

    # Words within a few edits of some term, or beginning so: bounded by the rows that are fitted on, not by the corpus.
    single = sums.filter((F.col("o") > 0) & (F.col("t") <= 4 * F.col("o")) & (F.col("term") != "") & ~F.col("term").endswith("-"))
    ordinary = [r.term for r in single.filter(close("term")).select("term").collect()]
    return replace(lexicon, ordinary=frozenset(ordinary))


def training_rows(docs: DataFrame, labels: DataFrame, fold: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Texts with their label, outside the fold that is held out; of at most ``FIT_ROWS`` ids."""
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
    one = named.groupBy("id").agg(F.max("label").alias("toxic"))
    bounded = one.withColumn("fold", fold).filter(~F.col("fold")).orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("id", "toxic")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(joinable(bounded), "id").select("text", "toxic")


def features(text: Column, lexicon: Lexicon) -> Column:
    """STRUCT of the three numbers that a score is made of."""

    @arrow_udf("struct<hits: double, length: double, density: double>")
    def of(texts: pa.Array) -> pa.Array:
        found = np.array([lexicon.features(t.as_py()) for t in texts], np.float64).reshape(-1, 3)
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in found.T], ["hits", "length", "density"])

    return of(text)


def toxicity(text: Column, lexicon: Lexicon) -> Column:
    """DOUBLE score of ``text``."""

    @arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([lexicon.score(t.as_py()) for t in texts], pa.float64())

    return of(text)


def _fold(name: str) -> Column:
    return F.coalesce(F.crc32(F.col(name).cast("string")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """The lexicon of the labelled rows whose id is not held out."""
    return fit(training_rows(docs, labels, _fold("id"), id_col, text_col, label_col))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted."""
    scored = docs.select(F.col(id_col), _fold(id_col).alias("held_out"), toxicity(F.col(text_col), learned(docs, labels, id_col, text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``; columns as they are."""
    return docs.filter(toxicity(F.col(text_col), learned(docs, labels, id_col, text_col)) < threshold)

"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams (one to three characters) of a
language, most frequent first. Words are stretches of letters and marks, in
lower case and padded with a gap on either side; an n-gram does not reach over
a gap. A text's own most frequent n-grams are ranked in the same way, and its
distance to a profile is the sum, over its n-grams, of how far each is out of
place; one that the profile lacks counts as the profile's length. The nearest
profile names the language.

Fit. Counts cover every row that the caller hands over. Each task sums n-grams
per language and emits one row for each; profiles are the ``PROFILE`` first of
each language, so what the driver collects is bounded by the number of
languages times that. Prediction is one narrow pass.

Score. How much nearer the best profile is than the second: (d2 - d1) / d2; for
a single learned language the share of places that fit.

Defined cases. A null text, or one without a letter, is ``und`` with score 0,
and so is any text when nothing could be learned. Ties go to the language
that sorts first. Ties between n-grams go by their characters. Very long texts
are counted whole. Rows without language or text teach nothing.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: N-grams in a profile, and of a text that are compared.
PROFILE = 400
GAP = 32
#: Characters of a language that are counted at a time, and a text beyond.
STRETCH = 1 << 19


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """For each code point: 2 a letter, 1 a mark, 0 a gap."""
    kinds = {"L": 2, "M": 1}
    return np.array([kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text with each run of other characters as one gap.

    Empty when the text has no letter.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[points]
    if not (kind == 2).any():
        return np.empty(0, np.uint32)
    points = np.concatenate(([GAP], np.where(kind > 0, points, GAP), [GAP])).astype(np.uint32)
    gap = points == GAP
    return points[~(gap & np.concatenate(([False], gap[:-1])))]


def grams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams as numbers of 21 bits a character, ascending, and their counts."""
    if not len(points):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    used = np.flatnonzero(np.bincount(points))
    base = len(used)
    place = np.zeros(int(used[-1]) + 1, np.int64)
    place[used] = np.arange(base)
    code, gap = place[points], points == GAP
    two = (code[:-1] * base + code[1:])[~(gap[:-1] & gap[1:])]
    three = (code[:-2] * base * base + code[1:-1] * base + code[2:])[~gap[1:-1]]
    out, many = [], []
    for n, codes in ((1, code[~gap]), (2, two), (3, three)):
        if base**n <= 1 << 18 or base**n <= 4 * len(codes):
            counts = np.bincount(codes)
            found = np.flatnonzero(counts)
            counts = counts[found]
        else:
            found, counts = np.unique(codes, return_counts=True)
        key = np.zeros(len(found), np.int64)
        for i in range(n):
            key |= used[found // base ** (n - 1 - i) % base].astype(np.int64) << (21 * (2 - i))
        out.append(key)
        many.append(counts)
    return np.concatenate(out), np.concatenate(many)


def ranked(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by characters."""
    return keys[np.lexsort((keys, -counts))[:PROFILE]]


class Profiles:
    """Rank-order profiles of the learned languages."""

    def __init__(self, profiles: dict[str, list[int]]) -> None:
        self.names = sorted(profiles)
        self.lists = [np.array(profiles[n], np.int64) for n in self.names]
        self.sorted = [(np.sort(x), np.argsort(x)) for x in self.lists]

    def distances(self, own: np.ndarray) -> list[int]:
        at = np.arange(len(own))
        out = []
        for keys, rank in self.sorted:
            i = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
            there = keys[i] == own
            out.append(int(np.where(there, np.minimum(np.abs(rank[i] - at), PROFILE), PROFILE).sum()))
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(*grams(letters(text or "")))
        if not len(own) or not self.names:
            return "und", 0.0
        d = self.distances(own)
        order = sorted(range(len(d)), key=lambda i: d[i])
        if len(d) == 1:
            return self.names[0], 1.0 - d[0] / (PROFILE * len(own))
        best, second = d[order[0]], d[order[1]]
        return self.names[order[0]], (second - best) / second if second else 0.0


def learn(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles from all rows of ``rows`` that have text and language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, Counter] = {}

        def emit() -> pa.RecordBatch:
            flat = [(lang, k, n) for lang, c in sums.items() for k, n in c.items()]
            sums.clear()
            columns = list(zip(*flat, strict=True)) if flat else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["lang", "gram", "n"])

        def add(lang: str, points: list[np.ndarray]) -> None:
            keys, counts = grams(np.concatenate(points))
            sums.setdefault(lang, Counter()).update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))

        for part in batches:
            texts: dict[str, list[np.ndarray]] = {}
            held: Counter = Counter()
            for lang, text in zip(part.column("lang"), part.column("text"), strict=True):
                lang, points = lang.as_py(), letters(text.as_py())
                texts.setdefault(lang, []).append(points)
                held[lang] += len(points)
                if held[lang] > STRETCH:
                    add(lang, texts.pop(lang))
                    held[lang] = 0
            for lang, points in texts.items():
                add(lang, points)
            if sum(map(len, sums.values())) > 150_000:
                yield emit()
        yield emit()

    known = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).dropna()
    totals = known.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = totals.withColumn("rank", place).filter(F.col("rank") <= PROFILE).collect()
    profiles: dict[str, list] = {}
    for r in sorted(top, key=lambda r: (r.lang, r.rank)):
        profiles.setdefault(r.lang, []).append(r.gram)
    return Profiles(profiles)


def languages(text: Column, profiles: Profiles) -> Column:
    """STRUCT<lang STRING, score DOUBLE> of the nearest profile."""

    @arrow_udf("struct<lang: string, score: double>")
    def of(texts: pa.Array) -> pa.Array:
        found = [profiles.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang", "score"])

    return of(text)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is in the fold that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row: id, held_out, lang_pred, score."""
    profiles = learn(docs.filter(~held_out(id_col)), text_col, lang_col)
    found = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), languages(F.col(text_col), profiles).alias("found"))
    return found.select(id_col, "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language can be told; columns as they are.

    Where nothing could be learned no text can be told from another, and all with a letter stay.
    """
    profiles = learn(docs.filter(~held_out(id_col)), text_col, lang_col)
    if not profiles.names:
        profiles = Profiles({"any": [0]})  # an n-gram of no text
    return docs.filter(languages(F.col(text_col), profiles)["lang"] != "und")

"""Subwords of a public vocabulary by longest match, with word ids, markers and special tokens.

A word is lower-cased and written over the vocabulary's byte alphabet; from its
beginning the longest piece that the vocabulary has is taken again and again,
the last piece being one that ends a word. Every byte is a piece of its own, so
nothing is unknown. Python works on the different words of a batch only; all
that is made of the pieces are expressions inside the JVM.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StructType

from tessera.functions import text as T

END = "</w>"
PIECES = "array<struct<word: int, sub: int, piece: string, token_id: int>>"
#: Words that a worker remembers.
REMEMBERED = 200_000
#: Words that are split at a time.
STRETCH = 50_000


def byte_alphabet() -> str:
    """The character that stands for each byte: itself where it prints, else one after the 255th."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256))
    return "".join(chr(b) if b in plain else chr(256 + next(others)) for b in range(256))


class Vocabulary:
    """Pieces inside a word and at its end, and how long they get."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            ids = json.load(f)["model"]["vocab"]
        self.inner = {p: i for p, i in ids.items() if not p.endswith(END)}
        self.final = {p.removesuffix(END): i for p, i in ids.items() if p.endswith(END)}
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.bytes = byte_alphabet()
        self.known: dict[str, tuple[list[str], list[int]]] = {}

    def split(self, word: str) -> tuple[list[str], list[int]]:
        """Pieces and ids of a lower-cased word."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[word] = self._walk("".join(self.bytes[b] for b in word.encode("utf-8", "surrogatepass")))
        return found

    def _walk(self, text: str) -> tuple[list[str], list[int]]:
        pieces, ids, at = [], [], 0
        while at < len(text):
            for n in range(min(self.longest, len(text) - at), 0, -1):
                piece, last = text[at : at + n], at + n == len(text)
                token = (self.final if last else self.inner).get(piece)
                if token is not None:
                    break
            else:
                raise ValueError(f"the vocabulary lacks {text[at]!r}")
            pieces.append(piece + END if last else piece)
            ids.append(token)
            at += n
        return pieces, ids


@lru_cache(maxsize=4)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _split(lists: pa.Array, vocabulary: Vocabulary) -> pa.Array:
    """The pieces of lists of lower-cased words; each different word is split once."""
    flat = lists.flatten().dictionary_encode()
    split = [vocabulary.split(w) for w in flat.dictionary.to_pylist()]
    codes = flat.indices.to_numpy(zero_copy_only=False)
    sizes = np.fromiter((len(i) for _, i in split), np.int64, len(split))
    each = sizes[codes] if len(codes) else np.empty(0, np.int64)
    starts = np.cumsum(sizes) - sizes
    sub = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    at = np.repeat(starts[codes], each) + sub if len(codes) else np.empty(0, np.int64)
    names = pa.array([p for ps, _ in split for p in ps], pa.string()).take(pa.array(at, pa.int64()))
    ids = np.array([i for _, js in split for i in js], np.int32)[at]
    begins = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    word = np.repeat(np.arange(len(codes)) - np.repeat(begins[:-1], np.diff(begins)), each)
    ends = np.concatenate(([0], np.cumsum(each)))[begins].astype(np.int32)
    entries = pa.StructArray.from_arrays([pa.array(word.astype(np.int32)), pa.array(sub.astype(np.int32)), names, pa.array(ids)], ["word", "sub", "piece", "token_id"])
    return pa.ListArray.from_arrays(ends, entries, mask=lists.is_null() if lists.null_count else None)


def _ids(lists: pa.Array, vocabulary: Vocabulary) -> pa.Array:
    """``_split`` without all but the ids."""
    flat = lists.flatten().dictionary_encode()
    split = [vocabulary.split(w)[1] for w in flat.dictionary.to_pylist()]
    codes = flat.indices.to_numpy(zero_copy_only=False)
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    each = sizes[codes] if len(codes) else np.empty(0, np.int64)
    starts, begins = np.cumsum(sizes) - sizes, np.cumsum(each) - each
    at = np.arange(each.sum()) + np.repeat(starts[codes] - begins, each) if len(codes) else np.empty(0, np.int64)
    ids = np.array([i for js in split for i in js], np.int32)[at]
    ends = np.concatenate(([0], np.cumsum(each)))[lists.offsets.to_numpy() - lists.offsets[0].as_py()].astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(ids), mask=lists.is_null() if lists.null_count else None)


def pieces(words: Column, path: str) -> Column:
    """ARRAY<STRUCT<word, sub, piece, token_id>> of an array of words; ``path`` is a vocabulary file that all workers reach."""

    @arrow_udf(PIECES)
    def of(lists: pa.Array) -> pa.Array:
        return _split(lists, _vocabulary(path))

    return of(F.transform(words, F.lower))


def with_pieces(rows: DataFrame, words: str, path: str, name: str = "p") -> DataFrame:
    """``rows`` with the pieces of the column ``words`` in its place, worked on ``STRETCH`` words at a time, for texts of any length."""
    return _worked(rows, words, path, name, PIECES, _split)


def with_ids(rows: DataFrame, words: str, path: str, name: str = "ids") -> DataFrame:
    """``with_pieces`` for the ids alone."""
    return _worked(rows, words, path, name, "array<int>", _ids)


def _worked(rows: DataFrame, words: str, path: str, name: str, kind: str, split: Callable[[pa.Array, Vocabulary], pa.Array]) -> DataFrame:
    carried = [c for c in rows.columns if c != words]
    low = rows.select(*carried, F.transform(words, F.lower).alias("__low"))
    schema = StructType([*[rows.schema[c] for c in carried], *StructType.fromDDL(f"{name} {kind}")])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ends = np.cumsum(np.diff(part.column("__low").offsets.to_numpy()))
            at, done = 0, 0
            while at < part.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, done + STRETCH, side="right")))
                some = part.slice(at, stop - at)
                kept = [some.column(c) for c in carried]
                yield pa.RecordBatch.from_arrays([*kept, split(some.column("__low"), _vocabulary(path))], names=[*carried, name])
                at, done = stop, int(ends[stop - 1])

    return low.mapInArrow(run, schema)


@dataclass(frozen=True)
class Tokenizer:
    """Texts or lists of words to token ids, as a model takes them.

    ``marker`` is a word before every text. With ``special`` the ids begin and
    end with a token that belongs to no word. At most ``longest`` ids stay, the
    special ones included; with ``pad`` shorter ones are filled up to it.
    """

    path: str
    begin_id: int = 49406
    end_id: int = 49407
    pad_id: int = 0
    longest: int = 256
    marker: str | None = None
    special: bool = True
    pad: bool = False

    def words(self, text: Column) -> Column:
        return T.words(T.with_marker(F.coalesce(text, F.lit("")), self.marker))

    def marked(self, words: Column) -> Column:
        """A text that is split already, with the marker before it."""
        return F.concat(F.array(F.lit(self.marker)), words) if self.marker else words

    def encode(self, words: Column) -> Column:
        """STRUCT<input_ids, word_ids, attention>: ids, the word of each (null for special and padded ones), and 1 but for padding."""
        # A word has a piece at least, so no more words than ids are looked at.
        found = F.slice(pieces(F.slice(words, 1, self.longest), self.path), 1, self.longest - 2 * self.special)
        edge = lambda x: F.array(F.lit(x).cast("int")) if self.special else F.array().cast("array<int>")
        ids = F.concat(edge(self.begin_id), F.transform(found, lambda p: p["token_id"]), edge(self.end_id))
        of = F.concat(edge(None), F.transform(found, lambda p: p["word"]), edge(None))
        fill = lambda xs, x: F.concat(xs, F.array_repeat(F.lit(x).cast("int"), F.greatest(F.lit(0), F.lit(self.longest) - F.size(xs)))) if self.pad else xs
        return F.struct(fill(ids, self.pad_id).alias("input_ids"), fill(of, None).alias("word_ids"), fill(F.transform(ids, lambda _: F.lit(1)), 0).alias("attention"))


def aligned(word_ids: Column, tags: Column, vocabulary: tuple[str, ...] = T.NER_TAGS, first_only: bool = True, ignore: int = T.IGNORE) -> Column:
    """The label of each id: its word's tag, ``ignore`` where there is no word, and after a word's first id if ``first_only``."""
    label = lambda w: T.tag_ids(F.get(tags, w), vocabulary)
    before = lambda i: F.when(i > 0, F.get(word_ids, i - 1))
    later = (lambda w, i: w.eqNullSafe(before(i))) if first_only else (lambda w, i: F.lit(False))
    return F.transform(word_ids, lambda w, i: F.when(w.isNull() | later(w, i), F.lit(ignore)).otherwise(label(w)))

"""Whole-batch work on texts: slices of bounded size, and gathering by codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; a longer text is a slice of its own.
SLICE = 1 << 21


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of consecutive stretches; nulls become empty texts."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield at, texts.slice(at, stop - at)
        at, done = stop, int(ends[stop - 1])


def coded(parts: pa.ListArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of lists of strings: each string's code, the different strings, and where each list begins and ends."""
    found = parts.flatten().dictionary_encode()
    offsets = parts.offsets.to_numpy()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary, offsets - offsets[0]


def coded_values(values: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Each string's code, and the different strings."""
    found = values.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_pylist()


def _plain() -> tuple[str, str]:
    """Letters of ASCII and Latin-1, and the marks of ASCII but the apostrophe."""
    ascii_, latin = [chr(c) for c in range(0x21, 0x7F)], [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]
    return "".join(c for c in ascii_ + latin if c.isalpha()), "".join(c for c in ascii_ if not c.isalnum() and c != "'")


LETTERS, MARKS = _plain()


def apart(words: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Which words are plain letters with or without marks after them, and of those the letters and the marks."""
    core, tail = pc.utf8_rtrim(words, characters=MARKS), pc.utf8_ltrim(words, characters=LETTERS)
    simple = pc.and_(pc.equal(pc.utf8_rtrim(tail, characters=MARKS), ""), pc.not_equal(core, ""))
    return simple.to_numpy(zero_copy_only=False), core.filter(simple), tail.filter(simple)


def gather(codes: np.ndarray, entries: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The entries of the codes, one after another, and where each ends."""
    width = np.dtype(kind).itemsize
    blob = np.frombuffer(b"".join(entries), kind)
    sizes = np.fromiter(map(len, entries), np.int64, len(entries)) // width
    starts = (np.cumsum(sizes) - sizes)[codes]
    each = sizes[codes]
    ends = np.cumsum(each)
    if not len(ends):
        return blob[:0], ends
    small = np.int32 if ends[-1] < 1 << 31 and len(blob) < 1 << 31 else np.int64
    at = np.repeat((starts - (ends - each)).astype(small), each)
    at += np.arange(len(at), dtype=small)
    return blob[at], ends

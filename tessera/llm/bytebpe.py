"""Byte-level BPE encoding and decoding in linear time.

A text is cut by the vocabulary's pattern and each match is encoded alone, to
what repeated merging of the lowest-ranked pair gives. Merging is not run.
Bytes are mapped to Latin-1 letters, and one scan of an Aho-Corasick automaton
over all tokens gives the longest token that starts at each byte. A search
places tokens from the left, longest first. Two tokens may be neighbours when
merging would not have crossed their border; this depends on the two alone and
is memoised. A path that cannot go on steps back to the next shorter token, and
a position that failed is never tried again, so each byte is visited a bounded
number of times. A sequence of tokens whose neighbours are all compatible is
the one that merging gives.

Each token is split once into the two tokens whose merge makes it; two tokens
are compatible when no pair of pieces that touch at their border merges before
the pieces are absorbed into the tokens.

Texts are taken a slice at a time: they are cut at spaces that a match can
begin with, each different stretch is encoded once, and the ids are gathered.
Under the pattern ``KNOWN`` letters and the marks after them are two matches,
so these are taken apart for the whole slice; other stretches go through the
pattern. Results are remembered per match in a memory of bounded size.

Defined cases. A null text counts as empty and has no tokens. Special strings
are ordinary text. Unpaired surrogates cannot occur in Spark strings. Very
long texts and matches are encoded whole; an empty table gives an empty result, and
other columns are not touched. Decoding takes any list of ids of
the vocabulary; a null list gives null, an unknown id raises.
"""

from __future__ import annotations

import base64
import re
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from tessera.llm.batched import apart, coded, coded_values, gather, slices
from tessera.llm.memory import Memory

#: Matches in each generation of a worker's memory.
CACHE = 250_000
#: Bytes of text that are encoded at a time.
SLICE = 1 << 22
#: Fixed value: the pattern under which a space, letters and marks are cut as ``_entries`` does.
KNOWN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space that a match can begin with: the character after it is no white
#: space by any definition, so a cut before it never falls into a match.
_CUT = re.compile(r" (?=\S)")
#: A space before white space or the end: such a text cannot be cut at all spaces.
_GAP = " (?:[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|$)"


def cuts(texts: pa.Array) -> pa.ListArray:
    """The stretches of each text, the spaces between them left out."""
    odd = pc.match_substring_regex(texts, _GAP)
    if not pc.any(odd).as_py():
        return pc.split_pattern(texts, " ")
    plain = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
    other = pa.array([_CUT.split(t) for t in texts.filter(odd).to_pylist()], plain.type)
    odd = odd.to_numpy(zero_copy_only=False)
    place = np.where(odd, len(plain) + np.cumsum(odd) - 1, np.cumsum(~odd) - 1)
    return pa.concat_arrays([plain, other]).take(pa.array(place))


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ranks, which are 0, 1, 2, ..."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [token for _, token in ranked]


class ByteBpe:
    """Encoder and decoder of one vocabulary; one per worker."""

    def __init__(self, tokens: list[bytes], pattern: str) -> None:
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.size = [len(t) for t in tokens]
        self._bytes = pa.array(tokens, pa.binary())
        self.findall = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [self._prefix(t) for t in tokens]
        self.parts: list[tuple[int, int]] = []
        self.merged: dict[tuple[int, int], int] = {}
        self._fit: dict[int, bool] = {}
        for i in range(len(tokens)):
            self.parts.append(self._split(i))
            if self.parts[i][0] != i:
                self.merged[self.parts[i]] = i
        self.plain = pattern == KNOWN
        self.known = Memory(lambda m: self._matches([m])[0], CACHE)

    def _prefix(self, token: bytes) -> int:
        """The longest token that is a proper prefix of ``token``, or -1."""
        for n in range(len(token) - 1, 0, -1):
            found = self.rank.get(token[:n])
            if found is not None:
                return found
        return -1

    def _split(self, i: int) -> tuple[int, int]:
        """The two earlier tokens whose merge makes token ``i``; (i, i) for a byte."""
        left, token = self.shorter[i], self.tokens[i]
        while left >= 0:
            right = self.rank.get(token[self.size[left] :])
            if right is not None and left < i and right < i and self._compatible(left, right):
                return left, right
            left = self.shorter[left]
        return i, i

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves the border between the two tokens alone."""
        # Undo merges around the border, the latest first. A pair met on the
        # way would have merged, if its rank is below that of every merge
        # that has been undone, before either side had grown past it.
        bound = len(self.tokens)
        while True:
            if self.merged.get((left, right), bound) < bound:
                return False
            if left > right:
                bound, (_, inner) = left, self.parts[left]
                if inner == left:
                    bound = right + 1
                    first = self.parts[right][0]
                    if first == right:
                        return True
                    right = first
                else:
                    left = inner
            else:
                bound, (first, _) = right + 1, self.parts[right]
                if first == right:
                    bound, (_, inner) = left, self.parts[left]
                    if inner == left:
                        return True
                    left = inner
                else:
                    right = first

    def encode_match(self, match: str) -> list[int]:
        """Ids of one match of the pattern."""
        text = match.encode().decode("latin-1")
        n, size, shorter, fit, many = len(text), self.size, self.shorter, self._fit, len(self.tokens)
        longest = [-1] * n
        for end, token in self.automaton.iter(text):  # later ends are longer
            longest[end + 1 - size[token]] = token
        if size[longest[0]] == n and longest[0] >= 0:
            return [longest[0]]
        if len(fit) > 1_000_000:
            fit.clear()
        closed: set[int] = set()
        out: list[int] = []
        at, token, last = 0, -2, -1
        while at < n:
            if token == -2:
                token = longest[at]
            while token >= 0:
                end = at + size[token]
                if end not in closed:
                    good = last < 0
                    if not good:
                        good = fit.get(last * many + token)
                        if good is None:
                            good = fit[last * many + token] = self._compatible(last, token)
                    if good:
                        out.append(token)
                        at, last, token = end, token, -2
                        break
                token = shorter[token]
            else:
                closed.add(at)
                if not out:
                    raise ValueError("the vocabulary lacks a byte of this text")
                token = shorter[last]
                at -= size[out.pop()]
                last = out[-1] if out else -1
        return out

    def _matches(self, matches: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(ids)}i", *ids) for ids in map(self.encode_match, matches)]

    def _stretches(self, texts: list[str]) -> list[bytes]:
        cut = list(map(self.findall, texts))
        known = self.known
        return [known[m[0]] if len(m) == 1 else b"".join([known[x] for x in m]) for m in cut]

    def _entries(self, found: pa.Array) -> list[bytes]:
        """Ids of different stretches that a space comes before."""
        if not self.plain:
            return self._stretches([" " + x for x in found.to_pylist()])
        simple, core, tail = apart(found)
        cores, names = coded_values(core)
        tails, signs = coded_values(tail)
        stems, ends = self.known.many([" " + x for x in names], self._matches), [self.known[x] if x else b"" for x in signs]
        out = np.empty(len(found), object)
        out[simple] = [stems[i] + ends[j] if signs[j] else stems[i] for i, j in zip(cores.tolist(), tails.tolist(), strict=True)]
        out[~simple] = self._stretches([" " + x for x in found.filter(pa.array(~simple)).to_pylist()])
        return out.tolist()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a slice, one after another, and where each text begins and ends."""
        codes, found, ends = coded(parts := cuts(texts))
        first, heads = coded_values(pc.list_element(parts, 0))
        codes = codes.copy()
        codes[ends[:-1]] = len(found) + first
        ids, upto = gather(codes, self._entries(found) + self._stretches(heads), "<i4")
        return ids, np.concatenate(([0], upto))[ends]

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """Bytes of each list of tokens; null for null."""
        ids = lists.flatten()
        if ids.null_count or (len(ids) and not 0 <= pc.min(ids).as_py() <= pc.max(ids).as_py() < len(self.tokens)):
            raise ValueError("an id is not in the vocabulary")
        parts = self._bytes.take(ids)
        ends = np.frombuffer(parts.buffers()[1], np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        at = np.ascontiguousarray(ends[np.concatenate(([0], np.cumsum(sizes)))])
        found = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(at), parts.buffers()[2]])
        return pc.if_else(lists.is_valid(), found, pa.scalar(None, pa.binary())) if lists.null_count else found


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(read_ranks(path), pattern)


def encode(text: Column, path: str, pattern: str) -> Column:
    """ARRAY<INT> of the token ids of ``text``."""

    @arrow_udf("array<int>")
    def of(texts: pa.Array) -> pa.Array:
        bpe = byte_bpe(path, pattern)
        ids, ends = [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
        for _, some in slices(texts, SLICE):
            more, upto = bpe.encode(some)
            ids.append(more)
            ends.append(upto[1:] + ends[-1][-1])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(np.concatenate(ids)))

    return of(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """BINARY that the token ids stand for."""

    @arrow_udf("binary")
    def of(lists: pa.Array) -> pa.Array:
        return byte_bpe(path, pattern).decode(lists)

    return of(ids)

"""Token counts and ids by a tokenizers file, whole words first.

Two things make this fast without changing a result:

* Words. Both the normaliser and the splitter of the supported files treat a
  text as words between white space, so a word always gives the same tokens.
  Texts are cut at spaces and line feeds only, which every definition of white
  space contains; whatever else a word holds goes to the library as it is.
* Whole tokens (counting). ``whole_tokens`` proves once, from the vocabulary
  alone, which pre-tokens merge into exactly one token: it runs the model on
  each vocabulary string. A pre-token found there counts as one; only the
  rest is merged.

Texts are taken a slice at a time: its words are numbered, each different word
is encoded once, and the ids are gathered by the numbers. Words of plain
letters, with or without marks after them, are cut and lower-cased for the
whole slice at once, so a stem is looked up once however it is written; other
plain words are split here, and all others by the library. A word that
contains an added token's string is left to its whole encoder, so special
strings in texts behave as its default does. Results are remembered per word
in a memory of bounded size.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from tessera.llm.batched import LETTERS, MARKS, apart, coded, coded_values, gather, slices
from tessera.llm.memory import Memory

#: Words in each generation of a worker's memory.
CACHE = 30_000
END_OF_WORD = "</w>"


def words(texts: pa.Array) -> pa.ListArray:
    """The stretches of each text between spaces and line feeds; may hold empty ones."""
    return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")


#: Characters whose normal form is their lower case in every standard.
PLAIN = frozenset(LETTERS + MARKS + "'0123456789")
#: The splitter of the supported files.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, str]:
    """Letters that stand for UTF-8 bytes: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTER = _byte_letters()
_BYTE = {c: b for b, c in _LETTER.items()}


def whole_tokens(tokenizer: Tokenizer, suffix: str = END_OF_WORD) -> frozenset[str]:
    """Pre-tokens that encode to a single token, proved by encoding each candidate."""
    model, out = tokenizer.model, set()
    for v in tokenizer.get_vocab(with_added_tokens=False):
        letters = v.removesuffix(suffix)
        if letters and letters != v and len(model.tokenize(letters)) == 1:
            try:
                out.add(bytes(map(_BYTE.__getitem__, letters)).decode())
            except ValueError:  # a part of a character: no text has it alone
                continue
    return frozenset(out)


class WordTokens:
    """Encodes and counts with one tokenizers file; one per worker and file."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = whole_tokens(self.tokenizer)
        self._merge_model = self.tokenizer.model.tokenize
        #: Of pre-tokens.
        self._counts = Memory(lambda p: self._piece_counts([p])[0], CACHE)
        self._ids = Memory(lambda p: self._piece_ids([p])[0], CACHE)

    def pieces(self, word: str) -> list[str] | None:
        """The word's pre-tokens; None: the library has to cut this one."""
        if not PLAIN.issuperset(word):
            return None
        for added in self.added:
            if added in word:
                return None
        return SPLIT.findall(word.lower())

    @staticmethod
    def _bytes(piece: str) -> str:
        """The letters that stand for the bytes of a pre-token."""
        return piece if piece.isascii() else "".join([_LETTER[b] for b in piece.encode()])

    def _library_ids(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _piece_counts(self, pieces: list[str]) -> list[int]:
        whole, tokenize, letters = self.whole, self._merge_model, self._bytes
        return [1 if p in whole else len(tokenize(letters(p))) for p in pieces]

    def _piece_ids(self, pieces: list[str]) -> list[bytes]:
        tokens = [*map(self._merge_model, map(self._bytes, pieces))]
        ids = struct.pack(f"<{sum(map(len, tokens))}I", *[t.id for ts in tokens for t in ts])
        ends = [0, *accumulate([4 * len(ts) for ts in tokens])]
        return [ids[a:b] for a, b in pairwise(ends)]

    def _count_word(self, word: str) -> int:
        pieces = self.pieces(word)
        return len(self._library_ids(word)) if pieces is None else sum(map(self._counts.__getitem__, pieces))

    def _word_ids(self, word: str) -> bytes:
        pieces = self.pieces(word)
        return self._packed(self._library_ids(word)) if pieces is None else b"".join(map(self._ids.__getitem__, pieces))

    @staticmethod
    def _each(found: pa.Array, known: Memory, make: Callable, other: Callable) -> list:
        """Of each different word what ``known`` has for its letters and the marks after them, or what ``other`` makes of it."""
        simple, core, tail = apart(found)
        cores, names = coded_values(pc.utf8_lower(core))
        tails, signs = coded_values(tail)
        stems, ends = known.many(names, make), [*map(known.__getitem__, signs)]
        out = np.empty(len(found), object)
        out[simple] = [stems[i] + ends[j] if signs[j] else stems[i] for i, j in zip(cores.tolist(), tails.tolist(), strict=True)]
        out[~simple] = [other(w) for w in found.filter(pa.array(~simple)).to_pylist()]
        return out.tolist()

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        for at, some in slices(texts):
            codes, found, ends = coded(words(some))
            each = np.array(self._each(found, self._counts, self._piece_counts, self._count_word), np.int64)
            upto = np.concatenate(([0], np.cumsum(each[codes])))
            out[at : at + len(some)] = np.diff(upto[ends])
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text begins and ends.

        For texts of a slice: what is held grows with their bytes.
        """
        codes, found, ends = coded(words(texts))
        ids, upto = gather(codes, self._each(found, self._ids, self._piece_ids, self._word_ids), "<u4")
        return ids, np.concatenate(([0], upto))[ends]


@lru_cache(maxsize=4)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)

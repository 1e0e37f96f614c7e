"""Token expressions: markers, words, pieces, masks and label alignment."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tag vocabularies in the order of their ids.
NER_TAGS = ("O", "B-LOC", "I-LOC", "B-ORG", "I-ORG", "B-PER", "I-PER", "B-MISC", "I-MISC")
POS_TAGS = (
    "N", "Np", "Nc", "Nu", "Ni", "V", "A", "P", "L", "M", "R", "E", "C", "Cc", "I", "T",
    "B", "Ab", "Cb", "Eb", "Mb", "Nb", "Pb", "Vb", "Y", "Ny", "Vy", "Xy", "X", "Z", "CH",
)
PUNCTUATION = tuple(string.punctuation)
IGNORE = -100


def with_marker(text: Column, marker: str | None) -> Column:
    return F.concat_ws(" ", F.lit(marker), text) if marker else text


def words(text: Column) -> Column:
    """Words between spaces, tabs and line ends; none of them empty."""
    return F.filter(F.split(text, "[ \\t\\n\\r]+"), lambda w: w != "")


def pieces(word: Column, width: int = 4) -> Column:
    """A word cut into subwords of ``width`` characters."""
    starts = F.sequence(F.lit(1), F.char_length(word), F.lit(width))
    return F.transform(starts, lambda i: F.substring(word, i, F.lit(width)))


def token_mask(token: Column, masked: tuple[str, ...] = PUNCTUATION) -> Column:
    return ~token.isin(*masked)


def truncate_pad(ids: Column, length: int, pad: int) -> Column:
    """``ids`` cut to ``length`` and filled up with ``pad``."""
    cut = F.slice(ids, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(length) - F.size(cut))))


def aligned_label(tag_id: Column, word: Column, before: Column, first_only: bool = True, ignore: int = IGNORE) -> Column:
    """The label of a subword: its word's, but ``ignore`` after the first one."""
    if not first_only:
        return F.when(word.isNull(), F.lit(ignore)).otherwise(tag_id)
    return F.when(word.isNull() | word.eqNullSafe(before), F.lit(ignore)).otherwise(tag_id)


def tag_ids(tag: Column, vocabulary: tuple[str, ...] = NER_TAGS) -> Column:
    names = F.array(*[F.lit(t) for t in vocabulary])
    return (F.array_position(names, tag) - 1).cast("int")


def with_marker_tag(tags: Column, marker: str | None, first: str = "O") -> Column:
    """``tags`` with one more for the marker before a text: ``O``, or ``N`` for parts of speech."""
    return F.concat(F.array(F.lit(first)), tags) if marker else tags


def binary_labels(label: Column, kept: tuple[int, ...], ignore: int = IGNORE) -> Column:
    """1 for labels among ``kept`` and 0 for others; ignored ones stay."""
    return F.when(label == ignore, F.lit(ignore)).otherwise(label.isin(*kept).cast("int"))


def split_word_labels(words: Column, tags: Column, vocabulary: tuple[str, ...] = NER_TAGS, width: int = 4, first_only: bool = True, ignore: int = IGNORE) -> Column:
    """ARRAY<STRUCT<word, sub, piece, label>> of a text that is split into words already, tag by tag."""
    one = lambda w, i: F.transform(
        pieces(w, width),
        lambda x, j: F.struct(
            i.cast("bigint").alias("word"),
            j.cast("bigint").alias("sub"),
            x.alias("piece"),
            (F.when(j > 0, F.lit(ignore)).otherwise(tag_ids(F.get(tags, i), vocabulary)) if first_only else tag_ids(F.get(tags, i), vocabulary)).alias("label"),
        ),
    )
    return F.flatten(F.transform(words, one))


def label_names(predicted: Column, gold: Column, vocabulary: tuple[str, ...] = NER_TAGS, ignore: int = IGNORE) -> Column:
    """ARRAY<STRUCT<predicted, gold>> of tag names, without the positions whose gold label is ignored."""
    names = F.array(*[F.lit(t) for t in vocabulary])
    both = F.filter(F.arrays_zip(predicted.alias("p"), gold.alias("g")), lambda x: x["g"] != ignore)
    return F.transform(both, lambda x: F.struct(F.get(names, x["p"]).alias("predicted"), F.get(names, x["g"]).alias("gold")))


def segmented(text: Column, segment: Column | None = None) -> Column:
    """Words joined by one space; ``segment`` is a pluggable ARRAY<STRING>, else words between white space."""
    return F.array_join(words(text) if segment is None else segment, " ")


def without_last(mask: Column) -> Column:
    """An ARRAY<INT> mask with its last set position, the separator's, put to 0; the mask is set from its start."""
    n = F.aggregate(mask, F.lit(0), lambda a, x: a + x.cast("int"))
    return F.transform(mask, lambda x, i: F.when(i == n - 1, F.lit(0)).otherwise(x.cast("int")))

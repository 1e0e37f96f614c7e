"""Exact duplicates by progressive refinement, with DataFrame functions only.

Texts are equal when they are identical without white space, that is without
the characters 0x20 and 0x09 to 0x0D. Rows are refined in three steps, each on
what the one before left together. The first counts rows by length alone. The
second hashes a prefix of those whose length is shared, from the beginning of
the text. The third takes the SHA-256 of the whole text of those that share
length and prefix hash. A row that is alone at a step is decided there.

Scale. Steps one and two move two numbers a row, pre-aggregated; texts never
enter a shuffle while the keys that survive stay under the bounds of
``joinable`` and ``looked_up``, and beyond them only those of survivors do.
Groups are aggregated with a partial step, so copies that make up a third of
all rows cost one row per task, and the join that hands each copy its decision
spreads them. Each step reads the texts once: three passes, and one more for
``keep_one``.

Defined cases. A null text counts as empty, and all empty texts are equal. Of
equal texts the one with the most code points in the original stays, then the
one with the smallest id; a null id comes last. Rows that repeat both id and
text share their decision; ``keep_one`` lets one of them through. An empty
table gives an empty result. Other input columns are passed through by
``keep_one`` and ignored by ``duplicates``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.runtime import checkpointed, joinable, looked_up

#: Code points of the normalised text that step two hashes, and of the original they are looked for in first.
PREFIX, BEGINNING = 128, 1024
_LEN, _PRE, _SHA, _MET, _KEEP, _MOST, _SIZE, _TIMES = (f"__dedup_{x}" for x in ("length", "prefix", "sha", "met", "keep", "most", "size", "times"))


def normalised(text: Column) -> Column:
    """``text`` without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for gap in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(gap), F.lit(""))
    return out


def _prefix(text: Column) -> Column:
    """The first code points of the normalised text; the whole text is read only where its beginning is mostly white space."""
    some = normalised(F.left(text, F.lit(BEGINNING)))
    return F.left(F.when(F.char_length(some) >= PREFIX, some).otherwise(normalised(text)), F.lit(PREFIX))


def _survivors(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``_MET`` true where steps one and two left company, else null."""
    text = F.col(text_col)
    sized = docs.withColumn(_LEN, F.octet_length(normalised(text)))
    lengths = joinable(sized.groupBy(_LEN).agg(F.count("*").alias("n")).filter("n > 1").select(_LEN))
    hashed = lambda df: df.withColumn(_PRE, F.xxhash64(_prefix(text)))
    shared = hashed(sized.join(lengths, _LEN, "left_semi")).groupBy(_LEN, _PRE).agg(F.count("*").alias("n")).filter("n > 1")
    shared = joinable(shared.select(_LEN, _PRE, F.lit(True).alias(_MET)))
    marked = sized.join(lengths.withColumn(_PRE, F.lit(1)), _LEN, "left")
    marked = marked.withColumn(_PRE, F.when(F.col(_PRE).isNotNull(), F.xxhash64(_prefix(text))))
    return marked.join(shared, [_LEN, _PRE], "left").drop(_LEN, _PRE)


def _groups(hashed: DataFrame, id_col: str, chars: Column) -> DataFrame:
    """Of each SHA-256 that several rows have: id and code points of the row that stays, how often it is there, and rows."""
    each = hashed.filter(F.col(_SHA).isNotNull()).groupBy(_SHA, F.col(id_col).alias("id"), chars.alias("chars")).agg(F.count("*").alias("n"))
    first = F.min(F.struct((-F.col("chars")).alias("chars"), F.col("id").isNull().alias("none"), "id", "n"))
    one = each.groupBy(_SHA).agg(first.alias("first"), F.sum("n").alias(_SIZE)).filter(F.col(_SIZE) > 1)
    return one.select(_SHA, F.col("first.id").alias(_KEEP), (-F.col("first.chars")).alias(_MOST), F.col("first.n").alias(_TIMES), _SIZE, F.col(_SIZE).alias("n"))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per row: id, keep_id, group_size, kept, text_sha256.

    ``text_sha256`` is null where the row was decided before step three,
    unless ``digest`` asks for it everywhere.
    """
    sha = F.sha2(normalised(F.col(text_col)), 256)
    chars = F.char_length(F.coalesce(F.col(text_col), F.lit("")))
    rows = _survivors(docs.select(F.col(id_col).alias("id"), F.col(text_col)), text_col)
    rows = rows.select("id", chars.alias("chars"), _MET, (sha if digest else F.when(F.col(_MET), sha)).alias("text_sha256"))
    rows = checkpointed(rows.withColumn(_SHA, F.when(F.col(_MET), F.col("text_sha256"))))
    decided = looked_up(rows, _groups(rows, "id", F.col("chars")), _SHA, "n")
    keep = F.when(F.col(_SIZE).isNotNull(), F.col(_KEEP)).otherwise(F.col("id"))
    return decided.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce(_SIZE, F.lit(1)).cast("bigint").alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"),
        "text_sha256",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one of each group of equal texts."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    chars = F.char_length(F.coalesce(F.col(text_col), F.lit("")))
    marked = _survivors(docs, text_col).withColumn(_SHA, F.when(F.col(_MET), F.sha2(normalised(F.col(text_col)), 256)))
    groups = checkpointed(_groups(marked, id_col, chars))
    held = looked_up(marked, groups.withColumnRenamed("n", "__dedup_n"), _SHA, "__dedup_n")
    stays = F.col(_SIZE).isNull() | (F.col(_KEEP).eqNullSafe(F.col(id_col)) & (chars == F.col(_MOST)))
    held = held.filter(stays)
    if groups.filter(F.col(_TIMES) > 1).isEmpty():
        return held.select(columns)
    again = F.coalesce(F.col(_TIMES) > 1, F.lit(False))
    return held.filter(~again).select(columns).unionByName(held.filter(again).dropDuplicates([_SHA]).select(columns))

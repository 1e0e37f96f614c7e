"""Static pruning of token indexes, and the statistics it needs.

Tokens have columns pid, pos, token_id, vec and valid (whether unmasked).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import dot
from tessera.operators.search import _ragged, packed


def _doc():
    return Window.partitionBy("pid")

def keyword(tokens: DataFrame, threshold: float, apply_weight: bool = False) -> DataFrame:
    """Tokens of at least the threshold weight, scaled by it if asked."""
    kept = tokens.filter(F.col("weight") >= threshold)
    return kept.withColumn("vec", F.transform("vec", lambda x: x * F.col("weight"))) if apply_weight else kept


def first_tokens(tokens: DataFrame, share: float) -> DataFrame:
    """Valid tokens whose position is below ``share`` of the valid count."""
    n = F.count(F.when(F.col("valid"), 1)).over(_doc())
    return tokens.withColumn("n", n).filter(F.col("valid") & (F.col("pos") < F.floor(F.col("n") * share))).drop("n")


def _means(tokens: DataFrame) -> DataFrame:
    """(pid, mean): the mean vector of each document's valid tokens, a block of documents at a time."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lengths, matrix = _ragged(pa.Table.from_batches([part]))
            if not len(matrix):
                continue
            means = np.add.reduceat(matrix, np.cumsum(lengths) - lengths, axis=0) / lengths[:, None]
            lists = pa.ListArray.from_arrays(np.arange(len(means) + 1, dtype=np.int32) * matrix.shape[1], means.ravel())
            yield pa.RecordBatch.from_arrays([part.column("pid"), lists], names=["pid", "mean"])

    kind = tokens.schema["pid"].dataType.simpleString()
    return packed(tokens.filter("valid"), "pid", "pos").mapInArrow(run, f"pid {kind}, mean array<double>")


def doc_means(tokens: DataFrame) -> DataFrame:
    return _means(tokens)


def top_attention(tokens: DataFrame, share: float) -> DataFrame:
    """The tokens most similar to their document's mean, one at least."""
    scored = tokens.filter("valid").join(_means(tokens), "pid").withColumn("attention", F.round(dot("vec", "mean"), 6))
    place = F.row_number().over(_doc().orderBy(F.desc("attention"), F.asc("pos")))
    scored = scored.withColumns({"place": place, "n": F.count("*").over(_doc())})
    return scored.filter(F.col("place") <= F.greatest(F.floor(F.col("n") * share), F.lit(1))).drop("place", "n", "mean")


def token_idf(tokens: DataFrame) -> DataFrame:
    """(token_id, df, idf): documents that hold the token, and ln(N / df)."""
    per = tokens.select("pid", "token_id").distinct().groupBy("token_id").agg(F.count("*").alias("df"))
    total = tokens.agg(F.count_distinct("pid").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("token_id", "df", F.round(F.ln(F.col("total") / F.col("df")), 6).alias("idf"))


def top_idf(tokens: DataFrame, share: float, strict: bool = False) -> DataFrame:
    """The rarest tokens of each document, and its first token always.

    With ``strict`` the first token appears a second time when it was chosen.
    """
    scored = tokens.filter("valid").join(token_idf(tokens).select("token_id", "idf"), "token_id")
    place = F.row_number().over(_doc().orderBy(F.desc("idf"), F.asc("pos")))
    scored = scored.withColumns({"place": place, "n": F.count("*").over(_doc())})
    chosen = F.col("place") <= F.floor(F.col("n") * share)
    if not strict:
        return scored.filter(chosen | (F.col("pos") == 0)).drop("place", "n")
    return scored.filter(chosen).unionByName(scored.filter("pos = 0")).drop("place", "n")

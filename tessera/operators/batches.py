"""Samples, splits, batches, masking and chunks; all by hashes, so repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.store import stored


def share_of(*key: Column) -> Column:
    """A number from 0 up to 1 that depends on the key alone, alike in SQL engines."""
    text = F.concat_ws("-", *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    return rows.orderBy(share_of(F.lit(seed), F.col(key)), key).limit(n)


def split(rows: DataFrame, key: str, share: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    part = share_of(F.lit(seed), F.col(key))
    return rows.filter(part >= share), rows.filter(part < share)


def shuffled(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return rows.orderBy(share_of(F.lit(seed), F.col(key)), key)


#: Rows in a range of keys that one task numbers, and ranges at most.
RANGE, RANGES = 1_000_000, 4096


def _ranged(rows: DataFrame, key: str, per_range: int) -> DataFrame:
    """``rows`` with ``__range``: ranges of the key that hold about as many rows each, in order.

    Bounds are quantiles of the keys that are there, so a few far keys do not
    leave the rest in one range. Equal keys share a range.
    """
    from pyspark.ml.feature import Bucketizer

    many = min(RANGES, max(1, -(-rows.count() // per_range)))
    bounds = rows.agg(F.percentile_approx(F.col(key).cast("double"), [i / many for i in range(1, many)], 20 * many)).first()[0] if many > 1 else None
    if not bounds:
        return rows.withColumn("__range", F.lit(0).cast("bigint"))
    inf = float("inf")
    splits = [-inf, *sorted({x for x in bounds if -inf < x < inf}), inf]
    deal = Bucketizer(splits=splits, inputCol="__key", outputCol="__cell", handleInvalid="keep")
    cut = deal.transform(rows.withColumn("__key", F.col(key).cast("double")))
    return cut.withColumn("__range", F.col("__cell").cast("bigint")).drop("__key", "__cell")


def running(rows: DataFrame, key: str, weight: Column | None = None, per_range: int | None = None) -> DataFrame:
    """``rows`` with ``at``, the sum of ``weight`` over the rows before them in the order of ``key``; without one their place from 0.

    Each range of keys is summed by itself and begins where those before end,
    so no task sees more than its range. A null key comes nowhere and is left out.
    """
    rows = rows.filter(F.col(key).isNotNull()).withColumn("__weight", (F.lit(1) if weight is None else weight).cast("bigint"))
    cut = _ranged(rows, key, RANGE if per_range is None else per_range)
    totals = cut.groupBy("__range").agg(F.sum("__weight").alias("__n"))
    before = lambda w, x: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = totals.select("__range", before(Window.orderBy("__range"), "__n").alias("__begin"))
    inside = before(Window.partitionBy("__range").orderBy(key), "__weight")
    placed = cut.join(F.broadcast(begins), "__range").withColumn("at", F.col("__begin") + inside)
    return placed.drop("__range", "__begin", "__weight")


def in_order(rows: DataFrame, key: str, per_bucket: int | None = None) -> DataFrame:
    """``rows`` with ``at``, their place from 0 in the order of ``key``; see ``running``."""
    return running(rows, key, per_range=per_bucket)


def ordered_batches(rows: DataFrame, size: int, key: str, drop_last: bool = True) -> DataFrame:
    """Rows with their batch number in the order of ``key``, over the whole table."""
    numbered = in_order(rows, key).withColumn("batch", F.floor(F.col("at") / size).cast("bigint"))
    if not drop_last:
        return numbered.drop("at")
    whole = numbered.agg(F.floor(F.count("*") / size).alias("whole"))
    return numbered.join(F.broadcast(whole), F.col("batch") < F.col("whole")).drop("at", "whole")


def sequential(rows: DataFrame, key: str) -> DataFrame:
    """Rows in the order of their key, as they are read for validation."""
    return rows.orderBy(key)


def frozen_masks(tokens: DataFrame, path: str, p: float = 0.2, mask_id: int = -1, seed: int = 0) -> DataFrame:
    """A validation set masked once, written to ``path`` and read back; ids are named ``masked_id``."""
    whole_word_mask(tokens, p, mask_id, seed).withColumnRenamed("token_id", "masked_id").write.mode("overwrite").parquet(path)
    return tokens.sparkSession.read.parquet(path)


def batches(rows: DataFrame, size: int, key: str, group: str, drop_last: bool = True) -> DataFrame:
    """Rows with a batch number inside each ``group``, in order of ``key``."""
    w = Window.partitionBy(group)
    numbered = rows.withColumn("batch", F.floor((F.row_number().over(w.orderBy(key)) - 1) / size).cast("bigint"))
    full = F.count("*").over(Window.partitionBy(group, "batch"))
    return numbered.withColumn("n", full).filter(F.col("n") == size).drop("n") if drop_last else numbered


def padded(rows: DataFrame, batch: list[str], ids: str, pad: int) -> DataFrame:
    """``ids`` filled up to the longest of its batch."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(*batch))
    fill = F.array_repeat(F.lit(pad), longest - F.size(ids))
    return rows.withColumn(ids, F.concat(ids, fill))


def whole_word_mask(tokens: DataFrame, p: float = 0.2, mask_id: int = -1, seed: int = 0, ignore: int = -100) -> DataFrame:
    """Tokens (doc, word, sub, token_id) with masked ids and labels, word by word."""
    hit = share_of(F.lit(seed), F.col("doc"), F.col("word")) < p
    return tokens.withColumn("label", F.when(hit, F.col("token_id")).otherwise(F.lit(ignore))).withColumn("token_id", F.when(hit, F.lit(mask_id)).otherwise(F.col("token_id")))


def token_mask(tokens: DataFrame, p: float = 0.15, mask_id: int = -1, seed: int = 0, ignore: int = -100) -> DataFrame:
    hit = share_of(F.lit(seed), F.col("doc"), F.col("word"), F.col("sub")) < p
    return tokens.withColumn("label", F.when(hit, F.col("token_id")).otherwise(F.lit(ignore))).withColumn("token_id", F.when(hit, F.lit(mask_id)).otherwise(F.col("token_id")))


def _apart(rows: DataFrame, key: str, ids: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` made once and written, with ``__row``, and (key, __row, n), their key and length, which alone are numbered."""
    kept = stored(rows.filter(F.col(key).isNotNull()).withColumn("__row", F.monotonically_increasing_id()).withColumn("n", F.size(ids).cast("bigint")))
    return kept.drop("n"), kept.select(key, "__row", "n")


def padded_batches(rows: DataFrame, size: int, key: str, ids: str, pad: int) -> DataFrame:
    """``padded`` rows of the full ``ordered_batches``. Only keys and lengths are numbered; lists are made once and move once."""
    kept, lengths = _apart(rows, key, ids)
    w = Window.partitionBy("batch")
    batched = in_order(lengths, key).withColumn("batch", F.floor(F.col("at") / size).cast("bigint"))
    told = batched.withColumns({"longest": F.max("n").over(w), "many": F.count("*").over(w)}).filter(F.col("many") == size)
    met = kept.join(told.select("__row", "batch", "longest"), "__row")
    fill = F.array_repeat(F.lit(pad), (F.col("longest") - F.size(ids)).cast("int"))
    return met.withColumn(ids, F.concat(ids, fill)).drop("__row", "longest")


def chunked(rows: DataFrame, size: int, key: str, ids: str = "ids", batch: int = 1000) -> DataFrame:
    """(batch, chunk, ids): runs of ``size`` ids over the texts of a batch, one after another in the order of ``key``.

    A batch is ``batch`` rows that follow each other; its last ids, fewer than
    ``size``, go. A text is cut only where chunks meet in it, and only parts of
    chunks that several texts share are brought together.
    """
    kept, lengths = _apart(rows.select(key, ids), key, ids)
    numbered = in_order(lengths, key).withColumn("batch", F.floor(F.col("at") / batch).cast("bigint"))
    w = Window.partitionBy("batch").orderBy("at")
    begin = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    placed = kept.join(numbered.withColumn("begin", begin).filter("n > 0").select("__row", "batch", "at", "begin"), "__row")
    met = F.sequence(F.floor(F.col("begin") / size), F.floor((F.col("begin") + F.size(ids) - 1) / size))

    def part(chunk: Column) -> Column:
        start = F.greatest(chunk * size - F.col("begin"), F.lit(0)).cast("int")
        stop = F.least((chunk + 1) * size - F.col("begin"), F.size(ids)).cast("int")
        return F.struct(chunk.cast("bigint").alias("chunk"), F.slice(ids, start + 1, stop - start).alias("part"))

    # A text's list is cut before its rows are made, so no row carries the whole of it.
    cut = placed.select("batch", "at", F.explode(F.transform(met, part)).alias("c")).select("batch", "at", "c.chunk", "c.part")
    full = F.size("part") == size
    entry = F.array_sort(F.collect_list(F.struct("at", "part")))
    shared = cut.filter(~full).groupBy("batch", "chunk").agg(entry.alias("p")).select("batch", "chunk", F.flatten("p.part").alias("ids")).filter(F.size("ids") == size)
    return cut.filter(full).select("batch", "chunk", F.col("part").alias("ids")).unionByName(shared)


def chunks(ids: Column, size: int) -> Column:
    """ARRAY of runs of ``size`` ids each, in their order; a short tail goes, so fewer ids give none."""
    whole = F.floor(F.size(ids) / size).cast("int")
    places = F.when(whole > 0, F.sequence(F.lit(0), whole - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.slice(ids, i * size + 1, size))

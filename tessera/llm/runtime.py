"""Helpers on the session: cutting lineage so that jobs survive lost executors, and joins that spread hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this application.

    It is in the session's ``spark.checkpoint.dir``. Only where none is set,
    as in tests on one machine, is it a temporary one.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


@contextmanager
def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """Lets a batch that goes to a Python worker hold at most ``most`` bytes, or one row.

    By itself a session allows 64 MB, which executor and worker both hold, with
    room to grow. A smaller bound that the session has already is kept. The
    setting is read when a plan runs, so what is to be bounded must run inside;
    afterwards the session is as it was.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if 0 < held <= most:
        yield
        return
    before = spark.conf.get(name, None)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as a Parquet table in the shared checkpoint folder.

    For wide rows: a reader takes only the columns it needs.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _within(df: DataFrame, rows: int, weight: Column | None) -> bool:
    """Whether ``df`` has at most ``rows`` rows, each counting ``weight``."""
    if weight is None:
        return df.limit(rows + 1).count() <= rows
    return (df.agg(F.sum(weight + 1)).first()[0] or 0) <= rows


def joinable(df: DataFrame, rows: int = 500_000, weight: Column | None = None) -> DataFrame:
    """``df``, materialised; marked for broadcast when it has at most ``rows`` rows.

    Meant for rows of a few short columns; ``weight`` says how many values
    more a row holds. Beyond the bound the join that uses it shuffles, and
    Spark splits what is skewed.
    """
    done = checkpointed(df)
    return F.broadcast(done) if _within(done, rows, weight) else done


def looked_up(rows: DataFrame, table: DataFrame, key: str, size: str, bound: int = 500_000, hot: int = 4096, weight: Column | None = None) -> DataFrame:
    """``rows`` with what ``table`` says of their ``key``, null where it says nothing.

    ``table`` has each key once and in ``size`` how many rows have it. Up to
    ``bound`` keys are broadcast, so no row moves. Beyond that only keys of
    more than ``hot`` rows are (at most one for so many rows, and again under
    the bound), and just the rows of others meet the table by a shuffle: a key
    that a third of all rows share never lands in one task. ``weight`` is as
    in ``joinable``.
    """
    table = checkpointed(table)
    if _within(table, bound, weight):
        return rows.join(F.broadcast(table.drop(size)), key, "left")
    large = joinable(table.filter(F.col(size) > hot), bound, weight)
    met = rows.join(large.drop(size), key)
    known = rows.filter(F.col(key).isNotNull()).join(large.select(key), key, "left_anti")
    rest = known.join(table.filter(F.col(size) <= hot).drop(size), key, "left")
    told = [f for f in table.schema.fields if f.name not in (key, size)]
    blank = rows.filter(F.col(key).isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in told])
    return met.unionByName(rest).unionByName(blank)

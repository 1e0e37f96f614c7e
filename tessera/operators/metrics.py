"""Ranking metrics over hits (qid, pid, rank) and relevance pairs (qid, pid).

Means go over all queries that have a relevant document, found or not.
Repeated relevance pairs count in how many documents are relevant, not in hits.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def judged(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid, relevant, rank, rel): one row per hit, and one for a query without hits."""
    need = qrels.groupBy("qid").agg(F.count("*").alias("relevant"))
    marks = qrels.select("qid", "pid").distinct().withColumn("rel", F.lit(1))
    rows = need.join(hits.select("qid", "pid", "rank"), "qid", "left").join(marks, ["qid", "pid"], "left")
    return rows.select("qid", "relevant", "rank", F.coalesce("rel", F.lit(0)).alias("rel"))


def per_query(hits: DataFrame, qrels: DataFrame, ks: list[int]) -> DataFrame:
    """All metrics of each query at each cut-off."""
    rows = judged(hits, qrels)
    seen = F.sum("rel").over(Window.partitionBy("qid").orderBy("rank"))
    rows = rows.withColumn("seen", seen)
    cuts = rows.withColumn("k", F.explode(F.array(*[F.lit(k).cast("bigint") for k in ks])))
    hit = (F.col("rel") == 1) & (F.col("rank") <= F.col("k"))
    when = lambda x: F.when(hit, x)
    one = F.lit(1.0)
    sums = cuts.groupBy("qid", "relevant", "k").agg(
        F.coalesce(F.sum(when(1)), F.lit(0)).alias("found"),
        F.coalesce(one / F.min(when(F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.sum(when(one / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"),
        F.coalesce(F.sum(when(F.col("seen") / F.col("rank"))), F.lit(0.0)).alias("precisions"),
    )
    least = F.least("relevant", "k")
    ideal = F.aggregate(F.sequence(F.lit(1).cast("bigint"), least), F.lit(0.0), lambda s, i: s + one / F.log2(i + 1))
    return sums.select(
        "qid",
        "k",
        (F.col("found") > 0).cast("double").alias("accuracy"),
        (F.col("found") / F.col("k")).alias("precision"),
        (F.col("found") / F.col("relevant")).alias("recall"),
        "mrr",
        (F.col("dcg") / ideal).alias("ndcg"),
        (F.col("precisions") / least).alias("map"),
    )


NAMES = ("accuracy", "precision", "recall", "mrr", "ndcg", "map")


def evaluate(hits: DataFrame, qrels: DataFrame, ks: list[int], names: tuple[str, ...] = NAMES) -> DataFrame:
    """(k, one column per metric), rounded to six decimals."""
    return per_query(hits, qrels, ks).groupBy("k").agg(*[F.round(F.avg(n), 6).alias(n) for n in names])


def _decimals(n: int) -> Callable[[Column], Column]:
    """Numbers as text of ``n`` decimals, rounded by their exact value as printf of C and SQL does; Java's rounds their shortest digits half up."""

    @F.arrow_udf("string")
    def text(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f"{v:.{n}f}" for v in x.to_pylist()], pa.string())

    return text


def report(metrics: DataFrame, label: str) -> DataFrame:
    """(line): percentages for ratios, four decimals for the rest."""
    percent, plain = _decimals(2), _decimals(4)
    shown = F.concat_ws(
        " ", *[F.format_string(f"{n}@%d: %s%%", F.col("k"), percent(F.col(n) * 100)) if n in NAMES[:3] else F.format_string(f"{n}@%d: %s", F.col("k"), plain(F.col(n))) for n in metrics.columns if n != "k"]
    )
    return metrics.select(F.concat_ws(" ", F.lit(label), shown).alias("line"))


def as_row(metrics: DataFrame, label: str, epoch: int, steps: int) -> DataFrame:
    """One wide row for an appended file of results."""
    cells = metrics.select(F.explode(F.array(*[F.struct(F.lit(n).alias("m"), F.col("k"), F.col(n).alias("v")) for n in metrics.columns if n != "k"])).alias("c"))
    wide = cells.select(F.lit(epoch).alias("epoch"), F.lit(steps).alias("steps"), F.concat(F.lit(f"{label}-"), "c.m", F.lit("@"), "c.k").alias("name"), "c.v")
    return wide.groupBy("epoch", "steps").pivot("name").agg(F.first("v"))


def spans(tags: DataFrame) -> DataFrame:
    """Entities of BIO tags (row, idx, tag): (row, kind, start, end)."""
    order = Window.partitionBy("row").orderBy("idx")
    kind = F.when(F.col("tag") != "O", F.substring("tag", 3, 100))
    rows = tags.withColumns({"kind": kind, "before": F.lag(kind).over(order)})
    starts = (F.col("tag").startswith("B-") | ~F.col("kind").eqNullSafe(F.col("before"))).cast("int")
    rows = rows.withColumn("island", F.sum(starts).over(order)).filter("kind is not null")
    return rows.groupBy("row", "island", "kind").agg(F.min("idx").alias("start"), F.max("idx").alias("end")).drop("island")


def span_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: entity precision, recall and F1."""
    a, b = spans(gold), spans(predicted)
    same = a.join(b, ["row", "kind", "start", "end"]).agg(F.count("*").alias("both"))
    return _ratios(same.crossJoin(a.agg(F.count("*").alias("g"))).crossJoin(b.agg(F.count("*").alias("p"))))


def span_scores_of_lists(texts: DataFrame, tags: str) -> DataFrame:
    """``span_scores`` of texts whose ``tags`` are an ARRAY<STRUCT<gold, predicted>> of BIO tags.

    One pass over each list counts its entities and those that begin, end and
    are named alike; nothing but three counts leaves a row.
    """
    none = F.lit(None).cast("string")
    state = F.struct(F.lit(0).cast("bigint").alias("g"), F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("both"), F.lit(False).alias("open"), none.alias("a"), none.alias("b"))
    kind = lambda tag: F.when(tag != "O", F.substring(tag, 3, 100))

    def step(s: Column, t: Column) -> Column:
        a, b = kind(t["gold"]), kind(t["predicted"])
        begins = lambda k, tag, before: k.isNotNull() & (tag.startswith("B-") | ~k.eqNullSafe(before))
        ga, gb = begins(a, t["gold"], s["a"]), begins(b, t["predicted"], s["b"])
        more_a, more_b = a.isNotNull() & ~ga, b.isNotNull() & ~gb
        return F.struct(
            (s["g"] + ga.cast("bigint")).alias("g"),
            (s["p"] + gb.cast("bigint")).alias("p"),
            (s["both"] + (s["open"] & ~more_a & ~more_b).cast("bigint")).alias("both"),
            ((ga & gb & a.eqNullSafe(b)) | (s["open"] & more_a & more_b)).alias("open"),
            a.alias("a"),
            b.alias("b"),
        )

    found = texts.select(F.aggregate(tags, state, step, lambda s: F.struct((s["both"] + s["open"].cast("bigint")).alias("both"), s["g"].alias("g"), s["p"].alias("p"))).alias("n"))
    sums = [F.coalesce(F.sum(f"n.{c}"), F.lit(0)).alias(c) for c in ("both", "g", "p")]
    return _ratios(found.agg(*sums))


def _ratios(n: DataFrame) -> DataFrame:
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    p, r = ratio(F.col("both"), F.col("p")), ratio(F.col("both"), F.col("g"))
    return n.select(p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))

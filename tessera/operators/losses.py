"""Forward values of ranking losses, as aggregates over score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _r(x: Column, name: str) -> Column:
    return F.round(x, 6).alias(name)


def next_negatives(rows: DataFrame) -> DataFrame:
    """(qid, pid, score, rel) with ``neg_score``: that of the query's next document by id which is not relevant.

    Ids fall, so that what is seen grows row by row; a frame that shrinks is
    summed up anew for each row. A ``neg_score`` that is known stays, as in
    ``search.judged_positives``.
    """
    after = Window.partitionBy("qid").orderBy(F.desc("pid")).rowsBetween(Window.unboundedPreceding, -1)
    found = F.last(F.when(F.col("rel") == 0, F.col("score")), ignorenulls=True).over(after)
    return rows.withColumn("neg_score", F.coalesce("neg_score", found) if "neg_score" in rows.columns else found)


def pairwise_ce(rows: DataFrame) -> DataFrame:
    """Of (pos_score, neg_score): mean of ln(1 + exp(neg - pos)), for scores of any size."""
    x = F.col("neg_score") - F.col("pos_score")
    return rows.agg(_r(F.avg(F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))), "loss"))


def margin(rows: DataFrame) -> DataFrame:
    return rows.agg(_r(F.avg(F.greatest(F.col("neg_score") - F.col("pos_score"), F.lit(0.0))), "loss"))


def pair_mse(rows: DataFrame, target: str) -> DataFrame:
    return rows.agg(_r(F.avg(F.pow(F.col("pos_score") - F.col(target), 2)), "loss"))


def batch_accuracy(rows: DataFrame) -> DataFrame:
    return rows.agg(_r(F.avg((F.col("pos_score") > F.col("neg_score")).cast("int")), "accuracy"))


def _with_entropy(rows: DataFrame) -> DataFrame:
    """``rows`` with ``ce``, the cross entropy of each as a positive among its query's negatives; one row of these may stand for several, see ``search.judged_positives``."""
    w, several = Window.partitionBy("qid"), "rest" in rows.columns
    neg = F.when(F.col("rel") == 0, F.col("top" if several else "score"))
    known = rows.withColumns({"part": neg, "most": F.max(neg).over(w), "share": F.col("rest") if several else F.lit(1.0)})
    rest = F.sum(F.exp(F.col("part") - F.col("most")) * F.col("share")).over(w)
    known = known.withColumn("rest", rest).withColumn("top", F.col("most")).drop("part", "most", "share").filter("rel = 1")
    m = F.greatest("score", "top")
    total = F.exp(F.col("score") - m) + F.coalesce(F.col("rest") * F.exp(F.col("top") - m), F.lit(0.0))
    return known.withColumn("ce", m + F.ln(total) - F.col("score"))


def in_batch(rows: DataFrame) -> DataFrame:
    """Of (qid, score, rel): cross entropy of each positive among its query's negatives.

    Sums are taken below the largest score, so scores may have any size.
    """
    return _with_entropy(rows).agg(_r(F.avg("ce"), "loss"))


def online_contrastive(rows: DataFrame, limit: float = 0.5) -> DataFrame:
    """Of (score, rel): squared distances of hard positives and hard negatives."""
    d = rows.select((F.lit(1.0) - F.col("score")).alias("d"), "rel")
    pos, neg = F.when(F.col("rel") == 1, F.col("d")), F.when(F.col("rel") == 0, F.col("d"))
    bounds = d.agg(F.max(pos).alias("pmax"), F.avg(pos).alias("pavg"), F.count(pos).alias("pn"), F.min(neg).alias("nmin"), F.avg(neg).alias("navg"), F.count(neg).alias("nn"))
    both = d.crossJoin(F.broadcast(bounds))
    hard_neg = (F.col("rel") == 0) & (F.col("d") < F.when(F.col("pn") > 1, F.col("pmax")).otherwise(F.col("navg")))
    hard_pos = (F.col("rel") == 1) & (F.col("d") > F.when(F.col("nn") > 1, F.col("nmin")).otherwise(F.col("pavg")))
    near = F.pow(F.greatest(F.lit(limit) - F.col("d"), F.lit(0.0)), 2)
    total = F.sum(F.when(hard_pos, F.pow("d", 2)).when(hard_neg, near).otherwise(0.0))
    return both.agg(_r(total, "loss"))


def _among_negatives(rows: DataFrame) -> DataFrame:
    """The positives of (qid, score, rel), each a batch row with its query's negatives.

    ``top`` is the best negative, ``squares`` the sum of all squared, and n0,
    n1 and n2 are number, sum and sum of squares of those above the positive.
    """
    w, neg = Window.partitionBy("qid"), F.when(F.col("rel") == 0, F.col("score"))
    # Of equal scores the positive comes first: only what is truly above it counts.
    above = w.orderBy(F.desc("score"), F.desc("rel")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.lit(0.0)
    known = rows.withColumns(
        {
            "top": F.max(neg).over(w),
            "squares": F.coalesce(F.sum(neg * neg).over(w), zero),
            "n0": F.count(neg).over(above),
            "n1": F.coalesce(F.sum(neg).over(above), zero),
            "n2": F.coalesce(F.sum(neg * neg).over(above), zero),
        }
    )
    return known.filter("rel = 1")


def _hard(positives: DataFrame, scale: Column, pos_target: float, neg_target: float) -> DataFrame:
    """Squared distances to their targets of positives under the best negative, and of negatives above the positive."""
    p = F.when(F.col("score") < F.col("top"), F.pow(F.lit(pos_target) - F.col("score") / scale, 2)).otherwise(0.0)
    n = F.col("n2") / (scale * scale) - 2 * neg_target * F.col("n1") / scale + neg_target**2 * F.col("n0")
    return positives.agg(_r(F.coalesce(F.sum(p + n), F.lit(0.0)), "loss"))


def lexical_online(rows: DataFrame, length: Column | None = None, pos_target: float = 1.0, neg_target: float = 0.0) -> DataFrame:
    """Of (qid, score, rel): squared distances of hard scores, divided by the query's ``length`` first."""
    scaled = rows if length is None else rows.withColumn("score", F.col("score") / length)
    return _hard(_among_negatives(scaled), F.lit(1.0), pos_target, neg_target)


def lexical_dynamic(rows: DataFrame, limit: float = 0.5) -> DataFrame:
    """Of (qid, score, rel): hard scores against each other's bound, ``limit`` apart."""
    known, p = _among_negatives(rows), F.col("score")
    pos = F.when(p < F.col("top"), F.pow(F.col("top") + limit - p, 2)).otherwise(0.0)
    neg = F.col("n2") - 2 * (p - limit) * F.col("n1") + F.pow(p - limit, 2) * F.col("n0")
    return known.agg(_r(F.coalesce(F.sum(pos + neg), F.lit(0.0)), "loss"))


def query_normalized(rows: DataFrame, pos_target: float = 1.0, neg_target: float = 0.0) -> DataFrame:
    """``lexical_online`` after scaling each positive and its negatives to length one."""
    known = _among_negatives(rows)
    return _hard(known, F.greatest(F.sqrt(F.pow("score", 2) + F.col("squares")), F.lit(1e-12)), pos_target, neg_target)


def routed(scores: DataFrame, router_scores: DataFrame, weights: DataFrame, loads: DataFrame, batch: int, alpha: float, beta: float) -> DataFrame:
    """One row: contrastive, router, regular and balance, the four parts of the routed loss.

    ``scores`` and ``router_scores`` are (qid, score, rel); ``weights`` has the
    weight of each chosen expert, and ``loads`` of each side and expert how
    many tokens chose it (mask) and its summed softmax.
    """
    a = query_normalized(scores).withColumnRenamed("loss", "contrastive")
    b = query_normalized(router_scores).withColumnRenamed("loss", "router")
    return a.crossJoin(b).crossJoin(_routing(weights, loads, batch, alpha, beta))


def _routing(weights: DataFrame, loads: DataFrame, batch: int, alpha: float, beta: float) -> DataFrame:
    c = weights.agg(_r(F.coalesce(F.sum("weight"), F.lit(0.0)) * (beta / batch if beta > 0 else 0.0), "regular"))
    each = loads.groupBy("side", "expert_id").agg((F.sum("mask") * F.sum("softmax")).alias("load"))
    d = each.agg(_r(F.coalesce(F.sum("load"), F.lit(0.0)) * (alpha / batch if alpha > 0 else 0.0), "balance"))
    return c.crossJoin(d)


def routed_of_scores(scores: DataFrame, weights: DataFrame, loads: DataFrame, batch: int, alpha: float, beta: float) -> DataFrame:
    """``routed`` of pairs that have both scores, (qid, score, router, rel); they are dealt by query once, for both orders."""
    w, neg, part = Window.partitionBy("qid"), F.col("rel") == 0, F.lit(0.0)
    # A row is a positive or a negative of both scores, so both windows keep all rows until their own sums are there.
    for name in ("score", "router"):
        n, above = F.when(neg, F.col(name)), w.orderBy(F.desc(name), F.desc("rel")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        scores = scores.withColumns({f"{name}_top": F.max(n).over(w), f"{name}_squares": F.coalesce(F.sum(n * n).over(w), part), f"{name}_n2": F.coalesce(F.sum(n * n).over(above), part)})
    loss = lambda name: _normalized(F.col(name), F.col(f"{name}_top"), F.col(f"{name}_squares"), F.col(f"{name}_n2"))
    total = lambda name, to: _r(F.coalesce(F.sum(loss(name)), part), to)
    both = scores.filter("rel = 1").agg(total("score", "contrastive"), total("router", "router"))
    return both.crossJoin(_routing(weights, loads, batch, alpha, beta))


def _normalized(p: Column, top: Column, squares: Column, n2: Column) -> Column:
    """``query_normalized`` of one positive, with targets 1 and 0."""
    scale = F.greatest(F.sqrt(F.pow(p, 2) + squares), F.lit(1e-12))
    return F.when(p < top, F.pow(F.lit(1.0) - p / scale, 2)).otherwise(0.0) + n2 / (scale * scale)


def mask_distill(tokens: DataFrame, used: DataFrame, guide: Column | None = None) -> DataFrame:
    """sqrt of the summed (1 - weight)^2 of tokens that some query token chose.

    ``guide`` adds tokens that a tagger marks.
    """
    marked = tokens.join(used.select("pid", "pos").distinct().withColumn("used", F.lit(True)), ["pid", "pos"], "left")
    on = F.coalesce("used", F.lit(False)) if guide is None else F.coalesce("used", F.lit(False)) | guide
    return marked.filter(on).agg(_r(F.sqrt(F.coalesce(F.sum(F.pow(F.lit(1.0) - F.col("weight"), 2)), F.lit(0.0))), "loss"))


def tag_guide(tokens: DataFrame) -> DataFrame:
    return tokens.filter("label > 0").agg(_r(F.sum(F.lit(1.0) - F.col("weight")), "loss"))


def keyword_regularizer(tokens: DataFrame, normalized: bool, mask: Column | None = None) -> DataFrame:
    """Summed weights; normalized: of each document divided by its unmasked tokens first."""
    if not normalized:
        return tokens.agg(_r(F.sum("weight"), "loss"))
    n = F.count("*") if mask is None else F.greatest(F.sum(mask.cast("int")), F.lit(1))
    return tokens.groupBy("pid").agg((F.sum("weight") / n).alias("w")).agg(_r(F.sum("w"), "loss"))


def validation_mean(rows: DataFrame, score: str = "score") -> DataFrame:
    """One row: the mean score over the whole data set, the last short batch included."""
    return rows.agg(_r(F.avg(score), "mean"))


def token_ce(rows: DataFrame, ignore: int = -100) -> DataFrame:
    """Of (label, p): mean -ln p of the gold label, ignored labels left out."""
    return rows.filter(F.col("label") != ignore).agg(_r(F.avg(-F.ln("p")), "loss"))


def warm_up(coef: float, step: int, steps: int) -> float:
    return coef * min(1.0, step / steps) if steps else coef


def ramped(rows: DataFrame, coef: float, steps: int, step: str = "step", loss: str = "loss") -> DataFrame:
    """``rows`` with each step's loss times its warm-up, see ``warm_up``."""
    share = F.least(F.lit(1.0), F.col(step) / steps) if steps else F.lit(1.0)
    return rows.withColumn(loss, F.round(F.col(loss) * coef * share, 6))


def mixed(rows: DataFrame, in_batch_rows: DataFrame, target: str, decay: float) -> DataFrame:
    a, b = margin(rows).withColumnRenamed("loss", "a"), in_batch(in_batch_rows).withColumnRenamed("loss", "b")
    c = pair_mse(rows, target).withColumnRenamed("loss", "c")
    return a.crossJoin(b).crossJoin(c).select(_r(F.col("a") + F.col("b") + decay * F.col("c"), "loss"))


def mixed_of_scores(rows: DataFrame, target: float, decay: float) -> DataFrame:
    """``mixed`` of all scores (qid, pid, score, rel), or of ``search.judged_positives``, the pairs being those of ``next_negatives``; scores are read once."""
    known, pair = _with_entropy(next_negatives(rows)), F.col("neg_score").isNotNull()
    a = F.when(pair, F.greatest(F.col("neg_score") - F.col("score"), F.lit(0.0)))
    c = F.when(pair, F.pow(F.col("score") - F.lit(target), 2))
    parts = known.agg(_r(F.avg(a), "a"), _r(F.avg("ce"), "b"), _r(F.avg(c), "c"))
    return parts.select(_r(F.col("a") + F.col("b") + decay * F.col("c"), "loss"))


def perplexity(rows: DataFrame, loss: str = "loss") -> DataFrame:
    return rows.agg(_r(F.exp(F.avg(loss)), "perplexity"))

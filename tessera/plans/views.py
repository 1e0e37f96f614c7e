"""Logical tables of the engine, derived from the test tables, for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import as_double
from tessera.operators import corpus

#: Common table expressions that every SQL twin may use.
SQL = """
tv AS (SELECT vec_id // 10 AS pid, vec_id % 10 AS pos, label AS token_id, embedding::DOUBLE[] AS vec FROM embeddings),
q AS (SELECT pid AS qid, pos AS qpos, token_id, vec FROM tv WHERE pid % 20 = 0),
sims AS (SELECT qid, qpos, pid, pos, list_dot_product(q.vec, tv.vec) AS sim FROM q JOIN tv ON pid <> qid),
best AS (SELECT qid, qpos, pid, max(sim) AS best FROM sims GROUP BY ALL),
exact AS (SELECT qid, pid, round(sum(best), 6) AS score FROM best GROUP BY ALL),
qrels AS (SELECT a.pid AS qid, b.pid FROM tv a JOIN tv b ON a.token_id = b.token_id AND a.pos = 0 AND b.pos = 0 AND a.pid <> b.pid WHERE a.pid % 20 = 0),
top AS (SELECT qid, pid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM exact QUALIFY rank <= 50),
cents AS (SELECT (vec_id // 31)::INTEGER AS cid, embedding::DOUBLE[] AS vec FROM embeddings WHERE vec_id % 31 = 0),
assigned AS (SELECT pid, pos, tv.vec, cid, cents.vec AS centroid FROM tv, cents
             QUALIFY row_number() OVER (PARTITION BY pid, pos ORDER BY round(list_dot_product(tv.vec, cents.vec), 6) DESC, cid) = 1),
weights AS (SELECT pid, pos, token_id, vec, 1 / (1 + exp(-(vec[1] * 8))) AS weight, vec[2] > -0.2 AS valid FROM tv),
cscores AS (SELECT qid, qpos, cid, round(list_dot_product(q.vec, cents.vec), 6) AS sim FROM q, cents),
ivf AS (SELECT DISTINCT cid, pid FROM assigned),
cells AS (SELECT DISTINCT qid, cid FROM (SELECT * FROM cscores QUALIFY row_number() OVER (PARTITION BY qid, qpos ORDER BY sim DESC, cid) <= 2)),
probed AS (SELECT DISTINCT qid, pid FROM cells JOIN ivf USING (cid) WHERE pid <> qid)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.select(
        F.expr("vec_id div 10").alias("pid"), (F.col("vec_id") % 10).alias("pos"), F.col("label").alias("token_id"), as_double("embedding").alias("vec")
    )


def q_tok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: all tokens of every passage whose id divides by 20."""
    t = token_vecs(spark, sf_dir).filter("pid % 20 = 0")
    return t.select(F.col("pid").alias("qid"), F.col("pos").alias("qpos"), "token_id", "vec")


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").filter("vec_id % 31 = 0")
    return v.select(F.expr("cast(vec_id div 31 as int)").alias("cid"), as_double("embedding").alias("vec"))


def weighted_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with a keyword weight and a validity, both made of components."""
    t = token_vecs(spark, sf_dir)
    weight = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("vec")[0] * 8)))
    return t.withColumns({"weight": weight, "valid": F.col("vec")[1] > -0.2})


def vec_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose first token is of the query's first token's kind."""
    first = token_vecs(spark, sf_dir).filter("pos = 0").select("pid", "token_id")
    asked = first.filter("pid % 20 = 0").select(F.col("pid").alias("qid"), "token_id")
    return asked.join(first, "token_id").filter("pid <> qid").select("qid", "pid")


def text_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return corpus.containing(items, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pid"), "text"))

"""Readers with fixed schemas and writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import splits

PASSAGES = "pid BIGINT, text STRING"
QUERIES = "qid BIGINT, text STRING"
TRIPLES = "qid BIGINT, pos_pid BIGINT, neg_pid BIGINT"
QRELS = "qid BIGINT, unused STRING, pid BIGINT, grade STRING"


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated rows, quoted by double quotes that double inside; one file is read by many tasks."""
    return splits.read_quoted(spark, path, schema)


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """Of repeated ids the last row stays."""
    rows = splits.read_quoted(spark, path, PASSAGES, position=True)
    return rows.groupBy("pid").agg(F.max_by("text", "at").alias("text"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return read_passages(spark, path).withColumnRenamed("pid", "qid")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """All pairs, whatever their grade; repeats stay."""
    return read_tsv(spark, path, QRELS).select("qid", "pid")


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Raises on the first use of a row that has another number of columns than three."""
    lines = spark.read.text(path).filter(F.length("value") > 0)
    parts = F.split("value", "\t", -1)
    wrong = F.raise_error(F.concat(F.lit("three columns are expected: "), "value"))
    cells = F.when(F.size(parts) == 3, parts).otherwise(wrong.cast("array<string>"))
    rows = lines.select(cells.alias("c"))
    return rows.select(*[F.col("c")[i].cast("bigint").alias(n) for i, n in enumerate(("qid", "pos_pid", "neg_pid"))])


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """(pid, tags) from one JSON object keyed by id, however large."""
    found = splits.read_object_of_lists(spark, path)
    return found.select(F.col("key").cast("bigint").alias("pid"), F.col("values").alias("tags"))


def read_by_extension(spark: SparkSession, path: str) -> DataFrame:
    """The type is read off the name; .csv and .tsv begin with a header."""
    kind = path.rsplit(".", 1)[-1]
    if kind in ("csv", "tsv"):
        return spark.read.csv(path, sep="\t" if kind == "tsv" else ",", header=True, quote='"', escape='"')
    return spark.read.format({"jsonl": "json", "txt": "text"}.get(kind, kind)).load(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON array, or of an object a line."""
    return spark.read.json(path, multiLine=True)


def write_splits(splits: dict[str, DataFrame], path: str) -> None:
    for name, rows in splits.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split (train, val or test) of a processed data set."""
    return spark.read.parquet(f"{path}/{split}")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    if not path.endswith(".txt"):
        raise ValueError("a .txt file is expected")
    return spark.read.text(path).withColumnRenamed("value", "text")


def write_hits(hits: DataFrame, path: str) -> None:
    """One JSON object a query: its hits, best first."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col("pid").alias("corpus_id"), "score")))
    grouped = hits.groupBy("qid").agg(F.transform(ordered, lambda x: F.struct(x["corpus_id"].alias("corpus_id"), x["score"].alias("score"))).alias("hits"))
    grouped.write.mode("overwrite").json(path)


def append_metrics(row: DataFrame, path: str) -> None:
    """One more line of results; the header stands in a file of its own, written once."""
    lines = row.select(F.concat_ws(",", *[F.col(f"`{c}`").cast("string") for c in row.columns]).alias("value"))
    folder = row.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(row.sparkSession._jsc.sc().hadoopConfiguration())
    if not files.exists(folder):
        header = row.sparkSession.createDataFrame([(",".join(row.columns),)], "value string")
        header.coalesce(1).write.mode("append").text(path)
    lines.coalesce(1).write.mode("append").text(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The appended results: (line); the header comes first."""
    rows = spark.read.text(path).withColumnRenamed("value", "line")
    return rows.orderBy((~F.col("line").startswith("epoch,")).cast("int"), F.col("line"))


def to_json(rows: DataFrame) -> DataFrame:
    """(json): each row as a JSON object of two spaces' indent with its keys in order."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"pretty": "true"}).alias("json"))


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_metrics(rows: DataFrame, path: str) -> None:
    """One JSON object a score function and cut-off: its name, k and metrics."""
    rows.write.mode("overwrite").json(path)

"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.embedding_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.exact_dedup import duplicates

    return duplicates(_table(spark, sf_dir, "documents"), digest=True)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.bytebpe import decode, encode

    which = (_vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = _table(spark, sf_dir, "documents").select("doc_id", encode(F.col("text"), *which).alias("ids"))
    both = ids.withColumn("decoded", decode(F.col("ids"), *which))
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_count import count_tokens

    found = count_tokens(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), limit=2048)
    return found.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.chat import formatted_digests

    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], rows.schema)
    return formatted_digests(rows.unionByName(extra)).withColumnRenamed("conv", "conv_id")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.language import identify

    return identify(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import simhash_classes

    found = simhash_classes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack

    pieces = pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), capacity=4096, end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.html_extract import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality_rules import quality

    found = quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), limit=0.05, risk=0.05)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.whitening import whitened

    found = whitened(_table(spark, sf_dir, "embeddings"), k=8)
    # Beyond some three million vectors a deviation can exceed a long: null here, exact in the operator.
    return found.withColumn("deviation", F.col("deviation").try_cast("bigint"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.filter_audit import audit

    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}

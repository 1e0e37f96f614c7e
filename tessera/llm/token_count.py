"""Token counts of whole texts.

Counts equal ``len(Tokenizer.encode(text, add_special_tokens=False).ids)``
without truncation. See ``wordbpe`` for the method.

Scale. One narrow pass without a shuffle; a worker holds one batch and a
bounded word memory.

Defined cases. A null or blank text has no tokens. Strings of special tokens
inside a text count as the library's default has it. Very long texts and words
are counted whole. Other input columns stay as they are, but for those named
n_bytes, n_tokens or over_limit, whose place the results take. An empty table
gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tessera.llm.wordbpe import word_tokens


def token_counts(text: Column, path: str) -> Column:
    """BIGINT number of tokens of ``text`` under the tokenizers file ``path``."""

    @arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(word_tokens(path).counts(texts))

    return of(text)


def count_tokens(docs: DataFrame, path: str, limit: int, text_col: str = "text") -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("n_bytes", F.octet_length(text).cast("bigint")).withColumn("n_tokens", token_counts(text, path)).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )

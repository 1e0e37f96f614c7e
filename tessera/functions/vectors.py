"""Vector, bit and quantisation expressions, all inside the JVM.

Arithmetic is in double precision, whatever the stored type.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12
Name = str | Column


def _c(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(v: Name) -> Column:
    return _c(v).cast("array<double>")


def dot(a: Name, b: Name) -> Column:
    """Sum of products, in order of the components."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Name) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Name) -> Column:
    """``v`` divided by its length; a zero vector stays zero."""
    return F.transform(_c(v), lambda x: x / F.greatest(norm(v), F.lit(EPS)))


def weighted(v: Name, w: Name) -> Column:
    return F.transform(_c(v), lambda x: x * _c(w))


def minus(a: Name, b: Name) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def masked(v: Name, mask: Column) -> Column:
    """``v`` where the mask holds, else a zero vector of its length."""
    return F.when(mask, _c(v)).otherwise(F.transform(_c(v), lambda x: x * 0))


def as_single(v: Name) -> Column:
    """Components in single precision, the narrowest that Spark stores."""
    return _c(v).cast("array<float>")


def top_experts(logits: Name, k: int) -> Column:
    """ARRAY<STRUCT<weight, expert_id>>: the ``k`` largest log(1 + relu(x)), ties by the smaller id."""
    rows = F.transform(_c(logits), lambda x, i: F.struct((-router(x)).alias("w"), i.alias("expert_id")))
    return F.transform(F.slice(F.array_sort(rows), 1, k), lambda r: F.struct((-r["w"]).alias("weight"), r["expert_id"].alias("expert_id")))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def router(logit: Column) -> Column:
    """log(1 + max(x, 0))."""
    return F.log1p(F.greatest(logit, F.lit(0.0)))


def keyword_weight(w: Column, threshold: float, apply: bool) -> Column:
    """Below the threshold 0; else the weight itself, or 1 when it is not applied."""
    return F.when(w < threshold, F.lit(0.0)).otherwise(w if apply else F.lit(1.0))


def bucketize(x: Column, cutoffs: Column) -> Column:
    """How many cutoffs are strictly less than ``x``."""
    return F.size(F.filter(cutoffs, lambda c: c < x))


def bits_of(bucket: Column, nbits: int) -> Column:
    """The bits of a bucket number, lowest first."""
    return F.array(*[F.shiftright(bucket, i).bitwiseAND(F.lit(1)) for i in range(nbits)])


def pack_bits(bits: Column) -> Column:
    """Bytes from bits, eight at a time, first bit highest."""
    starts = F.sequence(F.lit(1), F.size(bits), F.lit(8))
    return F.transform(starts, lambda i: F.aggregate(F.slice(bits, i, 8), F.lit(0), lambda a, b: a * 2 + b))


def unpack_buckets(packed: Column, nbits: int) -> Column:
    """Bucket numbers back from packed bytes."""
    per = 8 // nbits
    one = lambda byte, i: reduce(
        lambda a, b: a + b, [F.shiftright(byte, 7 - (i * nbits + j)).bitwiseAND(F.lit(1)) * (1 << j) for j in range(nbits)]
    )
    return F.flatten(F.transform(packed, lambda byte: F.array(*[one(byte, i) for i in range(per)])))


def partitions(n_docs: int, mean_length: float, coef: float) -> int:
    """Number of centroids: a power of two near coef * sqrt(tokens)."""
    return 2 ** math.floor(math.log2(max(1.0, coef * math.sqrt(n_docs * mean_length))))


def sample_size(n_tokens: int, n_docs: int) -> int:
    """Passages that a codec is trained on."""
    return min(1 + int(16 * math.sqrt(n_tokens)), n_docs)

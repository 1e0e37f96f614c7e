"""Whitening of embeddings from one aggregation of centred products.

Each entry becomes a whole number, ``floor(1024 c) + 100000``, so counts and
sums are exact. A first aggregation takes the number of vectors and the sum of
every dimension. A second one gives the sum of the products of both entries
less their means for each pair of dimensions: a vector is dealt out by
dimension, and a generated SQL expression for each distance from one dimension
to another, counted around, sums its products. LAPACK decomposes the assembled
matrix, and a narrow pass projects every vector.

Scale. A vector is read four times (lengths, sums, products, projection) and
never shuffled. What a task sends on is one row of sums, and of products one
row a dimension; the former meet in ``SPREAD`` groups before the last task adds
them up. The driver holds a matrix whose size depends on the dimension alone.
Plans have half as many expressions as a vector has dimensions, and at most
``PAIRS``, since driver and executors compile them: one for each pair, 2,080 for
64 dimensions, took more of the driver's memory than the data, and too long.

Defined cases. A vector that is null or has a null or non-finite entry is left
out, and so is one whose length is not the most frequent (of equally frequent
ones the greatest): what it lacks counts as null. Entries beyond 2**43 count as
2**43. A component without variance, as in a table of one vector or of fewer
different vectors than dimensions, has ``whitened`` null and is left out of
``identity_error``, which is null when no component varies. An exact deviation
of more than 38 digits is null. Null and repeated ids are rows like others. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.runtime import stored

#: Expressions in one aggregation, and groups that partial sums meet in.
PAIRS, SPREAD = 128, 64
LARGEST = float(1 << 43)


def whole(entry: Column) -> Column:
    """``floor(1024 c) + 100000`` as a long."""
    held = F.greatest(F.least(entry.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))
    return F.floor(held * 1024).cast("bigint") + 100_000


def usable(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, x) of the vectors that count, x their whole numbers, and the dimension."""
    finite = F.forall(vec_col, lambda c: F.abs(c.cast("double")) < F.lit(float("inf")))
    known = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).filter(finite & (F.size("vec") > 0))
    usual = known.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = usual.d if usual else 0
    return known.filter(F.size("vec") == d).select("id", F.transform("vec", whole).alias("x")), d


def summed(columns: DataFrame, expressions: dict[str, str]) -> dict:
    """One row of sums, added up in two steps; ``expressions`` are SQL by name."""
    out = {}
    names = list(expressions)
    for at in range(0, len(names), PAIRS):
        some = names[at : at + PAIRS]
        dealt = columns.groupBy(F.pmod(F.spark_partition_id(), F.lit(SPREAD)).alias("__task"))
        parts = dealt.agg(*[F.expr(f"sum({expressions[n]}) AS {n}") for n in some])
        out |= parts.agg(*[F.expr(f"sum({n}) AS {n}") for n in some]).first().asDict()
    return out


def products(centred: DataFrame, d: int) -> np.ndarray:
    """Sums of c[i] c[j] over all vectors ``c`` of ``d`` entries, as a matrix."""
    each, out = centred.select("c", F.posexplode("c").alias("i", "a")), np.zeros((d, d))
    steps = range(d // 2 + 1)  # around the dimensions, so that i, i + step is every pair
    for at in range(0, len(steps), PAIRS):
        some = steps[at : at + PAIRS]
        sums = [F.expr(f"sum(a * c[pmod(i + {k}, {d})]) AS s{k}") for k in some]
        for row in each.groupBy("i").agg(*sums).collect():  # one row a dimension
            for k in some:
                j = (row.i + k) % d
                out[row.i, j] = out[j, row.i] = row[f"s{k}"]
    return out


@dataclass(frozen=True)
class Whitening:
    """What all vectors say: their number, sums, and components by falling variance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    reach: int

    @classmethod
    def fit(cls, x: DataFrame, d: int) -> Whitening:
        """``x`` has the whole numbers of each vector, ``d`` of them."""
        each = x.select(*[F.col("x")[i].cast("decimal(20,0)").alias(f"x{i}") for i in range(d)], F.lit(1).cast("bigint").alias("one"))
        found = summed(each, {"n": "one"} | {f"s{i}": f"x{i}" for i in range(d)})
        n, sums = found["n"], tuple(int(found[f"s{i}"]) for i in range(d))
        reach = x.agg(F.max(F.array_max(F.transform("x", F.abs)))).first()[0]
        means = F.array(*[F.lit(s / n) for s in sums])
        cov = products(x.select(F.zip_with("x", means, lambda e, m: e - m).alias("c")), d) / n
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(-values, kind="stable")
        return cls(n, sums, values[order], vectors[:, order], float(np.trace(cov)), reach)

    def varying(self, k: int) -> int:
        """How many of the first ``k`` components have variance beyond rounding."""
        least = len(self.values) * np.finfo(float).eps * max(float(self.values[0]), 0.0)
        return int((self.values[:k] > least).sum())

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """n x - S of every entry, and the exact sum of squares of each row."""
        n, sums = self.n, np.array(self.sums, object)
        far = 2 * n * self.reach
        y = n * x - sums.astype(np.int64) if far < 1 << 62 else n * x.astype(object) - sums
        if len(sums) * far * far >= 1 << 63:
            y = y.astype(object)
        squares = (y * y).sum(axis=1).tolist()
        return y.astype(np.float64), [Decimal(s) if s < 10**38 else None for s in squares]


def whitened(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 8) -> DataFrame:
    """One row per usable vector and component: id, component, n, deviation decimal(38,0), whitened, explained, identity_error."""
    x, d = usable(rows, id_col, vec_col)
    kind = rows.schema[id_col].dataType.simpleString()
    if not d:
        none = rows.sparkSession.createDataFrame([], f"id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")
        return none.withColumnRenamed("id", id_col)
    fit = Whitening.fit(x, d)
    k, live = min(k, d), fit.varying(min(k, d))
    matrix = fit.vectors[:, :live] / np.sqrt(fit.values[:live])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            y, squares = fit.deviations(part.column("x").flatten().to_numpy().reshape(-1, d))
            w = pa.array(((y / fit.n) @ matrix).ravel())
            lists = pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * live, w)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(squares, pa.decimal128(38, 0)), lists], names=["id", "deviation", "w"])

    done = stored(x.mapInArrow(project, f"id {kind}, deviation decimal(38,0), w array<double>"))
    error = _identity_error(done, live)
    explained = F.array(*[F.lit(float(max(v, 0.0) / fit.trace) if fit.trace > 0 else 0.0) for v in fit.values[:k]])
    each = done.select("id", "deviation", "w", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("component"))
    return each.select(
        F.col("id").alias(id_col),
        "component",
        F.lit(fit.n).cast("bigint").alias("n"),
        "deviation",
        F.get("w", F.col("component") - 1).alias("whitened"),
        F.element_at(explained, F.col("component")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def _identity_error(done: DataFrame, live: int) -> float | None:
    """The largest entry of the covariance of what came out, less the identity; measured over all rows."""
    if not live:
        return None
    pairs = [(i, j) for i in range(live) for j in range(i, live)]
    found = done.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, found, strict=True))

"""Near-duplicate vectors by an inverted multi-index.

Vectors of the same label link when their cosine reaches a threshold. Each
half of a vector has a codebook of its own, so K centroids a half make a grid
of K x K cells. A vector is entered in its nearest cell and looks up cells in
order of distance: a multi-sequence traversal over the two sorted lists of
half distances. It stops when a cell is farther than the nearest one by more
than a margin. Candidates of visited cells are verified by cosine in double
precision.

Fit. The centroids of a half grow with the square root of the vectors, up to
``MOST_CENTROIDS``, so cells stay small. Codebooks and margin come from 16
vectors a centroid in hash order, at least ``SAMPLE`` and at most ``MOST_SAMPLE``.
The margin is calibrated for the hardest case: each sampled vector gets
a partner exactly at the threshold in a random direction, and the margin is
the smallest with which the target share of such pairs is found from either
side. Closer pairs are found more often. All vectors are indexed.

Scale. Identical vectors are collapsed first and numbered. A cell is cut into
blocks of entries and of probes, each pair of blocks a group of its own; what leaves a pair of blocks is a count per vector and
a spanning forest of the links, so no pairs are emitted and a group of copies
costs memory in proportion to a block. A link that both sides find is counted
by each for itself; one that a single side finds is counted for both. Rows look
up only vectors that have links or copies, by a join that spreads hot ones.
Beyond some 4e9 different vectors cells grow with the data; blocks still bound
a task's memory, but the products within a cell then grow with its square.

Defined cases. A vector links with nothing when it, its id or its label is
null, or it is empty, zero or holds a null or non-finite component; it is its
own component. Only vectors of equal length compare. Rows that repeat a
vector, with the same id too, count as other vectors, and so do different
vectors of one id. An empty table gives an empty result. Other input columns
are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import classes
from tessera.llm.runtime import checkpointed, joinable, looked_up
from tessera.llm.simhash import forest

#: Vectors that the codebooks are fitted on, at least and at most, where there are so many.
SAMPLE, MOST_SAMPLE = 8192, 65536
#: Vectors meant for a cell of the whole grid, and most centroids of a half.
PER_CELL, MOST_CENTROIDS = 256, 4096
#: Most entries, and most probes, that meet in one task's block, on average.
BLOCK = 1024


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] - 2.0 * (x @ centroids.T) + (centroids * centroids).sum(1)[None, :]
    return np.maximum(d, 0.0)


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centroids = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _squared(x, centroids).argmin(axis=1)
        for i in range(len(centroids)):
            own = x[near == i]
            if len(own):
                centroids[i] = own.mean(axis=0)
    return centroids


@dataclass(frozen=True)
class MultiIndex:
    """Two codebooks and the margin at which the traversal stops."""

    first: np.ndarray
    second: np.ndarray
    margin: float

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of unit rows to the centroids of either half."""
        width = self.half + self.second.shape[1]
        if x.shape[1] < width:
            x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
        return _squared(x[:, : self.half], self.first), _squared(x[:, self.half : width], self.second)

    def traverse(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Cells in order of a[i] + b[j] up to the margin beyond the nearest."""
        order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        sorted_a, sorted_b = a[order_a].tolist(), b[order_b].tolist()
        limit = sorted_a[0] + sorted_b[0] + self.margin
        heap, out, many = [(sorted_a[0] + sorted_b[0], 0, 0)], [], len(b)
        while heap:
            distance, i, j = heapq.heappop(heap)
            if distance > limit:
                break
            out.append(int(order_a[i]) * many + int(order_b[j]))
            if j + 1 < many:
                heapq.heappush(heap, (sorted_a[i] + sorted_b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(sorted_a):
                heapq.heappush(heap, (sorted_a[i + 1] + sorted_b[0], i + 1, 0))
        return out


def fit(sample: np.ndarray, k: int, threshold: float, recall: float, seed: int = 7) -> MultiIndex:
    """Codebooks of ``k`` centroids a half and the margin for ``recall``."""
    rng = np.random.default_rng(seed)
    width = sample.shape[1]
    half = max(1, width // 2)
    index = MultiIndex(_codebook(sample[:, :half], k, rng), _codebook(sample[:, half:], k, rng), 0.0)
    noise = rng.standard_normal(sample.shape)
    noise -= (noise * sample).sum(1, keepdims=True) * sample
    norm = np.sqrt((noise * noise).sum(1, keepdims=True))
    partner = threshold * sample + math.sqrt(max(0.0, 1 - threshold**2)) * noise / np.maximum(norm, 1e-12)

    def needed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        (a, b), (c, d) = index.distances(x), index.distances(y)
        rows = np.arange(len(x))
        return a[rows, c.argmin(1)] + b[rows, d.argmin(1)] - a.min(1) - b.min(1)

    either = np.minimum(needed(sample, partner), needed(partner, sample))
    return MultiIndex(index.first, index.second, round(float(np.quantile(either, recall)) + 1e-6, 9))


def _block(table: pa.Table, index: MultiIndex, threshold: float, kind: str) -> pa.Table:
    """Counts and a forest of the links between the probes and entries of a block."""
    entry = table["entry"].to_numpy(zero_copy_only=False)
    ids, copies = table["node"].to_numpy(), table["copies"].to_numpy()
    x = unit(np.stack([np.frombuffer(v, kind) for v in table["vector"].to_pylist()]))
    e, p = np.flatnonzero(entry), np.flatnonzero(~entry)
    count = np.zeros(len(ids), np.int64)
    nodes, roots = [], []
    if len(e) and len(p):
        a, b = index.distances(x)
        home_a, home_b, nearest = a.argmin(1), b.argmin(1), a.min(1) + b.min(1)
        for at in range(0, len(p), 256):
            q = p[at : at + 256]
            linked = (x[q] @ x[e].T >= threshold) & (ids[q][:, None] != ids[e][None, :])
            if not linked.any():
                continue
            # Does the entry visit the probe's own cell? Then it counts for itself there.
            back = a[np.ix_(e, home_a[q])].T + b[np.ix_(e, home_b[q])].T
            back = back - nearest[e][None, :] <= index.margin
            count[q] += linked @ copies[e]
            count[e] += (linked & ~back).T @ copies[q]
            node, root = forest(linked, ids[q], ids[e])
            nodes.append(node)
            roots.append(root)
    some = count > 0
    node, root = np.concatenate([ids[some], *nodes]), np.concatenate([ids[some], *roots])
    n = np.concatenate([count[some], *[np.zeros(len(x), np.int64) for x in nodes]])
    return pa.table({"node": node, "n": n, "root": root})


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.93,
    recall: float = 0.98,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per row: id, n_links, component_id, kept."""
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    item = "array<float>" if kind == "<f4" else "array<double>"
    vector = F.col("vector")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(item).alias("vector"), F.col(label_col).alias("label"))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & _usable(vector)
    rows = rows.withColumns({"good": good, "k1": F.xxhash64(vector), "k2": F.xxhash64(F.lit(1), vector)})
    keys = ["label", "k1", "k2"]
    some = rows.filter("good").groupBy(keys).agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.any_value("vector").alias("vector"))
    distinct = checkpointed(some.withColumn("node", F.monotonically_increasing_id()))
    total, width = distinct.agg(F.count("*"), F.max(F.size("vector"))).first()
    same = rows.select("id", F.when(F.col("good"), F.struct(*keys)).alias("key"))
    none = F.lit(0).cast("bigint")
    if not total:
        return same.select(F.col("id").alias(id_col), none.alias("n_links"), F.col("id").cast("bigint").alias("component_id"), F.lit(True).alias("kept"))

    k = max(2, min(MOST_CENTROIDS, math.ceil(math.sqrt(total / PER_CELL))))
    most = max(SAMPLE, min(MOST_SAMPLE, 16 * k))
    picked = distinct.select("vector", F.xxhash64("k1", F.lit(5)).alias("at")).orderBy("at").limit(most).select("vector").toArrow()["vector"]
    sample = unit(np.stack([np.pad(np.array(v, np.float64), (0, width - len(v))) for v in picked.to_pylist()]))
    index = fit(sample, k, threshold, recall)
    many = len(index.second)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            raw = [np.array(v, kind) for v in part.column("vector").to_pylist()]
            size = max(map(len, raw))
            a, b = index.distances(unit(np.stack([np.pad(v, (0, size - len(v))) for v in raw])))
            home = (a.argmin(1) * many + b.argmin(1)).astype(np.int32)
            cells = [index.traverse(x, y) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("node"),
                    part.column("copies"),
                    part.column("label"),
                    pa.array([v.tobytes() for v in raw], pa.binary()),
                    pa.array(home),
                    pa.array(cells, pa.list_(pa.int32())),
                ],
                names=["node", "copies", "label", "vector", "home", "cells"],
            )

    kinds = dict(distinct.dtypes)
    schema = f"node bigint, copies bigint, label {kinds['label']}, vector binary, home int, cells array<int>"
    placed = checkpointed(distinct.select("node", "copies", "label", "vector").mapInArrow(visit, schema))
    base = ["node", "copies", "label", "vector", F.octet_length("vector").alias("width")]
    entries = placed.select(*base, F.col("home").alias("cell"))
    probes = placed.select(*base, F.explode("cells").alias("cell"))
    where = ["label", "width", "cell"]
    sizes = entries.groupBy(where).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("e"))
    sizes = joinable(sizes.join(probes.groupBy(where).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("p")), where))
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["node", "copies", "vector", *where]
    left = entries.join(sizes, where).select(*columns, deal("e").alias("be"), each("p").alias("bp"), F.lit(True).alias("entry"))
    right = probes.join(sizes, where).select(*columns, each("e").alias("be"), deal("p").alias("bp"), F.lit(False).alias("entry"))
    block = lambda table: _block(table, index, threshold, kind)
    # Dealt by block as well, or all blocks of a cell would stay in one task.
    met = left.unionByName(right).repartition(*where, "be", "bp").groupBy(*where, "be", "bp")
    found = checkpointed(met.applyInArrow(block, "node bigint, n bigint, root bigint"))

    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = classes(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = distinct.select(*keys, "node", "least", "copies").join(counts, "node", "left").join(roots, "node", "left")
    known = known.filter("copies > 1 or n is not null or root is not null").withColumn("root", F.coalesce("root", "node"))
    together = known.groupBy("root").agg(F.min("least").alias("component"))
    told = known.join(together, "root").select(
        F.struct(*keys).alias("key"), "copies", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component"
    )
    root = F.coalesce("component", "id")
    return looked_up(same, told, "key", "copies").select(
        F.col("id").alias(id_col), F.coalesce("n_links", none).alias("n_links"), root.cast("bigint").alias("component_id"), root.eqNullSafe(F.col("id")).alias("kept")
    )

"""Centroids, residual codes and the cascade that searches them.

A document's codes are one row: the centroid of each token (``cids``) and all
its residuals in one binary, ``dim * nbits / 8`` bytes a token, rounded up. A byte holds the
bucket numbers of ``8 / nbits`` components, the bits of each lowest first and
the byte filled from its highest bit; it is read back through a table of 256
rows. A cell's postings are rows (cid, pid).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import l2_normalize, minus
from tessera.operators import batches
from tessera.operators.search import QUERY_BYTES, TILE_BYTES, _above, _bytes, _dots, _matrix, _ragged, askers, best_rows, blocks, packed, product, rerank_packed, small, spans, top_k, wanted
from tessera.operators.store import stored

#: Score of a query token for a document without any passing centroid.
SENTINEL = -9999.0
#: Documents in a block of a cell's postings.
CELL = 1 << 16


def assign(tokens: DataFrame, centroids: DataFrame) -> DataFrame:
    """Tokens with the centroid of largest inner product; ties: the smallest cid.

    One narrow pass: each batch of tokens meets the centroids, whose number is
    about the root of the tokens'. Where their bytes pass the bound of
    ``search.product`` a token gets the best of each block, and the best of these.
    """

    def meet(table: pa.Table, rows: pa.Table) -> pa.Table:
        cid = table["cid"].to_numpy()
        order = np.argsort(cid, kind="stable")
        cid, matrix, vecs = cid[order], _matrix(table["vec"])[order], _matrix(rows["vec"])
        near, sims = [], []
        height = max(1, TILE_BYTES // 8 // len(cid))
        for at in range(0, len(vecs), height):
            found = np.round(vecs[at : at + height] @ matrix.T, 6)
            near.append(found.argmax(axis=1))
            sims.append(found.max(axis=1))
        near, sims = np.concatenate(near), np.concatenate(sims)
        flat, width = matrix[near].ravel(), matrix.shape[1]
        centroid = pa.ListArray.from_arrays(np.arange(len(near) + 1, dtype=np.int32) * width, pa.array(flat))
        return pa.table({"pid": rows["pid"], "pos": rows["pos"], "vec": rows["vec"], "cid": cid[near].astype(np.int32), "centroid": centroid, "sim": sims})

    schema = "pid bigint, pos bigint, vec array<double>, cid int, centroid array<double>, sim double"
    table = centroids.select(F.col("cid").cast("int").alias("cid"), "vec")
    found = product(table, tokens.select("pid", "pos", "vec"), meet, schema)
    if _bytes(table) > QUERY_BYTES:
        best = F.max_by(F.struct("vec", "cid", "centroid"), F.struct("sim", -F.col("cid")))
        found = found.groupBy("pid", "pos").agg(best.alias("b")).select("pid", "pos", "b.*")
    return found.select("pid", "pos", "vec", "cid", "centroid")


def residuals(assigned: DataFrame) -> DataFrame:
    return assigned.withColumn("residual", minus("vec", "centroid"))


def quantiles(values: DataFrame, at: list[float]) -> list[float | None]:
    """Exact interpolated quantiles of the column ``x``.

    Different values are counted first and numbered in ranges of about equal
    size, so no task sorts or holds all of them.
    """
    values = values.filter("x IS NOT NULL")
    counts = stored(values.groupBy("x").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return [None] * len(at)
    placed = batches.running(counts, "x", F.col("n"))
    places = {q: (total - 1) * q for q in at}
    needed = sorted({int(p) for p in places.values()} | {min(total - 1, int(p) + 1) for p in places.values()})
    holds = lambda i: (F.col("at") <= i) & (F.col("at") + F.col("n") > i)
    some = reduce(or_, map(holds, needed)) if len(needed) <= 64 else F.exists(F.array(*[F.lit(i) for i in needed]), holds)
    found = placed.filter(some).select("x", "at", "n").collect()  # two rows a quantile at most
    value = {i: r.x for i in needed for r in found if r["at"] <= i < r["at"] + r.n}
    return [value[int(p)] + (value[min(total - 1, int(p) + 1)] - value[int(p)]) * (p - int(p)) for p in places.values()]


def codec(residual: DataFrame, nbits: int) -> DataFrame:
    """One row: bucket cutoffs, bucket weights and the mean absolute residual.

    Quantiles are exact and interpolated, over all components.
    """
    n = 1 << nbits
    flat = residual.select(F.explode("residual").alias("x"))
    cuts, weights = [i / n for i in range(1, n)], [(i + 0.5) / n for i in range(n)]
    found = quantiles(flat, cuts + weights)
    mean = flat.agg(F.avg(F.abs("x"))).first()[0]
    return residual.sparkSession.createDataFrame([(found[: len(cuts)], found[len(cuts) :], mean)], "cutoffs array<double>, weights array<double>, mean_residual double")


def pack(buckets: np.ndarray, nbits: int) -> np.ndarray:
    """Bytes of rows of bucket numbers."""
    bits = (buckets[:, :, None] >> np.arange(nbits)) & 1
    return np.packbits(bits.reshape(len(buckets), -1).astype(np.uint8), axis=1)


def digits(nbits: int) -> np.ndarray:
    """The bucket numbers that each of the 256 bytes holds."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).reshape(256, 8 // nbits, nbits)
    return (bits << np.arange(nbits)).sum(axis=2)


def _of(codec: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Cutoffs, weights and bits of a codec."""
    row = codec.first()
    return np.array(row.cutoffs), np.array(row.weights), len(row.weights).bit_length() - 1


def compress(residual: DataFrame, codec: DataFrame) -> DataFrame:
    """(pid, pos, cid, packed): the bucket of each component, as bytes."""
    cutoffs, _, nbits = _of(codec)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = _matrix(pa.chunked_array([part.column("residual")]))
            found = pack(np.searchsorted(cutoffs, rows, side="left"), nbits)
            yield pa.RecordBatch.from_pydict({**{c: part.column(c) for c in ("pid", "pos", "cid")}, "packed": pa.array([r.tobytes() for r in found], pa.binary())})

    return residual.select("pid", "pos", "cid", "residual").mapInArrow(run, "pid bigint, pos bigint, cid int, packed binary")


def by_document(compressed: DataFrame) -> DataFrame:
    """(pid, cids, packed): a row per document, tokens in order of position."""
    entry = F.array_sort(F.collect_list(F.struct("pos", "cid", "packed")))
    rows = compressed.groupBy("pid").agg(entry.alias("e")).select("pid", F.col("e.cid").alias("cids"), F.col("e.packed").alias("parts"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists = part.column("parts")
            whole = pa.array([b"".join(x.as_py()) for x in lists], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("pid"), part.column("cids"), whole], names=["pid", "cids", "packed"])

    return rows.mapInArrow(run, "pid bigint, cids array<int>, packed binary")


def unpacked(blob: bytes | memoryview, tokens: int, table: np.ndarray) -> np.ndarray:
    """Rows of what ``table`` says of each component."""
    return table[np.frombuffer(blob, np.uint8)].reshape(tokens, -1)


def decompress(codes: DataFrame, centroids: DataFrame, codec: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """(pid, vecs, and the columns ``more``) of documents (pid, cids, packed): centroid plus bucket weights, of length one.

    One narrow pass in which bytes are looked up in a table of weights. Where
    the centroids pass the bound of ``search.product`` tokens meet them by a
    join on the cell, and documents are packed again.
    """
    _, weights, nbits = _of(codec)
    table = weights[digits(nbits)]
    kept = [f for f in codes.schema.fields if f.name in more]
    schema = "pid bigint, vecs array<array<double>>" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in kept)
    if _bytes(centroids) > QUERY_BYTES:
        return _decompress_joined(codes, centroids, table, kept)
    held = centroids.select("cid", "vec").toArrow().sort_by("cid")
    cid, matrix = held["cid"].to_numpy(), _matrix(held["vec"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists, lengths = part.column("cids"), np.diff(part.column("cids").offsets.to_numpy())
            raw = matrix[np.searchsorted(cid, lists.flatten().to_numpy(zero_copy_only=False))]
            if len(raw):
                raw = raw + unpacked(b"".join(x.as_py() for x in part.column("packed")), len(raw), table)[:, : raw.shape[1]]
                raw /= np.maximum(np.sqrt((raw * raw).sum(axis=1, keepdims=True)), 1e-12)
            flat = pa.ListArray.from_arrays(np.arange(len(raw) + 1, dtype=np.int32) * matrix.shape[1], raw.ravel())
            vecs = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32), flat)
            yield pa.RecordBatch.from_arrays([part.column("pid"), vecs, *[part.column(f.name) for f in kept]], names=["pid", "vecs", *[f.name for f in kept]])

    return codes.select("pid", "cids", "packed", *[f.name for f in kept]).mapInArrow(run, schema)


def _decompress_joined(codes: DataFrame, centroids: DataFrame, table: np.ndarray, kept: list) -> DataFrame:
    lookup = F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in table])
    width = F.expr("octet_length(packed) div size(cids)")
    tokens = codes.withColumn("w", width).select("pid", "packed", "w", F.posexplode("cids").alias("pos", "cid"))
    tokens = tokens.withColumn("part", F.substring(F.col("packed"), F.col("pos") * F.col("w") + 1, F.col("w")))
    byte = lambda i: F.conv(F.hex(F.substring(F.col("part"), i, F.lit(1))), 16, 10).cast("int")
    weight = F.flatten(F.transform(F.sequence(F.lit(1), F.col("w").cast("int")), lambda i: F.element_at(lookup, byte(i) + 1)))
    met = tokens.join(centroids.select("cid", F.col("vec").alias("centroid")), "cid")
    raw = met.select("pid", "pos", F.zip_with("centroid", F.slice(weight, F.lit(1), F.size("centroid")), lambda a, b: a + b).alias("raw"))
    entry = F.array_sort(F.collect_list(F.struct("pos", l2_normalize("raw").alias("vec"))))
    docs = raw.groupBy("pid").agg(entry.alias("e")).select("pid", F.col("e.vec").alias("vecs"))
    return docs.join(codes.select("pid", *[f.name for f in kept]), "pid") if kept else docs


def as_tokens(docs: DataFrame) -> DataFrame:
    """(pid, pos, vec) of packed documents."""
    return docs.select("pid", F.posexplode("vecs").alias("pos", "vec")).select("pid", F.col("pos").cast("bigint").alias("pos"), "vec")


def inverted(codes: DataFrame) -> DataFrame:
    """Different (cid, pid) pairs."""
    return codes.select("cid", "pid").distinct()


def cells(ivf: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slot, pids) and (cid, cut): the documents of each cell together, a large cell in several blocks."""
    rows, cuts = blocks(ivf.select(F.col("cid").cast("bigint").alias("cid"), "pid"), "cid", CELL, ["pid"], F.col("pid"))
    return rows.select("slot", F.col("entries").alias("pids")), cuts


def cell_sizes(codes: DataFrame, centroids: DataFrame) -> DataFrame:
    """Tokens of every centroid, also of empty ones."""
    counts = codes.groupBy("cid").agg(F.count("*").alias("n"))
    return centroids.select("cid").join(counts, "cid", "left").select("cid", F.coalesce("n", F.lit(0)).alias("n"))


def centroid_scores(queries: DataFrame, centroids: DataFrame) -> DataFrame:
    """(qid, qpos, cid, sim) of all query tokens and centroids."""

    def meet(asked: pa.Table, table: pa.Table) -> pa.Table:
        sims = np.round(_matrix(asked["vec"]) @ _matrix(table["vec"]).T, 6)
        n, m = sims.shape
        each = lambda c: np.repeat(asked[c].to_numpy(), m)
        return pa.table({"qid": each("qid"), "qpos": each("qpos"), "cid": np.tile(table["cid"].to_numpy().astype(np.int32), n), "sim": sims.ravel()})

    asked = queries.select("qid", "qpos", "vec")
    return product(asked, centroids.select(F.col("cid").cast("int").alias("cid"), "vec"), meet, "qid bigint, qpos bigint, cid int, sim double")


def probe(scores: DataFrame, ivf: DataFrame, ncells: int) -> DataFrame:
    """(qid, pid): documents in the best cells of some query token."""
    cells = top_k(scores, ncells, ["qid", "qpos"], F.desc("sim"), F.asc("cid")).select("qid", "cid").distinct()
    return cells.join(ivf, "cid").filter(F.col("pid") != F.col("qid")).select("qid", "pid").distinct()


def approximate(pairs: DataFrame, scores: DataFrame, ivf: DataFrame, threshold: float | None = None, decimals: int = 6) -> DataFrame:
    """(qid, pid, score) from centroids alone; below the threshold they do not count."""
    use = scores
    if threshold is not None:
        passing = scores.groupBy("qid", "cid").agg(F.max("sim").alias("most")).filter(F.col("most") >= threshold)
        use = scores.join(passing.select("qid", "cid"), ["qid", "cid"], "left_semi")
    grid = pairs.join(scores.select("qid", "qpos").distinct(), "qid")
    met = pairs.join(ivf, "pid").join(use, ["qid", "cid"]).groupBy("qid", "qpos", "pid").agg(F.max("sim").alias("best"))
    filled = grid.join(met, ["qid", "qpos", "pid"], "left").withColumn("best", F.coalesce("best", F.lit(SENTINEL)))
    return filled.groupBy("qid", "pid").agg(F.round(F.sum("best"), decimals).alias("score"))


def centroid_rows(queries: DataFrame, centroids: DataFrame) -> DataFrame:
    """(qid, qpos, cids, vec): the scores of all centroids, in order of cid, in one row a query token."""

    def meet(table: pa.Table, asked: pa.Table) -> pa.Table:
        cid = table["cid"].to_numpy()
        order = np.argsort(cid, kind="stable")
        sims = np.round(_dots(_matrix(asked["vec"]), _matrix(table["vec"])[order]), 6)
        ends = np.arange(len(sims) + 1, dtype=np.int32) * len(cid)
        cids = pa.ListArray.from_arrays(ends, pa.array(np.tile(cid[order].astype(np.int32), len(sims))))
        return pa.table({"qid": asked["qid"], "qpos": asked["qpos"], "cids": cids, "vec": pa.ListArray.from_arrays(ends, sims.ravel())})

    table = centroids.select(F.col("cid").cast("int").alias("cid"), "vec")
    found = product(table, queries.select("qid", "qpos", "vec"), meet, "qid bigint, qpos bigint, cids array<int>, vec array<double>")
    if _bytes(table) <= QUERY_BYTES:
        return found
    # Blocks of centroids: all their scores in order of cid again.
    each = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("cids", "vec"))))
    return found.groupBy("qid", "qpos").agg(each.alias("e")).select("qid", "qpos", F.col("e.cids").alias("cids"), F.col("e.vec").alias("vec"))


def probed(rows: DataFrame, ncells: int) -> DataFrame:
    """Different (qid, cid): the best cells of each query token, ties by the smaller cid, from ``centroid_rows``."""
    best = F.slice(F.array_sort(F.zip_with("vec", "cids", lambda x, c: F.struct((-x).alias("x"), c.alias("cid")))), 1, ncells)
    return rows.select("qid", F.explode(best).alias("b")).select("qid", "b.cid").distinct()


def best_cells(queries: DataFrame, centroids: DataFrame, ncells: int) -> DataFrame:
    """Different (qid, cid): the best cells of each query token, ties by the smaller cid; scores are made in tiles and only the best leave a task."""
    cells = TILE_BYTES // 8

    def meet(table: pa.Table, asked: pa.Table) -> Iterator[pa.Table]:
        cid, matrix, vecs = table["cid"].to_numpy(), _matrix(table["vec"]), _matrix(asked["vec"])
        qid, qpos, height = asked["qid"].to_numpy(), asked["qpos"].to_numpy(), max(1, cells // len(cid))
        for at in range(0, len(vecs), height):
            sims = np.round(_dots(vecs[at : at + height], matrix), 6)
            i, j = _above(sims, ncells)
            yield pa.table({"qid": qid[i + at], "qpos": qpos[i + at], "cid": cid[j], "sim": sims[i, j]})

    table = centroids.select(F.col("cid").cast("int").alias("cid"), "vec")
    cut = best_rows(ncells, ["qid", "qpos"], [("sim", True), ("cid", False)])
    found = product(table, queries.select("qid", "qpos", "vec"), meet, "qid bigint, qpos bigint, cid int, sim double", cut=cut)
    return top_k(found, ncells, ["qid", "qpos"], F.desc("sim"), F.asc("cid")).select("qid", "cid").distinct()


def cascade(queries: DataFrame, centroids: DataFrame, ivf: DataFrame, codes: DataFrame, ncells: int, threshold: float, ndocs: int) -> tuple[DataFrame, DataFrame]:
    """Both filter stages: the ``ndocs`` by passing centroids, a quarter by all.

    ``ivf`` are postings (cid, pid), ``codes`` documents (pid, cids). Only
    documents in a probed cell are scored, for the queries that want them.
    Equal scores favour the larger document id.
    """
    pairs = small(best_cells(queries, centroids, ncells)).join(ivf, "cid").filter(F.col("pid") != F.col("qid")).select("qid", "pid").distinct()
    return filtered(queries, centroids, codes.join(wanted(pairs, queries), "pid"), threshold, ndocs)


def filtered(queries: DataFrame, centroids: DataFrame, docs: DataFrame, threshold: float, ndocs: int) -> tuple[DataFrame, DataFrame]:
    """Both stages of query tokens and documents (pid, cids, wanted).

    A query meets the centroids of the documents that it wants and no others,
    so there is no table of all scores. Where the centroids pass the bound of
    ``search.product`` documents bring the vectors of theirs.
    """
    cells, held = TILE_BYTES // 8, None
    if _bytes(centroids) <= QUERY_BYTES:
        table = centroids.select("cid", "vec").toArrow().sort_by("cid")
        held = table["cid"].to_numpy(), _matrix(table["vec"])
        docs = docs.select("pid", "cids", "wanted")
    else:
        docs = _with_centroids(docs, centroids)

    def meet(asked: pa.Table, docs: pa.Table) -> Iterator[pa.Table]:
        (sizes, matrix), pids, of = _ragged(asked), docs["pid"].to_numpy(), askers(docs)
        if held is None:
            lengths, words = _ragged(docs)
            codes = np.arange(len(words))
        else:
            lists = docs["cids"].combine_chunks()
            lengths, words = np.diff(lists.offsets.to_numpy()), held[1]
            codes = np.searchsorted(held[0], lists.flatten().to_numpy(zero_copy_only=False))
        starts, begins = np.cumsum(sizes) - sizes, np.cumsum(lengths) - lengths
        for i, qid in enumerate(asked["qid"].to_numpy()):
            all_ = of(qid)
            all_, rows = all_[lengths[all_] > 0], matrix[starts[i] : starts[i] + sizes[i]]
            for a, b in spans(lengths[all_], cells) if len(rows) else ():
                some, n = all_[a:b], lengths[all_[a:b]]
                heads = np.cumsum(n) - n
                met, at = np.unique(codes[np.repeat(begins[some] - heads, n) + np.arange(n.sum())], return_inverse=True)
                height, near = max(1, cells // len(met)), words[met]
                tiles = lambda: (np.round(_dots(rows[r : r + height], near), 6) for r in range(0, len(rows), height))  # noqa: B023, E731
                passing = np.maximum.reduce([t.max(axis=0) for t in tiles()]) >= threshold
                one, two = np.zeros(len(some)), np.zeros(len(some))
                for tile in tiles():
                    for by_token in tile:  # one query token at a time: no matrix of tokens and codes
                        two += np.maximum.reduceat(by_token[at], heads)
                        one += np.maximum.reduceat(np.where(passing, by_token, SENTINEL)[at], heads)
                yield pa.table({"qid": np.full(len(some), qid), "pid": pids[some], "score": np.round(one, 6), "next": np.round(two, 6)})

    cut = best_rows(ndocs, ["qid"], [("score", True), ("pid", True)])
    found = product(packed(queries, "qid", "qpos"), docs, meet, "qid bigint, pid bigint, score double, next double", "vecs", cut, "vecs" if held is None else "cids")
    best = [F.desc("score"), F.desc("pid")]
    one = top_k(found, ndocs, ["qid"], *best)
    two = top_k(one.select("qid", "pid", F.col("next").alias("score")), max(1, ndocs // 4), ["qid"], *best)
    return one.drop("next"), two


def _with_centroids(docs: DataFrame, centroids: DataFrame) -> DataFrame:
    """(pid, vecs, wanted): documents with the vectors of their different centroids, which meet them by a join."""
    each = docs.select("pid", "cids").dropDuplicates(["pid"]).select("pid", F.explode(F.array_distinct("cids")).alias("cid"))
    vecs = each.join(centroids.select("cid", "vec"), "cid").groupBy("pid").agg(F.collect_list("vec").alias("vecs"))
    return docs.select("pid", "wanted").join(vecs, "pid").select("pid", "vecs", "wanted")


def final_scores(pairs: DataFrame, queries: DataFrame, docs: DataFrame, decimals: int = 6) -> DataFrame:
    """Floored MaxSim of the surviving pairs over decompressed documents (pid, vecs)."""
    return rerank_packed(docs.join(wanted(pairs.select("qid", "pid"), queries), "pid"), queries, True, decimals)


def lloyd(tokens: DataFrame, start: DataFrame, rounds: int = 20) -> DataFrame:
    """(cid, vec): k-means from the centroids ``start``, scaled to length one at the end.

    A round assigns every vector to the nearest centroid (by distances of six
    digits; ties: the smallest cid) and takes means. Tasks send on one sum for
    each centroid they met. A centroid that loses all its vectors stays.
    """
    from pyspark.sql.types import ArrayType, DoubleType

    centroids = start.select(F.col("cid").cast("int").alias("cid"), F.col("vec").cast(ArrayType(DoubleType())).alias("vec"))
    rows = tokens.select("pid", "vec")
    spark = tokens.sparkSession
    for _ in range(rounds):
        sums = _sums(rows, centroids)
        parts = sums.select("cid", "n", F.posexplode("vec").alias("dim", "x")).groupBy("cid", "dim").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        mean = F.array_sort(F.collect_list(F.struct("dim", (F.col("x") / F.col("n")).alias("x"))))
        means = parts.groupBy("cid").agg(F.transform(mean, lambda s: s["x"]).alias("mean"))
        moved = centroids.join(means, "cid", "left").select("cid", F.coalesce("mean", "vec").alias("vec"))
        # About the root of the vectors: the driver holds centroids, never vectors.
        centroids = spark.createDataFrame(moved.toArrow(), "cid int, vec array<double>")
    return centroids.select("cid", l2_normalize("vec").alias("vec"))


def _sums(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cid, n, vec): number and sum of the vectors nearest to each centroid, one row a task and centroid."""
    held = centroids.toArrow().sort_by("cid")
    cid, matrix = held["cid"].to_numpy(), _matrix(held["vec"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(matrix.shape), np.zeros(len(matrix), np.int64)
        half = (matrix * matrix).sum(axis=1) / 2
        for part in parts:
            vecs = _matrix(pa.chunked_array([part.column("vec")])) if part.num_rows else np.empty((0, matrix.shape[1]))
            for at in range(0, len(vecs), 4096):
                some = vecs[at : at + 4096]
                near = np.round(_dots(some, matrix) - half, 6).argmax(axis=1)
                n += np.bincount(near, minlength=len(matrix))
                np.add.at(total, near, some)
        met = np.flatnonzero(n)
        lists = pa.ListArray.from_arrays(np.arange(len(met) + 1, dtype=np.int32) * matrix.shape[1], total[met].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(cid[met].astype(np.int32)), pa.array(n[met]), lists], names=["cid", "n", "vec"])

    return rows.mapInArrow(run, "cid int, n bigint, vec array<double>")


def train(tokens: DataFrame, k: int, rounds: int = 20, seed: int = 1) -> DataFrame:
    """(cid, vec): k-means centroids, scaled to length one; the first ones are spread out by the ML library's seeding."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    seeds = KMeans(k=k, maxIter=1, seed=seed).fit(tokens.select(array_to_vector("vec").alias("features"))).clusterCenters()
    start = tokens.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(seeds)], "cid int, vec array<double>")
    return lloyd(tokens, start, rounds)


def held_out(tokens: DataFrame, share: float = 0.05, key: Column | None = None) -> DataFrame:
    """``share`` of the rows, rounded down but one at least: the first in hash order over the whole table."""
    order = F.xxhash64("pid", "pos") if key is None else key
    placed = batches.in_order(tokens.withColumn("__hash", order), "__hash")
    return placed.filter(F.col("at") < max(1, int(share * tokens.count()))).drop("at", "__hash")

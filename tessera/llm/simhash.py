"""SimHash near-duplicate detection by multi-index hashing.

A fingerprint has 64 bits. Bit ``b`` is 1 when it is set in more than half of
the XXH64 hashes (seed 42) of a text's word shingles. Two fingerprints link
when at most ``radius`` bits differ.

Search. The 64 bits are cut into segments. Two fingerprints within ``radius``
agree, in at least one segment, up to a small Hamming ball: with ``m``
segments, ``s = radius // m`` and ``a = radius - m * s``, either one of the
first ``a + 1`` segments differs in at most ``s`` bits or one of the others in
at most ``s - 1``. Every fingerprint is entered once per segment and looked up
under each value of the ball; each candidate is verified over all 64 bits. No
link is lost: the search is exact.

Scale. Equal fingerprints are collapsed before the search, so copies cost one
aggregation. A table entry of up to ``CALM`` fingerprints is joined and gives
its links, at most so many a lookup. A larger one is cut into blocks, and what
leaves a pair of blocks is a spanning forest of its links, not the links: the
result needs classes, and a forest keeps those whole while its size stays
linear in the members. Only fingerprints with company are looked up for their
rows, by a join that spreads those which many rows share.

Defined cases. A null or blank text has fingerprint zero and links like any
other. Fewer words than a shingle make one shingle of all words. Repeated rows
come back as often as they come in. A null id takes part, but names a class
only when no other member has an id. An empty table gives an empty result.
Columns of the input other than id and text are ignored, whatever their names;
``keep_one`` passes them through.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tessera.llm.components import classes
from tessera.llm.runtime import checkpointed, joinable, looked_up

#: Bytes between words: space, tab, newline, vertical tab, form feed, return.
_GAPS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_TABLE = bytes(_GAPS[_LOWER[i]] for i in range(256))
#: Shingles that are turned into bits at a time.
_STRIP = 1 << 15
#: Fingerprints of a table entry that is joined as a whole.
CALM = 64


def fingerprint(text: str | None, width: int = 4) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, n, _STRIP):
        hashes = np.array(
            [digest(line[a:b], 42) for a, b in zip(starts[at : at + _STRIP], ends[at : at + _STRIP], strict=True)], np.uint64
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column, width: int = 4) -> Column:
    """Signed BIGINT holding the fingerprint of ``text``."""

    @arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(x.as_py(), width) for x in texts), np.uint64, len(texts))
        return pa.array(found.view(np.int64))

    return of(text)


def plan_segments(radius: int, segments: int) -> list[tuple[int, int, int]]:
    """(lowest bit, width, ball radius) of each segment; radius -1: not needed."""
    s, a = divmod(radius, segments)
    width, extra = divmod(64, segments)
    out, low = [], 0
    for i in range(segments):
        w = width + (i < extra)
        out.append((low, w, s if i <= a else s - 1))
        low += w
    return [x for x in out if x[2] >= 0]


def _ball(width: int, radius: int) -> list[int]:
    masks = [0]
    for r in range(1, radius + 1):
        masks += [sum(1 << b for b in bits) for bits in combinations(range(width), r)]
    return masks


def forest(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) pairs that keep the classes of a bipartite link matrix.

    At most one pair per row and column; root is the least id of its class.
    """
    r, c = rows.copy(), columns.copy()
    worst = np.iinfo(np.int64).max
    some_r, some_c = linked.any(axis=1), linked.any(axis=0)
    while True:
        new_r = np.minimum(r, np.where(linked, c[None, :], worst).min(axis=1, initial=worst))
        new_c = np.minimum(c, np.where(linked, new_r[:, None], worst).min(axis=0, initial=worst))
        if (new_r == r).all() and (new_c == c).all():
            break
        r, c = new_r, new_c
    return np.concatenate((rows[some_r], columns[some_c])), np.concatenate((r[some_r], c[some_c]))


def _block_links(table: pa.Table, radius: int) -> pa.Table:
    """Links between the probes and the entries of one pair of blocks."""
    fp = table["fp"].to_numpy()
    entry = table["entry"].to_numpy(zero_copy_only=False)
    rows, columns = np.unique(fp[~entry]), np.unique(fp[entry])
    a, b = [], []
    for at in range(0, len(rows), 1024):
        strip = rows[at : at + 1024]
        near = np.bitwise_count(strip.view(np.uint64)[:, None] ^ columns.view(np.uint64)[None, :]) <= radius
        x, y = forest(near, strip, columns)
        a.append(x)
        b.append(y)
    none = np.empty(0, np.int64)
    return pa.table({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])})


def links(fps: DataFrame, radius: int = 4, segments: int = 3, block: int = 2048, calm: int = CALM) -> DataFrame:
    """Links (a, b) that hold together all fingerprints within ``radius``.

    ``fps`` has distinct BIGINT values in column fp. A table entry of at most
    ``calm`` fingerprints is joined and gives its links; a larger one is cut
    into blocks and gives a spanning forest for each pair of blocks.
    """
    parts = plan_segments(radius, segments)
    segment = lambda low, width: F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))
    entries = fps.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("s"), segment(lo, w).alias("v")) for i, (lo, w, _) in enumerate(parts)])).alias("k")
    ).select("fp", "k.s", "k.v")
    balls = [F.array(*[F.lit(x).cast("bigint") for x in _ball(width, ball)]) for _, width, ball in parts]
    probes = None
    for i, (low, width, _) in enumerate(parts):
        one = fps.select("fp", segment(low, width).alias("own"), F.explode(balls[i]).alias("mask"))
        one = one.select("fp", F.lit(i).alias("s"), F.col("own").bitwiseXOR(F.col("mask")).alias("v"))
        probes = one if probes is None else probes.unionByName(one)
    sizes = entries.groupBy("s", "v").agg(F.count("*").alias("n"))
    # Few entries can exceed the bound: at most a row per `calm` fingerprints and segment.
    large = joinable(sizes.filter(F.col("n") > calm))
    small = lambda df: df.join(large, ["s", "v"], "left_anti")
    # What looks up a large entry is found from the entry's side: its ball, by the segment's own value.
    near = large.withColumn("mask", F.explode(F.element_at(F.array(*balls), F.col("s") + 1)))
    near = joinable(near.select("s", "n", F.col("v").alias("of"), F.col("v").bitwiseXOR(F.col("mask")).alias("v")))
    hot_entries = entries.join(large, ["s", "v"])
    hot_probes = checkpointed(entries.join(near, ["s", "v"]).select("fp", "s", F.col("of").alias("v"), "n"))
    per = joinable(hot_probes.groupBy("s", "v").agg(F.count("*").alias("p")))
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    deal = lambda n: F.pmod(F.xxhash64("fp"), blocks(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    left = hot_entries.join(per, ["s", "v"]).select("fp", "s", "v", deal("n").alias("i"), each("p").alias("j"), F.lit(True).alias("entry"))
    right = hot_probes.join(per, ["s", "v"]).select("fp", "s", "v", each("n").alias("i"), deal("p").alias("j"), F.lit(False).alias("entry"))
    # Dealt by all four, or the blocks of an entry would stay in one task.
    met = left.unionByName(right).repartition("s", "v", "i", "j").groupBy("s", "v", "i", "j")
    found = met.applyInArrow(lambda t: _block_links(t, radius), "a bigint, b bigint")
    return _join_links(small(entries), small(probes), radius).unionByName(found.filter("a <> b"))


def _join_links(entries: DataFrame, probes: DataFrame, radius: int) -> DataFrame:
    e, p = entries.withColumnRenamed("fp", "a"), probes.withColumnRenamed("fp", "b")
    near = (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return e.join(p, (e.s == p.s) & (e.v == p.v) & near).select("a", "b")


def _marked(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), fingerprints(F.col(text_col), width).alias("fp"))


def _company(marked: DataFrame, radius: int, segments: int) -> DataFrame:
    """Of fingerprints that several rows or links hold: the class's least id, the fingerprint of its row that stays, and their rows."""
    fps = marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    roots = classes(links(fps.select("fp"), radius, segments)).withColumnRenamed("node", "fp")
    known = fps.join(roots, "fp", "left").filter("n > 1 or root is not null").withColumn("root", F.coalesce("root", "fp"))
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp"))
    one = known.groupBy("root").agg(first.alias("first")).select("root", F.col("first.least").alias("component_id"), F.col("first.fp").alias("stays"))
    return known.join(one, "root").select("fp", "n", "component_id", "stays")


def simhash_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, segments: int = 3
) -> DataFrame:
    """(id, fingerprint BIGINT, component_id) for each row of ``docs``.

    ``component_id`` is the smallest id whose fingerprint is reachable over
    links of at most ``radius`` differing bits.
    """
    marked = checkpointed(_marked(docs, id_col, text_col, width))
    met = looked_up(marked, _company(marked, radius, segments), "fp", "n")
    return met.select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, segments: int = 3
) -> DataFrame:
    """The rows of ``docs`` without all but one of each class; columns as they are.

    The row with the smallest id stays, null last; of rows that share it, the
    one with the smallest signed fingerprint; of rows that share both, one.
    """
    marked = checkpointed(_marked(docs, id_col, text_col, width))
    company = checkpointed(_company(marked, radius, segments))
    told = looked_up(marked, company, "fp", "n").filter("stays is not null")
    leaves = lambda i: ~(i.eqNullSafe(F.col("component_id")) & (F.col("fp") == F.col("stays")))
    # Rows are told apart by id. Those whose id is null or repeated are decided by their fingerprint, made anew.
    shared = checkpointed(marked.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 or id is null").select("id"))
    gone = told.filter(leaves(F.col("id"))).select("id").distinct().unionByName(shared)
    own = lambda t, how: docs.join(t.withColumnRenamed("id", "__gone"), docs[id_col].eqNullSafe(F.col("__gone")), how)
    single = own(joinable(gone.distinct()), "left_anti")
    if shared.isEmpty():
        return single.select(docs.columns)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    again = own(joinable(shared), "left_semi").select(row, F.col(id_col).alias("id"), fingerprints(F.col(text_col), width).alias("fp"))
    decided = looked_up(again, company, "fp", "n").filter(F.col("stays").isNull() | ~leaves(F.col("id")))
    return single.select(docs.columns).unionByName(decided.dropDuplicates(["id", "fp"]).select("row.*"))

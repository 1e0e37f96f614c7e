"""How filters interact: what each removes, in every order they could run in.

Copies are found by partition refinement. Rows are split by their text's length
in code points, then by the hash of its first block, of its second and so on;
after each split the rows that are alone drop out. Blocks grow by ``GROWTH``,
so a text of any length has at most nine. The full texts of what survives are
compared, a class that a collision put together is taken apart by its texts,
and every row whose id is not the least among equal texts is marked.

Each row then has a mask of the filters it fails, and everything else follows
from how many rows of a part have which mask: for a filter and the set of
filters before it, a row is removed when its mask holds the filter and none
before, redundant when it holds the filter and one before. Sets do not depend
on the order within, so 2**(k-1) sets a filter serve all k! orders. Summed over
the orders, a row that fails m filters is removed by each of them in k!/m.

Scale. Texts are read twice, the second time only to compare survivors, and a
text moves at most once a task for each different one among them. All else
moves as narrow rows: keys are counted with a partial step, so a group of
copies that makes up a third of all rows costs one row a task, and
``runtime.looked_up`` hands rows their verdict without gathering a hot key.
What is enumerated per part depends on the number of filters alone.

Defined cases. A null text counts as empty, and empty texts are equal to each
other; a null part is the empty string. A null id fails no duplicate filter and
makes none fail; rows that repeat an id with the same text are no copies of one
another, since neither id is smaller. A document is good (toxic) when some row
of ``labels`` with its id says so. An empty table has no part and no row.
Columns beyond those named are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.runtime import checkpointed, joinable, looked_up, stored

Hash = Callable[[Column], Column]
#: Code points of the first block, and how much longer each next one reaches.
BLOCK, GROWTH = 512, 8


def words(text: Column) -> Column:
    """Maximal stretches without the characters 0x20 and 0x09 to 0x0D."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


#: Failure of a text by its column, its words and its code points.
FILTERS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "A": lambda text, words, chars: F.size(words) < 200,
    "B": lambda text, words, chars: 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
    "C": lambda text, words, chars: 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * chars,
    "D": lambda text, words, chars: text.rlike("[#$%&*|]"),
}
DUPLICATE = "E"


def _ends() -> list[int]:
    """Where blocks end; the last reaches beyond any text."""
    ends = [BLOCK]
    while ends[-1] < 1 << 31:
        ends.append(ends[-1] * GROWTH)
    return ends


def block_hashes(text: Column, chars: Column, hashed: Hash = F.xxhash64) -> Column:
    """The hash of each block that a text has, null beyond its end."""
    ends = _ends()
    starts = [0, *ends[:-1]]
    cut = lambda a, b: F.substring(text, a + 1, min(b, (1 << 31) - 1) - a)
    return F.array(*[F.when(chars > a, hashed(cut(a, b))) for a, b in zip(starts, ends, strict=True)])


def _keyed(docs: DataFrame, hashed: Hash) -> DataFrame:
    """``docs`` with the length and the block hashes of ``text``."""
    sized = docs.withColumn("chars", F.char_length("text").cast("bigint"))
    return sized.withColumn("hashes", block_hashes(F.col("text"), F.col("chars"), hashed))


def refined(rows: DataFrame) -> DataFrame:
    """(key, n): the classes of several rows that length and all blocks leave together.

    ``rows`` has chars and hashes. The key is the length and the hashes.
    """
    alive, blocks = rows.select("chars", "hashes"), len(_ends())
    for done in range(blocks + 1):
        key = F.concat(F.array("chars"), F.slice("hashes", 1, done)).alias("key")
        classes = checkpointed(alive.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1"))
        longest = classes.agg(F.max(F.col("key")[0])).first()[0]
        if done == blocks or longest is None or longest <= ([0, *_ends()][done]):
            break
        kept = looked_up(alive.withColumn("key", key), classes.withColumn("met", F.lit(True)), "key", "n")
        alive = stored(kept.filter("met").select("chars", "hashes"))
    rest = [F.lit(None).cast("bigint")] * (blocks - done)
    return classes.select(F.concat("key", F.array(*rest)).alias("key") if rest else "key", "n")


def marked(docs: DataFrame, id_col: str, text_col: str, carried: dict[str, Column], hashed: Hash = F.xxhash64) -> DataFrame:
    """(id, what ``carried`` names, duplicate): whether a smaller id has the same text.

    ``carried`` are columns of ``text``, ``words`` and ``chars``, and of the table.
    """
    names, key = list(carried), F.concat(F.array("chars"), F.col("hashes"))
    source = docs.withColumns({"__id": F.col(id_col), "__text": F.coalesce(F.col(text_col), F.lit(""))})
    source = source.select(F.col("__id").alias("id"), F.col("__text").alias("text"), *[F.col(c).alias(f"in_{c}") for c in docs.columns])
    facts = _keyed(source, hashed).withColumn("words", words(F.col("text")))
    rows = stored(facts.select("id", *[c.alias(n) for n, c in carried.items()], "chars", "hashes"))
    classes = refined(rows)
    if classes.isEmpty():
        return rows.select("id", *names, F.lit(False).alias("duplicate"))
    texts = _keyed(source.select("id", "text"), hashed).select("id", "text", key.alias("key"))
    met = texts.join(joinable(classes.select("key"), weight=F.size("key")), "key", "left_semi")
    groups = stored(met.groupBy("key", "text").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    verdicts = groups.groupBy("key").agg(F.min("least").alias("least"), F.count("*").alias("texts"), F.sum("n").alias("n"))
    told = looked_up(rows.withColumn("key", key), verdicts, "key", "n", weight=F.size("key"))
    alone = F.coalesce(F.col("texts") == 1, F.lit(True))
    found = lambda df: df.select("id", *names, F.coalesce(F.col("id") > F.col("least"), F.lit(False)).alias("duplicate"))
    out = found(told.filter(alone))
    mixed = checkpointed(groups.groupBy("key").agg(F.count("*").alias("texts")).filter("texts > 1").select("key"))
    if mixed.isEmpty():
        return out
    # Equal hashes of different texts: here, and only here, rows meet by their texts.
    again = facts.withColumn("key", key).join(mixed, "key", "left_semi").select("id", "text", "key", *[c.alias(n) for n, c in carried.items()])
    return out.unionByName(found(again.join(groups.select("key", "text", "least"), ["key", "text"])))


def failure_counts(rows: DataFrame, labels: DataFrame, label_id: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic) of rows (id, part, mask): how many there are of each mask, and how many are labelled so."""
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    said = labels.groupBy(F.col(label_id).alias("id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic")).filter("good + toxic > 0")
    all_ = rows.groupBy("part", "mask").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("bigint")
    lost = rows.filter(F.col("id").isNotNull()).groupBy("id", "part", "mask").agg(F.count("*").alias("n")).join(said, "id")
    lost = lost.groupBy("part", "mask").agg(*[F.sum(F.col("n") * F.col(c)).alias(c) for c in ("good", "toxic")])
    both = all_.select("part", "mask", "n", zero.alias("good"), zero.alias("toxic")).unionByName(lost.select("part", "mask", zero.alias("n"), "good", "toxic"))
    return both.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def interactions(counts: DataFrame, letters: str) -> DataFrame:
    """Rows of every part, order of the filters and step, from (part, mask, n, good, toxic); bit i of a mask is the i-th letter."""
    k = len(letters)
    bits = {c: 1 << i for i, c in enumerate(letters)}
    sets = [(b, p) for b in bits.values() for p in range(1 << k) if not p & b]
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(p).alias("before")) for b, p in sets])).alias("s")
    met = counts.select("*", each).select("part", "mask", "n", "good", "toxic", "s.bit", "s.before")
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda where, c, name: F.sum(F.when(where, F.col(c)).otherwise(0)).cast("bigint").alias(name)
    shares = F.expr(f"n * ({math.factorial(k)} div greatest(bit_count(mask), 1))")
    sums = met.groupBy("part", "bit", "before").agg(
        total(~fails & ~earlier, "n", "kept"),
        total(fails & ~earlier, "n", "removed"),
        total(fails & earlier, "n", "redundant"),
        total(F.col("mask") == F.col("bit"), "n", "unique_fails"),
        total(fails & ~earlier, "good", "good_lost"),
        total(fails & ~earlier, "toxic", "toxic_lost"),
        F.sum(F.when(fails, shares).otherwise(0)).cast("bigint").alias("shapley"),
    )
    orders = [("".join(o), i + 1, bits[o[i]], reduce(int.__or__, (bits[c] for c in o[:i]), 0)) for o in permutations(letters) for i in range(k)]
    steps = counts.sparkSession.createDataFrame(orders, "filter_order string, step int, bit int, before int")
    found = sums.join(F.broadcast(steps), ["bit", "before"])
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", filters: dict | None = None, hashed: Hash = F.xxhash64
) -> DataFrame:
    """One row per part, order and step: filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``filters`` gives each letter its failure; the duplicate filter is the last letter.
    """
    filters = FILTERS if filters is None else filters
    mask = reduce(
        Column.__add__, [F.when(f(F.col("text"), F.col("words"), F.col("chars")), F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(filters.values())]
    )
    carried = {"part": F.coalesce(F.col(f"in_{part_col}").cast("string"), F.lit("")), "mask": mask}
    rows = marked(docs.select(*dict.fromkeys([id_col, text_col, part_col])), id_col, text_col, carried, hashed)
    rows = rows.select("id", "part", (F.col("mask") + F.col("duplicate").cast("int") * (1 << len(filters))).alias("mask"))
    return interactions(failure_counts(rows, labels), "".join(filters) + DUPLICATE)

"""Joins of ids with texts and tags, and the guards that go with them."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.batches import in_order
from tessera.operators.search import product


def keep_last(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Of repeated keys the value that comes last."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def merged(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """Both tables; where both have a key the second's value stays."""
    both = first.withColumn("at", F.lit(0)).unionByName(second.withColumn("at", F.lit(1)))
    return keep_last(both, key, value, "at")


def triple_texts(triples: DataFrame, queries: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, pos_pid, neg_pid) with the three texts."""
    text = lambda df, key, name: df.select(F.col(df.columns[0]).alias(key), F.col(df.columns[1]).alias(name))
    return (
        triples.join(text(queries, "qid", "query"), "qid")
        .join(text(passages, "pos_pid", "positive"), "pos_pid")
        .join(text(passages, "neg_pid", "negative"), "neg_pid")
    )


def pair_texts(qrels: DataFrame, queries: DataFrame, passages: DataFrame) -> DataFrame:
    return qrels.join(queries, "qid").join(passages, "pid")


def dangling(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Ids that the table lacks."""
    return ids.join(table, key, "left_anti")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that are in both tables; an append is refused when there are any."""
    return a.select(key).intersect(b.select(key))


def same_keys(a: DataFrame, b: DataFrame, key: str) -> bool:
    return a.select(key).exceptAll(b.select(key)).isEmpty() and b.select(key).exceptAll(a.select(key)).isEmpty()


def with_tags(passages: DataFrame, tags: DataFrame, key: str = "pid") -> DataFrame:
    """Passages with their tags; raises when the key sets differ."""
    if not same_keys(passages, tags, key):
        raise ValueError("passages and tags must have the same keys")
    return passages.join(tags, key)


def evaluable(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    return queries.join(qrels, "qid", "left_semi")


def hit_texts(hits: DataFrame, passages: DataFrame) -> DataFrame:
    """Hits (qid, pid, ..) with the text of their passage; a hit without one has none."""
    return hits.join(passages.select("pid", "text"), "pid", "left").select(*hits.columns, "text")


def containing(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, pid): documents (pid, text) that hold the text of an item (qid, text).

    One pass over each document finds all items, by an automaton over the
    items of a block; see ``search.product`` for how many a block holds.
    """
    built: dict[int, tuple] = {}

    def automaton(asked: pa.Table) -> tuple:
        if id(asked) not in built:
            built.clear()
            which: dict[str, list[int]] = {}
            for qid, text in zip(asked["qid"].to_pylist(), asked["text"].to_pylist(), strict=True):
                which.setdefault(text, []).append(qid)
            found = ahocorasick.Automaton()
            everywhere = which.pop("", [])
            for text, ids in which.items():
                found.add_word(text, ids)
            found.make_automaton()
            built[id(asked)] = (asked, found if which else None, everywhere)
        return built[id(asked)]

    def meet(asked: pa.Table, found: pa.Table) -> pa.Table:
        _, machine, everywhere = automaton(asked)
        qids, pids = [], []
        for pid, text in zip(found["pid"].to_pylist(), found["text"], strict=True):
            ids = {q for _, some in machine.iter(text.as_py()) for q in some} if machine else set()
            qids += [*ids, *everywhere]
            pids += [pid] * (len(ids) + len(everywhere))
        return pa.table({"qid": pa.array(qids, pa.int64()), "pid": pa.array(pids, pa.int64())})

    return product(items.select("qid", "text").dropna(), docs.select("pid", "text").dropna(), meet, "qid bigint, pid bigint", "text")


def next_other(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, pos_pid, neg_pid): each relevant pair with the smallest id of ``docs`` above it that is not relevant to the query.

    Documents are numbered without gaps. Relevant documents that follow one
    another have the same place less rank within their query; for all of such a
    run the answer is the place after its end. So each pair is one row.
    """
    places = in_order(docs.select(F.col("pid").alias("neg_pid")), "neg_pid")
    known = pairs.select("qid", "pid").distinct()
    at = known.join(places.select(F.col("neg_pid").alias("pid"), F.col("at").alias("place")), "pid")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("place"))
    runs = at.withColumn("run", F.col("place") - rank)
    after = runs.withColumn("at", F.max("place").over(Window.partitionBy("qid", "run")) + 1)
    return after.join(places, "at").select("qid", F.col("pid").alias("pos_pid"), "neg_pid")

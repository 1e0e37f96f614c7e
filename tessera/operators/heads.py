"""Model heads on hidden states: keyword weights, token and whole-text vectors, experts, tags.

Hidden states (id, pos, token_id, vec) come from any base model. A head is a
matrix; all heads of a model are applied to a batch of states in one blocked
product each, and give one row per token in one schema. Matrices are broadcast
once to every worker; their size is the model's, not the data's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import pruning, search
from tessera.operators.search import _matrix

SCHEMA = "pos bigint, token_id bigint, vec array<double>, weight double, cls array<double>, experts array<struct<weight: double, expert_id: bigint>>, tag int"


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-12)


def _lists(rows: np.ndarray, used: np.ndarray | None = None) -> pa.ListArray:
    """Rows as lists; null out of ``used``."""
    width = rows.shape[1]
    ends = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()), mask=None if used is None else pa.array(~used))


@dataclass(frozen=True)
class Heads:
    """Matrices of (hidden size, outputs); a head that is missing gives null, and without ``token`` vectors are the states.

    ``unit`` scales token vectors to length one. ``keyword`` has one column,
    whose sigmoid is the token's weight; ``router`` one an expert, of which a
    token takes the ``experts`` best by log(1 + relu), ties by the smaller;
    ``tagger`` one a tag, of which it takes the best. ``whole`` is applied to
    the state at position 0.
    """

    token: np.ndarray | None = None
    whole: np.ndarray | None = None
    keyword: np.ndarray | None = None
    router: np.ndarray | None = None
    tagger: np.ndarray | None = None
    unit: bool = True
    experts: int = 1

    def apply(self, hidden: DataFrame, key: str, at: str = "pos") -> DataFrame:
        """(key, pos, token_id, vec, weight, cls, experts, tag) of every state."""
        model, names = hidden.sparkSession.sparkContext.broadcast(self), [key, "pos", "token_id", "vec", "weight", "cls", "experts", "tag"]

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays([part.column(key), part.column(at), part.column("token_id"), *model.value.outputs(part, at)], names=names)

        rows = hidden.select(key, F.col(at).cast("bigint").alias(at), F.col("token_id").cast("bigint").alias("token_id"), "vec")
        return rows.mapInArrow(run, f"{key} bigint, {SCHEMA}")

    def outputs(self, part: pa.RecordBatch, at: str) -> list[pa.Array]:
        states, n = _matrix(pa.chunked_array([part.column("vec")])), part.num_rows
        tokens = states if self.token is None else states @ self.token
        weight = pa.nulls(n, pa.float64()) if self.keyword is None else pa.array(1.0 / (1.0 + np.exp(-(states @ self.keyword).ravel())))
        cls = pa.nulls(n, pa.list_(pa.float64()))
        if self.whole is not None:
            first = part.column(at).to_numpy() == 0
            found = np.zeros((n, self.whole.shape[1]))
            found[first] = states[first] @ self.whole
            cls = _lists(found, first)
        experts = pa.nulls(n, pa.list_(pa.struct([("weight", pa.float64()), ("expert_id", pa.int64())])))
        if self.router is not None:
            scores = np.log1p(np.maximum(states @ self.router, 0.0))
            best = np.argsort(-scores, axis=1, kind="stable")[:, : self.experts]
            pairs = pa.StructArray.from_arrays([pa.array(np.take_along_axis(scores, best, axis=1).ravel()), pa.array(best.ravel().astype(np.int64))], ["weight", "expert_id"])
            experts = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * best.shape[1], pairs)
        tag = pa.nulls(n, pa.int32()) if self.tagger is None else pa.array((states @ self.tagger).argmax(axis=1).astype(np.int32))
        return [_lists(_unit(tokens) if self.unit else tokens), weight, cls, experts, tag]


def keyword_tokens(encoded: DataFrame, threshold: float, apply_weight: bool = False) -> DataFrame:
    """Tokens of an index that keeps those of at least the threshold weight."""
    return pruning.keyword(encoded, threshold, apply_weight)


def whole_texts(encoded: DataFrame, key: str) -> DataFrame:
    """(key, vec): the whole-text vectors."""
    return encoded.filter("cls IS NOT NULL").select(key, F.col("cls").alias("vec"))


def routes(encoded: DataFrame) -> DataFrame:
    """A row for each token and expert of its: (.., expert_id, weight, vec)."""
    kept = [c for c in encoded.columns if c not in ("weight", "experts", "cls", "tag")]
    return encoded.select(*kept, F.explode("experts").alias("e")).select(*kept, "e.expert_id", "e.weight")


def keyword_search(queries: DataFrame, passages: DataFrame, k: int, threshold: float) -> DataFrame:
    """(qid, pid, score) of encoded texts, passages pruned by keyword weight; the best ``k`` of each task."""
    return search.exact_scores(queries, keyword_tokens(passages, threshold), k=k)


def lexical_search(queries: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """(qid, pid, score): token vectors by equal ids, and whole-text vectors; the best ``k`` of each shard of passages."""
    return search.lexical_best(queries, passages, k, (whole_texts(queries, "qid"), whole_texts(passages, "pid")))


def routed_search(queries: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """(qid, pid, score): token vectors by equal experts, weighted by both sides; the best ``k`` of each shard of passages."""
    return search.routed(routes(queries), routes(passages), k=k)

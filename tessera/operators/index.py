"""Indexes: token tables that are built, appended, saved, loaded and searched.

A saved index is a folder of generations (see ``store``): saving to the folder
it came from writes only what was appended and commits it at the end, a failed
write leaves the former generation, and emptying is a generation of its own.
Appending refuses known documents.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors
from tessera.operators import batches, corpus, pruning, residual, search
from tessera.operators.store import Manifest, Store, stored

Prune = Callable[[DataFrame], DataFrame]


def keyword(threshold: float, apply_weight: bool = False) -> Prune:
    return lambda t: pruning.keyword(t, threshold, apply_weight)


def first_tokens(share: float) -> Prune:
    return lambda t: pruning.first_tokens(t, share)


def top_attention(share: float) -> Prune:
    return lambda t: pruning.top_attention(t, share)


def top_idf(share: float, strict: bool = False) -> Prune:
    return lambda t: pruning.top_idf(t, share, strict)


#: Buckets of a stored part, documents by pid, postings by token or cell; and different keys that are written into a plan as literals.
BUCKETS, LITERALS = 64, 4096


@dataclass(frozen=True)
class Home:
    """Where an index was loaded from or saved to, as of a generation."""

    store: Store
    manifest: Manifest


@dataclass(frozen=True)
class Tables:
    """Tables of an index: those of its home, and rows that are not stored yet."""

    home: Home | None = None
    fresh: dict[str, DataFrame] = field(default_factory=dict)

    def parts(self, name: str) -> list[DataFrame]:
        stored = self.home.store.parts(self.home.manifest, name) if self.home else []
        found = stored + ([self.fresh[name]] if name in self.fresh else [])
        return found or [self.all(name)]

    def all(self, name: str) -> DataFrame:
        if name in self.fresh and not (self.home and self.home.manifest.tables.get(name)):
            return self.fresh[name]
        stored = self.home.store.table(self.home.manifest, name)
        return stored.unionByName(self.fresh[name]) if name in self.fresh else stored

    def grown(self, **more: DataFrame) -> Tables:
        return replace(self, fresh=self.fresh | {n: self.fresh[n].unionByName(rows) if n in self.fresh else rows for n, rows in more.items()})

    def emptied(self, *names: str) -> Tables:
        """Without the rows of some tables, which is a generation of its own once saved."""
        fresh = {n: rows.limit(0) if n in names else rows for n, rows in self.fresh.items()}
        if self.home is None:
            return replace(self, fresh=fresh)
        kept = {n: () if n in names else parts for n, parts in self.home.manifest.tables.items()}
        return Tables(replace(self.home, manifest=replace(self.home.manifest, tables=kept)), {n: r for n, r in fresh.items() if n not in names})

    def saved(self, spark: SparkSession, path: str, keys: dict[str, str], settings: dict, sorts: dict[str, str] | None = None) -> Tables:
        """Committed to ``path``: only what is fresh when it came from there, else everything.

        A table is bucketed by its entry in ``keys`` unless that is blank, and buckets are in order of ``sorts`` or of the key.
        """
        store = Store(spark, path)
        same = self.home is not None and self.home.store.path == path
        base = self.home.manifest if same else store.manifest()
        tables, schemas = (dict(base.tables), dict(base.schemas)) if same else ({}, {})
        for name, key in keys.items():
            rows = self.fresh.get(name) if same else self.all(name)
            if rows is None:
                continue
            part = store.write(rows, name, key, BUCKETS if key else 0, (sorts or {}).get(name, ""))
            tables[name] = (*tables.get(name, ()), part)
            schemas[name] = rows.schema.json()
        done = store.commit(base, Manifest(0, tables, schemas, settings))
        return Tables(Home(store, done))


def _joined(parts: list[DataFrame], other: DataFrame, key: str) -> DataFrame:
    """The join of each part with ``other``, one below the other: a bucketed part is not moved."""
    return reduce(DataFrame.unionByName, [p.join(other, key) for p in parts])


def _literal(keys: DataFrame) -> list | None:
    """The different values of a column, if they are few enough to stand in a plan."""
    found = [r[0] for r in keys.distinct().limit(LITERALS + 1).collect()]
    return found if len(found) <= LITERALS else None


def _only(parts: list[DataFrame], key: str, values: list | None) -> list[DataFrame]:
    """Parts cut to some keys by a literal, which buckets and statistics of files are pruned by."""
    return parts if values is None else [p.filter(F.col(key).isin(values)) for p in parts]


def _packed(tokens: DataFrame) -> DataFrame:
    kinds = {f.name for f in tokens.schema.fields}
    rows = tokens if "token_id" in kinds else tokens.withColumn("token_id", F.lit(None).cast("bigint"))
    rows = rows.select(F.col("pid").cast("bigint").alias("pid"), F.col("pos").cast("bigint").alias("pos"), F.col("token_id").cast("bigint").alias("token_id"), F.col("vec").cast("array<double>").alias("vec"))
    return search.packed(rows, "pid", "pos", ("pos", "token_id"))


@dataclass(frozen=True)
class FlatIndex:
    """Documents with all their token vectors: (pid, vecs, pos, token_id), packed once and bucketed by pid when saved."""

    tables: Tables
    prune: Prune | None = None

    @classmethod
    def build(cls, tokens: DataFrame, prune: Prune | None = None) -> FlatIndex:
        """Of (pid, pos, token_id, vec); ``prune`` also applies to what is appended."""
        return cls(Tables(fresh={"docs": _packed(prune(tokens) if prune else tokens)}), prune)

    @property
    def docs(self) -> DataFrame:
        return self.tables.all("docs")

    @property
    def tokens(self) -> DataFrame:
        """(pid, pos, token_id, vec) again."""
        each = self.docs.select("pid", F.explode(F.arrays_zip("pos", "token_id", "vecs")).alias("t"))
        return each.select("pid", "t.pos", "t.token_id", F.col("t.vecs").alias("vec"))

    def _refuse_known(self, tokens: DataFrame) -> None:
        if not corpus.overlap(self.docs, tokens, "pid").isEmpty():
            raise ValueError("some documents are in the index already")

    def append(self, tokens: DataFrame) -> FlatIndex:
        self._refuse_known(tokens)
        return replace(self, tables=self.tables.grown(docs=_packed(self.prune(tokens) if self.prune else tokens)))

    def reset(self) -> FlatIndex:
        return replace(self, tables=self.tables.emptied("docs"))

    def save(self, path: str) -> FlatIndex:
        """The index as a new generation in ``path``, bound to it; appended documents are all that is written when it came from there."""
        spark = self.docs.sparkSession
        return replace(self, tables=self.tables.saved(spark, path, {"docs": "pid"}, {"kind": "flat"}))

    @classmethod
    def load(cls, spark: SparkSession, path: str, prune: Prune | None = None) -> FlatIndex:
        return cls(_home(spark, path, "flat"), prune)

    def search(self, queries: DataFrame, k: int, top_k_tokens: int | None = None) -> DataFrame:
        """(qid, pid, score, rank): all documents, or only those of near tokens. No document is moved by the former."""
        if top_k_tokens is None:
            scores = search.packed_scores(search.packed(queries, "qid", "qpos"), self.docs.select("pid", "vecs"), k=k)
        else:
            near = search.candidates(search.token_neighbours(queries, self.tokens, top_k_tokens))
            asked = search.wanted(near, queries)
            parts = [p.select("pid", "vecs") for p in self.tables.parts("docs")]
            scores = search.rerank_packed(_joined(_only(parts, "pid", _literal(near.select("pid"))), asked, "pid"), queries)
        return search.top_k(scores, k, ["qid"], F.desc("score"), F.asc("pid"))


def _home(spark: SparkSession, path: str, kind: str) -> Tables:
    store = Store(spark, path)
    manifest = store.manifest()
    if manifest is None or manifest.settings.get("kind") != kind:
        raise ValueError(f"{path} holds no {kind} index")
    return Tables(Home(store, manifest))


@dataclass(frozen=True)
class VectorIndex:
    """One vector a document: (pid, vec)."""

    tables: Tables

    @classmethod
    def build(cls, vectors: DataFrame) -> VectorIndex:
        return cls(Tables(fresh={"vectors": _vectors(vectors)}))

    @property
    def vectors(self) -> DataFrame:
        return self.tables.all("vectors")

    def append(self, vectors: DataFrame) -> VectorIndex:
        if not corpus.overlap(self.vectors, vectors, "pid").isEmpty():
            raise ValueError("some documents are in the index already")
        return replace(self, tables=self.tables.grown(vectors=_vectors(vectors)))

    def reset(self) -> VectorIndex:
        return replace(self, tables=self.tables.emptied("vectors"))

    def save(self, path: str) -> VectorIndex:
        return replace(self, tables=self.tables.saved(self.vectors.sparkSession, path, {"vectors": ""}, {"kind": "vector"}))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        return cls(_home(spark, path, "vector"))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, pid, score, rank) of queries (qid, vec)."""
        return search.top_k(search.single_vector(queries, self.vectors, k=k), k, ["qid"], F.desc("score"), F.asc("pid"))


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("pid").cast("bigint").alias("pid"), F.col("vec").cast("array<double>").alias("vec"))


@dataclass(frozen=True)
class LexicalIndex:
    """Postings in shards of documents, (shard, token_id, pids, vecs), bucketed by shard when saved; whole-text vectors are among them (see ``search.shards``)."""

    tables: Tables
    whole: bool

    @classmethod
    def build(cls, tokens: DataFrame, cls_vectors: DataFrame | None = None) -> LexicalIndex:
        return cls(Tables(fresh=_lexical(tokens, cls_vectors)), cls_vectors is not None)

    def append(self, tokens: DataFrame, cls_vectors: DataFrame | None = None) -> LexicalIndex:
        """Further documents, in shards of their own when saved."""
        if (cls_vectors is not None) != self.whole:
            raise ValueError("whole-text vectors must come with all documents or with none")
        if not corpus.overlap(self.pids, tokens, "pid").isEmpty():
            raise ValueError("some documents are in the index already")
        more, held = _lexical(tokens, cls_vectors), self.tables.fresh.get("postings")
        if held is not None:  # both stay unsaved: their shards are numbered one after the other
            after = (held.agg(F.max("shard")).first()[0] or 0) + 1
            more["postings"] = more["postings"].withColumn("shard", F.col("shard") + after)
        return replace(self, tables=self.tables.grown(**more))

    @property
    def pids(self) -> DataFrame:
        return self.tables.all("documents")

    @property
    def cls_vectors(self) -> DataFrame | None:
        """(pid, vec) of whole texts."""
        if not self.whole:
            return None
        rows = self.tables.all("postings").filter(F.col("token_id") == search.WHOLE)
        return rows.select(F.explode(F.arrays_zip("pids", "vecs")).alias("t")).select(F.col("t.pids").alias("pid"), F.col("t.vecs").alias("vec"))

    def reset(self) -> LexicalIndex:
        return replace(self, tables=self.tables.emptied("postings", "documents"))

    def save(self, path: str) -> LexicalIndex:
        settings = {"kind": "lexical", "whole": self.whole}
        tables = self.tables.saved(self.pids.sparkSession, path, {"postings": "shard", "documents": ""}, settings, {"postings": "token_id"})
        return replace(self, tables=tables)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LexicalIndex:
        tables = _home(spark, path, "lexical")
        return cls(tables, tables.home.manifest.settings["whole"])

    def search(self, queries: DataFrame, k: int, cls_queries: DataFrame | None = None) -> DataFrame:
        """(qid, pid, score, rank); the queries' tokens come to the shards, which are scored where they lie.

        Postings are in order of token, so files are read only where a token that is asked for can be.
        """
        whole = cls_queries if self.whole else None
        met = _literal(queries.filter("token_id IS NOT NULL").select("token_id"))
        met = met if met is None or whole is None else [*met, search.WHOLE]
        scores = search.best_of_shards(queries, _only(self.tables.parts("postings"), "token_id", met), k, whole)
        return search.top_k(scores, k, ["qid"], F.desc("score"), F.asc("pid"))


def _lexical(tokens: DataFrame, cls_vectors: DataFrame | None) -> dict[str, DataFrame]:
    rows = tokens.select(F.col("pid").cast("bigint").alias("pid"), F.col("token_id").cast("bigint").alias("token_id"), F.col("vec").cast("array<double>").alias("vec"))
    postings = search.shards(rows, whole=None if cls_vectors is None else _vectors(cls_vectors))
    return {"postings": postings, "documents": rows.select("pid").distinct()}


@dataclass(frozen=True)
class ResidualIndex:
    """Centroids and codec, documents' codes (pid, cids, packed) bucketed by pid, and the cells' postings (slot, pids) bucketed by slot."""

    tables: Tables

    @classmethod
    def build(cls, tokens: DataFrame, centroids: DataFrame, codec: DataFrame) -> ResidualIndex:
        """Of all tokens (pid, pos, vec) under centroids and a codec that are known."""
        centroids = centroids.select(F.col("cid").cast("int").alias("cid"), F.col("vec").cast("array<double>").alias("vec"))
        return cls(Tables(fresh={"centroids": centroids, "codec": codec} | _coded(tokens, centroids, codec)))

    @classmethod
    def from_flat(cls, flat: FlatIndex, centroids: DataFrame, nbits: int = 1) -> ResidualIndex:
        tokens = flat.tokens
        return cls.build(tokens, centroids, residual.codec(residual.residuals(residual.assign(tokens, centroids)), nbits))

    @classmethod
    def train(cls, tokens: DataFrame, nbits: int = 1, coef: float = 2.0, rounds: int = 20, seed: int = 1) -> ResidualIndex:
        """Centroids and codec from a sample of documents, codes of all tokens.

        The sample has ``vectors.sample_size`` documents in hash order, and
        the centroids number ``vectors.partitions``. A twentieth of its tokens
        is held out: k-means sees the others, and the codec is fitted on the
        residuals of the held-out ones alone.
        """
        n_docs, n_tokens = tokens.agg(F.count_distinct("pid"), F.count("*")).first()
        picked = batches.sample(tokens.select("pid").distinct(), "pid", vectors.sample_size(n_tokens, n_docs), seed)
        rows = tokens.join(picked, "pid", "left_semi")
        out = residual.held_out(rows)
        seen = rows.join(out.select("pid", "pos"), ["pid", "pos"], "left_anti")
        k = min(vectors.partitions(n_docs, n_tokens / n_docs, coef), max(1, seen.count()))
        centroids = residual.train(seen, k, rounds, seed)
        codec = residual.codec(residual.residuals(residual.assign(out, centroids)), nbits)
        return cls.build(tokens, centroids, codec)

    @property
    def centroids(self) -> DataFrame:
        return self.tables.all("centroids")

    @property
    def codec(self) -> DataFrame:
        return self.tables.all("codec")

    @property
    def codes(self) -> DataFrame:
        return self.tables.all("codes")

    def append(self, tokens: DataFrame) -> ResidualIndex:
        """Codes of further documents under the same centroids and codec."""
        if not corpus.overlap(self.codes, tokens, "pid").isEmpty():
            raise ValueError("some documents are in the index already")
        return replace(self, tables=self.tables.grown(**_coded(tokens, self.centroids, self.codec)))

    def reset(self) -> ResidualIndex:
        """Without documents; centroids and codec stay."""
        return replace(self, tables=self.tables.emptied("codes", "ivf", "cuts"))

    def save(self, path: str) -> ResidualIndex:
        keys = {"centroids": "", "codec": "", "codes": "pid", "ivf": "slot", "cuts": ""}
        return replace(self, tables=self.tables.saved(self.codes.sparkSession, path, keys, {"kind": "residual"}))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ResidualIndex:
        return cls(_home(spark, path, "residual"))

    def stages(self, queries: DataFrame, ncells: int = 4, threshold: float = 0.45, ndocs: int = 1000) -> tuple[DataFrame, DataFrame]:
        """Both filter stages, (qid, pid, score, rank).

        Only the buckets of probed cells are read of the postings, and codes
        meet the documents found there by their own buckets.
        """
        cells = stored(residual.best_cells(queries, self.centroids, ncells))
        asked = search.slots(cells, self.tables.all("cuts"), "cid")
        postings = _only(self.tables.parts("ivf"), "slot", _literal(asked.select("slot")))
        met = _joined(postings, search.small(asked), "slot").select("qid", F.explode("pids").alias("pid"))
        pairs = met.filter(F.col("pid") != F.col("qid")).distinct()
        docs = _joined([p.select("pid", "cids") for p in self.tables.parts("codes")], search.wanted(pairs, queries), "pid")
        return residual.filtered(queries, self.centroids, docs, threshold, ndocs)

    def search(self, queries: DataFrame, k: int, ncells: int = 4, threshold: float = 0.45, ndocs: int = 1000, decimals: int = 6) -> DataFrame:
        """(qid, pid, score, rank). Only what survives both filters is decompressed."""
        pairs = stored(self.stages(queries, ncells, threshold, ndocs)[1].select("qid", "pid"))
        few = pairs.limit(LITERALS + 1).collect()
        if len(few) <= LITERALS:
            pairs = pairs.sparkSession.createDataFrame(few, "qid bigint, pid bigint")
        asked = search.wanted(pairs, queries)
        parts = _only(self.tables.parts("codes"), "pid", sorted({r.pid for r in few}) if len(few) <= LITERALS else None)
        found = residual.decompress(_joined(parts, asked, "pid"), self.centroids, self.codec, ("wanted",))
        scores = search.rerank_packed(found, queries, True, decimals)
        return search.top_k(scores, k, ["qid"], F.desc("score"), F.asc("pid"))


def _coded(tokens: DataFrame, centroids: DataFrame, codec: DataFrame) -> dict[str, DataFrame]:
    # Postings count, cut and group the codes; vectors meet the centroids once for all of that.
    codes = stored(residual.by_document(residual.compress(residual.residuals(residual.assign(tokens, centroids)), codec)))
    ivf, cuts = residual.cells(codes.select("pid", F.explode(F.array_distinct("cids")).alias("cid")))
    return {"codes": codes, "ivf": ivf, "cuts": cuts}

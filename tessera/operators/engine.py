"""From texts to hits: encoders, score functions by name, and evaluation.

An encoder turns texts into token vectors; a model goes here. ``HashEncoder``
needs none: a word's vector is made of its hashes, so equal words have equal
vectors and texts that share words come out near.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.functions import subwords
from tessera.functions import text as T
from tessera.functions.vectors import l2_normalize
from tessera.operators import batches, corpus, index, metrics, pruning, search
from tessera.sources import files

Score = Callable[[DataFrame, DataFrame], DataFrame]


class Encoder(Protocol):
    """Token vectors of queries (qid, qpos, token_id, vec) and passages (pid, pos, token_id, vec)."""

    def encode_queries(self, queries: DataFrame) -> DataFrame: ...

    def encode_passages(self, passages: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class HashEncoder:
    dim: int = 32
    vocabulary: int = 1 << 20
    query_marker: str | None = None
    doc_marker: str | None = None
    mask_punctuation: bool = True

    def _tokens(self, rows: DataFrame, key: str, marker: str | None) -> DataFrame:
        words = T.words(F.lower(T.with_marker(F.coalesce("text", F.lit("")), marker)))
        found = rows.select(key, F.posexplode(words).alias("pos", "token"))
        if self.mask_punctuation:
            found = found.filter(T.token_mask(F.col("token")))
        parts = F.array(*[(F.xxhash64(F.lit(i), "token") / float(1 << 63)) for i in range(self.dim)])
        token_id = F.pmod(F.xxhash64("token"), F.lit(self.vocabulary))
        return found.select(key, F.col("pos").cast("bigint").alias("pos"), token_id.alias("token_id"), l2_normalize(parts).alias("vec"))

    def encode_queries(self, queries: DataFrame) -> DataFrame:
        return self._tokens(queries, "qid", self.query_marker).withColumnRenamed("pos", "qpos")

    def encode_passages(self, passages: DataFrame) -> DataFrame:
        return self._tokens(passages, "pid", self.doc_marker)


SCORES: dict[str, Score] = {}


def score_function(name: str) -> Callable[[Score], Score]:
    """Registers (queries, tokens) -> (qid, pid, score) under a name."""

    def put(f: Score) -> Score:
        if name in SCORES:
            raise ValueError(f"{name} is registered already")
        SCORES[name] = f
        return f

    return put


score_function("maxsim")(search.exact_scores)
score_function("maxsim_floor")(lambda q, t: search.exact_scores(q, t, floor_zero=True))
score_function("lexical")(search.lexical)
score_function("first")(lambda q, t: search.single_vector(q.filter("qpos = 0"), t.filter("pos = 0")))


@dataclass(frozen=True)
class Processor:
    """The tables of a data set in one folder; later files win where ids repeat."""

    spark: SparkSession
    path: str

    def passages(self) -> DataFrame:
        return files.read_passages(self.spark, f"{self.path}/collection.tsv")

    def queries(self, *names: str) -> DataFrame:
        first, *others = [files.read_queries(self.spark, f"{self.path}/{n}") for n in names or ("queries.tsv",)]
        for more in others:
            first = corpus.merged(first, more, "qid", "text")
        return first

    def triples(self) -> DataFrame:
        return corpus.triple_texts(files.read_triples(self.spark, f"{self.path}/train_triples.tsv"), self.queries(), self.passages())

    def qrels(self) -> DataFrame:
        return files.read_qrels(self.spark, f"{self.path}/dev_qrels.tsv")

    def examples(self, mode: str) -> DataFrame:
        """Texts to train on (query, positive, negative) or to validate on (query, passage), with their ids."""
        if mode == "train":
            return self.triples()
        if mode != "val":
            raise ValueError(f"a mode is train or val, not {mode}")
        passages = self.passages().withColumnRenamed("text", "passage")
        return corpus.pair_texts(self.qrels(), self.queries().withColumnRenamed("text", "query"), passages)


@dataclass(frozen=True)
class Engine:
    """What the knobs of ``Settings`` do: tokenizers, batches, pruning, indexes and searches."""

    settings: Settings = Settings()
    vocabulary: str = ""

    def tokenizer(self, side: str) -> subwords.Tokenizer:
        """That of ``query`` or ``doc`` texts: marker, special tokens, and padding to the longest query if asked for."""
        x = self.settings
        if side == "query":
            longest = x.query_max_length if x.query_pad else x.max_length
            return subwords.Tokenizer(self.vocabulary, longest=longest, marker=x.query_marker, special=x.add_cls, pad=x.query_pad)
        return subwords.Tokenizer(self.vocabulary, longest=x.max_length, marker=x.doc_marker, special=x.add_cls)

    def encoder(self, dim: int = 32) -> HashEncoder:
        """The stand-in for a model, with this engine's markers and punctuation mask."""
        x = self.settings
        return HashEncoder(dim, query_marker=x.query_marker, doc_marker=x.doc_marker, mask_punctuation=x.mask_punctuation)

    def tokenized(self, examples: DataFrame, batch_size: int, mode: str, key: str, seed: int = 0) -> DataFrame:
        """Whole batches of examples, each text column as ids padded to the longest of its batch; training is shuffled, validation in order of ``key``.

        ``batch`` numbers them; as in training loops a short last batch goes.
        """
        order = F.xxhash64(F.lit(seed), key) if mode == "train" else F.col(key)
        rows = batches.ordered_batches(examples.withColumn("__order", order), batch_size, "__order").drop("__order")
        for name in [c for c in ("query", "positive", "negative", "passage") if c in examples.columns]:
            tokenizer = self.tokenizer("query" if name == "query" else "doc")
            rows = rows.withColumn(name, tokenizer.encode(tokenizer.words(F.col(name)))["input_ids"])
            rows = batches.padded(rows, ["batch"], name, tokenizer.pad_id)
        return rows

    def labels(self, word_ids: Column, tags: Column, vocabulary: tuple[str, ...] = T.NER_TAGS) -> Column:
        """Labels by word ids, binary when ``kept_tags`` says which count."""
        x = self.settings
        found = subwords.aligned(word_ids, T.with_marker_tag(tags, x.doc_marker, vocabulary[0]), vocabulary, x.first_token_only, x.ignore_label)
        return F.transform(found, lambda l: T.binary_labels(l, x.kept_tags, x.ignore_label)) if x.kept_tags else found

    def kept_tokens(self, encoded: DataFrame) -> DataFrame:
        """Tokens with a weight that stay in an index."""
        return pruning.keyword(encoded, self.settings.keyword_threshold, self.settings.apply_weight)

    def flat(self, tokens: DataFrame) -> index.FlatIndex:
        return index.FlatIndex.build(self.kept_tokens(tokens) if "weight" in tokens.columns else tokens)

    def residual(self, tokens: DataFrame) -> index.ResidualIndex:
        return index.ResidualIndex.train(tokens, self.settings.nbits, self.settings.partitions_coef)

    def search(self, found: index.FlatIndex | index.ResidualIndex | index.LexicalIndex, queries: DataFrame) -> DataFrame:
        """(qid, pid, score, rank) of the best ``top_k``."""
        x = self.settings
        if isinstance(found, index.ResidualIndex):
            return found.search(queries, x.top_k, x.ncells, x.centroid_score_threshold, x.ndocs)
        return found.search(queries, x.top_k, x.top_k_tokens) if isinstance(found, index.FlatIndex) else found.search(queries, x.top_k)

    def metrics(self, hits: DataFrame, qrels: DataFrame) -> DataFrame:
        return metrics.evaluate(hits, qrels, list(self.settings.ks))


def retrieve(encoder: Encoder, queries: DataFrame, passages: DataFrame, k: int, score: str = "maxsim") -> DataFrame:
    """(qid, pid, score, rank) from texts; a query may share its id with a passage only if they are the same."""
    scores = SCORES[score](encoder.encode_queries(queries), encoder.encode_passages(passages))
    return search.top_k(scores, k, ["qid"], F.desc("score"), F.asc("pid"))


def evaluate(encoder: Encoder, queries: DataFrame, passages: DataFrame, qrels: DataFrame, ks: list[int], names: list[str]) -> DataFrame:
    """(fn, k, metrics) of each named score function, over the queries that have a relevant passage."""
    asked, out = corpus.evaluable(queries, qrels), None
    for name in names:
        hits = retrieve(encoder, asked, passages, max(ks), name)
        one = metrics.evaluate(hits, qrels, ks).select(F.lit(name).alias("fn"), "*")
        out = one if out is None else out.unionByName(one)
    return out

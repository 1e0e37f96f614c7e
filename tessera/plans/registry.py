"""All queries of the retrieval engine by name, with their SQL twins."""

from __future__ import annotations

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import subwords as W
from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import batches, corpus, heads, losses, metrics, pruning, residual, search
from tessera.operators.index import FlatIndex, LexicalIndex, ResidualIndex, VectorIndex
from tessera.operators.store import scratch, stored
from tessera.plans import views

_QUERIES: dict = {}
_SQL: dict[str, str] = {}



def _query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, and its SQL."""

    def put(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = f"WITH RECURSIVE {views.SQL.strip()}{sql}" if sql.lstrip().startswith(",") else f"WITH RECURSIVE {views.SQL.strip()}\n{sql}"
        return f

    return put


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _top(df: DataFrame, k: int = 10) -> DataFrame:
    return search.top_k(df, k, ["qid"], F.desc("score"), F.asc("pid"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return _top(search.exact_scores(views.q_tok(spark, d), views.token_vecs(spark, d), k=50), 50)


_RANKED = "SELECT qid, pid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM {} QUALIFY rank <= 10"


# Search ---------------------------------------------------------------------


@_query("SELECT * FROM top WHERE rank <= 10")
def maxsim_exact_topk(spark, d):
    return _top(search.exact_scores(views.q_tok(spark, d), views.token_vecs(spark, d), k=10))


@_query(", s AS (SELECT qid, pid, round(sum(greatest(best, 0)), 6) AS score FROM best GROUP BY ALL) " + _RANKED.format("s"))
def maxsim_floor_topk(spark, d):
    return _top(search.exact_scores(views.q_tok(spark, d), views.token_vecs(spark, d), floor_zero=True, k=10))


@_query(
    """, b AS (SELECT qid, qpos, pid, max(CASE WHEN valid THEN sim ELSE 0 END) AS best FROM sims JOIN weights USING (pid, pos) GROUP BY ALL)
    SELECT qid, pid, round(avg(best), 6) AS score FROM b GROUP BY ALL"""
)
def maxsim_masked_mean(spark, d):
    t = views.weighted_tokens(spark, d)
    return search.masked_maxsim(views.q_tok(spark, d), t, F.col("valid"))


@_query(
    """, b AS (SELECT qid, qpos, pid, max(sim * weight) AS best FROM sims JOIN weights USING (pid, pos) GROUP BY ALL)
    SELECT qid, pid, round(sum(best), 6) AS score FROM b GROUP BY ALL"""
)
def maxsim_weighted(spark, d):
    t = views.weighted_tokens(spark, d).withColumn("vec", V.weighted("vec", "weight"))
    return search.exact_scores(views.q_tok(spark, d), t)


@_query("SELECT qid, qpos, pid, arg_max(pos, (round(sim, 6), -pos)) AS pos FROM sims GROUP BY ALL")
def maxsim_argmax(spark, d):
    return search.best_positions(views.q_tok(spark, d), views.token_vecs(spark, d))


_KNN = """, knn AS (SELECT qid, qpos, pid, pos, round(sim, 6) AS sim,
    row_number() OVER (PARTITION BY qid, qpos ORDER BY round(sim, 6) DESC, pid, pos) AS rank FROM sims QUALIFY rank <= 20) """


@_query(_KNN + "SELECT * FROM knn")
def token_knn_topk(spark, d):
    return search.token_neighbours(views.q_tok(spark, d), views.token_vecs(spark, d), 20)


@_query(_KNN + "SELECT DISTINCT qid, pid FROM knn")
def candidate_docs(spark, d):
    return search.candidates(token_knn_topk(spark, d))


@_query(_KNN + ", s AS (SELECT * FROM exact SEMI JOIN knn USING (qid, pid)) " + _RANKED.format("s"))
def retrieve_rerank(spark, d):
    q, t = views.q_tok(spark, d), views.token_vecs(spark, d)
    return _top(search.rerank(search.candidates(search.token_neighbours(q, t, 20)), q, t))


_CLS = ", cls AS (SELECT qid, pid, round(sim, 6) AS score FROM sims WHERE qpos = 0 AND pos = 0)"


@_query(_CLS + _RANKED.format("cls"))
def biencoder_topk(spark, d):
    return _top(_cls(spark, d, 10))


def _cls(spark, d, k=None):
    return search.single_vector(views.q_tok(spark, d).filter("qpos = 0"), views.token_vecs(spark, d).filter("pos = 0"), k=k)


_TOK = """, lb AS (SELECT qid, qpos, pid, greatest(max(list_dot_product(q.vec, tv.vec)), 0) AS best FROM q JOIN tv USING (token_id) WHERE pid <> qid GROUP BY ALL),
tok AS (SELECT qid, pid, round(sum(best), 6) AS score FROM lb GROUP BY ALL)"""


@_query(_TOK + "SELECT * FROM tok")
def coil_token_score(spark, d):
    return search.lexical(views.q_tok(spark, d), views.token_vecs(spark, d))


@_query(_TOK + _CLS + ", f AS (SELECT qid, pid, round(coalesce(tok.score, 0) + cls.score, 6) AS score FROM cls LEFT JOIN tok USING (qid, pid)) " + _RANKED.format("f"))
def coil_full_topk(spark, d):
    q, t = views.q_tok(spark, d), views.token_vecs(spark, d)
    return _top(search.lexical_best(q, t, 10, (q.filter("qpos = 0"), t.filter("pos = 0"))))


def _experts(rows: DataFrame, k: int) -> DataFrame:
    """The token's own expert and, for k = 2, the next; weights from components."""
    weight = lambda i: V.router(F.col("vec")[i] * 4 + 1)
    all_ = F.array(*[F.struct(((F.col("token_id") + i) % 10).cast("int").alias("expert_id"), weight(i).alias("weight")) for i in range(k)])
    return rows.withColumn("e", F.explode(all_)).select(*rows.columns, "e.expert_id", "e.weight")


_EXPERTS = """, qe AS (SELECT qid, qpos, vec, token_id AS expert_id, ln(1 + greatest(vec[1] * 4 + 1, 0)) AS weight FROM q),
de AS (SELECT pid, pos, vec, (token_id + i) % 10 AS expert_id, ln(1 + greatest(vec[i + 1] * 4 + 1, 0)) AS weight FROM tv, (SELECT unnest([0, 1]) AS i)),
eb AS (SELECT qid, qpos, pid, qe.expert_id, greatest(max(list_dot_product(qe.vec, de.vec) * qe.weight * de.weight), 0) AS best
       FROM qe JOIN de ON qe.expert_id = de.expert_id AND pid <> qid GROUP BY ALL),
es AS (SELECT qid, pid, round(sum(best), 6) AS score FROM eb GROUP BY ALL) """


@_query(_EXPERTS + _RANKED.format("es"))
def citadel_score_topk(spark, d):
    return _top(search.routed(_experts(views.q_tok(spark, d), 1), _experts(views.token_vecs(spark, d), 2), k=10))


@_query("SELECT pid, token_id AS vocab_id, round(max(ln(1 + greatest(vec[1], 0))), 6) AS weight FROM tv GROUP BY ALL")
def router_pooling(spark, d):
    t = views.token_vecs(spark, d)
    return t.groupBy("pid", F.col("token_id").alias("vocab_id")).agg(F.round(F.max(V.router(F.col("vec")[0])), 6).alias("weight"))


# Pruning --------------------------------------------------------------------


@_query("SELECT pid, pos, round(weight, 6) AS weight FROM weights WHERE weight >= 0.5")
def prune_keyword(spark, d):
    return pruning.keyword(views.weighted_tokens(spark, d), 0.5).select("pid", "pos", F.round("weight", 6).alias("weight"))


@_query("SELECT pid, pos FROM (SELECT *, count(*) FILTER (valid) OVER (PARTITION BY pid) AS n FROM weights) WHERE valid AND pos < floor(n * 0.5)")
def prune_first_tokens(spark, d):
    return pruning.first_tokens(views.weighted_tokens(spark, d), 0.5).select("pid", "pos")


_MEAN = """, parts AS (SELECT pid, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM weights WHERE valid),
means AS (SELECT pid, list(x ORDER BY dim) AS mean FROM (SELECT pid, dim, avg(x) AS x FROM parts GROUP BY ALL) GROUP BY pid)"""


@_query(
    _MEAN
    + """, sc AS (SELECT pid, pos, round(list_dot_product(vec, mean), 6) AS attention, count(*) OVER (PARTITION BY pid) AS n FROM weights JOIN means USING (pid) WHERE valid)
    SELECT pid, pos, attention FROM sc QUALIFY row_number() OVER (PARTITION BY pid ORDER BY attention DESC, pos) <= greatest(floor(n * 0.5), 1)"""
)
def prune_top_attention(spark, d):
    return pruning.top_attention(views.weighted_tokens(spark, d), 0.5).select("pid", "pos", "attention")


@_query(_MEAN + "SELECT pid, dim - 1 AS dim, round(mean[dim], 6) AS x FROM (SELECT pid, mean, unnest(generate_series(1, len(mean))) AS dim FROM means)")
def doc_means(spark, d):
    parts = pruning.doc_means(views.weighted_tokens(spark, d)).select("pid", F.posexplode("mean").alias("dim", "x"))
    return parts.select("pid", F.col("dim").cast("bigint").alias("dim"), F.round("x", 6).alias("x"))


_IDF = """, n AS (SELECT count(DISTINCT pid) AS total FROM tv), dfs AS (SELECT token_id, count(DISTINCT pid) AS df FROM tv GROUP BY ALL),
idf AS (SELECT token_id, df, round(ln(total / df), 6) AS idf FROM dfs, n)"""


@_query(_IDF + "SELECT * FROM idf")
def token_idf(spark, d):
    return pruning.token_idf(views.token_vecs(spark, d))


@_query(
    _IDF
    + """, r AS (SELECT pid, pos, idf, row_number() OVER (PARTITION BY pid ORDER BY idf DESC, pos) AS place, count(*) OVER (PARTITION BY pid) AS n
    FROM weights JOIN idf USING (token_id) WHERE valid) SELECT pid, pos, idf FROM r WHERE place <= floor(n * 0.5) OR pos = 0"""
)
def prune_top_idf(spark, d):
    return pruning.top_idf(views.weighted_tokens(spark, d), 0.5).select("pid", "pos", "idf")


@_query("SELECT pid, count(*) AS n FROM tv GROUP BY pid")
def doc_lengths(spark, d):
    return views.token_vecs(spark, d).groupBy("pid").agg(F.count("*").alias("n"))


@_query("SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM (SELECT vec_id, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-12)) AS v FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 3) AS e FROM embeddings))")
def normalize_vectors(spark, d):
    v = views.table(spark, d, "embeddings").select("vec_id", V.weighted(V.as_double("embedding"), F.lit(3.0)).alias("e"))
    return v.select("vec_id", F.round(V.norm(V.l2_normalize("e")), 6).alias("norm"))


# Residual index -------------------------------------------------------------


def _assigned(spark, d):
    return residual.assign(views.token_vecs(spark, d), views.centroids(spark, d))


@_query("SELECT pid, pos, cid FROM assigned")
def plaid_assign(spark, d):
    return _assigned(spark, d).select("pid", "pos", "cid")


_RES = """, res AS (SELECT pid, pos, cid, centroid, list_transform(list_zip(vec, centroid), lambda p: p[1] - p[2]) AS r FROM assigned),
flat AS (SELECT unnest(r) AS x FROM res), codec AS (SELECT quantile_cont(x, [0.25, 0.5, 0.75]) AS cuts, quantile_cont(x, [0.125, 0.375, 0.625, 0.875]) AS w, avg(abs(x)) AS mean_residual FROM flat),
codes AS (SELECT pid, pos, cid, centroid, list_transform(r, lambda x: len(list_filter(cuts, lambda c: c < x))) AS buckets FROM res, codec)"""


@_query(_RES + "SELECT round(cuts[1], 6) AS c1, round(cuts[2], 6) AS c2, round(cuts[3], 6) AS c3, round(w[1], 6) AS w1, round(w[4], 6) AS w4, round(mean_residual, 6) AS mean_residual FROM codec")
def plaid_residual_quantiles(spark, d):
    c = residual.codec(residual.residuals(_assigned(spark, d)), 2)
    r = lambda x, n: F.round(x, 6).alias(n)
    cuts, w = F.col("cutoffs"), F.col("weights")
    return c.select(r(cuts[0], "c1"), r(cuts[1], "c2"), r(cuts[2], "c3"), r(w[0], "w1"), r(w[3], "w4"), r("mean_residual", "mean_residual"))


def _codes(spark, d):
    rest = residual.residuals(stored(_assigned(spark, d)))
    codec = residual.codec(rest, 2)
    return residual.compress(rest, codec), codec


@_query(_RES + "SELECT pid, pos, cid, array_to_string(buckets, '') AS buckets FROM codes")
def plaid_bucketize(spark, d):
    rest = residual.residuals(_assigned(spark, d))
    cuts = F.array(*[F.lit(x) for x in residual.codec(rest, 2).first().cutoffs])
    buckets = F.transform("residual", lambda x: V.bucketize(x, cuts))
    return rest.select("pid", "pos", "cid", F.array_join(buckets.cast("array<string>"), "").alias("buckets"))


@_query(
    _RES
    + """, bits AS (SELECT pid, pos, flatten(list_transform(buckets, lambda b: [b & 1, (b >> 1) & 1])) AS bits FROM codes)
    SELECT pid, pos, array_to_string(list_transform(generate_series(1, len(bits), 8), lambda i: bits[i]*128 + bits[i+1]*64 + bits[i+2]*32 + bits[i+3]*16 + bits[i+4]*8 + bits[i+5]*4 + bits[i+6]*2 + bits[i+7]), ',') AS packed,
    true AS same FROM bits"""
)
def plaid_pack_bits(spark, d):
    """The bytes of the stored codes, and whether they say the buckets again."""
    codes, codec = _codes(spark, d)
    byte = F.transform(F.sequence(F.lit(1), F.octet_length("packed")), lambda i: F.conv(F.hex(F.substring(F.col("packed"), i, F.lit(1))), 16, 10).cast("int"))
    rest, cuts = residual.residuals(_assigned(spark, d)), F.array(*[F.lit(x) for x in codec.first().cutoffs])
    buckets = rest.select("pid", "pos", F.transform("residual", lambda x: V.bucketize(x, cuts)).alias("buckets"))
    both = codes.select("pid", "pos", byte.alias("packed")).join(buckets, ["pid", "pos"])
    return both.select("pid", "pos", F.array_join(F.col("packed").cast("array<string>"), ",").alias("packed"), (V.unpack_buckets(F.col("packed"), 2) == F.col("buckets")).alias("same"))


@_query("SELECT cid, pid FROM ivf")
def plaid_ivf(spark, d):
    return residual.inverted(_assigned(spark, d))


@_query("SELECT cid, count(pos) AS n FROM cents LEFT JOIN assigned USING (cid) GROUP BY cid")
def plaid_cell_sizes(spark, d):
    return residual.cell_sizes(_assigned(spark, d), views.centroids(spark, d))


@_query("SELECT * FROM probed")
def plaid_probe(spark, d):
    scores = residual.centroid_scores(views.q_tok(spark, d), views.centroids(spark, d))
    return residual.probe(scores, residual.inverted(_assigned(spark, d)), 2)


def _stage(name: str, pairs: str, scores: str) -> str:
    return f""", {name}g AS (SELECT qid, pid, qpos FROM {pairs} JOIN (SELECT DISTINCT qid, qpos FROM cscores) USING (qid)),
    {name}b AS (SELECT qid, qpos, pid, max(sim) AS best FROM {pairs} JOIN ivf USING (pid) JOIN {scores} USING (qid, cid) GROUP BY ALL),
    {name}s AS (SELECT qid, pid, round(sum(coalesce(best, -9999)), 6) AS score FROM {name}g LEFT JOIN {name}b USING (qid, qpos, pid) GROUP BY ALL)"""


def _pick(name: str, k: int) -> str:
    return f"SELECT qid, pid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid DESC) AS rank FROM {name}s QUALIFY rank <= {k}"


def _one(threshold: float) -> str:
    return f", passing AS (SELECT qid, qpos, cid, sim FROM cscores QUALIFY max(sim) OVER (PARTITION BY qid, cid) >= {threshold})" + _stage("one_", "probed", "passing") + f", one AS ({_pick('one_', 40)})"


_TWO = _one(0.2) + _stage("two_", "one", "cscores") + f", two AS ({_pick('two_', 10)})"


def _cascade(spark, d, threshold=0.2):
    entry = F.array_sort(F.collect_list(F.struct("pos", "cid")))
    codes = stored(_assigned(spark, d).groupBy("pid").agg(entry.alias("e")).select("pid", F.col("e.cid").alias("cids")))
    ivf = codes.select("pid", F.explode(F.array_distinct("cids")).alias("cid"))
    return residual.cascade(views.q_tok(spark, d), views.centroids(spark, d), ivf, codes, 2, threshold, 40)


@_query(_one(0.2) + "SELECT * FROM one")
def plaid_stage1(spark, d):
    return _cascade(spark, d)[0]


@_query(_one(0.45) + "SELECT * FROM one")
def plaid_stage1_sentinel(spark, d):
    return _cascade(spark, d, 0.45)[0]


@_query(_TWO + "SELECT * FROM two")
def plaid_stage2(spark, d):
    return _cascade(spark, d)[1]


_FINAL = (
    _RES
    + _TWO
    + """, raw AS (SELECT pid, pos, list_transform(list_zip(centroid, buckets), lambda p: p[1] + w[(p[2] + 1)::BIGINT]) AS raw FROM codes, codec),
    dec AS (SELECT pid, pos, list_transform(raw, lambda x: x / greatest(sqrt(list_dot_product(raw, raw)), 1e-12)) AS vec FROM raw),
    fb AS (SELECT two.qid, qpos, two.pid, greatest(max(list_dot_product(q.vec, dec.vec)), 0) AS best FROM two JOIN dec USING (pid) JOIN q ON two.qid = q.qid GROUP BY ALL),
    fs AS (SELECT qid, pid, round(sum(best), 5) AS score FROM fb GROUP BY ALL) SELECT * FROM fs"""
)


@_query(_FINAL)
def plaid_decompress_score(spark, d):
    pairs = _cascade(spark, d)[1]
    codes, codec = _codes(spark, d)
    some = residual.by_document(codes.join(F.broadcast(pairs.select("pid").distinct()), "pid", "left_semi"))
    return residual.final_scores(pairs, views.q_tok(spark, d), residual.decompress(some, views.centroids(spark, d), codec), decimals=5)


def _lloyd(rounds: int) -> str:
    """Rounds of k-means one after another, as (cid, c) from the last."""
    out = ", l0 AS (SELECT cid, vec AS c FROM cents)"
    for i in range(1, rounds + 1):
        out += f""", n{i} AS (SELECT pid, pos, vec, cid FROM tv, l{i - 1} QUALIFY row_number() OVER (PARTITION BY pid, pos ORDER BY round(list_dot_product(vec, c) - list_dot_product(c, c) / 2, 6) DESC, cid) = 1),
        m{i} AS (SELECT cid, list(x ORDER BY dim) AS c FROM (SELECT cid, dim, avg(x) AS x FROM (SELECT cid, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM n{i}) GROUP BY ALL) GROUP BY cid),
        l{i} AS (SELECT o.cid, coalesce(m{i}.c, o.c) AS c FROM l{i - 1} o LEFT JOIN m{i} USING (cid))"""
    return out


@_query(_lloyd(3) + " SELECT cid, dim - 1 AS dim, round(c[dim] / sqrt(list_dot_product(c, c)), 5) AS x FROM (SELECT cid, c, unnest(generate_series(1, len(c))) AS dim FROM l3)")
def plaid_kmeans_train(spark, d):
    found = residual.lloyd(views.token_vecs(spark, d), views.centroids(spark, d), rounds=3).select("cid", F.posexplode("vec").alias("dim", "x"))
    return found.select("cid", F.col("dim").cast("bigint").alias("dim"), F.round("x", 5).alias("x"))


# Metrics --------------------------------------------------------------------

_METRICS = """, need AS (SELECT qid, count(*) AS relevant FROM qrels GROUP BY qid),
judged AS (SELECT need.qid, relevant, rank, CASE WHEN qrels.pid IS NULL THEN 0 ELSE 1 END AS rel FROM need LEFT JOIN top ON need.qid = top.qid LEFT JOIN qrels ON qrels.qid = top.qid AND qrels.pid = top.pid),
cum AS (SELECT *, sum(rel) OVER (PARTITION BY qid ORDER BY rank) AS seen FROM judged),
cuts AS (SELECT *, unnest([1, 3, 5, 10, 50]::BIGINT[]) AS k FROM cum),
pq AS (SELECT qid, relevant, k, coalesce(sum(rel) FILTER (rank <= k), 0) AS found, coalesce(1 / min(rank) FILTER (rel = 1 AND rank <= k), 0) AS mrr,
  coalesce(sum(1 / log2(rank + 1)) FILTER (rel = 1 AND rank <= k), 0) AS dcg, coalesce(sum(seen / rank) FILTER (rel = 1 AND rank <= k), 0) AS ap,
  list_sum(list_transform(generate_series(1, least(relevant, k)), lambda i: 1 / log2(i + 1))) AS ideal FROM cuts GROUP BY ALL) """


def _metric(spark, d, *names):
    return metrics.evaluate(_hits(spark, d), views.vec_qrels(spark, d), [1, 3, 5, 10, 50], names)


@_query(_METRICS + "SELECT k, round(avg((found > 0)::INT), 6) AS accuracy FROM pq GROUP BY k")
def metric_accuracy(spark, d):
    return _metric(spark, d, "accuracy")


@_query(_METRICS + "SELECT k, round(avg(found / k), 6) AS precision, round(avg(found / relevant), 6) AS recall FROM pq GROUP BY k")
def metric_precision_recall(spark, d):
    return _metric(spark, d, "precision", "recall")


@_query(_METRICS + "SELECT k, round(avg(mrr), 6) AS mrr FROM pq GROUP BY k")
def metric_mrr(spark, d):
    return _metric(spark, d, "mrr")


@_query(_METRICS + "SELECT k, round(avg(dcg / ideal), 6) AS ndcg FROM pq GROUP BY k")
def metric_ndcg(spark, d):
    return _metric(spark, d, "ndcg")


@_query(_METRICS + "SELECT k, round(avg(ap / least(k, relevant)), 6) AS map FROM pq GROUP BY k")
def metric_map(spark, d):
    return _metric(spark, d, "map")


# Texts, labels and batches --------------------------------------------------

_TEXT_QRELS = ", tq AS (SELECT item_id AS qid, doc_id AS pid FROM benchmark b JOIN documents t ON contains(t.text, b.text))"


@_query(_TEXT_QRELS + "SELECT qid, pid, b.text AS query, md5(t.text) AS passage FROM tq JOIN benchmark b ON b.item_id = qid JOIN documents t ON t.doc_id = pid")
def qrels_join(spark, d):
    items = views.table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    docs = views.table(spark, d, "documents").select(F.col("doc_id").alias("pid"), F.col("text").alias("passage"))
    return corpus.pair_texts(views.text_qrels(spark, d), items, docs).withColumn("passage", F.md5("passage"))


def _triples(spark, d):
    return corpus.next_other(views.text_qrels(spark, d), views.table(spark, d, "documents").select(F.col("doc_id").alias("pid")))


_TRIPLES = _TEXT_QRELS + """, tr AS (SELECT qid, tq.pid AS pos_pid, min(doc_id) AS neg_pid FROM tq JOIN documents ON doc_id > tq.pid
    WHERE NOT EXISTS (SELECT 1 FROM tq y WHERE y.qid = tq.qid AND y.pid = doc_id) GROUP BY ALL)"""


@_query(_TRIPLES + "SELECT qid, pos_pid, neg_pid, b.text AS query, md5(p.text) AS positive, md5(n.text) AS negative FROM tr JOIN benchmark b ON item_id = qid JOIN documents p ON p.doc_id = pos_pid JOIN documents n ON n.doc_id = neg_pid")
def triples_materialize(spark, d):
    items = views.table(spark, d, "benchmark").select("item_id", "text")
    docs = views.table(spark, d, "documents").select("doc_id", "text")
    found = corpus.triple_texts(_triples(spark, d), items, docs)
    return found.select("qid", "pos_pid", "neg_pid", "query", F.md5("positive").alias("positive"), F.md5("negative").alias("negative"))


def _words(table: str, key: str) -> str:
    split = r"list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '')"
    return f""", w AS (SELECT {key} AS doc, unnest({split}) AS word, generate_subscripts({split}, 1) - 1 AS idx FROM {table}),
pc AS (SELECT doc, idx, word, unnest(generate_series(0, (length(word) - 1) // 4)) AS sub FROM w),
toks AS (SELECT doc, idx AS word, sub, substr(word, sub * 4 + 1, 4) AS piece, length(substr(word, sub * 4 + 1, 4)) AS token_id, word AS source FROM pc)"""


_WORDS, _ASKED = _words("documents", "doc_id"), _words("benchmark", "item_id")


def _tokens(spark, d):
    """(doc, word, sub, piece, token_id, source): subwords of all documents, in one narrow pass."""
    docs = views.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(T.words(F.col("text"))).alias("word", "source"))
    cut = docs.select("doc", F.col("word").cast("bigint").alias("word"), "source", F.posexplode(T.pieces(F.col("source"))).alias("sub", "piece"))
    return cut.withColumns({"sub": F.col("sub").cast("bigint"), "token_id": F.char_length("piece").cast("bigint")})


@_query(_WORDS + "SELECT doc, word, sub, piece FROM toks")
def subwords(spark, d):
    return _tokens(spark, d).select("doc", "word", "sub", "piece")


def _labels(spark, d, tag, vocabulary):
    """Labels without a shuffle: the subword before one with ``sub`` > 0 is of the same word."""
    before = F.when(F.col("sub") > 0, F.col("word"))
    rows = _tokens(spark, d).withColumn("tag", T.tag_ids(tag, vocabulary))
    return rows.select("doc", "word", "sub", T.aligned_label(F.col("tag"), F.col("word"), before).cast("int").alias("label"))


@_query(_WORDS + "SELECT doc, word, sub, (CASE WHEN sub > 0 THEN -100 WHEN regexp_matches(source, '^[A-Z]') THEN 5 ELSE 0 END)::INTEGER AS label FROM toks")
def tag_align_ner(spark, d):
    return _labels(spark, d, F.when(F.col("source").rlike("^[A-Z]"), "B-PER").otherwise("O"), T.NER_TAGS)


@_query(_WORDS + "SELECT doc, word, sub, (CASE WHEN sub > 0 THEN -100 WHEN regexp_matches(source, '[0-9]') THEN 1 ELSE 0 END)::INTEGER AS label FROM toks")
def tag_align_pos(spark, d):
    rows = _labels(spark, d, F.when(F.col("source").rlike("[0-9]"), "M").otherwise("N"), T.POS_TAGS)
    return rows.withColumn("label", T.binary_labels(F.col("label"), (T.POS_TAGS.index("M"),)))


_IDS = ", ids AS (SELECT doc, list(token_id ORDER BY word, sub) AS ids FROM toks GROUP BY doc)"


def _ids(spark, d, table="documents", key="doc_id"):
    """(doc, ids): token ids of each text with a word, in one narrow pass."""
    ids = F.flatten(F.transform(T.words(F.col("text")), lambda w: F.transform(T.pieces(w), lambda p: F.char_length(p).cast("bigint"))))
    return views.table(spark, d, table).select(F.col(key).alias("doc"), ids.alias("ids")).filter(F.size("ids") > 0)


@_query(_KNN + _CLS + ", s AS (SELECT qid, pid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid DESC) AS rank FROM exact QUALIFY rank <= 10) SELECT * FROM s")
def chunked_topk(spark, d):
    return search.chunked_top_k(search.exact_scores(views.q_tok(spark, d), views.token_vecs(spark, d), k=10, falls=True), 10)


@_query("SELECT top.qid, top.pid, rank, md5(d.text) AS text FROM top LEFT JOIN documents d ON d.doc_id = top.pid WHERE rank <= 10")
def hit_passages(spark, d):
    passages = views.table(spark, d, "documents").select(F.col("doc_id").alias("pid"), "text")
    hits = _top(search.exact_scores(views.q_tok(spark, d), views.token_vecs(spark, d), k=10))
    return corpus.hit_texts(hits, passages).select("qid", "pid", "rank", F.md5("text").alias("text"))


@_query(
    """, b AS (SELECT qid, qpos, pid, max(sim) AS best FROM sims WHERE pid // 10 = qid // 10 GROUP BY ALL)
    SELECT qid, pid, round(avg(best), 6) AS score FROM b GROUP BY ALL"""
)
def in_batch_scores(spark, d):
    q = views.q_tok(spark, d).withColumn("batch", F.expr("qid div 10"))
    t = views.token_vecs(spark, d).select("pid", "pos", "vec", F.expr("pid div 10").alias("batch"))
    return search.in_batch(q, t, lambda sims: search.batch_maxsim(sims.filter("pid <> qid"), F.lit(True)))


@_query(
    """, qq AS (SELECT * FROM q WHERE qpos > 0 AND qpos < 9), b AS (SELECT qid, qpos, p.pid, max(CASE WHEN tv.token_id = qq.token_id THEN list_dot_product(qq.vec, tv.vec) ELSE 0 END) AS best
    FROM qq JOIN tv p ON p.pos = 0 JOIN tv ON tv.pid = p.pid GROUP BY ALL) SELECT qid, pid, round(sum(best), 6) AS score FROM b GROUP BY ALL"""
)
def coil_train_scores(spark, d):
    pack = lambda rows, key, order: rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "token_id", "vec"))).alias("t")).select(
        key, F.col("t.token_id").alias("ids"), F.transform("t", lambda x: F.lit(1)).alias("mask"), F.col("t.vec").alias("vecs"), F.lit(0).alias("batch")
    )
    return search.exact_match(pack(views.q_tok(spark, d), "qid", "qpos"), pack(views.token_vecs(spark, d), "pid", "pos"))


@_query("SELECT round(avg(score), 6) AS mean FROM exact")
def validation_mean(spark, d):
    return losses.validation_mean(search.exact_scores(views.q_tok(spark, d), views.token_vecs(spark, d)))


@_query(
    _WORDS
    + _IDS
    + """, bt AS (SELECT doc, ids, (row_number() OVER (ORDER BY doc) - 1) // 8 AS batch FROM ids)
    SELECT doc, batch, array_to_string(list_concat(ids, list_transform(generate_series(1, max(len(ids)) OVER (PARTITION BY batch) - len(ids)), lambda i: 0)), ',') AS ids FROM bt QUALIFY count(*) OVER (PARTITION BY batch) = 8"""
)
def pad_batch(spark, d):
    rows = batches.ordered_batches(_ids(spark, d), 8, "doc")
    out = batches.padded(rows, ["batch"], "ids", 0)
    return out.select("doc", "batch", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@_query(_ASKED + _IDS + "SELECT doc, array_to_string(list_concat(ids[1:32], list_transform(generate_series(1, 32 - len(ids[1:32])), lambda i: 0)), ',') AS ids FROM ids")
def query_pad_truncate(spark, d):
    out = _ids(spark, d, "benchmark", "item_id").select("doc", T.truncate_pad(F.col("ids"), 32, 0).alias("ids"))
    return out.select("doc", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@_query(
    _WORDS
    + """, bt AS (SELECT doc, (row_number() OVER (ORDER BY doc) - 1) // 100 AS batch FROM (SELECT DISTINCT doc FROM toks)),
    n AS (SELECT batch, token_id, row_number() OVER (PARTITION BY batch ORDER BY doc, word, sub) - 1 AS place FROM toks JOIN bt USING (doc))
    SELECT batch, place // 16 AS chunk, array_to_string(list(token_id ORDER BY place), ',') AS ids FROM n GROUP BY ALL HAVING count(*) = 16"""
)
def chunk_tokens(spark, d):
    out = batches.chunked(_ids(spark, d), 16, "doc", batch=100)
    return out.select("batch", "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def _share(*key: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('-', {', '.join(f'{k}::VARCHAR' for k in key)})), 1, 8))::UBIGINT / 4294967296.0)"


@_query(_WORDS + f"SELECT doc, word, sub, CASE WHEN {_share('0', 'doc', 'word')} < 0.2 THEN -1 ELSE token_id END AS token_id, CASE WHEN {_share('0', 'doc', 'word')} < 0.2 THEN token_id ELSE -100 END AS label FROM toks")
def whole_word_mask(spark, d):
    return batches.whole_word_mask(_tokens(spark, d)).select("doc", "word", "sub", F.col("token_id").cast("bigint").alias("token_id"), F.col("label").cast("bigint").alias("label"))


@_query(_WORDS + f"SELECT doc, word, sub, CASE WHEN {_share('0', 'doc', 'word', 'sub')} < 0.15 THEN -1 ELSE token_id END AS token_id, CASE WHEN {_share('0', 'doc', 'word', 'sub')} < 0.15 THEN token_id ELSE -100 END AS label FROM toks")
def token_mask(spark, d):
    return batches.token_mask(_tokens(spark, d)).select("doc", "word", "sub", F.col("token_id").cast("bigint").alias("token_id"), F.col("label").cast("bigint").alias("label"))


@_query(f"SELECT conv_id, turn FROM conversations WHERE {_share('3', 'conv_id')} < 0.1")
def split_held_out(spark, d):
    return batches.split(views.table(spark, d, "conversations"), "conv_id", 0.1, seed=3)[1].select("conv_id", "turn")


@_query(f"SELECT doc_id FROM documents ORDER BY {_share('1', 'doc_id')}, doc_id LIMIT 50")
def sample_passages(spark, d):
    return batches.sample(views.table(spark, d, "documents").select("doc_id"), "doc_id", 50, seed=1)


@_query("SELECT doc_id FROM documents SEMI JOIN labels USING (doc_id)")
def append_guard(spark, d):
    return corpus.overlap(views.table(spark, d, "documents"), views.table(spark, d, "labels"), "doc_id")


@_query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def dangling_ids(spark, d):
    return corpus.dangling(views.table(spark, d, "documents").select("doc_id"), views.table(spark, d, "labels"), "doc_id")


@_query("SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def keep_last(spark, d):
    return corpus.keep_last(views.table(spark, d, "conversations"), "conv_id", "text", "turn")


@_query(_TEXT_QRELS + "SELECT item_id AS qid FROM benchmark WHERE item_id IN (SELECT qid FROM tq)")
def evaluable_queries(spark, d):
    return corpus.evaluable(views.table(spark, d, "benchmark").select(F.col("item_id").alias("qid")), views.text_qrels(spark, d))


# Losses ---------------------------------------------------------------------

_PAIRS = """, rels AS (SELECT e.qid, e.pid, e.score / 10 AS score, CASE WHEN r.pid IS NULL THEN 0 ELSE 1 END AS rel FROM exact e LEFT JOIN qrels r ON e.qid = r.qid AND e.pid = r.pid),
negs AS (SELECT p.qid, p.pid, p.score AS pos_score, n.score AS neg_score FROM rels p JOIN rels n ON p.qid = n.qid AND p.rel = 1 AND n.rel = 0 AND n.pid > p.pid QUALIFY row_number() OVER (PARTITION BY p.qid, p.pid ORDER BY n.pid) = 1)"""


def _rels(spark, d):
    scores = search.judged_scores(views.q_tok(spark, d), views.token_vecs(spark, d))
    return scores.select("qid", "pid", (F.col("score") / 10).alias("score"), "rel")


def _positives(spark, d):
    return search.judged_positives(views.q_tok(spark, d), views.token_vecs(spark, d), divisor=10)


def _negs(spark, d):
    """Each positive with the next document that is none."""
    pairs = losses.next_negatives(_positives(spark, d)).filter("rel = 1 AND neg_score IS NOT NULL")
    return pairs.select("qid", "pid", F.col("score").alias("pos_score"), "neg_score")


@_query(_PAIRS + "SELECT round(avg(ln(1 + exp(neg_score - pos_score))), 6) AS loss FROM negs")
def loss_pairwise_ce(spark, d):
    return losses.pairwise_ce(_negs(spark, d))


@_query(_PAIRS + "SELECT round(avg(greatest(neg_score - pos_score, 0)), 6) AS loss FROM negs")
def loss_margin(spark, d):
    return losses.margin(_negs(spark, d))


@_query(_PAIRS + "SELECT round(avg((pos_score - 1) ** 2), 6) AS loss FROM negs")
def loss_pair_mse(spark, d):
    return losses.pair_mse(_negs(spark, d).withColumn("target", F.lit(1.0)), "target")


@_query(_PAIRS + "SELECT round(avg((pos_score > neg_score)::INT), 6) AS accuracy FROM negs")
def batch_accuracy(spark, d):
    return losses.batch_accuracy(_negs(spark, d))


_CE = "SELECT round(avg(ln(exp(p.score) + coalesce(rest, 0)) - p.score), 6) AS loss FROM {0} p LEFT JOIN (SELECT qid, sum(exp(score)) AS rest FROM {0} WHERE rel = 0 GROUP BY qid) USING (qid) WHERE rel = 1"


@_query(_PAIRS + _CE.format("rels"))
def loss_in_batch(spark, d):
    return losses.in_batch(_rels(spark, d))


_HARD = """, bt AS (SELECT qid, pid, score AS p FROM rels WHERE rel = 1), nb AS (SELECT qid, score AS n FROM rels WHERE rel = 0),
tops AS (SELECT qid, max(n) AS top, sum(n * n) AS squares FROM nb GROUP BY qid) """


@_query(
    _PAIRS
    + _HARD
    + """, z AS (SELECT bt.qid, pid, p, top, sqrt(p * p + squares) AS z FROM bt JOIN tops USING (qid)),
    a AS (SELECT sum((1 - p / z) ** 2) AS x FROM z WHERE p < top), b AS (SELECT sum((n / z) ** 2) AS x FROM z JOIN nb USING (qid) WHERE n > p)
    SELECT round(coalesce(a.x, 0) + coalesce(b.x, 0), 6) AS loss FROM a, b"""
)
def loss_query_normalized(spark, d):
    return losses.query_normalized(_rels(spark, d))


@_query(
    _PAIRS
    + """, dd AS (SELECT 1 - score AS d, rel FROM rels), bb AS (SELECT max(d) FILTER (rel = 1) AS pmax, min(d) FILTER (rel = 0) AS nmin FROM dd)
    SELECT round(sum(CASE WHEN rel = 1 AND d > nmin THEN d * d WHEN rel = 0 AND d < pmax THEN greatest(0.5 - d, 0) ** 2 ELSE 0 END), 6) AS loss FROM dd, bb"""
)
def loss_online_contrastive(spark, d):
    return losses.online_contrastive(_rels(spark, d))


@_query(
    _PAIRS
    + _HARD
    + """, a AS (SELECT sum((1 - p) ** 2) AS x FROM bt JOIN tops USING (qid) WHERE p < top), b AS (SELECT sum(n * n) AS x FROM bt JOIN nb USING (qid) WHERE n > p)
    SELECT round(coalesce(a.x, 0) + coalesce(b.x, 0), 6) AS loss FROM a, b"""
)
def loss_lexical_online(spark, d):
    return losses.lexical_online(_rels(spark, d))  # the scores are divided by the ten query tokens already


@_query(
    _PAIRS
    + _HARD
    + """, a AS (SELECT sum((top + 0.5 - p) ** 2) AS x FROM bt JOIN tops USING (qid) WHERE p < top), b AS (SELECT sum((p - 0.5 - n) ** 2) AS x FROM bt JOIN nb USING (qid) WHERE n > p)
    SELECT round(coalesce(a.x, 0) + coalesce(b.x, 0), 6) AS loss FROM a, b"""
)
def loss_lexical_dynamic(spark, d):
    return losses.lexical_dynamic(_rels(spark, d))


_ROUTER = """, lg AS (SELECT pid, pos, unnest(list_transform(vec, lambda x: x * 4)) AS x, generate_subscripts(vec, 1) - 1 AS expert_id FROM tv),
ex AS (SELECT pid, pos, expert_id, ln(1 + greatest(x, 0)) AS weight FROM lg QUALIFY row_number() OVER (PARTITION BY pid, pos ORDER BY ln(1 + greatest(x, 0)) DESC, expert_id) <= 5),
qx AS (SELECT pid AS qid, pos AS qpos, expert_id, weight FROM ex WHERE pid % 20 = 0 QUALIFY row_number() OVER (PARTITION BY pid, pos ORDER BY weight DESC, expert_id) = 1) """


@_query(_ROUTER + "SELECT pid, pos, expert_id, round(weight, 6) AS weight FROM ex")
def router_topk(spark, d):
    return _routes(views.token_vecs(spark, d), 5).select("pid", "pos", "expert_id", F.round("weight", 6).alias("weight"))


def _routes(rows: DataFrame, k: int) -> DataFrame:
    """Each token's ``k`` best experts, its components being the logits."""
    best = V.top_experts(V.weighted("vec", F.lit(4.0)), k)
    return rows.withColumn("e", F.explode(best)).select(*rows.columns, F.col("e.expert_id").cast("bigint").alias("expert_id"), "e.weight")


@_query(
    _ROUTER
    + """, rb AS (SELECT qid, qpos, ex.pid, qx.expert_id, greatest(max(list_dot_product(a.vec, b.vec) * qx.weight * ex.weight), 0) AS best
    FROM qx JOIN ex ON qx.expert_id = ex.expert_id AND ex.pid <> qid JOIN tv a ON a.pid = qid AND a.pos = qpos JOIN tv b ON b.pid = ex.pid AND b.pos = ex.pos GROUP BY ALL),
    rs AS (SELECT qid, pid, round(sum(best), 6) AS score FROM rb GROUP BY ALL) """
    + _RANKED.format("rs")
)
def citadel_routed_topk(spark, d):
    return _top(search.routed(_routes(views.q_tok(spark, d), 1), _routes(views.token_vecs(spark, d), 5), k=10))


@_query(
    _PAIRS
    + _HARD
    + _ROUTER
    + """, z AS (SELECT bt.qid, pid, p, top, sqrt(p * p + squares) AS z FROM bt JOIN tops USING (qid)),
    a AS (SELECT sum((1 - p / z) ** 2) AS x FROM z WHERE p < top), b AS (SELECT sum((n / z) ** 2) AS x FROM z JOIN nb USING (qid) WHERE n > p),
    pool AS (SELECT pid, expert_id, max(ln(1 + greatest(x, 0))) AS w FROM lg GROUP BY ALL), qpool AS (SELECT pid AS qid, expert_id, max(ln(1 + greatest(x, 0))) AS w FROM lg WHERE pid % 20 = 0 GROUP BY ALL),
    rr AS (SELECT qid, pool.pid, sum(qpool.w * pool.w) / 64 AS score FROM qpool JOIN pool USING (expert_id) WHERE pid <> qid GROUP BY ALL),
    rl AS (SELECT rr.qid, rr.pid, rr.score, rel FROM rr JOIN rels ON rels.qid = rr.qid AND rels.pid = rr.pid),
    rbt AS (SELECT qid, pid, score AS p FROM rl WHERE rel = 1), rnb AS (SELECT qid, score AS n FROM rl WHERE rel = 0), rtop AS (SELECT qid, max(n) AS top, sum(n * n) AS squares FROM rnb GROUP BY qid),
    rz AS (SELECT rbt.qid, pid, p, top, sqrt(p * p + squares) AS z FROM rbt JOIN rtop USING (qid)),
    ra AS (SELECT sum((1 - p / z) ** 2) AS x FROM rz WHERE p < top), rbb AS (SELECT sum((n / z) ** 2) AS x FROM rz JOIN rnb USING (qid) WHERE n > p),
    sm AS (SELECT pid, pos, expert_id, exp(x) / sum(exp(x)) OVER (PARTITION BY pid, pos) AS s FROM lg),
    ld AS (SELECT sm.expert_id, count(ex.weight) FILTER (ex.weight > 0) * sum(sm.s) AS load FROM sm LEFT JOIN ex ON ex.pid = sm.pid AND ex.pos = sm.pos AND ex.expert_id = sm.expert_id GROUP BY sm.expert_id),
    lq AS (SELECT sm.expert_id, count(qx.weight) FILTER (qx.weight > 0) * sum(sm.s) AS load FROM sm LEFT JOIN qx ON qx.qid = sm.pid AND qx.qpos = sm.pos AND qx.expert_id = sm.expert_id WHERE sm.pid % 20 = 0 GROUP BY sm.expert_id)
    SELECT round(coalesce(a.x, 0) + coalesce(b.x, 0), 6) AS contrastive, round(coalesce(ra.x, 0) + coalesce(rbb.x, 0), 6) AS router,
    round(0.01 / 5 * ((SELECT sum(weight) FROM ex) + (SELECT sum(weight) FROM qx)), 6) AS regular, round(0.01 / 5 * ((SELECT sum(load) FROM ld) + (SELECT sum(load) FROM lq)), 6) AS balance FROM a, b, ra, rbb"""
)
def loss_routed(spark, d):
    q, t = views.q_tok(spark, d), views.token_vecs(spark, d)
    chosen = {"query": _routes(q, 1).select("expert_id", "weight"), "doc": _routes(t, 5).select("expert_id", "weight")}
    logits = {"query": q.select(F.col("qid").alias("pid"), F.col("qpos").alias("pos"), "vec"), "doc": t.select("pid", "pos", "vec")}
    loads = []
    for side, rows in logits.items():
        # A token's softmax is made in its row, so nothing is dealt by token; the sum is a column before it is used for each component.
        exps = rows.select(F.transform("vec", lambda x: F.exp(x * 4)).alias("e"))
        each = exps.select(F.aggregate("e", F.lit(0.0), lambda a, x: a + x).alias("total"), F.posexplode("e").alias("expert_id", "x"))
        soft = each.select(F.lit(side).alias("side"), F.col("expert_id").cast("bigint").alias("expert_id"), F.lit(0).alias("mask"), (F.col("x") / F.col("total")).alias("softmax"))
        used = chosen[side].select(F.lit(side).alias("side"), "expert_id", (F.col("weight") > 0).cast("int").alias("mask"), F.lit(0.0).alias("softmax"))
        loads += [soft, used]
    load = loads[0].unionByName(loads[1]).unionByName(loads[2]).unionByName(loads[3])
    pairs = search.judged_scores(q, t, pool=_pool).select("qid", (F.col("score") / 10).alias("score"), (F.col("router") / 64).alias("router"), "rel")
    return losses.routed_of_scores(pairs, chosen["query"].unionByName(chosen["doc"]), load, batch=5, alpha=0.01, beta=0.01)


def _pool(vecs):
    """The largest weight of each expert over all vectors of a text; weights are never below zero."""
    zero = F.transform(F.get(vecs, F.lit(0)), lambda x: F.lit(0.0))
    return F.aggregate(vecs, zero, lambda a, v: F.zip_with(a, v, lambda x, y: F.greatest(x, V.router(y * 4))))


@_query(", am AS (SELECT DISTINCT pid, arg_max(pos, (round(sim, 6), -pos)) AS pos FROM sims GROUP BY qid, qpos, pid) SELECT round(sqrt(sum((1 - weight) ** 2)), 6) AS loss FROM weights SEMI JOIN am USING (pid, pos)")
def loss_mask_distill(spark, d):
    return losses.mask_distill(views.weighted_tokens(spark, d), maxsim_argmax(spark, d))


@_query(", am AS (SELECT DISTINCT pid, arg_max(pos, (round(sim, 6), -pos)) AS pos FROM sims GROUP BY qid, qpos, pid) SELECT round(sqrt(sum((1 - weight) ** 2)), 6) AS loss FROM weights LEFT JOIN (SELECT pid, pos, 1 AS used FROM am) USING (pid, pos) WHERE used = 1 OR token_id > 7")
def loss_mask_distill_guided(spark, d):
    return losses.mask_distill(views.weighted_tokens(spark, d), maxsim_argmax(spark, d), F.col("token_id") > 7)


@_query("SELECT round(sum(1 - weight), 6) AS loss FROM weights WHERE token_id > 0")
def loss_tag_guide(spark, d):
    return losses.tag_guide(views.weighted_tokens(spark, d).withColumn("label", F.col("token_id")))


@_query("SELECT round(sum(w), 6) AS loss FROM (SELECT pid, avg(weight) AS w FROM weights GROUP BY pid)")
def kw_regularizer(spark, d):
    return losses.keyword_regularizer(views.weighted_tokens(spark, d), normalized=True)


@_query("SELECT round(avg(-ln(weight)), 6) AS loss FROM weights WHERE token_id <> 3")
def loss_token_ce(spark, d):
    rows = views.weighted_tokens(spark, d).select(F.col("weight").alias("p"), F.when(F.col("token_id") == 3, -100).otherwise(F.col("token_id")).alias("label"))
    return losses.token_ce(rows)


@_query("SELECT round(exp(avg(weight)), 6) AS perplexity FROM weights")
def perplexity(spark, d):
    return losses.perplexity(views.weighted_tokens(spark, d), "weight")


# Parts of texts, vectors and indexes ----------------------------------------

_NER = "CASE WHEN regexp_matches(word, '^[A-Z]') THEN 'B-PER' ELSE 'O' END"


def _texts(spark, d):
    return views.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), T.words(F.col("text")).alias("words"))


def _person(word):
    return F.when(word.rlike("^[A-Z]"), "B-PER").otherwise("O")


@_query(_WORDS + f", t AS (SELECT doc, list({_NER} ORDER BY idx) AS tags FROM w GROUP BY doc) SELECT doc, len(tags) + 1 AS n, md5('O ' || array_to_string(tags, ' ')) AS tags FROM t")
def marker_tags(spark, d):
    tags = _texts(spark, d).filter(F.size("words") > 0).select("doc", T.with_marker_tag(F.transform("words", _person), "[D]").alias("tags"))
    return tags.select("doc", F.size("tags").cast("bigint").alias("n"), F.md5(F.array_join("tags", " ")).alias("tags"))


@_query(_WORDS + "SELECT doc, word, sub, piece, (CASE WHEN sub > 0 THEN -100 WHEN regexp_matches(source, '^[A-Z]') THEN 5 ELSE 0 END)::INTEGER AS label FROM toks")
def presplit_labels(spark, d):
    tagged = _texts(spark, d).withColumn("tags", F.transform("words", _person))
    return tagged.select("doc", F.explode(T.split_word_labels(F.col("words"), F.col("tags"))).alias("t")).select("doc", "t.word", "t.sub", "t.piece", "t.label")


@_query(_WORDS + r"""SELECT doc, count(*) AS n, count(*) FILTER (NOT regexp_matches(piece, '^[!-/:-@\[-`{-~]$')) AS kept FROM toks GROUP BY doc""")
def punctuation_mask(spark, d):
    kept = F.count_if(T.token_mask(F.col("piece")))
    return _tokens(spark, d).groupBy("doc").agg(F.count("*").alias("n"), kept.alias("kept"))


@_query(_WORDS + "SELECT doc, md5(string_agg(word, ' ' ORDER BY idx)) AS text FROM w GROUP BY doc")
def segmented_texts(spark, d):
    texts = views.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), T.segmented(F.col("text")).alias("text"))
    return texts.filter("text <> ''").select("doc", F.md5("text").alias("text"))


@_query(
    _WORDS
    + """, p AS (SELECT doc, idx, CASE WHEN regexp_matches(word, '^[A-Z]') AND length(word) > 3 THEN 'B-PER' ELSE 'O' END AS predicted,
    CASE WHEN regexp_matches(word, '^[A-Z]') THEN 'B-PER' ELSE 'O' END AS gold FROM w WHERE idx % 3 <> 2) SELECT doc, idx, predicted, gold FROM p"""
)
def label_decode(spark, d):
    ids = lambda tag: T.tag_ids(tag)
    guess = F.transform("words", lambda w: ids(F.when(w.rlike("^[A-Z]") & (F.char_length(w) > 3), "B-PER").otherwise("O")))
    gold = F.transform("words", lambda w, i: F.when(i % 3 == 2, F.lit(T.IGNORE)).otherwise(ids(_person(w))))
    named = _texts(spark, d).select("doc", F.posexplode(T.label_names(guess, gold)).alias("at", "l"))
    return named.select("doc", F.expr("cast(at div 2 * 3 + at % 2 as bigint)").alias("idx"), "l.predicted", "l.gold")


def _runs(name: str, test: str) -> str:
    return f"""{name}t AS (SELECT doc, idx, {test} AS inside FROM w),
    {name}i AS (SELECT doc, idx, idx - row_number() OVER (PARTITION BY doc ORDER BY idx) AS island FROM {name}t WHERE inside),
    {name} AS (SELECT doc, min(idx) AS s, max(idx) AS e FROM {name}i GROUP BY doc, island)"""


@_query(
    _WORDS
    + ", "
    + _runs("gold", "regexp_matches(word, '^[A-Z]')")
    + ", "
    + _runs("guess", "regexp_matches(word, '^[A-Z]') AND length(word) > 3")
    + """, c AS (SELECT (SELECT count(*) FROM gold JOIN guess USING (doc, s, e)) AS hit, (SELECT count(*) FROM gold) AS g, (SELECT count(*) FROM guess) AS p)
    SELECT round(hit / p, 6) AS precision, round(hit / g, 6) AS recall, round(2 * (hit / p) * (hit / g) / (hit / p + hit / g), 6) AS f1 FROM c"""
)
def ner_span_scores(spark, d):
    # A run of such words is one entity, which the inner tag alone says.
    tag = lambda test: F.when(test, "I-PER").otherwise("O")
    inside = lambda w: w.rlike("^[A-Z]")
    both = F.transform("words", lambda w: F.struct(tag(inside(w)).alias("gold"), tag(inside(w) & (F.char_length(w) > 3)).alias("predicted")))
    found = metrics.span_scores_of_lists(_texts(spark, d).select(both.alias("tags")), "tags")
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@_query("SELECT pid, pos, round(CASE WHEN valid THEN vec[1] / sqrt(list_dot_product(vec, vec)) ELSE 0 END, 6) AS x, round(CASE WHEN valid THEN 1 ELSE 0 END, 6)::DOUBLE AS norm FROM weights")
def mask_multiply(spark, d):
    rows = views.weighted_tokens(spark, d).select("pid", "pos", V.l2_normalize(V.masked("vec", F.col("valid"))).alias("v"))
    return rows.select("pid", "pos", F.round(F.col("v")[0] + 0.0, 6).alias("x"), F.round(V.norm("v"), 6).alias("norm"))


@_query("SELECT pid, pos, round(CASE WHEN weight < 0.6 THEN 0 ELSE weight END, 6) AS applied, CASE WHEN weight < 0.6 THEN 0.0 ELSE 1.0 END::DOUBLE AS switched FROM weights")
def keyword_weights(spark, d):
    w = V.sigmoid(F.col("vec")[0] * 8)
    return views.token_vecs(spark, d).select("pid", "pos", F.round(V.keyword_weight(w, 0.6, True), 6).alias("applied"), V.keyword_weight(w, 0.6, False).alias("switched"))


@_query("SELECT pid, pos, round((vec[1] / 3)::FLOAT::DOUBLE, 9) AS x FROM tv")
def single_precision(spark, d):
    rows = views.token_vecs(spark, d).select("pid", "pos", V.as_single(F.transform("vec", lambda x: x / 3)).alias("v"))
    return rows.select("pid", "pos", F.round(F.col("v")[0].cast("double"), 9).alias("x"))


@_query(
    """, b AS (SELECT qid, qpos, pid, arg_max(pos, (round(sim, 6), -pos)) AS pos FROM sims GROUP BY ALL)
    SELECT b.qid, b.qpos, b.pid, CASE WHEN q.vec[2] > -0.1 THEN b.pos ELSE f.pos END AS pos FROM b JOIN q ON q.qid = b.qid AND q.qpos = b.qpos JOIN b f ON f.qid = b.qid AND f.pid = b.pid AND f.qpos = 0"""
)
def maxsim_argmax_masked(spark, d):
    return search.best_positions(views.q_tok(spark, d), views.token_vecs(spark, d), F.col("vec")[1] > -0.1)


@_query("SELECT coalesce(c.id, b.id) AS id, coalesce(b.text, c.text) AS text FROM (SELECT doc_id AS id, md5(text) AS text FROM documents) c FULL JOIN (SELECT item_id AS id, md5(text) AS text FROM benchmark) b ON c.id = b.id")
def merged_texts(spark, d):
    one = lambda name, key: views.table(spark, d, name).select(F.col(key).alias("id"), "text")
    return corpus.merged(one("documents", "doc_id"), one("benchmark", "item_id"), "id", "text").select("id", F.md5("text").alias("text"))


def _halves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.filter("pid % 2 = 0"), rows.filter("pid % 2 = 1")


@_query("SELECT * FROM top WHERE rank <= 10")
def index_append_search(spark, d):
    """A flat index saved with one half of the passages, loaded, grown by the other, saved to the same folder and loaded again."""
    (one, two), path = _halves(views.token_vecs(spark, d)), scratch(spark)
    FlatIndex.build(one).save(path)
    FlatIndex.load(spark, path).append(two).save(path)
    return FlatIndex.load(spark, path).search(views.q_tok(spark, d), 10)


@_query(_KNN + ", s AS (SELECT * FROM exact SEMI JOIN knn USING (qid, pid)) " + _RANKED.format("s"))
def index_token_search(spark, d):
    """The same index asked for the documents of near tokens only."""
    (one, two), path = _halves(views.token_vecs(spark, d)), scratch(spark)
    return FlatIndex.build(one).save(path).append(two).save(path).search(views.q_tok(spark, d), 10, top_k_tokens=20)


@_query(_TOK + _CLS + ", f AS (SELECT qid, pid, round(coalesce(tok.score, 0) + cls.score, 6) AS score FROM cls LEFT JOIN tok USING (qid, pid)) " + _RANKED.format("f"))
def lexical_index_search(spark, d):
    """Token postings and whole-text vectors on disk, grown there."""
    (one, two), path, q = _halves(views.token_vecs(spark, d)), scratch(spark), views.q_tok(spark, d)
    LexicalIndex.build(one, one.filter("pos = 0").select("pid", "vec")).save(path)
    LexicalIndex.load(spark, path).append(two, two.filter("pos = 0").select("pid", "vec")).save(path)
    return LexicalIndex.load(spark, path).search(q, 10, q.filter("qpos = 0").select("qid", "vec"))


@_query(_CLS + _RANKED.format("cls"))
def vector_index_search(spark, d):
    """One vector a passage on disk, grown there."""
    (one, two), path = _halves(views.token_vecs(spark, d).filter("pos = 0").select("pid", "vec")), scratch(spark)
    VectorIndex.build(one).save(path)
    VectorIndex.load(spark, path).append(two).save(path)
    return VectorIndex.load(spark, path).search(views.q_tok(spark, d).filter("qpos = 0").select("qid", "vec"), 10)


def _residual_index(spark, d):
    """An index of all passages under the given centroids, saved with one half and grown by the other."""
    tokens, centroids, path = views.token_vecs(spark, d), views.centroids(spark, d), scratch(spark)
    codec = residual.codec(stored(residual.residuals(residual.assign(tokens, centroids)).select("residual")), 2)
    one, two = _halves(tokens)
    ResidualIndex.build(one, centroids, codec).save(path)
    ResidualIndex.load(spark, path).append(two).save(path)
    return ResidualIndex.load(spark, path)


@_query(_one(0.2) + "SELECT * FROM one")
def plaid_index_stage1(spark, d):
    return _residual_index(spark, d).stages(views.q_tok(spark, d), 2, 0.2, 40)[0]


@_query(_TWO + "SELECT * FROM two")
def plaid_index_stage2(spark, d):
    return _residual_index(spark, d).stages(views.q_tok(spark, d), 2, 0.2, 40)[1]


@_query(_FINAL)
def plaid_index_search(spark, d):
    found = _residual_index(spark, d).search(views.q_tok(spark, d), 10, ncells=2, threshold=0.2, ndocs=40, decimals=5)
    return found.select("qid", "pid", "score")


# Subwords of a public vocabulary -------------------------------------------

#: The vocabulary file; a parameter of all that uses it.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _walk(words: str) -> str:
    """SQL for ``vt`` (doc, idx, source, sub, piece, token_id): the longest match over the words ``w`` of a table, step by step."""
    byte = "CASE WHEN b <= 32 THEN chr(256 + b) WHEN b BETWEEN 127 AND 160 THEN chr(289 + b - 127) WHEN b = 173 THEN chr(323) ELSE chr(b) END"
    return f"""{words}, voc AS (SELECT unnest(map_keys(j)) AS entry, unnest(map_values(j))::INTEGER AS token_id FROM (SELECT json_extract(json, '$.model.vocab')::MAP(VARCHAR, BIGINT) AS j FROM read_json_objects('{VOCABULARY}'))),
pv AS (SELECT CASE WHEN ends_with(entry, '</w>') THEN left(entry, length(entry) - 4) ELSE entry END AS body, ends_with(entry, '</w>') AS last, entry, token_id FROM voc),
dw AS (SELECT DISTINCT word, lower(word) AS low FROM w),
hx AS (SELECT word, hex(encode(low)) AS h FROM dw),
mp AS (SELECT word, array_to_string(list_transform(list_transform(generate_series(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::INTEGER), lambda b: {byte}), '') AS s FROM hx),
cut AS (SELECT word, s, i, n FROM (SELECT word, s, i, unnest(generate_series(1, least(32, length(s) - i + 1))) AS n FROM (SELECT word, s, unnest(generate_series(1, length(s))) AS i FROM mp))),
step AS (SELECT word, i, max(n) AS n, arg_max(entry, n) AS piece, arg_max(token_id, n) AS token_id FROM cut JOIN pv ON body = substr(s, i, n) AND last = (i + n - 1 = length(s)) GROUP BY word, i),
way AS (SELECT word, 0 AS sub, piece, token_id, i + n AS nxt FROM step WHERE i = 1 UNION ALL SELECT step.word, sub + 1, step.piece, step.token_id, i + n FROM way JOIN step ON step.word = way.word AND step.i = way.nxt),
vt AS (SELECT doc, idx, w.word AS source, sub, piece, token_id FROM w JOIN way ON way.word = w.word)"""


_VOC, _VOC_ASKED = _walk(_WORDS), _walk(_ASKED)


def _voc(spark, d):
    """(doc, p): the pieces of all documents, in one narrow pass."""
    return W.with_pieces(_texts(spark, d), "words", VOCABULARY)


def _voc_tokens(spark, d):
    each = _voc(spark, d).select("doc", F.explode("p").alias("t"))
    return each.select("doc", F.col("t.word").cast("bigint").alias("word"), F.col("t.sub").cast("bigint").alias("sub"), "t.piece", "t.token_id")


@_query(_VOC + " SELECT doc, idx AS word, sub::BIGINT AS sub, piece, token_id FROM vt")
def vocab_subwords(spark, d):
    return _voc_tokens(spark, d).select("doc", "word", "sub", "piece", "token_id")


@_query(
    _VOC
    + """, o AS (SELECT doc, idx, sub, row_number() OVER (PARTITION BY doc ORDER BY idx, sub) AS place, regexp_matches(source, '^[A-Z]') AS person FROM vt QUALIFY place <= 254),
    e AS (SELECT doc, max(place) AS n FROM o GROUP BY doc)
    SELECT doc, place, idx AS word, (CASE WHEN sub > 0 THEN -100 WHEN person THEN 5 ELSE 0 END)::INTEGER AS label FROM o
    UNION ALL SELECT doc, 0, NULL, -100 FROM e UNION ALL SELECT doc, n + 1, NULL, -100 FROM e"""
)
def vocab_label_align(spark, d):
    """Labels by word ids, special tokens and truncation to 256 included."""
    tokenizer = W.Tokenizer(VOCABULARY)
    rows = _texts(spark, d).filter(F.size("words") > 0).withColumn("e", tokenizer.encode(F.col("words")))
    tagged = rows.select("doc", F.col("e.word_ids").alias("word_ids"), F.transform("words", _person).alias("tags"))
    each = tagged.select("doc", F.posexplode(F.arrays_zip("word_ids", W.aligned(F.col("word_ids"), F.col("tags")).alias("label"))).alias("place", "x"))
    return each.select("doc", F.col("place").cast("bigint").alias("place"), F.col("x.word_ids").cast("bigint").alias("word"), "x.label")


@_query(
    _VOC_ASKED
    + """, o AS (SELECT doc, token_id, row_number() OVER (PARTITION BY doc ORDER BY idx, sub) AS place FROM vt QUALIFY place <= 29),
    k AS (SELECT doc, list_concat(list_concat([49406, 336], list(token_id ORDER BY place)), [49407]) AS ids FROM o GROUP BY doc)
    SELECT doc, array_to_string(list_concat(ids, list_transform(generate_series(1, 32 - len(ids)), lambda i: 0)), ',') AS ids, len(ids) AS n FROM k"""
)
def vocab_query_pad(spark, d):
    """Queries with a marker, special tokens, truncated and padded to 32."""
    tokenizer = W.Tokenizer(VOCABULARY, longest=32, marker="q", pad=True)
    rows = views.table(spark, d, "benchmark").select(F.col("item_id").alias("doc"), tokenizer.encode(tokenizer.words(F.col("text"))).alias("e"))
    n = F.aggregate("e.attention", F.lit(0), lambda a, x: a + x).cast("bigint")
    return rows.select("doc", F.array_join(F.col("e.input_ids").cast("array<string>"), ",").alias("ids"), n.alias("n"))


_VIDS = ", ids AS (SELECT doc, list(token_id ORDER BY idx, sub) AS ids FROM vt GROUP BY doc)"


def _voc_ids(spark, d):
    return W.with_ids(_texts(spark, d), "words", VOCABULARY).filter(F.size("ids") > 0)


@_query(
    _VOC
    + _VIDS
    + """, bt AS (SELECT doc, ids, (row_number() OVER (ORDER BY doc) - 1) // 8 AS batch FROM ids)
    SELECT doc, batch, md5(array_to_string(list_concat(ids, list_transform(generate_series(1, max(len(ids)) OVER (PARTITION BY batch) - len(ids)), lambda i: 0)), ',')) AS ids FROM bt QUALIFY count(*) OVER (PARTITION BY batch) = 8"""
)
def vocab_pad_batch(spark, d):
    out = batches.padded_batches(_voc_ids(spark, d), 8, "doc", "ids", 0)
    return out.select("doc", "batch", F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids"))


@_query(
    _VOC
    + """, bt AS (SELECT doc, (row_number() OVER (ORDER BY doc) - 1) // 1000 AS batch FROM (SELECT DISTINCT doc FROM vt)),
    n AS (SELECT batch, token_id, row_number() OVER (PARTITION BY batch ORDER BY doc, idx, sub) - 1 AS place FROM vt JOIN bt USING (doc))
    SELECT batch, place // 256 AS chunk, md5(array_to_string(list(token_id ORDER BY place), ',')) AS ids FROM n GROUP BY ALL HAVING count(*) = 256"""
)
def vocab_chunks(spark, d):
    out = batches.chunked(_voc_ids(spark, d), 256, "doc", batch=1000)
    return out.select("batch", "chunk", F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids"))


@_query(_VOC + f" SELECT doc, idx AS word, sub::BIGINT AS sub, CASE WHEN {_share('0', 'doc', 'idx')} < 0.2 THEN -1 ELSE token_id END AS token_id, CASE WHEN {_share('0', 'doc', 'idx')} < 0.2 THEN token_id ELSE -100 END AS label FROM vt")
def vocab_word_mask(spark, d):
    return batches.whole_word_mask(_voc_tokens(spark, d)).select("doc", "word", "sub", "token_id", "label")


# Model heads ----------------------------------------------------------------


def _heads(experts: int) -> heads.Heads:
    """Heads over the vectors as hidden states, their matrices by rule."""
    grid = lambda f, m, step=1.0, shift=0.0: f(np.outer(np.arange(1, 65), np.arange(1, m + 1) * step + shift))
    return heads.Heads(grid(np.cos, 16), grid(np.sin, 16), 4 * grid(np.cos, 1, 0.5), 3 * grid(np.cos, 10, 1.0, -0.5), grid(np.sin, 9), experts=experts)


def _encoded(spark, d, experts=2):
    q, t = views.q_tok(spark, d), views.token_vecs(spark, d)
    asked = _heads(1).apply(q.withColumnRenamed("qpos", "pos"), "qid").withColumnRenamed("pos", "qpos")
    return asked, _heads(experts).apply(t, "pid")


def _head(name: str, f: str, m: int, scale: str = "") -> str:
    return f"list_transform(generate_series(1, {m}), lambda j: {scale}list_sum(list_transform(generate_series(1, 64), lambda i: vec[i] * {f}))) AS {name}"


_HEADS = f""", hd AS (SELECT pid, pos, token_id, {_head("raw", "cos(i * j)", 16)}, {_head("whole", "sin(i * j)", 16)}, {_head("z", "cos(i * j * 0.5)", 1, "4 * ")}, {_head("route", "cos(i * (j - 0.5))", 10, "3 * ")}, {_head("tags", "sin(i * j)", 9)} FROM tv),
hv AS (SELECT pid, pos, token_id, list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))) AS vec, whole, 1 / (1 + exp(-z[1])) AS weight, tags, list_transform(route, lambda x: ln(1 + greatest(x, 0))) AS route FROM hd),
hq AS (SELECT pid AS qid, pos AS qpos, token_id, vec, whole, route FROM hv WHERE pid % 20 = 0)"""


@_query(_HEADS + """, hb AS (SELECT qid, qpos, hv.pid, max(list_dot_product(hq.vec, hv.vec)) AS best FROM hq JOIN hv ON pid <> qid WHERE weight >= 0.5 GROUP BY ALL),
    hs AS (SELECT qid, pid, round(sum(best), 6) AS score FROM hb GROUP BY ALL) """ + _RANKED.format("hs"))
def keyword_encoder_topk(spark, d):
    return _top(heads.keyword_search(*_encoded(spark, d), 10, 0.5))


@_query(_HEADS + """, hb AS (SELECT qid, qpos, hv.pid, greatest(max(list_dot_product(hq.vec, hv.vec)), 0) AS best FROM hq JOIN hv ON pid <> qid AND hq.token_id = hv.token_id GROUP BY ALL),
    ht AS (SELECT qid, pid, round(sum(best), 6) AS score FROM hb GROUP BY ALL),
    hc AS (SELECT qid, hv.pid, round(list_dot_product(hq.whole, hv.whole), 6) AS score FROM hq JOIN hv ON pid <> qid AND pos = 0 AND qpos = 0),
    hs AS (SELECT qid, pid, round(coalesce(ht.score, 0) + hc.score, 6) AS score FROM hc LEFT JOIN ht USING (qid, pid)) """ + _RANKED.format("hs"))
def lexical_encoder_topk(spark, d):
    return _top(heads.lexical_search(*_encoded(spark, d), 10))


@_query(_HEADS + """, he AS (SELECT pid, pos, vec, unnest(route) AS weight, generate_subscripts(route, 1) AS expert FROM hv),
    dx AS (SELECT * FROM he QUALIFY row_number() OVER (PARTITION BY pid, pos ORDER BY weight DESC, expert) <= 2),
    qx AS (SELECT pid AS qid, pos AS qpos, vec, weight, expert FROM dx WHERE pid % 20 = 0 QUALIFY row_number() OVER (PARTITION BY pid, pos ORDER BY weight DESC, expert) = 1),
    hb AS (SELECT qid, qpos, dx.pid, expert, greatest(max(list_dot_product(qx.vec, dx.vec) * qx.weight * dx.weight), 0) AS best FROM qx JOIN dx USING (expert) WHERE pid <> qid GROUP BY ALL),
    hs AS (SELECT qid, pid, round(sum(best), 6) AS score FROM hb GROUP BY ALL) """ + _RANKED.format("hs"))
def routed_encoder_topk(spark, d):
    return _top(heads.routed_search(*_encoded(spark, d), 10))


@_query(_HEADS + " SELECT pid, pos, (list_position(tags, list_max(tags)) - 1)::INTEGER AS tag, round(weight, 6) AS weight FROM hv")
def tag_encoder(spark, d):
    return _encoded(spark, d)[1].select("pid", "pos", "tag", F.round("weight", 6).alias("weight"))


# Collections, batches, schedules, reports and sizes -----------------------------


@_query(_WORDS + f", t AS (SELECT doc, list({_NER} ORDER BY idx) AS tags FROM w GROUP BY doc) SELECT doc, md5(d.text) AS passage, len(tags) AS n, md5(array_to_string(tags, ' ')) AS tags FROM t JOIN documents d ON d.doc_id = doc")
def collection_with_tags(spark, d):
    """Passages and their tags from two tables whose keys must be the same; digests of both are joined, not the texts."""
    texts = views.table(spark, d, "documents").filter(F.size(T.words(F.col("text"))) > 0).select(F.col("doc_id").alias("doc"), F.md5("text").alias("passage"))
    tags = _texts(spark, d).filter(F.size("words") > 0).select("doc", F.transform("words", _person).alias("t"))
    told = tags.select("doc", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ")).alias("tags"))
    return corpus.with_tags(texts, told, "doc").select("doc", "passage", "n", "tags")


@_query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch FROM documents")
def encode_batches(spark, d):
    """Slices of 64 documents in the order of their ids, the last one shorter."""
    return batches.ordered_batches(views.table(spark, d, "documents").select("doc_id"), 64, "doc_id", drop_last=False).select("doc_id", "batch")


@_query(_WORDS + f"SELECT doc, word, sub, CASE WHEN {_share('7', 'doc', 'word')} < 0.2 THEN -1 ELSE token_id END AS masked_id, CASE WHEN {_share('7', 'doc', 'word')} < 0.2 THEN token_id ELSE -100 END AS label FROM toks")
def masked_validation(spark, d):
    """A validation set that is masked once, written, and read back."""
    kept = batches.frozen_masks(_tokens(spark, d), f"{scratch(spark)}/masked", seed=7)
    return kept.select("doc", "word", "sub", F.col("masked_id").cast("bigint").alias("masked_id"), F.col("label").cast("bigint").alias("label"))


@_query(
    _METRICS
    + """, m AS (SELECT k, round(avg((found > 0)::INT), 6) AS a, round(avg(found / k), 6) AS p, round(avg(found / relevant), 6) AS r,
      round(avg(mrr), 6) AS rr, round(avg(dcg / ideal), 6) AS g, round(avg(ap / least(k, relevant)), 6) AS ap FROM pq GROUP BY k)
    SELECT printf('exact accuracy@%d: %.2f%% precision@%d: %.2f%% recall@%d: %.2f%% mrr@%d: %.4f ndcg@%d: %.4f map@%d: %.4f', k, a * 100, k, p * 100, k, r * 100, k, rr, k, g, k, ap) AS line FROM m"""
)
def metric_report(spark, d):
    return metrics.report(_metric(spark, d, *metrics.NAMES), "exact")


@_query(
    _PAIRS
    + f", a AS (SELECT round(avg(greatest(neg_score - pos_score, 0)), 6) AS loss FROM negs), b AS ({_CE.format('rels')}), c AS (SELECT round(avg((pos_score - 1) ** 2), 6) AS loss FROM negs)"
    + " SELECT round(a.loss + b.loss + 0.5 * c.loss, 6) AS loss FROM a, b, c"
)
def loss_mixed(spark, d):
    """Margin and in-batch cross entropy, and half of the squared error."""
    return losses.mixed_of_scores(_positives(spark, d), 1.0, 0.5)


@_query(
    """, s AS (SELECT pid, sum(weight) AS w FROM weights GROUP BY pid), b AS (SELECT w, (row_number() OVER (ORDER BY pid) - 1) // 8 AS step FROM s),
    f AS (SELECT step, sum(w) AS w FROM b GROUP BY step HAVING count(*) = 8) SELECT step, round(w * 0.1 * least(1.0::DOUBLE, step / 4), 6) AS loss FROM f"""
)
def kw_regularizer_warm_up(spark, d):
    """The regulariser of each batch of eight passages, its factor rising over four steps."""
    each = views.weighted_tokens(spark, d).groupBy("pid").agg(F.sum("weight").alias("w"))
    steps = batches.ordered_batches(each, 8, "pid").groupBy(F.col("batch").alias("step")).agg(F.sum("w").alias("loss"))
    return losses.ramped(steps, 0.1, 4)


@_query(
    """, n AS (SELECT count(DISTINCT pid) AS docs, count(*) AS tokens FROM tv), c AS (SELECT unnest([0.5, 1.0, 2.0, 4.0]::DOUBLE[]) AS coef)
    SELECT coef, (2 ** floor(log2(greatest(1.0::DOUBLE, coef * sqrt(tokens::DOUBLE)))))::BIGINT AS centroids, least(1 + floor(16 * sqrt(tokens::DOUBLE))::BIGINT, docs) AS sampled FROM n, c"""
)
def plaid_size_rules(spark, d):
    """Centroids for several factors, and passages to train on, by one aggregated row."""
    n = views.token_vecs(spark, d).groupBy("pid").agg(F.count("*").alias("n")).agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    mean = n.tokens / max(1, n.docs)
    rows = [(c, V.partitions(n.docs, mean, c), V.sample_size(n.tokens, n.docs)) for c in (0.5, 1.0, 2.0, 4.0)]
    return spark.createDataFrame(rows, "coef double, centroids bigint, sampled bigint")


@_query(", s AS (SELECT * FROM exact WHERE pid % 2 = 1) " + _RANKED.format("s"))
def index_reset_search(spark, d):
    """An index that was emptied by a generation of its own and then grown by one half of the passages."""
    (one, two), path = _halves(views.token_vecs(spark, d)), scratch(spark)
    FlatIndex.build(one).save(path)
    FlatIndex.load(spark, path).reset().save(path)
    FlatIndex.load(spark, path).append(two).save(path)
    return FlatIndex.load(spark, path).search(views.q_tok(spark, d), 10)

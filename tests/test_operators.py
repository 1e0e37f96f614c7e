"""Small hand-made cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.functions import vectors as V
from tessera.operators import corpus, metrics, pruning, search
from tessera.operators.index import FlatIndex, ResidualIndex
from tessera.plans import registry
from tessera.sources import files

TOKENS = "pid bigint, pos bigint, token_id int, vec array<double>"
QUERIES = "qid bigint, qpos bigint, token_id int, vec array<double>"


@pytest.fixture
def tiny(spark):
    docs = [(1, 0, 5, [1.0, 0.0]), (1, 1, 6, [0.6, 0.8]), (2, 0, 5, [-1.0, 0.0]), (2, 1, 5, [-0.6, -0.8]), (3, 0, 7, [0.0, 1.0])]
    asked = [(10, 0, 5, [1.0, 0.0]), (10, 1, 9, [0.0, 1.0]), (11, 0, 6, [0.6, 0.8])]
    return spark.createDataFrame(asked, QUERIES), spark.createDataFrame(docs, TOKENS)


def _scores(df):
    return {(r.qid, r.pid): r.score for r in df.collect()}


def test_floor_differs_from_exact_only_below_zero(tiny):
    exact, floored = _scores(search.exact_scores(*tiny)), _scores(search.exact_scores(*tiny, floor_zero=True))
    assert exact[10, 1] == floored[10, 1] == 1.8
    assert exact[10, 2] == -0.6 and floored[10, 2] == 0.0
    q, t = tiny
    sims = t.crossJoin(q.select("qid", "qpos", F.col("vec").alias("qvec"))).withColumn("sim", V.dot("qvec", "vec"))
    assert exact == _scores(search.maxsim(sims))


def test_lexical_takes_the_best_equal_token_and_skips_absent_ones(tiny):
    assert _scores(search.lexical(*tiny)) == {(10, 1): 1.0, (10, 2): 0.0, (11, 1): 1.0}


def test_top_k_is_a_prefix(tiny):
    index = FlatIndex.build(tiny[1])
    two, one = (sorted((r.qid, r.rank, r.pid) for r in index.search(tiny[0], k).collect()) for k in (2, 1))
    assert one == [x for x in two if x[1] == 1]


def test_metrics_by_hand(spark):
    hits = spark.createDataFrame([(1, p, p) for p in range(1, 8)] + [(2, 9, 1)], "qid bigint, pid bigint, rank bigint")
    qrels = spark.createDataFrame([(1, 1), (1, 3), (1, 7), (2, 5), (3, 5)], "qid bigint, pid bigint")
    r = metrics.evaluate(hits, qrels, [3]).first()
    assert r.accuracy == pytest.approx(1 / 3, abs=1e-6) and r.precision == pytest.approx(2 / 9, abs=1e-6)
    assert r.recall == pytest.approx(2 / 9, abs=1e-6) and r.mrr == pytest.approx(1 / 3, abs=1e-6)
    assert r.map == pytest.approx((1 + 2 / 3) / 9, abs=1e-6)
    ideal = 1 + 1 / math.log2(3) + 0.5
    assert r.ndcg == pytest.approx((1 + 0.5) / ideal / 3, abs=1e-6)


def test_buckets_and_bits(spark):
    cut = F.array(F.lit(-0.1), F.lit(0.0), F.lit(0.1))
    rows = spark.createDataFrame([(x,) for x in (-0.2, -0.1, 0.0, 0.05, 0.1, 0.3)], "x double")
    assert [r[0] for r in rows.select(V.bucketize(F.col("x"), cut)).collect()] == [0, 0, 1, 2, 2, 3]
    one = spark.createDataFrame([([1, 0, 1, 1, 0, 0, 0, 1], [0, 1, 2, 3, 3, 1, 0, 2])], "bits array<int>, buckets array<int>")
    assert one.select(V.pack_bits(F.col("bits"))).first()[0] == [177]
    bits = F.flatten(F.transform("buckets", lambda b: V.bits_of(b, 2)))
    assert one.select(V.unpack_buckets(V.pack_bits(bits), 2)).first()[0] == [0, 1, 2, 3, 3, 1, 0, 2]


def test_zero_vector_stays_zero(spark):
    v = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>").select(V.l2_normalize("v")).collect()
    assert [r[0] for r in v] == [[0.0, 0.0], [0.6, 0.8]]


def test_residual_search_with_all_cells_equals_floored_exact(spark, tiny):
    queries, tokens = tiny
    centroids = tokens.select(F.expr("cast(pid * 2 + pos as int)").alias("cid"), "vec")
    index = ResidualIndex.from_flat(FlatIndex.build(tokens), centroids, nbits=1)
    found = _scores(index.search(queries, 10, ncells=9, threshold=-1.0, ndocs=40))
    assert found == pytest.approx(_scores(search.exact_scores(queries, tokens, floor_zero=True)))


def test_pruning_keeps_one_token_at_least(spark, tiny):
    rows = tiny[1].withColumn("valid", F.lit(True))
    assert {r.pid for r in pruning.top_attention(rows, 0.1).collect()} == {1, 2, 3}
    assert pruning.first_tokens(rows, 0.5).count() == 2
    strict, plain = pruning.top_idf(rows, 1.0, strict=True).count(), pruning.top_idf(rows, 1.0).count()
    assert (strict, plain) == (8, 5)


def test_append_refuses_known_documents(spark, tiny):
    index = FlatIndex.build(tiny[1])
    with pytest.raises(ValueError, match="already"):
        index.append(tiny[1].limit(1))
    more = tiny[1].withColumn("pid", F.col("pid") + 10)
    assert index.append(more).tokens.count() == 10


def test_spans_of_tags(spark):
    schema = "row int, idx int, tag string"
    gold = spark.createDataFrame([(1, i, t) for i, t in enumerate(["B-PER", "I-PER", "O", "B-LOC"])], schema)
    guess = spark.createDataFrame([(1, i, t) for i, t in enumerate(["B-PER", "I-PER", "O", "O"])], schema)
    r = metrics.span_scores(gold, guess).first()
    assert (r.precision, r.recall) == (1.0, 0.5) and r.f1 == pytest.approx(2 / 3)


def test_readers_and_index_files(spark, tiny, tmp_path):
    (tmp_path / "c.tsv").write_text('1\told\n2\t"a ""b""\nc"\n1\tnew\n')
    assert {r.pid: r.text for r in files.read_passages(spark, str(tmp_path / "c.tsv")).collect()} == {1: "new", 2: 'a "b"\nc'}
    (tmp_path / "q.tsv").write_text("1\t0\t5\t0\n1\t0\t5\t1\n")
    assert files.read_qrels(spark, str(tmp_path / "q.tsv")).count() == 2
    (tmp_path / "t.json").write_text('{"7": ["O", "B-PER"]}')
    assert files.read_tags(spark, str(tmp_path / "t.json")).first()[:] == (7, ["O", "B-PER"])
    FlatIndex.build(tiny[1]).save(str(tmp_path / "index"))
    assert FlatIndex.load(spark, str(tmp_path / "index")).tokens.count() == 5


def test_merge_guards_and_settings(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "qid bigint, text string")
    b = spark.createDataFrame([(2, "z")], "qid bigint, text string")
    assert {r.qid: r.text for r in corpus.merged(a, b, "qid", "text").collect()} == {1: "x", 2: "z"}
    assert not corpus.same_keys(a, b, "qid")
    with pytest.raises(ValueError, match="unknown"):
        Settings.from_dict({"nope": 1})


def test_chunks_leave_short_tails_out(spark):
    from tessera.operators import batches

    rows = spark.createDataFrame([(1, list(range(7))), (2, [5]), (3, []), (4, list(range(6)))], "doc bigint, ids array<bigint>")
    found = {r.doc: r.chunks for r in rows.select("doc", batches.chunks(F.col("ids"), 3).alias("chunks")).collect()}
    assert found == {1: [[0, 1, 2], [3, 4, 5]], 2: [], 3: [], 4: [[0, 1, 2], [3, 4, 5]]}


def test_trained_centroids_are_means_of_apart_clusters(spark):
    import numpy as np

    from tessera.operators import residual

    noise = np.random.default_rng(7).normal(scale=0.02, size=(60, 4))
    vecs = np.repeat(np.eye(4)[:3], 20, axis=0) + noise
    tokens = spark.createDataFrame([(i // 20, i % 20, 0, v.tolist()) for i, v in enumerate(vecs)], TOKENS)
    trained = residual.train(tokens, 3)
    means = [m / np.linalg.norm(m) for m in vecs.reshape(3, 20, 4).mean(axis=1)]
    found = sorted((r.vec for r in trained.collect()), reverse=True)
    assert np.allclose(found, sorted((m.tolist() for m in means), reverse=True), atol=1e-6)
    cells = residual.assign(tokens, trained).groupBy("pid").agg(F.count_distinct("cid").alias("n")).collect()
    assert [r.n for r in cells] == [1, 1, 1]


def test_spans_of_lists_equal_those_of_rows(spark):
    rng = np.random.default_rng(3)
    names = np.array(["O", "B-PER", "I-PER", "B-LOC", "I-LOC"])
    lists = [(i, [(str(a), str(b if rng.random() < 0.4 else a)) for a, b in names[rng.integers(0, 5, (n, 2))]]) for i, n in enumerate([0, 1, 2, *[12] * 40])] + [(99, None)]
    texts = spark.createDataFrame(lists, "row int, tags array<struct<gold: string, predicted: string>>")
    each = texts.select("row", F.posexplode("tags").alias("idx", "t"))
    want = metrics.span_scores(each.select("row", "idx", F.col("t.gold").alias("tag")), each.select("row", "idx", F.col("t.predicted").alias("tag"))).first()
    found = metrics.span_scores_of_lists(texts, "tags")
    assert found.first()[:] == pytest.approx(want[:]) and 0 < want.f1 < 1
    assert metrics.span_scores_of_lists(texts.limit(0), "tags").first()[:] == (0.0, 0.0, 0.0)


def test_span_scores_query_deals_out_no_words(spark):
    plan = registry.queries()["ner_span_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan

"""Losses, blocks, indexes, files and the engine on small cases with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import batches, corpus, engine, index, losses, metrics, residual, search
from tessera.sources import files


def _scores(spark, *rows):
    return spark.createDataFrame(list(rows), "qid bigint, score double, rel int")


def _loss(frame):
    return frame.first()[0]


def test_hard_losses_by_hand(spark):
    one = _scores(spark, (1, 0.5, 1), (1, 0.9, 0))
    assert _loss(losses.lexical_online(one)) == pytest.approx(0.25 + 0.81)
    assert _loss(losses.query_normalized(one)) == pytest.approx(1.028714, abs=1e-5)
    assert _loss(losses.lexical_dynamic(one)) == pytest.approx((0.9 + 0.5 - 0.5) ** 2 + (0.5 - 0.5 - 0.9) ** 2)
    # Equal scores are not above; a positive over all negatives is not hard; without negatives there is nothing.
    assert _loss(losses.lexical_online(_scores(spark, (1, 0.5, 1), (1, 0.5, 0), (2, 0.9, 1), (2, 0.1, 0), (3, 0.2, 1)))) == 0
    assert _loss(losses.lexical_online(_scores(spark, (1, 2.0, 1), (1, 3.6, 0)), F.lit(4.0))) == pytest.approx(0.25 + 0.81)


def test_hard_losses_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(q), float(rng.choice([0.1, 0.2, 0.4, rng.random()])), int(rng.random() < 0.3)) for q in range(12) for _ in range(int(rng.integers(1, 9)))]
    plain = dynamic = scaled = 0.0
    for q, p, rel in rows:
        neg = [s for k, s, r in rows if k == q and r == 0]
        if rel and neg:
            z = math.sqrt(p * p + sum(n * n for n in neg))
            plain += (1 - p) ** 2 * (p < max(neg)) + sum(n * n for n in neg if n > p)
            dynamic += (max(neg) + 0.5 - p) ** 2 * (p < max(neg)) + sum((p - 0.5 - n) ** 2 for n in neg if n > p)
            scaled += (1 - p / z) ** 2 * (p < max(neg)) + sum((n / z) ** 2 for n in neg if n > p)
    frame = _scores(spark, *rows)
    assert _loss(losses.lexical_online(frame)) == pytest.approx(plain, abs=1e-5)
    assert _loss(losses.lexical_dynamic(frame)) == pytest.approx(dynamic, abs=1e-5)
    assert _loss(losses.query_normalized(frame)) == pytest.approx(scaled, abs=1e-5)


def test_cross_entropies_take_large_scores(spark):
    pairs = spark.createDataFrame([(800.0, 790.0), (-5.0, 900.0)], "pos_score double, neg_score double")
    assert _loss(losses.pairwise_ce(pairs)) == pytest.approx((math.log1p(math.exp(-10)) + 905) / 2)
    rows = _scores(spark, (1, 800.0, 1), (1, 790.0, 0), (1, 801.0, 0), (2, 3.0, 1))
    want = math.log(1 + math.exp(-10) + math.exp(1))
    assert _loss(losses.in_batch(rows)) == pytest.approx(want / 2, abs=1e-6)


def test_routed_loss_by_hand(spark):
    one = _scores(spark, (1, 0.5, 1), (1, 0.9, 0))
    weights = spark.createDataFrame([(0, 2.0), (1, 3.0)], "expert_id bigint, weight double")
    loads = spark.createDataFrame([("q", 0, 2, 0.5), ("q", 0, 1, 0.5), ("d", 0, 1, 0.25)], "side string, expert_id bigint, mask int, softmax double")
    r = losses.routed(one, one, weights, loads, batch=2, alpha=0.1, beta=0.2).first()
    assert (r.contrastive, r.router) == pytest.approx((1.028714, 1.028714), abs=1e-5) and r.regular == pytest.approx(0.5) and r.balance == pytest.approx(0.1 * (3 * 1.0 + 0.25) / 2)
    assert losses.routed(one, one, weights, loads, 2, 0.0, 0.0).first()[2:] == (0.0, 0.0)


def _vectors(spark, n, key, at, seed):
    x = np.random.default_rng(seed).standard_normal((n, 8))
    rows = [(i // 3, i % 3, int(i % 5), v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    return spark.createDataFrame(rows, f"{key} bigint, {at} bigint, token_id bigint, vec array<double>")


def test_blocks_beyond_the_bound_give_the_same(spark, monkeypatch):
    q, t = _vectors(spark, 30, "qid", "qpos", 1), _vectors(spark, 90, "pid", "pos", 2)
    cents = t.filter("pos = 0").select(F.col("pid").alias("cid"), "vec")
    items = spark.createDataFrame([(1, "ab"), (2, "b c"), (3, ""), (4, None), (5, "ab")], "qid bigint, text string")
    docs = spark.createDataFrame([(1, "xab c"), (2, None), (3, ""), (4, "zzz")], "pid bigint, text string")

    def run():
        frames = [
            search.exact_scores(q, t),
            search.token_neighbours(q, t, 4),
            search.single_vector(q.filter("qpos = 0"), t.filter("pos = 0")),
            residual.assign(t, cents).select("pid", "pos", "cid"),
            residual.centroid_scores(q, cents),
            corpus.containing(items, docs),
            search.rerank(q.select("qid").distinct().crossJoin(t.select("pid").distinct()).filter("(qid + pid) % 3 = 0"), q, t),
        ]
        return [sorted(map(tuple, f.collect())) for f in frames]

    whole = run()
    assert whole[5] == [(1, 1), (2, 1), (3, 1), (3, 3), (3, 4), (5, 1)]
    assert whole[6] == [x for x in sorted((r.qid, r.pid, r.score) for r in search.maxsim(q.select("qid", "qpos", F.col("vec").alias("qvec")).crossJoin(t).withColumn("sim", V.dot("qvec", "vec"))).collect()) if (x[0] + x[1]) % 3 == 0]
    for module in (search, residual):
        monkeypatch.setattr(module, "QUERY_BYTES", 700)
    monkeypatch.setattr(search, "DOC_BYTES", 2000)
    assert run() == whole
    assert search.exact_scores(q, t.limit(0)).count() == search.exact_scores(q.limit(0), t).count() == 0
    assert search.single_vector(q.limit(0), t).count() == search.token_neighbours(q, t.limit(0), 3).count() == 0


def test_order_batches_and_next_other(spark):
    rows = spark.createDataFrame([(k,) for k in [7, -3, 10**12, 8, 9, 0, 5, 6, 11]] + [(None,)], "k bigint")
    got = {r.k: r["at"] for r in batches.in_order(rows, "k", per_bucket=2).collect()}
    assert got == {k: i for i, k in enumerate([-3, 0, 5, 6, 7, 8, 9, 11, 10**12])}
    assert batches.in_order(rows.limit(0), "k").count() == 0
    assert sorted((r.batch, r.k) for r in batches.ordered_batches(rows, 4, "k").collect()) == [(0, -3), (0, 0), (0, 5), (0, 6), (1, 7), (1, 8), (1, 9), (1, 11)]
    docs = spark.createDataFrame([(k,) for k in (1, 5, 900, 901, 5000)], "pid bigint")
    pairs = spark.createDataFrame([(1, 1), (1, 5), (1, 901), (2, 900), (3, 5000), (1, 1)], "qid bigint, pid bigint")
    assert sorted(map(tuple, corpus.next_other(pairs, docs).collect())) == [(1, 1, 900), (1, 5, 900), (1, 901, 5000), (2, 900, 901)]


def test_tags_masks_and_experts(spark):
    row = spark.createDataFrame([(["Anna", "lives"], ["B-PER", "O"], [1, 1, 1, 0], [3, 1, 5], [5, -100, 0], [0.5, -1.0, 2.0, 0.5])], "w array<string>, t array<string>, m array<int>, p array<int>, g array<int>, l array<double>")
    r = row.select(
        T.split_word_labels(F.col("w"), F.col("t")).alias("split"),
        T.with_marker_tag(F.col("t"), "[D]").alias("marked"),
        T.without_last(F.col("m")).alias("sep"),
        T.label_names(F.col("p"), F.col("g")).alias("names"),
        V.top_experts("l", 2).alias("experts"),
        T.segmented(F.lit(" a  b\n")).alias("seg"),
        V.masked("l", F.lit(False)).alias("zero"),
        V.as_single("l").alias("single"),
    ).first()
    assert [tuple(x) for x in r["split"]] == [(0, 0, "Anna", 5), (1, 0, "live", 0), (1, 1, "s", -100)]
    assert r.marked == ["O", "B-PER", "O"] and r.sep == [1, 1, 0, 0] and r.seg == "a b" and r.zero == [0.0] * 4
    assert [tuple(x) for x in r["names"]] == [("B-ORG", "B-PER"), ("B-PER", "O")]
    assert [(x.expert_id, round(x.weight, 6)) for x in r.experts] == [(2, round(math.log(3), 6)), (0, round(math.log(1.5), 6))]
    assert len(T.POS_TAGS) == 31 and T.NER_TAGS[5] == "B-PER" and T.POS_TAGS[9] == "M"


def test_query_masks(spark):
    # Products: 0.5 and 0.9 for the first query token, -0.4 and -0.2 for the second.
    q = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0])], "qid bigint, qpos bigint, vec array<double>")
    t = spark.createDataFrame([(9, 0, [0.5, -0.4]), (9, 1, [0.9, -0.2])], "pid bigint, pos bigint, vec array<double>")
    assert search.masked_maxsim(q, t, F.lit(True)).first().score == pytest.approx(0.35)
    assert search.masked_maxsim(q, t, F.col("pos") == 0, F.col("qpos") == 0).first().score == pytest.approx(0.5)
    assert {r.qpos: r.pos for r in search.best_positions(q, t, F.col("qpos") == 1).collect()} == {0: 1, 1: 1}
    first = t.withColumn("vec", F.when(F.col("pos") == 0, F.array(F.lit(2.0), F.lit(-0.4))).otherwise(F.col("vec")))
    assert {r.qpos: r.pos for r in search.best_positions(q, first, F.col("qpos") == 0).collect()} == {0: 0, 1: 0}
    assert {r.qpos: r.pos for r in search.best_positions(q, first).collect()} == {0: 0, 1: 1}


def test_indexes_train_append_reset_save_load(spark, tmp_path):
    t = _vectors(spark, 300, "pid", "pos", 5)
    q = t.filter("pid < 5").select((F.col("pid") + 1000).alias("qid"), F.col("pos").alias("qpos"), "token_id", "vec")
    built = index.ResidualIndex.train(t.filter("pid < 90"), nbits=2, coef=1.0)
    assert built.centroids.count() == V.partitions(90, 3.0, 1.0) and built.codes.count() == 90
    grown = built.append(t.filter("pid >= 90"))
    with pytest.raises(ValueError):
        built.append(t)
    grown.save(f"{tmp_path}/r")
    again = index.ResidualIndex.load(spark, f"{tmp_path}/r")
    hits = {r.qid: r.pid for r in again.search(q, 1, ncells=4, threshold=0.0, ndocs=100).collect()}
    assert sum(hits[1000 + i] == i for i in range(5)) >= 4 and again.codes.count() == 100 and built.reset().codes.count() == 0
    cls = t.filter("pos = 0").select("pid", "vec")
    lexical = index.LexicalIndex.build(t.filter("pid < 50"), cls_vectors=cls.filter("pid < 50")).append(t.filter("pid >= 50"), cls.filter("pid >= 50"))
    lexical.save(f"{tmp_path}/l")
    asked = q.filter("qpos = 0").select("qid", "vec")
    want = sorted(map(tuple, lexical.search(q, 3, asked).collect()))
    loaded = index.LexicalIndex.load(spark, f"{tmp_path}/l")
    assert sorted(map(tuple, loaded.search(q, 3, asked).collect())) == want and loaded.reset().cls_vectors.count() == 0
    index.LexicalIndex.build(t).save(f"{tmp_path}/n")
    assert index.LexicalIndex.load(spark, f"{tmp_path}/n").cls_vectors is None
    with pytest.raises(ValueError):
        lexical.append(t.limit(0))


def test_files_and_engine(spark, tmp_path):
    (tmp_path / "collection.tsv").write_text('1\tthe red house\n2\ta "blue" car\n2\ta blue boat\n3\tgreen tree .\n')
    (tmp_path / "queries.tsv").write_text("10\tred house\n11\tblue boat\n12\tnothing\n")
    (tmp_path / "val.tsv").write_text("12\tgreen tree\n")
    (tmp_path / "dev_qrels.tsv").write_text("10\t0\t1\t1\n11\t0\t2\t1\n12\t0\t3\t0\n")
    (tmp_path / "train_triples.tsv").write_text("10\t1\t2\n")
    (tmp_path / "bad.tsv").write_text("10\t1\n")
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx, y\n")
    (tmp_path / "j.json").write_text('[{"a": 1},\n {"a": 2}]')
    data = engine.Processor(spark, str(tmp_path))
    assert data.triples().first()[3:] == ("red house", "the red house", "a blue boat")
    with pytest.raises(Exception, match="three columns"):
        files.read_triples(spark, f"{tmp_path}/bad.tsv").collect()
    assert tuple(files.read_by_extension(spark, f"{tmp_path}/t.tsv").first()) == ("1", "x, y")
    assert files.read_json(spark, f"{tmp_path}/j.json").count() == 2
    encoder, asked = engine.HashEncoder(), data.queries("queries.tsv", "val.tsv")
    found = engine.evaluate(encoder, asked, data.passages(), data.qrels(), [1], ["maxsim", "lexical"]).collect()
    assert {(r.fn, r.mrr) for r in found} == {("maxsim", 1.0), ("lexical", 1.0)}
    assert "first" in engine.SCORES
    with pytest.raises(ValueError):
        engine.score_function("maxsim")(search.exact_scores)
    hits = engine.retrieve(encoder, asked, data.passages(), 2)
    assert {r.text for r in corpus.hit_texts(hits, data.passages()).filter("rank = 1").collect()} == {"the red house", "a blue boat", "green tree ."}
    row = metrics.as_row(metrics.evaluate(hits, data.qrels(), [1], ("mrr",)), "dev", 1, 2)
    for _ in range(2):
        files.append_metrics(row, f"{tmp_path}/metrics")
    assert [r.line for r in files.read_metrics(spark, f"{tmp_path}/metrics").collect()] == ["epoch,steps,dev-mrr@1", "1,2,1.0", "1,2,1.0"]
    files.write_splits({"train": row}, f"{tmp_path}/set")
    assert files.read_split(spark, f"{tmp_path}/set", "train").columns == row.columns
    files.write_hits(hits, f"{tmp_path}/hits")
    files.write_jsonl(hits, f"{tmp_path}/lines")
    assert spark.read.json(f"{tmp_path}/hits").count() == 3 and files.read_by_extension(spark, f"{tmp_path}/j.json").count() >= 2
    assert "\n" in files.to_json(row).first().json and metrics.report(metrics.evaluate(hits, data.qrels(), [1]), "dev").first().line.startswith("dev accuracy@1: 100.00%")


def _scored(spark):
    """(qid, pid, score, rel, router) of three queries, with positives in runs and at the end."""
    rng = np.random.default_rng(5)
    rows = [(q, p, float(rng.random()), int(rng.random() < 0.4), float(rng.random())) for q in (0, 20, 40) for p in range(60) if p != q]
    return rows, spark.createDataFrame(rows, "qid bigint, pid bigint, score double, rel int, router double")


def test_next_negatives_look_at_each_row_once(spark):
    rows, frame = _scored(spark)
    want = {(q, p): next((s for a, b, s, r, _ in rows if a == q and b > p and r == 0), None) for q, p, *_ in rows}
    found = losses.next_negatives(frame)
    assert {(r.qid, r.pid): r.neg_score for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "unboundedfollowing" not in plan.lower()  # such a frame is summed up anew for each row


def test_losses_of_scores_equal_their_parts(spark):
    _, frame = _scored(spark)
    pairs = losses.next_negatives(frame).filter("rel = 1 AND neg_score IS NOT NULL").selectExpr("score AS pos_score", "neg_score", "1.0D AS target")
    assert losses.mixed_of_scores(frame, 1.0, 0.5).first().loss == pytest.approx(losses.mixed(pairs, frame, "target", 0.5).first().loss, abs=1e-6)
    weights = spark.createDataFrame([(0.5,), (0.25,)], "weight double")
    loads = spark.createDataFrame([("q", 1, 1, 0.5), ("d", 1, 0, 0.25)], "side string, expert_id bigint, mask int, softmax double")
    router = frame.select("qid", F.col("router").alias("score"), "rel")
    args = (weights, loads, 5, 0.01, 0.01)
    assert losses.routed_of_scores(frame, *args).first()[:] == pytest.approx(losses.routed(frame, router, *args).first()[:], abs=2e-6)


@pytest.mark.parametrize("bound", [1 << 26, 100])
def test_judged_scores_equal_a_join(spark, monkeypatch, bound):
    """Kinds that are null, missing or there twice give the rows that a join gives."""
    rng = np.random.default_rng(1)
    rows = [(i // 3, i % 3, [None, 1, 2, 3][i % 4], rng.standard_normal(4).tolist()) for i in range(90)] + [(7, 0, 2, [1.0, 0.0, 0.0, 0.0]), (8, 0, 2, [0.0, 1.0, 0.0, 0.0])]
    tokens = spark.createDataFrame([r for r in rows if r[:2] != (11, 0)], "pid bigint, pos bigint, token_id int, vec array<double>")
    q = tokens.filter("pid % 4 = 0").withColumnsRenamed({"pid": "qid", "pos": "qpos"})
    first = tokens.filter("pos = 0").select("pid", "token_id")
    marks = first.filter("pid % 4 = 0").withColumnRenamed("pid", "qid").join(first, "token_id").filter("pid <> qid").selectExpr("qid", "pid", "1 AS rel")
    want = search.exact_scores(q, tokens).join(marks, ["qid", "pid"], "left").fillna(0, ["rel"])
    monkeypatch.setattr(search, "QUERY_BYTES", bound)
    monkeypatch.setattr(search, "TILE_BYTES", 1 << 12)
    key = lambda r: (r.qid, r.pid, r.rel)
    got, want = (sorted(x.collect(), key=key) for x in (search.judged_scores(q, tokens), want))
    assert [key(r) for r in got] == [key(r) for r in want]
    assert [r.score for r in got] == pytest.approx([r.score for r in want], abs=2e-6)

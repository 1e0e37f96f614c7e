"""Model heads, the knobs, examples by mode, and small operators without a query of their own."""

import math

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.operators import batches, corpus, engine, heads, index, losses
from tessera.sources import files

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _hidden(spark, n=40):
    x = np.random.default_rng(2).standard_normal((n, 6))
    rows = [(i // 4, i % 4, i % 3, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "pid bigint, pos bigint, token_id bigint, vec array<double>").repartition(3), x


def test_heads_equal_numpy(spark):
    hidden, x = _hidden(spark)
    rng = np.random.default_rng(3)
    token, whole, keyword, router, tagger = (rng.standard_normal((6, m)) for m in (4, 3, 1, 5, 9))
    got = {(r.pid, r.pos): r for r in heads.Heads(token, whole, keyword, router, tagger, experts=2).apply(hidden, "pid").collect()}
    for i, h in enumerate(x):
        r = got[i // 4, i % 4]
        raw = h @ token
        assert np.allclose(r.vec, raw / np.linalg.norm(raw)) and r.weight == pytest.approx(1 / (1 + math.exp(-(h @ keyword)[0])))
        assert (r.cls is None) == (r.pos > 0) and (r.pos > 0 or np.allclose(r.cls, h @ whole)) and r.tag == int((h @ tagger).argmax())
        scores = np.log1p(np.maximum(h @ router, 0))
        assert [e.expert_id for e in r.experts] == sorted(range(5), key=lambda e: (-scores[e], e))[:2]
    bare = heads.Heads(unit=False).apply(hidden, "pid").filter("pid = 0 AND pos = 1").first()
    assert np.allclose(bare.vec, x[1]) and (bare.weight, bare.cls, bare.experts, bare.tag) == (None,) * 4
    assert heads.Heads(token, whole, keyword, router, tagger).apply(hidden.limit(0), "pid").count() == 0
    assert heads.routes(heads.Heads(router=router, experts=2).apply(hidden, "pid")).count() == 80


def test_settings_change_what_they_name(spark, tmp_path):
    hidden, _ = _hidden(spark)
    q = hidden.filter("pid < 2").select((F.col("pid") + 100).alias("qid"), F.col("pos").alias("qpos"), "token_id", "vec")
    encoded = heads.Heads(keyword=np.ones((6, 1))).apply(hidden, "pid")
    for k, threshold in ((2, 0.0), (3, 0.6)):
        one = engine.Engine(Settings(top_k=k, top_k_tokens=1000, keyword_threshold=threshold))
        found = one.flat(encoded)
        assert found.tokens.count() == encoded.filter(F.col("weight") >= threshold).count()
        hits = one.search(found, q).groupBy("qid").count().collect()
        assert {r["count"] for r in hits} == {k}
    assert engine.Engine(Settings(top_k=5)).search(index.LexicalIndex.build(hidden), q).agg(F.max("rank")).first()[0] == 5
    small = engine.Engine(Settings(nbits=4, partitions_coef=1.0, ncells=1, centroid_score_threshold=-9.0, ndocs=8, top_k=2))
    trained = small.residual(hidden)
    assert len(trained.codec.first().weights) == 16 and small.search(trained, q).groupBy("qid").count().agg(F.max("count")).first()[0] <= 2
    weighted = engine.Engine(Settings(apply_weight=True)).kept_tokens(encoded).filter("pid = 0 AND pos = 0").first()
    assert np.allclose(weighted.vec, np.array(encoded.filter("pid = 0 AND pos = 0").first().vec) * weighted.weight)
    texts = spark.createDataFrame([("The house stands",)], "t string")
    ids = lambda s, side: texts.select(engine.Engine(s, VOCABULARY).tokenizer(side).encode(engine.Engine(s, VOCABULARY).tokenizer(side).words(F.col("t")))["input_ids"].alias("i")).first().i
    plain = ids(Settings(), "doc")
    assert len(plain) == 5 and ids(Settings(add_cls=False), "doc") == plain[1:-1] and len(ids(Settings(doc_marker="d"), "doc")) == 6
    assert len(ids(Settings(query_pad=True, query_max_length=12), "query")) == 12 and len(ids(Settings(max_length=4), "query")) == 4
    row = spark.createDataFrame([([None, 0, 1, 1, None], ["B-PER", "O"])], "w array<int>, t array<string>")
    label = lambda s: row.select(engine.Engine(s).labels(F.col("w"), F.col("t")).alias("l")).first().l
    assert label(Settings()) == [-100, 5, 0, -100, -100] and label(Settings(first_token_only=False)) == [-100, 5, 0, 0, -100]
    assert label(Settings(kept_tags=(5,))) == [-100, 1, 0, -100, -100] and label(Settings(ignore_label=-1)) == [-1, 5, 0, -1, -1]
    said = spark.createDataFrame([(1, "a house .")], "pid bigint, text string")
    assert [engine.Engine(Settings(mask_punctuation=m, doc_marker=d)).encoder().encode_passages(said).count() for m, d in ((True, None), (False, None), (False, "D"))] == [2, 3, 4]
    qrels = spark.createDataFrame([(100, 0)], "qid bigint, pid bigint")
    hits = engine.Engine(Settings(top_k=5)).search(index.LexicalIndex.build(hidden), q)
    table = engine.Engine(Settings(ks=(1, 2))).metrics(hits, qrels)
    assert {r.k for r in table.collect()} == {1, 2}
    files.write_metrics(table, f"{tmp_path}/m")
    assert spark.read.json(f"{tmp_path}/m").count() == 2


def test_examples_and_batches_by_mode(spark, tmp_path):
    (tmp_path / "collection.tsv").write_text("".join(f"{i}\tpassage number {i}\n" for i in range(9)))
    (tmp_path / "queries.tsv").write_text("".join(f"{i}\tquery {'long ' * i}\n" for i in range(10, 15)))
    (tmp_path / "train_triples.tsv").write_text("".join(f"{10 + i % 5}\t{i}\t{i + 1}\n" for i in range(8)))
    (tmp_path / "dev_qrels.tsv").write_text("".join(f"{10 + i}\t0\t{i}\t1\n" for i in range(5)))
    data, one = engine.Processor(spark, str(tmp_path)), engine.Engine(Settings(), VOCABULARY)
    train, val = data.examples("train"), data.examples("val")
    assert train.count() == 8 and sorted(r.passage for r in val.collect()) == [f"passage number {i}" for i in range(5)]
    with pytest.raises(ValueError, match="mode"):
        data.examples("test")
    rows = one.tokenized(train, 3, "train", "pos_pid").collect()
    assert len(rows) == 6 and {r.batch for r in rows} == {0, 1}
    for b in (0, 1):
        assert len({len(r["query"]) for r in rows if r.batch == b}) == 1
    ordered = one.tokenized(val, 2, "val", "pid").collect()
    assert sorted((r.batch, r.pid) for r in ordered) == [(0, 0), (0, 1), (1, 2), (1, 3)]
    assert one.tokenized(train, 3, "train", "pos_pid", seed=1).count() == 6


def test_small_operators(spark, tmp_path):
    assert [losses.warm_up(0.5, s, 4) for s in (0, 2, 4, 9)] == [0.0, 0.25, 0.5, 0.5] and losses.warm_up(0.5, 3, 0) == 0.5
    pairs = spark.createDataFrame([(0.2, 0.5, 1.0), (0.9, 0.1, 0.0)], "pos_score double, neg_score double, target double")
    inb = spark.createDataFrame([(1, 0.5, 1), (1, 0.9, 0)], "qid bigint, score double, rel int")
    want = 0.3 / 2 + (math.log(math.exp(0.5) + math.exp(0.9)) - 0.5) + 0.1 * (0.64 + 0.81) / 2
    assert losses.mixed(pairs, inb, "target", 0.1).first().loss == pytest.approx(want, abs=1e-5)
    rows = spark.createDataFrame([(i,) for i in range(50)], "k bigint").repartition(4)
    order = [r.k for r in batches.shuffled(rows, "k", 1).collect()]
    assert sorted(order) == list(range(50)) and order != sorted(order) and order == [r.k for r in batches.shuffled(rows, "k", 1).collect()] != [r.k for r in batches.shuffled(rows, "k", 2).collect()]
    assert [r.k for r in batches.sequential(rows, "k").collect()] == list(range(50))
    tokens = spark.createDataFrame([(d, w, s, 7) for d in range(20) for w in range(5) for s in range(2)], "doc bigint, word bigint, sub bigint, token_id bigint")
    frozen = batches.frozen_masks(tokens, f"{tmp_path}/frozen")
    assert frozen.count() == 200 and frozen.columns[-2:] == ["masked_id", "label"] and frozen.filter("masked_id = -1 AND label = 7").count() == frozen.filter("label <> -100").count() > 0
    passages = spark.createDataFrame([(1, "a"), (2, "b")], "pid bigint, text string")
    tags = spark.createDataFrame([(1, ["O"]), (2, ["B-PER"])], "pid bigint, tags array<string>")
    assert {r.pid: r.tags for r in corpus.with_tags(passages, tags).collect()} == {1: ["O"], 2: ["B-PER"]}
    for bad in (tags.filter("pid = 1"), tags.unionByName(tags.filter("pid = 1"))):
        with pytest.raises(ValueError, match="same keys"):
            corpus.with_tags(passages, bad)
    (tmp_path / "lines.txt").write_text("one\n\ntwo\n")
    assert [r.text for r in files.read_lines(spark, f"{tmp_path}/lines.txt").collect()] == ["one", "", "two"]
    with pytest.raises(ValueError, match="txt"):
        files.read_lines(spark, f"{tmp_path}/lines.csv")


def test_ramp_of_a_column_equals_the_ramp_of_a_number(spark):
    rows = spark.createDataFrame([(i, 10.0 + i) for i in range(7)], "step bigint, loss double")
    for steps in (0, 4):
        got = {r.step: r.loss for r in losses.ramped(rows, 0.3, steps).collect()}
        assert got == {i: pytest.approx(losses.warm_up(0.3, i, steps) * (10.0 + i)) for i in range(7)}
    assert losses.ramped(rows.limit(0), 0.3, 4).count() == 0


@pytest.mark.parametrize("name", ["collection_with_tags", "encode_batches", "kw_regularizer_warm_up", "plaid_size_rules", "masked_validation"])
def test_queries_take_empty_tables(spark, tmp_path, name):
    from tessera.plans import registry

    for table in ("documents", "embeddings"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    found = registry.queries()[name](spark, str(tmp_path)).collect()
    assert not found if name != "plaid_size_rules" else [(r.centroids, r.sampled) for r in found] == [(1, 0)] * 4

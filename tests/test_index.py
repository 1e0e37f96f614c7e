"""Indexes on disk, bounded products, packed codes, orders of skewed keys."""

import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import batches, corpus, index, losses, residual, search, store

DIM = 16


def _tokens(spark, docs, each=5, seed=0, first=0, vocabulary=7):
    x = np.random.default_rng(seed).standard_normal((docs * each, DIM))
    rows = [(first + i // each, i % each, int(i % vocabulary), v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    return spark.createDataFrame(rows, "pid bigint, pos bigint, token_id bigint, vec array<double>")


def _asked(tokens, n=4):
    return tokens.filter(F.col("pid") < n).select((F.col("pid") + 10_000).alias("qid"), F.col("pos").alias("qpos"), "token_id", "vec")


def _rows(frame):
    return sorted(map(tuple, frame.collect()))


def _make(kind, tokens):
    if kind == "flat":
        return index.FlatIndex.build(tokens)
    if kind == "vector":
        return index.VectorIndex.build(tokens.filter("pos = 0").select("pid", "vec"))
    if kind == "lexical":
        return index.LexicalIndex.build(tokens, tokens.filter("pos = 0").select("pid", "vec"))
    cents = tokens.filter("pos = 0 AND pid < 6").select(F.col("pid").cast("int").alias("cid"), "vec")
    return index.ResidualIndex.build(tokens, cents, residual.codec(residual.residuals(residual.assign(tokens, cents)), 2))


def _grow(kind, found, tokens):
    if kind == "vector":
        return found.append(tokens.filter("pos = 0").select("pid", "vec"))
    return found.append(tokens, tokens.filter("pos = 0").select("pid", "vec")) if kind == "lexical" else found.append(tokens)


def _search(kind, found, q):
    if kind == "vector":
        return _rows(found.search(q.filter("qpos = 0").select("qid", "vec"), 5))
    if kind == "lexical":
        return _rows(found.search(q, 5, q.filter("qpos = 0").select("qid", "vec")))
    return _rows(found.search(q, 5) if kind == "flat" else found.search(q, 5, ncells=3, threshold=-1.0, ndocs=400))


TYPES = {"flat": index.FlatIndex, "vector": index.VectorIndex, "lexical": index.LexicalIndex, "residual": index.ResidualIndex}


@pytest.mark.parametrize("kind", sorted(TYPES))
def test_load_append_save_to_one_folder(spark, tmp_path, kind):
    one, two, path = _tokens(spark, 30), _tokens(spark, 20, seed=1, first=30), str(tmp_path / kind)
    q = _asked(one)
    whole = _grow(kind, _make(kind, one), two)
    want = _search(kind, whole, q)
    _make(kind, one).save(path)
    before = {p for p in pathlib.Path(path).rglob("*.parquet")}
    grown = _grow(kind, TYPES[kind].load(spark, path), two)
    assert _search(kind, grown, q) == want
    grown.save(path)
    again = TYPES[kind].load(spark, path)
    assert _search(kind, again, q) == want and again.tables.home.manifest.generation == 2
    # The old files are as they were: only the new part was written.
    assert before < {p for p in pathlib.Path(path).rglob("*.parquet")}
    # Saving what was loaded adds nothing, another folder gets everything.
    copied = again.save(str(tmp_path / "copy"))
    assert _search(kind, copied, q) == want
    with pytest.raises(ValueError):
        _grow(kind, again, two)
    with pytest.raises(ValueError, match="holds no"):
        TYPES["flat" if kind != "flat" else "residual"].load(spark, path)
    # An emptied index is a generation, and documents can come again.
    again.reset().save(path)
    empty = TYPES[kind].load(spark, path)
    assert _search(kind, empty, q) == []
    refilled = _grow(kind, empty, two).save(path)
    assert len(_search(kind, refilled, q)) > 0 and refilled.tables.home.manifest.generation == 4
    kept = store.Store(spark, path)
    assert kept.vacuum() > 0 and kept.generations() == [4] and len(_search(kind, TYPES[kind].load(spark, path), q)) > 0


@pytest.mark.parametrize("kind", sorted(TYPES))
def test_failed_and_rival_writes_leave_the_index(spark, tmp_path, kind):
    one, two, path = _tokens(spark, 20), _tokens(spark, 10, seed=1, first=20), str(tmp_path / kind)
    q, first = _asked(one), _make(kind, one).save(path)
    want = _search(kind, first, q)
    bad = F.when(F.col("pid") == 27, F.raise_error(F.lit("lost")).cast("array<double>")).otherwise(F.col("vec"))
    with pytest.raises(Exception, match="lost"):
        _grow(kind, TYPES[kind].load(spark, path), two.withColumn("vec", bad)).save(path)
    assert _search(kind, TYPES[kind].load(spark, path), q) == want
    rival = _grow(kind, TYPES[kind].load(spark, path), _tokens(spark, 5, seed=2, first=100))
    _grow(kind, TYPES[kind].load(spark, path), two).save(path)
    with pytest.raises(store.Conflict):
        rival.save(path)
    assert TYPES[kind].load(spark, path).tables.home.manifest.generation == 2


@pytest.mark.parametrize("nbits", [1, 2, 4])
def test_packed_codes_have_the_size_of_the_formula_and_come_back(spark, tmp_path, nbits, monkeypatch):
    tokens = _tokens(spark, 400, 10)
    cents = tokens.filter("pos = 0 AND pid < 20").select(F.col("pid").cast("int").alias("cid"), "vec")
    rest = residual.residuals(residual.assign(tokens, cents))
    codec = residual.codec(rest, nbits)
    found = index.ResidualIndex.build(tokens, cents, codec).save(str(tmp_path / "i"))
    assert found.codes.agg(F.sum(F.octet_length("packed"))).first()[0] == 4000 * DIM * nbits // 8
    size = found.codes.select("packed").write.mode("overwrite").parquet(str(tmp_path / "p")) or sum(p.stat().st_size for p in (tmp_path / "p").glob("*.parquet"))
    one = found.codes.coalesce(1).select("packed").write.option("compression", "none").parquet(str(tmp_path / "q")) or sum(p.stat().st_size for p in (tmp_path / "q").glob("*.parquet"))
    assert one < 1.1 * (4000 * DIM * nbits // 8 + 4 * 400) + 2000 and size > 0
    row = codec.first()
    plain = {}
    for r in rest.collect():
        raw = np.array(r.centroid) + np.array([row.weights[sum(c < x for c in row.cutoffs)] for x in r.residual])
        plain[r.pid, r.pos] = raw / np.linalg.norm(raw)
    for bound in (search.QUERY_BYTES, 10):
        monkeypatch.setattr(residual, "QUERY_BYTES", bound)
        got = residual.as_tokens(residual.decompress(found.codes, cents, codec)).collect()
        assert len(got) == 4000 and all(np.allclose(r.vec, plain[r.pid, r.pos], atol=1e-12) for r in got)
    assert residual.digits(2)[0b10110001].tolist() == [1, 3, 0, 2] and residual.pack(np.array([[0, 1, 2, 3, 3, 1, 0, 2]]), 2).tolist() == [[0b00100111, 0b11100001]]


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def _read(spark, frame):
    """Bytes that were read from files while a frame was computed."""
    counted = lambda: sum(x.getBytesRead() for x in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())
    before = counted()
    frame.collect()
    return counted() - before


def test_probe_reads_only_the_cells_it_needs(spark, tmp_path):
    tokens = _tokens(spark, 2000, 4)
    cents = tokens.filter("pos = 0 AND pid < 256").select(F.col("pid").cast("int").alias("cid"), "vec")
    codec = residual.codec(residual.residuals(residual.assign(tokens, cents)), 1)
    found = index.ResidualIndex.build(tokens, cents, codec).save(str(tmp_path / "i"))
    q = _asked(tokens, 1)

    def postings_read(ncells):
        cells = residual.probed(residual.centroid_rows(q, found.centroids), ncells)
        asked = search.slots(cells, found.tables.all("cuts"), "cid")
        (part,) = index._only(found.tables.parts("ivf"), "slot", index._literal(asked.select("slot")))
        return _read(spark, part)

    sizes = [postings_read(n) for n in (1, 4, 256)]
    assert 0 < sizes[0] < sizes[1] < sizes[2] and sizes[0] < sizes[2] / 8
    exact = {tuple(r) for r in index.FlatIndex.build(tokens).search(q, 10).select("qid", "pid").collect()}
    near = {tuple(r) for r in found.search(q, 10, ncells=256, threshold=-1.0, ndocs=8000).select("qid", "pid").collect()}
    assert len(exact & near) >= 5


def test_index_side_is_not_exchanged(spark, tmp_path, monkeypatch):
    tokens = _tokens(spark, 300)
    q = _asked(tokens)
    monkeypatch.setattr(search, "QUERY_BYTES", 100)
    monkeypatch.setattr(search, "POSTINGS", 64)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        slots, cuts = search.postings(tokens)
        tables = index.Tables(fresh={"postings": slots, "cuts": cuts}).saved(spark, str(tmp_path / "s"), {"postings": "slot", "cuts": ""}, {})
        # 1500 tokens of seven ids: each is cut into several blocks, none much larger than the bound.
        (part,) = tables.parts("postings")
        assert part.count() >= 7 * 3 and part.agg(F.max(F.size("pids"))).first()[0] < 2 * 64
        joined = search.met_postings(q, [part], tables.all("cuts"))
        monkeypatch.setattr(search, "QUERY_BYTES", 1 << 26)
        assert _rows(joined) == _rows(search.lexical(q, tokens))
        plan = _plan(joined)
        scan = plan[plan.index("SortMergeJoin") :]
        left = scan[scan.index(":- ") : scan.index("+- ", scan.index("Scan parquet"))]
        assert "Exchange" not in left and "Bucketed: true" in left
        lexical = index.LexicalIndex.build(tokens, tokens.filter("pos = 0")).save(str(tmp_path / "l"))
        plan = _plan(search.best_of_shards(q, lexical.tables.parts("postings"), 5, q.filter("qpos = 0")))
        assert "Exchange" not in plan and "Bucketed: true" in plan
        flat = index.FlatIndex.build(tokens).save(str(tmp_path / "f"))
        plan = _plan(search.packed_scores(search.packed(q, "qid", "qpos"), flat.docs.select("pid", "vecs"), k=5))
        assert "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("bound", [1 << 26, 4000])
def test_best_of_shards_are_those_of_all_pairs(spark, monkeypatch, whole, bound):
    """Against a loop over all pairs: ids that repeat in a text, tokens without an id, texts without a whole vector, ties, several shards, tiles and blocks."""
    tokens = _tokens(spark, 60, 6, vocabulary=4).withColumn("vec", F.transform("vec", lambda x: F.round(x, 1)))
    tokens = tokens.withColumn("token_id", F.when(F.col("pid") % 7 != 3, F.col("token_id")))
    copies = tokens.filter("pid < 5").withColumn("pid", F.col("pid") + 500)
    tokens = tokens.unionByName(copies).cache()
    firsts = tokens.filter("pos = 0 AND pid % 10 <> 9")
    q = tokens.filter("pid % 4 = 0").select(F.col("pid").alias("qid"), F.col("pos").alias("qpos"), "token_id", "vec")
    asked = q.filter("qpos = 0 AND qid % 8 = 0")
    for name, value in (("SHARD", 50), ("QUERY_BYTES", bound), ("DOC_BYTES", 20_000), ("TILE_BYTES", 8 * 64)):
        monkeypatch.setattr(search, name, value)
    docs, queries, texts, wholes = {}, {}, {r.pid: np.array(r.vec) for r in firsts.collect()}, {r.qid: np.array(r.vec) for r in asked.collect()}
    for r in tokens.collect():
        docs.setdefault(r.pid, []).append((r.token_id, np.array(r.vec)))
    for r in q.collect():
        queries.setdefault(r.qid, []).append((r.token_id, np.array(r.vec)))
    want = []
    for qid, rows in queries.items():
        scores = []
        for pid, words in docs.items():
            met = [max(0.0, max(float(v @ w) for u, w in words if u == t)) for t, v in rows if t is not None and any(u == t for u, _ in words)]
            if pid != qid and (qid in wholes and pid in texts if whole else met):
                scores.append((round(sum(met) + (float(wholes[qid] @ texts[pid]) if whole else 0.0), 6), pid))
        want += [(qid, pid, s, i + 1) for i, (s, pid) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:3])]
    found = search.lexical_best(q, tokens, 3, (asked, firsts) if whole else None)
    got = _rows(search.top_k(found, 3, ["qid"], F.desc("score"), F.asc("pid")))
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in sorted(want, key=lambda r: (r[0], r[1]))]
    assert np.allclose([r[2] for r in got], [r[2] for r in sorted(want, key=lambda r: (r[0], r[1]))], atol=2e-6)
    assert search.lexical_best(q.limit(0), tokens, 3).isEmpty() and search.lexical_best(q, tokens.limit(0), 3).isEmpty()


def test_products_stay_under_the_bound(spark, monkeypatch):
    rng, made = np.random.default_rng(1), []
    monkeypatch.setattr(search, "_dots", lambda a, b: made.append(len(a) * len(b)) or a @ b.T)
    rows, words = rng.standard_normal((40, 8)), rng.standard_normal((500, 8))
    lengths = np.array([1, 200, 3, 250, 46])
    owner = np.repeat(np.arange(5), lengths)
    got = search.best_of_documents(rows, words, owner, 5, cells=400)
    assert max(made) <= 400
    full = rows @ words.T
    want = np.stack([full[:, owner == i].max(axis=1) for i in range(5)], axis=1)
    assert np.allclose(got, want)
    place = np.concatenate([np.arange(n) for n in lengths])
    found = search.places_of_best(rows, words, owner, place, 5, cells=400)
    assert (found == np.stack([np.round(full[:, owner == i], 6).argmax(axis=1) for i in range(5)], axis=1)).all()


def test_tiles_and_a_bounded_k_change_nothing(spark, monkeypatch):
    tokens = _tokens(spark, 60)
    q = _asked(tokens, 9)
    calls = lambda: [
        _rows(search.top_k(search.exact_scores(q, tokens, k=4), 4, ["qid"], F.desc("score"), F.asc("pid"))),
        _rows(search.token_neighbours(q, tokens, 3)),
        _rows(search.top_k(search.single_vector(q.filter("qpos = 0"), tokens.filter("pos = 0"), k=4), 4, ["qid"], F.desc("score"), F.asc("pid"))),
        _rows(search.best_positions(q, tokens, F.col("qpos") % 2 == 1)),
        _rows(search.masked_maxsim(q, tokens, F.col("pos") != 1, F.col("qpos") != 2)),
        _rows(search.rerank(q.select("qid").distinct().crossJoin(tokens.select("pid").distinct()), q, tokens)),
    ]
    want = calls()
    full = search.exact_scores(q, tokens)
    assert want[0] == _rows(search.top_k(full, 4, ["qid"], F.desc("score"), F.asc("pid")))
    monkeypatch.setattr(search, "TILE_BYTES", 8 * 3)
    monkeypatch.setattr(search, "ASKERS", 2)
    assert calls() == want
    per_task = search.exact_scores(q, tokens.repartition(4, "pid"), k=2).withColumn("task", F.spark_partition_id()).groupBy("task", "qid").count()
    assert per_task.agg(F.max("count")).first()[0] <= 2


def test_ties_at_the_bound_go_by_id(spark):
    tokens = spark.createDataFrame([(i, 0, 0, [1.0, 0.0]) for i in range(50)], "pid bigint, pos bigint, token_id bigint, vec array<double>")
    q = spark.createDataFrame([(99, 0, 0, [1.0, 1.0])], "qid bigint, qpos bigint, token_id bigint, vec array<double>")
    for falls, want in ((False, [0, 1, 2]), (True, [49, 48, 47])):
        order = F.desc("pid") if falls else F.asc("pid")
        hits = search.top_k(search.exact_scores(q, tokens, k=3, falls=falls), 3, ["qid"], F.desc("score"), order)
        assert [r.pid for r in hits.orderBy("rank").collect()] == want


def test_order_of_skewed_keys(spark):
    keys = [*range(20_000), 1 << 60, -(1 << 61)]
    rows = spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(5)
    sizes = [r["count"] for r in batches._ranged(rows, "k", 1000).groupBy("__range").count().collect()]
    assert max(sizes) <= 2 * len(keys) / len(sizes) and len(sizes) >= 15
    got = {r.k: r["at"] for r in batches.in_order(rows, "k", 1000).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    weighted = batches.running(spark.createDataFrame([(3, 5), (1, 2), (2, 10)], "k bigint, w bigint"), "k", F.col("w"), 1)
    assert {r.k: r["at"] for r in weighted.collect()} == {1: 0, 2: 2, 3: 12}


def test_chunks_run_over_texts(spark):
    rng = np.random.default_rng(2)
    texts = [list(map(int, rng.integers(0, 99, int(n)))) for n in [0, 1, 2, 40, 3, 3, 0, 17, 5, 1, 30, 2]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc bigint, ids array<bigint>").repartition(4)
    want = []
    for b in range(0, len(texts), 5):
        flat = sum(texts[b : b + 5], [])
        want += [(b // 5, i // 7, flat[i : i + 7]) for i in range(0, len(flat) // 7 * 7, 7)]
    assert sorted((r.batch, r.chunk, r.ids) for r in batches.chunked(rows, 7, "doc", batch=5).collect()) == want
    assert batches.chunked(rows.limit(0), 7, "doc").count() == 0


def test_next_other_is_linear_and_right(spark):
    rng = np.random.default_rng(3)
    docs = sorted(set(map(int, rng.integers(0, 3000, 900))))
    pairs = [(q, int(d)) for q in range(4) for d in rng.choice(docs, 300 * (q + 1) // 2, replace=False)]
    frame = spark.createDataFrame(pairs, "qid bigint, pid bigint")
    got = _rows(corpus.next_other(frame, spark.createDataFrame([(d,) for d in docs], "pid bigint")))
    want = []
    for q in range(4):
        mine = {d for x, d in pairs if x == q}
        for p in mine:
            after = next((d for d in docs if d > p and d not in mine), None)
            want += [(q, p, after)] if after is not None else []
    assert got == sorted(want)


def test_held_out_share_quantiles_and_mean(spark):
    tokens = _tokens(spark, 200, 10)
    assert residual.held_out(tokens).count() == 100 and residual.held_out(tokens.limit(3)).count() == 1
    x = np.round(np.random.default_rng(5).standard_normal(5001), 2)
    values = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    at = [0.0, 0.125, 0.5, 0.77, 1.0]
    assert residual.quantiles(values, at) == pytest.approx(np.quantile(x, at).tolist())
    assert residual.quantiles(values.limit(0), [0.5]) == [None]
    scores = spark.createDataFrame([(float(i),) for i in range(17)], "score double")
    assert losses.validation_mean(scores).first().mean == 8.0


@pytest.mark.parametrize("bounds", [(100, 1 << 26), (100, 100)])
def test_cascade_beyond_the_bound_of_a_product(spark, monkeypatch, bounds):
    """Blocks of queries, then of centroids too, give what one block gives; before, documents without vectors failed in blocks."""
    tokens = _tokens(spark, 200)
    q, centroids = _asked(tokens), tokens.filter("pid % 7 = 0 AND pos = 0").select((F.col("pid") / 7).cast("int").alias("cid"), "vec")
    codes = residual.assign(tokens, centroids).groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("pos", "cid"))).alias("e")).select("pid", F.col("e.cid").alias("cids"))
    ivf = codes.select("pid", F.explode(F.array_distinct("cids")).alias("cid"))

    def both():
        return [sorted(map(tuple, x.select("qid", "pid", "score", "rank").collect())) for x in residual.cascade(q, centroids, ivf, codes, 2, 0.3, 20)]

    want = both()
    assert all(want)
    monkeypatch.setattr(search, "QUERY_BYTES", bounds[0])
    monkeypatch.setattr(residual, "QUERY_BYTES", bounds[1])
    monkeypatch.setattr(search, "DOC_BYTES", 2000)
    monkeypatch.setattr(search, "TILE_BYTES", 1 << 12)
    monkeypatch.setattr(residual, "TILE_BYTES", 1 << 12, raising=False)
    for got, known in zip(both(), want, strict=True):
        assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in known]
        assert [r[2] for r in got] == pytest.approx([r[2] for r in known], abs=2e-6)


def test_slots_of_large_integer_keys(spark):
    """Cells beyond the 2047th; their slots did not fit an int before."""
    rows = spark.createDataFrame([(5000, 1), (5000, 2), (3, 4)], "cid int, pid bigint")
    found, cuts = search.blocks(rows, "cid", 1, ["pid"], F.col("pid"))
    asked = search.slots(rows.select("cid").distinct(), cuts, "cid")
    assert sorted(p for r in asked.join(found, "slot").collect() for p in r.entries) == [1, 2, 4]


def test_best_rows_are_not_cut_anew_for_each_query(spark, monkeypatch):
    """A cut sorts what a task holds; before, each query of a batch had one, so it grew with the square of the queries."""
    seen, best = spark.sparkContext.accumulator(0), search.best_rows

    def counted(*arguments):
        cut = best(*arguments)
        return lambda rows: seen.add(1) or cut(rows)

    monkeypatch.setattr(residual, "best_rows", counted)
    tokens = _tokens(spark, 200).coalesce(1)
    q, centroids = tokens.filter("pid % 2 = 0").select(F.col("pid").alias("qid"), F.col("pos").alias("qpos"), "vec"), tokens.filter("pid % 7 = 0 AND pos = 0").select((F.col("pid") / 7).cast("int").alias("cid"), "vec")
    docs = residual.assign(tokens, centroids).groupBy("pid").agg(F.collect_list("cid").alias("cids"))
    docs = store.stored(docs.withColumn("wanted", F.array(*[F.lit(i).cast("bigint") for i in range(0, 200, 2)])).coalesce(1))
    want = _rows(residual.filtered(q, centroids, docs, 0.3, 20)[0])
    assert len(want) == 100 * 20 and seen.value < 10
    monkeypatch.setattr(search, "HELD_ROWS", 30)
    assert _rows(residual.filtered(q, centroids, docs, 0.3, 20)[0]) == want


def test_residual_index_assigns_each_token_once(spark, monkeypatch):
    """Before, the postings' counts and groups and the codes each met the centroids anew."""
    seen, meet = spark.sparkContext.accumulator(0), residual.compress

    def counted(rest, codec):
        def add(parts):
            for part in parts:
                seen.add(part.num_rows)
                yield part

        return meet(rest.mapInArrow(add, rest.schema), codec)

    monkeypatch.setattr(residual, "compress", counted)
    tokens = _tokens(spark, 60)
    centroids = tokens.filter("pid % 7 = 0 AND pos = 0").select((F.col("pid") / 7).cast("int").alias("cid"), "vec")
    codec = residual.codec(residual.residuals(residual.assign(tokens, centroids)), 2)
    index.ResidualIndex.build(tokens, centroids, codec).save(store.scratch(spark))
    assert seen.value == tokens.count()


def test_best_of_documents_by_layers_and_by_stretches(monkeypatch):
    rng, lengths = np.random.default_rng(3), np.array([3, 0, 1, 7, 3, 2])
    words, rows, owner = rng.standard_normal((16, DIM)), rng.standard_normal((80, DIM)), np.repeat(np.arange(6), lengths)
    for use in (None, rng.random(16) > 0.4):
        for cells in (100, 1 << 20):
            layers = search.best_of_documents(rows, words, owner, 6, cells, use)
            with monkeypatch.context() as m:
                m.setattr(search, "LAYERS", 0)
                assert np.allclose(layers, search.best_of_documents(rows, words, owner, 6, cells, use))
        assert np.isneginf(layers[:, 1]).all()


@pytest.mark.parametrize("bound", [1 << 26, 100])
def test_positives_with_their_next_negatives(spark, monkeypatch, bound):
    """What losses take from all pairs, over several ranges of documents, in rows of positives alone; before, every pair was sorted."""
    tokens = _tokens(spark, 60, vocabulary=3).repartition(5)
    tokens = tokens.unionByName(tokens.filter("pid IN (9, 12) AND pos = 0")).filter("NOT (pid > 40 AND token_id = 1)")  # kinds met twice; no kind at all
    q = tokens.filter("pid % 5 = 0").select(F.col("pid").alias("qid"), F.col("pos").alias("qpos"), "token_id", "vec")
    every = search.judged_scores(q, tokens).withColumn("score", F.col("score") / 10)
    want = losses.next_negatives(every).filter("rel = 1")
    monkeypatch.setattr(search, "POSTINGS", 40)
    monkeypatch.setattr(search, "QUERY_BYTES", bound)
    monkeypatch.setattr(search, "DOC_BYTES", 4000)
    found = search.judged_positives(q, tokens, divisor=10)
    got = losses.next_negatives(found).filter("rel = 1")
    columns = ["qid", "pid", "score", "neg_score"]
    flat = lambda rows: sorted(tuple(round(x or 99, 5) for x in r) for r in rows.select(columns).collect())
    assert flat(got) == flat(want) and len(flat(want)) > 100
    assert found.filter("rel = 0").count() < every.filter("rel = 0").count() / 3
    assert losses.mixed_of_scores(found, 1.0, 0.5).first().loss == pytest.approx(losses.mixed_of_scores(every, 1.0, 0.5).first().loss, abs=2e-6)

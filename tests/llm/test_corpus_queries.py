"""Every registered corpus query and the pipeline, on hard and on empty tables."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import language, queries, toxicity

rng = random.Random(17)
WORDS = ["".join(rng.choice("aeioulrstn") for _ in range(rng.randint(2, 9))) for _ in range(300)]
TYPES = {
    "documents": [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("score", pa.string())],
    "labels": [("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())],
    "embeddings": [("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32()), ("n", pa.string())],
    "pages": [("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("text", pa.int32())],
    "conversations": [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("leaf", pa.string())],
}
COLUMNS = {
    "op1": ["vec_id", "n_links", "component_id", "kept"],
    "op2": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op3": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op4": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op5": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op6": ["doc_id", "held_out", "lang_pred", "score"],
    "op7": ["doc_id", "fingerprint", "component_id"],
    "op8": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op9": ["page_id", "url", "text", "n_chars"],
    "op10": ["doc_id", "held_out", "score", "predicted"],
    "op11": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op12": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    "op13": ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
}


def _said(n, *more):
    return " ".join([*(rng.choice(WORDS) for _ in range(n)), *more])


def _documents():
    texts = [_said(rng.randint(20, 300)) for _ in range(120)]
    texts += [t.replace(" ", "\n", 3) for t in texts[:10]] + texts[10:15]  # exact copies
    texts += [_near(t) for t in texts[20:30]]
    texts += [_said(60, *["blockhead"] * 3) for _ in range(30)]
    texts += [None, "", " \n", "12 - 3", "!", "a", "é 漢字 😀", _said(60_000), "x" * 200_000]
    rows = [(i, t, rng.choice(["aa", "bb", None]), None, None, "s") for i, t in enumerate(texts)]
    return [*rows, (3, texts[3], "aa", None, None, "t"), (7, texts[70], None, None, None, None), (None, _said(50), "aa", "q", 1, "u"), (None, texts[33], None, None, None, None)]


def _near(text):
    words = text.split(" ")
    words[len(words) // 2] = "another"
    return " ".join(words)


def _tables():
    docs = _documents()
    toxic = [(r[0], 1, int("blockhead" in (r[1] or ""))) for r in docs if r[0] is not None and r[0] % 5]
    x = [[float(v) for v in np.random.default_rng(i // 2).standard_normal(16)] for i in range(60)]
    vectors = [(i, v, i % 3 if i % 10 else None, "x") for i, v in enumerate(x)] + [(0, x[5], 1, None), (None, x[0], 1, None), (99, None, 1, None), (98, [0.0, float("nan")], 1, None)]
    page = lambda i: f"<nav>{i}</nav><div>Same</div><article><p>Text {i}</p></article>"
    pages = [(i, f"http://h.example/{i}", page(i), 1) for i in range(9)] + [(9, None, None, None), (None, "::", "", 1), (3, "http://h.example/3", page(3), 2), (10, "x", "<p>" + "word " * 60_000, 3)]
    talks = [(i % 9, i // 9, rng.choice(["user", "assistant", None]), rng.choice(["hi", "<\\", None, "y" * 30_000]), "z") for i in range(60)]
    talks += [(None, 0, "user", "hi", None), (None, None, None, None, None), (1, 0, "user", "hi", "z"), (2, None, "user", "late", "z")]
    return {"documents": docs, "labels": [*toxic, (None, 0, 1), (3, 0, None), (100_000, 1, 1)], "embeddings": vectors, "pages": pages, "conversations": talks}


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    where, tables = tmp_path_factory.mktemp("tables"), _tables()
    for kind in ("hard", "empty"):
        (where / kind).mkdir()
        for name, types in TYPES.items():
            rows = tables[name] if kind == "hard" else []
            arrays = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(types)]
            pq.write_table(pa.Table.from_arrays(arrays, [n for n, _ in types]), where / kind / f"{name}.parquet")
    return where, tables


@pytest.mark.parametrize("name", sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0])))
def test_query_on_hard_and_empty_tables(spark, data, name):
    where, tables = data
    frame = queries.queries()[name](spark, f"{where}/hard")
    op = name.split("_")[0]
    assert frame.columns == COLUMNS[op]
    got = frame.collect()
    if op == "op5":
        assert len(got) == 9 + 2 + 1
    elif op == "op8":
        assert sum(r.length for r in got if r.start == 0) and {r.doc_id for r in got} == {r[0] for r in tables["documents"]}
    elif op == "op12":
        assert len(got) == 8 * 62 and {r.n for r in got} == {62}
    elif op == "op13":
        assert len(got) == 600 * 3 and all(r.kept + r.removed >= 0 for r in got)
        assert sum(r.kept + r.removed for r in got if r.filter_order == "ABCDE" and r.step == 1) == len(tables["documents"])
    else:
        source = {"op1": "embeddings", "op9": "pages"}.get(op, "documents")
        assert sorted((repr(r[0]) for r in got)) == sorted(repr(r[0]) for r in tables[source])
    assert queries.queries()[name](spark, f"{where}/empty").count() == (op == "op5")


def _fingerprint(text):
    import re

    import xxhash

    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    total = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) if hashes else np.zeros(64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def test_pipeline_equals_brute_force(spark, data):
    where, tables = data
    docs = spark.read.parquet(f"{where}/hard/documents.parquet")
    lexicon = toxicity.learned(docs, spark.read.parquet(f"{where}/hard/labels.parquet"))
    rows = [r for r in tables["documents"] if lexicon.score(r[1]) < 0.3]
    assert 0 < len(tables["documents"]) - len(rows) <= 31
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    last = lambda r: (r[0] is None, r[0])
    groups = {}
    for r in rows:
        groups.setdefault("".join(c for c in r[1] if c not in " \t\n\r\x0b\x0c"), []).append(r)
    rows = [min(g, key=lambda r: (-len(r[1]), *last(r))) for g in groups.values()]
    prints, kept = {id(r): _fingerprint(r[1]) for r in rows}, []
    while rows:
        found, todo = [], [rows[0]]
        while todo:
            x = todo.pop()
            if x in rows:
                rows.remove(x)
                found.append(x)
                todo += [y for y in rows if (prints[id(x)] ^ prints[id(y)]).bit_count() <= 4]
        kept.append(min(found, key=lambda r: (*last(r), prints[id(r)] - (prints[id(r)] >> 63 << 64))))
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    sizes = sorted(((r[0], len(encode(r[1], add_special_tokens=False).ids) + 1) for r in kept), key=repr)
    pieces = corpus_pipeline.run(spark, f"{where}/hard").collect()
    assert sorted({(p.doc_id, p.doc_tokens) for p in pieces}, key=repr) == sorted(set(sizes), key=repr)
    assert sum(p.length for p in pieces) == sum(n for _, n in sizes)
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for ps in by_sequence.values():
        ends = np.cumsum([p.length for p in sorted(ps, key=lambda p: p.offset)])
        assert [p.offset for p in sorted(ps, key=lambda p: p.offset)] == [0, *ends[:-1]] and int(ends[-1]).bit_count() == 1 and ends[-1] <= 4096


def test_pipeline_stages_keep_columns_and_take_empty_tables(spark, data):
    where, _ = data
    for kind in ("hard", "empty"):
        docs = spark.read.parquet(f"{where}/{kind}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, f"{where}/{kind}").columns == docs.columns
    assert corpus_pipeline.run(spark, f"{where}/empty").count() == 0


def test_pipeline_scores_each_text_once(spark, data):
    where, _ = data
    final = corpus_pipeline.run(spark, f"{where}/hard")
    plan = final._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("MapInArrow") == 1


def test_exact_digest_of_op2_is_of_the_normalised_text(spark, data):
    where, tables = data
    got = sorted((repr(r.doc_id), r.text_sha256) for r in queries.op2_exact_dedup(spark, f"{where}/hard").collect())
    assert got == sorted((repr(r[0]), hashlib.sha256("".join((r[1] or "").split(" ")).replace("\n", "").encode()).hexdigest()) for r in tables["documents"])


def test_language_filter_and_prediction_agree(spark, data):
    docs = spark.read.parquet(f"{data[0]}/hard/documents.parquet")
    said = {(r.doc_id, r.lang_pred) for r in language.identify(docs).collect() if r.lang_pred != "und"}
    assert {r.doc_id for r in language.keep_identified(docs).collect()} == {i for i, _ in said}

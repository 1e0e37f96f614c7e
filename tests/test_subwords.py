"""Vocabulary subwords against a plain walk, and what models are given of them."""

import json
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.functions import subwords
from tessera.functions import text as T
from tessera.operators import batches

PATH = public_tokenizers.path("word_bpe_49k.json")
VOCABULARY = json.load(open(PATH, encoding="utf-8"))["model"]["vocab"]


def _plain(word):
    """Letter by letter, without tables of the library."""
    shown = {}
    for b in range(256):
        shown[b] = chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b else chr(256 + len([x for x in shown.values() if ord(x) > 255]))
    rest, out = "".join(shown[b] for b in word.lower().encode()), []
    while rest:
        whole = rest + "</w>"
        if whole in VOCABULARY:
            return [*out, whole]
        piece = next(rest[:n] for n in range(len(rest) - 1, 0, -1) if rest[:n] in VOCABULARY and not rest[:n].endswith("</w>"))
        out.append(piece)
        rest = rest[len(piece) :]
    return out


def test_pieces_of_all_documents_equal_a_plain_walk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", T.words(F.col("text")).alias("words"))
    known = {}
    for r in docs.select("doc_id", "words", subwords.pieces(F.col("words"), PATH).alias("p")).collect():
        want = []
        for i, w in enumerate(r.words):
            if w not in known:
                known[w] = _plain(w)
            want += [(i, j, p, VOCABULARY[p]) for j, p in enumerate(known[w])]
        assert [tuple(x) for x in r.p] == want


def test_hard_words(spark):
    rng = random.Random(4)
    words = ["a</w>b", "</w>", "😀é漢", "x" * 5000, "\x00", "­", "don't", *["".join(rng.choice("aeß</w>é#\x7f") for _ in range(rng.randint(1, 30))) for _ in range(200)]]
    rows = spark.createDataFrame([(1, words), (2, []), (3, None), (4, ["a"])], "k int, words array<string>").repartition(1)
    got = {r.k: r.p for r in rows.select("k", subwords.pieces(F.col("words"), PATH).alias("p")).collect()}
    assert got[2] == [] and got[3] is None and [x.piece for x in got[4]] == ["a</w>"]
    assert {r.k: r.p for r in subwords.with_pieces(rows, "words", PATH).collect()} == got
    assert [(x.word, x.piece) for x in got[1]] == [(i, p) for i, w in enumerate(words) for p in _plain(w)]


def test_specials_markers_truncation_and_padding(spark):
    rows = spark.createDataFrame([(1, "The house"), (2, None), (3, "word " * 40)], "k int, text string")

    def encode(**more):
        t = subwords.Tokenizer(PATH, **more)
        return {r.k: r.e for r in rows.select("k", t.encode(t.words(F.col("text"))).alias("e")).collect()}

    the, house, word, mark = (VOCABULARY[x + "</w>"] for x in ("the", "house", "word", "q"))
    plain = encode(marker="q")
    assert plain[1].input_ids == [49406, mark, the, house, 49407] and plain[1].word_ids == [None, 0, 1, 2, None] and plain[1].attention == [1] * 5
    assert plain[2].input_ids == [49406, mark, 49407]
    cut = encode(longest=6, pad=True, pad_id=7)
    assert cut[3].input_ids == [49406, word, word, word, word, 49407] and cut[3].word_ids == [None, 0, 1, 2, 3, None]
    assert cut[1].input_ids == [49406, the, house, 49407, 7, 7] and cut[1].word_ids == [None, 0, 1, None, None, None] and cut[1].attention == [1, 1, 1, 1, 0, 0]
    assert encode(special=False, longest=2)[3].input_ids == [word, word]
    t = subwords.Tokenizer(PATH, marker="[D]")
    assert rows.limit(1).select(t.marked(F.array(F.lit("a"))).alias("w")).first().w == ["[D]", "a"]


@pytest.mark.parametrize(("first_only", "want"), [(True, [-100, 5, -100, 0, -100]), (False, [-100, 5, 5, 0, -100])])
def test_labels_follow_words(spark, first_only, want):
    rows = spark.createDataFrame([([None, 0, 0, 1, None], ["B-PER", "O"])], "w array<int>, t array<string>")
    assert rows.select(subwords.aligned(F.col("w"), F.col("t"), first_only=first_only).alias("l")).first().l == want


def test_ids_alone_equal_those_of_pieces(spark):
    rows = spark.createDataFrame([(1, ["One", "two2", "\u00e9t\u00e9"]), (2, []), (3, None), (4, ["x" * 90, "One"])], "doc bigint, words array<string>")
    want = {r.doc: r.p and [x.token_id for x in r.p] for r in subwords.with_pieces(rows, "words", PATH).collect()}
    assert {r.doc: r.ids for r in subwords.with_ids(rows, "words", PATH).collect()} == want


def test_lists_are_made_once_for_batches_and_chunks(spark):
    """Before, each count, range and window over the numbered rows made the lists anew."""
    made = spark.sparkContext.accumulator(0)

    def run(parts):
        for part in parts:
            made.add(part.num_rows)
            yield part

    lists = [(7 * i % 50, [i] * (i % 5)) for i in range(50)] + [(9, [99]), (None, [1])]
    rows = spark.createDataFrame(lists, "doc bigint, ids array<int>").mapInArrow(run, "doc bigint, ids array<int>")
    got = batches.padded_batches(rows, 8, "doc", "ids", 0).collect()
    assert made.value == len(lists)
    docs = sorted(d for d, _ in lists if d is not None)
    assert sorted(r.doc for r in got) == docs[:48] and {r.batch for r in got} == set(range(6))
    for b in range(6):
        some = [r.ids for r in got if r.batch == b]
        assert len({len(x) for x in some}) == 1 and any(0 not in x or len(x) == sum(i == 0 for i in x) for x in some)
    assert batches.chunked(rows, 4, "doc", batch=10).count() > 0
    assert made.value == 2 * len(lists)

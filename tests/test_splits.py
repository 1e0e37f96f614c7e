"""Large files in many tasks against readers that take them whole."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import files, splits

SCHEMA = "a bigint, b string, c string"


def _cell(rng):
    return "".join(rng.choice('ab \t\n"é\\') for _ in range(rng.randint(0, 12)))


def _tsv(rng, rows):
    out = io.StringIO()
    writer = csv.writer(out, delimiter="\t", lineterminator="\n")
    for r in rows:
        writer.writerow(r)
    return out.getvalue()


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "24"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def test_line_ends_and_fields():
    for line, want in (("a\tb", False), ('a\t"b', True), ('"a""', True), ('"a"""', False), ('5" pipe\tx', False), ('a\t"b"\tc', False), ('"', True)):
        assert splits.tsv_ends(line, False) is want
    assert splits.tsv_ends('b"\tc', True) is False and splits.tsv_ends("x", True) and splits.tsv_ends('b"\t"c', True)
    assert splits.tsv_fields('1\t"a ""b""\tc"\t\t5" x') == ["1", 'a "b"\tc', None, '5" x']
    assert splits.json_ends(r'{"a": ["x\"', False) and not splits.json_ends(r'"a\\"', False)


@pytest.mark.parametrize("seed", [1, 2])
def test_one_file_in_many_tasks_equals_whole_readers(spark, tmp_path, small_blocks, seed):
    rng = random.Random(seed)
    rows = [(i, _cell(rng), "x" * rng.choice([1, 1, 1, 300])) for i in range(400)]
    path = tmp_path / "t.tsv"
    path.write_text(_tsv(rng, rows), encoding="utf-8", newline="")
    got = splits.read_quoted(spark, str(path), SCHEMA, position=True)
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 15
    ordered = [(r.a, r.b, r.c) for r in got.orderBy("at").collect()]
    plain = list(csv.reader(io.StringIO(path.read_text(encoding="utf-8"), newline=""), delimiter="\t"))
    assert ordered == [(int(a), b or None, c) for a, b, c in plain] and len(ordered) == 400
    whole = spark.read.csv(str(path), sep="\t", quote='"', escape='"', multiLine=True, schema=SCHEMA)
    assert sorted(map(tuple, whole.select("a", "c").collect())) == sorted((a, c) for a, _, c in ordered)


def test_last_row_wins_across_blocks_and_files_end_anywhere(spark, tmp_path, small_blocks):
    (tmp_path / "p.tsv").write_text("".join(f"{i % 7}\tpassage {i}\r\n" for i in range(200)) + "\n\n8\tlast")
    assert {r.pid: r.text for r in files.read_passages(spark, f"{tmp_path}/p.tsv").collect()} == {i: f"passage {max(k for k in range(200) if k % 7 == i)}" for i in range(7)} | {8: "last"}
    (tmp_path / "open.tsv").write_text('1\tx\n2\t"never\nclosed\n')
    assert sorted(map(tuple, files.read_tsv(spark, f"{tmp_path}/open.tsv", "a int, b string").collect())) == [(1, "x"), (2, "never\nclosed")]
    (tmp_path / "none.tsv").write_text("")
    assert files.read_tsv(spark, f"{tmp_path}/none.tsv", "a int").count() == 0
    (tmp_path / "odd.tsv").write_text("no number\tb\tmore\textra\n5\n")
    assert sorted(map(tuple, files.read_tsv(spark, f"{tmp_path}/odd.tsv", SCHEMA).collect()), key=repr) == [(5, None, None), (None, "b", "more")]


@pytest.mark.parametrize("indent", [None, 2])
def test_one_json_object_in_many_tasks(spark, tmp_path, small_blocks, indent):
    rng = random.Random(3)
    tags = {str(i): [rng.choice(["O", "B-PER", "x]y", 'q"]\\', "é"]) for _ in range(rng.randint(0, 20))] for i in range(300)}
    (tmp_path / "tags.json").write_text(json.dumps(tags, indent=indent))
    got = files.read_tags(spark, f"{tmp_path}/tags.json")
    assert {r.pid: r.tags for r in got.collect()} == {int(k): v for k, v in tags.items()}
    (tmp_path / "empty.json").write_text("{}")
    assert files.read_tags(spark, f"{tmp_path}/empty.json").count() == 0
    assert got.select(F.max("pid")).first()[0] == 299

"""Records of one large file, read by many tasks, although a quoted separator ends no record.

Spark cuts a file into blocks of lines (or of what another separator ends).
Whether a block begins inside quotes depends on all before it, but each line
maps "begins inside" to "ends inside", and so does a block as a whole. A first
pass folds every block into that map of two values; the maps of a file, one row
a block, are chained; a second pass then puts records together. What a block
has of a record that began before it, or that goes on after it, is joined with
its other pieces at the end, two pieces a block at most.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: (line, begins inside quotes) -> ends inside quotes.
Ends = Callable[[str, bool], bool]
WHOLE, FIRST, MIDDLE, LAST = range(4)


def tsv_ends(line: str, inside: bool, sep: str = "\t") -> bool:
    """Quotes count at the beginning of a field only, and double inside of one."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if not inside:
            if not line.startswith('"', at):
                at = line.find(sep, at) + 1
                if not at:
                    return False
                continue
            at, inside = at + 1, True
        at = line.find('"', at)
        if at < 0:
            return True
        if line.startswith('""', at):
            at += 2
            continue
        inside = False
        at = line.find(sep, at) + 1
        if not at:
            return False


def tsv_fields(record: str, sep: str = "\t") -> list[str | None]:
    """The fields of a record; an empty one without quotes is null."""
    out, at = [], 0
    while True:
        if record.startswith('"', at):
            parts, at = [], at + 1
            while True:
                stop = record.find('"', at)
                parts.append(record[at:] if stop < 0 else record[at:stop])
                if stop < 0 or not record.startswith('""', stop):
                    break
                parts.append('"')
                at = stop + 2
            end = len(record) if stop < 0 else record.find(sep, stop)
            rest = "" if stop < 0 else record[stop + 1 : end if end >= 0 else len(record)]
            out.append("".join(parts) + rest)
        else:
            end = record.find(sep, at)
            out.append(record[at : end if end >= 0 else len(record)] or None)
        if end < 0 or end >= len(record):
            return out
        at = end + 1


def json_ends(part: str, inside: bool) -> bool:
    """Quotes count unless a backslash is before them."""
    at = part.find('"')
    while at >= 0:
        back = at
        while back and part[back - 1] == "\\":
            back -= 1
        if (at - back) % 2 == 0:
            inside = not inside
        at = part.find('"', at + 1)
    return inside


def records(spark: SparkSession, path: str, sep: str, ends: Ends) -> DataFrame:
    """(file, block, n, record): what ``sep`` ends outside quotes, by file, block of its beginning and number there."""
    lines = spark.read.option("lineSep", sep).text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    maps = lines.mapInArrow(lambda parts: _folded(parts, ends), "file string, block bigint, out boolean, `in` boolean")
    opened = maps.groupBy("file").applyInPandas(_chained, "file string, block bigint, opened boolean")
    # A row for each block that Spark cuts a file into.
    placed = lines.join(F.broadcast(opened), ["file", "block"]).select("file", "block", "opened", "value")
    schema = "file string, block bigint, n bigint, kind int, record string"
    found = placed.mapInArrow(lambda parts: _assembled(parts, ends, sep), schema)
    pieces = found.filter(F.col("kind") != WHOLE).groupBy("file")
    across = pieces.applyInPandas(lambda group: _stitched(group, sep), "file string, block bigint, n bigint, record string")
    return found.filter(F.col("kind") == WHOLE).drop("kind").unionByName(across)


def _folded(parts: Iterator[pa.RecordBatch], ends: Ends) -> Iterator[pa.RecordBatch]:
    """The map of each block: what it ends as when it begins outside, and inside quotes."""
    row = lambda key, a, b: pa.RecordBatch.from_pydict({"file": [key[0]], "block": [key[1]], "out": [a], "in": [b]})
    now, a, b = None, False, True
    for part in parts:
        for *key, value in zip(*[part.column(c).to_pylist() for c in ("file", "block", "value")], strict=True):
            if key != now:
                if now:
                    yield row(now, a, b)
                now, a, b = key, False, True
            a, b = ends(value, a), ends(value, b)
    if now:
        yield row(now, a, b)


def _chained(group: pd.DataFrame) -> pd.DataFrame:
    group, inside, opened = group.sort_values("block"), False, []
    for out, in_ in zip(group["out"], group["in"], strict=True):
        opened.append(inside)
        inside = bool(in_ if inside else out)
    return pd.DataFrame({"file": group["file"], "block": group["block"], "opened": opened})


def _assembled(parts: Iterator[pa.RecordBatch], ends: Ends, sep: str) -> Iterator[pa.RecordBatch]:
    """Whole records of each block, and what it has of records that begin before it or go on."""
    now, held, inside, came, n, out = None, [], False, False, 0, []

    def put(kind: int) -> None:
        out.append((*now, n, kind, sep.join(held)))

    def batch() -> pa.RecordBatch:
        rows = list(zip(*out, strict=True)) if out else [[]] * 5
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["file", "block", "n", "kind", "record"])

    for part in parts:
        for *key, opened, value in zip(*[part.column(c).to_pylist() for c in ("file", "block", "opened", "value")], strict=True):
            if key != now:
                if held:
                    put(MIDDLE if came else FIRST)
                now, held, inside, came, n = key, [], opened, opened, 0
            held.append(value)
            inside = ends(value, inside)
            if not inside:
                put(LAST if came else WHOLE)
                held, came, n = [], False, n + 1
        if out:
            yield batch()
    if held:
        put(MIDDLE if came else FIRST)
    yield batch()


def _stitched(group: pd.DataFrame, sep: str) -> pd.DataFrame:
    """Records of several blocks; one that the file's end leaves open ends there."""
    group, done, held = group.sort_values(["block", "n"]), [], None
    for block, n, kind, text in zip(group["block"], group["n"], group["kind"], group["record"], strict=True):
        if kind == FIRST or held is None:
            if held is not None:
                done.append(held)
            held = [block, n, [text]]
        else:
            held[2].append(text)
        if kind == LAST:
            done.append(held)
            held = None
    if held is not None:
        done.append(held)
    return pd.DataFrame({"file": group["file"].iloc[0], "block": [d[0] for d in done], "n": [d[1] for d in done], "record": [sep.join(d[2]) for d in done]})


def read_quoted(spark: SparkSession, path: str, schema: str, sep: str = "\t", position: bool = False) -> DataFrame:
    """Rows of delimited text with quoted fields, in any number of tasks.

    Blank lines are left out, missing fields are null, further ones go, and
    what a type cannot hold is null. With ``position`` a column ``at`` says
    where a row stands: (file, block, n).
    """
    fields = StructType.fromDDL(schema).fields
    cells = F.col("cells")

    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [tsv_fields(r.removesuffix("\r"), sep) for r in part.column("record").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("file", "block", "n")], pa.array(found, pa.list_(pa.string()))], names=["file", "block", "n", "cells"])

    rows = records(spark, path, "\n", lambda line, inside: tsv_ends(line, inside, sep)).filter(F.rtrim("record") != "")
    rows = rows.mapInArrow(parse, "file string, block bigint, n bigint, cells array<string>")
    typed = [F.get(cells, i).try_cast(f.dataType).alias(f.name) for i, f in enumerate(fields)]
    return rows.select(*typed, *([F.struct("file", "block", "n").alias("at")] if position else []))


def read_object_of_lists(spark: SparkSession, path: str) -> DataFrame:
    """(key, values) of one JSON object whose values are lists of strings, in any number of tasks."""

    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            said = [r.strip().lstrip("{,").strip() for r in part.column("record").to_pylist()]
            found = [next(iter(json.loads("{" + r + "]}").items())) for r in said if r and r != "}"]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.list_(pa.string()))], names=["key", "values"])

    return records(spark, path, "]", json_ends).mapInArrow(parse, "key string, values array<string>")

"""Chat formatting with shared beginnings written once.

Template. A turn is ``<turn ROLE>`` + text + ``</turn>`` + a line feed. In
texts and roles each backslash and each ``<`` gets a backslash before it, so
no text can hold a control string, and reading back is exact.

Prefix tree. Conversations that begin with the same turns share the path of
those turns. The tree is written depth first into sequences, and every turn of
the tree is written exactly once in all of them, children after their parent.
Each turn carries where it lies in its sequence, the position its first
character has in its conversation (so position ids go on along the path, not
along the sequence) and what it attends to besides itself: intervals of its
sequence, neighbours joined to one, and before them the first ``above`` turns
of the sequence's ``context``. The context names, by node, the turns on the
path above the sequence's first one; they lie in earlier sequences. Loss covers
the assistant's texts.

Scale. A turn is named by the hash of its path, so equal beginnings meet by
sorting: equal conversations are collapsed, the others range-partitioned in
tree order and checkpointed. A task writes its range with one open path in
memory and begins a new sequence where the next turn would pass ``capacity``
characters. What a range shares with the one before is its first context, so
a first turn that a third of all conversations share is cut over many tasks
and still written once; the driver sees two paths of each task for that. Only
the turns of one conversation are ever collected together.

Defined cases. Null text and null role count as empty. Turns are ordered by
turn, then role, then text, nulls first; repeated rows are turns of their own.
Each row whose conversation id is null is a conversation of its own. An empty
table gives empty results. Other columns are ignored, whatever their names. A
turn longer than ``capacity`` is a sequence of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tessera.llm.runtime import checkpointed, joinable, looked_up

OPEN, SHUT, END = "<turn ", ">", "</turn>\n"
_SPECIAL = re.compile(r"[\\<]")
_UNDO = re.compile(r"\\(.)", re.DOTALL)
#: A role ends at the first ``>``, so that is escaped in roles, too.
_ROLE = re.compile(r"[\\<>]")
_TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*+)>((?:[^\\<]|\\.)*+)</turn>\n", re.DOTALL)

#: Characters of turns that are broadcast, at most.
MOST_CHARS = 32_000_000
SEQUENCE = """sequence string, context array<string>, text string, turns array<struct<node: string, parent: string, start: bigint, length: bigint,
    position: bigint, loss_start: bigint, loss_end: bigint, above: bigint, ancestors: array<struct<start: bigint, end: bigint>>, ends: bigint>>"""


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _UNDO.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and where its text starts and ends in it."""
    head = OPEN + _ROLE.sub(r"\\\g<0>", role) + SHUT
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; raises when the string is not all turns."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        out.append((unescape(m.group(1)), unescape(m.group(2))))
        at = m.end()
    return out


def names(turns: list[dict]) -> list[str]:
    """The node of each turn: a hash over it and all before it."""
    out, above = [], b""
    for t in turns:
        role, text = (hashlib.sha256(t[k].encode("utf-8", "surrogatepass")).digest() for k in ("role", "text"))
        above = hashlib.sha256(above + role + text).digest()
        out.append(above[:16].hex())
    return out


def paths(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, leaf, path, turns) of each conversation: the nodes of its turns, and the turns."""

    @arrow_udf("array<string>")
    def path(found: pa.Array) -> pa.Array:
        return pa.array([names(t) for t in found.to_pylist()], pa.list_(pa.string()))

    said = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    told = rows.select(F.col(conv).alias("conv"), F.when(F.col(conv).isNull(), F.monotonically_increasing_id()).alias("alone"), said.alias("said"))
    whole = told.groupBy("conv", "alone").agg(F.array_sort(F.collect_list("said")).alias("turns"))
    lines = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    named = whole.select("conv", lines.alias("turns")).withColumn("path", path("turns"))
    return named.select("conv", F.element_at("path", -1).alias("leaf"), "path", "turns")


class Writer:
    """Writes conversations in tree order into sequences.

    ``above`` is the part of the first conversation's path that was written
    before.
    """

    def __init__(self, capacity: int, above: list[str] = ()) -> None:
        self.capacity = capacity
        self.open: list[dict] = [{"node": n, "end": None, "seen": [], "above": i + 1} for i, n in enumerate(above)]
        self._begin()

    def _begin(self) -> None:
        """A new sequence below the open path, all of which lies in others."""
        for i, x in enumerate(self.open):
            x.update(seen=[], above=i + 1)
        self.context = [x["node"] for x in self.open]
        self.parts: list[str] = []
        self.size = 0
        self.turns: list[dict] = []
        self.known: dict[str, dict] = {}

    def add(self, path: list[str], turns: list[dict], ends: int) -> list[tuple]:
        """Writes what is new of one conversation; gives the sequences that are full."""
        shared = 0
        while shared < min(len(path), len(self.open)) and self.open[shared]["node"] == path[shared]:
            shared += 1
        del self.open[shared:]
        done = []
        for node, turn in zip(path[shared:], turns[shared:], strict=True):
            line, a, b = format_turn(turn["role"], turn["text"])
            if self.turns and self.size + len(line) > self.capacity:
                done.append(self._done())
                self._begin()
            up = self.open[-1] if self.open else {"node": None, "end": 0, "seen": [], "above": 0}
            position = up["end"]
            if position is None:  # the path above was written by another task
                position = sum(len(format_turn(t["role"], t["text"])[0]) for t in turns[: len(self.open)])
            start, loss = self.size, turn["role"] == "assistant"
            entry = {
                "node": node,
                "parent": up["node"],
                "start": start,
                "length": len(line),
                "position": position,
                "loss_start": start + a if loss else None,
                "loss_end": start + b if loss else None,
                "above": up["above"],
                "ancestors": [{"start": x, "end": y} for x, y in up["seen"]],
                "ends": 0,
            }
            self.parts.append(line)
            self.size += len(line)
            self.turns.append(entry)
            self.known[node] = entry
            seen = [*up["seen"][:-1], (up["seen"][-1][0], self.size)] if up["seen"] and up["seen"][-1][1] == start else [*up["seen"], (start, self.size)]
            self.open.append({"node": node, "end": position + len(line), "seen": seen, "above": up["above"]})
        # Different conversations end at different nodes, and one that ends within another comes before it.
        self.known[path[-1]]["ends"] = ends
        return done

    def _done(self) -> tuple:
        return self.turns[0]["node"], self.context, "".join(self.parts), self.turns

    def close(self) -> list[tuple]:
        return [self._done()] if self.turns else []


def common(a: list[str], b: list[str]) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def sequences(conversations: DataFrame, capacity: int = 1 << 16) -> DataFrame:
    """The sequences that hold every turn of ``paths``' result once.

    ``ends`` counts the conversations that end at a turn.
    """
    one = conversations.groupBy("leaf").agg(F.any_value(F.struct("path", "turns")).alias("c"), F.count("*").alias("ends"))
    # The path is the order of the tree: a parent comes before its children.
    ordered = checkpointed(one.select("c.path", "c.turns", "ends").repartitionByRange("path").sortWithinPartitions("path"))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first and the last path of a task."""
        first = last = None
        for part in batches:
            if part.num_rows:
                first = part.column("path")[0].as_py() if first is None else first
                last = part.column("path")[part.num_rows - 1].as_py()
        if first is not None:
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([first], kind), pa.array([last], kind)], names=["task", "first", "last"])

    found = sorted(ordered.select("path").mapInArrow(edges, "task bigint, first array<string>, last array<string>").collect())
    above = {r.task: r.first[: common(r.first, before.last)] for before, r in zip(found, found[1:], strict=False)}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(capacity, above.get(TaskContext.get().partitionId(), []))
        interval = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        turn = pa.struct(
            [("node", pa.string()), ("parent", pa.string())]
            + [(n, pa.int64()) for n in ("start", "length", "position", "loss_start", "loss_end", "above")]
            + [("ancestors", pa.list_(interval)), ("ends", pa.int64())]
        )
        kinds = [pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(turn)]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["sequence", "context", "text", "turns"])

        held: list[tuple] = []
        for part in batches:
            for i in range(part.num_rows):
                held += writer.add(*[part.column(c)[i].as_py() for c in ("path", "turns", "ends")])
                if len(held) >= 16:
                    yield batch(held)
                    held = []
        yield batch(held + writer.close())

    return ordered.mapInArrow(write, SEQUENCE)


def with_context(written: DataFrame) -> DataFrame:
    """Sequences with ``before``: the formatted turns of their context and where their loss lies."""
    lies = written.select("sequence", F.explode("turns").alias("t")).select(
        F.col("t.node").alias("node"), F.struct("sequence", "t.node", "t.start", "t.length", "t.loss_start", "t.loss_end").alias("span")
    )
    asked = checkpointed(written.select("sequence", F.posexplode("context").alias("at", "node")))
    needed = checkpointed(lies.join(joinable(asked.groupBy("node").agg(F.count("*").alias("n"))), "node"))
    # The few turns that others refer to, out of the sequences that hold them.
    line = lambda s: F.struct(
        s["node"].alias("node"),
        F.substring(F.col("text"), s["start"] + 1, s["length"]).alias("line"),
        (s["loss_start"] - s["start"]).alias("loss_start"),
        (s["loss_end"] - s["start"]).alias("loss_end"),
    )
    spans = needed.select("span.sequence", "span").groupBy("sequence").agg(F.collect_list("span").alias("spans"))
    said = written.select("sequence", "text").join(joinable(spans, weight=F.size("spans")), "sequence").select(F.explode(F.transform("spans", line)).alias("said"))
    said = said.join(needed.select(F.col("node").alias("name"), "n"), F.col("said.node") == F.col("name")).select(F.col("name").alias("node"), "said", "n")
    met = looked_up(asked, said, "node", "n", bound=MOST_CHARS, weight=F.char_length("said.line"))
    before = met.groupBy("sequence").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "said"))), lambda x: x["said"]).alias("before"))
    return written.join(before, "sequence", "left")


def position_ids(turns: list[dict]) -> list[int]:
    """Position of every character of a sequence, from its turns."""
    return [t["position"] + i for t in turns for i in range(t["length"])]


def read_back(text: str, before: list[str], turn: dict) -> str:
    """The conversation that ends at ``turn`` of a sequence: all it attends to."""
    own = text[turn["start"] : turn["start"] + turn["length"]]
    return "".join([*before[: turn["above"]], *[text[a["start"] : a["end"]] for a in turn["ancestors"]], own])


def digests(sequence: Column) -> Column:
    """Of each conversation that ends in a sequence: leaf, how many they are, and digests of what is read back."""
    fields = [("leaf", pa.string()), ("ends", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

    @arrow_udf("array<struct<leaf: string, ends: bigint, n_turns: bigint, turns_sha256: string, loss_chars: bigint, loss_sha256: string, formatted_chars: bigint>>")
    def of(rows: pa.Array) -> pa.Array:
        out = []
        for row in rows:
            row = row.as_py()
            text, by_node, before = row["text"], {t["node"]: t for t in row["turns"]}, row["before"] or []
            lines = [x["line"] for x in before]
            masked = [x["line"][x["loss_start"] : x["loss_end"]] if x["loss_start"] is not None else "" for x in before]
            found = []
            for t in row["turns"]:
                if not t["ends"]:
                    continue
                formatted = read_back(text, lines, t)
                turns = read_turns(formatted)
                loss, at = [], t
                while at is not None:
                    if at["loss_start"] is not None:
                        loss.append(text[at["loss_start"] : at["loss_end"]])
                    at = by_node.get(at["parent"])
                learned = "".join(map(unescape, [*masked[: t["above"]], *reversed(loss)]))
                whole = "".join([f"{role}\n{said}\n" for role, said in turns])
                sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
                found.append((t["node"], t["ends"], len(turns), sha(whole), len(learned), sha(learned), len(formatted)))
            out.append([dict(zip([f for f, _ in fields], x, strict=True)) for x in found])
        return pa.array(out, pa.list_(pa.struct(fields)))

    return of(sequence)


def formatted_digests(rows: DataFrame, capacity: int = 1 << 16) -> DataFrame:
    """One row per conversation: conv and the digests of its formatted form."""
    told = checkpointed(paths(rows))
    written = with_context(checkpointed(sequences(told, capacity)))
    read = written.select(F.explode(digests(F.struct("text", "turns", "before"))).alias("d")).select("d.*")
    return looked_up(told.select("conv", "leaf"), read, "leaf", "ends").drop("leaf")

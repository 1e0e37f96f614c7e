"""Packing of tokenised documents into sequences of one capacity.

Harmonic packing: a document of n tokens is dealt by its length. First its
whole capacities are sequences of their own. The rest, r tokens, is in class
k = C // r (so C/(k+1) < r <= C/k), and a bin of class k holds exactly k whole
documents. They leave a gap that is smaller than any document of the class;
the beginning of the class's next document fills it, and what is left of that
one is dealt again by its length. So a document is cut only where a bin ends,
and every bin is full. All rests of at most C/``CLASSES`` tokens share the last
class, whose bins take as many as fit.

Each worker fills its bins without any other, in one narrow pass without a
shuffle.

Leftovers. When a worker ends, each class has at most one open bin. Laid end
to end from the first class on, these fill further whole sequences; the last
stretch is cut at powers of two into sequences that need no padding. So
nothing is padded at all.

Scale. A worker holds one slice of texts and at most ``CLASSES`` open bins,
each of less than one sequence.

Defined cases. A null or blank text is a document of the closing id alone.
Repeated rows are documents of their own. An empty table gives no pieces. A
null id is kept. Other input columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm.batched import slices
from tessera.llm.wordbpe import word_tokens

SCHEMA = "{id} {id_type}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
#: Sequence ids of one worker start at its number times this.
WORKER = 1 << 40
#: Classes of lengths.
CLASSES = 64


class Bins:
    """The open bins of one worker. ``add`` and ``close`` return pieces that are placed.

    A piece is (key, start, length, ids, doc_tokens, sequence, offset).
    """

    def __init__(self, capacity: int, first: int, classes: int = CLASSES) -> None:
        if capacity < 1 or capacity & (capacity - 1):
            raise ValueError("the capacity must be a power of two")
        self.capacity, self.next, self.classes = capacity, first, classes
        self.open: dict[int, list] = {}
        self.used: dict[int, int] = {}

    def _number(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, key: object, ids: bytes) -> list[tuple]:
        """Deals one document, given by its ids of four bytes each."""
        n, start, out = len(ids) // 4, 0, []
        while start < n:
            rest = n - start
            if rest >= self.capacity:
                stop = start + self.capacity
                out.append((key, start, self.capacity, ids[4 * start : 4 * stop], n, self._number(), 0))
                start = stop
                continue
            k = min(self.capacity // rest, self.classes)
            at = self.used.get(k, 0)
            length = min(rest, self.capacity - at)
            members = self.open.setdefault(k, [])
            members.append((key, start, length, ids[4 * start : 4 * (start + length)], n, at))
            self.used[k] = at + length
            start += length
            if self.used[k] == self.capacity:
                number = self._number()
                out += [(*m[:5], number, m[5]) for m in self.open.pop(k)]
                del self.used[k]
        return out

    def close(self) -> list[tuple]:
        left = [m for k in sorted(self.open) for m in self.open[k]]
        rest = sum(m[2] for m in left)
        out, at, room, number = [], 0, 0, 0
        for key, start, length, ids, n, _ in left:
            done = 0
            while done < length:
                if at == room:  # the next sequence: whole, or the largest power of two that the rest fills
                    at, room, number = 0, self.capacity if rest >= self.capacity else 1 << (rest.bit_length() - 1), self._number()
                size = min(length - done, room - at)
                out.append((key, start + done, size, ids[4 * done : 4 * (done + size)], n, number, at))
                at, done, rest = at + size, done + size, rest - size
        self.open, self.used = {}, {}
        return out


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` holds little-endian unsigned 32-bit token ids; ``end_id`` closes
    each document. ``sequence_id`` is unique over all workers.
    """
    closing = end_id.to_bytes(4, "little")
    out_schema = pa.schema(
        [("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokens(path)
        bins = Bins(capacity, TaskContext.get().partitionId() * WORKER)
        kind = None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            arrays = [pa.array(columns[0], kind), *[pa.array(c, f.type) for c, f in zip(columns[1:], out_schema, strict=True)]]
            return pa.RecordBatch.from_arrays(arrays, names=[id_col, *out_schema.names])

        for part in batches:
            kind = part.schema.field(0).type
            for at, texts in slices(part.column(1)):
                ids, ends = encoder.ids(texts)
                ids, ends = memoryview(np.ascontiguousarray(ids)).cast("B"), (4 * ends).tolist()
                keys, placed = part.column(0).slice(at, len(texts)).to_pylist(), []
                for key, a, b in zip(keys, ends, ends[1:], strict=False):
                    placed += bins.add(key, bytes(ids[a:b]) + closing)
                yield batch(placed)
        if kind is not None:
            yield batch(bins.close())

    kinds = dict(docs.dtypes)
    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA.format(id=f"`{id_col}`", id_type=kinds[id_col]))

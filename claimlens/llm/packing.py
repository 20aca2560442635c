"""Harmonic packing of token ids into sequences of a fixed capacity.

Lengths fall into reciprocal-capacity classes: class j holds pieces longer than
capacity/(j+1) and at most capacity/j, and a bin of class j takes exactly j pieces. As a
document may be cut, it is cut where classes lose nothing: whole sequences first, then
at most one piece of a half, a quarter, ... of the capacity down to `SMALLEST_CUT`, which
fill the bins of classes 1, 2, 4, ... to the brim. Only the rest, shorter than
`SMALLEST_CUT`, goes to a class by its length, where a bin stays open by less than one
piece in at least capacity/`SMALLEST_CUT`.

Each worker fills its own bins without hearing of the others, so nothing is shuffled.
Bins that are not full when a worker's rows end are joined, largest first, into
sequences of that worker. A sequence number has the number of the worker's partition in
its upper bits.

Defined results: a null text is empty and has the end-of-document id only; repeated rows
are packed as often as they come; an empty table gives no pieces; other input columns
are not passed on.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from claimlens.llm import arrays as A
from claimlens.llm import bpe

CAPACITY = 1024
SMALLEST_CUT = 64
END_OF_DOCUMENT = 0
def cut(n: int, capacity: int, smallest: int) -> list[int]:
    """Lengths of the pieces of a document of n ids, in order."""
    out = [capacity] * (n // capacity)
    rest, size = n % capacity, capacity
    while rest >= smallest:
        size //= 2
        if rest >= size:
            out.append(size)
            rest -= size
    if rest:
        out.append(rest)
    return out


class Packer:
    """The bins of one worker."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.next = capacity, first_sequence
        # Open bin of each class: rows in it, ids in it.
        self.open: dict[int, tuple[list[int], list[int]]] = {}

    def _close(self, members: list[int], lengths: list[int], place) -> None:
        offset = 0
        for row, length in zip(members, lengths):
            place(row, self.next, offset)
            offset += length
        self.next += 1

    def add(self, row: int, length: int, place: Callable[[int, int, int], None]) -> None:
        kind = self.capacity // length
        members, lengths = self.open.setdefault(kind, ([], []))
        members.append(row)
        lengths.append(length)
        if len(members) == kind:
            self._close(members, lengths, place)
            del self.open[kind]

    def finish(self, place: Callable[[int, int, int], None]) -> None:
        """Join the bins that are left, largest first, each into the first with room."""
        left = sorted(self.open.values(), key=lambda b: -sum(b[1]))
        bins: list[tuple[list[int], list[int]]] = []
        for members, lengths in left:
            for m, s in bins:
                if sum(s) + sum(lengths) <= self.capacity:
                    m += members
                    s += lengths
                    break
            else:
                bins.append((list(members), list(lengths)))
        for members, lengths in bins:
            self._close(members, lengths, place)
        self.open.clear()


PIECES = [
    ("start", T.LongType()),
    ("length", T.LongType()),
    ("ids_crc32", T.LongType()),
    ("doc_tokens", T.LongType()),
    ("sequence_id", T.LongType()),
    ("offset", T.LongType()),
    ("ids", T.ArrayType(T.IntegerType())),
]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
    smallest_cut: int = SMALLEST_CUT,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    A sequence is its pieces in order of `offset`, padded to `capacity` unless its length
    is a power of two. The tokenizer file must be at the same path on every machine.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    id_type = rows.schema["id"].dataType
    wanted = PIECES if with_ids else PIECES[:-1]
    schema = T.StructType([T.StructField("id", id_type), *(T.StructField(*p) for p in wanted)])

    def with_end(texts: pa.Array) -> tuple[bytes, np.ndarray]:
        """Little-endian 32-bit ids of all texts, each with its end mark, and their bounds."""
        ids, ptr = bpe.load(tokenizer_path).tokens(texts).flat()
        bounds = ptr + np.arange(len(ptr))
        out = np.full(bounds[-1], END_OF_DOCUMENT, dtype="<u4")
        here = np.ones(len(out), dtype=bool)
        here[bounds[1:] - 1] = False
        out[here] = ids
        return out.tobytes(), bounds

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)
        # Pieces that wait for their sequence: [id, start, ids as bytes, ids of the document].
        waiting: dict[int, tuple] = {}
        done: list[tuple] = []
        number = 0

        def place(row: int, sequence: int, offset: int) -> None:
            done.append((*waiting.pop(row), sequence, offset))

        def flush() -> pa.RecordBatch:
            ids, start, raw, total, sequence, offset = zip(*done) if done else [[]] * 6
            columns = [
                pa.array(list(ids), type=batch_id_type[0]),
                pa.array(start, pa.int64()),
                pa.array([len(r) // 4 for r in raw], pa.int64()),
                pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                pa.array(total, pa.int64()),
                pa.array(sequence, pa.int64()),
                pa.array(offset, pa.int64()),
            ]
            if with_ids:
                body = np.frombuffer(b"".join(raw), dtype="<i4")
                bounds = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(body, pa.int32())))
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

        batch_id_type = [pa.int64()]
        for batch in batches:
            batch_id_type[0] = batch.schema.field("id").type
            for part in A.by_bytes(batch, "text"):
                body, bounds = with_end(part.column("text"))
                bounds = bounds.tolist()
                for doc, first, last in zip(part.column("id").to_pylist(), bounds, bounds[1:]):
                    start = 0
                    for length in cut(last - first, capacity, smallest_cut):
                        at = 4 * (first + start)
                        waiting[number] = (doc, start, body[at : at + 4 * length], last - first)
                        packer.add(number, length, place)
                        start += length
                        number += 1
                if done:
                    yield flush()
        packer.finish(place)
        if done:
            yield flush()

    return rows.mapInArrow(task, schema).withColumnRenamed("id", id_column)

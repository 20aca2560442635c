"""CSV files whose quoted values may hold line breaks, read by many tasks a file.

A file is read as lines, split among tasks at any line end. Whether a line end stands
inside quotes depends on all lines before it, so a first pass sums every split up as a
function of two states: does it end inside quotes, if it starts outside of them, and if it
starts inside? Running over the splits of a file, these functions tell the state every
split starts in. The lines are then cut into records where they are read. A record that
crosses splits is put together from its pieces, which a pass of their own collects; nothing
else is shuffled or stored.

Each file has a header of its own and may order its columns differently. Quotes inside a
quoted value are doubled. An unquoted empty value is null, a quoted one an empty string.
A record whose number of values is not that of its header is an error, and so is a later
pass that meets other splits than the first.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from claimlens.session import durable

# From a place inside quotes to the end of the value, and a whole value from its start.
_REST = r'[^"]*+(?:""[^"]*+)*+"(?!")[^,]*+'
_VALUE = rf'(?:"{_REST}|[^",][^,]*+|)'
_ENDS_OUTSIDE = re.compile(rf"{_VALUE}(?:,{_VALUE})*+")
_LEAVES_QUOTES = re.compile(rf"{_REST}(?:,{_VALUE})*+")

SPLIT = ["file", "at", "size"]
_TAIL, _HEAD = 0, 1


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line ends inside quotes, given whether it starts there."""
    if '"' not in line:
        return inside
    return not (_LEAVES_QUOTES if inside else _ENDS_OUTSIDE).fullmatch(line)


def values_of(lines: list[str]) -> Iterator[list[str | None]]:
    """The values of each record in whole records' lines; blank lines are no records."""
    csv.field_size_limit(sys.maxsize)
    rows = csv.reader((f"{line}\n" for line in lines), quoting=csv.QUOTE_NOTNULL)
    return (r for r in rows if r)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64(meta["file_path"]).alias("file"),
        meta["file_block_start"].alias("at"),
        meta["file_block_length"].alias("size"),
        "value",
    )


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Iterator[list[str]]]]:
    """Each split of a task with its lines, batch by batch."""
    waiting: list = []

    def parts():
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in keys]
            lines = batch.column("value").to_pylist()
            bounds = [0]
            for i in range(1, len(lines)):
                if columns[1][i] != columns[1][i - 1] or columns[0][i] != columns[0][i - 1]:
                    bounds.append(i)
            for a, b in zip(bounds, [*bounds[1:], len(lines)]):
                if a < b:
                    yield tuple(c[a] for c in columns), lines[a:b]

    source = parts()

    def of(key, first):
        yield first
        for other, lines in source:
            if other[:3] != key[:3]:
                waiting.append((other, lines))
                return
            yield lines

    while True:
        head = waiting.pop() if waiting else next(source, None)
        if head is None:
            return
        run = of(*head)
        yield head[0], run
        # What the caller left unread belongs to this split.
        for _ in run:
            pass


def _summaries(lines: DataFrame) -> DataFrame:
    """One row per split: where it ends for either start, and the header of a file's first split."""

    def task(batches):
        for key, parts in _runs(batches, SPLIT):
            ends = [False, True]
            header, first = None, []
            for part in parts:
                for line in part:
                    if header is None and key[1] == 0:
                        first.append(line)
                        if not ends_inside(line, ends[0]):
                            header = next(values_of(first), None)
                            first = [] if header is None else first
                    if '"' in line:
                        ends = [ends_inside(line, e) for e in ends]
            yield pa.RecordBatch.from_pydict(
                {
                    **{k: pa.array([v], pa.int64()) for k, v in zip(SPLIT, key)},
                    "out_to": pa.array([int(ends[0])], pa.int32()),
                    "in_to": pa.array([int(ends[1])], pa.int32()),
                    "header": pa.array([header], pa.list_(pa.string())),
                }
            )

    return lines.mapInArrow(
        task, "file long, at long, size long, out_to int, in_to int, header array<string>"
    )


def _starts(splits: DataFrame) -> DataFrame:
    """The state each split starts in: 1 inside quotes.

    A split either ends in one state whatever it starts in, or keeps the state, or turns
    it. So the state is what the last split of the first kind left, turned as often as the
    splits of the third kind since then turn it.
    """
    before = W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    fixed = F.col("out_to") == F.col("in_to")
    turns = F.when(~fixed & (F.col("out_to") == 1), 1).otherwise(0)
    rows = splits.withColumn("_turned", F.coalesce(F.sum(turns).over(before), F.lit(0)))
    left = F.when(fixed, F.struct(F.col("out_to").alias("state"), F.col("_turned").alias("turned")))
    last = F.last(left, ignorenulls=True).over(before)
    state = F.coalesce(last["state"], F.lit(0)) + F.col("_turned") - F.coalesce(last["turned"], F.lit(0))
    return rows.withColumn("inside", F.pmod(state, F.lit(2)).cast("int")).drop("_turned")


def _headers(splits: DataFrame, wanted: list[str], optional: list[str]) -> tuple[DataFrame, list[str]]:
    """(file, width, places of the columns to read) and the names of these columns."""
    headers = splits.where(F.col("at") == 0).select("file", F.col("header").alias("h"))
    seen = headers.agg(
        *[F.min(F.coalesce(F.array_contains("h", c), F.lit(False))).alias(c) for c in wanted],
        *[F.min(F.array_contains("h", c)).alias(f"all {c}") for c in optional],
        *[F.max(F.array_contains("h", c)).alias(f"any {c}") for c in optional],
    ).first()
    missing = [c for c in wanted if seen[c] is False]
    if missing:
        raise ValueError(f"missing columns {missing}")
    uneven = [c for c in optional if seen[f"all {c}"] != seen[f"any {c}"]]
    if uneven:
        raise ValueError(f"columns {uneven} are in some files only")
    names = [*wanted, *[c for c in optional if seen[f"all {c}"]]]
    places = F.array(*[(F.array_position("h", c) - 1).cast("int") for c in names])
    return headers.select("file", F.size("h").alias("width"), places.alias("places")), names


def _records(told: DataFrame) -> DataFrame:
    """The records that lie in one split, without the headers."""

    def task(batches):
        for key, parts in _runs(batches, [*SPLIT, "inside", "width", "places"]):
            _, at, _, inside, width, places = key
            state, header, pending = _started(inside), at == 0, []
            skip = state
            for part in parts:
                done: list[str] = []
                for line in part:
                    state = ends_inside(line, state)
                    pending.append(line)
                    if not state:
                        # What ends here may have started in an earlier split.
                        if not skip:
                            done += pending
                        skip, pending = False, []
                rows = values_of(done)
                if header and next(rows, None) is not None:
                    header = False
                rows = [picked(r, width, places) for r in rows]
                if rows:
                    yield pa.RecordBatch.from_pydict({"v": pa.array(rows, pa.list_(pa.string()))})

    return told.mapInArrow(task, "v array<string>")


def _pieces(told: DataFrame) -> DataFrame:
    """What is left of records at the start and the end of splits, from the splits that have some.

    A split that starts inside quotes gives a tail, one that ends inside a head; one that
    lies in a single value gives a tail.
    """

    def task(batches):
        for key, parts in _runs(batches, [*SPLIT, "inside", "width", "places"]):
            file, at, _, inside, width, places = key
            state, pending, out = _started(inside), [], []
            tail = state
            for part in parts:
                for line in part:
                    state = ends_inside(line, state)
                    if tail or state or pending:
                        pending.append(line)
                    if not state:
                        if tail:
                            out.append((_TAIL, "\n".join(pending)))
                        tail, pending = False, []
            if pending:
                out.append((_TAIL if tail else _HEAD, "\n".join(pending)))
            for kind, text in out:
                yield pa.RecordBatch.from_pydict(
                    {
                        "file": pa.array([file], pa.int64()),
                        "at": pa.array([at], pa.int64()),
                        "kind": pa.array([kind], pa.int32()),
                        "width": pa.array([width], pa.int32()),
                        "places": pa.array([places], pa.list_(pa.int32())),
                        "piece": pa.array([text], pa.string()),
                    }
                )

    some = told.where((F.col("inside") == 1) | (F.col("outside") == 0) | F.col("inside").isNull())
    return some.mapInArrow(
        task, "file long, at long, kind int, width int, places array<int>, piece string"
    )


def _started(inside: int | None) -> bool:
    if inside is None:
        raise RuntimeError("the splits of the files have changed since they were looked at")
    return bool(inside)


def picked(row: list, width: int, places: list[int]) -> list:
    if len(row) != width:
        raise ValueError(f"a record of {len(row)} values under a header of {width}: {str(row)[:200]}")
    return [row[p] for p in places]


def _joined(pieces: DataFrame) -> DataFrame:
    """The records that cross splits, put together from a head and what follows it."""
    order = W.partitionBy("file").orderBy("at", "kind")
    number = F.sum(F.when(F.col("kind") == _HEAD, 1).otherwise(0)).over(order)
    grouped = pieces.withColumn("_n", number).groupBy("file", "_n").agg(
        F.first("width").alias("width"),
        F.first("places").alias("places"),
        F.sort_array(F.collect_list(F.struct("at", "kind", "piece"))).alias("p"),
    )
    text = F.array_join(F.transform("p", lambda p: p["piece"]), "\n").alias("piece")

    def task(batches):
        for batch in batches:
            rows = []
            for width, places, text in zip(*(batch.column(c).to_pylist() for c in ("width", "places", "piece"))):
                rows += [picked(r, width, places) for r in values_of(text.split("\n"))]
            yield pa.RecordBatch.from_pydict({"v": pa.array(rows, pa.list_(pa.string()))})

    return grouped.select("width", "places", text).mapInArrow(task, "v array<string>")


def read_records(
    spark: SparkSession, path: str | list[str], wanted: list[str], optional: list[str] | None = None
) -> DataFrame:
    """The wanted columns as text, and those optional ones that all files have.

    What is broadcast has one row of about 50 bytes for each split of the files, of which
    the driver has a longer list anyway when it plans the read.
    """
    lines = _lines(spark, path)
    splits = durable(_summaries(lines))
    headers, names = _headers(splits, wanted, optional or [])
    starts = _starts(splits)
    ends = F.when(F.col("inside") == 1, F.col("in_to")).otherwise(F.col("out_to"))
    known = starts.select(*SPLIT, "inside", (1 - ends).alias("outside")).join(headers, "file")
    told = lines.join(F.broadcast(durable(known)), SPLIT, "left")
    crossing = _joined(durable(_pieces(told)))
    rows = _records(told).unionByName(crossing)
    return rows.select(*[F.get("v", i).alias(c) for i, c in enumerate(names)])

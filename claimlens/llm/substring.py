"""Substring dedup: repeated windows by hashed anchors, in place of relative Lempel-Ziv parsing.

A window is `WINDOW` consecutive words of one text; its words go if the same words also
start anywhere else. The whole collection is indexed by
anchors: of the `GRAM`-word runs inside a window the one with the smallest hash is its
anchor, so equal windows have equal anchors wherever they stand, and one word in about
fourteen starts one. The index is cut into blocks by the anchor's hash; a stretch of text can
only match in the blocks that hold its anchors, and meets all of these.

1. Each text is cut into candidate factors, the words of all windows that share an
   anchor. Anchors and factors are counted by hash (combined in the map tasks).
2. A factor whose whole word sequence also starts elsewhere is matched in full: all of its
   windows are duplicates. This settles the inside of long copies at the cost of one row
   per anchor.
3. A factor whose anchor occurs elsewhere, but not with the same words, lies at the
   boundary of a match. There, and for one of each kind of matched factors, window hashes
   are counted one by one, and windows found twice are duplicates.
4. Spans of duplicate windows are united per text and cut out.

Positions travel with a 64-bit content key of their row, so ids need not be unique. Joins
on hashes stand next to the aggregates that count them, where Spark does not split a very
frequent anchor: its rows, which hold hashes and positions only, go to one task.

Defined results: a null or empty text has no words; repeated rows are copies of each
other; an empty table gives an empty one; columns of the input are passed on unchanged
and those added give way to clashing names by an underscore in front.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from claimlens.llm import arrays as A
from claimlens.llm.repetition import covered
from claimlens.llm.tables import free_name
from claimlens.session import durable

WINDOW, GRAM = 35, 8


def _sliding(values: np.ndarray, width: int, low: bool) -> np.ndarray:
    """Smallest (or largest) of the `width` values from each place on; shorter at the end."""
    pick = np.minimum if low else np.maximum
    out, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        ahead = out[step:]
        out = np.concatenate([pick(out[: len(ahead)], ahead), out[len(ahead) :]])
        reach += step
    return out


def anchors(w: A.Words, window: int, gram: int):
    """(anchor place, first and last window that has it, anchor hash) of each factor."""
    span = window - gram + 1
    n = len(w.hash)
    empty = np.zeros(0, dtype=np.int64)
    if n < window:
        return empty, empty, empty, empty.view(np.uint64)
    code = w.grams(gram)
    best = _sliding(code, span, low=True)
    valid = w.left() >= window
    # Largest window minimum among the windows that hold a place: its own code at an anchor.
    held = np.where(valid, best, np.uint64(0))
    back = _sliding(held[::-1], span, low=False)[::-1]
    place = np.flatnonzero((back == code) & (back > 0))
    # Windows of a place: the run of valid windows around it with its minimum.
    start = np.flatnonzero(valid)
    run_new = np.ones(len(start), dtype=bool)
    run_new[1:] = (best[start[1:]] != best[start[:-1]]) | (np.diff(start) > 1)
    run_start = start[run_new]
    run_end = np.append(start[np.flatnonzero(run_new)[1:] - 1], start[-1])
    # The first and last run that can hold the place.
    lo = np.searchsorted(run_end, np.maximum(place - span + 1, 0))
    hi = np.searchsorted(run_start, place, side="right") - 1
    first, last = np.full(len(place), n), np.full(len(place), -1)
    for step in range(int((hi - lo).max(initial=-1)) + 1):
        run = lo + step
        ok = run <= hi
        r = np.where(ok, run, 0)
        same = ok & (best[run_start[r]] == code[place])
        first = np.where(same, np.minimum(first, np.maximum(run_start[r], place - span + 1)), first)
        last = np.where(same, np.maximum(last, np.minimum(run_end[r], place)), last)
    ok = first <= last
    return place[ok], first[ok], last[ok], code[place[ok]]


def factors(texts: pa.Array, window: int, gram: int):
    """Words and candidate factors: (words, text, place in the text, first, last, anchor, factor)."""
    w = A.words(texts)
    place, first, last, anchor = anchors(w, window, gram)
    text = np.searchsorted(w.ptr, place, side="right") - 1
    whole = w.ranges(first, last + window)
    # The same words with another place of the anchor are another factor.
    whole = A.mix(whole + (place - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (last - first).astype(np.uint64))
    return w, text, place - w.ptr[text], first, last, anchor, whole


MATCHED, BOUNDARY, MODEL = 1, 2, 3


def dedup(
    docs: DataFrame,
    text_column: str = "text",
    id_column: str = "doc_id",
    window: int = WINDOW,
    gram: int = GRAM,
) -> DataFrame:
    """All columns of docs and: n_words, n_removed, kept_text (kept words joined by a space)."""
    key, text = free_name(docs, "_key"), F.col(text_column)
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_column), text))
    marks_name, starts_name = free_name(docs, "marks"), free_name(docs, "starts")

    def occurrences(part: pa.RecordBatch) -> pa.RecordBatch:
        w, which, place, _, _, anchor, whole = factors(part.column("text"), window, gram)
        return pa.RecordBatch.from_arrays(
            [
                part.column("k").take(pa.array(which)),
                pa.array(place, pa.int32()),
                pa.array(anchor.view(np.int64)),
                pa.array(whole.view(np.int64)),
            ],
            names=["k", "place", "anchor", "factor"],
        )

    plain = keyed.select(F.col(key).alias("k"), text.alias("text"))
    found = plain.mapInArrow(A.over_texts(occurrences), "k long, place int, anchor long, factor long")
    n_anchor = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    # Factors whose anchor is found twice at least; few in a collection without copies.
    again = durable(found.join(n_anchor, "anchor").select("k", "place", "factor"))
    # The model of a factor is its occurrence with the smallest hash of where it stands.
    stand = F.xxhash64("k", "place")
    by_factor = again.groupBy("factor").agg(F.count(F.lit(1)).alias("n"), F.min(stand).alias("model"))
    kind = (
        F.when(F.col("n") == 1, BOUNDARY).when(F.col("model") == stand, MODEL).otherwise(MATCHED)
    )
    marks = (
        again.join(by_factor, "factor")
        .select("k", F.struct("place", kind.alias("kind")).alias("m"))
        .groupBy("k")
        .agg(F.collect_list("m").alias("marks"))
    )
    marks = durable(marks).withColumnsRenamed({"k": key, "marks": marks_name})
    # All columns, though only the text is read: so this join and the last one share one
    # exchange of the texts, which is the largest of all. For that, nothing below is stored.
    candidates = keyed.join(marks, key)

    def marked(part: pa.RecordBatch):
        """(words, first and last window of each marked factor, its kind, its text)."""
        w, which, place, first, last, _, _ = factors(part.column(text_column), window, gram)
        sizes = A.list_sizes(part.column(marks_name))
        flat = part.column(marks_name).flatten()
        own = np.repeat(np.arange(part.num_rows), sizes) << 32 | flat.field("place").to_numpy()
        mine = which << 32 | place
        by = np.argsort(mine)
        at = by[np.searchsorted(mine[by], own)]
        return w, first[at], last[at], flat.field("kind").to_numpy(), which[at]

    def boundary(part: pa.RecordBatch) -> pa.RecordBatch:
        w, first, last, kinds, which = marked(part)
        look = kinds != MATCHED
        size = last[look] - first[look] + 1
        start = np.repeat(first[look] - np.cumsum(size) + size, size) + np.arange(size.sum())
        text = np.repeat(which[look], size)
        # A window with two anchors of the same hash is one window.
        start, at = np.unique(start, return_index=True)
        text = text[at]
        code = w.ranges(start, start + window)
        return pa.RecordBatch.from_arrays(
            [
                part.column(key).take(pa.array(text)),
                pa.array(start - w.ptr[text], pa.int32()),
                pa.array(code.view(np.int64)),
            ],
            names=["k", "place", "code"],
        )

    windows = candidates.mapInArrow(
        A.over_texts(boundary, text_column), "k long, place int, code long"
    )
    twice = windows.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("code")
    single = windows.join(twice, "code").groupBy(F.col("k").alias(key))
    single = single.agg(F.collect_list("place").alias(starts_name))

    # One row of marks and starts per key; texts without any have none.
    spans = marks.join(single, key, "left")
    n_words, n_removed, kept_text = (free_name(docs, c) for c in ("n_words", "n_removed", "kept_text"))
    schema = T.StructType(
        [
            *docs.schema.fields,
            T.StructField(n_words, T.LongType()),
            T.StructField(n_removed, T.LongType()),
            T.StructField(kept_text, T.StringType()),
        ]
    )
    given, names = docs.columns, [f.name for f in schema]

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        w, first, last, kinds, which = marked(part)
        n = len(w.hash)
        full = kinds != BOUNDARY
        starts, ends = [first[full]], [last[full] + window]
        counts = A.list_sizes(part.column(starts_name))
        alone = part.column(starts_name).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        alone = alone + np.repeat(w.ptr[:-1], counts)
        gone = covered(np.concatenate([*starts, alone]), np.concatenate([*ends, alone + window]), n)
        removed = A.spread_sum(gone.astype(np.int64), w.ptr)
        kept = np.flatnonzero(~gone)
        # The bytes of kept words, each with a space behind it, text by text.
        size = w.end[kept] - w.start[kept] + 1
        source = np.repeat(w.start[kept] - np.cumsum(size) + size, size) + np.arange(size.sum())
        body = np.append(w.data, np.uint8(32))[source]
        body[np.cumsum(size) - 1] = 32
        ptr = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(kept, w.ptr)]
        raw = body.tobytes()
        texts = [raw[a : b - 1 if b > a else b].decode() for a, b in zip(ptr, ptr[1:])]
        columns = [part.column(c) for c in given]
        columns += [pa.array(w.counts(), pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    joined = keyed.join(spans, key, "left").drop(key)
    return joined.mapInArrow(A.over_texts(cut, text_column), schema)


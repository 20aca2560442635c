"""Quality rules on repetition, from suffix arrays over the words of each text.

All texts of an Arrow part are sorted together by prefix doubling, with the number of
the text in front, so that suffixes of different texts never meet. The ranks kept from
every doubling give the longest common prefix of neighbours without a second pass. A
word that starts a repeat of length L (the larger of its two neighbours' prefixes) covers
L words; the union of these spans over all maximal repeats is the covered part.

Nothing is shuffled: every figure depends on one text only. Memory is bounded by the
step of `arrays.by_bytes` or by one text, if that is longer.

Defined results: null and empty texts have no words and fail the base rules; repeated
rows give repeated results; an empty table gives an empty one; input columns other than
the id and the text are not passed on, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from claimlens.llm import arrays as A

# A repeat counts towards the covered part from this many words on.
MIN_REPEAT_WORDS = 8
# A text is dropped when more than this share of it, or a repeat longer than this, is found.
MAX_COVERED = 0.4
MAX_REPEAT_WORDS = 60
# The base rules.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

_STATS = [
    ("n_words", "long"),
    ("word_chars", "long"),
    ("n_symbols", "long"),
    ("n_dup_lines", "long"),
    ("n_repeat_words", "long"),
    ("covered_words", "long"),
    ("longest_repeat", "long"),
]


def prefix_ranks(text: np.ndarray, word: np.ndarray, left: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes by their first 1, 2, 4, ... words, until all differ.

    A rank is the number of suffixes that sort before the whole class, so refining a
    class leaves all others as they are and only undecided suffixes are sorted again.
    """
    n = len(word)
    order = np.lexsort((word, text))
    new = np.ones(n, dtype=bool)
    new[1:] = (text[order][1:] != text[order][:-1]) | (word[order][1:] != word[order][:-1])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, step = [rank], 1
    while True:
        size = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(size[rank] > 1)
        if not len(open_):
            return levels
        inside = left[open_] > step
        after = np.full(len(open_), -1, dtype=np.int64)
        after[inside] = rank[open_[inside] + step]
        first = rank[open_]
        by = np.lexsort((after, first))
        f, a, m = first[by], after[by], len(by)
        at = np.arange(m)
        class_start = np.ones(m, dtype=bool)
        class_start[1:] = f[1:] != f[:-1]
        part_start = class_start.copy()
        part_start[1:] |= a[1:] != a[:-1]
        base = np.maximum.accumulate(np.where(class_start, at, 0))
        part = np.maximum.accumulate(np.where(part_start, at, 0))
        rank = rank.copy()
        rank[open_[by]] = f + part - base
        levels.append(rank)
        step *= 2


def longest_repeats(w: A.Words) -> np.ndarray:
    """For each word, the length of the longest repeat of its text that starts there."""
    n = len(w.hash)
    best = np.zeros(n, dtype=np.int64)
    if n < 2:
        return best
    text, left = w.text_of(), w.left()
    levels = prefix_ranks(text, w.hash, left)
    order = np.argsort(levels[-1])
    a, b = order[:-1], order[1:]
    same = text[a] == text[b]
    a, b = a[same], b[same]
    common = np.zeros(len(a), dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        step = 1 << level
        fits = (common + step <= left[a]) & (common + step <= left[b])
        at = np.flatnonzero(fits)
        equal = levels[level][a[at] + common[at]] == levels[level][b[at] + common[at]]
        common[at[equal]] += step
    np.maximum.at(best, a, common)
    np.maximum.at(best, b, common)
    return best


def covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in the union of the ranges."""
    change = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(change)[:n] > 0


def duplicate_lines(w: A.Words) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line of the text."""
    n_texts = len(w.ptr) - 1
    breaks = np.flatnonzero(w.data == 10)
    start = np.concatenate([w.offsets[:-1], breaks + 1])
    text = np.concatenate(
        [np.arange(n_texts), np.searchsorted(w.offsets, breaks, side="right") - 1]
    )
    by = np.lexsort((start, text))
    start, text = start[by], text[by]
    end = np.concatenate([start[1:] - 1, [len(w.data)]])
    last = np.ones(len(start), dtype=bool)
    last[:-1] = text[1:] != text[:-1]
    end[last] = w.offsets[text[last] + 1]
    wordy = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, text = start[wordy], end[wordy], text[wordy]
    if not len(start):
        return np.zeros(n_texts, dtype=np.int64)
    line = A._range_sums(A._BYTE_VALUE[w.data], start, end, A._BYTE_BASE)
    by = np.lexsort((line, text))
    again = (line[by][1:] == line[by][:-1]) & (text[by][1:] == text[by][:-1])
    return np.bincount(text[by][1:][again], minlength=n_texts)


def statistics(texts: pa.Array, min_repeat: int = MIN_REPEAT_WORDS) -> list[np.ndarray]:
    """The columns of `_STATS` for a column of texts."""
    w = A.words(texts)
    n = len(w.hash)
    longest = longest_repeats(w)
    at = np.arange(n)

    def in_spans(width: int, length: np.ndarray) -> np.ndarray:
        hit = longest >= width
        return A.spread_sum(covered(at[hit], at[hit] + length[hit], n).astype(np.int64), w.ptr)

    first_byte = (w.data & 0xC0) != 0x80
    most = np.zeros(len(w.ptr) - 1, dtype=np.int64)
    np.maximum.at(most, w.text_of(), longest)
    return [
        w.counts(),
        A.spread_sum((first_byte & ~A._SEPARATOR[w.data]).astype(np.int64), w.offsets),
        A.spread_sum(_SYMBOL[w.data].astype(np.int64), w.offsets),
        duplicate_lines(w),
        in_spans(WINDOW, np.full(n, WINDOW)),
        in_spans(min_repeat, longest),
        most,
    ]


def quality_rules(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_repeat: int = MIN_REPEAT_WORDS,
    max_covered: float = MAX_COVERED,
    max_repeat: int = MAX_REPEAT_WORDS,
) -> DataFrame:
    """(id, statistics, base_failed, kept) for every row, null and empty texts included."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    fields = [T.StructField("id", rows.schema["id"].dataType)]
    fields += [T.StructField(name, T.LongType()) for name, _ in _STATS]

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        columns = [pa.array(c, type=pa.int64()) for c in statistics(part.column("text"), min_repeat)]
        return pa.RecordBatch.from_arrays(
            [part.column("id"), *columns], names=["id", *(name for name, _ in _STATS)]
        )

    stats = rows.mapInArrow(A.over_texts(kernel), T.StructType(fields))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    fine = (F.col("covered_words") <= max_covered * F.col("n_words")) & (
        F.col("longest_repeat") <= max_repeat
    )
    return stats.select(
        F.col("id").alias(id_column),
        *(name for name, _ in _STATS),
        failed.alias("base_failed"),
        (~failed & fine).alias("kept"),
    )

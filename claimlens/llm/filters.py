"""Filter interaction audit: what every order of five filters removes, from one count tensor.

Each document is reduced to five failure bits. Per part and bit pattern the documents are
counted, which gives a tensor of 2x2x2x2x2 (0: passes, 1: fails, one axis per filter) for all
documents, for the good and for the toxic ones. What a step of an order sees is then a
contraction: `pass` along the axes of the filters before it, `fail` along its own, `all`
along the others. Texts are read once and never shuffled; the rows that are shuffled hold
digests, and equal ones are combined before they move.

A document fails the filter of exact copies when a smaller id has its text. The smallest id
of a text is found by an aggregate over digests, and the row that has it by a join on digest
and id, so one text that many documents share is spread by their ids. Labels are joined on
id and a salt.

Defined results: a null text is empty, a null part is the empty string; a null id fails
nothing for being a copy, is no smaller id and has no labels; rows with equal id and text
are not copies of each other; labels count once per id, and an id labelled both ways counts
as good and as toxic; an empty table gives no rows; other input columns are not passed on,
so their names cannot clash.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from claimlens.session import durable

FILTERS = "ABCDE"
# Least words, least share of distinct words, most share of capitals, symbols.
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT, SYMBOLS = 100, 80, 10, "#$%&*|"
_WORD = r"[^\x20\x09-\x0D]+"
# Salts over which the rows of one id are spread when they meet its labels.
SALTS = 8
# Parts contracted at a time.
STEP_PARTS = 256

_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures(text: Column) -> list[Column]:
    """Whether a text that is not null fails each of the filters A to D."""
    words = F.regexp_extract_all(text, F.lit(f"({_WORD})"), 1)
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    symbol = F.lit(False)
    for s in SYMBOLS:
        symbol = symbol | F.contains(text, F.lit(s))
    return [
        n_words < MIN_WORDS,
        100 * n_distinct < MIN_DISTINCT_PERCENT * n_words,
        100 * capitals > MAX_CAPITAL_PERCENT * F.length(text),
        symbol,
    ]


def _bits(fails: list[Column]) -> Column:
    """The first filter is the highest of five bits."""
    return sum((F.when(f, 1 << (len(FILTERS) - 1 - i)).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def facts(docs: DataFrame, id_column: str, text_column: str, part_column: str) -> DataFrame:
    """(id, part, digest, mask, n): how many rows have these, with the bits of A to D."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("id"),
        F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        _bits(failures(text)).alias("mask"),
    )
    return rows.groupBy("digest", "id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))


def pattern_counts(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    part_column: str = "lang",
) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters they fail."""
    rows = durable(facts(docs, id_column, text_column, part_column))
    # The rows of the smallest id of each text; all others of that text are copies.
    smallest = rows.groupBy("digest").agg(F.min("id").alias("id"))
    first = rows.join(smallest, ["digest", "id"], "left_semi")
    known = rows.where(F.col("id").isNotNull())
    copy = F.lit(1)
    marks = (
        known.withColumn("mask", F.col("mask") + copy)
        .unionByName(rows.where(F.col("id").isNull()))
        .unionByName(first.withColumns({"mask": F.col("mask") + copy, "n": -F.col("n")}))
        .unionByName(first)
    )
    marked = (
        labels.where((F.col("quality") == 1) | (F.col("toxic") == 1))
        .groupBy(F.col(id_column).alias("id"))
        .agg(
            F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
            F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
        )
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    salted = marks.withColumn("salt", F.pmod(F.hash("digest"), F.lit(SALTS)))
    # Spark takes the salted labels for as small as the labels' files, and would broadcast them.
    labelled = salted.join(marked.hint("merge"), ["id", "salt"]).select(
        "part",
        "mask",
        F.lit(0).cast("long").alias("n"),
        (F.col("good") * F.col("n")).alias("good"),
        (F.col("toxic") * F.col("n")).alias("toxic"),
    )
    none = F.lit(0).cast("long")
    plain = marks.select("part", "mask", "n", none.alias("good"), none.alias("toxic"))
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    return plain.unionByName(labelled).groupBy("part", "mask").agg(*sums)


@lru_cache(maxsize=1)
def steps() -> tuple[list[tuple[str, int]], np.ndarray, np.ndarray, np.ndarray]:
    """All (order, step), the filter of each, and two selectors per step.

    A selector has for every axis the weights of passing and failing: (1, 0) selects what
    passes, (0, 1) what fails, (1, 1) all. The first selects what the step removes, the
    second what it keeps.
    """
    names, own, removed, kept = [], [], [], []
    passes, fails, both = (1, 0), (0, 1), (1, 1)
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[f] for f in order)
        for at, f in enumerate(order):
            before = set(order[:at])
            names.append((name, at + 1))
            own.append(f)
            base = [passes if x in before else both for x in range(len(FILTERS))]
            removed.append([fails if x == f else s for x, s in enumerate(base)])
            kept.append([passes if x == f else s for x, s in enumerate(base)])
    return names, np.array(own), np.array(removed), np.array(kept)


def _contract(tensor: np.ndarray, selector: np.ndarray) -> np.ndarray:
    """Sums of tensor[part, what, a, b, c, d, e] as each row of the selector picks them."""
    s = [selector[:, axis] for axis in range(len(FILTERS))]
    return np.einsum("pwabcde,za,zb,zc,zd,ze->pwz", tensor, *s, optimize="greedy")


def interactions(tensor: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every part and step, as (parts, steps) arrays, from (parts, 3, 2, 2, 2, 2, 2)."""
    _, own, removed, kept = steps()
    n = len(FILTERS)
    gone = _contract(tensor, removed)
    only = np.array([[[0, 1] if x == f else [1, 0] for x in range(n)] for f in range(n)])
    fail = np.array([[[0, 1] if x == f else [1, 1] for x in range(n)] for f in range(n)])
    alone = _contract(tensor[:, :1], only)[:, 0]
    failing = _contract(tensor[:, :1], fail)[:, 0]
    shapley = np.stack([gone[:, 0, own == f].sum(1) for f in range(n)], axis=1)
    return {
        "kept": _contract(tensor[:, :1], kept)[:, 0],
        "removed": gone[:, 0],
        "redundant": failing[:, own] - gone[:, 0],
        "unique_fails": alone[:, own],
        "good_lost": gone[:, 1],
        "toxic_lost": gone[:, 2],
        "shapley": shapley[:, own],
    }


def audit(counts: DataFrame) -> DataFrame:
    """One row per part, order and step, from the counts by part and mask."""
    what = ("n", "good", "toxic")
    size = 1 << len(FILTERS)
    cells = [F.sum(F.when(F.col("mask") == m, F.col(w))) for w in what for m in range(size)]
    zero = F.lit(0).cast("long")
    tensors = counts.groupBy("part").agg(F.array(*[F.coalesce(c, zero) for c in cells]).alias("t"))
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS)

    def task(batches):
        names = steps()[0]
        orders, at = (pa.array(c) for c in zip(*names))
        for batch in batches:
            for low in range(0, batch.num_rows, STEP_PARTS):
                some = batch.slice(low, STEP_PARTS)
                cells = some.column("t").flatten().to_numpy(zero_copy_only=False)
                found = interactions(cells.reshape(-1, len(what), *[2] * len(FILTERS)))
                n = some.num_rows
                part = some.column("part").take(pa.array(np.repeat(np.arange(n), len(names))))
                yield pa.RecordBatch.from_arrays(
                    [
                        part,
                        pa.concat_arrays([orders] * n),
                        pa.concat_arrays([at.cast(pa.int32())] * n),
                        *(pa.array(found[c].ravel(), pa.int64()) for c in _COUNTS),
                    ],
                    names=["part", "filter_order", "step", *_COUNTS],
                )

    return tensors.mapInArrow(task, schema)

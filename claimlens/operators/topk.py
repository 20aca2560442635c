"""Helpers shared by the exact top-k joins: a running top-k and size-checked collection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

HITS_SCHEMA = "query_id long, item_id long, score double"
_ARROW = pa.schema([("query_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64())])
# Score-matrix cells per numpy step: 4M doubles, 32 MB.
STEP_CELLS = 4_000_000


class RunningTopK:
    """The k best (score desc, id asc) items per query, over any number of offers."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.score = np.full((n_queries, k), -np.inf)
        self.item = np.full((n_queries, k), np.iinfo(np.int64).max, dtype=np.int64)

    def offer(
        self,
        scores: np.ndarray,
        ids: np.ndarray,
        rows: np.ndarray | None = None,
        floor: np.ndarray | None = None,
        digits: int | None = None,
    ) -> None:
        """scores is queries x items; -inf marks a pair that is no hit, as does NaN.

        The queries are all of them or those at `rows`. Scores below a query's `floor` are left
        out. With `digits` scores are rounded first, which is done for those that can enter only.
        """
        k = self.k
        rows = np.arange(len(scores)) if rows is None else rows
        least = self.score[rows, -1]
        if floor is not None:
            least = np.maximum(least, floor)
        margin = 0.0 if digits is None else 10.0**-digits
        near = least - margin
        hit = scores >= near[:, None]
        if scores.shape[1] > k and np.count_nonzero(hit) > 4 * k * len(scores):
            known = np.where(np.isnan(scores), -np.inf, scores)
            kth = np.partition(known, scores.shape[1] - k, axis=1)[:, -k]
            near = np.maximum(near, kth - margin)
            hit = scores >= near[:, None]
        if len(near) and near.min() == -np.inf:
            hit &= scores > -np.inf
        q, i = np.nonzero(hit)
        vals = scores[q, i] if digits is None else np.round(scores[q, i], digits)
        own = self.score[rows[q], -1]
        enters = (vals >= least[q]) & ((vals > own) | (ids[i] < self.item[rows[q], -1]))
        q, i, vals = q[enters], i[enters], vals[enters]
        if not len(q):
            return
        touched, local = np.unique(q, return_inverse=True)
        held = rows[touched]
        lines = np.concatenate([np.repeat(np.arange(len(touched)), k), local])
        vals = np.concatenate([self.score[held].ravel(), vals])
        items = np.concatenate([self.item[held].ravel(), ids[i]])
        order = np.lexsort((items, -vals, lines))
        starts = np.searchsorted(lines[order], np.arange(len(touched)))
        best = order[(starts[:, None] + np.arange(k)).ravel()]
        self.score[held] = vals[best].reshape(-1, k)
        self.item[held] = items[best].reshape(-1, k)

    def to_arrow(self, query_ids: np.ndarray) -> pa.RecordBatch:
        found = self.score > -np.inf
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(query_ids, self.k)[found.ravel()]),
                pa.array(self.item[found]),
                pa.array(self.score[found]),
            ],
            schema=_ARROW,
        )


def steps(n_items: int, n_queries: int):
    """Slices of the items that keep one score matrix within STEP_CELLS."""
    size = max(1, STEP_CELLS // max(1, n_queries))
    return (slice(s, s + size) for s in range(0, n_items, size))


def best_per_query(hits: DataFrame, k: int) -> DataFrame:
    """Rank partial hits; Spark prunes each map task to k rows per query before the shuffle."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("item_id"))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def collect_if_small(df: DataFrame, max_rows: int) -> pa.Table | None:
    """The rows, when there are at most max_rows of them; else None.

    The limit is the size check: no more than max_rows + 1 rows ever leave Spark.
    """
    table = df.limit(max_rows + 1).toArrow()
    return table if table.num_rows <= max_rows else None


def spread(key: Column, n: Column | int) -> Column:
    """Even, repeatable share 0..n-1 of a key."""
    return F.pmod(F.xxhash64(key), n if isinstance(n, Column) else F.lit(n)).cast("long")


def every(n: Column | int) -> Column:
    """One row for each of 0..n-1."""
    top = n if isinstance(n, Column) else F.lit(n)
    return F.explode(F.sequence(F.lit(0).cast("long"), top.cast("long") - 1))

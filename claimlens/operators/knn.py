"""Exact top-k join by inner product.

Few queries: they are broadcast (their size is checked) and every task keeps a running
top-k over its share of the items; the items are not shuffled at all.

Many queries: a Voronoi-partitioned kNN join (Lu et al., "Efficient Processing of k
Nearest Neighbor Joins using MapReduce", VLDB 2012). Items go to the cell of their
nearest pivot. A cell that holds too many is parted once more, by pivots of its own, so
that cells stay small as items grow; an item is then compared with the first pivots and
those of its cell only. A query first searches the cells next to it, which bounds its k-th
score, and then only those cells that the triangle inequality cannot rule out. Cells are
put together to bins of some thousand items, and a query goes to each bin once, however many
of its cells it must see: where bounds do not help, as with many dimensions, all pairs are
compared block by block, and rows are copied once per block of the other side. Full
cells are split into blocks of limited size on both sides, so a cell that holds a
third of all rows becomes many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from claimlens.functions.vectors import SCORE_DIGITS
from claimlens.operators.topk import (
    HITS_SCHEMA,
    RunningTopK,
    best_per_query,
    collect_if_small,
    every,
    spread,
    steps,
)
from claimlens.session import durable

# Queries are broadcast up to this many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 8_192, 64 << 20
MAX_PIVOTS = 1024
# A cell of more items gets pivots of its own, about one for each so many items. All pivots
# together are broadcast: beyond `MAX_LEAVES` of them cells grow again.
CELL_ROWS, MAX_LEAVES = 16_384, 32_768
BLOCK_ROWS = 16_384
# Blocks of a side while they stay below `BLOCK_ROWS`: smaller ones would only be copied more
# often, larger ones leave cores idle.
MANY_BLOCKS, LEAST_BLOCK = 16, 1_024
# Room for rounded scores and float storage when a cell is ruled out.
SLACK = 1e-5


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) and not pc.all(pc.equal(pc.list_value_length(column), dim)).as_py():
        raise ValueError(f"a vector does not have the {dim} components of the first query")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), dim)


def _ids(column) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(
        zero_copy_only=False
    )


def _comparable(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows can be compared, their vectors), as `_usable` tells them."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    odd = np.bincount(row[~np.isfinite(flat)], minlength=len(sizes)) > 0
    fine = ~odd & (sizes > 0)
    if (sizes[fine] != dim).any():
        raise ValueError(f"a vector does not have the {dim} components of the first query")
    return fine, (flat if fine.all() else flat[fine[row]]).reshape(-1, dim)


def _rows(df: DataFrame, id_col: str, name: str, vector: str) -> DataFrame:
    """(id as long, v as array<float> or else array<double>)."""
    kind = df.select(vector).schema[0].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    return df.select(F.col(id_col).cast("long").alias(name), F.col(vector).cast(kind).alias("v"))


def _usable(rows: DataFrame) -> DataFrame:
    """The rows that can be compared."""
    fine = F.forall("v", lambda x: x.isNotNull() & (x * 0 == 0)) & (F.size("v") > 0)
    return rows.where(F.col("v").isNotNull() & fine)


def knn_join(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    query_id: str,
    item_id: str,
    vector: str = "embedding",
    strategy: str = "auto",
    broadcast_rows: int = BROADCAST_ROWS,
    max_pivots: int = MAX_PIVOTS,
    block_rows: int = BLOCK_ROWS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(query_id, item_id, score, rank): the k best items per query, ties by item id.

    Scores are rounded to the ranking precision. Rows whose vector is null, empty, or holds a
    null or a number that is not finite take no part; vectors of different lengths are an
    error. With fewer than k items all of them are returned.
    """
    q, i = _usable(_rows(queries, query_id, "query_id", vector)), _rows(items, item_id, "item_id", vector)
    small = None
    if strategy in ("auto", "broadcast"):
        # Rows and bytes are counted in Spark before anything is collected.
        size = q.limit(broadcast_rows + 1).agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(8 * F.size("v")), F.lit(0)).alias("bytes")
        ).first()
        if size["n"] <= broadcast_rows and size["bytes"] <= BROADCAST_BYTES:
            small = collect_if_small(q, broadcast_rows)
        if small is None and strategy == "broadcast":
            raise ValueError("queries exceed the broadcast limit")
    if small is not None:
        hits = _scan(i, small, k)
    else:
        hits = _cells(q, _usable(i), k, max_pivots, block_rows, cell_rows)
    return best_per_query(hits, k).select(
        F.col("query_id").alias(query_id), "item_id", "score", "rank"
    )


def _scan(items: DataFrame, queries: pa.Table, k: int) -> DataFrame:
    if queries.num_rows == 0:
        return items.sparkSession.createDataFrame([], HITS_SCHEMA)
    ids = _ids(queries.column("query_id"))
    dim = len(queries.column("v")[0])
    shared = items.sparkSession.sparkContext.broadcast((ids, _matrix(queries.column("v"), dim)))

    def task(batches):
        qids, qmat = shared.value
        top = RunningTopK(len(qids), k)
        for b in batches:
            fine, m = _comparable(b.column(1), qmat.shape[1])
            ids = _ids(b.column(0))[fine]
            for part in steps(len(m), len(qids)):
                top.offer(qmat @ m[part].T, ids[part], digits=SCORE_DIGITS)
        yield top.to_arrow(qids)

    return items.mapInArrow(task, HITS_SCHEMA)


def _cell_sizes(placed: DataFrame):
    """Items, radius and largest squared length of each cell; one row per pivot."""
    sizes = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius"), F.max("norm2").alias("norm2")
    )
    return sizes.toArrow().to_pandas().sort_values("cell")


def _parted(placed: DataFrame, stats, pivots: np.ndarray, cell_rows: int):
    """(items with the cells they have after large ones are parted, all pivots).

    The pivots of a large cell are its first one and a share of its items chosen by hash.
    """
    total = int(stats["n"].sum())
    cell_rows = max(cell_rows, -(-total // MAX_LEAVES))
    big = stats["cell"][stats["n"] > cell_rows].tolist()
    if not big:
        return placed, pivots
    chosen = F.pmod(F.xxhash64("item_id", F.lit("pivot")), F.lit(cell_rows)) == 0
    # About one row for each cell_rows items, at most MAX_LEAVES or so.
    own = placed.where(F.col("cell").isin(big) & chosen).select("cell", "v").toArrow()
    dim = pivots.shape[1]
    cell = np.concatenate([np.arange(len(pivots)), own.column("cell").to_numpy()])
    every_ = np.concatenate([pivots, _matrix(own.column("v"), dim)]) if own.num_rows else pivots
    order = np.argsort(cell, kind="stable")
    leaves, cell = every_[order], cell[order]
    bounds = np.searchsorted(cell, np.arange(len(pivots) + 1))
    shared = placed.sparkSession.sparkContext.broadcast((leaves, bounds))

    def part(batches):
        leaves, bounds = shared.value
        for b in batches:
            m = _matrix(b.column(1), dim)
            cells = b.column(2).to_numpy(zero_copy_only=False)
            dist = b.column(3).to_numpy(zero_copy_only=False).copy()
            leaf = bounds[cells]
            for c in np.unique(cells):
                mine = leaves[bounds[c] : bounds[c + 1]]
                if len(mine) > 1:
                    rows = np.flatnonzero(cells == c)
                    for some in steps(len(rows), 4 * len(mine)):
                        at = rows[some]
                        x = m[at]
                        d2 = (x**2).sum(1)[:, None] + (mine**2).sum(1)[None, :] - 2 * x @ mine.T
                        near = d2.argmin(axis=1)
                        leaf[at] = bounds[c] + near
                        dist[at] = np.sqrt(np.maximum(d2[np.arange(len(x)), near], 0))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(leaf.astype(np.int64)), pa.array(dist), b.column(4)],
                names=b.schema.names,
            )

    return durable(placed.mapInArrow(part, placed.schema)), leaves


def _cells(
    q: DataFrame, i: DataFrame, k: int, max_pivots: int, block_rows: int, cell_rows: int
) -> DataFrame:
    spark = q.sparkSession
    # Read several times below: fixed once, so that a costly encoder runs once.
    q, i = durable(q), durable(i)
    n_items = i.count()
    if n_items == 0:
        return spark.createDataFrame([], HITS_SCHEMA)
    n_pivots = int(min(max_pivots, max(1, round(n_items**0.5))))
    seed = F.md5(F.col("item_id").cast("string"))
    # At most max_pivots rows reach the driver.
    sample = i.orderBy(seed, "item_id").limit(n_pivots).select("v").toArrow()
    dim = len(sample.column("v")[0])
    pivots = np.unique(_matrix(sample.column("v"), dim), axis=0)
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches):
        piv = shared.value
        p2 = (piv**2).sum(axis=1)
        for b in batches:
            m = _matrix(b.column(1), piv.shape[1])
            for part in steps(len(m), 4 * len(piv)):
                x = m[part]
                x2 = (x**2).sum(axis=1)
                d2 = np.maximum(x2[:, None] + p2[None, :] - 2 * x @ piv.T, 0)
                cell = d2.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0)[part.start : part.start + len(x)],
                        b.column(1)[part.start : part.start + len(x)],
                        pa.array(cell.astype(np.int64)),
                        pa.array(np.sqrt(d2[np.arange(len(x)), cell])),
                        pa.array(x2),
                    ],
                    names=["item_id", "v", "cell", "dist", "norm2"],
                )

    # Read for the sizes of cells and by both probes: placed once.
    placed = durable(
        i.mapInArrow(assign, f"item_id long, v {_kind(i)}, cell long, dist double, norm2 double")
    )
    stats = _cell_sizes(placed)
    placed, leaves = _parted(placed, stats, pivots, cell_rows)
    if leaves is not pivots:
        stats = _cell_sizes(placed)
    n = stats["n"].to_numpy()
    rows = _block(n_items, block_rows)
    # Bins of neighbouring cells, of one block or so; a larger cell has a bin of its own.
    alone = np.stack([(np.cumsum(n) - n) // rows, np.where(n > rows, np.arange(len(n)), -1)])
    bins = np.unique(alone, axis=1, return_inverse=True)[1].ravel()
    cell = stats["cell"].to_numpy()
    found = _Cells(cell, leaves[cell], n, stats["radius"].to_numpy(), stats["norm2"].to_numpy(), bins)
    shared = spark.sparkContext.broadcast(found)
    blocks = np.where(n > rows, -(-n // rows), 1)
    sizes = spark.createDataFrame(
        list(zip(cell.tolist(), bins.tolist(), blocks.tolist(), strict=True)), "cell long, bin long, n_blocks long"
    )
    n_queries = q.count()
    share_rows = _block(n_queries, block_rows)
    # Few groups are much work: they are dealt to tasks by number and not by size.
    groups = int(bins.max() + 1) * max(1, -(-n_queries // share_rows))
    n_tasks = min(groups, max(4 * spark.sparkContext.defaultParallelism, groups // 4))

    near = _probe(_routes(q.withColumn("floor", F.lit(None).cast("double")), shared, k), placed, sizes, shared, k, dim, share_rows, n_tasks)
    floor = best_per_query(near, k).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("score").alias("worst")
    )
    # Read for the load of bins and for the search.
    known = durable(
        q.join(floor, "query_id", "left").select(
            "query_id",
            "v",
            F.when(F.col("n") >= k, F.col("worst")).otherwise(F.lit(float("-inf"))).alias("floor"),
        )
    )
    # The cells next to a query can hold its k-th hit, so this search finds all of its hits.
    return _probe(_routes(known, shared, k), placed, sizes, shared, k, dim, share_rows, n_tasks)


def _kind(df: DataFrame) -> str:
    return df.schema["v"].dataType.simpleString()


def _block(n: int, block_rows: int) -> int:
    """Rows of a block when a side has n of them."""
    return max(min(block_rows, LEAST_BLOCK), min(max(block_rows, BLOCK_ROWS), -(-n // MANY_BLOCKS)))


@dataclass(frozen=True)
class _Cells:
    """Ids, pivots, sizes, radii, largest squared lengths and bins of all cells, by id."""

    ids: np.ndarray
    pivots: np.ndarray
    n: np.ndarray
    radius: np.ndarray
    norm2: np.ndarray
    bins: np.ndarray

    def home(self, x: np.ndarray, k: int) -> np.ndarray:
        """queries x cells: the nearest cells that hold k items together."""
        d2 = _square_distances(x, self.pivots)
        out = np.zeros(d2.shape, dtype=bool)
        first = d2.argmin(axis=1)
        out[np.arange(len(x)), first] = True
        more = np.flatnonzero(self.n[first] < k)
        order = d2[more].argsort(axis=1, kind="stable")
        np.put_along_axis(held := out[more], order, np.cumsum(self.n[order], axis=1) - self.n[order] < k, axis=1)
        out[more] = held
        return out

    def reach(self, x: np.ndarray, floors: np.ndarray, at: slice | np.ndarray) -> np.ndarray:
        """queries x cells at `at`: those that may hold an item with a score of the floor or more."""
        gap = np.maximum(np.sqrt(_square_distances(x, self.pivots[at])) - self.radius[at], 0)
        room = (x**2).sum(axis=1)[:, None] + self.norm2[at]
        return (room - gap**2) / 2 + SLACK * (1 + room) >= floors[:, None]


def _square_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * x @ pivots.T, 0)


def _routes(q: DataFrame, shared, k: int) -> DataFrame:
    """(query_id, v, floor, cell, bin): the cells a query must see, those next to it without a floor.

    A bin looks for the cells in reach of a floor by itself, so the vector goes there once: the
    other rows of the bin have none.
    """

    def task(batches):
        cells = shared.value
        for b in batches:
            m = _matrix(b.column(1), cells.pivots.shape[1])
            floors = b.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            # Several arrays of queries x cells at once, and routes with their columns.
            for part in steps(len(m), 8 * len(cells.ids)):
                x, f = m[part], floors[part]
                near = np.isnan(f)
                go = cells.reach(x, f, slice(None))
                go[near] = cells.home(x[near], k)
                r, c = np.nonzero(go)
                bins = cells.bins[c]
                first = np.ones(len(r), dtype=bool)
                first[1:] = near[r[1:]] | (r[1:] != r[:-1]) | (bins[1:] != bins[:-1])
                at = r + part.start
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(at)),
                        b.column(1).take(pa.array(at, mask=~first)),
                        b.column(2).take(pa.array(at)),
                        pa.array(cells.ids[c]),
                        pa.array(bins.astype(np.int64)),
                    ],
                    names=["query_id", "v", "floor", "cell", "bin"],
                )

    return q.mapInArrow(task, f"query_id long, v {_kind(q)}, floor double, cell long, bin long")


def _probe(
    routes: DataFrame, placed: DataFrame, sizes: DataFrame, shared, k: int, dim: int, share_rows: int, n_tasks: int
) -> DataFrame:
    """Score routed queries against the items of their cells, block by block.

    `sizes` has one row per cell and `load` one per bin, which is what makes broadcasting them safe.
    """
    asked = routes.where(F.col("v").isNotNull())
    load = asked.groupBy("bin").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(share_rows)).cast("long").alias("n_shares")
    )
    # Made again for the join, which costs less than to store it; the load is small.
    load = durable(load)
    bins = sizes.groupBy("bin").agg(F.max("n_blocks").alias("n_blocks"))
    left = (
        asked.join(F.broadcast(bins), "bin")
        .join(F.broadcast(load), "bin")
        .select(
            "query_id",
            "v",
            "floor",
            "cell",
            "bin",
            spread(F.col("query_id"), F.col("n_shares")).alias("share"),
            every(F.col("n_blocks")).alias("block"),
        )
    )
    right = (
        placed.join(F.broadcast(sizes), "cell")
        .join(F.broadcast(load), "bin")
        .select(
            "item_id",
            "v",
            "cell",
            "bin",
            every(F.col("n_shares")).alias("share"),
            spread(F.col("item_id"), F.col("n_blocks")).alias("block"),
        )
    )

    def score(queries: pa.Table, items: pa.Table) -> pa.Table:
        qids, ids = _ids(queries.column("query_id")), _ids(items.column("item_id"))
        top = RunningTopK(len(qids), k)
        if len(qids) and len(ids):
            cells = shared.value
            x, y = _matrix(queries.column("v"), dim), _matrix(items.column("v"), dim)
            floors = queries.column("floor").to_numpy().astype(np.float64)
            near, own = np.isnan(floors), queries.column("cell").to_numpy()
            held = items.column("cell").to_numpy()
            # Ascending ids: of equal scores the first ones stay.
            order = np.lexsort((ids, held))
            found, start = np.unique(held[order], return_index=True)
            stop = np.append(start[1:], len(held))
            at = np.searchsorted(cells.ids, found)
            floors = np.where(near, -np.inf, floors)
            for some in steps(len(found), 8 * len(qids)):
                go = cells.reach(x, floors, at[some])
                go[near] = own[near][:, None] == found[some]
                for c, lo, hi in zip(range(go.shape[1]), start[some], stop[some], strict=True):
                    rows = np.flatnonzero(go[:, c])
                    mine, wanted = order[lo:hi], x[rows]
                    for part in steps(len(mine) if len(rows) else 0, len(rows)):
                        few = mine[part]
                        top.offer(wanted @ y[few].T, ids[few], rows, floors[rows], SCORE_DIGITS)
        return pa.Table.from_batches([top.to_arrow(qids)])

    keys = ["bin", "share", "block"]
    left, right = (side.repartition(n_tasks, *keys) for side in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, HITS_SCHEMA)

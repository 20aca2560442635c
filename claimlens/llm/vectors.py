"""Embedding near-dedup: sign hashing in several tables, exact cosines, components.

Equal vectors form one class, of which one member goes on. In each of `tables`
tables a class has as its key the signs of its products with `bits` random hyperplanes;
classes that share a key are compared exactly. Two vectors at the threshold share a key
of one table with a known probability, so the number of tables follows from the wanted
`RECALL`; the number of bits grows with the logarithm of the number of classes, which
keeps buckets small.

A bucket of more than `BLOCK` classes is split into blocks and each pair of blocks is a
group of its own, so hot buckets are spread over tasks. A link is counted in the
first table in which its ends share a key. Groups hand on only each member's number
of links and one link to its group's smallest connected member, never all pairs.

Defined results: vectors that are null, zero, or hold null or non-finite components link
with nothing, nor do vectors of different lengths; a row with a null id links with
nothing; repeated rows are vectors of their own with equal results; an empty table
gives an empty one; other input columns are not passed on.
"""

from __future__ import annotations

from functools import lru_cache
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from claimlens.llm import arrays as A
from claimlens.llm.components import components
from claimlens.session import durable

MIN_COSINE = 0.9
RECALL = 0.998
BLOCK = 1_024


def layout(n: int, min_cosine: float = MIN_COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for n vectors."""
    bits = max(4, round(log2(max(n, 2))) - 6)
    agree = (1 - acos(min_cosine) / pi) ** bits
    return bits, max(1, ceil(log(1 - recall) / log(1 - agree)))


@lru_cache(maxsize=16)
def planes(dim: int, bits: int, tables: int) -> np.ndarray:
    """Normal vectors of the hyperplanes, the same for equal arguments; made once per worker."""
    return np.random.default_rng([dim, bits, tables]).normal(size=(dim, tables * bits))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1, in double precision."""
    x = x.astype(np.float64)
    # Scaled first, so that very large or small numbers keep a length.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def keys(x: np.ndarray, normals: np.ndarray, bits: int) -> np.ndarray:
    """Key of each vector in each table."""
    signs = (x @ normals > 0).reshape(len(x), -1, bits)
    return (signs * (1 << np.arange(bits, dtype=np.int64))).sum(2)


def links_in_group(x, members, ids, own_first, cross, table, normals, bits, min_cosine):
    """(position, number of links, smallest connected id) of the classes with links.

    Links whose ends share a key of an earlier table are left to that table. `cross`: only
    links between the two blocks, told apart by `own_first`, count here.
    """
    cosine = x @ x.T
    i, j = np.nonzero(np.triu(cosine >= min_cosine, 1))
    if cross:
        apart = own_first[i] != own_first[j]
        i, j = i[apart], j[apart]
    if len(i) and table:
        used, where = np.unique(np.concatenate([i, j]), return_inverse=True)
        early = keys(x[used], normals[:, : table * bits], bits)
        a, b = where[: len(i)], where[len(i) :]
        fresh = np.ones(len(i), dtype=bool)
        for at in range(0, len(i), 65_536):
            part = slice(at, at + 65_536)
            fresh[part] = ~(early[a[part]] == early[b[part]]).any(1)
        i, j = i[fresh], j[fresh]
    if not len(i):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(ids)
    count = np.bincount(i, members[j], n) + np.bincount(j, members[i], n)
    root = ids.copy()
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        if (root == before).all():
            break
    at = np.unique(np.concatenate([i, j]))
    return at, count[at].astype(np.int64), root[at]


def near_duplicates(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    min_cosine: float = MIN_COSINE,
    recall: float = RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    v = F.col(vector_column)
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v")
    )
    # Only finite numbers are left when those times zero are all zero.
    fine = F.forall("v", lambda x: x.isNotNull() & (x * 0 == 0)) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(F.col("id").isNotNull() & fine, F.col("v")))
    rows = rows.withColumns({"h": F.xxhash64("v"), "g": F.hash("v")})
    valid = rows.where(F.col("v").isNotNull())
    classes = durable(
        valid.groupBy("h", "g").agg(
            F.min("id").alias("rep"), F.count(F.lit(1)).alias("members"), F.first("v").alias("v")
        )
    )
    n_classes = classes.count()
    bits, tables = layout(n_classes, min_cosine, recall)

    # Vectors travel as they came: single precision holds all of a float column.
    single = isinstance(vectors.schema[vector_column].dataType.elementType, T.FloatType)
    number = np.float32 if single else np.float64

    def unit(column: pa.Array) -> np.ndarray:
        x = np.frombuffer(b"".join(column.to_pylist()), dtype=number)
        return unit_rows(x.reshape(len(column), -1))

    def hashed(batches):
        """A row for each class and table, with the vector as bytes."""
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = A.list_sizes(batch.column("v"))
            ids, members = (batch.column(c).to_numpy() for c in ("rep", "members"))
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes):
                for some in np.array_split(np.flatnonzero(sizes == dim), ceil((sizes == dim).sum() / 2_000)):
                    x = np.stack([flat[at[r] : at[r + 1]] for r in some])
                    key = keys(unit_rows(x), planes(int(dim), bits, tables), bits)
                    body = [row.tobytes() for row in x.astype(number)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.tile(np.arange(tables, dtype=np.int32), len(some))),
                            pa.array(np.full(len(some) * tables, dim, dtype=np.int32)),
                            pa.array(key.ravel()),
                            pa.array(np.repeat(ids[some], tables)),
                            pa.array(np.repeat(members[some], tables)),
                            pa.array([b for b in body for _ in range(tables)], pa.binary()),
                        ],
                        names=["t", "dim", "key", "rep", "members", "x"],
                    )

    entry = classes.select("rep", "members", "v").mapInArrow(
        hashed, "t int, dim int, key long, rep long, members long, x binary"
    )
    bucket = ["t", "dim", "key"]
    sizes = entry.select(*bucket).groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # A class alone in its bucket has nothing to be compared with there.
    placed = entry.join(sizes, bucket).withColumn("s", F.ceil(F.col("n") / block).cast("int"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("s")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    group = [*bucket, "lo", "hi"]
    placed = placed.select(
        *bucket,
        F.least("own", "other").alias("lo"),
        F.greatest("own", "other").alias("hi"),
        (F.col("own") <= F.col("other")).alias("first"),
        "rep",
        "members",
        "x",
    )

    def compare(batches):
        """Groups arrive one after the other; the last of a batch waits for its rest."""
        carry = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if carry is None else pa.concat_tables([carry, table]).combine_chunks()
            code = np.stack([table.column(c).to_numpy().astype(np.int64) for c in group], axis=1)
            new = np.flatnonzero((code[1:] != code[:-1]).any(1)) + 1
            last = int(new[-1]) if len(new) else 0
            carry = table.slice(last)
            if last:
                yield from done(table.slice(0, last), code[:last], np.concatenate([[0], new]))
        if carry is not None and carry.num_rows:
            code = np.stack([carry.column(c).to_numpy().astype(np.int64) for c in group], axis=1)
            yield from done(carry, code, np.array([0, carry.num_rows]))

    def done(table, code, bounds):
        ids, members = (table.column(c).to_numpy() for c in ("rep", "members"))
        first = table.column("first").to_numpy()
        body = table.column("x").combine_chunks()
        out = [[], [], []]
        for a, b in zip(bounds, bounds[1:]):
            if b - a < 2:
                continue
            t, dim, _, lo, hi = code[a]
            x = unit(body.slice(a, b - a))
            at, count, root = links_in_group(
                x, members[a:b], ids[a:b], first[a:b], lo != hi, int(t), planes(int(dim), bits, tables), bits, min_cosine
            )
            for to, what in zip(out, (ids[a:b][at], count, root)):
                to.append(what)
        if out[0]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["rep", "links", "root"]
            )

    found = durable(
        placed.repartition(*group)
        .sortWithinPartitions(*group)
        .mapInArrow(compare, "rep long, links long, root long")
        .groupBy("rep", "root")
        .agg(F.sum("links").alias("links"))
    )
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found, "rep", "root").withColumnRenamed("id", "rep")
    result = (
        classes.drop("v")
        .join(links, "rep", "left")
        .join(roots, "rep", "left")
        .select(
            "h",
            "g",
            (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    lone = rows.where(F.col("v").isNull()).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
    )
    all_ = valid.select("id", "h", "g").join(result, ["h", "g"]).select("id", "n_links", "component_id")
    return all_.unionByName(lone).select(
        F.col("id").alias(id_column),
        "n_links",
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )

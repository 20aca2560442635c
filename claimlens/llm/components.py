"""Connected components of a table of links, by alternating large and small stars.

Every round replaces links by links to smaller ids without losing a connection, until
each node links to the smallest id of its component only. Minima are combined in the map
tasks; the joins are inner joins by node, whose rows hold two numbers. A node of very many
links has them in one task of such a join, which Spark does not split next to an aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimlens.session import durable


def _mark(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The links stored, and a fingerprint of the whole table to see when it stays as it is."""
    links = durable(links.distinct())
    code = F.xxhash64("u", "v").cast("decimal(20,0)")
    row = links.agg(F.count(F.lit(1)), F.sum(code), F.bit_xor(F.xxhash64("v", "u"))).first()
    return links, tuple(row)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) of every id with a link to another one; component is its smallest id.

    Links with a null end or from an id to itself connect nothing.
    """
    links = links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    )
    links, state = _mark(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.withColumnRenamed("m", "v"))
        links, new_state = _mark(small)
        if new_state == state:
            break
        state = new_state
    root = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return root.unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())

"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimlens.llm.tables import fold


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    modulus: int,
    held_out: int,
    rows: int,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(id, text, label) of at most `rows` labelled documents outside the held-out fold.

    The ids with the smallest hashes are taken, which is a uniform sample that does not
    depend on the order of rows. Ids with a null or two different labels are left out.
    The chosen ids are at most `rows`, so they are broadcast; texts are read in place.
    An id that is stored several times gives one row, the text with the smallest hash,
    chosen in the map tasks before anything is shuffled.
    """
    known = (
        labels.where(F.col(id_column).isNotNull() & (fold(id_column, modulus) != held_out))
        .groupBy(F.col(id_column).alias("_id"))
        .agg(F.min(label).alias("label"), F.max(label).alias("_most"))
        .where((F.col("label") == F.col("_most")) & F.col("label").isin(0, 1))
    )
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(rows).select("_id", "label")
    texts = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("text"))
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"]
    return (
        texts.join(F.broadcast(chosen), "_id")
        .groupBy(F.col("_id").alias("id"))
        .agg(one.alias("text"), F.first("label").alias("label"))
    )

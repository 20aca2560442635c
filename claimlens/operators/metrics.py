"""Corpus statistics, confusion counts and macro precision / recall / F1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimlens.functions.verdict import evaluated_label


def corpus_stats(evidence: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows and distinct sources."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return evidence.agg(
        F.count(F.lit(1)).alias("n_rows"), distinct("source_url").alias("n_sources")
    )


# Size of a sketch: 2**16 registers tell distinct values to about half a percent.
LG_K = 16


def sketch_batches(rows: DataFrame, batch: Column, *columns: str) -> DataFrame:
    """(batch, n_rows, a sketch of the distinct values of each column): small rows to store.

    Nulls are not counted. The function leaves empty strings out, so a mark goes in front.
    """
    marked = {c: F.concat(F.lit("="), F.col(c).cast("string")) for c in columns}
    sketches = [F.hll_sketch_agg(v, F.lit(LG_K)).alias(c) for c, v in marked.items()]
    return rows.groupBy(batch.alias("batch")).agg(F.count(F.lit(1)).alias("n_rows"), *sketches)


def merged_counts(sketches: DataFrame, *columns: str) -> DataFrame:
    """Rows and distinct values over any batches, from their stored sketches."""
    counts = [F.hll_sketch_estimate(F.hll_union_agg(c)).alias(f"n_{c}") for c in columns]
    return sketches.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), *counts)


def predicted_labels(predictions: DataFrame) -> DataFrame:
    """Add `pred`, the label each prediction stands for."""
    return predictions.withColumn(
        "pred",
        evaluated_label(F.col("label"), F.col("predicted_label"), F.col("raw_output")),
    )


def confusion(pairs: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(label, tp, n_gold, n_pred) over all labels that occur on either side."""
    cells = pairs.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("gold").eqNullSafe(F.col("pred")), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(
            F.col("gold").alias("label"), hit.alias("tp"), F.col("n").alias("g"), zero.alias("p")
        ),
        F.struct(
            F.col("pred").alias("label"), zero.alias("tp"), zero.alias("g"), F.col("n").alias("p")
        ),
    )
    return (
        cells.select(F.inline(sides))
        .groupBy("label")
        .agg(F.sum("tp").alias("tp"), F.sum("g").alias("n_gold"), F.sum("p").alias("n_pred"))
    )


def macro_prf(counts: DataFrame) -> DataFrame:
    """Unweighted means over the labels; a ratio without a denominator counts as 0."""

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    p = ratio(F.col("tp"), F.col("n_pred"))
    r = ratio(F.col("tp"), F.col("n_gold"))
    f = ratio(2 * F.col("tp"), F.col("n_pred") + F.col("n_gold"))
    return counts.agg(
        F.round(F.avg(p), 6).alias("precision"),
        F.round(F.avg(r), 6).alias("recall"),
        F.round(F.avg(f), 6).alias("f1"),
    )

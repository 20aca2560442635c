"""Vector expressions; sums run in array order in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SCORE_DIGITS = 6


def dot(a: Column, b: Column) -> Column:
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda acc, v: acc + v)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def with_unit_vector(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Divide by the L2 norm; a zero vector stays as it is.

    The norm is its own column, read twice, so that it is computed once per row
    and not once per element inside the lambda.
    """
    out = out or col
    df = df.withColumn("_norm", norm(F.col(col)))
    unit = F.transform(F.col(col), lambda x: x.cast("double") / F.col("_norm"))
    return df.withColumn(
        out, F.when(F.col("_norm") > 0, unit).otherwise(F.col(col).cast("array<double>"))
    ).drop("_norm")


def cosine(a: Column, b: Column) -> Column:
    """Inner product of unit vectors, rounded to the ranking precision; null if either is."""
    return F.round(dot(a, b), SCORE_DIGITS)

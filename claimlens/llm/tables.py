"""Reading the given tables, and keys that rows without a unique id can be joined by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def row_key(*columns: str) -> Column:
    """64-bit key made of the content of a row: equal rows have equal keys."""
    return F.xxhash64(*[F.col(c) for c in columns])


def free_name(df: DataFrame, wanted: str) -> str:
    """The wanted column name, or one that no column of df has (case is ignored)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def fold(id_column: str, modulus: int) -> Column:
    """Remainder of the CRC-32 of an id written as text; null ids are in fold 0."""
    crc = F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary"))
    return F.pmod(crc, F.lit(modulus))

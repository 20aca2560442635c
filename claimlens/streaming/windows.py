"""Windowed counts in append mode, with the late rows kept in a table of their own.

Two queries follow each other. The first splits the arriving rows: the watermark of a batch
is the latest event time of the batches before it, less the delay, and a row whose window
has ended by then is late. The second counts the rows in time per window, gives a window out
once when its own watermark has passed it, and frees its state. That watermark rests on rows
in time of earlier batches only, so it is never ahead of the one that split them: a row is
either counted or late, never both and never neither. A row without a time is kept with
those in time and belongs to no window.

The first query moves no row; the second combines counts in the map tasks before the
shuffle, so that one busy window is not one task's work.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

IN_TIME, LATE, MARKS = "in_time", "late", "marks"


def _watermark(spark: SparkSession, out: str, batch_id: int, delay: str):
    """Latest event time before this batch less the delay; None for the first batch."""
    if batch_id == 0:
        return None
    path = os.path.join(out, MARKS, f"batch_id={batch_id - 1}")
    latest = F.col("latest") - F.expr(f"INTERVAL {delay}")
    return spark.read.schema("latest timestamp").parquet(path).select(latest).scalar()


def _window_end(time_col: str, width: str) -> Column:
    """End of the window of a time; `window` itself would drop rows without one."""
    micros, size = F.unix_micros(time_col), F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {width}"))
    return F.timestamp_micros(micros - F.pmod(micros, size) + size)


def split_late(
    stream: DataFrame, time_col: str, width: str, delay: str, out: str, checkpoint: str
) -> StreamingQuery:
    """Write every row under `out`, to `in_time` or to `late`, once however often a batch is run."""

    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        mark = _watermark(spark, out, batch_id, delay)
        late = F.lit(False) if mark is None else F.coalesce(_window_end(time_col, width) <= mark, F.lit(False))
        for name, which in ((IN_TIME, ~late), (LATE, late)):
            folder = os.path.join(out, name, f"batch_id={batch_id}")
            df.where(which).write.mode("overwrite").parquet(folder)
        latest = df.agg(F.max(time_col).alias("latest"))
        if batch_id:
            path = os.path.join(out, MARKS, f"batch_id={batch_id - 1}")
            before = spark.read.schema("latest timestamp").parquet(path)
            latest = latest.unionByName(before).agg(F.max("latest").alias("latest"))
        latest.write.mode("overwrite").parquet(os.path.join(out, MARKS, f"batch_id={batch_id}"))

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def late_rows(spark: SparkSession, out: str, schema) -> DataFrame:
    """The rows that came after their window was closed."""
    return spark.read.schema(schema).parquet(os.path.join(out, LATE, "batch_id=*"))


def in_time_stream(spark: SparkSession, out: str, schema) -> DataFrame:
    """The rows in time as a stream; a batch's files are read after those of earlier ones."""
    return spark.readStream.schema(schema).parquet(os.path.join(out, IN_TIME, "batch_id=*"))


def closed_windows(stream: DataFrame, time_col: str, label_col: str, width: str, delay: str) -> DataFrame:
    """(window_start, label, n), for append mode: each window once, after the watermark."""
    counts = stream.withWatermark(time_col, delay).groupBy(F.window(time_col, width).alias("w"), label_col)
    return counts.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), label_col, "n")

"""Run ledger, decay schedule and claim history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from claimlens.functions.formatting import ctime, schedule, status_line
from claimlens.functions.text import DEFAULT_LABEL, preview

# Batches of one run summed by one task; running sums are offset chunk by chunk.
CHUNK = 100_000


def ledger(batches: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Running steps, updates, last update and schedule value after every batch.

    A batch without rows changes nothing. The running sums are taken within chunks of
    batches and shifted by the totals of the chunks before, so that one long run is
    not summed by one task.
    """
    rows = batches.withColumn("chunk", F.floor(F.col("batch_seq") / F.lit(chunk)))
    live = F.col("n_rows") > 0
    step = F.when(live, F.col("n_rows")).otherwise(0).cast("long")
    update = F.when(live, 1).otherwise(0).cast("long")
    stamp = F.when(live, F.col("finished_at"))
    totals = rows.groupBy("run_id", "chunk").agg(
        F.sum(step).alias("s"), F.sum(update).alias("u"), F.max(stamp).alias("t")
    )
    earlier = W.partitionBy("run_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "run_id",
        "chunk",
        F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("s0"),
        F.coalesce(F.sum("u").over(earlier), F.lit(0)).alias("u0"),
        F.max("t").over(earlier).alias("t0"),
    )
    within = (
        W.partitionBy("run_id", "chunk")
        .orderBy("batch_seq")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    running = rows.select(
        *batches.columns,
        "chunk",
        F.sum(step).over(within).alias("s1"),
        F.sum(update).over(within).alias("u1"),
        F.max(stamp).over(within).alias("t1"),
    )
    updates = F.col("u0") + F.col("u1")
    return running.join(offsets, ["run_id", "chunk"]).select(
        *batches.columns,
        (F.col("s0") + F.col("s1")).alias("steps"),
        updates.alias("updates"),
        F.coalesce("t1", "t0").alias("last_update"),
        schedule(updates).alias("loss"),
    )


def ledger_report(entries: DataFrame) -> DataFrame:
    """One line per run: latest counters, status text, time of the last update, seconds spent."""
    seconds = F.unix_micros("finished_at") - F.unix_micros("started_at")
    last = entries.groupBy("run_id").agg(
        F.max("steps").alias("steps"),
        F.max("updates").alias("updates"),
        F.max("last_update").alias("last_update"),
        F.round(F.sum(seconds) / F.lit(1e6), 2).alias("seconds"),
    )
    return last.select(
        "run_id",
        "steps",
        "updates",
        status_line(F.col("updates")).alias("status"),
        ctime(F.col("last_update")).alias("last_update"),
        "seconds",
    )


def loss_curve(entries: DataFrame) -> DataFrame:
    """(run_id, update, loss): every batch with rows is one update."""
    return entries.where(F.col("n_rows") > 0).select(
        "run_id", F.col("updates").alias("update"), F.round("loss", 6).alias("loss")
    )


def batch_row(analysed: DataFrame, run_id: str, batch_seq: int, started_at) -> DataFrame:
    """Ledger row of one analysed batch; blank and skipped claims are not counted."""
    counted = F.sum(F.when(F.col("counted"), 1).otherwise(0)).cast("long")
    return analysed.agg(F.coalesce(counted, F.lit(0)).alias("n_rows")).select(
        F.lit(run_id).alias("run_id"),
        F.lit(batch_seq).cast("long").alias("batch_seq"),
        "n_rows",
        F.lit(started_at).cast("timestamp").alias("started_at"),
        F.current_timestamp().alias("finished_at"),
    )


def history_rows(analysis: DataFrame, batch_seq: int | None = None) -> DataFrame:
    """What the history keeps of every analysed claim; with a batch number, ready to append."""
    rows = analysis.select(
        "claim_id",
        preview(F.col("text")).alias("preview"),
        F.coalesce("label", F.lit(DEFAULT_LABEL)).alias("label"),
        "confidence",
        "status",
    )
    if batch_seq is None:
        return rows
    return rows.select(F.lit(batch_seq).cast("long").alias("seq"), *rows.columns)


def recent_history(history: DataFrame, *order: str, n: int = 10) -> DataFrame:
    """The last n entries, newest first; by batch and claim unless told otherwise."""
    return history.orderBy(*[F.desc(c) for c in order or ("seq", "claim_id")]).limit(n)

"""Counters of runs as keyed state: one state per run, in RocksDB, with a time to live.

Every batch of a run that arrives gives one row with the run's steps, updates and latest
time so far. A batch without rows changes nothing but is answered. The numbers of the
batches seen are part of the state, so a batch that is delivered twice counts once; one that
arrives late counts when it arrives. A run that has been quiet for the time to live is
forgotten, and starts anew if it goes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TTL_MS = 30 * 24 * 3600 * 1000
# State with a time to live needs RocksDB. It also asks for a batch after every batch, with
# or without data, so that a query over what is available now would never end.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}

# Times are whole microseconds inside the state and the function on it.
_TIMES = ("started_at", "finished_at", "last_update")
_OUT = ("run_id", "batch_seq", "n_rows", "started_at", "finished_at", "steps", "updates", "last_update")


class RunCounters(StatefulProcessor):
    """Counts rows and batches with rows, for one run."""

    def __init__(self, ttl_ms: int = TTL_MS):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        counters = "steps long, updates long, last_update long"
        self.counters = handle.getValueState("counters", counters, self.ttl_ms)
        self.seen = handle.getMapState("seen", "batch_seq long", "seen boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        steps, updates, latest = self.counters.get() or (0, 0, None)
        # The batches of one run in one trigger are few: each stands for many claims.
        for r in sorted(rows, key=lambda r: r.batch_seq):
            if self.seen.containsKey((r.batch_seq,)):
                continue
            self.seen.updateValue((r.batch_seq,), (True,))
            if r.n_rows:
                steps, updates = steps + r.n_rows, updates + 1
                latest = r.finished_at if latest is None else max(latest, r.finished_at)
            told = (key[0], r.batch_seq, r.n_rows, r.started_at, r.finished_at, steps, updates, latest)
            yield Row(**dict(zip(_OUT, told)))
        self.counters.update((steps, updates, latest))

    def close(self) -> None:
        pass


def run_state(batches: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """(batch columns, steps, updates, last_update) for every batch of the stream, in update mode.

    `batches` has the schema `BATCHES`; the query must be started under `rocksdb_state`.
    """
    rows = batches.select(
        "run_id", "batch_seq", "n_rows", *[F.unix_micros(c).alias(c) for c in _TIMES[:2]]
    )
    counted = rows.groupBy("run_id").transformWithState(
        statefulProcessor=RunCounters(ttl_ms),
        outputStructType="run_id string, " + ", ".join(f"{c} long" for c in _OUT[1:]),
        outputMode="Update",
        timeMode="ProcessingTime",
    )
    return counted.withColumns({c: F.timestamp_micros(c) for c in _TIMES})


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's settings come back."""
    before = {name: spark.conf.get(name, None) for name in _SETTINGS}
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)

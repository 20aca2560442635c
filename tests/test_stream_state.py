"""Keyed run state, windows in append mode with late rows, and stateless top-k."""

import time

import pytest

from claimlens import schemas as S
from claimlens.operators import ledger as L
from claimlens.operators.knn import knn_join
from claimlens.streaming import claims as St
from claimlens.streaming import nearest as N
from claimlens.streaming import runs as Runs
from claimlens.streaming import windows as Win

SF = "/root/testdata/sf0.001"


def batches(spark, rows):
    """(run, number, rows): a batch starts at its number and takes a second."""
    df = spark.createDataFrame(rows, "run_id string, batch_seq long, n_rows long")
    at = "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, batch_seq"
    return df.selectExpr("*", f"{at}) as started_at", f"{at} + 1) as finished_at")


def deliver(spark, folder, rows, **how):
    """Land the rows, run what is new, and return all answers by delivery."""
    land, out, state = (str(folder / n) for n in ("land", "out", "state"))
    batches(spark, rows).write.mode("append").parquet(land)
    stream = spark.readStream.schema(S.BATCHES).parquet(land)
    with Runs.rocksdb_state(spark):
        St.per_batch(Runs.run_state(stream, **how), lambda df, _: df, out, state, mode="update").awaitTermination()
    return spark.read.parquet(out)


def test_run_state_over_restarts_repeats_and_stragglers(spark, tmp_path):
    first = [("a", 0, 1), ("a", 1, 4), ("a", 2, 0), ("b", 0, 0)]
    second = [("a", 1, 4), ("a", 5, 2), ("b", 1, 7)]
    deliver(spark, tmp_path, first)
    got = deliver(spark, tmp_path, second).drop("batch_id")
    want = L.ledger(batches(spark, first + second[1:])).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # A straggler counts when it comes, after what came before it.
    late = deliver(spark, tmp_path, [("a", 3, 10)]).where("run_id = 'a' and batch_seq = 3").first()
    assert (late.steps, late.updates, late.last_update.second) == (17, 4, 6)
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"


def test_quiet_runs_are_forgotten(spark, tmp_path):
    deliver(spark, tmp_path, [("a", 0, 5)], ttl_ms=1)
    time.sleep(0.1)
    row = deliver(spark, tmp_path, [("a", 1, 2)], ttl_ms=1).where("batch_seq = 1").first()
    assert (row.steps, row.updates) == (2, 1)


def test_rows_are_counted_or_late(spark, tmp_path):
    """Random deliveries: every row is in one of both tables, and windows come out once."""
    schema = "id long, ts timestamp, label string"
    land, out, first, windows, second = (str(tmp_path / n) for n in ("land", "out", "s1", "windows", "s2"))
    minutes = [[5, 20, 130], [70, 10, 200], [150, 400, None], [60, 121, 399, 181], [1000]]
    known, late_ids, kept, top = 0, [], {}, None
    for d, some in enumerate(minutes):
        rows = [(100 * d + i, m) for i, m in enumerate(some)]
        df = spark.createDataFrame(rows, "id long, m long")
        df = df.selectExpr("id", "timestamp'2024-01-01' + make_interval(0,0,0,0,0,m) as ts", "'x' as label")
        df.write.mode("append").parquet(land)
        stream = spark.readStream.schema(schema).parquet(land)
        for _ in range(2):  # The second run has nothing to do.
            Win.split_late(stream, "ts", "1 hour", "1 hour", out, first).awaitTermination()
        counts = Win.closed_windows(Win.in_time_stream(spark, out, schema), "ts", "label", "1 hour", "1 hour")
        St.append_to(counts, windows, second).awaitTermination()
        for i, m in rows:
            if m is None:
                continue
            if top is not None and (m // 60 + 1) * 60 <= top - 60:
                late_ids.append(i)
            else:
                kept[m // 60] = kept.get(m // 60, 0) + 1
        top = max([m for m in some if m is not None] + ([] if top is None else [top]))
        known += len(rows)
    assert sorted(r.id for r in Win.late_rows(spark, out, schema).collect()) == late_ids and late_ids
    got = spark.read.parquet(windows).collect()
    closed = {h: n for h, n in kept.items() if (h + 1) * 60 <= top - 60}
    assert sorted((r.window_start.hour, r.n) for r in got) == sorted(closed.items())
    both = sum(spark.read.parquet(f"{out}/{n}/batch_id=*").count() for n in (Win.IN_TIME, Win.LATE))
    assert both == known


def _vectors(spark):
    rows = [(i, [float((i * 7 + j * j) % 11) - 5.0 for j in range(6)]) for i in range(60)]
    rows += [(100, None), (101, [float("nan")] * 6), (102, []), (103, [None] * 6), (104, [0.0] * 6), (105, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df


@pytest.mark.parametrize("k", [1, 6, 1000])
def test_nearest_as_the_join_finds_it(spark, k):
    vecs = _vectors(spark)
    got = N.nearest(vecs, N.corpus_row(vecs, "vec_id"), k, "vec_id").collect()
    want = knn_join(vecs, vecs, k, "vec_id", "vec_id").collect()
    assert sorted((r.vec_id, r.rank, r.item_id, r.score) for r in got) == sorted(
        (r.vec_id, r.rank, r.item_id, r.score) for r in want
    )


def test_corpus_is_read_once_and_its_size_is_checked(spark, tmp_path):
    vecs = _vectors(spark)
    vecs.write.parquet(str(tmp_path / "v"))
    corpus = N.corpus_row(spark.read.parquet(str(tmp_path / "v")), "vec_id")
    with pytest.raises(ValueError, match="more than 100 bytes"):
        N.corpus_row(vecs, "vec_id", max_bytes=100)
    stream = spark.readStream.schema("vec_id long, embedding array<float>").parquet(str(tmp_path / "v"))
    found = N.nearest(stream, corpus, 2, "vec_id")
    assert found.isStreaming
    St.append_to(found, str(tmp_path / "o"), str(tmp_path / "s")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2 * 62
    plan = N.nearest(vecs, corpus, 2, "vec_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("BroadcastExchange") == 1
    assert str(tmp_path / "v") not in plan
    empty = N.corpus_row(vecs.limit(0), "vec_id")
    assert N.nearest(vecs, empty, 2, "vec_id").collect() == []

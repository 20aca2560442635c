from claimlens.operators import generate as G
from claimlens.operators import ledger as L
from claimlens.plans.analyze import analyze
from claimlens.sources import tables as T
from claimlens.streaming import claims as St

START = "2024-01-01 00:00:00"


def test_event_times_follow_the_id(spark):
    df = spark.createDataFrame(
        [(i, "t", "True") for i in (0, 999, 1000, 1001)], "id long, text string, label string"
    )
    rows = St.claim_stream_rows(df, START, seed=7).orderBy("id").collect()
    assert [r.timestamp.minute * 60 + r.timestamp.second for r in rows] == [0, 999, 0, 1]
    assert {r.platform for r in rows} == {"sim"}
    again = St.claim_stream_rows(df, START, seed=7).orderBy("id").collect()
    other = St.claim_stream_rows(df, START, seed=8).orderBy("id").collect()
    assert rows == again and [r.arrival for r in rows] != [r.arrival for r in other]


def test_scored_stream_equals_batch_and_feeds_the_ledger(spark, tmp_path):
    claims = spark.createDataFrame(
        [(i, f"claim {i}" if i else " ", "True") for i in range(9)],
        "id long, text string, label string",
    )
    outs = spark.range(9).selectExpr("id as claim_id", "concat('It is true ', id) as raw_output")
    gen = G.precomputed(outs)
    land, out, state, led, log = (
        str(tmp_path / n) for n in ("land", "out", "state", "ledger", "history")
    )
    St.land_claim_stream(St.claim_stream_rows(claims, START), land, files=3)

    def keep(df, batch_id, started):
        L.batch_row(df, "run", batch_id, started).write.mode("append").parquet(led)
        T.append_history(L.history_rows(df, batch_id), log)

    def run():
        St.score_claims(
            St.read_claim_stream(spark, land),
            lambda df, n: analyze(df, None, gen, updates=n, with_counted=True),
            out,
            state,
            after=keep,
        ).awaitTermination()

    run()
    run()  # nothing new: nothing changes
    cols = ["claim_id", "label", "confidence", "explanation"]
    got = spark.read.parquet(out).select(cols).orderBy("claim_id").collect()
    batch = analyze(claims.selectExpr("id as claim_id", "text"), None, gen)
    assert got == batch.select(cols).orderBy("claim_id").collect()
    last = L.ledger(spark.read.parquet(led)).orderBy("batch_seq").collect()[-1]
    assert last.steps == 8 and last.updates == 3
    newest = L.recent_history(T.read_history(spark, log), n=4).collect()
    assert len(newest) == 4 and newest[0].seq == 2


def events(spark, path, files):
    for n, rows in enumerate(files):
        df = spark.createDataFrame(rows, "id long, ts string, label string")
        df.selectExpr("id", "timestamp(ts) ts", "label").coalesce(1).write.mode("append").parquet(path)
    return St.read_claim_stream(spark, path, 1, "id long, ts timestamp, label string")


FILES = [
    [(1, "2024-01-01 00:10:00", "Fake"), (2, "2024-01-01 00:20:00", "Fake")],
    [(1, "2024-01-01 00:10:00", "Fake"), (3, "2024-01-01 09:00:00", "True")],
    [(4, "2024-01-01 20:00:00", "True")],
    [(5, "2024-01-01 00:30:00", "Fake")],
]


def test_repeats_are_dropped(spark, tmp_path):
    stream = events(spark, str(tmp_path / "in"), FILES[:2])
    out = str(tmp_path / "out")
    St.append_to(
        St.drop_repeats(stream, ["id"], "ts", "1 day"), out, str(tmp_path / "s")
    ).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_late_rows_leave_closed_windows_alone(spark, tmp_path):
    stream = events(spark, str(tmp_path / "in"), FILES)
    out = str(tmp_path / "out")
    counts = St.windowed_counts(stream, "ts", "label", "1 hour", "1 hour")
    St.append_to(counts, out, str(tmp_path / "s")).awaitTermination()
    rows = spark.read.parquet(out).orderBy("window_start").collect()
    assert [(r.window_start.hour, r.label, r.n) for r in rows] == [(0, "Fake", 3), (9, "True", 1)]

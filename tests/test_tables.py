import csv

import pytest

from claimlens import schemas as S
from claimlens.operators import ledger as L
from claimlens.operators import metrics as M
from claimlens.sources import tables as T


def write_csv(path, header, rows):
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)
    return str(path)


def test_evidence_csv_with_quotes_newlines_and_copies(spark, tmp_path):
    rows = [('a "quoted", text', "u"), ("two\nlines", "v"), ("same", "w"), ("same", "w")]
    path = write_csv(tmp_path / "e.csv", ["text", "source_url"], rows)
    got = T.read_evidence_csv(spark, path, multi_line=True).collect()
    assert sorted((r.text, r.source_url) for r in got) == sorted(rows)
    assert len({r.evidence_id for r in got}) == 4
    assert {r.evidence_id for r in got} == {
        r.evidence_id for r in T.read_evidence_csv(spark, path, multi_line=True).collect()
    }


def test_demo_evidence_keeps_its_ids(spark, tmp_path):
    T.write_demo_evidence(spark, str(tmp_path / "d"))
    got = T.read_evidence_csv(spark, str(tmp_path / "d")).orderBy("evidence_id").collect()
    assert [tuple(r) for r in got] == T.DEMO_EVIDENCE


def test_copies_spread_over_tasks_get_distinct_ids(spark):
    df = spark.range(1000).selectExpr("'x' as text", "if(id % 3 = 0, 'hot', cast(id as string)) u")
    got = T.with_content_id(df.repartition(8), "i")
    assert got.select("i").distinct().count() == 1000


def test_claims_csv(spark, tmp_path):
    rows = [("true", " a  b ", "s"), ("false", "", "s"), ("half-true", "c", "")]
    path = write_csv(tmp_path / "c.csv", ["label", "statement", "source"], rows)
    got = sorted(tuple(r) for r in T.read_claims_csv(spark, path).select("text", "label").collect())
    assert got == [("a b", "True"), ("c", "True")]
    kept = T.read_claims_csv(spark, path, null_as_text=True)
    assert sorted(r.text for r in kept.collect()) == ["a b", "c", "nan"]
    bad = write_csv(tmp_path / "b.csv", ["label", "statement"], [("true", "x")])
    with pytest.raises(ValueError, match="source"):
        T.read_claims_csv(spark, bad)


def test_missing_tables_are_empty(spark, tmp_path):
    for read, schema in ((T.read_vectors, S.VECTORS), (T.read_history, S.HISTORY)):
        df = read(spark, str(tmp_path / "none"))
        assert df.count() == 0 and df.schema == schema


def test_history_append(spark, tmp_path):
    path = str(tmp_path / "h")
    for first in (0, 15):
        rows = [(first + i, 1, "p", "True", 0.5, "s") for i in range(15)]
        T.append_history(spark.createDataFrame(rows, S.HISTORY), path)
    got = L.recent_history(T.read_history(spark, path)).collect()
    assert [r.seq for r in got] == list(range(29, 19, -1))


def test_recent_entries_are_found_by_batch(spark, tmp_path):
    path = str(tmp_path / "h")
    assert T.read_recent(spark, path).collect() == []

    def batch(seq, ids, label="True"):
        rows = [(seq, i, "p", label, 0.5, "s") for i in ids]
        T.append_history(spark.createDataFrame(rows, S.HISTORY), path)

    batch(0, range(30))
    batch(7, range(4), "Fake")
    batch(7, range(4))  # Written again: replaced.
    batch(9, range(3))
    got = T.read_recent(spark, path).collect()
    want = [(9, 2), (9, 1), (9, 0), (7, 3), (7, 2), (7, 1), (7, 0), (0, 29), (0, 28), (0, 27)]
    assert [(r.seq, r.claim_id) for r in got] == want and {r.label for r in got} == {"True"}
    few = T.read_recent(spark, path, n=5)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(seq" in plan and "(seq#" in plan
    assert len(T.read_recent(spark, path, n=1000).collect()) == 37


def test_macro_scores(spark):
    pairs = [("True", "True"), ("True", "Fake"), ("Fake", "Fake"), ("Uncertain", "Fake")]
    df = spark.createDataFrame(pairs, "gold string, pred string")
    assert tuple(M.macro_prf(M.confusion(df)).first()) == (0.444444, 0.5, 0.388889)
    only = spark.createDataFrame([("True", "Odd")], "gold string, pred string")
    assert {(r.label, r.tp, r.n_gold, r.n_pred) for r in M.confusion(only).collect()} == {
        ("True", 0, 1, 0),
        ("Odd", 0, 0, 1),
    }
    assert tuple(M.macro_prf(M.confusion(only)).first()) == (0.0, 0.0, 0.0)


def test_corpus_stats(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "source_url string")
    assert tuple(M.corpus_stats(df).first()) == (3, 2)
    assert tuple(M.corpus_stats(df, approximate=True).first()) == (3, 2)


@pytest.mark.parametrize("chunk", [1, 2, 100_000])
def test_ledger(spark, chunk):
    rows = spark.sql(
        """select 'r' run_id, seq batch_seq, n n_rows,
           timestamp'2024-01-01' + make_interval(0,0,0,0,0,0,seq) started_at,
           timestamp'2024-01-01' + make_interval(0,0,0,0,0,0,seq + 1) finished_at
           from values (0L, 1L), (1L, 4L), (2L, 0L), (3L, 2L) as t(seq, n)"""
    )
    out = L.ledger(rows, chunk).orderBy("batch_seq").collect()
    assert [r.updates for r in out] == [1, 2, 2, 3]
    assert [r.steps for r in out] == [1, 5, 5, 7]
    assert [round(r.loss, 6) for r in out] == [0.45, 0.4, 0.4, 0.35]
    assert out[2].last_update == out[1].finished_at
    report = L.ledger_report(L.ledger(rows, chunk)).first()
    assert (report.steps, report.updates, report.seconds) == (7, 3, 4.0)
    curve = L.loss_curve(L.ledger(rows, chunk)).orderBy("update").collect()
    assert [(r.update, r.loss) for r in curve] == [(1, 0.45), (2, 0.4), (3, 0.35)]

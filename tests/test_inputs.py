"""Inputs that the given tables lack: odd vectors, mixed headers, long articles, odd numbers."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from claimlens.functions import verdict as V
from claimlens.operators import retrieve as R
from claimlens.operators.knn import knn_join
from claimlens.sources import articles as A, tables as T

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("strategy", ["broadcast", "cells"])
def test_knn_takes_any_number_type_and_skips_odd_vectors(spark, strategy):
    rows = [(i, [float(i), 1.0]) for i in range(1, 9)]
    rows += [(20, [NAN, 1.0]), (21, [INF, 1.0]), (22, None), (23, [None, 1.0]), (24, []), (25, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    got = knn_join(df, df, 3, "id", "id", "v", strategy=strategy, max_pivots=3, block_rows=2).collect()
    found = {}
    for r in got:
        found.setdefault(r["id"], []).append((r["rank"], r["item_id"]))
    assert sorted(found[1]) == [(1, 8), (2, 7), (3, 6)]
    assert sorted(found[25]) == [(1, 1), (2, 2), (3, 3)]
    assert set(found) == {*range(1, 9), 25}


def test_vectors_of_different_lengths_are_an_error(spark):
    q = spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>")
    i = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0, 3.0]), (3, [1.0, 1.0])], "id long, v array<double>")
    with pytest.raises(PySparkException):
        knn_join(q, i, 3, "id", "id", "v").collect()


def test_news_search_reads_past_the_snippet(spark):
    filler = "filler " * 300
    rows = [(1, "Title", "Short.", f"{filler}zebra", "u", "en"), (2, "Title", "Other.", filler, "u", "en")]
    columns = "article_id long, title string, description string, content string, url string, lang string"
    news = A.news(spark.createDataFrame(rows, columns))
    assert [len(r.text) <= 1000 for r in news.collect()] == [True, True]
    claims = spark.createDataFrame([(5, "a zebra")], "claim_id long, text string")
    from claimlens.operators.encode import lexicon

    source = R.build_source(news, lexicon(news, "item_id", "text"))
    hits = R.article_hits(claims, source, 3, R.NEWS).collect()
    assert [(r.claim_id, r.item_id) for r in hits] == [(5, 1)]


def test_csv_files_must_share_their_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text,source_url\n1,one,u\n")
    assert T.read_evidence_csv(spark, str(tmp_path)).collect()[0].text == "one"
    (tmp_path / "b.csv").write_text("id,source_url,text\n2,u,two\n")
    with pytest.raises(Exception, match="(?i)header|malformed"):
        T.read_evidence_csv(spark, str(tmp_path)).collect()


def test_csv_ids_must_be_numbers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text,source_url\nx,one,u\n")
    with pytest.raises(Exception, match="(?i)header|malformed"):
        T.read_evidence_csv(spark, str(tmp_path)).collect()


def test_csv_line_breaks_by_option(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text,source_url\n1,"one\ntwo",u\n')
    assert T.read_evidence_csv(spark, str(tmp_path), multi_line=True).collect()[0].text == "one\ntwo"


@pytest.mark.parametrize(
    "raw,confidence",
    [
        ('{"confidence":"0.9f"}', 0.5),
        ('{"confidence":"0.9d"}', 0.5),
        ('{"confidence":"0x1p3"}', 0.5),
        ('{"confidence":"1_0"}', 10.0),
        ('{"confidence":" 0.25 "}', 0.25),
        ('{"confidence":"1e-1"}', 0.1),
        ('{"confidence":0.7} ', 0.5),
        ('{"confidence":0.7} \n', 0.7),
    ],
)
def test_confidence_is_read_as_python_reads_numbers(spark, raw, confidence):
    df = spark.createDataFrame([(raw,)], "raw_output string")
    got = V.with_parsed_output(df).select(F.col("verdict.confidence")).first()[0]
    assert got == confidence

import pytest
from pyspark.sql import functions as F

from claimlens.functions import formatting as Fm
from claimlens.functions import text as X


def column(spark, values, expr):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_clean_text(spark):
    cases = {
        "  a\t\n b ": "a b",
        "a  b": "a b",
        "a\u001cb": "a b",
        "a\u0085b": "a b",
        "": "",
        " \n": "",
    }
    assert column(spark, cases, X.clean_text) == list(cases.values())


def test_strip_keeps_inner_whitespace(spark):
    cases = {"  a  b\n\x1d": "a  b", "x": "x", "\n \t": "", "a" + " " * 5000 + "b": None}
    want = [v if v is not None else k for k, v in cases.items()]
    assert column(spark, cases, X.strip) == want


def test_labels(spark):
    cases = {
        "true": "True",
        "TRUE": "True",
        "half-true": "True",
        "barely-true": "True",
        "mostly-true": "Uncertain",
        "mostly barely-true": "Fake",
        "false": "Fake",
        "mostly-false": "Fake",
        "pants-fire": "Fake",
        "pants on fire": "Uncertain",
        "unproven": "Uncertain",
    }
    assert column(spark, cases, X.normalize_label) == list(cases.values())
    assert column(spark, [None], X.normalize_label) == ["Uncertain"]
    own = (("Good", ("yes",), ("no",)),)
    assert column(spark, ["YES", "yes no"], lambda c: X.normalize_label(c, own, "?")) == ["Good", "?"]


@pytest.mark.parametrize(
    ("body", "lead"),
    [
        ("One. Two! Three?", "One. Two!"),
        ("Only one.", "Only one."),
        ("No end", "No end"),
        ("A\nb. C d. E.", "A\nb. C d."),
    ],
)
def test_lead_sentences(spark, body, lead):
    assert column(spark, [body], X.lead_sentences) == [lead]


def test_links_and_snippets(spark):
    assert column(spark, ["A B"], X.article_url) == ["https://en.wikipedia.org/wiki/A_B"]
    df = spark.createDataFrame([("t", None), (None, "d"), ("t" * 600, "d" * 600)], "t string, d string")
    got = [r[0] for r in df.select(X.news_snippet(F.col("t"), F.col("d"))).collect()]
    assert got[:2] == ["t. ", ". d"] and len(got[2]) == 1000


def test_tokens(spark):
    assert column(spark, ["--Été, 5G x5!", None, "..."], X.tokens) == [["été", "5g", "x5"], [], []]


def test_formats(spark):
    df = spark.sql("select timestamp'2024-01-05 03:04:05' t, 0L a, 1L b, 9L c, 10L d, 11L e")
    row = df.select(
        Fm.ctime(F.col("t")).alias("t"),
        *[F.round(Fm.schedule(F.col(c)), 6).alias(c) for c in "abcde"],
        Fm.status_line(F.col("b")).alias("s"),
    ).first()
    assert row.t == "Fri Jan  5 03:04:05 2024"
    assert [row.a, row.b, row.c, row.d, row.e] == [0.0, 0.45, 0.05, 0.01, 0.01]
    assert row.s == "1 updates, loss=0.450"

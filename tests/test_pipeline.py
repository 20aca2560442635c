import pytest
from pyspark.sql import functions as F

from claimlens.operators import generate as G
from claimlens.operators import retrieve as R
from claimlens.plans import analyze as P
from claimlens.plans.evaluate import evaluate
from claimlens.schemas import ANALYSIS
from claimlens.sources import articles as A
from claimlens.sources import tables as T

EVIDENCE = [
    (0, "The Earth is round and tests confirm it", "u0"),
    (1, "Vaccines are safe", "u1"),
    (2, "The moon landing was called a hoax", None),
    (3, "Vaccines are safe", "u3"),
]
NEWS = [
    (10, "Moon", None, "n10", "en"),
    (11, "Vaccines", "are safe and good", None, "en"),
    (12, "Mond", "Erde", "n12", "de"),
]
ARTICLES = [(5, "Flat Earth", "The Earth is not flat. It is round. More."), (6, None, "x")]
CLAIMS = [
    (1, "Earth is flat"),
    (2, "  \n"),
    (3, None),
    (4, "vaccines are safe"),
    (5, "vaccines are safe"),
    (6, "zzz qqq"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    ev = spark.createDataFrame(EVIDENCE, "evidence_id long, text string, source_url string")
    news = spark.createDataFrame(
        NEWS, "article_id long, title string, description string, url string, lang string"
    )
    art = spark.createDataFrame(ARTICLES, "article_id long, title string, body string")
    return R.build_corpus(ev, A.encyclopaedia(art), A.news(news))


@pytest.fixture(scope="module")
def claims(spark):
    return spark.createDataFrame(CLAIMS, "claim_id long, text string")


def outputs(spark):
    return G.precomputed(
        spark.createDataFrame(
            [(1, "That is true"), (4, '{"label":"True","confidence":0.95}'), (5, "x")],
            "claim_id long, raw_output string",
        )
    )


def by_id(df):
    return {r.claim_id: r for r in df.collect()}


def test_every_claim_once_with_its_exit(spark, corpus, claims):
    out = P.analyze(claims, corpus, outputs(spark))
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in ANALYSIS]
    rows = by_id(out)
    assert sorted(rows) == [1, 2, 3, 4, 5, 6] and out.count() == 6
    for blank in (2, 3):
        assert rows[blank].label == "Uncertain" and rows[blank].confidence == 0.0
        assert rows[blank].status == "No input provided." and rows[blank].evidence == []
    assert rows[1].label == "Fake" and rows[1].status == "1 updates, loss=0.450"
    assert rows[6].explanation == "No output" and rows[6].confidence == 0.5
    assert rows[4].evidence == rows[5].evidence and len(rows[4].evidence) == 5


def test_retrieval_order_ties_and_sources(spark, corpus, claims):
    live = claims.where("claim_id in (1, 4)")
    rows = R.retrieve(live, corpus, 6).orderBy("claim_id", "rank").collect()
    four = [r for r in rows if r.claim_id == 4]
    # Four evidence rows and the one news row that shares a word.
    assert [r.rank for r in four] == [1, 2, 3, 4, 5]
    assert [(r.item_id, r.source) for r in four[:2]] == [(1, "u1"), (3, "u3")]
    assert all(-1 <= r.score <= 1 for r in rows)
    sources = {r.source for r in rows}
    assert {"local", "newsapi", "https://en.wikipedia.org/wiki/Flat_Earth"} <= sources
    assert "n12" not in sources


def test_small_corpus_returns_all_of_it(spark, claims):
    ev = spark.createDataFrame(T.DEMO_EVIDENCE, "evidence_id long, text string, source_url string")
    got = R.retrieve(claims.where("claim_id = 1"), R.build_corpus(ev), 6)
    assert got.count() == 3


def test_sources_can_be_off_or_empty(spark, claims):
    news = spark.createDataFrame(
        NEWS, "article_id long, title string, description string, url string, lang string"
    )
    assert A.news(news, enabled=False).count() == 0
    rows = by_id(P.analyze(claims, None, outputs(spark)))
    assert all(r.evidence == [] for r in rows.values())
    assert rows[1].label == "True"


def test_without_generator(corpus, claims):
    rows = by_id(P.analyze(claims, corpus, None))
    assert rows[1].explanation == "Generator not available."
    assert rows[1].status == "Skipped (no generator)" and rows[1].evidence
    assert rows[2].explanation == "Empty input."


def test_failing_rows_stay_apart(corpus, claims):
    def load():
        def call(prompts, params):
            assert params["num_beams"] == 4 and params["temperature"] == 0.7
            if any("vaccines" in p.split("\n")[1] for p in prompts):
                raise ValueError("too long")
            return ["That is true"] * len(prompts)

        return call

    rows = by_id(P.analyze(claims, corpus, G.model(load), with_counted=True))
    assert rows[4].explanation == "too long" and rows[4].label == "Uncertain"
    assert rows[4].evidence and rows[4].counted and not rows[2].counted
    assert rows[1].label == "Fake"


def test_report_defaults(spark, corpus, claims):
    rows = {r.claim_id: r for r in P.report(P.analyze(claims, corpus, outputs(spark))).collect()}
    assert rows[2].counterfactual == "—" and rows[2].confidence == "0.00"
    assert rows[1].confidence == "0.90" and rows[1].counterfactual != "—"


def test_evaluate(spark, corpus, claims):
    labeled = claims.withColumn("label", F.lit("Fake"))
    row = evaluate(labeled, corpus, outputs(spark)).first()
    assert 0 < row.precision <= 1 and 0 < row.recall < 1


def test_corpus_survives_storage(spark, corpus, claims, tmp_path):
    T.write_corpus(corpus, str(tmp_path / "c"))
    stored = T.read_corpus(spark, str(tmp_path / "c"))
    live = claims.where("claim_id in (1, 4, 6)")
    a, b = (sorted(map(tuple, R.retrieve(live, c, 6).collect()), key=str) for c in (corpus, stored))
    assert a == b
    bare = R.Corpus(corpus.evidence, corpus.vectors, corpus.lex)
    T.write_corpus(bare, str(tmp_path / "d"))
    assert T.read_corpus(spark, str(tmp_path / "d")).sources() == []


def test_input_is_trimmed(spark, corpus):
    df = spark.createDataFrame([(1, " Earth  is flat\n")], "claim_id long, text string")
    assert P.analyze(df, None, None).first().text == "Earth  is flat"
    assert P.analyze(df, None, None, trim_input=False).first().text == " Earth  is flat\n"

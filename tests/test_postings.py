"""The stored index against the scan of all articles, and what a lookup reads."""

import random
import shutil

import pytest

from claimlens import schemas as S
from claimlens.operators import postings as I
from claimlens.operators import retrieve as R
from claimlens.operators.encode import distinct_tokens
from claimlens.operators.lexical import lexical_join, term_index
from claimlens.sources import tables as T


def tables(spark, n_articles, n_claims, seed=3):
    """Words by a steep law, so that some are in most articles and most in few; many ties."""
    rng = random.Random(seed)

    def text(n):
        return " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(n))

    articles = [(i, text(rng.randint(0, 25))) for i in range(n_articles)] + [(9_000, None)]
    claims = [(i, text(rng.randint(0, 8))) for i in range(n_claims)]
    claims += [(900, "w1"), (901, "w1 w2 w3"), (902, "unknown words"), (903, None), (904, "w1 unknown w1")]
    return (
        spark.createDataFrame(articles, "item_id long, text string"),
        spark.createDataFrame(claims, "claim_id long, text string"),
    )


@pytest.mark.parametrize("k,first,blocks", [(1, 0, 16), (3, 0, 64), (3, 40, 8), (50, 10, 1000), (10_000, 10, 32)])
def test_same_hits_as_a_scan(spark, tmp_path, k, first, blocks):
    articles, claims = tables(spark, 600, 60)
    terms = distinct_tokens(articles, "item_id", "text")
    I.write_index(terms, str(tmp_path / "i"), n_parts=8, block_articles=blocks)
    index = I.read_index(spark, str(tmp_path / "i"))
    got = I.index_join(claims, index, k, "claim_id", "text", first_postings=first).collect()
    want = lexical_join(claims, term_index(terms), k, "claim_id", "text").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert len({r.claim_id for r in got}) > 50


def test_articles_are_not_read_again(spark, tmp_path):
    articles, claims = tables(spark, 300, 20)
    articles.write.parquet(str(tmp_path / "articles"))
    stored = spark.read.parquet(str(tmp_path / "articles"))
    terms = distinct_tokens(stored, "item_id", "text")
    want = sorted(map(tuple, lexical_join(claims, term_index(terms), 2, "claim_id", "text").collect()))
    I.write_index(terms, str(tmp_path / "i"), n_parts=4, block_articles=32)
    shutil.rmtree(tmp_path / "articles")
    got = I.index_join(claims, I.read_index(spark, str(tmp_path / "i")), 2, "claim_id", "text")
    assert sorted(map(tuple, got.collect())) == want


def test_only_the_folders_of_the_words_are_read(spark, tmp_path):
    articles, _ = tables(spark, 300, 1)
    I.write_index(distinct_tokens(articles, "item_id", "text"), str(tmp_path / "i"), n_parts=16)
    index = I.read_index(spark, str(tmp_path / "i"))
    words = spark.createDataFrame([(1, "w1", 5)], "query_id long, token string, weight long")
    plan = I._hits(words, index)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and plan.count("(part#") <= 2
    assert len(I._folders(words, 16)) == 1


def test_lists_are_cut_into_blocks(spark, tmp_path):
    articles = spark.range(5_000).selectExpr("id as item_id", "'all of them' as text")
    I.write_index(distinct_tokens(articles, "item_id", "text"), str(tmp_path / "i"), block_articles=500)
    rows = I.read_index(spark, str(tmp_path / "i")).postings.where("token = 'all'").collect()
    assert len(rows) == 10 and sum(len(r.ids) for r in rows) == 5_000
    assert max(len(r.ids) for r in rows) < 700


def test_a_stored_corpus_is_asked_by_its_lists(spark, tmp_path, monkeypatch):
    """From a number of articles on, claims meet the lists; hits are those of the scan."""
    articles, claims = tables(spark, 120, 15)
    items = articles.selectExpr("item_id", "'s' as source", "text", "text as body")
    corpus = R.build_corpus(spark.createDataFrame([(1, "w1", "u")], S.EVIDENCE), items)
    want = sorted(map(tuple, R.article_hits(claims, corpus.articles, 2, 1).collect()))
    monkeypatch.setattr(R, "INDEX_ARTICLES", 100)
    T.write_corpus(corpus, str(tmp_path / "c"))
    stored = T.read_corpus(spark, str(tmp_path / "c"))
    monkeypatch.setattr(R, "lexical_join", None)
    assert sorted(map(tuple, R.article_hits(claims, stored.articles, 2, 1).collect())) == want
    assert len(want) > 15


def test_empty_tables(spark, tmp_path):
    articles, claims = tables(spark, 0, 5)
    I.write_index(distinct_tokens(articles.limit(0), "item_id", "text"), str(tmp_path / "i"))
    index = I.read_index(spark, str(tmp_path / "i"))
    assert I.index_join(claims, index, 2, "claim_id", "text").collect() == []
    assert I.index_join(claims.limit(0), index, 2, "claim_id", "text").collect() == []

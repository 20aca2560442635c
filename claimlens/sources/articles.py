"""Landed article tables in the form retrieval reads: item_id, source, text, body."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimlens.functions import text as X


def encyclopaedia(articles: DataFrame, base: str = X.ARTICLE_BASE_URL) -> DataFrame:
    """From (article_id, title, body): link from the title, two-sentence lead as text.

    A row without title or body gives no hit and costs no other row anything.
    """
    usable = F.col("title").isNotNull() & F.col("body").isNotNull()
    return articles.where(usable).select(
        F.col("article_id").alias("item_id"),
        X.article_url(F.col("title"), base).alias("source"),
        X.lead_sentences(F.col("body")).alias("text"),
        F.concat_ws(" ", "title", "body").alias("body"),
    )


def news(articles: DataFrame, lang: str = "en", enabled: bool = True) -> DataFrame:
    """From (article_id, title, description, content, url, lang): one language, snippet as text.

    Words are looked up in the uncut title, description and content; only what is shown
    is cut. A table without content has none.
    """
    rows = articles.where(F.col("lang") == lang)
    if not enabled:
        rows = rows.where(F.lit(False))
    snippet = X.news_snippet(F.col("title"), F.col("description"))
    return rows.select(
        F.col("article_id").alias("item_id"),
        F.coalesce("url", F.lit(X.NEWS_SOURCE)).alias("source"),
        snippet.alias("text"),
        F.concat_ws(" ", *[c for c in ("title", "description", "content") if c in articles.columns]).alias("body"),
    )

"""The given tables in the roles of the engine's inputs; every row of a table is used.

The generated prose holds none of the wording the rules look for, so a suffix chosen
by id is added to the texts, the same way in the check SQL.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from claimlens.functions.text import clean_text
from claimlens.operators import retrieve as R
from claimlens.sources import articles as A

# Raw labels and evidence suffixes by id.
RAW_LABELS = (
    "true",
    "false",
    "half-true",
    "mostly-true",
    "barely-true",
    "pants-fire",
    "unproven",
)
SUFFIXES = (" debunked", " scientific consensus", " confirm", " unclear", "")
STREAM_START = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def wide(df: DataFrame) -> DataFrame:
    """Spread a table that comes as fewer splits than there are cores.

    A large table has more splits than that and is left alone, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def by_id(id_col: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(
        F.array(*[F.lit(v) for v in values]), (F.pmod(id_col, F.lit(len(values))) + 1).cast("int")
    )


def marked_text() -> Column:
    return F.concat("text", by_id(F.col("doc_id"), SUFFIXES))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("evidence_id"),
        marked_text().alias("text"),
        F.col("source").alias("source_url"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = F.when(F.col("item_id") % 2 == 0, " flat").otherwise("")
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("claim_id"), F.concat("text", flat).alias("text")
    )


def labeled_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label, statement, source, quality, toxic) for the documents with labels."""
    docs = table(spark, sf_dir, "documents")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id",
        by_id(F.col("doc_id"), RAW_LABELS).alias("label"),
        F.col("text").alias("statement"),
        "source",
        "quality",
        "toxic",
    )


def _title() -> Column:
    return F.regexp_extract("html", "<title>([^<]*)", 1)


def _article() -> Column:
    """All text of a page's article."""
    inner = F.regexp_extract("html", "(?s)<article>(.*)</article>", 1)
    return clean_text(F.regexp_replace(inner, "<[^>]*>", " "))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.encyclopaedia(
        wide(table(spark, sf_dir, "pages")).select(
            F.col("page_id").alias("article_id"), _title().alias("title"), _article().alias("body")
        )
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    # All of the first paragraph, without the tags inside it.
    inner = F.regexp_extract("html", "(?s)<p>(.*?)</p>", 1)
    first = clean_text(F.regexp_replace(inner, "<[^>]*>", " "))
    return A.news(
        wide(table(spark, sf_dir, "pages")).select(
            F.col("page_id").alias("article_id"),
            _title().alias("title"),
            F.when(first != "", first).alias("description"),
            _article().alias("content"),
            "url",
            F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"),
        )
    )


def corpus(spark: SparkSession, sf_dir: str) -> R.Corpus:
    return R.build_corpus(
        evidence(spark, sf_dir), articles(spark, sf_dir), news(spark, sf_dir)
    )


def raw_output() -> Column:
    """A conversation turn as a model might have answered, in ten shapes by position."""
    plain = F.trim(F.regexp_replace("text", "[^A-Za-z]+", " "))
    shapes = (
        F.concat(F.lit('{"label":"Fake","confidence":0.9,"explanation":"'), plain, F.lit('"}')),
        F.concat(
            F.lit(' {"label":"True","confidence":"0.8","counterfactual":"'), plain, F.lit('"}\n')
        ),
        F.lit("{}"),
        F.concat(F.lit('{"confidence":null,"explanation":"'), plain, F.lit('"}')),
        F.lit('{"label":null,"confidence":0.7}'),
        F.concat(F.lit('{"label":"True" '), plain),
        F.concat(F.lit('{"reasoning":["a","'), plain, F.lit('"]}')),
        F.concat("text", F.lit(" This is not true.")),
        F.concat(F.lit("That is true: "), "text"),
        F.col("text"),
    )
    which = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(shapes)))
    out = F.when(which == 0, shapes[0])
    for n, shape in enumerate(shapes[1:], 1):
        out = out.when(which == n, shape)
    return out


def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One output per claim: the first assistant turn of the conversation with its id."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return turns.groupBy(F.col("conv_id").alias("claim_id")).agg(
        F.min_by(raw_output(), "turn").alias("raw_output")
    )


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger input: the events of one type and day are one batch of a run."""
    ts = F.col("ts").cast("timestamp")
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.col("event_type").alias("run_id"),
            F.datediff(F.col("ts"), F.lit("2024-01-01")).cast("long").alias("batch_seq"),
        )
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.min(ts).alias("started_at"),
            F.max(ts).alias("finished_at"),
        )
    )

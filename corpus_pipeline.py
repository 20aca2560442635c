"""From raw documents to packed training sequences, stage by stage.

Every stage works on the rows that the one before kept, which are written as Parquet and
read again in between, so a lost executor costs no more than its stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimlens.llm import language, minhash, packing, quality, substring
from claimlens.llm.tables import free_name, table
from claimlens.session import scratch_path, shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; empty and unidentified ones go."""
    shared_dir(spark)
    kept = free_name(docs, "kept")
    return language.identify(docs).where(F.col(kept)).select(*docs.columns)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; learnt from the labelled tables."""
    machine = quality.fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    scored = quality.with_score(docs, machine, name=score)
    return scored.where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, however often it is stored."""
    shared_dir(spark)
    return minhash.one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur more than once; others stay as they are."""
    shared_dir(spark)
    removed, text = free_name(docs, "n_removed"), free_name(docs, "kept_text")
    cut = F.col(removed) > 0
    out = substring.dedup(docs).withColumns(
        {
            "text": F.when(cut, F.col(text)).otherwise(F.col("text")),
            "n_chars": F.when(cut, F.length(text).cast("long")).otherwise(F.col("n_chars")),
        }
    )
    return out.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into training sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality", classify_quality),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]

# Trained models and iterated joins are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

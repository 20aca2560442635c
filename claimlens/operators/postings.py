"""A stored inverted index, and exact top-k lookups that read only the lists they need.

The posting list of a word is cut into blocks by a hash of the article's id, one row each,
and the rows lie in folders by a hash of the word, sorted by word. A batch of claims reads
the folders of its words and never the articles.

All articles that share a word gain the same weight by it, its IDF. So the maximum of a
word over a block is its weight where the block has a row of it and nothing elsewhere, and
it can be read from the row's key without its ids. A lookup goes by MaxScore:

1. The rarest words of a claim give a first floor: the k-th best sum so far.
2. A word is essential while it and all more frequent ones together reach the floor. An
   article without an essential word cannot. The lists of essential words are read whole;
   they give all candidates with part of their score, and a better floor.
3. Of the other words only the keys in the candidates' blocks are read. A candidate whose
   part and the maxima of its block stay below the floor goes.
4. The ids of what is left complete the scores.

Nothing is cut off: bounds decide, and a claim of frequent words only reads their lists.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from claimlens.operators.encode import Lexicon, distinct_tokens, each_term
from claimlens.operators.lexical import weighted_terms
from claimlens.operators.topk import best_per_query
from claimlens.session import durable

# Folders at most; small indexes have one for each so many articles.
PARTS, PART_ARTICLES = 256, 16_384
# Articles of a block, on average.
BLOCK_ARTICLES = 4_096
# Words that give the first floor are added while their lists have this many articles in all.
FIRST_POSTINGS = 10_000
_POSTINGS = "token string, block int, ids array<long>, part int"
# Tasks that write one folder, so that a word most articles have is not written by one.
SPREAD = 8


@dataclass(frozen=True)
class StoredIndex:
    """postings(part, token, block, ids) and words(part, token, df) of n_docs articles."""

    postings: DataFrame
    words: DataFrame
    n_docs: int
    n_parts: int
    n_blocks: int


def part_of(token: Column, n_parts: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(n_parts)).cast("int")


def block_of(item: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(n_blocks)).cast("int")


def write_index(
    terms: DataFrame, path: str, n_parts: int | None = None, block_articles: int = BLOCK_ARTICLES
) -> None:
    """Store the index of (id, terms), the distinct words of every article."""
    n_docs = terms.count()
    n_parts = n_parts or min(PARTS, max(1, -(-n_docs // PART_ARTICLES)))
    n_blocks = max(1, -(-n_docs // block_articles))
    rows = each_term(terms).select(
        "token", block_of(F.col("id"), n_blocks).alias("block"), F.col("id").alias("item_id")
    )
    lists = rows.groupBy("token", "block").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
    lists = lists.withColumn("part", part_of(F.col("token"), n_parts))
    (
        lists.repartition("part", F.pmod("block", F.lit(SPREAD)))
        .sortWithinPartitions("part", "token", "block")
        .write.mode("overwrite")
        .partitionBy("part")
        .parquet(f"{path}/postings")
    )
    spark = terms.sparkSession
    stored = spark.read.schema(_POSTINGS).parquet(f"{path}/postings")
    words = stored.groupBy("part", "token").agg(F.sum(F.size("ids")).cast("long").alias("df"))
    (
        words.repartition("part")
        .sortWithinPartitions("part", "token")
        .write.mode("overwrite")
        .partitionBy("part")
        .parquet(f"{path}/words")
    )
    sizes = spark.createDataFrame([(n_docs, n_parts, n_blocks)], "n_docs long, n_parts int, n_blocks int")
    sizes.write.mode("overwrite").parquet(f"{path}/sizes")


def read_index(spark: SparkSession, path: str) -> StoredIndex:
    sizes = spark.read.parquet(f"{path}/sizes").first()
    postings = spark.read.schema(_POSTINGS).parquet(f"{path}/postings")
    words = spark.read.schema("token string, df long, part int").parquet(f"{path}/words")
    return StoredIndex(postings, words, sizes["n_docs"], sizes["n_parts"], sizes["n_blocks"])


def _folders(wanted: DataFrame, n_parts: int) -> list[int]:
    """The folders that hold the wanted tokens; there are at most n_parts."""
    rows = wanted.select(part_of(F.col("token"), n_parts).alias("part")).distinct()
    return sorted(r["part"] for r in rows.collect())


def _hits(words: DataFrame, index: StoredIndex) -> DataFrame:
    """(query_id, item_id, part score) from the whole lists of the words."""
    lists = index.postings.where(F.col("part").isin(_folders(words, index.n_parts)))
    rows = words.join(lists, "token").select("query_id", "weight", F.explode("ids").alias("item_id"))
    return rows.groupBy("query_id", "item_id").agg(F.sum("weight").alias("score"))


def _floor(hits: DataFrame, k: int) -> DataFrame:
    """(query_id, floor): the k-th best score of the queries that have k hits."""
    best = best_per_query(hits, k)
    return best.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))


def index_join(
    claims: DataFrame,
    index: StoredIndex,
    k: int,
    claim_id: str,
    claim_text: str,
    first_postings: int = FIRST_POSTINGS,
) -> DataFrame:
    """(claim_id, item_id, score, rank): the result of `lexical_join`, from the stored lists."""
    own = durable(distinct_tokens(claims, claim_id, claim_text))
    known = index.words.where(F.col("part").isin(_folders(each_term(own), index.n_parts)))
    terms = weighted_terms(own, Lexicon(known.select("token", "df"), index.n_docs))
    after = W.partitionBy("query_id").orderBy("place").rowsBetween(W.currentRow, W.unboundedFollowing)
    before = W.partitionBy("query_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    each = terms.select("query_id", F.posexplode("words").alias("place", "w"))
    # Rarest first: `reach` is what a word and all more frequent ones can give together.
    words = durable(
        each.select("query_id", "place", "w.token", "w.df", "w.weight").select(
            "*",
            F.sum("weight").over(after).alias("reach"),
            F.coalesce(F.sum("df").over(before), F.lit(0)).alias("read"),
            F.coalesce(F.max("df").over(before), F.lit(0)).alias("most"),
        )
    )
    # Until one word has k articles, or as long as the lists are short.
    first = words.where((F.col("most") < k) | (F.col("read") + F.col("df") <= first_postings))
    floor = _floor(_hits(first, index), k)
    marked = durable(
        words.join(floor, "query_id", "left").withColumn(
            "essential", F.col("reach") >= F.coalesce("floor", F.lit(0))
        )
    )
    found = durable(_hits(marked.where("essential"), index))
    others = marked.where(~F.col("essential")).select("query_id", "token", "weight")
    rest = others.groupBy("query_id").agg(F.sum("weight").alias("rest"))
    floor = _floor(found, k).withColumnRenamed("floor", "least")
    # Only what can still reach the floor goes on; with fewer than k hits that is all.
    open_ = (
        found.join(floor, "query_id", "left")
        .join(rest, "query_id", "left")
        .fillna(0, ["least", "rest"])
        .where(F.col("score") + F.col("rest") >= F.col("least"))
        .withColumn("block", block_of(F.col("item_id"), index.n_blocks))
    )
    open_ = durable(open_)
    lists = index.postings.where(F.col("part").isin(_folders(others, index.n_parts)))
    places = open_.select("query_id", "block").distinct().join(others, "query_id")
    keys = places.join(lists.select("token", "block"), ["token", "block"])
    maxima = keys.groupBy("query_id", "block").agg(F.sum("weight").alias("top"))
    left = (
        open_.join(maxima, ["query_id", "block"], "left")
        .fillna(0, ["top"])
        .where(F.col("score") + F.col("top") >= F.col("least"))
        .select("query_id", "item_id", "block", "score")
    )
    left = durable(left)
    needed = left.select("query_id", "block").distinct().join(others, "query_id")
    more = (
        needed.join(lists.select("token", "block", "ids"), ["token", "block"])
        .select("query_id", "weight", F.explode("ids").alias("item_id"))
        .join(left.select("query_id", "item_id"), ["query_id", "item_id"], "left_semi")
        .select("query_id", "item_id", F.col("weight").alias("score"))
    )
    total = left.select("query_id", "item_id", "score").unionByName(more)
    scored = total.groupBy("query_id", "item_id").agg(F.sum("score").cast("double").alias("score"))
    return best_per_query(scored, k).select(
        F.col("query_id").alias(claim_id), "item_id", F.col("score").cast("long").alias("score"), "rank"
    )

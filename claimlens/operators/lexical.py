"""Exact top-k articles per claim by the summed IDF of the distinct words they share.

Few claims: their words are broadcast (size checked), every task scores its share of
the articles and keeps a running top-k.

Many claims: each claim first meets only the articles that hold one of its rarest
words, by a join on words whose posting lists are short. The candidates are scored in
full. If the k-th score beats the summed weight of all words that were not used, no
article outside the candidates can enter the top k, and the claim is done. The claims
that cannot be certified this way are scanned against all articles, by broadcast when
they are few and block by block when they are not. No word is dropped: frequent ones
just weigh little.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from claimlens.operators.encode import (
    HOT_TOKENS,
    Lexicon,
    distinct_tokens,
    each_term,
    frequencies,
    idf_units,
)
from claimlens.operators.topk import (
    HITS_SCHEMA,
    RunningTopK,
    best_per_query,
    collect_if_small,
    every,
    spread,
    steps,
)
from claimlens.session import durable

BROADCAST_CLAIMS = 10_000
BROADCAST_BYTES = 32 << 20
# Words used to find candidates: the rarest few, with posting lists up to this length.
PROBE_WORDS = 8
PROBE_POSTINGS = 10_000
BLOCK_ARTICLES = 65_536
BLOCK_CLAIMS = 4_096


@dataclass(frozen=True)
class TermIndex:
    """The distinct words of every article, (id, terms), and how many articles have each."""

    terms: DataFrame
    lex: Lexicon


def term_index(terms: DataFrame) -> TermIndex:
    """From (id, terms); read twice, so best from a stored table."""
    return TermIndex(terms, Lexicon(durable(frequencies(terms)), terms.count()))


def lexical_join(
    claims: DataFrame,
    index: TermIndex,
    k: int,
    claim_id: str,
    claim_text: str,
    strategy: str = "auto",
    probe_words: int = PROBE_WORDS,
    probe_postings: int = PROBE_POSTINGS,
    broadcast_claims: int = BROADCAST_CLAIMS,
    block_articles: int = BLOCK_ARTICLES,
    block_claims: int = BLOCK_CLAIMS,
) -> DataFrame:
    """(claim_id, item_id, score, rank): ties by article id; an article must share a word."""
    docs = index.terms
    # Read by the size check, the scan and the probe: computed once.
    terms = durable(weighted_terms(distinct_tokens(claims, claim_id, claim_text), index.lex))
    if strategy == "auto":
        small = _collect_claims(terms, broadcast_claims)
        if small is not None:
            hits = _scan(docs, small, k)
        else:
            strategy = "probe"
    if strategy == "scan":
        hits = _scan_any(terms, docs, k, broadcast_claims, block_articles, block_claims)
    elif strategy == "probe":
        hits = _probe(
            terms,
            index,
            k,
            probe_words,
            probe_postings,
            broadcast_claims,
            block_articles,
            block_claims,
        )
    return best_per_query(hits, k).select(
        F.col("query_id").alias(claim_id), "item_id", F.col("score").cast("long").alias("score"), "rank"
    )


def weighted_terms(claim_terms: DataFrame, lex: Lexicon) -> DataFrame:
    """(query_id, words: array<struct<df,token,weight>>) in order of rarity.

    Words no article has are left out, they cannot score. A word that most claims
    share is split over tasks by Spark's skew join, the lexicon has it once.
    The weight is the IDF in whole units plus one, so that sharing any word counts.
    """
    rows = each_term(claim_terms).withColumnRenamed("id", "query_id")
    rows = rows.join(lex.df, "token").select(
        "query_id",
        F.struct("df", "token", (idf_units(lex.n_docs, F.col("df")) + 1).alias("weight")).alias("w"),
    )
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list("w")).alias("words"))


def _collect_claims(terms: DataFrame, max_claims: int) -> pa.Table | None:
    """Claims with their words when both their number and their size are bounded."""
    sized = terms.select(
        "query_id",
        F.transform("words", lambda w: w["token"]).alias("tokens"),
        F.transform("words", lambda w: w["weight"]).alias("weights"),
    )
    total = sized.limit(max_claims + 1).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(
            F.sum(F.aggregate("tokens", F.lit(0), lambda a, t: a + F.octet_length(t) + 16)), F.lit(0)
        ).alias("bytes"),
    ).first()
    if total["n"] > max_claims or total["bytes"] > BROADCAST_BYTES:
        return None
    return collect_if_small(sized, max_claims)


class _ClaimWords:
    """The claims of one task as columns, with the claims of each word side by side."""

    def __init__(self, claims: pa.Table):
        claims = claims.combine_chunks()
        self.ids = claims.column("query_id").to_numpy()
        tokens = claims.column("tokens").combine_chunks()
        sizes = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
        coded = tokens.flatten().dictionary_encode()
        self.vocabulary = coded.dictionary
        word = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(word, kind="stable")
        self.claim = np.repeat(np.arange(len(self.ids)), sizes)[order]
        weights = claims.column("weights").combine_chunks().flatten()
        self.weight = weights.to_numpy(zero_copy_only=False).astype(np.float64)[order]
        self.start = np.searchsorted(word[order], np.arange(len(self.vocabulary) + 1))

    def offer(self, top: RunningTopK, ids: np.ndarray, terms: pa.ListArray) -> None:
        """Sum the weights of shared words for every claim and article of the batch."""
        sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
        word = pc.index_in(terms.flatten(), value_set=self.vocabulary)
        known = pc.is_valid(word).to_numpy(zero_copy_only=False)
        word = word.drop_null().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(ids)), sizes)[known]
        n = len(self.ids)
        # Each claim and article may share many words: an eighth of the usual step.
        for part in steps(len(ids), 8 * n):
            lo, hi = np.searchsorted(doc, [part.start, part.stop])
            if lo == hi:
                continue
            w, d = word[lo:hi], doc[lo:hi] - part.start
            width = len(ids[part])
            fan = self.start[w + 1] - self.start[w]
            at = np.repeat(self.start[w] - np.cumsum(fan) + fan, fan) + np.arange(fan.sum())
            cell = self.claim[at] * width + np.repeat(d, fan)
            score = np.bincount(cell, weights=self.weight[at], minlength=n * width)
            score = score.reshape(n, width)
            score[score == 0] = -np.inf
            top.offer(score, ids[part])


def _scan(docs: DataFrame, claims: pa.Table, k: int) -> DataFrame:
    """One pass over the articles with all (few) claims in every task."""
    if claims.num_rows == 0:
        return docs.sparkSession.createDataFrame([], HITS_SCHEMA)
    shared = docs.sparkSession.sparkContext.broadcast(claims)

    def task(batches):
        words = _ClaimWords(shared.value)
        top = RunningTopK(len(words.ids), k)
        for b in batches:
            if b.num_rows:
                words.offer(top, b.column(0).to_numpy(zero_copy_only=False), b.column(1))
        yield top.to_arrow(words.ids)

    return docs.mapInArrow(task, HITS_SCHEMA)


def _scan_any(
    terms: DataFrame,
    docs: DataFrame,
    k: int,
    broadcast_claims: int,
    block_articles: int,
    block_claims: int,
) -> DataFrame:
    small = _collect_claims(terms, broadcast_claims)
    if small is not None:
        return _scan(docs, small, k)
    n_blocks = max(1, -(-docs.count() // block_articles))
    n_shares = max(1, -(-terms.count() // block_claims))
    left = terms.select(
        "query_id",
        F.transform("words", lambda w: w["token"]).alias("tokens"),
        F.transform("words", lambda w: w["weight"]).alias("weights"),
        spread(F.col("query_id"), n_shares).alias("share"),
        every(n_blocks).alias("block"),
    )
    right = docs.select(
        F.col("id").alias("item_id"),
        "terms",
        every(n_shares).alias("share"),
        spread(F.col("id"), n_blocks).alias("block"),
    )

    def score(claims: pa.Table, articles: pa.Table) -> pa.Table:
        top = RunningTopK(claims.num_rows, k)
        qids = claims.column("query_id").to_numpy()
        if claims.num_rows and articles.num_rows:
            words = _ClaimWords(claims.select(["query_id", "tokens", "weights"]))
            for b in articles.combine_chunks().to_batches():
                words.offer(top, b.column("item_id").to_numpy(zero_copy_only=False), b.column("terms"))
        return pa.Table.from_batches([top.to_arrow(qids)])

    keys = ["share", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, HITS_SCHEMA)


def _probe(
    terms: DataFrame,
    index: TermIndex,
    k: int,
    probe_words: int,
    probe_postings: int,
    broadcast_claims: int,
    block_articles: int,
    block_claims: int,
) -> DataFrame:
    docs = index.terms
    # Rarest words first, so the probe words are a prefix; the rest bounds unseen articles.
    probe = F.filter(
        F.slice("words", 1, probe_words), lambda w: w["df"] <= F.lit(probe_postings)
    )
    split = terms.withColumn("probe", probe).withColumn(
        "unseen",
        F.aggregate(
            F.slice("words", F.size("probe") + 1, F.greatest(F.size("words"), F.lit(1))),
            F.lit(0).cast("long"),
            lambda a, w: a + w["weight"],
        ),
    )
    wanted = split.select("query_id", F.explode("probe.token").alias("token"))
    # No probe word is that frequent: the bulk of the postings never reaches the shuffle.
    frequent = F.broadcast(
        index.lex.df.where(F.col("df") > probe_postings)
        .orderBy(F.desc("df"), F.asc("token"))
        .limit(HOT_TOKENS)
        .select("token")
    )
    postings = each_term(docs).withColumnRenamed("id", "item_id")
    postings = postings.join(frequent, "token", "left_anti")
    pairs = wanted.join(postings, "token").select("query_id", "item_id").distinct()
    shared = F.array_intersect(F.transform("words", lambda w: w["token"]), F.col("terms"))
    scored = (
        pairs.join(docs.withColumnRenamed("id", "item_id"), "item_id")
        .join(terms, "query_id")
        .select("query_id", "item_id", "words", shared.alias("shared"))
        .select(
            "query_id",
            "item_id",
            F.aggregate(
                F.filter("words", lambda w: F.array_contains(F.col("shared"), w["token"])),
                F.lit(0).cast("long"),
                lambda a, w: a + w["weight"],
            )
            .cast("double")
            .alias("score"),
        )
    )
    found = durable(best_per_query(scored, k).drop("rank"))
    worst = found.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("score").alias("worst")
    )
    done = split.join(worst, "query_id", "left").select(
        "query_id",
        (
            (F.col("unseen") == 0)
            | ((F.coalesce("n", F.lit(0)) >= k) & (F.coalesce("worst", F.lit(0.0)) > F.col("unseen")))
        ).alias("certain"),
    )
    done = durable(done)
    rest = terms.join(done.where(~F.col("certain")), "query_id", "left_semi")
    sure = found.join(done.where("certain"), "query_id", "left_semi")
    return sure.unionByName(
        _scan_any(durable(rest), docs, k, broadcast_claims, block_articles, block_claims)
    )

"""Evidence retrieval: three sources, one bag of candidates, one re-ranking."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from claimlens.functions import text as X
from claimlens.functions.vectors import cosine, with_unit_vector
from claimlens.operators.encode import Encoder, Lexicon, encode, hashed_encoder, lexicon
from claimlens.operators.knn import knn_join
from claimlens.operators.lexical import TermIndex, lexical_join, term_index
from claimlens.operators.postings import StoredIndex, index_join
from claimlens.session import durable

# Depth of the final cut and of each article source.
DEFAULT_K, ENCYCLOPAEDIA_K, NEWS_K = 5, 2, 3
LOCAL, ENCYCLOPAEDIA, NEWS = 0, 1, 2
LOCAL_SOURCE = "local"


# Rows (of ids and scores only) up to which hits are broadcast to the tables they point into.
BROADCAST_ROWS = 200_000

# Articles from which a stored inverted index is used instead of a pass over all articles.
INDEX_ARTICLES = 100_000

# Gives the encoder of a table from the names of its id and text columns.
EncoderOf = Callable[[str, str], Encoder]


@dataclass(frozen=True)
class Source:
    """A landed article table (item_id, source, text), its words and the vectors of its texts.

    With an encoder the vectors are not stored, and those of hits alone can be made. A table
    that was written has its posting lists as well.
    """

    items: DataFrame
    index: TermIndex
    vectors: DataFrame
    encoder: Encoder | None = None
    stored: StoredIndex | None = None


@dataclass(frozen=True)
class Corpus:
    """What claims are checked against.

    evidence(evidence_id, text, source_url), vectors(evidence_id, embedding) and what made
    them: an encoder, or without one the lexicon of the default encoder. Articles and news
    are None when switched off.
    """

    evidence: DataFrame
    vectors: DataFrame
    lex: Lexicon | None
    articles: Source | None = None
    news: Source | None = None
    encoder: EncoderOf | None = None

    def sources(self) -> list[tuple[int, int, Source]]:
        """(source rank, depth, source) of the keyword sources that are on."""
        rows = ((ENCYCLOPAEDIA, ENCYCLOPAEDIA_K, self.articles), (NEWS, NEWS_K, self.news))
        return [r for r in rows if r[2] is not None]


def encoder_for(
    id_col: str, text_col: str, lex: Lexicon | None, encoder: EncoderOf | None = None
) -> Encoder:
    """The plugged-in encoder, its vectors scaled to length 1, or else the default one."""
    if encoder is None:
        return hashed_encoder(lex, id_col, text_col)
    plugged = encoder(id_col, text_col)

    def run(df: DataFrame) -> DataFrame:
        unit = with_unit_vector(plugged(df).select(id_col, "embedding"), "embedding")
        return unit.withColumn("embedding", F.col("embedding").cast("array<float>"))

    return run


def build_source(table: DataFrame, lex: Lexicon | None, encoder: EncoderOf | None = None) -> Source:
    """Index a landed table (item_id, source, text, body); words are looked up in body.

    The rows with their words are written out once and serve every later read.
    """
    words = F.array_distinct(X.tokens(F.col("body"))).alias("terms")
    landed = durable(table.select("item_id", "source", "text", words))
    items = landed.select("item_id", "source", "text")
    encode_items = encoder_for("item_id", "text", lex, encoder)
    index = term_index(landed.select(F.col("item_id").alias("id"), "terms"))
    return Source(items, index, encode_items(items), encode_items)


def build_corpus(
    evidence: DataFrame,
    articles: DataFrame | None = None,
    news: DataFrame | None = None,
    encoder: EncoderOf | None = None,
) -> Corpus:
    """Index evidence and articles, with the default encoder unless another is plugged in.

    Word frequencies are read by every later step of the default encoder, so they are
    written out once; so are the vectors of a plugged-in one, which may be dear. The rest
    stays lazy.
    """
    if encoder is None:
        words = lexicon(evidence, "evidence_id", "text")
        lex = Lexicon(durable(words.df), words.n_docs)
        vectors = encode(evidence, "evidence_id", "text", lex)
    else:
        lex = None
        vectors = durable(encoder_for("evidence_id", "text", None, encoder)(evidence))
    on = [None if t is None else build_source(t, lex, encoder) for t in (articles, news)]
    return Corpus(evidence, vectors, lex, *on, encoder)


def claim_vectors(claims: DataFrame, corpus: Corpus) -> DataFrame:
    return encoder_for("claim_id", "text", corpus.lex, corpus.encoder)(claims)


def if_small(stored: DataFrame) -> DataFrame:
    """A stored table of narrow rows, marked for broadcast while it has few of them."""
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def local_hits(vectors: DataFrame, corpus: Corpus, k: int, **how) -> DataFrame:
    """(claim_id, source_rank, pos, item_id, score) from the evidence vectors."""
    hits = knn_join(vectors, corpus.vectors, k, "claim_id", "evidence_id", **how)
    return hits.select(
        "claim_id", F.lit(LOCAL).alias("source_rank"), F.col("rank").alias("pos"), "item_id", "score"
    )


def article_hits(claims: DataFrame, source: Source, k: int, source_rank: int, **how) -> DataFrame:
    """(claim_id, source_rank, pos, item_id, relevance) from a keyword source.

    Large sources that have stored posting lists are asked by these, which gives the same hits.
    """
    if source.stored is not None and source.stored.n_docs >= INDEX_ARTICLES and not how:
        hits = index_join(claims, source.stored, k, "claim_id", "text")
    else:
        hits = lexical_join(claims, source.index, k, "claim_id", "text", **how)
    return hits.select(
        "claim_id",
        F.lit(source_rank).alias("source_rank"),
        F.col("rank").alias("pos"),
        "item_id",
        F.col("score").alias("relevance"),
    )


def candidates(claims: DataFrame, vectors: DataFrame, corpus: Corpus, k: int) -> DataFrame:
    """Bag union of the sources, each with its own limit; duplicates stay.

    Only the evidence search scores its hits here; keyword hits have no score yet.
    """
    none = F.lit(None).cast("double").alias("score")
    out = local_hits(vectors, corpus, k)
    for rank, depth, source in corpus.sources():
        hits = article_hits(claims, source, depth, rank)
        out = out.unionByName(hits.select("claim_id", "source_rank", "pos", "item_id", none))
    return out


def rescore(cands: DataFrame, vectors: DataFrame, corpus: Corpus) -> DataFrame:
    """Cosine of claim and candidate text for every candidate.

    Evidence hits carry that value already; only keyword hits need their vectors, and
    where these are not stored, only articles that were hit are encoded. A candidate
    without a vector keeps a null score. `cands` is read more than once.
    """
    items = None
    for rank, _, source in corpus.sources():
        vecs = source.vectors
        if source.encoder is not None:
            hit = durable(cands.where(F.col("source_rank") == rank).select("item_id").distinct())
            vecs = source.encoder(source.items.join(if_small(hit), "item_id", "left_semi"))
        part = vecs.select(F.lit(rank).alias("source_rank"), "item_id", "embedding")
        items = part if items is None else items.unionByName(part)
    if items is None:
        return cands
    claim = vectors.select("claim_id", F.col("embedding").alias("claim_embedding"))
    scored = (
        cands.where(F.col("source_rank") > LOCAL)
        .join(items, ["source_rank", "item_id"], "left")
        .join(claim, "claim_id", "left")
        .select(
            "claim_id",
            "source_rank",
            "pos",
            "item_id",
            cosine(F.col("claim_embedding"), F.col("embedding")).alias("score"),
        )
    )
    return cands.where(F.col("source_rank") == LOCAL).unionByName(scored)


def rerank(scored: DataFrame, k: int) -> DataFrame:
    """The k best candidates per claim; equal scores keep source order, then position."""
    w = W.partitionBy("claim_id").orderBy(
        F.desc_nulls_last("score"), F.asc("source_rank"), F.asc("pos")
    )
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_text(ranked: DataFrame, corpus: Corpus) -> DataFrame:
    """Look source and text up after the cut, by the hit's own id.

    Few hits are broadcast to the texts, which then stay where they are read. Each source is
    joined by its id alone, so texts that are stored in buckets by id stay there in any case.
    """
    ranked = if_small(durable(ranked))
    local = corpus.evidence.select(
        F.col("evidence_id").alias("item_id"),
        F.coalesce("source_url", F.lit(LOCAL_SOURCE)).alias("source"),
        "text",
    )
    tables = [(LOCAL, local)]
    tables += [(rank, s.items.select("item_id", "source", "text")) for rank, _, s in corpus.sources()]
    found = [ranked.where(F.col("source_rank") == rank).join(items, "item_id") for rank, items in tables]
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def retrieve(claims: DataFrame, corpus: Corpus, k: int = DEFAULT_K) -> DataFrame:
    """(claim_id, rank, source_rank, item_id, source, text, score), best first."""
    # Read by the evidence search and again for scoring: computed once.
    vectors = durable(claim_vectors(claims, corpus))
    cands = durable(candidates(claims, vectors, corpus, k))
    ranked = rerank(rescore(cands, vectors, corpus), k)
    return with_text(ranked, corpus).select(
        "claim_id", "rank", "source_rank", "item_id", "source", "text", "score"
    )


def as_list(hits: DataFrame, key: str = "claim_id") -> DataFrame:
    """One row per claim: its hits (k at most) as an array in rank order."""
    packed = F.array_sort(F.collect_list(F.struct("rank", "source", "text", "score")))
    plain = F.transform(
        packed,
        lambda h: F.struct(
            h["source"].alias("source"), h["text"].alias("text"), h["score"].alias("score")
        ),
    )
    return hits.groupBy(key).agg(plain.alias("evidence"))

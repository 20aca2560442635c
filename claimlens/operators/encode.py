"""Default text encoder: hashed, IDF-weighted bag of words; and the encoder contract.

Weights are whole numbers (micro-nats), so sums do not depend on the order in which
shuffled rows arrive and a re-run task gives the same vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from claimlens.functions import text as X

# An encoder maps (id, text) rows to (id, embedding) rows.
Encoder = Callable[[DataFrame], DataFrame]

DIM = 256
IDF_UNITS = 1e6
# Tokens met by broadcast because they are the most frequent ones, whatever the corpus size:
# in joins, about 1 MB, and with their prices in the encoder's tasks, about 6 MB.
HOT_TOKENS = 10_000
PRICED_TOKENS = 200_000
# Words up to which all prices are broadcast to the words that leave their row, about 60 MB.
BROADCAST_WORDS = 1_000_000
# Texts whose bucket sums are held as one dense array.
STEP_TEXTS = 4_096


@dataclass(frozen=True)
class Lexicon:
    """Document frequencies of a corpus: token, df; and the number of documents."""

    df: DataFrame
    n_docs: int


def distinct_tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, terms): the distinct tokens of each text as one array."""
    return docs.select(
        F.col(id_col).alias("id"), F.array_distinct(X.tokens(F.col(text_col))).alias("terms")
    )


def lexicon(docs: DataFrame, id_col: str, text_col: str) -> Lexicon:
    """Word frequencies of a corpus. The number of documents is counted at once, which
    for a stored table reads no column."""
    return Lexicon(frequencies(distinct_tokens(docs, id_col, text_col)), docs.count())


def each_term(terms: DataFrame) -> DataFrame:
    """(id, token) rows. The outer form keeps Spark from tokenising twice, once for a
    filter on the array's size and once for its elements."""
    rows = terms.select("id", F.explode_outer("terms").alias("token"))
    return rows.where(F.col("token").isNotNull())


def frequencies(terms: DataFrame) -> DataFrame:
    """(token, df); the counts are combined in the map tasks before the shuffle."""
    return each_term(terms).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def idf_units(n_docs: int, df: Column) -> Column:
    ratio = F.lit(n_docs + 1.0) / (df.cast("double") + 1.0)
    return F.round(F.log(ratio) * F.lit(IDF_UNITS)).cast("long")


def bucket_of(token: Column, dim: int = DIM) -> Column:
    """Fixed rule: the first eight hex digits of the token's md5, modulo the dimension."""
    head = F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long")
    return F.pmod(head, F.lit(dim)).cast("int")


def _most_frequent(words: DataFrame, n: int) -> DataFrame:
    """The words of the highest frequencies, whole frequencies only, as long as they are at most n.

    Only the numbers of words by frequency are sorted, of which n are enough; so are ties cut
    off together, and no table of words is sorted.
    """
    sizes = words.groupBy("df").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("df")).limit(n + 1)
    total, least = 0, None
    for row in sizes.collect():
        total += row["n"]
        if total > n:
            break
        least = row["df"]
    return words.where(F.lit(False) if least is None else F.col("df") >= least)


@lru_cache(maxsize=4)
def _has_few_words(lex: Lexicon, most: int) -> bool:
    """Looked up once per corpus, as claims, articles and evidence are encoded by the same one."""
    return lex.df.limit(most + 1).count() <= most


@lru_cache(maxsize=4)
def _corpus_prices(lex: Lexicon, dim: int, hot: int) -> pa.Table:
    """(token, bucket, idf) of the corpus' most frequent words, at most `hot`."""
    price = idf_units(lex.n_docs, F.col("df")).alias("idf")
    top = _most_frequent(lex.df, hot)
    return top.select("token", bucket_of(F.col("token"), dim).alias("bucket"), price).toArrow()


def _pairs(buckets: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    columns = [pa.array(buckets, pa.int32()), pa.array(weights, pa.int64())]
    items = pa.StructArray.from_arrays(columns, ["bucket", "weight"])
    return pa.ListArray.from_arrays(pa.array(at), items)


def _sum_in_rows(prices: pa.Table, dim: int):
    """A task that sums the priced tokens of each text into buckets and hands on the others.

    A text gives one row with its (bucket, weight) pairs, the first of them (-1, 0), under a
    token that no text has; each other distinct token gives a row with its count.
    """
    shared = {c: prices.column(c).combine_chunks() for c in ("token", "bucket", "idf")}

    def step(ids: pa.Array, tokens: pa.ListArray) -> Iterator[pa.RecordBatch]:
        n, width = len(ids), dim + 1
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        text, flat = np.repeat(np.arange(n), sizes), tokens.flatten()
        code = pc.fill_null(pc.index_in(flat, value_set=shared["token"]), -1).to_numpy(zero_copy_only=False)
        known = code >= 0
        # Bucket -1 is the first column and always there.
        cell = text[known] * width + shared["bucket"].to_numpy()[code[known]] + 1
        price = shared["idf"].to_numpy()[code[known]]
        weight = np.bincount(cell, weights=price, minlength=n * width)
        there = np.bincount(cell, minlength=n * width) > 0
        there[::width] = True
        at = np.flatnonzero(there)
        yield pa.RecordBatch.from_arrays(
            [
                ids,
                pc.binary_join_element_wise("", pc.fill_null(ids.cast(pa.string()), ""), " "),
                _pairs(at % width - 1, weight[at].astype(np.int64), there.reshape(n, width).sum(1)),
                pa.nulls(n, pa.int32()),
            ],
            names=["id", "token", "e", "tf"],
        )
        coded = flat.filter(pa.array(~known)).dictionary_encode()
        words = len(coded.dictionary)
        if words:
            key = text[~known] * words + coded.indices.to_numpy(zero_copy_only=False)
            key, count = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(key // words)),
                    coded.dictionary.take(pa.array(key % words)),
                    pa.nulls(len(key), _pairs(at[:0], at[:0], at[:0]).type),
                    pa.array(count, pa.int32()),
                ],
                names=["id", "token", "e", "tf"],
            )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, STEP_TEXTS):
                part = batch.slice(low, STEP_TEXTS)
                yield from step(part.column("id"), part.column("tokens"))

    return task


def _merged(dim: int, give: Callable[[pa.Array, np.ndarray, np.ndarray], pa.RecordBatch]):
    """A task that adds up the (bucket, weight) pairs of equal ids, which come side by side.

    `give` makes its rows from the ids, the sums by text and bucket, the first of them bucket -1,
    and what is there. At most `STEP_TEXTS` rows are summed at once, and the sums of the last id
    wait for those that follow.
    """
    width = dim + 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for low in range(0, batch.num_rows, STEP_TEXTS):
                part = batch.slice(low, STEP_TEXTS)
                ids, e = part.column(0), part.column(1)
                code = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                text = np.concatenate([[0], np.cumsum(code[1:] != code[:-1])])
                firsts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                n = len(firsts)
                flat = e.flatten()
                sizes = pc.fill_null(pc.list_value_length(e), 0).to_numpy(zero_copy_only=False)
                cell = np.repeat(text, sizes) * width + flat.field(0).to_numpy(zero_copy_only=False) + 1
                weight = np.bincount(cell, weights=flat.field(1).to_numpy(zero_copy_only=False), minlength=n * width)
                sums = weight.astype(np.int64).reshape(n, width)
                there = (np.bincount(cell, minlength=n * width) > 0).reshape(n, width)
                ids = ids.take(pa.array(firsts))
                if last is not None:
                    if last[0].to_pylist() == ids.slice(0, 1).to_pylist():
                        sums[0] += last[1][0]
                        there[0] |= last[2][0]
                    else:
                        yield give(*last)
                if n > 1:
                    yield give(ids.slice(0, n - 1), sums[:-1], there[:-1])
                last = ids.slice(n - 1), sums[-1:].copy(), there[-1:].copy()
        if last is not None:
            yield give(*last)

    return task


def _as_pairs(ids: pa.Array, sums: np.ndarray, there: np.ndarray) -> pa.RecordBatch:
    text, cell = np.nonzero(there)
    e = _pairs(cell - 1, sums[text, cell], there.sum(axis=1))
    return pa.RecordBatch.from_arrays([ids, e], names=["id", "e"])


def _as_vectors(ids: pa.Array, sums: np.ndarray, there: np.ndarray) -> pa.RecordBatch:
    weights = sums[:, 1:].astype(np.float64)
    length = np.sqrt((weights**2).sum(axis=1))
    weights /= np.where(length > 0, length, 1)[:, None]
    at = np.arange(len(ids) + 1, dtype=np.int32) * weights.shape[1]
    vectors = pa.ListArray.from_arrays(pa.array(at), pa.array(weights.astype(np.float32).ravel()))
    return pa.RecordBatch.from_arrays([ids, vectors], names=["id", "embedding"])


def _summed(
    docs: DataFrame, id_col: str, text_col: str, lex: Lexicon, own: DataFrame | None, dim: int, hot: int
) -> DataFrame:
    """(id, e): (bucket, weight) pairs of every text in one row or more, side by side."""
    priced = lex.df.select(
        "token",
        bucket_of(F.col("token"), dim).alias("bucket"),
        idf_units(lex.n_docs, F.col("df")).alias("idf"),
    )
    # A token the corpus has not seen weighs as one with document frequency 0.
    bucket = F.coalesce("bucket", bucket_of(F.col("token"), dim))
    idf = F.coalesce("idf", idf_units(lex.n_docs, F.lit(0)))
    few = _has_few_words(lex, BROADCAST_WORDS)
    if own is None or few:
        prices = _corpus_prices(lex, dim, hot)
    else:
        found = _most_frequent(own, hot).select("token").join(priced, "token", "left")
        prices = found.select("token", bucket.alias("bucket"), idf.alias("idf")).toArrow()
    rows = docs.select(F.col(id_col).alias("id"), X.tokens(F.col(text_col)).alias("tokens"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("token", T.StringType())])
    pair = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("weight", T.LongType())])
    schema.add("e", T.ArrayType(pair)).add("tf", T.IntegerType())
    summed = rows.mapInArrow(_sum_in_rows(prices, dim), schema)
    one = F.array(F.struct(bucket.alias("bucket"), (F.col("tf") * idf).alias("weight")))
    # Sums move along with the words that left: a token of their own spreads them evenly.
    priced = F.broadcast(priced) if few else priced.hint("shuffle_hash")
    rows = summed.join(priced, "token", "left").select("id", F.coalesce("e", one).alias("e"))
    return rows.repartition("id").sortWithinPartitions("id")


def bucket_weights(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    lex: Lexicon,
    own: DataFrame | None = None,
    dim: int = DIM,
    hot: int = PRICED_TOKENS,
    beside: DataFrame | None = None,
) -> DataFrame:
    """(id, bucket, weight): summed tf * idf per hash bucket, and (id, -1, 0) for every text.

    The most frequent tokens are priced in the row, from a broadcast of at most `hot` prices,
    and summed into buckets there. The others leave the row and meet their prices by token:
    with up to `BROADCAST_WORDS` words in the corpus by broadcast, with more by a shuffle.
    Texts are tokenised once. None of these tokens can dominate, since `hot` others occur more
    often: `own` gives the (token, df) of the encoded texts when they are not the corpus of
    `lex`, and is read with more words only. The columns of `beside`, a table with an `id`, are
    joined to the texts before these become rows.
    """
    rows = _summed(docs, id_col, text_col, lex, own, dim, hot)
    merged = rows.mapInArrow(_merged(dim, _as_pairs), rows.schema)
    more = [] if beside is None else [c for c in beside.columns if c != "id"]
    merged = merged if beside is None else merged.join(beside, "id")
    return merged.select("id", *more, F.inline("e"))


def encode(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    lex: Lexicon,
    own: DataFrame | None = None,
    dim: int = DIM,
) -> DataFrame:
    """(id, embedding ARRAY<FLOAT>): unit vectors; a text without tokens gets the zero vector."""
    rows = _summed(docs, id_col, text_col, lex, own, dim, PRICED_TOKENS)
    schema = T.StructType([rows.schema["id"], T.StructField("embedding", T.ArrayType(T.FloatType()))])
    vectors = rows.mapInArrow(_merged(dim, _as_vectors), schema)
    return vectors.select(F.col("id").alias(id_col), "embedding")


def hashed_encoder(lex: Lexicon, id_col: str, text_col: str, dim: int = DIM) -> Encoder:
    """The default encoder, weighted by a corpus lexicon."""

    def run(df: DataFrame) -> DataFrame:
        own = frequencies(distinct_tokens(df, id_col, text_col))
        return encode(df, id_col, text_col, lex, own, dim)

    return run


def model_encoder(
    load: Callable[[], Callable[[list[str]], list]], id_col: str, text_col: str
) -> Encoder:
    """Encoder backed by a model: loaded once per task, called per Arrow batch.

    A batch that fails is retried row by row, so that one bad text only costs its own
    vector: its embedding is null and `error` says why.
    """
    schema = T.StructType(
        [
            T.StructField(id_col, T.LongType()),
            T.StructField("embedding", T.ArrayType(T.FloatType())),
            T.StructField("error", T.StringType()),
        ]
    )

    def run(df: DataFrame) -> DataFrame:
        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            call = load()
            for pdf in batches:
                texts = pdf[text_col].tolist()
                try:
                    vecs, errs = list(call(texts)), [None] * len(texts)
                except Exception:
                    vecs, errs = [], []
                    for t in texts:
                        try:
                            vecs.append(list(call([t]))[0])
                            errs.append(None)
                        except Exception as e:
                            vecs.append(None)
                            errs.append(str(e))
                yield pd.DataFrame({id_col: pdf[id_col], "embedding": vecs, "error": errs})

        return df.select(id_col, text_col).mapInPandas(task, schema)

    return run

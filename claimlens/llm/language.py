"""Language ID by fusing evidence: text, declared language, address suffix and host.

The posterior of language l of a row is proportional to
    P(text | l)^(1/3) * P(declared | l) * P(l | host),
with byte trigrams for the text (each byte is in three of them, hence the third), the
declared language's confusion with what texts say (counted for every declared value), and a host prior smoothed towards the
prior of its address suffix, which is smoothed towards that of all rows. Counts for the
last two come from grouped aggregation over all rows. A class `und` with evenly
spread trigrams takes texts that no known language explains.

Every declared language has a trigram model, fitted on all of its rows or on a sample of
about `SAMPLE_ROWS` of them, so none is lost for being rare. A model takes 131 kB of
memory. The counts by host are combined in the map tasks, so a host with a third
of all rows costs no more than others; its prior comes back by a broadcast of the
`HOT_HOSTS` largest hosts, and only rows of other hosts are joined by a shuffle; the
evidence of declared values comes back in the same way.

Defined results: null, empty and letterless texts are `und` with confidence 0 and not kept;
a null declared language or address counts as a value of its own; repeated rows give
repeated results; an empty table gives an empty one; columns of the input are passed on
unchanged and those added give way to clashing names by an underscore in front.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from claimlens.llm import arrays as A
from claimlens.llm.tables import free_name
from claimlens.session import durable

SAMPLE_ROWS = 1_000
GRAMS = 1 << 15
HOT_HOSTS = 5_000
# Weight of the wider prior, in rows; share of rows expected to be in no known language.
SMOOTHING, UNKNOWN_SHARE = 20.0, 0.01
MIN_CONFIDENCE = 0.5
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of all texts in order and the first one of each text."""
    data, offsets = A.buffers(texts)
    b = _LOWER[data]
    if len(b) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(len(offsets), dtype=np.int64)
    code = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(17)
    # A trigram that reaches over the end of its text is none.
    inside = np.ones(len(code), dtype=bool)
    for back in (1, 2):
        at = offsets[1:-1] - back
        inside[at[(at >= 0) & (at < len(code))]] = False
    total = np.concatenate([[0], np.cumsum(inside)])
    return code[inside].astype(np.int64), total[np.clip(offsets, 0, len(code))]


def letterless(texts: pa.Array) -> np.ndarray:
    data, offsets = A.buffers(texts)
    letter = (data >= 128) | (_LOWER[data] >= 97) & (_LOWER[data] <= 122)
    return A.spread_sum(letter.astype(np.int64), offsets) == 0


@dataclass
class Model:
    """log P(trigram | language) by trigram, the last language being `und`."""

    languages: list[str]
    log_gram: np.ndarray

    def log_text(self, texts: pa.Array) -> np.ndarray:
        gram, ptr = grams(texts)
        return A.spread_sum(self.log_gram[gram].astype(np.float64), ptr) / 3


def fit(docs: DataFrame, declared: Column, text: Column, key: Column, rows: int = SAMPLE_ROWS) -> Model:
    """Trigram models of all declared languages, from about `rows` rows of each.

    A language of at most `rows` rows gives all; of others the rows whose keys have the
    smallest hashes are taken, up to the hash that `rows` rows are expected below.
    """
    tagged = docs.select(F.xxhash64(key, text).alias("h"), declared.alias("l"), text.alias("text"))
    sizes = tagged.where("l is not null").groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least"))
    share = (F.lit(float(rows)) / F.col("n") * 2.0**64 - 2.0**63).cast("long")
    below = F.when(F.col("n") <= rows, (1 << 63) - 1).otherwise(F.greatest("least", share))
    limits = F.broadcast(sizes.select("l", below.alias("below")))
    sample = tagged.join(limits, "l").where(F.col("h") <= F.col("below")).select("l", "text")

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        names = part.column("l").to_pylist()
        order = {n: i for i, n in enumerate(dict.fromkeys(names))}
        gram, ptr = grams(part.column("text"))
        which = np.repeat(np.array([order[n] for n in names]), np.diff(ptr))
        pair, count = np.unique(which * GRAMS + gram, return_counts=True)
        label = pa.array(list(order)).take(pa.array(pair // GRAMS))
        return pa.RecordBatch.from_arrays(
            [label, pa.array(pair % GRAMS, pa.int32()), pa.array(count, pa.int64())], names=["l", "gram", "n"]
        )

    counts = sample.mapInArrow(A.over_texts(kernel), "l string, gram int, n long")
    found = counts.groupBy("l", "gram").agg(F.sum("n").alias("n")).toArrow()
    names, code = np.unique(found.column("l").to_pylist() or np.zeros(0, str), return_inverse=True)
    table = np.zeros((GRAMS, len(names)))
    np.add.at(table, (found.column("gram").to_numpy().astype(int), code), found.column("n").to_numpy())
    table = np.concatenate([table + 0.05, np.ones((GRAMS, 1))], axis=1)
    return Model([str(n) for n in names] + [UNKNOWN], np.log(table / table.sum(0)).astype(np.float32))


def host_of(address: Column) -> Column:
    """Host of an address; a value that is no address stands for its host."""
    host = F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(F.coalesce(F.when(host != "", host), address, F.lit("")))


def suffix_of(host: Column) -> Column:
    """What follows the last dot of a host; empty if there is none."""
    return F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -1)).otherwise(F.lit(""))


def _looked_up(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """The rows with the value of their key. table: (key, n, value), one row for each key.

    The `HOT_HOSTS` keys of the most rows are broadcast, the rest is joined by a shuffle.
    """
    hot = table.orderBy(F.desc("n"), key).limit(HOT_HOSTS).select(key, value)
    found = rows.join(F.broadcast(hot), key, "left")
    if table.count() <= HOT_HOSTS:
        return found
    late = free_name(rows, "_late")
    rest = table.join(F.broadcast(hot.select(key)), key, "left_anti").select(key, F.col(value).alias(late))
    return (
        found.where(F.col(value).isNotNull())
        .withColumn(late, F.lit(None).cast("array<double>"))
        .unionByName(found.where(F.col(value).isNull()).join(rest, key, "left"))
        .withColumn(value, F.coalesce(value, late))
        .drop(late)
    )


def identify(
    docs: DataFrame,
    text_column: str = "text",
    declared_column: str = "lang",
    address_column: str = "source",
    key_column: str = "doc_id",
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """All columns of docs and: language, confidence, kept."""
    spark = docs.sparkSession
    declared = F.lower(F.col(declared_column))
    model = fit(docs, declared, F.col(text_column), F.col(key_column))
    shared = spark.sparkContext.broadcast(model)
    names = model.languages
    n = len(names)
    text, said, host, suffix, prior, evidence = (
        free_name(docs, x) for x in ("_text", "_said", "_host", "_suffix", "_prior", "_evidence")
    )
    keyed = docs.withColumn(text, F.col(text_column)).withColumn(said, F.coalesce(declared, F.lit("")))
    keyed = keyed.withColumn(host, host_of(F.col(address_column)))

    # What texts alone say, counted by host and by declared language.
    def verdict(part: pa.RecordBatch) -> pa.RecordBatch:
        best = shared.value.log_text(part.column("text")).argmax(1)
        best[letterless(part.column("text"))] = n - 1
        return pa.RecordBatch.from_arrays(
            [part.column("host"), part.column("said"), pa.array(best, pa.int32())], names=["host", "said", "best"]
        )

    plain = keyed.select(F.col(text).alias("text"), F.col(host).alias("host"), F.col(said).alias("said"))
    counts = durable(
        plain.mapInArrow(A.over_texts(verdict), "host string, said string, best int")
        .groupBy("host", "said", "best")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    pairs = counts.groupBy("said", "best").agg(F.sum("n").alias("n"))
    by_best = np.full(n, 1.0)
    for r in pairs.groupBy("best").agg(F.sum("n").alias("n")).collect():
        by_best[r["best"]] += r["n"]
    total = float(by_best.sum() - n)
    slots = [F.coalesce(F.sum(F.when(F.col("best") == i, F.col("n"))), F.lit(0)).cast("double") for i in range(n)]
    # P(declared | language) for every declared value; each language has one row more, which
    # declares what all rows do. Nothing is known of what unknown languages declare: as the
    # others do on average.
    by_said = pairs.groupBy("said").agg(F.sum("n").alias("n"), F.array(*slots).alias("c"))
    rows_of = F.array(*map(F.lit, by_best[:-1].tolist())) if n > 1 else None
    if n > 1:
        rate = F.zip_with(F.slice("c", 1, n - 1), rows_of, lambda c, b: (c + F.col("n") / F.lit(total)) / b)
        by_said = by_said.withColumn("rate", rate)
        mean = F.aggregate(F.zip_with("rate", rows_of, lambda p, b: p * b), F.lit(0.0), lambda a, b: a + b)
        line = F.transform(F.concat("rate", F.array(mean / float(by_best[:-1].sum()))), lambda p: F.log(p))
    else:
        line = F.array(F.lit(0.0))
    lines = durable(by_said.select(F.col("said").alias(said), "n", line.alias(evidence)))
    overall = by_best / by_best.sum()
    overall[-1] = UNKNOWN_SHARE

    by_host = counts.groupBy("host").agg(F.sum("n").alias("n"), F.array(*slots).alias("c"))
    by_host = by_host.withColumn("suffix", suffix_of(F.col("host")))
    by_suffix = by_host.groupBy("suffix").agg(
        F.sum("n").alias("sn"), F.array(*(F.sum(F.get("c", F.lit(i))) for i in range(n))).alias("sc")
    )

    def smoothed(count: Column, size: Column, wider: Column | list[float]) -> Column:
        wide = F.array(*map(F.lit, wider)) if isinstance(wider, list) else wider
        return F.zip_with(count, wide, lambda c, w: (c + SMOOTHING * w) / (size + SMOOTHING))

    wider = by_suffix.select("suffix", smoothed(F.col("sc"), F.col("sn"), overall.tolist()).alias("wide"))
    # Suffixes are many at most as hosts are; large ones are few, so the hosts are split by AQE.
    priors = durable(
        by_host.join(wider, "suffix").select(
            F.col("host").alias(host),
            "n",
            F.transform(smoothed(F.col("c"), F.col("n"), F.col("wide")), lambda p: F.log(p)).alias(prior),
        )
    )
    fused = _looked_up(_looked_up(keyed, priors, host, prior), lines, said, evidence)

    language, confidence, kept = (free_name(docs, x) for x in ("language", "confidence", "kept"))
    schema = T.StructType(
        [
            *docs.schema.fields,
            T.StructField(language, T.StringType()),
            T.StructField(confidence, T.DoubleType()),
            T.StructField(kept, T.BooleanType()),
        ]
    )
    given, out_names = docs.columns, [f.name for f in schema]

    def decide(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column(text)
        log = shared.value.log_text(texts)
        for known in (part.column(prior), part.column(evidence)):
            log += known.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
        log -= log.max(1, keepdims=True)
        p = np.exp(log)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        sure = p[np.arange(len(best)), best]
        none = letterless(texts)
        best[none], sure[none] = n - 1, 0.0
        columns = [part.column(c) for c in given]
        columns += [
            pa.array([names[i] for i in best], pa.string()),
            pa.array(sure, pa.float64()),
            pa.array((best != n - 1) & (sure >= min_confidence)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=out_names)

    return fused.select(*docs.columns, text, prior, evidence).mapInArrow(A.over_texts(decide, text), schema)

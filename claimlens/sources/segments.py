"""Evidence that grows: immutable segments, a log of which are live, merged when read.

A segment has the evidence of one append and the document frequencies of its words. The
log says which segments were added and taken out by which version, and how many documents
each has; a version is one folder, which only one writer can create. Frequencies are sums
over the live segments, so words weigh as if all evidence had been indexed at once, and an
append reads nothing but its own rows. `compact` puts small segments together.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from claimlens import schemas as S
from claimlens.operators import retrieve as R
from claimlens.operators.encode import Lexicon, distinct_tokens, encode, frequencies
from claimlens.session import drop_path, durable

# Segments of fewer documents than this are put together by `compact`.
SMALL_SEGMENT = 1_000_000
_LOG = "segment string, n_docs long, live boolean, version long"
_WORDS = "token string, df long"


def _log(spark: SparkSession, path: str) -> DataFrame:
    """(segment, n_docs, live, version): what every version added or took out."""
    try:
        return spark.read.schema(_LOG).parquet(f"{path}/log")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LOG)


def live_segments(spark: SparkSession, path: str) -> dict[str, int]:
    """Documents of each live segment. `compact` keeps their number small."""
    last = _log(spark, path).groupBy("segment").agg(F.max_by(F.struct("n_docs", "live"), "version").alias("s"))
    return {r["segment"]: r["s"]["n_docs"] for r in last.where("s.live").orderBy("segment").collect()}


def _commit(spark: SparkSession, path: str, changes: list[tuple[str, int, bool]]) -> None:
    """Add a version; a writer that came first makes this one fail, and nothing changes."""
    version = (_log(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    rows = spark.createDataFrame(changes, "segment string, n_docs long, live boolean").coalesce(1)
    rows.write.mode("errorifexists").parquet(f"{path}/log/version={version}")


def _store(evidence: DataFrame, words: Callable[[DataFrame], DataFrame], path: str) -> tuple[str, int]:
    """Write a segment under a new name: (name, documents)."""
    spark, name = evidence.sparkSession, uuid.uuid4().hex
    folder = f"{path}/segments/{name}"
    evidence.select("evidence_id", "text", "source_url").write.parquet(f"{folder}/evidence")
    stored = spark.read.schema(S.EVIDENCE).parquet(f"{folder}/evidence")
    words(stored).write.parquet(f"{folder}/words")
    return name, stored.count()


def append(evidence: DataFrame, path: str) -> str:
    """Add evidence(evidence_id, text, source_url) as a segment; ids must be new."""
    name, n = _store(evidence, lambda rows: frequencies(distinct_tokens(rows, "evidence_id", "text")), path)
    _commit(evidence.sparkSession, path, [(name, n, True)])
    return name


def _evidence(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    if not names:
        return spark.createDataFrame([], S.EVIDENCE)
    return spark.read.schema(S.EVIDENCE).parquet(*[f"{path}/segments/{n}/evidence" for n in names])


def _words(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    if not names:
        return spark.createDataFrame([], _WORDS)
    rows = spark.read.schema(_WORDS).parquet(*[f"{path}/segments/{n}/words" for n in names])
    return rows.groupBy("token").agg(F.sum("df").alias("df"))


def compact(spark: SparkSession, path: str, small: int = SMALL_SEGMENT) -> str | None:
    """Put the small segments together; their files stay for readers until `vacuum`."""
    old = {name: n for name, n in live_segments(spark, path).items() if n < small}
    if len(old) < 2:
        return None
    names = list(old)
    name, n = _store(_evidence(spark, path, names), lambda _: _words(spark, path, names), path)
    _commit(spark, path, [(name, n, True), *[(o, c, False) for o, c in old.items()]])
    return name


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the segments that are no longer live; for when no reader is left on them."""
    live = live_segments(spark, path)
    gone = [r["segment"] for r in _log(spark, path).select("segment").distinct().collect() if r["segment"] not in live]
    for name in gone:
        drop_path(spark, f"{path}/segments/{name}")
    return len(gone)


def read(spark: SparkSession, path: str) -> R.Corpus:
    """The corpus of all live segments; a path without any is a corpus without evidence."""
    segments = live_segments(spark, path)
    evidence = _evidence(spark, path, list(segments))
    lex = Lexicon(durable(_words(spark, path, list(segments))), sum(segments.values()))
    return R.Corpus(evidence, encode(evidence, "evidence_id", "text", lex), lex)

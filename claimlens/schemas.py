"""Explicit schemas for every table the engine reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


STRING, LONG, DOUBLE, TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()

EVIDENCE = _struct(evidence_id=LONG, text=STRING, source_url=STRING)
CLAIMS_RAW = _struct(label=STRING, statement=STRING, source=STRING)
CLAIMS_LABELED = _struct(text=STRING, label=STRING, source=STRING)
CLAIMS = _struct(claim_id=LONG, text=STRING)
CLAIM_STREAM = _struct(id=LONG, text=STRING, label=STRING, timestamp=TS, platform=STRING)
VECTORS = _struct(
    evidence_id=LONG, text=STRING, source_url=STRING, embedding=T.ArrayType(T.FloatType())
)
ARTICLES = _struct(article_id=LONG, title=STRING, body=STRING)
NEWS = _struct(
    article_id=LONG, title=STRING, description=STRING, content=STRING, url=STRING, lang=STRING
)
MODEL_OUTPUTS = _struct(claim_id=LONG, raw_output=STRING)
BATCHES = _struct(run_id=STRING, batch_seq=LONG, n_rows=LONG, started_at=TS, finished_at=TS)
HISTORY = _struct(
    seq=LONG, claim_id=LONG, preview=STRING, label=STRING, confidence=DOUBLE, status=STRING
)

HIT = _struct(source=STRING, text=STRING, score=DOUBLE)
EVIDENCE_LIST = T.ArrayType(HIT)
VERDICT = _struct(
    label=STRING,
    confidence=DOUBLE,
    explanation=STRING,
    counterfactual=STRING,
    reasoning=T.ArrayType(STRING),
)
ANALYSIS = _struct(
    claim_id=LONG,
    text=STRING,
    label=STRING,
    confidence=DOUBLE,
    explanation=STRING,
    counterfactual=STRING,
    reasoning=T.ArrayType(STRING),
    status=STRING,
    evidence=EVIDENCE_LIST,
)

"""Claims in, verdicts out: the whole pipeline over a table of claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimlens import schemas as S
from claimlens.functions import text as X
from claimlens.functions import verdict as V
from claimlens.functions.formatting import status_line, two_decimals
from claimlens.operators import retrieve as R
from claimlens.operators.generate import Generator
from claimlens.session import durable

# Depth of the pipeline's retrieval and the verdicts of the early exits.
PIPELINE_K = 6
EMPTY_INPUT = ("Uncertain", 0.0, "Empty input.")
NO_GENERATOR = ("Uncertain", 0.5, "Generator not available.")
NO_OUTPUT = ("Uncertain", 0.5, "No output")
STATUS_EMPTY = "No input provided."
STATUS_SKIPPED = "Skipped (no generator)"


def attach_evidence(claims: DataFrame, corpus: R.Corpus | None, k: int = PIPELINE_K) -> DataFrame:
    """Add `evidence`, the ranked hits of every claim; [] for blank claims and claims without hits.

    Equal texts are looked up once, under the smallest id among them. Claims find their
    text's hits by a digest, so that no text is shuffled; blank ones take no part in that.
    """
    none = F.array().cast(S.EVIDENCE_LIST)
    if corpus is None:
        return claims.withColumn("evidence", none)
    blank, digest = X.is_blank(F.col("text")), F.unhex(F.sha2("text", 256)).alias("_digest")
    asked = claims.where(~blank).select("*", digest)
    distinct = durable(
        asked.groupBy("_digest").agg(F.min("claim_id").alias("claim_id"), F.first("text").alias("text"))
    )
    hits = R.as_list(R.retrieve(distinct.select("claim_id", "text"), corpus, k))
    found = distinct.select("_digest", "claim_id").join(hits, "claim_id").select("_digest", "evidence")
    joined = asked.join(found, "_digest", "left")
    return joined.select(*claims.columns, F.coalesce("evidence", none).alias("evidence")).unionByName(
        claims.where(blank).withColumn("evidence", none)
    )


def analyze(
    claims: DataFrame,
    corpus: R.Corpus | None,
    generator: Generator | None,
    k: int = PIPELINE_K,
    updates: int = 1,
    with_counted: bool = False,
    trim_input: bool = True,
) -> DataFrame:
    """One row per claim: verdict, status and evidence (schema `ANALYSIS`).

    Claims are trimmed at both ends first, as typed input is; inner whitespace stays.
    `updates` is the number of this batch in its run and shows in the status.
    """
    if trim_input:
        claims = claims.withColumn("text", X.strip(F.col("text")))
    rows = attach_evidence(claims, corpus, k)
    rows = rows.withColumn("_texts", V.evidence_texts(F.col("evidence")))
    rows = rows.withColumn("prompt", V.prompt(F.col("text"), F.col("_texts")))
    blank = X.is_blank(F.col("text"))
    empty = V.literal_verdict(*EMPTY_INPUT)
    if generator is None:
        rows = rows.withColumn(
            "v", F.when(blank, empty).otherwise(V.literal_verdict(*NO_GENERATOR))
        )
        status = F.lit(STATUS_SKIPPED)
        counted = F.lit(False)
    else:
        rows = V.with_parsed_output(generator(rows), "raw_output", "_parsed")
        rows = V.with_evidence_rules(rows, "_parsed", "text", "_texts", "_ruled")
        failed = V.literal_verdict("Uncertain", 0.5, F.col("error"))
        rows = rows.withColumn(
            "v",
            F.when(blank, empty)
            .when(F.col("error").isNotNull(), failed)
            .when(F.col("raw_output").isNull(), V.literal_verdict(*NO_OUTPUT))
            .otherwise(F.col("_ruled")),
        )
        status = status_line(F.lit(updates))
        counted = ~blank
    out = rows.select(
        "claim_id",
        "text",
        "v.*",
        F.when(blank, F.lit(STATUS_EMPTY)).otherwise(status).alias("status"),
        "evidence",
        counted.alias("counted"),
    )
    return out if with_counted else out.drop("counted")


def report(analysis: DataFrame) -> DataFrame:
    """What a reader sees of a verdict: defaults filled in, confidence with two decimals."""

    def text_or(col, default=""):
        return F.coalesce(F.col(col), F.lit(default))

    counterfactual = text_or("counterfactual")
    return analysis.select(
        "claim_id",
        text_or("label", "Uncertain").alias("label"),
        two_decimals(F.coalesce("confidence", F.lit(0.0))).alias("confidence"),
        text_or("explanation").alias("explanation"),
        F.when(counterfactual == "", "—").otherwise(counterfactual).alias("counterfactual"),
        text_or("status").alias("status"),
        F.size(F.coalesce("evidence", F.array().cast(S.EVIDENCE_LIST))).alias("n_evidence"),
    )

"""Score the pipeline on labelled claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimlens.operators import metrics as M
from claimlens.operators.generate import Generator
from claimlens.operators.retrieve import Corpus
from claimlens.plans.analyze import analyze


def evaluate(labeled: DataFrame, corpus: Corpus | None, generator: Generator | None) -> DataFrame:
    """Macro precision, recall and F1 over (claim_id, text, label) in one job."""
    gold = labeled.select("claim_id", F.col("label").alias("gold"))
    result = analyze(labeled.select("claim_id", "text"), corpus, generator)
    none = F.lit(None).cast("string")
    predictions = result.select(
        "claim_id", "label", none.alias("predicted_label"), none.alias("raw_output")
    )
    pairs = M.predicted_labels(predictions).join(gold, "claim_id")
    return M.macro_prf(M.confusion(pairs))

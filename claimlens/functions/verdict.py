"""Prompt, parameter defaults, output parsing and evidence rules as expressions."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from claimlens import schemas as S
from claimlens.functions.text import contains_any, strip

# Prompt size, text used without evidence, default label and confidences.
PROMPT_TEXTS = 5
NO_EVIDENCE = "No relevant evidence found."
UNCERTAIN = "Uncertain"
JSON_CONFIDENCE, KEYWORD_CONFIDENCE, FALLBACK_CONFIDENCE = 0.6, 0.8, 0.5
# Prompt wording around the claim and the evidence.
PROMPT_HEAD = "You are a fact verification model.\nClaim: "
PROMPT_MIDDLE = "\n\nEvidence:\n"
PROMPT_TAIL = (
    "\n\nDecide whether the claim is True, Fake, or Uncertain based only on the evidence. "
    "Then explain briefly why and give a counterfactual — what would make the claim true. "
    "Respond ONLY in JSON format with keys: label, confidence, explanation, counterfactual."
)
_FIELDS = ("label", "confidence", "explanation", "counterfactual", "reasoning")
# Decoding defaults.
PARAM_DEFAULTS = {
    "max_length": 256.0,
    "temperature": 0.7,
    "num_beams": 4.0,
    "repetition_penalty": 1.2,
}
# Evidence wording and the verdict it leads to.
REFUTING = ("anti-scientific", "not true", "false", "hoax", "conspiracy", "debunked")
REFUTED_EXPLANATION = "Evidence indicates the claim contradicts scientific consensus."
REFUTED_COUNTERFACTUAL = "If verified empirical data supported the claim, it could be true."
CONSENSUS, CONSENSUS_CLAIM = "scientific consensus", "flat"
CONSENSUS_EXPLANATION = "Scientific consensus confirms Earth is spherical, not flat."
CONSENSUS_COUNTERFACTUAL = (
    "If all scientific and satellite data were falsified, the claim might appear true."
)
CONFIRMING = ("confirm", "proves")
DOUBTING = ("no evidence", "unclear")

def evidence_texts(evidence: Column) -> Column:
    """Texts of the hits, without null or empty ones, in rank order."""
    return F.filter(F.transform(evidence, lambda h: h["text"]), lambda t: t.isNotNull() & (t != ""))


def prompt(claim: Column, texts: Column) -> Column:
    context = F.when(F.size(texts) == 0, F.lit(NO_EVIDENCE)).otherwise(
        F.array_join(F.slice(texts, 1, PROMPT_TEXTS), " ")
    )
    return F.concat(F.lit(PROMPT_HEAD), claim, F.lit(PROMPT_MIDDLE), context, F.lit(PROMPT_TAIL))


def resolved_params(params: Column, defaults: dict[str, float] | None = None) -> dict[str, Column]:
    """One column per parameter: the given value or the default of its key."""
    return {
        name: F.coalesce(F.try_element_at(params, F.lit(name)), F.lit(value))
        for name, value in (defaults or PARAM_DEFAULTS).items()
    }


def _verdict(label, confidence, explanation, counterfactual, reasoning) -> Column:
    return F.struct(
        label.cast("string").alias("label"),
        confidence.cast("double").alias("confidence"),
        explanation.cast("string").alias("explanation"),
        counterfactual.cast("string").alias("counterfactual"),
        reasoning.cast("array<string>").alias("reasoning"),
    )


def literal_verdict(label: str, confidence: float, explanation: Column | str) -> Column:
    """A fixed verdict whose other fields are unknown."""
    exp = F.lit(explanation) if isinstance(explanation, str) else explanation
    return _verdict(F.lit(label), F.lit(confidence), exp, F.lit(None), F.lit(None))


def _text_of(value) -> str | None:
    """A JSON value as text: strings as they are, others as JSON."""
    if value is None:
        return None
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    # An escaped half of a character has no UTF-8.
    return text.encode("utf-8", "replace").decode()


def _json_row(text: str | None) -> tuple:
    """(ok, label, confidence, explanation, counterfactual, reasoning) of one JSON text."""
    if text is None:
        return (None,) * 6
    try:
        doc = json.loads(text)
        confidence = float(doc.get("confidence", JSON_CONFIDENCE))
        steps = doc.get("reasoning", [])
        if steps is not None and not isinstance(steps, list):
            steps = [steps]
        reasoning = None if steps is None else [_text_of(s) for s in steps]
        fields = (doc.get("label", UNCERTAIN), doc.get("explanation", ""), doc.get("counterfactual", ""))
        label, explanation, counterfactual = (_text_of(f) for f in fields)
    except (ValueError, TypeError, OverflowError, RecursionError):
        return (False, *(None,) * 5)
    return True, label, confidence, explanation, counterfactual, reasoning


_JSON_TYPE = T.StructType([T.StructField("ok", T.BooleanType()), *S.VERDICT.fields])


@F.arrow_udf(_JSON_TYPE)
def json_verdict(texts: pa.Array) -> pa.Array:
    """The strict parser, a batch of texts at a time.

    No built-in function tells all of what counts here: content behind the object, numbers in
    quotes with any digits, NaN and infinities, the last of repeated keys.
    """
    types = (pa.bool_(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.list_(pa.string()))
    rows = [_json_row(t) for t in texts.to_pylist()]
    columns = zip(*rows) if rows else [[]] * len(types)
    arrays = [pa.array(c, type=t) for c, t in zip(columns, types)]
    return pa.StructArray.from_arrays(arrays, _JSON_TYPE.names)


def with_parsed_output(df: DataFrame, raw: str = "raw_output", out: str = "verdict") -> DataFrame:
    """Model text to a verdict struct.

    Text that opens with a brace is JSON: a key that is absent takes its default, a
    key that is present keeps its value, null included. A confidence that is not a
    number, or text that is not one JSON object, gives the fallback verdict. A reason that is
    no list is a list of one. Other text is judged by keywords.
    """
    t = F.col(raw)
    df = df.withColumn("_text", strip(t)).withColumn(
        "_json", F.startswith(F.col("_text"), F.lit("{"))
    )
    # Only what looks like JSON is sent to the parser.
    df = df.withColumn("_p", json_verdict(F.when(F.col("_json"), t)))
    none = F.array().cast("array<string>")
    low = F.lower(t)
    keyword = (
        F.when(contains_any(low, ("not true", "false")), "Fake")
        .when(F.contains(low, F.lit("true")), "True")
        .otherwise(UNCERTAIN)
    )
    fallback = _verdict(
        F.lit(UNCERTAIN), F.lit(FALLBACK_CONFIDENCE), F.col("_text"), F.lit(""), none
    )
    verdict = (
        F.when(t.isNull(), F.lit(None))
        .when(
            ~F.col("_json"),
            _verdict(
                keyword,
                F.when(keyword != UNCERTAIN, KEYWORD_CONFIDENCE).otherwise(FALLBACK_CONFIDENCE),
                F.col("_text"),
                F.lit(""),
                none,
            ),
        )
        .when(F.col("_p.ok"), _verdict(*[F.col(f"_p.{c}") for c in _FIELDS]))
        .otherwise(fallback)
    )
    return df.withColumn(out, verdict).drop("_text", "_json", "_p")


def with_evidence_rules(
    df: DataFrame, verdict: str, claim: str, texts: str, out: str | None = None
) -> DataFrame:
    """Correct a verdict by the wording of all its evidence; the first rule that fits wins."""
    v, old = F.col(verdict), F.col(f"{verdict}.confidence")
    df = df.withColumn("_e", F.lower(F.array_join(F.col(texts), " "))).withColumn(
        "_c", F.lower(F.col(claim))
    )
    e, c = F.col("_e"), F.col("_c")
    keep = (v["explanation"], v["counterfactual"], v["reasoning"])
    ruled = (
        F.when(
            contains_any(e, REFUTING),
            _verdict(
                F.lit("Fake"),
                F.greatest(F.coalesce(old, F.lit(0.7)), F.lit(0.9)),
                F.lit(REFUTED_EXPLANATION),
                F.lit(REFUTED_COUNTERFACTUAL),
                v["reasoning"],
            ),
        )
        .when(
            F.contains(e, F.lit(CONSENSUS)) & F.contains(c, F.lit(CONSENSUS_CLAIM)),
            _verdict(
                F.lit("Fake"),
                F.lit(0.95),
                F.lit(CONSENSUS_EXPLANATION),
                F.lit(CONSENSUS_COUNTERFACTUAL),
                v["reasoning"],
            ),
        )
        .when(contains_any(e, CONFIRMING), _verdict(F.lit("True"), F.lit(0.9), *keep))
        .when(contains_any(e, DOUBTING), _verdict(F.lit(UNCERTAIN), F.lit(0.6), *keep))
        .otherwise(v)
    )
    return df.withColumn(out or verdict, ruled).drop("_e", "_c")


def evaluated_label(label: Column, predicted: Column, raw: Column) -> Column:
    """The label of a prediction: given, predicted, or by keyword in its raw text."""
    low = F.lower(raw)
    by_text = (
        F.when(F.contains(low, F.lit("fake")), "Fake")
        .when(F.contains(low, F.lit("true")), "True")
        .otherwise(UNCERTAIN)
    )
    return F.coalesce(label, predicted, by_text)

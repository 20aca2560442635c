"""Generator contract: claims with prompts in, the same claims with raw output out.

A generator takes (claim_id, text, prompt, ...) and adds `raw_output` (null: nothing
came back) and `error` (null unless the row failed).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from claimlens.functions.verdict import PARAM_DEFAULTS

Generator = Callable[[DataFrame], DataFrame]
# A loaded model: prompts and decoding parameters in, one output (or None) per prompt out.
Model = Callable[[list[str], dict], list]


def precomputed(outputs: DataFrame) -> Generator:
    """Outputs of an earlier inference run, one row (claim_id, raw_output) per claim."""

    def run(df: DataFrame) -> DataFrame:
        one = outputs.select("claim_id", "raw_output")
        return df.join(one, "claim_id", "left").withColumn("error", F.lit(None).cast("string"))

    return run


def _answers(call: Model, prompts: list[str], params: dict) -> tuple[list, list]:
    """(outputs, errors) of a batch; when it fails, each prompt is tried by itself."""
    try:
        raws = list(call(prompts, params))
        if len(raws) != len(prompts):
            raise ValueError(f"{len(raws)} outputs for {len(prompts)} prompts")
        return raws, [None] * len(raws)
    except Exception as e:
        if len(prompts) == 1:
            return [None], [str(e)]
    each = [_answers(call, [p], params) for p in prompts]
    return [r[0] for r, _ in each], [e[0] for _, e in each]


def model(load: Callable[[], Model], params: dict | None = None, batch_rows: int = 64) -> Generator:
    """A model called with up to `batch_rows` prompts at once; it is loaded once per task.

    Decoding parameters that are not given, or null, take their defaults. Other columns
    pass through untouched. A row that fails keeps its claim and carries the message, so no
    job dies of one text.
    """
    given = {name: value for name, value in (params or {}).items() if value is not None}
    resolved = {**PARAM_DEFAULTS, **given}

    def run(df: DataFrame) -> DataFrame:
        schema = T.StructType(
            [
                *df.schema.fields,
                T.StructField("raw_output", T.StringType()),
                T.StructField("error", T.StringType()),
            ]
        )

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            call = load()
            for whole in batches:
                for at in range(0, whole.num_rows, batch_rows):
                    b = whole.slice(at, batch_rows)
                    raws, errors = _answers(call, b.column("prompt").to_pylist(), resolved)
                    yield pa.RecordBatch.from_arrays(
                        [*b.columns, pa.array(raws, pa.string()), pa.array(errors, pa.string())],
                        names=[*b.schema.names, "raw_output", "error"],
                    )

        return df.mapInArrow(task, schema)

    return run

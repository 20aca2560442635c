"""Fill-in-middle: texts rearranged so that a model learns to fill the gap.

A text is cut twice, between units (runs of ASCII letters, or single other characters), at
ranks drawn from a hash of its id. A learned rank index over all its unit boundaries tells
the offset of both cuts (`ranks`). Everything else is column expressions: the form, the
rearranged text and, from that text and the form alone, the original.

Nothing is shuffled. Memory is bounded by the step of `arrays.by_bytes` or by one text, if
that is longer.

Defined results: a null text is empty; an empty text, or one that holds a marker, stays
plain; a null id is hashed as an empty string; repeated rows give repeated results; equal
cuts give an empty middle; an empty table gives an empty one; other input columns are not
passed on, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from claimlens.llm import arrays as A
from claimlens.llm import ranks

# The markers, and the shares of plain texts and of the suffix-first form in percent.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
PLAIN, PSM, SPM = "plain", "psm", "spm"


def draws(id_column: str, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers from a hash of the id."""
    line = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    hexed = F.sha2(line, 256)
    return [F.conv(F.substring(hexed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def cuts(docs: DataFrame, id_column: str, text_column: str, seed: int = 1) -> DataFrame:
    """(id, text, n, low, high): units of each text and the offsets of its two cuts."""
    h1, h2, _, _ = draws(id_column, seed)
    rows = docs.select(
        F.col(id_column).alias("id"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
        h1.alias("h1"),
        h2.alias("h2"),
    )
    schema = T.StructType([rows.schema["id"], rows.schema["text"]])
    for name in ("n", "low", "high"):
        schema.add(name, T.LongType())

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        index = ranks.build(part.column("text"))
        n, text = index.units(), np.arange(part.num_rows)
        a, b = (part.column(h).to_numpy() % (n + 1) for h in ("h1", "h2"))
        found = (n, index.offsets(text, np.minimum(a, b)), index.offsets(text, np.maximum(a, b)))
        return pa.RecordBatch.from_arrays(
            [part.column("id"), part.column("text"), *(pa.array(c, pa.int64()) for c in found)],
            names=schema.names,
        )

    return rows.mapInArrow(A.over_texts(kernel), schema)


def _marked(text: Column) -> Column:
    return F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))


def transform(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = 1
) -> DataFrame:
    """(id, text, n, form, prefix_chars, middle_chars, output) for every row; text is never null."""
    rows = cuts(docs, id_column, text_column, seed)
    text, low, high = F.col("text"), F.col("low").cast("int"), F.col("high").cast("int")
    _, _, h3, h4 = draws("id", seed)
    plain = (text == "") | _marked(text) | (F.pmod(h3, F.lit(100)) >= PLAIN_FROM)
    form = F.when(plain, PLAIN).when(F.pmod(h4, F.lit(100)) < SPM_BELOW, SPM).otherwise(PSM)
    prefix, middle = F.substring(text, F.lit(1), low), F.substring(text, low + 1, high - low)
    suffix = F.substring(text, high + 1, F.length(text))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    rows = rows.withColumn("form", form)
    split = F.col("form") != PLAIN
    return rows.select(
        F.col("id").alias(id_column),
        text.alias("text"),
        "n",
        "form",
        F.when(split, F.col("low")).alias("prefix_chars"),
        F.when(split, F.col("high") - F.col("low")).alias("middle_chars"),
        F.when(F.col("form") == PSM, psm).when(split, spm).otherwise(text).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The original text, from the rearranged one and its form; markers occur once each."""
    p, s, m = (F.position(F.lit(mark), output) for mark in (PREFIX, SUFFIX, MIDDLE))
    tail = F.substring(output, m + 3, F.length(output))
    psm = F.concat(F.substring(output, F.lit(4), s - 4), tail, F.substring(output, s + 3, m - s - 3))
    spm = F.concat(F.substring(output, p + 3, m - p - 3), tail, F.substring(output, F.lit(4), p - 4))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)

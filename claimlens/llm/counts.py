"""Token counts of texts by rank-synchronous merging of arrays.

The pre-tokens of an Arrow part are held as one ragged numpy array of symbols; every round
applies each sequence's lowest-rank pair, and the symbols that survive are counted. Equal
pre-tokens of a part are merged once. Nothing is shuffled; memory is bounded by the step of
`arrays.by_bytes` or by one text, if that is longer, and no table grows with the input.

Special strings inside a text are one token each, as is the library's default; no begin,
end or other special token is added.

Defined results: a null text is empty, with no bytes and no tokens; repeated rows give
repeated results; an empty table gives an empty one; a text at the limit is not over it;
input columns other than the id and the text are not passed on, so names cannot clash.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from claimlens.llm import arrays as A
from claimlens.llm import bpe

# A text of more tokens than this is over the limit.
LIMIT = 1_024


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    limit: int = LIMIT,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row.

    The tokenizer file must be at the same path on every machine.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    schema = T.StructType(
        [
            T.StructField("id", rows.schema["id"].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
        ]
    )

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        found = bpe.load(tokenizer_path).tokens(part.column("text"))
        columns = [pa.array(c, pa.int64()) for c in (found.n_bytes(), found.counts())]
        return pa.RecordBatch.from_arrays([part.column("id"), *columns], names=schema.names)

    return rows.mapInArrow(A.over_texts(kernel), schema).select(
        F.col("id").alias(id_column),
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )

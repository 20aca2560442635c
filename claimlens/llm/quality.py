"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Inputs of a text are the shares of its hashed words, structure statistics in buckets (a
bucket is one input) and the length as metadata. A score is
    w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2),
so pairwise interactions cost time linear in the number of inputs. The machine is fitted
by AdaGrad on a bounded sample of labelled rows (`SAMPLE_ROWS`) on the driver; scoring
is one pass over the texts with the weights broadcast (their size is fixed).

Defined results: null and empty texts get the score of an input without words; repeated
rows give repeated results; an empty table gives an empty one; without labelled rows
every score is 1/2; other input columns are not passed on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from claimlens.llm import arrays as A
from claimlens.llm.labelled import labelled_sample

SAMPLE_ROWS = 6_000
WORD_INPUTS = 1 << 15
RANK = 6
BUCKETS = 12
EPOCHS = 12
# Labels are learnt from the other folds of the id.
MODULUS, HELD_OUT = 5, 0
THRESHOLD = 0.3

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_MARK = np.array([33 <= i < 127 and not chr(i).isalnum() for i in range(256)])
N_STATS = 10


def structure(w: A.Words) -> np.ndarray:
    """Statistics of each text: shares of kinds of characters, repetition, sizes."""
    n_words = w.counts()
    size = np.diff(w.offsets)
    some, words_ = np.maximum(size, 1), np.maximum(n_words, 1)

    def share(kind: np.ndarray) -> np.ndarray:
        return A.spread_sum(kind.astype(np.int64), w.offsets) / some

    text = w.text_of()
    pair, _ = np.unique(np.stack([text, w.hash.view(np.int64)]), axis=1, return_counts=True) if len(
        text
    ) else (np.zeros((2, 0), np.int64), None)
    different = np.bincount(pair[0], minlength=len(n_words))
    same_as_last = np.zeros(len(w.hash), dtype=np.int64)
    same_as_last[1:] = (w.hash[1:] == w.hash[:-1]) & (text[1:] == text[:-1])
    lines = A.spread_sum((w.data == 10).astype(np.int64), w.offsets) + 1
    word_bytes = A.spread_sum(w.end - w.start, w.ptr)
    return np.stack(
        [
            share(_UPPER[w.data]),
            share(_DIGIT[w.data]),
            share(_MARK[w.data]),
            share(w.data >= 128),
            different / words_,
            A.spread_sum(same_as_last, w.ptr) / words_,
            word_bytes / words_,
            np.log1p(n_words / lines),
            np.log1p(n_words),
            np.log1p(size),
        ],
        axis=1,
    )


def inputs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, word input, share) triples and the statistics of each text."""
    w = A.words(texts)
    text, feature, count = A.distinct(w.text_of(), (w.hash % np.uint64(WORD_INPUTS)).astype(np.int64), WORD_INPUTS)
    return text, feature, count / np.maximum(w.counts(), 1)[text], structure(w)


@dataclass
class Machine:
    """Weights of all inputs: hashed words, then the buckets of each statistic."""

    edges: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def all_inputs(self, text, feature, share, stats):
        """The triples of words and of buckets together, in order of text."""
        n = len(stats)
        bucket = np.stack(
            [np.searchsorted(self.edges[:, s], stats[:, s], side="right") for s in range(N_STATS)], axis=1
        )
        column = WORD_INPUTS + np.arange(N_STATS) * BUCKETS + bucket
        # Words together weigh as much as one bucket, and so do all buckets.
        all_text = np.concatenate([text, np.repeat(np.arange(n), N_STATS)])
        all_feature = np.concatenate([feature, column.ravel()])
        value = np.concatenate([share, np.full(n * N_STATS, 1.0)])
        by = np.argsort(all_text, kind="stable")
        return all_text[by], all_feature[by], value[by]

    def raw(self, text, feature, value, n: int):
        """Scores before the logistic function, and the sums the gradient needs."""
        ptr = np.searchsorted(text, np.arange(n + 1))
        line = A.spread_sum(self.linear[feature] * value, ptr)
        vx = self.factors[feature] * value[:, None]
        total = A.spread_sum(vx, ptr)
        pair = 0.5 * ((total**2).sum(1) - A.spread_sum((vx**2).sum(1), ptr))
        return self.bias + line + pair, total

    def score(self, texts: pa.Array) -> np.ndarray:
        triples = inputs(texts)
        raw, _ = self.raw(*self.all_inputs(*triples), len(texts))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(parts: list[tuple], labels: np.ndarray, seed: int = 7) -> Machine:
    """AdaGrad on logistic loss. parts: `inputs` of runs of the labelled texts, in order."""
    rng = np.random.default_rng(seed)
    n_inputs = WORD_INPUTS + N_STATS * BUCKETS
    machine = Machine(np.zeros((BUCKETS - 1, N_STATS)), 0.0, np.zeros(n_inputs), np.zeros((n_inputs, RANK)))
    if not len(labels) or labels.min() == labels.max():
        if len(labels):
            machine.bias = float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
        return machine
    stats = np.concatenate([p[3] for p in parts])
    machine.edges = np.quantile(stats, np.linspace(0, 1, BUCKETS + 1)[1:-1], axis=0)
    machine.factors = rng.normal(0, 0.01, (n_inputs, RANK))
    at = np.cumsum([0] + [len(p[3]) for p in parts])
    text = np.concatenate([p[0] + a for p, a in zip(parts, at)])
    triples = machine.all_inputs(
        text, np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]), stats
    )
    text, feature, value = triples
    ptr = np.searchsorted(text, np.arange(len(labels) + 1))
    g_bias, g_line, g_fact = 1e-6, np.full(n_inputs, 1e-6), np.full((n_inputs, RANK), 1e-6)
    rate, penalty = 0.1, 1e-4
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for some in np.array_split(order, max(1, len(order) // 64)):
            rows = np.concatenate([np.arange(ptr[i], ptr[i + 1]) for i in some])
            t = np.repeat(np.arange(len(some)), ptr[some + 1] - ptr[some])
            f, x = feature[rows], value[rows]
            raw, total = machine.raw(t, f, x, len(some))
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[some]) / len(some)
            e = error[t]
            used, inverse = np.unique(f, return_inverse=True)
            line = np.bincount(inverse, e * x, len(used)) + penalty * machine.linear[used]
            v = machine.factors[f]
            slope = (e * x)[:, None] * (total[t] - v * x[:, None])
            fact = np.stack([np.bincount(inverse, slope[:, r], len(used)) for r in range(RANK)], axis=1)
            fact += penalty * machine.factors[used]
            b = error.sum()
            g_bias += b * b
            g_line[used] += line**2
            g_fact[used] += fact**2
            machine.bias -= rate * b / np.sqrt(g_bias)
            machine.linear[used] -= rate * line / np.sqrt(g_line[used])
            machine.factors[used] -= rate * fact / np.sqrt(g_fact[used])
    return machine


_INPUT_SCHEMA = "id string, label int, feature array<int>, share array<float>, stats array<double>"


def train(sample: DataFrame) -> Machine:
    """Fit on a bounded table (id, text, label): inputs are made by Spark, weights on the driver."""
    rows = sample.select(F.col("id").cast("string").alias("id"), "text", F.col("label").cast("int"))

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        text, feature, share, stats = inputs(part.column("text"))
        ptr = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
        width = np.arange(part.num_rows + 1, dtype=np.int32) * N_STATS
        return pa.RecordBatch.from_arrays(
            [
                part.column("id"),
                part.column("label"),
                pa.ListArray.from_arrays(ptr, pa.array(feature, pa.int32())),
                pa.ListArray.from_arrays(ptr, pa.array(share, pa.float32())),
                pa.ListArray.from_arrays(width, pa.array(stats.ravel())),
            ],
            names=["id", "label", "feature", "share", "stats"],
        )

    table = rows.mapInArrow(A.over_texts(kernel), _INPUT_SCHEMA).toArrow().sort_by("id")
    table = table.combine_chunks()
    labels = table.column("label").to_numpy().astype(np.float64)
    if not len(labels):
        return fit([], labels)

    def flat(name: str) -> np.ndarray:
        return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)

    sizes = A.list_sizes(table.column("feature"))
    text = np.repeat(np.arange(len(labels)), sizes)
    stats = flat("stats").reshape(-1, N_STATS)
    return fit([(text, flat("feature").astype(np.int64), flat("share").astype(np.float64), stats)], labels)


def fitted(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Machine:
    """The machine for `labels.quality`, learnt outside the held-out fold."""
    return train(labelled_sample(docs, labels, "quality", MODULUS, HELD_OUT, rows))


def with_score(docs: DataFrame, machine: Machine, text_column: str = "text", name: str = "score") -> DataFrame:
    """All columns of docs and the score of each text; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        score = pa.array(shared.value.score(part.column(text_column)), pa.float64())
        return pa.RecordBatch.from_arrays([*part.columns, score], names=[*part.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(A.over_texts(kernel, text_column), schema)

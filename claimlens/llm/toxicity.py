"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max index.

The examples are a bounded sample of labelled rows (`SAMPLE_ROWS`). Near copies of an
earlier example of the same label (exact similarity of shingles of `MIN_SIMILARITY` or more)
are left out, so that copies neither fill the neighbours nor make their words look telling.
Every word of an example has a weight: its inverse frequency over all documents, times how
surely the examples tie it to label 1 (`favour`), which no word loses altogether. The unit
vectors are indexed as posting lists, cut into blocks of examples with the largest weight of
each block. A query adds up these maxima to a bound for each block, visits blocks from the
highest bound down and stops when no block left can beat its k-th neighbour, so the
cosine search is exact. Votes weighted by squared similarity go through a logistic
calibration fitted on the examples, each scored without itself.

The index grows with the words of the sample, not with the documents, and is broadcast; each
text is scored where it is read. Document frequencies are summed up within the tasks, so one
row per task and word of the sample is shuffled.

Defined results: null and empty texts, and texts without a word of any example, have no
neighbours and get the rate of such examples; ties between neighbours go to the lower
example id; very long texts are scored whole; repeated rows give repeated results and count
as often as they are stored; empty `documents` give an empty table; without labelled rows
every score is 1/2; other input columns are not passed on.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from claimlens.llm import arrays as A
from claimlens.llm.labelled import labelled_sample
from claimlens.llm.minhash import MIN_SIMILARITY, SHINGLE, regions

SAMPLE_ROWS = 8_000
NEIGHBOURS = 16
EVIDENCE = 3
# Examples of a block, a power of two.
BLOCK = 64
# Words in at least this share of the examples have a weight for every example instead of a
# posting list; texts that are searched with these at a time.
DENSE_SHARE, BATCH = 0.08, 128
# Weight of a word that is not tied to label 1, against 1 of one that is by `FAVOUR_Z` standard errors.
FAVOUR_BASE, FAVOUR_Z = 0.05, 6.0
# Squared similarity that the share of label 1 among all examples has in every vote.
DOUBT = 0.1
MODULUS, HELD_OUT = 3, 1
THRESHOLD = 0.7


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i]+1, ... size[i] numbers each, one after the other."""
    before = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(start - before, size)


@dataclass
class Index:
    """Examples as unit vectors over their words, by word and block."""

    vocabulary: np.ndarray
    worth: np.ndarray
    example_id: np.ndarray
    label: np.ndarray
    # Frequent words: their row, or -1, and weights by example, filled up to whole blocks.
    dense_row: np.ndarray
    dense: np.ndarray
    # Postings of the other words by word, then example; `pair_*` are the runs of one word in one block.
    post_example: np.ndarray
    post_weight: np.ndarray
    pair_ptr: np.ndarray
    pair_block: np.ndarray
    pair_max: np.ndarray
    pair_start: np.ndarray
    pair_size: np.ndarray
    # Share of label 1 among the examples, which a vote without near neighbours tends to.
    rate: float
    slope: float = 1.0
    offset: float = 0.0
    without: float = 0.5

    def frequent(self, text: np.ndarray, word: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """What the frequent words add to the cosines of n texts with all examples."""
        row = self.dense_row[word]
        known = row >= 0
        query = np.zeros((n, len(self.dense)))
        query[text[known], row[known]] = weight[known]
        return query @ self.dense

    def search(self, ptr: np.ndarray, word: np.ndarray, weight: np.ndarray, rows: np.ndarray, skip: bool = False):
        """(row, examples, cosines) of each of the rows; skip: leave out the example of that number."""
        for at in range(0, len(rows), BATCH):
            part = rows[at : at + BATCH]
            size = ptr[part + 1] - ptr[part]
            all_ = _runs(ptr[part], size)
            base = self.frequent(np.repeat(np.arange(len(part)), size), word[all_], weight[all_], len(part))
            for i, sums in zip(part.tolist(), base):
                mine = slice(ptr[i], ptr[i + 1])
                yield i, *self.nearest(word[mine], weight[mine], NEIGHBOURS, i if skip else -1, sums)

    def nearest(self, word: np.ndarray, weight: np.ndarray, k: int, skip: int = -1, base: np.ndarray | None = None):
        """(examples, cosines) of the k nearest examples that share a word, best first."""
        if base is None:
            base = self.frequent(np.zeros(len(word), np.int64), word, weight, 1)[0]
        base = base.reshape(-1, BLOCK)
        n_runs = self.pair_ptr[word + 1] - self.pair_ptr[word]
        runs = _runs(self.pair_ptr[word], n_runs)
        gain_of = np.repeat(weight, n_runs)
        block = self.pair_block[runs]
        bounds = base.max(axis=1) + np.bincount(block, self.pair_max[runs] * gain_of, len(base))
        by_bound = np.argsort(-bounds, kind="stable")
        bound = bounds[by_bound]
        n = int(np.searchsorted(-bound, 0.0))
        rank = np.empty(len(base), dtype=np.int32)
        rank[by_bound] = np.arange(len(base))
        place = rank[block]
        found, score, done, step = np.zeros(0, np.int64), np.zeros(0), 0, 32
        while done < n:
            if len(score) >= k and bound[done] < score[k - 1] - 1e-9:
                break
            to = min(n, done + step)
            now = np.flatnonzero((place >= done) & (place < to))
            size = self.pair_size[runs[now]]
            owner = np.repeat(np.arange(len(now)), size)
            at = np.arange(len(owner)) + (self.pair_start[runs[now]] - (np.cumsum(size) - size))[owner]
            # The examples of the blocks looked at, block after block.
            slot = (self.post_example[at] & (BLOCK - 1)) + ((place[now] - done) * BLOCK)[owner]
            total = np.bincount(slot, self.post_weight[at] * gain_of[now][owner], (to - done) * BLOCK)
            # Rounded, so that the order of the summands does not tell equal cosines apart.
            total = np.round(total + base[by_bound[done:to]].ravel(), 12)
            hit = np.flatnonzero(total)
            if len(hit) > k:
                hit = hit[total[hit] >= np.partition(total[hit], -k - 1)[-k - 1]]
            example = by_bound[done + hit // BLOCK] * BLOCK + hit % BLOCK
            keep = example != skip
            found, score = np.concatenate([found, example[keep]]), np.concatenate([score, total[hit[keep]]])
            best = np.lexsort((self.example_id[found], -score))[:k]
            found, score = found[best], score[best]
            done, step = to, step * 2
        return found, np.minimum(score, 1.0)

    def vectors(self, w: A.Words):
        """(text, word, weight) of the indexed words of a batch; vectors have length 1."""
        at = np.searchsorted(self.vocabulary, w.hash)
        at[at == len(self.vocabulary)] = 0
        hit = np.flatnonzero(self.vocabulary[at] == w.hash) if len(self.vocabulary) else np.zeros(0, int)
        text, word, count = A.distinct(w.text_of()[hit], at[hit], max(1, len(self.vocabulary)))
        weight = (1 + np.log(count)) * self.worth[word]
        length = np.sqrt(np.bincount(text, weight**2, len(w.ptr) - 1))
        return text, word, weight / length[text]

    def vote(self, cosine: np.ndarray, label: np.ndarray) -> float:
        return float(((cosine**2 * label).sum() + DOUBT * self.rate) / ((cosine**2).sum() + DOUBT))

    def probability(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope * vote + self.offset))))

    def score(self, texts: pa.Array, kept: dict | None = None):
        """(scores, neighbours of each text: example ids, labels and cosines)."""
        text, word, weight = self.vectors(A.words(texts, plain=True))
        ptr = np.searchsorted(text, np.arange(len(texts) + 1))
        scores, evidence = np.full(len(texts), self.without), [[] for _ in range(len(texts))]
        kept = {} if kept is None else kept
        if len(kept) >= 20_000:
            kept.clear()
        # Equal texts of a task are searched once.
        keys, first = {}, {}
        for i in np.flatnonzero(np.diff(ptr)).tolist():
            part = slice(ptr[i], ptr[i + 1])
            keys[i] = blake2b(word[part].tobytes() + weight[part].tobytes(), digest_size=16).digest()
            if keys[i] not in kept:
                first.setdefault(keys[i], i)
        for i, found, cosine in self.search(ptr, word, weight, np.array(list(first.values()), dtype=np.int64)):
            near = list(zip(self.example_id[found].tolist(), self.label[found].tolist(), cosine.tolist()))
            kept[keys[i]] = (self.probability(self.vote(cosine, self.label[found])), near[:EVIDENCE])
        for i, key in keys.items():
            scores[i], evidence[i] = kept[key]
        return scores, evidence


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method with a small penalty."""
    design, beta = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (p - y) + 1e-2 * beta
        curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta -= step
        if abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def favour(df: np.ndarray, df_pos: np.ndarray, n: int, n_pos: float) -> np.ndarray:
    """Between `FAVOUR_BASE` and 1, by the standard errors that a word is too frequent under label 1."""
    rate = n_pos / max(n, 1)
    z = (df_pos - rate * df) / np.sqrt(rate * (1 - rate) * df + 1)
    return FAVOUR_BASE + (1 - FAVOUR_BASE) * np.clip(z / FAVOUR_Z, 0, 1) ** 2


def build(
    ids: np.ndarray,
    labels: np.ndarray,
    text: np.ndarray,
    word: np.ndarray,
    count: np.ndarray,
    frequency: tuple[np.ndarray, int] | None = None,
) -> Index:
    """Index of the examples. (text, word hash, count) triples are in order of text.

    frequency: in how many documents each different word is, in order of the hashes, and the
    number of documents; of the examples themselves if None.
    """
    n, positive = len(ids), labels.astype(float)
    vocabulary, code = np.unique(word, return_inverse=True)
    code = code.astype(np.int32)
    df = np.bincount(code, minlength=len(vocabulary)).astype(float)
    df_pos = np.bincount(code, positive[text], len(vocabulary))
    in_docs, n_docs = (df, n) if frequency is None else frequency
    worth = (np.log((n_docs + 1) / (in_docs + 1)) + 1) * favour(df, df_pos, n, positive.sum())
    weight = (1 + np.log(count)) * worth[code]
    length = np.sqrt(np.bincount(text, weight**2, n))
    weight /= length[text]
    # Examples with the same main word stand together, which makes blocks' maxima tell more.
    main = np.full(n, -1)
    by = np.lexsort((weight, text))
    main[text[by]] = code[by]
    place = np.empty(n, dtype=np.int32)
    order = np.lexsort((ids, main))
    place[order] = np.arange(n)
    by = np.lexsort((place[text], code))
    example, code, weight = place[text[by]], code[by], weight[by]
    del by
    frequent = df >= max(DENSE_SHARE * n, 1)
    dense_row = np.where(frequent, np.cumsum(frequent) - 1, -1).astype(np.int32)
    dense = np.zeros((int(frequent.sum()), -(-n // BLOCK) * BLOCK))
    often = frequent[code]
    dense[dense_row[code[often]], example[often]] = weight[often]
    post_example, post_code, post_weight = example[~often], code[~often], weight[~often]
    block = post_example // BLOCK
    starts = np.ones(len(post_code), dtype=bool)
    starts[1:] = (post_code[1:] != post_code[:-1]) | (block[1:] != block[:-1])
    start = np.flatnonzero(starts)
    index = Index(
        vocabulary,
        worth,
        ids[order],
        labels[order],
        dense_row,
        dense,
        post_example,
        post_weight,
        np.searchsorted(post_code[start], np.arange(len(vocabulary) + 1)),
        block[start],
        np.maximum.reduceat(post_weight, start) if len(start) else np.zeros(0),
        start.astype(np.int32),
        np.diff(np.append(start, len(post_code))).astype(np.int32),
        float(positive.sum() / max(n, 1)),
    )
    by = np.lexsort((code, example))
    ptr = np.searchsorted(example[by], np.arange(n + 1))
    code, weight = code[by], weight[by]
    del by, example, often, starts
    votes, truth = [], []
    has = np.diff(ptr) > 0
    for i, found, cosine in index.search(ptr, code, weight, np.flatnonzero(has), skip=True):
        if len(found):
            votes.append(index.vote(cosine, index.label[found]))
            truth.append(index.label[i])
    if votes:
        index.slope, index.offset = _logistic(np.array(votes), np.array(truth, dtype=float))
    index.without = float((index.label[~has].sum() + 0.5) / ((~has).sum() + 1)) if n else 0.5
    return index


_SCHEMA = "id long, label int, word array<long>, count array<int>, region array<long>"


def _example(part: pa.RecordBatch) -> pa.RecordBatch:
    """Word counts of each text and the unit regions of its shingles, to tell copies."""
    w = A.words(part.column("text"), plain=True)
    n = part.num_rows
    by = np.lexsort((w.hash, w.text_of()))
    text, word = w.text_of()[by], w.hash[by]
    first = np.ones(len(word), dtype=bool)
    first[1:] = (text[1:] != text[:-1]) | (word[1:] != word[:-1])
    start = np.flatnonzero(first)
    count = np.diff(np.append(start, len(word)))
    ptr = np.searchsorted(text[start], np.arange(n + 1)).astype(np.int32)
    region, region_ptr = regions(w, SHINGLE)
    return pa.RecordBatch.from_arrays(
        [
            part.column("id"),
            part.column("label"),
            pa.ListArray.from_arrays(ptr, pa.array(word[start].view(np.int64))),
            pa.ListArray.from_arrays(ptr, pa.array(count, pa.int32())),
            pa.ListArray.from_arrays(region_ptr.astype(np.int32), pa.array(region.view(np.int64))),
        ],
        names=["id", "label", "word", "count", "region"],
    )


def without_copies(region: np.ndarray, size: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which examples stay: those that are no near copy of an earlier one of their label that stays.

    size: how many of the regions belong to each example, in order.
    """
    n = len(size)
    order = np.argsort(region, kind="stable")
    new = np.ones(len(region), dtype=bool)
    new[1:] = np.diff(region[order]) != 0
    count = np.diff(np.append(np.flatnonzero(new), len(region)))
    # Only regions that two examples share tell of copies.
    at = order[np.repeat(count > 1, count)]
    del order, new
    count = count[count > 1]
    holder = np.repeat(np.arange(n, dtype=np.int32), size)[at]
    code = np.repeat(np.arange(len(count), dtype=np.int32), count)[np.argsort(at)]
    ptr = np.concatenate([[0], np.cumsum(np.bincount(holder, minlength=n))])
    first = np.cumsum(count) - count
    stay = np.ones(n, dtype=bool)
    for i in np.flatnonzero(np.diff(ptr)):
        if not stay[i]:
            continue
        mine = code[ptr[i] : ptr[i + 1]]
        common = np.zeros(n, dtype=np.int64)
        for part in A.steps(count[mine], 1 << 18):
            common += np.bincount(holder[_runs(first[mine[part]], count[mine[part]])], minlength=n)
        near = common >= MIN_SIMILARITY * (size[i] + size - common) - 1e-9
        near[: i + 1] = False
        stay[near & (label == label[i])] = False
    return stay


def document_frequency(docs: DataFrame, vocabulary: np.ndarray, text_column: str = "text") -> tuple[np.ndarray, int]:
    """In how many rows each word of a sorted vocabulary of hashes is, and the number of rows."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def task(batches):
        known = shared.value
        total, rows = np.zeros(len(known) + 1, dtype=np.int64), 0
        for batch in batches:
            for part in A.by_bytes(batch, "text"):
                w = A.words(part.column("text"), plain=True)
                rows += part.num_rows
                at = np.searchsorted(known, w.hash)
                hit = np.flatnonzero(np.append(known, 0)[at] == w.hash) if len(known) else np.zeros(0, int)
                hit = hit[at[hit] < len(known)]
                _, code, _ = A.distinct(w.text_of()[hit], at[hit], len(known) + 1)
                total += np.bincount(code, minlength=len(total))
        total[-1] = rows
        code = np.flatnonzero(total)
        # The last code stands for the rows themselves.
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "n"])

    rows = docs.select(F.col(text_column).alias("text"))
    summed = rows.mapInArrow(task, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary) + 1, dtype=np.int64)
    out[summed.column("code").to_numpy()] = summed.column("n").to_numpy()
    return out[:-1], int(out[-1])


def train(sample: DataFrame, docs: DataFrame | None = None, text_column: str = "text") -> Index:
    """Index of a bounded table (id, text, label), with word frequencies over all rows of docs."""
    rows = sample.select(F.col("id").cast("long").alias("id"), "text", F.col("label").cast("int"))
    table = rows.mapInArrow(A.over_texts(_example), _SCHEMA).toArrow()
    order = np.argsort(table.column("id").to_numpy(), kind="stable")
    ids, labels = (table.column(c).to_numpy()[order] for c in ("id", "label"))

    def lists(name: str) -> tuple[np.ndarray, np.ndarray]:
        """Values and sizes of one column's lists by id; the column is let go."""
        nonlocal table
        column = table.column(name).combine_chunks()
        column = column.take(pa.array(order)) if len(order) else pa.array([], column.type)
        table = table.drop_columns([name])
        return column.flatten().to_numpy(zero_copy_only=False), A.list_sizes(column)

    fresh = without_copies(*lists("region"), labels)
    (word, sizes), (count, _) = lists("word"), lists("count")
    text = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
    use = fresh[text]
    place = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
    text, word, count = place[text[use]], word[use].view(np.uint64), count[use]
    pa.default_memory_pool().release_unused()
    frequency = document_frequency(docs, np.unique(word), text_column) if docs is not None else None
    return build(ids[fresh], labels[fresh], text, word, count, frequency)


def fitted(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Index:
    """The index for `labels.toxic`, learnt outside the held-out fold."""
    return train(labelled_sample(docs, labels, "toxic", MODULUS, HELD_OUT, rows), docs)


EVIDENCE_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("example_id", T.LongType()),
            T.StructField("label", T.IntegerType()),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
)


def score(docs: DataFrame, index: Index, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score, evidence) of every row; no shuffle."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(index)
    schema = T.StructType(
        [
            T.StructField("id", rows.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField("evidence", EVIDENCE_TYPE),
        ]
    )
    arrow = pa.list_(
        pa.struct([("example_id", pa.int64()), ("label", pa.int32()), ("similarity", pa.float64())])
    )

    def task(batches):
        kept: dict = {}
        names = ("example_id", "label", "similarity")
        for batch in batches:
            for part in A.by_bytes(batch, "text"):
                scores, near = shared.value.score(part.column("text"), kept)
                rows_ = [[dict(zip(names, e)) for e in n] for n in near]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(scores), pa.array(rows_, arrow)], names=["id", "score", "evidence"]
                )

    return rows.mapInArrow(task, schema).withColumnRenamed("id", id_column)

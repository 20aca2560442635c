"""MinHash near-dedup: DartMinHash signatures, banded joining, exact verification.

A text is the multiset of its `SHINGLE`-word shingles (all words of a shorter text), and
two texts are linked when the weighted Jaccard similarity of these is `MIN_SIMILARITY` or
more. A shingle that occurs c times is an element of weight c, cut into c regions of
weight 1, which all texts with that shingle share from the first on.

Signatures: darts are thrown into the plane of regions and ranks, on average one per unit
of area, at places that are hashes of the region. A text looks at the darts that fall
below its own weight and a bound on the rank, which is chosen so that about
k ln k + 3 k darts are seen whatever the size of the text; each dart belongs to one of k
coordinates, and the smallest rank of each is the signature. Texts with a coordinate
that no dart hit look at higher ranks, until there is none.

Joining: rows of the signature are hashed to band keys. Texts that share a key are
compared with the bucket's smallest text only, all on exact shingles, and the components
of the links found are taken. Where a bucket still holds several components, its texts of
different components are compared as well, so no connection is lost, and inside a
component no further pair is looked at: a group of copies costs work in proportion to its
size. Minima and components by bucket are combined in the map tasks.

Defined results: null texts, and texts without a word, link with nothing; equal texts with a
word are linked; repeated rows have equal results; an empty table gives an empty
one. Columns of the input are passed on and those added give way to clashing names
by an underscore in front.
"""

from __future__ import annotations

from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimlens.llm import arrays as A
from claimlens.llm.components import components
from claimlens.llm.tables import free_name
from claimlens.session import durable

SHINGLE, MIN_SIMILARITY = 5, 0.8
# Texts of similarity 0.8 share one of the bands with probability 0.997.
BANDS, BAND_ROWS = 32, 8
# A text is sent once to each of these shares of the texts that are compared with it.
SHARES = 64
# Texts of a bucket that are compared in one task.
BLOCK = 512
# Keys of repeated rows that are broadcast; more are joined by a shuffle, with the same rows.
MOST_BROADCAST = 200_000

# Upper ends of the cells that ranks are cut into: doubling up to 4, then steps of 4.
_FIRST, _STEP = -6, 4.0
_POISSON = np.cumsum(np.exp(-1) / np.cumprod(np.maximum(np.arange(25), 1.0)))


def _cell(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower end and width of the cells with these numbers."""
    n_doubling = 2 - _FIRST + 1
    small = number < n_doubling
    power = np.exp2(np.minimum(number, n_doubling) + _FIRST)
    low = np.where(number == 0, 0.0, np.where(small, power / 2, (number - n_doubling + 1) * _STEP))
    width = np.where(number == 0, power, np.where(small, power / 2, _STEP))
    return low, width


def _cells_below(rank: np.ndarray) -> np.ndarray:
    """Number of cells from rank 0 that cover each bound."""
    n_doubling = 2 - _FIRST + 1
    doubling = np.ceil(np.log2(np.maximum(rank, 2.0**_FIRST))).astype(np.int64) - _FIRST + 1
    return np.where(rank <= _STEP, doubling, n_doubling + np.ceil(rank / _STEP - 1).astype(np.int64))


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit hashes."""
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _poisson(u: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Poisson numbers by inversion: the value of u between the sums of probabilities."""
    count = np.zeros(len(u), dtype=np.int64)
    term = np.exp(-mean)
    total, left = term.copy(), np.flatnonzero(u > term)
    step = 0
    while len(left):
        step += 1
        count[left] += 1
        term[left] *= mean[left] / step
        total[left] += term[left]
        left = left[(u[left] > total[left]) & (step < 60)]
    return count


def regions(w: A.Words, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the unit regions of each text's shingles, first one of each text)."""
    counts, left = w.counts(), w.left()
    # A text of fewer words has one shingle with all of them.
    width = np.minimum(shingle, np.repeat(counts, counts))
    at = np.flatnonzero(left >= width)
    text = w.text_of()[at]
    code = w.ranges(at, at + width[at])
    ptr = np.searchsorted(text, np.arange(len(counts) + 1))
    by = np.lexsort((code, text))
    code, text = code[by], text[by]
    new = np.ones(len(code), dtype=bool)
    new[1:] = (code[1:] != code[:-1]) | (text[1:] != text[:-1])
    place = np.arange(len(code))
    nth = place - np.maximum.accumulate(np.where(new, place, 0))
    return np.where(nth == 0, code, A.mix(code + nth.astype(np.uint64))), ptr


def signatures(region: np.ndarray, ptr: np.ndarray, k: int) -> np.ndarray:
    """k smallest ranks, as 64-bit numbers in order, of each text; texts must have a region."""
    n, weight = len(ptr) - 1, np.diff(ptr)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * k, none)
    seen = np.zeros(n, dtype=np.int64)
    bound = k * (log(k) + 3) / np.maximum(weight, 1)
    todo = np.flatnonzero(weight > 0)
    while len(todo):
        until = np.maximum(_cells_below(bound[todo]), seen[todo] + 1)
        # Texts with as many darts as a step holds.
        for part in A.steps(weight[todo] * (until - seen[todo]), 1 << 19):
            _throw(region, ptr, todo[part], seen[todo[part]], until[part], k, out)
        seen[todo] = until
        bound[todo] *= 2
        empty = (out.reshape(n, k)[todo] == none).any(1)
        todo = todo[empty]
    return out.reshape(n, k)


def _throw(region, ptr, texts, from_, until, k, out) -> None:
    """Put the darts of the cells from_..until of some texts into their signatures."""
    weight = np.diff(ptr)[texts]
    text = np.repeat(texts, weight)
    code = region[np.repeat(ptr[texts] - np.cumsum(weight) + weight, weight) + np.arange(weight.sum())]
    cells = np.repeat(until - from_, weight)
    owner = np.repeat(np.arange(len(code)), cells)
    number = np.repeat(np.repeat(from_, weight) - np.cumsum(cells) + cells, cells) + np.arange(cells.sum())
    low, width = _cell(number)
    base = A.mix(code[owner] ^ (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    darts = _poisson(_uniform(base), width)
    some = np.flatnonzero(darts)
    times = darts[some]
    cell = np.repeat(some, times)
    nth = np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
    dart = A.salted(base[cell] + nth.astype(np.uint64), 1)
    rank = low[cell] + width[cell] * _uniform(dart)
    coordinate = (A.salted(dart, 2) % np.uint64(k)).astype(np.int64)
    np.minimum.at(out, text[owner[cell]] * k + coordinate, rank.view(np.uint64))


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band, with the number of the band in it."""
    part = A.mix(sig.reshape(len(sig), bands, rows))
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1))
    for r in range(rows):
        key = A.mix(key * np.uint64(0x9E3779B97F4A7C15) + part[:, :, r])
    return key


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted arrays of unit regions."""
    if not len(a) or not len(b):
        return 0.0
    common = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return common / (len(a) + len(b) - common)


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, min_similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough. texts: (c, text), one row for each c.

    a's text goes once to each share of its partners, b's with its pair; a task reads the
    rows of one share after the other and keeps a's shingles only.
    """
    placed = pairs.withColumn("share", F.pmod(F.xxhash64("b"), F.lit(SHARES)).cast("int"))
    heads = placed.select("a", "share").distinct().withColumn("b", F.lit(None).cast("long"))
    rows = heads.join(texts.withColumnRenamed("c", "a"), "a").select("a", "share", "b", "text")
    rows = rows.unionByName(
        placed.join(texts.withColumnRenamed("c", "b"), "b").select("a", "share", "b", "text")
    )

    def compare(batches):
        now, own = None, None
        for batch in batches:
            for part in A.by_bytes(batch, "text"):
                a, share = part.column("a").to_numpy(), part.column("share").to_numpy()
                b = part.column("b").to_pylist()
                region, ptr = regions(A.words(part.column("text")), shingle)
                keep = []
                for i in range(part.num_rows):
                    mine = np.sort(region[ptr[i] : ptr[i + 1]])
                    if b[i] is None:
                        now, own = (a[i], share[i]), mine
                    elif now == (a[i], share[i]) and similarity(own, mine) >= min_similarity:
                        keep.append(i)
                if keep:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a[keep]), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"]
                    )

    key = ["a", "share"]
    sorted_ = rows.repartition(*key).sortWithinPartitions(*key, F.asc_nulls_first("b"))
    return durable(sorted_.mapInArrow(compare, "a long, b long"))


def _joined(regions_: list[np.ndarray], root: np.ndarray, side: np.ndarray, min_similarity: float):
    """Positions of links that join different roots of a group, one for each joining.

    Only pairs of different sides count, unless all are of one side. The texts of the
    most frequent root need no search of their own: each pair across has another end.
    """
    sizes = np.array([len(r) for r in regions_])
    everything = np.concatenate(regions_)
    by = np.argsort(everything, kind="stable")
    value, owner = everything[by], np.repeat(np.arange(len(sizes)), sizes)[by]
    two_sided = side.min() != side.max()
    names, count = np.unique(root, return_counts=True)
    most = names[count.argmax()]
    now = root.copy()
    out = []
    for i in np.flatnonzero(root != most):
        if (now == now[0]).all():
            break
        lo = np.searchsorted(value, regions_[i])
        hi = np.searchsorted(value, regions_[i], side="right")
        size = hi - lo
        at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        common = np.bincount(owner[at], minlength=len(sizes))
        near = common >= min_similarity * (sizes[i] + sizes - common) - 1e-9
        near &= now != now[i]
        if two_sided:
            near &= side != side[i]
        for j in np.flatnonzero(near):
            if now[j] != now[i]:
                out.append((i, j))
                now[now == now[j]] = now[i]
    return out


def _across(rest: DataFrame, texts: DataFrame, shingle: int, min_similarity: float, block: int) -> DataFrame:
    """Links (a, b) between texts of different components in one bucket.

    rest: (key, b, root, n), a row for each text of a bucket of n. Large buckets are cut
    into blocks and each pair of blocks is a group.
    """
    rows = rest.withColumn("s", F.ceil(F.col("n") / block).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("b"), F.col("s")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1))).select(
        "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "root", "b"
    )
    rows = rows.join(texts.withColumnRenamed("c", "b"), "b")
    group = ["key", "lo", "hi"]

    def compare(batches):
        for run in A.groups(batches, group):
            roots = run.column("root").to_numpy()
            if (roots == roots[0]).all():
                continue
            found: list[np.ndarray] = []
            for batch in run.combine_chunks().to_batches():
                for part in A.by_bytes(batch, "text"):
                    region, ptr = regions(A.words(part.column("text")), shingle)
                    found += [np.sort(region[a:b]) for a, b in zip(ptr, ptr[1:])]
            ids = run.column("b").to_numpy()
            links = _joined(found, roots, run.column("own").to_numpy(), min_similarity)
            if links:
                i, j = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], names=["a", "b"])

    sorted_ = rows.repartition(*group).sortWithinPartitions(*group)
    return durable(sorted_.mapInArrow(compare, "a long, b long"))


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = SHINGLE,
    min_similarity: float = MIN_SIMILARITY,
    bands: int = BANDS,
    rows: int = BAND_ROWS,
    block: int = BLOCK,
) -> DataFrame:
    """(key, component) of each different text that is linked with another text.

    The key is `text_key` of the text; equal texts have one key.
    """
    text = F.col(text_column)
    plain = docs.select(
        text_key(text_column).alias("c"), F.xxhash64(F.col(id_column), text).alias("r"), text.alias("text")
    ).where(text.isNotNull())

    def sign(part: pa.RecordBatch) -> pa.RecordBatch:
        region, ptr = regions(A.words(part.column("text")), shingle)
        some = np.flatnonzero(np.diff(ptr))
        keys = band_keys(signatures(region, ptr, bands * rows)[some], bands, rows)
        bounds = np.arange(len(some) + 1, dtype=np.int32) * bands
        return pa.RecordBatch.from_arrays(
            [
                part.column("c").take(pa.array(some)),
                part.column("r").take(pa.array(some)),
                pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys.ravel().view(np.int64))),
            ],
            names=["c", "r", "keys"],
        )

    signed = plain.mapInArrow(A.over_texts(sign), "c long, r long, keys array<long>")
    # One row for each different text; equal texts have equal keys.
    classes = durable(signed.groupBy("c").agg(F.min("r").alias("r"), F.first("keys").alias("keys")))
    entry = classes.select("c", F.explode("keys").alias("key"))
    buckets = entry.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("a")).where("n > 1")
    shared = durable(entry.join(buckets.select("key", "a"), "key").select("key", "a", F.col("c").alias("b")))
    pairs = durable(shared.where("a != b").select("a", "b").distinct())
    wanted = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    wanted = wanted.join(classes.select("c", "r"), "c")
    # The smallest row of each text stands for its copies; repeated rows are the same row.
    texts = durable(plain.join(wanted, ["c", "r"]).dropDuplicates(["c"]).select("c", "text"))
    links = _verified(pairs, texts, shingle, min_similarity)
    found = components(links, "a", "b")

    # Buckets that still hold several components.
    root = shared.join(found.withColumnRenamed("id", "b"), "b", "left").select(
        "key", "b", F.coalesce("component", "b").alias("root")
    )
    code = F.xxhash64("b").cast("decimal(20,0)")
    open_ = root.groupBy("key").agg(
        F.min("root").alias("lo"),
        F.max("root").alias("hi"),
        F.count(F.lit(1)).alias("n"),
        F.sum(code).alias("s"),
        F.bit_xor(F.hash("b")).alias("x"),
    )
    # Buckets of the same texts are looked at once.
    open_ = open_.where("lo < hi").groupBy("n", "s", "x").agg(F.min("key").alias("key")).select("key", "n")
    rest = durable(root.join(open_, "key"))
    if rest.isEmpty():
        return found.select(F.col("id").alias("key"), "component")
    more = _across(rest, texts, shingle, min_similarity, block)
    found = components(links.unionByName(more), "a", "b")
    return found.select(F.col("id").alias("key"), "component")


def text_key(text_column: str):
    """64-bit key of a text."""
    return F.xxhash64(F.col(text_column))


def _wordy(text_column: str):
    """A text without a word is no copy of anything."""
    return F.col(text_column).rlike(r"[^\x20\x09-\x0D]")


def with_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **how) -> DataFrame:
    """All columns of docs and: component_id (smallest id linked with the row), kept.

    One document of each component is kept: one with the smallest id; repeated rows with that
    id are all the same document, and the smallest content key decides between others. All
    repeated rows of that document are marked as kept; `one_of_each` leaves one of them.
    """
    return _marked(docs, docs, id_column, text_column, **how)


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **how) -> DataFrame:
    """One row of each component, and all rows whose text has no word.

    Of rows with the kept id and text, null ids included, the one with the smallest hash of
    all columns stays. Only rows whose id and text repeat are grouped, combined in the map tasks.
    """
    row = free_name(docs, "_row")
    rows = docs.withColumn(row, F.when(_wordy(text_column), F.xxhash64(id_column, text_column)))
    again = rows.where(F.col(row).isNotNull()).groupBy(row).agg(F.count(F.lit(1)).alias("n"))
    again = durable(again.where("n > 1").select(row))
    repeats = again.count()
    kept = free_name(docs, "kept")
    if not repeats:
        return with_components(docs, id_column, text_column, **how).where(F.col(kept)).select(*docs.columns)
    if repeats <= MOST_BROADCAST:
        again = F.broadcast(again)
    one = rows.join(again, row).groupBy(row).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("r"))
    single = rows.join(again, row, "left_anti").select(*docs.columns).unionByName(one.select("r.*"))
    return _marked(docs, single, id_column, text_column, **how).where(F.col(kept)).select(*docs.columns)


def _marked(docs: DataFrame, rows: DataFrame, id_column: str, text_column: str, **how) -> DataFrame:
    """The given rows of docs with the component among docs and whether they are kept."""
    key, comp, cid, kept = (free_name(docs, x) for x in ("_key", "_component", "component_id", "kept"))
    low, first = free_name(docs, "_low"), free_name(docs, "_first")
    found = near_duplicates(docs, id_column, text_column, **how)
    found = found.select(F.col("key").alias(key), F.col("component").alias(comp))
    content = F.when(_wordy(text_column), text_key(text_column))
    ids = docs.withColumn(key, content).select(key, F.col(id_column).alias(low)).where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min(low).alias(low)
    )
    ids = ids.join(found, key, "left").withColumn(comp, F.coalesce(comp, key))
    lowest = ids.groupBy(comp).agg(F.min(F.struct(F.col(low).isNull(), F.col(low), F.col(key))).alias(first))
    ids = durable(
        ids.join(lowest, comp).select(key, F.col(first)[low].alias(cid), F.col(first)[key].alias(first))
    )
    out = rows.withColumn(key, content).join(ids, key, "left")
    alone = F.col(key).isNull()
    return out.select(
        *docs.columns,
        F.when(alone, F.col(id_column)).otherwise(F.col(cid)).alias(cid),
        (alone | (F.col(key) == F.col(first)) & F.col(id_column).eqNullSafe(F.col(cid))).alias(kept),
    )

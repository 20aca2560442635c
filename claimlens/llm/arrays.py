"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column.

A word is a maximal run of characters other than space, tab, line feed, vertical tab,
form feed and carriage return. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that a kernel looks at in one step; one longer text is a step of its own.
STEP_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# Fixed value: the finalising constants of the splitmix64 generator.
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    """Another hash of the same numbers for each salt."""
    return mix(x + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BYTE_BASE))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse's powers modulo 2**64, i below n."""
    up = np.full(n, base, dtype=np.uint64)
    down = np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _range_sums(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for each range, the same wherever it stands."""
    size = 1 << max(12, int(len(values)).bit_length())
    up, down = _powers(base, size)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * down[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * up[start])


@dataclass(frozen=True)
class Words:
    """Words of a batch of texts in order: hash, byte range; text i has ptr[i]:ptr[i+1]."""

    data: np.ndarray
    offsets: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def text_of(self) -> np.ndarray:
        """Number of the text each word belongs to."""
        return np.repeat(np.arange(len(self.ptr) - 1), self.counts())

    def left(self) -> np.ndarray:
        """Words from each one to the end of its text, itself included."""
        return np.repeat(self.ptr[1:], self.counts()) - np.arange(len(self.hash))

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words that start at each word; garbage where fewer are left."""
        n = len(self.hash)
        at = np.arange(n)
        return self.ranges(at, np.minimum(at + k, n))

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words of each range."""
        return _range_sums(self.hash, start, end, _WORD_BASE)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts in them; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body else np.zeros(0, dtype=np.uint8)
    if not len(offsets):
        return data[:0], np.zeros(1, dtype=np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_ASCII_MARK = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def words(texts: pa.Array, plain: bool = False) -> Words:
    """The words of each text; plain: ASCII letters in lower case, all ASCII marks separate."""
    data, offsets = buffers(texts)
    n = len(data)
    letter = np.zeros(n + 2, dtype=bool)
    letter[1:-1] = ~(_ASCII_MARK if plain else _SEPARATOR)[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start = np.flatnonzero(letter[1:] & (~letter[:-1] | edge))
    end = np.flatnonzero(letter[:-1] & (~letter[1:] | edge))
    if plain:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    hashes = _range_sums(_BYTE_VALUE[data], start, end, _BYTE_BASE)
    return Words(data, offsets, hashes, start, end, np.searchsorted(start, offsets))


def steps(sizes: np.ndarray, most: int = STEP_BYTES) -> Iterator[slice]:
    """Slices of rows whose sizes sum up to `most` at most, or hold one row."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        yield slice(at, to)
        at = to


def by_bytes(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts of bounded text size."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    for part in steps(sizes.to_numpy(zero_copy_only=False)):
        yield batch.slice(part.start, part.stop - part.start)


def over_texts(
    kernel: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "text"
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that calls the kernel on parts of bounded text size."""

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, column):
                yield kernel(part)

    return run


def distinct(text: np.ndarray, feature: np.ndarray, n_features: int) -> tuple[np.ndarray, ...]:
    """(text, feature, count) of each distinct pair, in order."""
    key, count = np.unique(text * n_features + feature, return_counts=True)
    return key // n_features, key % n_features, count


def list_sizes(lists: pa.Array) -> np.ndarray:
    """Length of each list; 0 for null."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def spread_sum(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sum of values[ptr[i]:ptr[i+1]] for each i; 0 for an empty range."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[ptr[1:]] - total[ptr[:-1]]


def groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal integer keys, from sorted rows; holds one run and one batch."""
    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if carry is None else pa.concat_tables([carry, table])
        code = np.stack([table.column(c).to_numpy().astype(np.int64) for c in columns], axis=1)
        bounds = [0, *(np.flatnonzero((code[1:] != code[:-1]).any(1)) + 1).tolist()]
        for a, b in zip(bounds, bounds[1:]):
            yield table.slice(a, b - a)
        carry = table.slice(bounds[-1])
    if carry is not None and carry.num_rows:
        yield carry

"""A learned rank index: the offset of every unit boundary of a text from its number.

The boundaries of a text are points (rank, offset). They are covered by line segments, each
within `ERROR` of all its points; what a segment misses a point by is kept as one signed
byte. An offset is predicted from its segment and corrected by the stored residual, so it
is exact. A segment whose chord misses a point by more is halved, until all fit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from claimlens.llm import arrays as A

# The residual of a boundary is at most this, on either side.
ERROR = 127

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def boundaries(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ptr): boundaries of text i in code points, from 0 to its length.

    A unit is a run of ASCII letters or any other single character.
    """
    data, offsets = A.buffers(texts)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(lead, offsets)
    letter = _LETTER[data[lead]]
    start = ~letter
    start[1:] |= ~letter[:-1]
    start[first[:-1][first[:-1] < len(lead)]] = True
    unit = np.flatnonzero(start)
    n_units = np.diff(np.searchsorted(unit, first))
    ptr = np.concatenate([[0], np.cumsum(n_units + 1)])
    text = np.repeat(np.arange(len(n_units)), n_units)
    out = np.empty(ptr[-1], dtype=np.int64)
    out[np.arange(len(unit)) + text] = unit - first[text]
    out[ptr[1:] - 1] = np.diff(first)
    return out, ptr


@dataclass(frozen=True)
class RankIndex:
    """Segments over the boundaries of many texts; text i has the boundaries ptr[i]:ptr[i+1].

    A segment starts at boundary `first` with offset `base` and rises by `rise` in `run` ranks.
    """

    ptr: np.ndarray
    first: np.ndarray
    base: np.ndarray
    rise: np.ndarray
    run: np.ndarray
    residual: np.ndarray

    def units(self) -> np.ndarray:
        """Number of units of each text."""
        return np.diff(self.ptr) - 1

    def predicted(self, at: np.ndarray) -> np.ndarray:
        """Offset of each boundary as its segment tells it."""
        s = np.searchsorted(self.first, at, side="right") - 1
        return _chord(at, self.first[s], self.base[s], self.rise[s], self.run[s])

    def offsets(self, text: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Exact offset of the boundary behind the first `rank` units of each text."""
        at = self.ptr[text] + rank
        return self.predicted(at) + self.residual[at]


def _chord(at, first, base, rise, run):
    # Whole numbers, so that the prediction is the same wherever it is made.
    return base + (at - first) * rise // np.maximum(run, 1)


def fit(offsets: np.ndarray, ptr: np.ndarray, error: int = ERROR) -> RankIndex:
    """Segments within `error` (at most 127) of all boundaries of each text."""
    residual = np.zeros(len(offsets), dtype=np.int8)
    first, last = ptr[:-1].copy(), ptr[1:] - 1
    done: list[np.ndarray] = []
    while len(first):
        run = last - first
        base, rise = offsets[first], offsets[last] - offsets[first]
        begin = np.cumsum(run + 1) - (run + 1)
        of = np.repeat(np.arange(len(run)), run + 1)
        at = first[of] + np.arange(len(of)) - begin[of]
        miss = offsets[at] - _chord(at, first[of], base[of], rise[of], run[of])
        fine = np.maximum.reduceat(np.abs(miss), begin) <= error
        done.append(np.stack([first, base, rise, run])[:, fine])
        inside = fine[of]
        residual[at[inside]] = miss[inside]
        first, last = first[~fine], last[~fine]
        middle = (first + last) // 2
        first, last = np.concatenate([first, middle + 1]), np.concatenate([middle, last])
    segments = np.concatenate(done, axis=1) if done else np.zeros((4, 0), dtype=np.int64)
    segments = segments[:, np.argsort(segments[0])]
    return RankIndex(ptr, *segments, residual)


def build(texts: pa.Array, error: int = ERROR) -> RankIndex:
    """The index of a column of texts; null is empty."""
    return fit(*boundaries(texts), error)

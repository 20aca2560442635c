"""Byte-level byte-pair encoding of many texts at once, on numpy arrays.

The bytes of a whole Arrow column are classed (letter, number, white space, other) and cut
into pre-tokens by array comparisons. Each different pre-token is merged once per step: all
of them lie in one ragged array of symbols, and every round applies to each sequence its
own lowest-rank pair, at all its places at once. A sequence leaves the array when no pair
of it can be merged.

A pair that a merge makes always ranks behind that merge (checked when the file is read),
so merging all places of the lowest-rank pair at once, from left to right where they
overlap, gives what merging them one by one gives. A sequence of more than `LONG` bytes
takes the same merges from a heap, so that it costs n log n and not n per rank.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from claimlens.llm import arrays as A

LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)
# Symbols of one sequence that take part in the rounds on arrays.
LONG = 2_048
_NO_RANK = np.int32(2**31 - 1)

# The characters of the White_Space property.
WHITE_SPACE = (
    0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005,
    0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
# What follows an apostrophe in a pre-token of its own.
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point; unassigned ones are unknown, as the library may be newer."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for c in range(0x110000):
        category = unicodedata.category(chr(c))
        out[c] = UNKNOWN if category == "Cn" else kind.get(category[0], OTHER)
    out[list(WHITE_SPACE)] = SPACE
    return out


def _alphabet() -> list[str]:
    """The character that stands for each byte in a vocabulary of byte-level tokens."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    hidden = [b for b in range(256) if b not in out]
    out.update((b, chr(256 + n)) for n, b in enumerate(hidden))
    return [out[b] for b in range(256)]


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start[i], start[i]+1, ... of every range, one range after the other."""
    total = np.cumsum(size)
    return np.repeat(start - total + size, size) + np.arange(total[-1] if len(total) else 0)


def _pointers(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


class BytePairs:
    """The merges of a byte-level tokenizer file, with its way to cut texts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cutting = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or cutting["type"] != "ByteLevel" or cutting["add_prefix_space"]:
            raise ValueError(f"{path}: not a byte-level tokenizer without normalisation")
        if not cutting.get("use_regex", True) or model["type"] != "BPE" or model.get("ignore_merges"):
            raise ValueError(f"{path}: not byte-pair encoding of words")
        self.pre_tokenizer = Tokenizer.from_file(path).pre_tokenizer
        vocabulary = model["vocab"]
        self.byte_id = np.array([vocabulary[c] for c in _alphabet()], dtype=np.int32)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left, right, made = (
            np.array([vocabulary[s] for s in side], dtype=np.int64)
            for side in (*zip(*pairs), [a + b for a, b in pairs])
        )
        n = len(pairs)
        used = np.full(max(vocabulary.values()) + 1, n)
        np.minimum.at(used, np.concatenate([left, right]), np.tile(np.arange(n), 2))
        if (used[made] <= np.arange(n)).any():
            raise ValueError(f"{path}: a merge uses a symbol that is made later")
        self.made = made.astype(np.int32)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.pair_key, self.pair_rank = key[order], order.astype(np.int32)
        at = np.arange(256)
        self.first_rank = self.rank(np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256)).reshape(256, 256)
        self.pair_of = dict(zip(key.tolist(), range(n)))
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path}: added tokens that take in their surroundings")
        self.special = {t["content"].encode(): t["id"] for t in added}
        longest = sorted(self.special, key=lambda s: (-len(s), s))
        self.special_at = re.compile(b"|".join(map(re.escape, longest))) if longest else None
        self.classes = _classes().copy()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; `_NO_RANK` for pairs that are not merged."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], _NO_RANK)

    def _learn_classes(self, points: np.ndarray) -> None:
        """Class characters this Python does not know as the library does."""
        for c in np.unique(points).tolist():
            starts = {span[0] for _, span in self.pre_tokenizer.pre_tokenize_str(f"a{chr(c)}1{chr(c)}!")}
            self.classes[c] = LETTER if 1 not in starts else NUMBER if 2 not in starts else OTHER if 4 not in starts else SPACE

    def _classed(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte where each character starts, and its class."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        head = data[lead]
        kind = self.classes[head]
        wide = np.flatnonzero(head >= 0xC0)
        if len(wide):
            at, b = lead[wide], head[wide].astype(np.int32)
            tail = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32) & 0x3F
            two = (b & 0x1F) << 6 | tail[at + 1]
            three = (b & 0x0F) << 12 | tail[at + 1] << 6 | tail[at + 2]
            four = (b & 0x07) << 18 | tail[at + 1] << 12 | tail[at + 2] << 6 | tail[at + 3]
            point = np.where(b < 0xE0, two, np.where(b < 0xF0, three, four))
            found = self.classes[point]
            if (found == UNKNOWN).any():
                self._learn_classes(point[found == UNKNOWN])
                found = self.classes[point]
            kind[wide] = found
        return lead, kind

    def _specials(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, id) of the special strings that lie inside one text."""
        if self.special_at is None:
            return []
        out = []
        body = data.tobytes()
        # Most columns hold none, which one fast search tells.
        if not any(s in body for s in self.special):
            return out
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            for m in self.special_at.finditer(body, a, b):
                out.append((m.start(), m.end(), self.special[m.group()]))
        return out

    def pre_tokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
        """First byte of each pre-token in order, and the ids of those that are special strings."""
        if not len(data):
            return np.zeros(0, dtype=np.int64), {}
        lead, kind = self._classed(data)
        n = len(lead)
        special = self._specials(data, offsets)
        edge = np.zeros(n + 1, dtype=bool)
        edge[np.searchsorted(lead, offsets)] = True
        for a, b, _ in special:
            edge[np.searchsorted(lead, [a, b])] = True
        edge[0] = edge[n] = True
        start = edge.copy()
        start[1:n] |= kind[1:] != kind[:-1]
        space = kind == SPACE
        # The last of the white space in front of a word: a space joins the word.
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:n])
        start[last] = True
        start[last[data[lead[last]] == 0x20] + 1] = False
        mark = np.flatnonzero((data[lead] == 0x27) & start[:n])
        if len(mark):
            ends = np.flatnonzero(edge)
            room = ends[np.searchsorted(ends, mark, side="right")]
            padded = np.concatenate([data, np.zeros(3, np.uint8)])
            byte = lead[mark]
            for tail in CONTRACTIONS:
                fits = mark + len(tail) < room
                for i, c in enumerate(tail, 1):
                    fits = fits & (padded[byte + i] == c)
                m = mark[fits]
                start[m + 1] = False
                start[m + 1 + len(tail)] = True
        for a, b, _ in special:
            i, j = np.searchsorted(lead, [a, b])
            start[i + 1 : j] = False
            start[i] = True
        ids = {a: token for a, _, token in special}
        return lead[start[:n]], ids

    def merge(self, data: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the byte sequences data[ptr[i]:ptr[i+1]], none empty, and their pointers."""
        size = np.diff(ptr)
        n = len(size)
        count = np.ones(n, dtype=np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for i in np.flatnonzero(size > LONG).tolist():
            ids = self._heap(data[ptr[i] : ptr[i + 1]])
            count[i] = len(ids)
            parts.append((np.array([i]), ids))
        which = np.flatnonzero(size <= LONG)
        body = data[ragged(ptr[which], size[which])]
        symbol, size = self.byte_id[body], size[which]
        rank = np.full(len(symbol), _NO_RANK, dtype=np.int32)
        rank[:-1] = self.first_rank[body[:-1], body[1:]]
        if len(symbol):
            rank[np.cumsum(size) - 1] = _NO_RANK
        while len(which):
            first = np.cumsum(size) - size
            low = np.minimum.reduceat(rank, first)
            over = low == _NO_RANK
            if over.any():
                at = ragged(first[over], size[over])
                count[which[over]] = size[over]
                parts.append((which[over], symbol[at]))
                go = ~over
                which, low = which[go], low[go]
                stay = ragged(first[go], size[go])
                symbol, rank, size = symbol[stay], rank[stay], size[go]
                continue
            hit = np.flatnonzero(rank == np.repeat(low, size))
            # Places of one pair that overlap, as in aaa: every other one from the left.
            if len(hit) > 1:
                joined = np.concatenate([[False], np.diff(hit) == 1])
                begin = np.maximum.accumulate(np.where(joined, 0, np.arange(len(hit))))
                hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            symbol[hit] = self.made[rank[hit]]
            keep = np.ones(len(symbol), dtype=bool)
            keep[hit + 1] = False
            size = size - np.add.reduceat(~keep, first)
            place = np.cumsum(keep) - 1
            symbol, rank, hit = symbol[keep], rank[keep], place[hit]
            last = np.zeros(len(symbol), dtype=bool)
            bounds = np.cumsum(size)
            last[bounds - 1] = True
            changed = np.concatenate([hit, hit[hit > 0] - 1])
            changed = changed[~last[changed]]
            rank[hit[last[hit]]] = _NO_RANK
            rank[changed] = self.rank(symbol[changed], symbol[changed + 1])
        out_ptr = _pointers(count)
        out = np.empty(out_ptr[-1], dtype=np.int32)
        for rows, symbols in parts:
            out[ragged(out_ptr[rows], count[rows])] = symbols
        return out, out_ptr

    def _heap(self, data: np.ndarray) -> np.ndarray:
        """Ids of one long sequence: merges by rank, then by place."""
        symbol = self.byte_id[data].tolist()
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known, made = self.pair_of.get, self.made.tolist()
        queue = []
        for i in range(n - 1):
            r = known(symbol[i] << 32 | symbol[i + 1])
            if r is not None:
                queue.append((r, i))
        heapq.heapify(queue)
        while queue:
            r, i = heapq.heappop(queue)
            j = after[i]
            if symbol[i] < 0 or j >= n or known(symbol[i] << 32 | symbol[j]) != r:
                continue
            symbol[i], symbol[j] = made[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                new = known(symbol[i] << 32 | symbol[k])
                if new is not None:
                    heapq.heappush(queue, (new, i))
            h = before[i]
            if h >= 0:
                new = known(symbol[h] << 32 | symbol[i])
                if new is not None:
                    heapq.heappush(queue, (new, h))
        return np.array([s for s in symbol if s >= 0], dtype=np.int32)

    def tokens(self, texts: pa.Array) -> Tokens:
        """The tokens of a column of texts; null is empty."""
        data, offsets = A.buffers(texts)
        start, special = self.pre_tokens(data, offsets)
        size = np.diff(np.concatenate([start, [len(data)]]))
        number, first = distinct_ranges(data, start, size)
        body = data[ragged(start[first], size[first])]
        ids, ptr = self.merge(body, _pointers(size[first]))
        if special:
            # Each special string is one id, whatever its bytes would give.
            at = np.searchsorted(start, list(special))
            extra = np.array(list(special.values()), dtype=np.int32)
            number[at] = len(ptr) - 1 + np.arange(len(at))
            ptr = np.concatenate([ptr, ptr[-1] + 1 + np.arange(len(at))])
            ids = np.concatenate([ids, extra])
        return Tokens(offsets, np.searchsorted(start, offsets), number, ids, ptr)


class Tokens:
    """Tokens of texts: text i has the pre-tokens words[i]:words[i+1], by number; a number has ids."""

    def __init__(self, offsets, words, number, ids, ptr):
        self.offsets, self.words, self.number, self.ids, self.ptr = offsets, words, number, ids, ptr

    def n_bytes(self) -> np.ndarray:
        return np.diff(self.offsets)

    def counts(self) -> np.ndarray:
        """How many ids each text has."""
        return A.spread_sum(np.diff(self.ptr)[self.number], self.words)

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the pointers of the texts."""
        size = np.diff(self.ptr)[self.number]
        return self.ids[ragged(self.ptr[:-1][self.number], size)], _pointers(size)[self.words]


def distinct_ranges(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each byte range among the different ones, a range of each number).

    Ranges of up to 15 bytes are told apart by one or two 64-bit words that hold all their
    bytes and their length, longer ones by the bytes themselves: no hashes, no collisions.
    """
    number = np.empty(len(start), dtype=np.int64)
    firsts: list[np.ndarray] = []
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    window = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    mask = np.array([(1 << 8 * i) - 1 for i in range(8)], dtype=np.uint64)
    n = 0

    def add(rows: np.ndarray, first: np.ndarray, inverse: np.ndarray) -> None:
        nonlocal n
        number[rows] = n + inverse
        firsts.append(rows[first])
        n += len(first)

    short = np.flatnonzero(size < 8)
    key = window[start[short]] & mask[size[short]] | size[short].astype(np.uint64) << np.uint64(56)
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    add(short, first, inverse)
    middle = np.flatnonzero((size >= 8) & (size < 16))
    if len(middle):
        a = window[start[middle]]
        b = window[start[middle] + 8] & mask[size[middle] - 8] | size[middle].astype(np.uint64) << np.uint64(56)
        order = np.lexsort((b, a))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        inverse = np.empty(len(order), dtype=np.int64)
        inverse[order] = np.cumsum(new) - 1
        add(middle, order[new], inverse)
    long = np.flatnonzero(size >= 16)
    if len(long):
        seen: dict[bytes, int] = {}
        first, inverse = [], []
        for i, (a, s) in enumerate(zip(start[long].tolist(), size[long].tolist())):
            at = seen.setdefault(data[a : a + s].tobytes(), len(seen))
            if at == len(first):
                first.append(i)
            inverse.append(at)
        add(long, np.array(first), np.array(inverse))
    return number, np.concatenate(firsts)


@lru_cache(maxsize=2)
def load(path: str) -> BytePairs:
    """The tokenizer file, read once by each Python worker."""
    return BytePairs(path)

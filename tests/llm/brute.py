"""Plain versions of the operators' contracts, for small inputs."""

import re
from collections import Counter

import numpy as np


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repeated_windows(texts, width):
    """Per text: which words lie in a window that starts more than once in all texts."""
    all_words = [words(t) for t in texts]
    count = Counter(tuple(w[i : i + width]) for w in all_words for i in range(len(w) - width + 1))
    out = []
    for w in all_words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append(gone)
    return out


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_texts(texts, shingle=5, least=0.8):
    """Pairs of texts whose weighted Jaccard similarity of shingles is large enough."""
    bags = []
    for t in texts:
        w = words(t)
        k = min(shingle, len(w))
        bags.append(Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter())
    for i, a in enumerate(bags):
        for j in range(i):
            low, high = sum((a & bags[j]).values()), sum((a | bags[j]).values())
            if low and low >= least * high:
                yield j, i


def near_vectors(x, least=0.9):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.triu(x @ x.T >= least, 1)
    return list(zip(*(a.tolist() for a in np.nonzero(near))))

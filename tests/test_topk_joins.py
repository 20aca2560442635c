import math
import re
from collections import Counter

import numpy as np
import pytest

from claimlens.operators import knn as K
from claimlens.operators.encode import distinct_tokens
from claimlens.operators.knn import knn_join
from claimlens.operators.lexical import lexical_join, term_index

VEC = "id long, embedding array<float>"


def clustered(n, dim, seed, copies=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, dim))
    v = centers[rng.integers(0, 5, n)] + 0.2 * rng.normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[n - copies :] = v[0]
    return v.astype(np.float32)


def frame(spark, m, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in r]) for i, r in enumerate(m)], VEC)


def brute(q, m, k):
    out = {}
    for i, row in enumerate(np.round(q.astype(float) @ m.astype(float).T, 6)):
        best = sorted(range(len(m)), key=lambda j: (-row[j], j))[:k]
        out[i] = [(j, r) for r, j in enumerate(best, 1)]
    return out


def ranked(df):
    out = {}
    for r in df.collect():
        out.setdefault(r[0], []).append((r.item_id, r["rank"]))
    return {q: sorted(v, key=lambda x: x[1]) for q, v in out.items()}


@pytest.mark.parametrize(
    "how",
    [
        {"strategy": "broadcast"},
        {"strategy": "cells", "max_pivots": 12, "block_rows": 40},
        {"strategy": "cells", "max_pivots": 4, "block_rows": 40, "cell_rows": 5},
        {"strategy": "auto", "broadcast_rows": 3, "max_pivots": 1, "block_rows": 1000},
    ],
)
def test_knn_equals_brute_force_with_a_third_of_copies(spark, how):
    items, queries = clustered(300, 8, 1, copies=100), clustered(60, 8, 2, copies=20)
    got = knn_join(frame(spark, queries), frame(spark, items), 6, "id", "id", **how)
    assert ranked(got) == brute(queries, items, 6)


def scored_pairs(spark, monkeypatch, n, **how):
    """Pairs that the cell plan compares for 40 queries among n items."""
    seen, probe = [], K._probe

    def counted(routes, placed, *rest):
        cells = placed.groupBy("cell").count().withColumnRenamed("count", "n")
        asked = routes.groupBy("cell").count().withColumnRenamed("count", "m")
        seen.append(cells.join(asked, "cell").selectExpr("coalesce(sum(n * m), 0) as p").first().p)
        return probe(routes, placed, *rest)

    monkeypatch.setattr(K, "_probe", counted)
    rng = np.random.default_rng(4)
    items, queries = rng.uniform(-1, 1, (n, 3)), rng.uniform(-1, 1, (40, 3))
    how = {"strategy": "cells", "max_pivots": 8, **how}
    got = knn_join(frame(spark, queries), frame(spark, items), 3, "id", "id", **how)
    assert ranked(got) == brute(queries.astype(np.float32), items.astype(np.float32), 3)
    monkeypatch.undo()
    return sum(seen)


def test_cells_stay_small_as_items_grow(spark, monkeypatch):
    small, large = (scored_pairs(spark, monkeypatch, n, cell_rows=64) for n in (1_000, 8_000))
    # Eight times the items cost less than half of eight times the pairs.
    assert large < 4 * small
    assert scored_pairs(spark, monkeypatch, 8_000, cell_rows=10**9) > 2 * large


def test_pivots_in_all_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(K, "MAX_LEAVES", 20)
    bound = []
    cells = K._cell_sizes
    monkeypatch.setattr(K, "_cell_sizes", lambda p: bound.append(cells(p)) or bound[-1])
    items = clustered(2_000, 4, 3)
    got = knn_join(frame(spark, items[:20]), frame(spark, items), 2, "id", "id", strategy="cells", max_pivots=2, cell_rows=1)
    assert ranked(got) == brute(items[:20], items, 2)
    assert len(bound) == 2 and 2 < len(bound[1]) < 60


def test_knn_cells_with_vectors_of_any_length(spark):
    rng = np.random.default_rng(5)
    items = (rng.normal(size=(200, 4)) * rng.uniform(0, 3, (200, 1))).astype(np.float32)
    queries = rng.normal(size=(30, 4)).astype(np.float32)
    queries[0] = 0
    got = knn_join(
        frame(spark, queries), frame(spark, items), 4, "id", "id", strategy="cells", max_pivots=9
    )
    assert ranked(got) == brute(queries, items, 4)


@pytest.mark.parametrize("strategy", ["broadcast", "cells"])
def test_knn_small_corpus_and_null_vectors(spark, strategy):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], VEC)
    queries = spark.createDataFrame([(7, [0.6, 0.8]), (8, None)], VEC)
    got = ranked(knn_join(queries, items, 6, "id", "id", strategy=strategy))
    assert got == {7: [(3, 1), (1, 2)]}
    empty = spark.createDataFrame([], VEC)
    assert knn_join(queries, empty, 6, "id", "id", strategy=strategy).count() == 0
    assert knn_join(empty, items, 6, "id", "id", strategy=strategy).count() == 0


def texts(n, seed, shared):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(120)]
    p = 1 / np.arange(1, 121)
    p /= p.sum()
    rows = [
        " ".join(rng.choice(vocabulary, rng.integers(2, 14), p=p)) for _ in range(n - shared)
    ]
    return rows + ["w0 w1 w2"] * shared


def brute_lexical(claims, articles, k):
    sets = [set(re.findall(r"\w+", t)) for t in articles]
    df = Counter(w for s in sets for w in s)
    weight = {w: round(math.log((len(sets) + 1) / (n + 1)) * 1e6) + 1 for w, n in df.items()}
    out = {}
    for i, t in enumerate(claims):
        mine = set(re.findall(r"\w+", t))
        score = {j: sum(weight[w] for w in mine & s) for j, s in enumerate(sets) if mine & s}
        best = sorted(score, key=lambda j: (-score[j], j))[:k]
        if best:
            out[i] = [(j, r) for r, j in enumerate(best, 1)]
    return out


@pytest.mark.parametrize(
    "how",
    [
        {},
        {"strategy": "probe", "probe_words": 2, "probe_postings": 20},
        {"strategy": "probe"},
        {
            "strategy": "probe",
            "probe_words": 1,
            "probe_postings": 3,
            "broadcast_claims": 2,
            "block_articles": 30,
            "block_claims": 7,
        },
        {"strategy": "scan", "broadcast_claims": 0, "block_articles": 50, "block_claims": 16},
    ],
)
def test_lexical_equals_brute_force(spark, how):
    articles, claims = texts(150, 3, 50), [*texts(40, 4, 12), "none of these", ""]
    a = spark.createDataFrame(list(enumerate(articles)), "id long, text string")
    c = spark.createDataFrame(list(enumerate(claims)), "id long, text string")
    index = term_index(distinct_tokens(a, "id", "text"))
    got = ranked(lexical_join(c, index, 3, "id", "text", **how))
    assert got == brute_lexical(claims, articles, 3)

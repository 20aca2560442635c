import numpy as np
from brute import near_vectors, roots

from claimlens.llm import components as C, vectors as V


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    x = np.concatenate([centres[i] + rng.normal(scale=0.25, size=(rng.integers(1, 20), 16)) for i in range(30)])
    x = np.concatenate([x, x[:5], rng.normal(size=(40, 16))]).astype(np.float32)
    rows = [(i + 7, v.tolist()) for i, v in enumerate(x)]
    links = near_vectors(x.astype(np.float64))
    count = np.bincount(np.array(links).ravel(), minlength=len(x))
    want = {i + 7: (int(count[i]), r + 7, r == i) for i, r in enumerate(roots(len(x), links))}
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for block in (1024, 8):
        got = V.near_duplicates(table, block=block, recall=0.999999).collect()
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [2.0, 4.1]), (4, [nan, 1.0]), (5, None), (6, [0.0, 0.0])]
    rows += [(None, [1.0, 2.0]), (7, [None, 1.0]), (8, [1.0]), (9, [2.0]), (2, [1.0, 2.0]), (10, [inf, 1.0]), (11, [])]
    got = V.near_duplicates(spark.createDataFrame(rows, "vec_id int, embedding array<double>")).collect()
    found = sorted((str(r.vec_id), r.n_links, r.component_id) for r in got)
    want = [(1, 3, 1), (2, 3, 1), (2, 3, 1), (3, 3, 1), (8, 1, 8), (9, 1, 8)]
    want += [(i, 0, i) for i in (4, 5, 6, 7, 10, 11, None)]
    assert found == sorted((str(a), b, c) for a, b, c in want)
    assert V.near_duplicates(spark.createDataFrame([], "vec_id int, embedding array<float>")).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(3, 3), (None, 4)]
    got = C.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert {r.id: r.component for r in got} == {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 40)}

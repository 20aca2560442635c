"""What grows with the input: rows that move, passes over texts, and work per word."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimlens.functions import text as X
from claimlens.operators import encode as E
from claimlens.operators import knn as K
from claimlens.operators import metrics as M
from claimlens.plans import queries as Q
from claimlens.session import durable
from claimlens.streaming import nearest as N


def test_a_vector_goes_to_a_bin_once_however_many_cells_it_sees(spark):
    rng = np.random.default_rng(7)
    pivots, bins = rng.normal(size=(50, 16)), np.arange(50) // 10
    cells = K._Cells(np.arange(50), pivots, np.full(50, 3), np.full(50, 9.0), (pivots**2).sum(axis=1), bins)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(40, 16)))]
    q = spark.createDataFrame(rows, "query_id long, v array<double>")
    shared = spark.sparkContext.broadcast(cells)
    far = K._routes(q.withColumn("floor", F.lit(float("-inf"))), shared, 6)
    assert far.count() == 40 * 50 and far.where("v is not null").count() == 40 * 5
    near = K._routes(q.withColumn("floor", F.lit(None).cast("double")), shared, 6)
    # Two cells of three items each, told one by one.
    assert near.count() == near.where("v is not null").count() == 40 * 2


def test_small_blocks_grow_with_the_rows():
    assert K._block(500, 64) == 64 and K._block(10**6, 64) == K.BLOCK_ROWS
    assert -(-(10**5) // K._block(10**5, 64)) <= K.MANY_BLOCKS


def test_many_small_cells_among_vectors_without_clusters(spark):
    rng = np.random.default_rng(8)
    m = rng.normal(size=(3_000, 24)).astype(np.float32)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<float>")
    got = K.knn_join(rows, rows, 6, "id", "id", strategy="cells", max_pivots=16, block_rows=64, cell_rows=32)
    found = {}
    for r in got.collect():
        found.setdefault(r[0], {})[r["rank"]] = r.item_id
    scores = np.round(m.astype(float) @ m.astype(float).T, 6)
    for i, s in enumerate(scores):
        assert [found[i][r] for r in range(1, 7)] == sorted(range(3_000), key=lambda j: (-s[j], j))[:6]


def test_texts_are_tokenised_once_and_sums_are_not_hashed(spark, monkeypatch):
    docs = durable(spark.createDataFrame([(1, "a b c"), (2, "b d e f"), (1, "a g")], "id long, text string"))
    words = E.lexicon(docs, "id", "text")
    lex = E.Lexicon(durable(words.df), words.n_docs)
    want = sorted(map(tuple, E.bucket_weights(docs, "id", "text", lex).collect()))
    monkeypatch.setattr(E, "BROADCAST_WORDS", 2)
    E._has_few_words.cache_clear()
    rows = E.bucket_weights(docs, "id", "text", lex, hot=2)
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    E._has_few_words.cache_clear()
    assert plan.count("split(") == 1 and "HashAggregate" not in plan
    assert sorted(map(tuple, rows.collect())) == want


def test_sums_of_one_id_are_added_over_batches():
    def batch(rows):
        pairs = [[{"bucket": b, "weight": w} for b, w in e] for _, e in rows]
        kind = pa.list_(pa.struct([("bucket", pa.int32()), ("weight", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array(pairs, kind)], names=["id", "e"])

    parts = [[(None, [(-1, 0)]), (None, [(0, 2)]), (1, [(-1, 0), (1, 5)])], [(1, [(1, 1)])], [(1, [(0, 0)]), (2, [(-1, 0)])]]
    out = pa.Table.from_batches(E._merged(2, E._as_pairs)(map(batch, parts))).to_pylist()
    got = [(r["id"], [(p["bucket"], p["weight"]) for p in r["e"]]) for r in out]
    assert got == [(None, [(-1, 0), (0, 2)]), (1, [(-1, 0), (0, 0), (1, 6)]), (2, [(-1, 0)])]
    vectors = pa.Table.from_batches(E._merged(2, E._as_vectors)(map(batch, parts))).to_pylist()
    assert [r["embedding"] for r in vectors] == [[1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]


def test_texts_are_not_carried_along_with_words(spark, monkeypatch):
    seen, sketch = [], M.sketch_batches
    monkeypatch.setattr(M, "sketch_batches", lambda rows, *a, **b: seen.append(rows.columns) or sketch(rows, *a, **b))
    assert Q.source_sketch(spark, "/root/testdata/sf0.001").first().near_word
    assert seen and not any({"text", "word"} <= set(c) for c in seen)


def test_a_text_with_a_token_is_told_without_cutting_it_up(spark):
    texts = ["a", " .,; ", "", None, "İ", "٣", "__", "-\n9", "é", "́"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    told = rows.select(X.has_token(F.col("text")).alias("has"), F.size(X.tokens(F.col("text"))).alias("n")).collect()
    assert all(r.has == (r.n > 0) for r in told)


@pytest.mark.parametrize("limit", [N.MAX_BYTES, 100])
def test_vectors_beyond_one_row_are_searched_batch_by_batch(spark, monkeypatch, limit):
    calls, join = [], Q.knn_join
    monkeypatch.setattr(N, "MAX_BYTES", limit)
    monkeypatch.setattr(Q, "knn_join", lambda *a, **b: calls.append(1) or join(*a, **b))
    got = Q.stream_knn_append(spark, "/root/testdata/sf0.001")
    vecs = Q.D.table(spark, "/root/testdata/sf0.001", "embeddings")
    want = join(vecs.where("vec_id % 100 = 0"), vecs, 6, "vec_id", "vec_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert bool(calls) == (limit == 100)


def test_arriving_vectors_meet_the_corpus_in_packs(spark):
    rows = spark.range(500).selectExpr("id as vec_id", "transform(sequence(1, 64), i -> cast(sin(id * i) as float)) as embedding")
    found = N.nearest(rows, N.corpus_row(rows, "vec_id"), 2, "vec_id")
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    want = K.knn_join(rows, rows, 2, "vec_id", "vec_id")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))

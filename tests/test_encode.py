import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from claimlens.operators import encode as E

TEXTS = ["the cat sat on the mat", "The DOG sat", "", "...", "cat cat cat dog", "the the mat"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def words(t):
    return [w for w in re.split(r"[\W_]+", t.lower()) if w]


def expected(texts, corpus):
    df = Counter(w for t in corpus for w in set(words(t)))
    out = []
    for t in texts:
        v = np.zeros(E.DIM)
        for w in words(t):
            idf = round(math.log((len(corpus) + 1) / (df[w] + 1)) * 1e6)
            v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % E.DIM] += idf
        n = np.linalg.norm(v)
        out.append(v / n if n else v)
    return np.array(out)


def vectors(df, key):
    return np.array([r.embedding for r in df.orderBy(key).collect()])


def test_rows_are_summed_where_they_are(spark):
    """Priced words become bucket sums of their text; the others leave it with their counts."""
    prices = pa.table({"token": ["the", "cat", "sat"], "bucket": pa.array([3, 3, 0], pa.int32()), "idf": [5, 7, 0]})
    texts = [words(t) for t in TEXTS] + [None, ["the"] * 40_000]
    batch = pa.RecordBatch.from_pydict({"id": list(range(8)), "tokens": pa.array(texts, pa.list_(pa.string()))})
    out = pa.Table.from_batches(E._sum_in_rows(prices, 4)([batch])).to_pylist()
    sums = {r["id"]: [(p["bucket"], p["weight"]) for p in r["e"]] for r in out if r["e"] is not None}
    for i, t in enumerate(texts):
        want = Counter({3: 0})
        for w in t or []:
            want[3] += {"the": 5, "cat": 7}.get(w, 0)
        zero = [(0, 0)] if "sat" in (t or []) else []
        assert sums[i] == [(-1, 0), *zero, *([(3, want[3])] if want[3] else [])]
    left = {(r["id"], r["token"]): r["tf"] for r in out if r["e"] is None}
    assert left == {(i, w): t.count(w) for i, t in enumerate(texts) for w in t or [] if w not in ("the", "cat", "sat")}


def test_encode_corpus_and_unseen_words(spark):
    docs = frame(spark, TEXTS)
    lex = E.lexicon(docs, "id", "text")
    np.testing.assert_allclose(
        vectors(E.encode(docs, "id", "text", lex), "id"), expected(TEXTS, TEXTS), atol=1e-6
    )
    claims = ["a new cat", "zebra zebra", " "]
    got = vectors(E.hashed_encoder(lex, "id", "text")(frame(spark, claims)), "id")
    np.testing.assert_allclose(got, expected(claims, TEXTS), atol=1e-6)


def test_hot_split_does_not_change_the_weights(spark):
    docs = frame(spark, TEXTS)
    lex = E.lexicon(docs, "id", "text")
    bags = [
        sorted(map(tuple, E.bucket_weights(docs, "id", "text", lex, hot=h).collect()))
        for h in (1, 3, 1000)
    ]
    assert bags[0] == bags[1] == bags[2]


def test_many_words_are_shuffled_and_weigh_the_same(spark, monkeypatch):
    docs = frame(spark, TEXTS)
    lex = E.lexicon(docs, "id", "text")
    want = sorted(map(tuple, E.bucket_weights(docs, "id", "text", lex, hot=2).collect()))
    monkeypatch.setattr(E, "BROADCAST_WORDS", 3)
    assert sorted(map(tuple, E.bucket_weights(docs, "id", "text", lex, hot=2).collect())) == want
    claims = ["a new cat", "zebra zebra", " "]
    got = vectors(E.hashed_encoder(lex, "id", "text")(frame(spark, claims)), "id")
    np.testing.assert_allclose(got, expected(claims, TEXTS), atol=1e-6)


def test_model_encoder_isolates_bad_rows(spark):
    def load():
        def call(texts):
            if any("bad" in t for t in texts):
                raise ValueError("bad text")
            return [[float(len(t)), 1.0] for t in texts]

        return call

    df = frame(spark, ["ab", "bad", "abc"]).coalesce(1)
    rows = E.model_encoder(load, "id", "text")(df).orderBy("id").collect()
    assert [r.embedding for r in rows] == [[2.0, 1.0], None, [3.0, 1.0]]
    assert [r.error for r in rows] == [None, "bad text", None]

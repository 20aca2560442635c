import os
import random
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import near_texts, repeated_windows, roots, words

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402

from claimlens.llm import arrays as A, minhash as M, substring as S  # noqa: E402

SCHEMA = "doc_id long, text string"


def _passages(rng, n):
    base = [[rng.choice("abcdefghij") for _ in range(rng.randint(5, 60))] for _ in range(12)]
    out = []
    for _ in range(n):
        w = []
        for _ in range(rng.randint(0, 6)):
            b = rng.choice(base)
            i = rng.randrange(len(b))
            letters = "abcdefghijklmnopqrstuvwxyz"[: rng.choice([1, 2, 26])]
            w += b[i : i + rng.randint(1, 60)] if rng.random() < 0.6 else [rng.choice(letters) for _ in range(rng.randint(1, 30))]
        out.append(rng.choice([" ", "\n", "  "]).join(w) if rng.random() > 0.03 else None)
    return out


@pytest.mark.parametrize("window,gram", [(10, 4), (6, 2)])
def test_substring_against_brute_force(spark, window, gram):
    texts = _passages(random.Random(window), 150)
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1])]
    got = S.dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), window=window, gram=gram).collect()
    gone = repeated_windows([t for _, t in rows], window)
    want = [
        (str(d), len(g), sum(g), " ".join(w for w, x in zip(words(t), g) if not x)) for (d, t), g in zip(rows, gone)
    ]
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got) == sorted(want)


def test_substring_edges(spark):
    empty = S.dedup(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == ["doc_id", "text", "n_words", "n_removed", "kept_text"]
    clash = spark.createDataFrame([(1, None, 5, "x"), (2, "", 6, "y")], "doc_id long, text string, n_words int, marks string")
    rows = {r.doc_id: r for r in S.dedup(clash).collect()}
    assert rows[1].n_words == 5 and rows[1]["_n_words"] == 0 and rows[2].marks == "y"
    long = " ".join(f"w{i}" for i in range(100_000))
    twice = spark.createDataFrame([(1, long), (2, f"{long} end")], SCHEMA)
    assert sorted((r.n_removed, r.kept_text) for r in S.dedup(twice).collect()) == [(100_000, ""), (100_000, "end")]


def test_signature_estimates_similarity():
    rng, estimates, exact = random.Random(5), [], []
    for n, edits in ((30, 1), (200, 4), (200, 8), (2000, 30)):
        for _ in range(10):
            a = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            b = list(a)
            for i in rng.sample(range(n), edits):
                b[i] = "changed"
            region, ptr = M.regions(A.words(pa.array([" ".join(a), " ".join(b)])), 5)
            sig = M.signatures(region, ptr, 256)
            estimates.append((sig[0] == sig[1]).mean())
            exact.append(M.similarity(*(np.sort(region[ptr[i] : ptr[i + 1]]) for i in (0, 1))))
    assert abs(np.mean(estimates) - np.mean(exact)) < 0.01
    assert np.abs(np.array(estimates) - exact).max() < 0.12


def test_minhash_against_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(25):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 8)):
            copy = list(w)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(400)}"
            texts.append(" ".join(copy))
    texts += ["a a a a a a a a", "a a a a a a a a a", "one two", "one  two", None, "", " \n"]
    ids = list(range(100, 100 + len(texts)))
    for block in (512, 2):
        got = M.with_components(spark.createDataFrame(list(zip(ids, texts)), SCHEMA), block=block)
        found = {r.doc_id: (r.component_id, r.kept) for r in got.collect()}
        want = roots(len(texts), near_texts(texts))
        assert found == {d: (ids[r], d == ids[r]) for d, r in zip(ids, want)}


def test_minhash_edges(spark):
    assert M.with_components(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, None, 1), (2, "", 2), (3, "a b", 3), (4, "a  b", 4), (None, "a b", 5), (3, "a b", 6), (5, " \n", 1)]
    got = M.with_components(spark.createDataFrame(rows, "doc_id int, text string, kept int"))
    assert got.columns == ["doc_id", "text", "kept", "component_id", "_kept"]
    assert sorted((str(r.doc_id), r.component_id, r["_kept"]) for r in got.collect()) == sorted(
        [("1", 1, True), ("2", 2, True), ("3", 3, True), ("3", 3, True), ("4", 3, False), ("5", 5, True), ("None", 3, False)]
    )


def test_one_row_of_each_component(spark, monkeypatch):
    rng = random.Random(4)

    def text(n=60):
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))

    alone, twice, group, nulls, mixed = (text() for _ in range(5))
    rows = [(1, alone, "a"), (2, twice, "a"), (2, twice, "a"), (2, twice, "b")]
    rows += [(3, group, "a")] * 3 + [(4, f"{group} end", "a"), (5, group, "a")]
    rows += [(None, nulls, "a")] * 3 + [(None, f"{nulls} end", "a"), (None, mixed, "a"), (9, mixed, "a")]
    rows += [(6, None, "a"), (6, None, "a"), (7, " ", "a")]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, kept string").repartition(5)
    for most in (M.MOST_BROADCAST, 0):
        monkeypatch.setattr(M, "MOST_BROADCAST", most)
        out = M.one_of_each(docs)
        assert out.dtypes == docs.dtypes
        got = Counter((r.doc_id, words(r.text)[0] if words(r.text) else r.text) for r in out.collect())
        want = [(1, alone), (2, twice), (3, group), (None, nulls), (9, mixed)]
        want = [(d, words(t)[0]) for d, t in want] + [(6, None), (6, None), (7, " ")]
        assert got == Counter(want)


def test_pipeline_keeps_repeated_document(spark):
    """A clean document that is stored twice goes through dedup once, with its whole text."""
    clean, other = (" ".join(f"{c}{i}" for i in range(80)) for c in "xy")
    rows = [(1, clean), (1, clean), (2, other), (None, f"{other} z"), (None, f"q {clean} z"), (None, f"q {clean} z")]
    docs = spark.createDataFrame([(d, t, "en", "a.com", len(t)) for d, t in rows], f"{SCHEMA}, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[2:4]:
        docs = stage(spark, docs, "")
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == [(1, clean), (2, other)]

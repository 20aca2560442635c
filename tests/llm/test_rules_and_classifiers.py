import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import words

from claimlens.llm import language as L, quality as Q, repetition as R, toxicity as X
from claimlens.llm.labelled import labelled_sample
from claimlens.llm.tables import fold, table

SF = "/root/testdata/sf0.1"


def _rules(text, least=8):
    w = words(text)
    n, longest = len(w), [0] * len(w)
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and w[i + k] == w[j + k]:
                k += 1
            longest[i], longest[j] = max(longest[i], k), max(longest[j], k)

    def cover(width, length):
        return len({p for i in range(n) if longest[i] >= width for p in range(i, i + length(i))})

    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            lines += line in seen
            seen.add(line)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return (n, sum(map(len, w)), symbols, lines, cover(3, lambda i: 3), cover(least, lambda i: longest[i]), max(longest, default=0))


def test_repetition_against_brute_force():
    rng = random.Random(2)
    texts = [None, "", " a  b c\n", "x", "a b a b a b c\n\nq\nq\n q\n \n ", "é é é é"]
    texts += ["".join(rng.choice(["a ", "b ", "é\n", "#c ", "\n"]) for _ in range(rng.randint(1, 90))) for _ in range(150)]
    got = [np.concatenate([c]) for c in R.statistics(pa.array(texts))]
    assert [tuple(int(c[i]) for c in got) for i in range(len(texts))] == [_rules(t) for t in texts]


def test_rules_drop_repetition(spark):
    clean = " ".join(f"w{i}" for i in range(200))
    rows = [(1, clean), (2, "same words again " * 60), (3, None), (4, f"{clean} {clean}"), (1, clean)]
    got = R.quality_rules(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert sorted((r.doc_id, r.base_failed, r.kept) for r in got) == [
        (1, False, True), (1, False, True), (2, True, False), (3, True, False), (4, True, False)
    ]


def _held_out(spark, scored, label, modulus, held_out):
    labels = table(spark, SF, "labels").where(fold("doc_id", modulus) == held_out)
    return scored.join(labels, "doc_id").select("score", label).toPandas()


def test_quality_on_held_out_labels(spark):
    docs, labels = table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "labels")
    machine = Q.fitted(docs, labels)
    out = _held_out(spark, Q.with_score(docs, machine), "quality", Q.MODULUS, Q.HELD_OUT)
    assert ((out.score >= Q.THRESHOLD) == (out.quality == 1)).mean() > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id int, text string")
    assert all(0 <= r.score <= 1 for r in Q.with_score(odd, machine).collect())
    assert [r.score for r in Q.with_score(odd, Q.fitted(docs, labels.limit(0))).collect()] == [0.5] * 3


def test_interactions_by_sums_of_squares():
    rng = np.random.default_rng(0)
    m = Q.Machine(np.zeros((Q.BUCKETS - 1, Q.N_STATS)), 0.3, rng.normal(size=50), rng.normal(size=(50, Q.RANK)))
    feature, value = np.array([3, 7, 20]), np.array([0.5, 2.0, 1.0])
    raw, _ = m.raw(np.zeros(3, int), feature, value, 1)
    pairs = sum(m.factors[feature[i]] @ m.factors[feature[j]] * value[i] * value[j] for i in range(3) for j in range(i))
    assert np.isclose(raw[0], 0.3 + m.linear[feature] @ value + pairs)


def test_toxicity_on_held_out_labels(spark):
    docs, labels = table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "labels")
    index = X.fitted(docs, labels)
    out = _held_out(spark, X.score(docs, index), "toxic", X.MODULUS, X.HELD_OUT)
    assert ((out.score >= X.THRESHOLD) == (out.toxic == 1)).mean() > 0.98
    assert (out.toxic == 1).sum() == 144 and ((out.score >= X.THRESHOLD) & (out.toxic == 1)).sum() >= 130
    assert out.score.nunique() > 0.9 * len(out)
    odd = spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")
    assert {r.score for r in X.score(odd, index).collect()} == {index.without}


@pytest.mark.parametrize("share", [0.0, 0.15, 2.0])
def test_nearest_examples_are_exact(monkeypatch, share):
    monkeypatch.setattr(X, "DENSE_SHARE", share)
    rng = np.random.default_rng(6)
    n, v = 400, 30
    text, word = (a.astype(int) for a in np.nonzero(rng.random((n, v)) < 0.15))
    labels = ((word == 0) | (word == 1)).astype(int)
    labels = np.bincount(text, labels, n).clip(0, 1).astype(int)
    index = X.build(np.arange(n), labels, text, word.astype(np.uint64), rng.integers(1, 4, len(text)))
    dense = np.zeros((n, len(index.vocabulary)))
    for w in range(dense.shape[1]):
        for run in range(index.pair_ptr[w], index.pair_ptr[w + 1]):
            at = slice(index.pair_start[run], index.pair_start[run] + index.pair_size[run])
            dense[index.post_example[at], w] = index.post_weight[at]
        if index.dense_row[w] >= 0:
            dense[:, w] = index.dense[index.dense_row[w]][:n]
    assert np.allclose(np.linalg.norm(dense, axis=1), (dense != 0).any(1))
    assert ((index.dense_row >= 0).mean() > 0.1) == (share < 1)
    assert dense.shape[1] > 1
    for _ in range(50):
        q = rng.random(dense.shape[1])
        q /= np.linalg.norm(q)
        found, cosine = index.nearest(np.arange(len(q)), q, 16)
        want = np.lexsort((np.arange(n), -(dense @ q)))[:16]
        assert np.allclose(cosine, (dense @ q)[want].clip(max=1.0))


def _plain_words(text):
    small = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    return Counter(re.findall("[0-9A-Za-z\x80-\U0010ffff]+", (text or "").translate(small)))


def test_scores_against_a_dense_cosine(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(120)] + ["É", "Bad", "bad", "Awful", "vile"]

    def text(toxic):
        words_ = rng.choices(vocabulary[:121], k=rng.randint(0, 25)) + ["bad", "awful,", "VILE"][: rng.randint(1, 3)] * toxic
        return " ".join(rng.sample(words_, len(words_)))

    rows = [(i, text(i % 4 == 0), i % 4 == 0) for i in range(300)] + [(400, None, False), (401, "", True)]
    docs = [(i, t) for i, t, _ in rows] + [(1000 + i, text(i % 3 == 0)) for i in range(200)]
    table_ = spark.createDataFrame(docs, "doc_id long, text string")
    index = X.train(spark.createDataFrame([(i, t, int(y)) for i, t, y in rows], "id long, text string, label int"), table_)
    assert sorted(index.example_id.tolist()) == [i for i, _, _ in rows]

    bags = {i: _plain_words(t) for i, t in docs}
    df = Counter(w for b in bags.values() for w in b)
    known = Counter(w for i, _, _ in rows for w in bags[i])
    positive = Counter(w for i, _, y in rows if y for w in bags[i])
    share = sum(y for _, _, y in rows) / len(rows)

    def vector(bag):
        out = {}
        for w, c in bag.items():
            if w in known:
                z = (positive[w] - share * known[w]) / math.sqrt(share * (1 - share) * known[w] + 1)
                favour = X.FAVOUR_BASE + (1 - X.FAVOUR_BASE) * min(max(z / X.FAVOUR_Z, 0), 1) ** 2
                out[w] = (1 + math.log(c)) * (math.log((len(docs) + 1) / (df[w] + 1)) + 1) * favour
        length = math.sqrt(sum(v * v for v in out.values()))
        return {w: v / length for w, v in out.items()}

    vectors = {i: vector(b) for i, b in bags.items()}

    def vote(bag_id, leave_out):
        near = []
        for i, _, y in rows:
            cosine = sum(v * vectors[i].get(w, 0.0) for w, v in vectors[bag_id].items())
            if cosine > 0 and not (leave_out and i == bag_id):
                near.append((-round(min(cosine, 1.0), 12), i, y))
        near = sorted(near)[: X.NEIGHBOURS]
        mass = sum(c * c for c, _, _ in near)
        return (sum(c * c * y for c, _, y in near) + X.DOUBT * share) / (mass + X.DOUBT), bool(near)

    votes = [(vote(i, True), y) for i, _, y in rows if vectors[i]]
    slope, offset = X._logistic(np.array([v for (v, any_), _ in votes if any_]), np.array([float(y) for (_, any_), y in votes if any_]))
    assert np.isclose([index.slope, index.offset], [slope, offset], rtol=1e-3).all()
    got = {r.doc_id: r.score for r in X.score(table_, index).collect()}
    for i, _ in docs:
        value, any_ = vote(i, False)
        want = 1 / (1 + math.exp(-(slope * value + offset))) if any_ else index.without
        assert abs(got[i] - want) < 1e-3, i
    clash = table_.selectExpr("doc_id", "text", "0.1 as score", "1 as evidence", "text as id")
    assert {r.doc_id: r.score for r in X.score(clash, index).collect()} == got
    long = spark.createDataFrame([(1, "w1 w2 " * 200_000), (1, "w1 w2 " * 200_000)], "doc_id long, text string")
    assert len({r.score for r in X.score(long, index).collect()}) == 1
    assert X.score(table_.limit(0), index).collect() == []


def test_labelled_sample_is_bounded_by_rows(spark):
    docs = spark.range(50_000).selectExpr("cast(1 as long) as doc_id", "concat('text ', id % 100) as text")
    docs = docs.unionAll(spark.range(2, 30).selectExpr("id as doc_id", "if(id = 5, null, 'other') as text"))
    labels = spark.range(1, 30).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    for rows in (10, 100):
        got = labelled_sample(docs, labels, "toxic", 3, 1, rows).collect()
        assert len(got) == len({r.id for r in got}) <= rows
    again = labelled_sample(docs.repartition(7), labels, "toxic", 3, 1, rows).orderBy("id").collect()
    assert again == sorted(got, key=lambda r: r.id)


def test_language_evidence(spark):
    docs = table(spark, SF, "documents").limit(1500)
    got = L.identify(docs).toPandas()
    assert (got.language == got.lang).mean() > 0.99 and got.kept.mean() > 0.99
    rows = [(1, None, None, None, 1), (None, "", "en", "a.com", 2), (2, "the of and", "en", "http://x.org/a", 3)]
    odd = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string, kept int")
    found = sorted((r.kept, r.language, r["_kept"]) for r in L.identify(odd).collect())
    assert found == [(1, "und", False), (2, "und", False), (3, "en", True)]
    assert L.identify(docs.limit(0)).collect() == []


def test_trigrams_stay_inside_texts():
    texts = ["abc", "", "ab", None, "xyzw"]
    gram, ptr = L.grams(pa.array(texts))
    assert np.diff(ptr).tolist() == [1, 0, 0, 0, 2]
    alone = [L.grams(pa.array([t]))[0].tolist() for t in texts]
    assert Counter(gram.tolist()) == Counter(g for a in alone for g in a)


def test_only_near_copies_of_a_label_are_left_out(spark):
    rng = random.Random(3)
    line = " ".join(f"licence{i}" for i in range(40))
    fresh = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(40)]
    # A shared passage, copies of one label, a copy of another label, a row without words.
    rows = [(i, f"{t} {line}", i % 2) for i, t in enumerate(fresh)]
    rows += [(50 + i, f"{fresh[i]} {line} end", i % 2) for i in range(5)]
    rows += [(60, f"{fresh[0]} {line}", 1), (70, "", 0), (71, None, 0)]
    index = X.train(spark.createDataFrame(rows, "id int, text string, label int"))
    assert sorted(index.example_id.tolist()) == [*range(40), 60, 70, 71]
    assert X.train(spark.createDataFrame([], "id int, text string, label int")).example_id.tolist() == []


def test_rare_and_many_languages_have_models_and_evidence(spark, monkeypatch):
    rng = random.Random(1)

    def text(letters, n=20):
        return " ".join("".join(rng.choices(letters, k=4)) for _ in range(n))

    rows = [(i, text("abcde"), "en", "a.com") for i in range(12_000)]
    rows += [(20_000 + i, text("uvwxyz"), "xx", "a.com") for i in range(3)]
    # Its text tells nothing; only what it declares does.
    rows += [(30_000, "m", "xx", "a.com")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")
    for hot in (L.HOT_HOSTS, 1):
        monkeypatch.setattr(L, "HOT_HOSTS", hot)
        got = {r.doc_id: r.language for r in L.identify(docs).where("doc_id >= 20000 or doc_id < 100").collect()}
        assert {got[i] for i in range(100)} == {"en"}
        assert {v for k, v in got.items() if k >= 20_000} == {"xx"}
    many = [(i, text("abcdefghij"), f"l{i % 80}", "a.com") for i in range(240)]
    many = spark.createDataFrame(many, docs.schema)
    model = L.fit(many, L.F.col("lang"), L.F.col("text"), L.F.col("doc_id"))
    assert model.languages == sorted(f"l{i}" for i in range(80)) + ["und"]
    # A language of one row that is stored very often keeps its model.
    same = spark.createDataFrame([(1, "same text", "zz", "a.com")] * 50, docs.schema)
    assert L.fit(same, L.F.col("lang"), L.F.col("text"), L.F.col("doc_id"), rows=2).languages == ["zz", "und"]

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from brute import words

from claimlens.llm import filters, middle, ranks

MARKS = re.compile("<[PSM]>")


def _texts(n=200):
    rng = random.Random(8)
    some = ["a", "bc", "Hello", " ", "  ", "\n", "é", "ß", "日本", "😀", "<", ">", "P", "<P", "x>", "1", ".", "\x00"]
    return ["".join(rng.choices(some, k=rng.randint(0, 60))) for _ in range(n)]


def _units(text):
    return re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "", re.DOTALL)


@pytest.mark.parametrize("error", [0, 1, 3, 127])
def test_rank_index_is_exact_and_bounded(error):
    texts = [None, "", "a", *_texts(), "w" * 50_000 + " ." * 9_000 + "q" * 70_000 + "!" * 5_000]
    index = ranks.build(pa.array(texts), error)
    assert index.units().tolist() == [len(_units(t)) for t in texts]
    for i, text in enumerate(texts):
        want = np.cumsum([0] + [len(u) for u in _units(text)])
        at = np.arange(len(want))
        assert index.offsets(np.full(len(want), i), at).tolist() == want.tolist()
        assert (np.abs(index.predicted(index.ptr[i] + at) - want) <= error).all()
    assert (np.abs(index.residual.astype(int)) <= error).all()
    # Every text starts a segment, so that no line runs from one text into the next.
    assert np.isin(index.ptr[:-1], index.first).all()


def test_looser_bounds_need_fewer_segments():
    texts = pa.array(_texts(50))
    sizes = [len(ranks.build(texts, e).first) for e in (0, 2, 8, 127)]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == 50


def _plain_transform(doc_id, text):
    text, units = text or "", _units(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or MARKS.search(text) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_against_a_plain_version(spark):
    texts = [None, "", "x<P>y", "a <M>", "<S>", "<<", "word " * 60_000, *_texts(400)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, "a <M>", "clash"), (None, "no id here", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string")
    got = middle.transform(docs)
    back = got.withColumn("back", middle.restored(got.output, got.form)).collect()
    assert len(back) == len(rows)
    want = Counter((i, *_plain_transform(i, t)) for i, t, _ in rows)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in back) == want
    assert all(r.back == r.text for r in back)
    assert {r.form for r in back} == {"plain", "psm", "spm"}
    assert middle.transform(docs.limit(0)).collect() == []


def _plain_audit(docs, labels):
    """The contract, filter by filter over lists of documents."""
    marks = {}
    for i, q, t in labels:
        g, x = marks.get(i, (False, False))
        marks[i] = (g or q == 1, x or t == 1)
    smallest = {}
    for i, text, _ in docs:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))

    def fails(i, text):
        text = text or ""
        w = words(text)
        return "".join(
            f
            for f, bad in zip(
                "ABCDE",
                (
                    len(w) < 100,
                    100 * len(set(w)) < 80 * len(w),
                    100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                    bool(re.search(r"[#$%&*|]", text)),
                    i is not None and i > smallest[text],
                ),
            )
            if bad
        )

    out = {}
    for part in {p or "" for _, _, p in docs}:
        mine = [(fails(i, t), *(marks.get(i, (0, 0)) if i is not None else (0, 0))) for i, t, p in docs if (p or "") == part]
        total = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                failing = sum(f in d[0] for d in mine)
                out[part, "".join(order), step] = (
                    f, len(left), len(gone), failing - len(gone), sum(d[0] == f for d in mine),
                    sum(bool(d[1]) for d in gone), sum(bool(d[2]) for d in gone),
                )
                total[f] += len(gone)
        for key in [k for k in out if k[0] == part]:
            out[key] = (*out[key][1:], total[out[key][0]])
    return out


def test_filter_audit_against_a_plain_version(spark):
    rng = random.Random(9)

    def text():
        n = rng.choice([0, 5, 99, 100, 101, 140])
        few = rng.random() < 0.4
        body = [rng.choice(["Aa", "BB", "c", "d"]) if few else f"w{j}" for j in range(n)]
        return rng.choice([" ", "\n", " \t"]).join(body) + rng.choice(["", "", "#", "|", "CAPS" * rng.randint(0, 30)])

    docs = [(i, text(), rng.choice(["en", "fr", None])) for i in range(150)]
    docs += [(200 + i, docs[i % 40][1], rng.choice(["en", "de"])) for i in range(60)]
    docs += [(5, docs[5][1], "en"), (5, docs[5][1], "fr"), (5, "another text of an id", "en"), (201, None, None), (300, "", "en")]
    docs += [(None, docs[0][1], "en"), (None, docs[0][1], "en"), (400, "Z" * 100_000, "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 260, 2)] + [(2, 1, 1), (None, 1, 1)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, lang string, mask int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filters.audit(filters.pattern_counts(df, marks)).collect()
    want = _plain_audit(docs, labels)
    assert len(got) == len(want) == 4 * 600
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == want
    assert filters.audit(filters.pattern_counts(df.limit(0), marks)).collect() == []
    assert filters.audit(filters.pattern_counts(df, marks.limit(0))).count() == 2400


def test_labels_are_not_broadcast_by_the_size_of_their_files(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('w', id) AS text", "'en' AS lang")
    # Taken for 320 KB, far below the limit for a broadcast; with all salts they are 20 MB and more.
    labels = spark.range(20_000).selectExpr("id AS doc_id", "1 AS quality", "int(id % 2) AS toxic")
    counts = filters.pattern_counts(docs, labels)
    rows = counts.collect()
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"(\w+Join) \[id#\w+, salt#", plan)) == {"SortMergeJoin"}
    # Too few words, and nothing else.
    assert [tuple(r) for r in rows if r.n] == [("en", 16, 300, 300, 150)]


def test_contractions_of_one_pattern():
    t = np.zeros((1, 3, 2, 2, 2, 2, 2), dtype=np.int64)
    t[0, 0, 1, 0, 1, 0, 0] = 7
    names = filters.steps()[0]
    found = filters.interactions(t)
    a_first, c_first = names.index(("ACBDE", 1)), names.index(("CABDE", 2))
    assert found["removed"][0, a_first] == 7 and found["redundant"][0, a_first + 1] == 7
    assert found["removed"][0, c_first] == 0 and found["unique_fails"].sum() == 0
    assert found["shapley"][0, a_first] == 7 * 60

"""Segments, texts in buckets, sketches, and what is left on disk."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from claimlens.operators import metrics as M
from claimlens.operators import retrieve as R
from claimlens.operators.encode import Lexicon, bucket_weights, lexicon
from claimlens.operators.generate import precomputed
from claimlens.plans.analyze import analyze
from claimlens.session import drop_path, durable, freed, scratch_path, shared_dir
from claimlens.sources import segments as Seg
from claimlens.sources import tables as T
from claimlens.streaming import claims as St

TEXTS = ["the cat sat", "the dog", "a cat and a dog", "", "the the mat", "new words here", None, "the cat"]


def evidence(spark, ids):
    rows = [(i, TEXTS[i % len(TEXTS)], f"u{i}") for i in ids]
    return spark.createDataFrame(rows, "evidence_id long, text string, source_url string")


def state(corpus):
    weights = bucket_weights(corpus.evidence, "evidence_id", "text", corpus.lex)
    vectors = {r.evidence_id: r.embedding for r in corpus.vectors.collect()}
    rows = sorted(map(str, corpus.evidence.collect()))
    return sorted(map(tuple, weights.collect())), vectors, sorted(map(tuple, corpus.lex.df.collect())), corpus.lex.n_docs, rows


def test_segments_equal_one_index(spark, tmp_path):
    path = str(tmp_path / "s")
    for ids in (range(0, 3), range(3, 4), range(4, 20)):
        Seg.append(evidence(spark, ids), path)
    whole = state(R.build_corpus(evidence(spark, range(20))))
    assert state(Seg.read(spark, path)) == whole
    assert len(Seg.live_segments(spark, path)) == 3
    # Only the small ones are put together; a reader of the old ones goes on.
    before = Seg.read(spark, path)
    Seg.compact(spark, path, small=10)
    assert sorted(Seg.live_segments(spark, path).values()) == [4, 16]
    assert state(before) == whole == state(Seg.read(spark, path))
    assert Seg.vacuum(spark, path) == 2 and state(Seg.read(spark, path)) == whole
    Seg.append(evidence(spark, range(20, 23)), path)
    assert state(Seg.read(spark, path)) == state(R.build_corpus(evidence(spark, range(23))))
    assert Seg.compact(spark, path, small=3) is None


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    Seg.append(evidence(spark, range(2)), path)
    # The other writer saw the log as it was before the first commit.
    seen = Seg._log
    monkeypatch.setattr(Seg, "_log", lambda s, p: seen(s, p).where("version < 1"))
    with pytest.raises(Exception, match="already exists"):
        Seg.append(evidence(spark, range(2, 4)), path)
    monkeypatch.undo()
    assert Seg.read(spark, path).lex.n_docs == 2


def test_no_index_is_no_evidence(spark, tmp_path):
    corpus = Seg.read(spark, str(tmp_path / "none"))
    claims = spark.createDataFrame([(1, "the cat")], "claim_id long, text string")
    assert corpus.evidence.count() == 0
    assert R.local_hits(R.claim_vectors(claims, corpus), corpus, 3).collect() == []
    rows = analyze(claims, corpus, precomputed(spark.createDataFrame([], "claim_id long, raw_output string"))).collect()
    assert [(r.claim_id, r.evidence, r.explanation) for r in rows] == [(1, [], "No output")]


def test_texts_in_buckets_stay_where_they_are(spark, tmp_path, monkeypatch):
    name = f"evidence_{uuid.uuid4().hex}"
    T.write_by_id(evidence(spark, range(50)), name, str(tmp_path / "t"), buckets=4)
    stored = spark.table(name)
    corpus = R.Corpus(stored, stored.limit(0), Lexicon(stored.limit(0), 0))
    hits = [(1, 0, 1, 7, 0.5), (1, 0, 2, 49, 0.4), (2, 0, 1, 7, 0.9), (2, 0, 2, 1_000, 0.1)]
    ranked = spark.createDataFrame(hits, "claim_id long, source_rank int, rank int, item_id long, score double")
    monkeypatch.setattr(R, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = R.with_text(ranked, corpus)
        rows = sorted((r.claim_id, r.item_id, r.source, r.text) for r in found.collect())
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {name}")
    assert rows == [(1, 7, "u7", TEXTS[7]), (1, 49, "u49", TEXTS[1]), (2, 7, "u7", TEXTS[7])]
    # The only exchange is that of the hits: none has a text.
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(exchanges) == 1 and "Bucketed: true" in plan and "Broadcast" not in plan


def test_sketches_merge(spark):
    rows = spark.range(60_000).selectExpr("id % 7 as b", "cast(id % 20000 as string) as v", "case id % 3 when 0 then null when 1 then '' else 'x' end as w")
    stored = M.sketch_batches(rows, F.col("b"), "v", "w")
    assert stored.count() == 7
    told = M.merged_counts(stored, "v", "w").first()
    assert told.n_rows == 60_000 and abs(told.n_v / 20_000 - 1) < 0.02 and told.n_w == 2
    one = M.merged_counts(stored.where("b = 1"), "v").first()
    assert abs(one.n_v / rows.where("b = 1").select("v").distinct().count() - 1) < 0.02
    assert M.merged_counts(stored.limit(0), "v").first().n_rows == 0


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names)


def local(path):
    return path.removeprefix("file:")


def test_freed_blocks_leave_nothing(spark):
    root = local(spark.sparkContext.getCheckpointDir() or shared_dir(spark))
    kept = durable(spark.range(10))
    before = files(root)
    with freed(spark):
        inner = durable(spark.range(100))
        with freed(spark):
            assert durable(inner.where("id < 5")).count() == 5
        assert inner.count() == 100 and len(files(root)) > len(before)
    assert files(root) == before and kept.count() == 10
    with pytest.raises(ZeroDivisionError):
        with freed(spark):
            durable(spark.range(3))
            1 / 0
    assert files(root) == before
    path = scratch_path(spark, "gone")
    spark.range(1).write.parquet(path)
    drop_path(spark, path)
    assert not os.path.exists(local(path))


def test_batches_of_a_stream_free_what_they_store_and_count_updates(spark, tmp_path):
    """Three batches, the middle one of blank claims only: it is no update, and no files pile up."""
    land, out, st = (str(tmp_path / n) for n in ("land", "out", "state"))
    corpus = R.build_corpus(evidence(spark, range(8)))
    outs = spark.range(20).selectExpr("id as claim_id", "'It is true' as raw_output")
    root = local(spark.sparkContext.getCheckpointDir())
    left = []
    for batch, text in enumerate(["the cat", " ", "a dog"]):
        rows = [(10 * batch + i, text) for i in range(2)]
        df = spark.createDataFrame(rows, "id long, text string").selectExpr(
            "id", "text", "cast(null as string) label", "timestamp'2024-01-01' timestamp", "'sim' platform"
        )
        df.write.mode("append").parquet(land)
        St.score_claims(
            St.read_claim_stream(spark, land, 10),
            lambda df, n: analyze(df, corpus, precomputed(outs), updates=n),
            out,
            st,
        ).awaitTermination()
        left.append(len(files(root)))
    assert left[0] == left[1] == left[2]
    got = {r.claim_id: r.status for r in spark.read.parquet(out).collect()}
    assert got[0].startswith("1 updates") and got[10] == "No input provided." and got[20].startswith("2 updates")


def test_lexicon_of_segments_weighs_like_one(spark, tmp_path):
    path = str(tmp_path / "s")
    for i in range(4):
        Seg.append(evidence(spark, [i]), path)
    merged, whole = Seg.read(spark, path).lex, lexicon(evidence(spark, range(4)), "evidence_id", "text")
    assert sorted(map(tuple, merged.df.collect())) == sorted(map(tuple, whole.df.collect()))
    assert merged.n_docs == whole.n_docs == 4

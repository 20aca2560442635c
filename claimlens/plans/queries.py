"""Registered queries: each takes (spark, sf_dir) and runs over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimlens import schemas as S
from claimlens.functions import text as X
from claimlens.functions import vectors as Vec
from claimlens.functions import verdict as V
from claimlens.operators import encode as E
from claimlens.operators import generate as G
from claimlens.operators import ledger as L
from claimlens.operators import metrics as M
from claimlens.operators import retrieve as R
from claimlens.operators import postings as I
from claimlens.operators.knn import knn_join
from claimlens.plans import analyze as P
from claimlens.plans.evaluate import evaluate
from claimlens.session import durable, scratch_path
from claimlens.sources import driver_tables as D
from claimlens.sources import segments as Seg
from claimlens.sources import tables as T
from claimlens.streaming import claims as St
from claimlens.streaming import nearest as N
from claimlens.streaming import runs as Runs
from claimlens.streaming import windows as Win

TIME = "yyyy-MM-dd HH:mm:ss"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def evidence_scan(spark, sf):
    return D.table(spark, sf, "documents").select(
        F.col("doc_id").alias("evidence_id"), "text", F.col("source").alias("source_url")
    )


def clean_text(spark, sf):
    docs = D.wide(D.table(spark, sf, "documents"))
    return docs.select("doc_id", X.clean_text(F.col("text")).alias("text"))


def label_normalize(spark, sf):
    raw = D.by_id(F.col("doc_id"), D.RAW_LABELS)
    return D.table(spark, sf, "documents").select(
        "doc_id", raw.alias("raw_label"), X.normalize_label(raw).alias("label")
    )


def _evidence_with_quotes(spark, sf):
    """Evidence with quotes, commas and line breaks of both kinds; some texts null or empty."""
    quoted = F.concat(F.lit('"'), F.col("text"), F.lit('", he said,\r\n""'))
    text = (
        F.when(F.col("evidence_id") % 7 == 3, F.lit(None))
        .when(F.col("evidence_id") % 7 == 5, F.lit(""))
        .when(F.col("evidence_id") % 2 == 0, quoted)
        .otherwise(F.col("text"))
    )
    return D.evidence(spark, sf).withColumn("text", text)


# Column orders of the evidence files; the second has a column that nobody reads.
CSV_ORDERS = (
    ("id", "text", "source_url"),
    ("source_url", "id", "note", "text"),
    ("text", "source_url", "id"),
)


def evidence_csv_roundtrip(spark, sf):
    """Evidence written as CSV files in several column orders and read back, line breaks and all."""
    rows = _evidence_with_quotes(spark, sf).withColumn("id", F.col("evidence_id"))
    rows = rows.withColumn("note", F.lit('a "note",\nin two lines'))
    paths = []
    for n, order in enumerate(CSV_ORDERS):
        paths.append(scratch_path(spark, f"evidence-{n}"))
        T.write_csv(rows.where(F.col("id") % len(CSV_ORDERS) == n).select(*order), paths[-1])
    return T.read_evidence_csv(spark, paths, multi_line=True)


def claims_csv_roundtrip(spark, sf):
    """Labelled claims through CSV; null statements become text."""
    path = scratch_path(spark, "claims")
    raw = D.labeled_raw(spark, sf).select("label", "statement", "source", "doc_id")
    gone = F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 1, " \n")
    T.write_csv(raw.withColumn("statement", gone.otherwise(F.col("statement"))).drop("doc_id"), path)
    return T.read_claims_csv(spark, path, multi_line=True, null_as_text=True)


def claims_load(spark, sf):
    return T.load_labeled_claims(D.labeled_raw(spark, sf))


def corpus_stats(spark, sf):
    return M.corpus_stats(D.evidence(spark, sf))


def source_sketch(spark, sf):
    """Distinct sources, texts and words from sketches stored by batch, beside the exact numbers."""
    path = scratch_path(spark, "sketches")
    kinds = ("source", "text", "word")
    docs = D.table(spark, sf, "documents").select("doc_id", "source", "text")
    words = E.each_term(docs.select(F.col("doc_id").alias("id"), X.tokens(F.col("text")).alias("terms")))
    words = words.select(F.col("id").alias("doc_id"), F.col("token").alias("word"))
    # A source and a text are looked at once per document with a word and not once per word.
    docs = docs.where(X.has_token(F.col("text")))
    for batch in range(3):
        some, which = F.col("doc_id") % 3 == batch, F.col("doc_id") % 3
        of_words = M.sketch_batches(words.where(some), which, "word")
        of_docs = M.sketch_batches(docs.where(some), which, "source", "text").drop("n_rows")
        of_words.join(of_docs, "batch").write.mode("append").parquet(path)
    told = M.merged_counts(spark.read.parquet(path), *kinds)
    # Texts are told apart by their SHA-256, so that they are not shuffled.
    exact = docs.agg(
        F.count_distinct("source").alias("exact_source"), F.count_distinct(F.sha2("text", 256)).alias("exact_text")
    ).join(words.agg(F.count_distinct("word").alias("exact_word")))
    near = [(F.abs(F.col(f"n_{c}") / F.col(f"exact_{c}") - 1) <= 0.02).alias(f"near_{c}") for c in kinds]
    return told.join(F.broadcast(exact)).select("n_rows", *[f"exact_{c}" for c in kinds], *near)


def hashed_embedding(spark, sf):
    docs = D.wide(D.table(spark, sf, "documents"))
    words = E.lexicon(docs, "doc_id", "text")
    # Read for the prices of frequent words and for those of the others: counted once.
    lex = E.Lexicon(durable(words.df), words.n_docs)
    rows = E.bucket_weights(docs, "doc_id", "text", lex)
    return rows.where("bucket >= 0").select(F.col("id").alias("doc_id"), "bucket", "weight")


def l2_normalize(spark, sf):
    scaled = D.table(spark, sf, "embeddings").select(
        "vec_id",
        F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1)).alias("v"),
    )
    unit = Vec.with_unit_vector(scaled, "v")
    return unit.select("vec_id", F.posexplode("v").alias("pos", "value")).select(
        "vec_id", "pos", F.round("value", 6).alias("value")
    )


def cosine_rescore(spark, sf):
    vecs = D.table(spark, sf, "embeddings")
    first = vecs.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("f"))
    return vecs.join(first, "label").select(
        "vec_id",
        F.col("f.vec_id").alias("other_id"),
        Vec.cosine(F.col("embedding"), F.col("f.embedding")).alias("score"),
    )


def knn_topk(spark, sf):
    vecs = D.wide(D.table(spark, sf, "embeddings"))
    return knn_join(vecs, vecs, 6, "vec_id", "vec_id")


def knn_topk_cells(spark, sf):
    """The plan for many queries, with small blocks."""
    vecs = D.table(spark, sf, "embeddings")
    how = {"strategy": "cells", "max_pivots": 16, "block_rows": 64, "cell_rows": 32}
    return knn_join(vecs, vecs, 6, "vec_id", "vec_id", **how)


def knn_dirty_vectors(spark, sf):
    """Null, zero, NaN and infinite vectors among the items, chosen by id."""
    vecs, bad = D.table(spark, sf, "embeddings"), F.pmod(F.col("vec_id"), F.lit(7))
    dirty = vecs.select(
        "vec_id",
        F.when(bad == 1, F.lit(None))
        .when(bad == 2, F.transform("embedding", lambda x: F.lit(0.0)))
        .when(bad == 3, F.transform("embedding", lambda x: F.lit(float("nan"))))
        .when(bad == 4, F.transform("embedding", lambda x, i: F.when(i > 0, x).otherwise(float("inf"))))
        .when(bad == 5, F.transform("embedding", lambda x, i: F.when(i > 0, x)))
        .otherwise(F.col("embedding"))
        .cast("array<float>")
        .alias("embedding"),
    )
    return knn_join(dirty, dirty, 6, "vec_id", "vec_id")


def knn_with_meta(spark, sf):
    corpus = R.build_corpus(D.evidence(spark, sf))
    claims = D.claims(spark, sf)
    hits = R.local_hits(R.claim_vectors(claims, corpus), corpus, P.PIPELINE_K)
    return R.with_text(hits, corpus).select("claim_id", "pos", "item_id", "source", "text", "score")


def knn_with_meta_bucketed(spark, sf):
    """The texts in buckets by id: hits move to them, they stay, with broadcasting off as well."""
    evidence = D.evidence(spark, sf)
    corpus = R.build_corpus(evidence)
    name = f"evidence_{uuid.uuid4().hex}"
    T.write_by_id(evidence, name, scratch_path(spark, "evidence"), buckets=8)
    claims = D.claims(spark, sf)
    hits = R.local_hits(R.claim_vectors(claims, corpus), corpus, P.PIPELINE_K)
    items = spark.table(name).select(
        F.col("evidence_id").alias("item_id"), "text", F.col("source_url").alias("source")
    )
    joined = hits.join(items.hint("merge"), "item_id")
    return joined.select("claim_id", "pos", "item_id", "source", "text", "score")


def corpus_append(spark, sf):
    """Evidence indexed in four appends, some put together in between: the weights of all its words."""
    path = scratch_path(spark, "segments")
    evidence = D.evidence(spark, sf)
    for part in range(4):
        Seg.append(evidence.where(F.col("evidence_id") % 4 == part), path)
        if part == 2:
            Seg.compact(spark, path)
    corpus = Seg.read(spark, path)
    sources = corpus.evidence.select(F.col("evidence_id").alias("id"), "source_url")
    weights = E.bucket_weights(corpus.evidence, "evidence_id", "text", corpus.lex, beside=sources)
    rows = weights.where("bucket >= 0").withColumnRenamed("id", "evidence_id")
    return rows.select("evidence_id", "source_url", "bucket", "weight")


def optional_index(spark, sf):
    """Hits per claim from an index that is there and from one that is not."""
    path = scratch_path(spark, "index")
    Seg.append(D.evidence(spark, sf), path)
    claims = D.claims(spark, sf)

    def hits(corpus, name):
        found = R.local_hits(R.claim_vectors(claims, corpus), corpus, P.PIPELINE_K)
        return found.groupBy("claim_id").agg(F.count(F.lit(1)).alias(name))

    there, missing = Seg.read(spark, path), Seg.read(spark, scratch_path(spark, "none"))
    rows = claims.select("claim_id").join(hits(there, "n_hits"), "claim_id", "left")
    rows = rows.join(hits(missing, "n_missing"), "claim_id", "left")
    return rows.fillna(0, ["n_hits", "n_missing"])


def _article_candidates(spark, sf, articles, depth, rank, **how):
    words = E.lexicon(articles, "item_id", "text")
    source = R.build_source(articles, words)
    hits = R.article_hits(D.claims(spark, sf), source, depth, rank, **how)
    return hits.join(articles.select("item_id", "source", "text"), "item_id").select(
        "claim_id", "pos", "item_id", "source", "text", "relevance"
    )


def wiki_candidates(spark, sf):
    return _article_candidates(
        spark, sf, D.articles(spark, sf), R.ENCYCLOPAEDIA_K, R.ENCYCLOPAEDIA
    )


def wiki_candidates_probe(spark, sf):
    """The plan for many claims: by the rarest words, the rest in blocks."""
    how = {"strategy": "probe", "broadcast_claims": 4, "block_articles": 100, "block_claims": 16}
    articles = D.articles(spark, sf)
    return _article_candidates(spark, sf, articles, R.ENCYCLOPAEDIA_K, R.ENCYCLOPAEDIA, **how)


def wiki_candidates_blocks(spark, sf):
    """All claims against all articles, block by block."""
    how = {"strategy": "scan", "broadcast_claims": 4, "block_articles": 100, "block_claims": 16}
    articles = D.articles(spark, sf)
    return _article_candidates(spark, sf, articles, R.ENCYCLOPAEDIA_K, R.ENCYCLOPAEDIA, **how)


def wiki_candidates_index(spark, sf):
    """From a stored inverted index: the articles are read once, when it is written."""
    path = scratch_path(spark, "index")
    articles = D.articles(spark, sf)
    I.write_index(E.distinct_tokens(articles, "item_id", "body"), path)
    articles.select("item_id", "source", "text").write.parquet(f"{path}/items")
    hits = I.index_join(D.claims(spark, sf), I.read_index(spark, path), R.ENCYCLOPAEDIA_K, "claim_id", "text")
    found = hits.select("claim_id", F.col("rank").alias("pos"), "item_id", F.col("score").alias("relevance"))
    items = spark.read.parquet(f"{path}/items")
    return found.join(items, "item_id").select("claim_id", "pos", "item_id", "source", "text", "relevance")


def news_candidates(spark, sf):
    return _article_candidates(spark, sf, D.news(spark, sf), R.NEWS_K, R.NEWS)


def candidates(spark, sf):
    corpus, claims = D.corpus(spark, sf), D.claims(spark, sf)
    return R.candidates(claims, R.claim_vectors(claims, corpus), corpus, P.PIPELINE_K)


def retrieve(spark, sf):
    return R.retrieve(D.claims(spark, sf), D.corpus(spark, sf), P.PIPELINE_K)


def _letter_model():
    """A stand-in for an embedding model: how often each letter occurs."""

    def call(texts):
        return [[float(t.count(c) + t.count(c.upper())) for c in LETTERS] for t in texts]

    return call


def letter_encoder(id_col: str, text_col: str) -> E.Encoder:
    return E.model_encoder(_letter_model, id_col, text_col)


def retrieve_custom_encoder(spark, sf):
    """Retrieval with a plugged-in encoder for evidence, articles and claims."""
    sources = D.evidence(spark, sf), D.articles(spark, sf), D.news(spark, sf)
    return R.retrieve(D.claims(spark, sf), R.build_corpus(*sources, letter_encoder), P.PIPELINE_K)


def retrieve_stats(spark, sf):
    rows = P.attach_evidence(D.claims(spark, sf), D.corpus(spark, sf))
    return rows.select(
        "claim_id",
        F.size("evidence").alias("n_hits"),
        F.array_max(F.transform("evidence", lambda h: h["score"])).alias("best"),
    )


def prompt(spark, sf):
    rows = P.attach_evidence(D.claims(spark, sf), D.corpus(spark, sf))
    return rows.select(
        "claim_id", V.prompt(F.col("text"), V.evidence_texts(F.col("evidence"))).alias("prompt")
    )


def param_defaults(spark, sf):
    events = D.table(spark, sf, "events")
    given = F.when(
        F.col("event_type") != "error",
        F.create_map(
            F.lit("temperature"),
            F.col("value"),
            F.lit("num_beams"),
            F.get_json_object("props", "$.k").cast("double"),
        ),
    )
    return events.select(
        "event_id", *[c.alias(n) for n, c in V.resolved_params(given).items()]
    )


def _verdict_columns(verdict: str) -> list:
    v = F.col(verdict)
    return [
        v["label"].alias("label"),
        v["confidence"].alias("confidence"),
        v["explanation"].alias("explanation"),
        v["counterfactual"].alias("counterfactual"),
        F.array_join(v["reasoning"], "|").alias("reasoning"),
    ]


def parse_output(spark, sf):
    turns = D.table(spark, sf, "conversations").select(
        "conv_id", "turn", D.raw_output().alias("raw_output")
    )
    return V.with_parsed_output(turns).select("conv_id", "turn", *_verdict_columns("verdict"))


def verdict_rules(spark, sf):
    flat = F.when(F.col("doc_id") % 2 == 0, " flat").otherwise("")
    rows = D.table(spark, sf, "documents").select(
        "doc_id",
        F.concat("text", flat).alias("claim"),
        F.array(D.marked_text()).alias("texts"),
        F.lit('{"label":"True","confidence":0.95,"explanation":"e"}').alias("raw_output"),
    )
    rows = V.with_evidence_rules(V.with_parsed_output(rows), "verdict", "claim", "texts")
    return rows.select("doc_id", *_verdict_columns("verdict"))


def _analysis(spark, sf):
    return P.analyze(
        D.claims(spark, sf), D.corpus(spark, sf), G.precomputed(D.model_outputs(spark, sf))
    )


def _flat(analysis: DataFrame) -> DataFrame:
    hits = F.transform(
        "evidence", lambda h: F.concat_ws(":", h["source"], F.format_string("%.6f", h["score"]))
    )
    return analysis.withColumn("reasoning", F.array_join("reasoning", "|")).withColumn(
        "evidence", F.array_join(hits, "|")
    )


def analyze(spark, sf):
    return _flat(_analysis(spark, sf))


def _claims_with_blanks(spark, sf):
    blank = F.col("claim_id") % 5 == 0
    return D.claims(spark, sf).withColumn("text", F.when(blank, " \n").otherwise(F.col("text")))


def _short_model():
    """A stand-in for a generator: refuses some prompts and has no output for others."""

    def call(prompts, params):
        out = []
        for p in prompts:
            if " flat\n" in p:
                raise ValueError("refused")
            answer = f'{{"label":"True","confidence":0.9,"explanation":"{len(p)} {params["num_beams"]:.0f}"}}'
            out.append(answer if len(p) % 3 else None)
        return out

    return call


def analyze_exits(spark, sf):
    """Blank claims, refused prompts, prompts without output and the rest, with a model."""
    generator = G.model(_short_model, {"temperature": 0.1, "num_beams": None})
    return _flat(P.analyze(_claims_with_blanks(spark, sf), None, generator))


def analyze_no_generator(spark, sf):
    return _flat(P.analyze(_claims_with_blanks(spark, sf), None, None))


def analyze_turns(spark, sf):
    """Every assistant turn as the output for the turn before it."""
    turns = D.table(spark, sf, "conversations")
    key = (F.col("conv_id") * 1000 + F.col("turn")).alias("claim_id")
    claims = turns.select((key + 1).alias("claim_id"), "text")
    answers = turns.where("role = 'assistant'").select(key, D.raw_output().alias("raw_output"))
    asked = claims.join(answers.select("claim_id"), "claim_id", "left_semi")
    return _flat(P.analyze(asked, None, G.precomputed(answers))).drop("status")


def report(spark, sf):
    return P.report(_analysis(spark, sf))


def history_rows(spark, sf):
    return L.history_rows(_analysis(spark, sf))


def _predictions(spark, sf):
    docs = D.labeled_raw(spark, sf)
    word = D.by_id(F.col("doc_id"), (" fake", " true", "", " Fake or true"))
    return docs.select(
        "doc_id",
        F.when((F.col("quality") == 1) & (F.col("doc_id") % 3 == 0), "True").alias("label"),
        F.when((F.col("toxic") == 1) & (F.col("doc_id") % 2 == 0), "Fake").alias("predicted_label"),
        F.concat("statement", word).alias("raw_output"),
        X.normalize_label(F.col("label")).alias("gold"),
    )


def eval_label(spark, sf):
    return M.predicted_labels(_predictions(spark, sf)).select("doc_id", "gold", "pred")


def confusion(spark, sf):
    return M.confusion(M.predicted_labels(_predictions(spark, sf)))


def macro_prf(spark, sf):
    return M.macro_prf(confusion(spark, sf))


def evaluation(spark, sf):
    """The evaluator on the whole pipeline; the gold label of a claim goes by its id."""
    labeled = D.claims(spark, sf).withColumn(
        "label", X.normalize_label(D.by_id(F.col("claim_id"), D.RAW_LABELS))
    )
    return evaluate(
        labeled, D.corpus(spark, sf), G.precomputed(D.model_outputs(spark, sf))
    )


def _text_times(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.date_format(c, TIME))
    return df


def ledger(spark, sf):
    rows = L.ledger(D.batches(spark, sf)).withColumn("loss", F.round("loss", 6))
    return _text_times(rows, "started_at", "finished_at", "last_update")


def ledger_report(spark, sf):
    return L.ledger_report(L.ledger(D.batches(spark, sf)))


def loss_curve(spark, sf):
    return L.loss_curve(L.ledger(D.batches(spark, sf)))


def recent_history(spark, sf):
    events = D.table(spark, sf, "events")
    return L.recent_history(events.select("event_id", "user_id", "event_type", "value"), "event_id")


def history_tail(spark, sf):
    """Two analysed batches, the second delivered twice, written to a history; its last ten entries."""
    path = scratch_path(spark, "history")
    outputs = G.precomputed(D.model_outputs(spark, sf))
    for batch in (0, 1, 1):
        claims = D.claims(spark, sf).where(F.col("claim_id") % 2 == batch)
        T.append_history(L.history_rows(P.analyze(claims, None, outputs), batch), path)
    return T.read_recent(spark, path).drop("status")


def vectors_roundtrip(spark, sf):
    evidence = D.evidence(spark, sf)
    path = scratch_path(spark, "vectors")
    T.write_vectors(evidence, R.build_corpus(evidence).vectors, path)
    back = T.read_vectors(spark, path)
    values = back.select("evidence_id", "source_url", F.posexplode("embedding").alias("pos", "value"))
    return values.where("value <> 0").withColumn("value", F.round(F.col("value").cast("double"), 6))


def _stream_claims(spark, sf):
    labeled = D.labeled_raw(spark, sf)
    rows = labeled.select(
        F.col("doc_id").alias("id"),
        X.clean_text(F.col("statement")).alias("text"),
        X.normalize_label(F.col("label")).alias("label"),
    )
    return St.claim_stream_rows(rows, D.STREAM_START, seed=42)


def claim_stream_rows(spark, sf):
    return _text_times(_stream_claims(spark, sf), "timestamp")


def stream_ingest(spark, sf):
    land, out, state = (scratch_path(spark, n) for n in ("land", "out", "state"))
    St.land_claim_stream(_stream_claims(spark, sf), land, files=4)
    St.append_to(St.read_claim_stream(spark, land, max_files=2), out, state).awaitTermination()
    return _text_times(spark.read.parquet(out), "timestamp")


def stored_corpus(spark, sf) -> R.Corpus:
    """The corpus with its vectors and words written once, for use by many batches."""
    path = scratch_path(spark, "corpus")
    T.write_corpus(D.corpus(spark, sf), path)
    return T.read_corpus(spark, path)


def stream_analyze(spark, sf):
    land, out, state = (scratch_path(spark, n) for n in ("land", "out", "state"))
    claims = D.claims(spark, sf).select(
        F.col("claim_id").alias("id"), "text", F.lit(None).cast("string").alias("label")
    )
    St.land_claim_stream(St.claim_stream_rows(claims, D.STREAM_START), land, files=2)
    corpus = stored_corpus(spark, sf)
    generator = G.precomputed(D.model_outputs(spark, sf))
    St.score_claims(
        St.read_claim_stream(spark, land, max_files=1),
        lambda df, n: P.analyze(df, corpus, generator, updates=n),
        out,
        state,
    ).awaitTermination()
    return _flat(spark.read.parquet(out)).drop("status", "batch_id")


def stream_knn(spark, sf):
    land, out, state = (scratch_path(spark, n) for n in ("land", "out", "state"))
    vecs = D.table(spark, sf, "embeddings")
    vecs.select("vec_id", "embedding").repartition(2, "vec_id").write.parquet(land)
    stream = St.read_claim_stream(spark, land, 1, "vec_id long, embedding array<float>")
    St.per_batch(
        stream, lambda df, _: knn_join(df, vecs, 6, "vec_id", "vec_id"), out, state
    ).awaitTermination()
    return spark.read.parquet(out).drop("batch_id")


def stream_knn_append(spark, sf):
    """Hits of arriving vectors without state and without a function per batch.

    The vectors that arrive are those whose id is divisible by 100, searched among all. More
    vectors than one row can hold are searched batch by batch.
    """
    land, out, state = (scratch_path(spark, n) for n in ("land", "out", "state"))
    vecs = D.table(spark, sf, "embeddings")
    asked = vecs.where(F.col("vec_id") % 100 == 0)
    asked.select("vec_id", "embedding").repartition(2, "vec_id").write.parquet(land)
    stream = St.read_claim_stream(spark, land, 1, "vec_id long, embedding array<float>")
    if N.vector_bytes(vecs) <= N.MAX_BYTES:
        hits = N.nearest(stream, N.corpus_row(vecs, "vec_id"), 6, "vec_id")
        St.append_to(hits, out, state).awaitTermination()
    else:
        St.per_batch(
            stream, lambda df, _: knn_join(df, vecs, 6, "vec_id", "vec_id"), out, state
        ).awaitTermination()
    return spark.read.parquet(out).drop("batch_id")


def _land_events(spark, sf, copies: int = 1):
    land = scratch_path(spark, "events")
    ts = F.col("ts").cast("timestamp").alias("ts")
    events = D.table(spark, sf, "events").select("event_id", ts, "event_type")
    if copies > 1:
        times = F.explode(F.array_repeat(F.lit(1), copies))
        events = events.select("*", times.alias("copy")).drop("copy")
    events.repartitionByRange(4, "event_id").write.parquet(land)
    return St.read_claim_stream(spark, land, 2, "event_id long, ts timestamp, event_type string")


def _latest(spark: SparkSession, out: str) -> DataFrame:
    """The state a complete-mode stream reached: what its last batch wrote."""
    rows = spark.read.parquet(out)
    return rows.where(F.col("batch_id") == rows.select(F.max("batch_id")).scalar()).drop("batch_id")


def stream_ledger(spark, sf):
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    counts = St.run_counters(_land_events(spark, sf), "event_type", "ts")
    St.per_batch(counts, lambda df, _: df, out, state, mode="complete").awaitTermination()
    return _text_times(_latest(spark, out), "last_update")


def stream_run_state(spark, sf):
    """Run counters as keyed state: three deliveries, a restart after each, one of them repeated."""
    land, out, state = (scratch_path(spark, n) for n in ("batches", "out", "state"))
    empty = F.col("batch_seq") % 4 == 3
    batches = D.batches(spark, sf).withColumn("n_rows", F.when(empty, 0).otherwise(F.col("n_rows")))
    third = F.floor(F.col("batch_seq") * 3 / F.lit(batches.agg(F.max("batch_seq") + 1).first()[0] or 1))
    for delivery in ([0], [0, 1], [2]):
        batches.where(third.isin(delivery)).write.mode("append").parquet(land)
        stream = spark.readStream.schema(S.BATCHES).parquet(land)
        with Runs.rocksdb_state(spark):
            rows = Runs.run_state(stream)
            St.per_batch(rows, lambda df, _: df, out, state, mode="update").awaitTermination()
    return _text_times(spark.read.parquet(out).drop("batch_id"), "started_at", "finished_at", "last_update")


def stream_dedup(spark, sf):
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    first = St.drop_repeats(_land_events(spark, sf, copies=2), ["event_id"], "ts", "60 days")
    St.append_to(first, out, state).awaitTermination()
    return _text_times(spark.read.parquet(out), "ts")


def stream_windowed(spark, sf):
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    counts = St.windowed_counts(_land_events(spark, sf), "ts", "event_type", "1 hour", "1 hour")
    St.per_batch(counts, lambda df, _: df, out, state, mode="complete").awaitTermination()
    return _text_times(_latest(spark, out), "window_start")


# Days of events in one delivery, and which of them come with the next one.
DELIVERY_DAYS, HELD_BACK = 8, 17


def stream_windowed_append(spark, sf):
    """Windows given out once, and the rows that came after theirs, from deliveries with stragglers."""
    land, out, first, windows, second = (
        scratch_path(spark, n) for n in ("events", "split", "state", "windows", "state")
    )
    schema = "event_id long, ts timestamp, event_type string"
    ts = F.col("ts").cast("timestamp")
    held = F.when(F.col("event_id") % HELD_BACK == 0, 1).otherwise(0)
    delivery = F.floor(F.datediff("ts", F.lit("2024-01-01")) / DELIVERY_DAYS) + held
    events = D.table(spark, sf, "events").select("event_id", ts.alias("ts"), "event_type", delivery.alias("d"))
    for d in range((events.agg(F.max("d")).first()[0] or 0) + 1):
        events.where(F.col("d") == d).drop("d").write.mode("append").parquet(land)
        stream = spark.readStream.schema(schema).parquet(land)
        Win.split_late(stream, "ts", "1 hour", "2 hours", out, first).awaitTermination()
        counts = Win.closed_windows(Win.in_time_stream(spark, out, schema), "ts", "event_type", "1 hour", "2 hours")
        St.append_to(counts, windows, second).awaitTermination()
    none = F.lit(None)
    closed = spark.read.parquet(windows).select(
        F.lit("window").alias("kind"), "window_start", "event_type", "n", none.cast("long").alias("event_id")
    )
    late = Win.late_rows(spark, out, schema).select(
        F.lit("late").alias("kind"),
        F.window("ts", "1 hour")["start"].alias("window_start"),
        "event_type",
        none.cast("long").alias("n"),
        "event_id",
    )
    return _text_times(closed.unionByName(late), "window_start")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        evidence_scan,
        clean_text,
        label_normalize,
        evidence_csv_roundtrip,
        claims_csv_roundtrip,
        claims_load,
        corpus_stats,
        source_sketch,
        hashed_embedding,
        l2_normalize,
        cosine_rescore,
        knn_topk,
        knn_with_meta,
        knn_with_meta_bucketed,
        corpus_append,
        optional_index,
        wiki_candidates,
        news_candidates,
        knn_topk_cells,
        knn_dirty_vectors,
        wiki_candidates_probe,
        wiki_candidates_blocks,
        wiki_candidates_index,
        candidates,
        retrieve,
        retrieve_stats,
        prompt,
        param_defaults,
        parse_output,
        verdict_rules,
        retrieve_custom_encoder,
        analyze,
        analyze_exits,
        analyze_no_generator,
        analyze_turns,
        report,
        history_rows,
        eval_label,
        confusion,
        macro_prf,
        evaluation,
        ledger,
        ledger_report,
        loss_curve,
        recent_history,
        history_tail,
        vectors_roundtrip,
        claim_stream_rows,
        stream_ingest,
        stream_analyze,
        stream_knn,
        stream_knn_append,
        stream_ledger,
        stream_run_state,
        stream_dedup,
        stream_windowed,
        stream_windowed_append,
    )
}

"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimlens.llm import counts, filters, html, language, middle, minhash, packing, pieces
from claimlens.llm import quality, repetition, substring, toxicity, vectors
from claimlens.llm.tables import fold, table
from claimlens.session import shared_dir


def _vocabulary(name: str) -> str:
    """Path of a public vocabulary file, which every machine has."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return language.identify(docs).select("doc_id", "language", "confidence", "kept")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (fold("doc_id", toxicity.MODULUS) == toxicity.HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        "evidence",
    )


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.with_components(docs).select("doc_id", "component_id", "kept")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pieces.encode_documents(docs, _vocabulary("piece_bpe_32k.model"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = quality.fitted(docs, table(spark, sf_dir, "labels"))
    return quality.with_score(docs, machine).select(
        "doc_id",
        (fold("doc_id", quality.MODULUS) == quality.HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.dedup(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, _vocabulary("byte_bpe_50k.json"), with_ids=False)


def op10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = repetition.quality_rules(table(spark, sf_dir, "documents"))
    return rules.drop("longest_repeat")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = middle.transform(table(spark, sf_dir, "documents"))
    back = middle.restored(F.col("output"), F.col("form"))
    return rows.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(back, 256).alias("restored_sha256"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return filters.audit(filters.pattern_counts(docs, labels))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_language_id": op2_language_id,
    "op3_toxicity": op3_toxicity,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_quality": op7_quality,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_packing": op9_packing,
    "op10_repetition": op10_repetition,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_filter_audit": op12_filter_audit,
    "op13_token_counts": op13_token_counts,
    "pipeline": pipeline,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _covered(name: str, width: int) -> str:
    """CTEs that count, per text, the words in windows found twice or more in that text."""
    return f"""
{name}_w AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {width} + 2)) AS i FROM words),
{name}_k AS (SELECT doc_id, i, array_to_string(ws[i:i + {width} - 1], ' ') AS s FROM {name}_w),
{name}_d AS (SELECT doc_id, s FROM {name}_k GROUP BY doc_id, s HAVING count(*) > 1),
{name}_p AS (SELECT doc_id, unnest(range(i, i + {width})) AS j FROM {name}_k JOIN {name}_d USING (doc_id, s)),
{name} AS (SELECT doc_id, count(DISTINCT j) AS n FROM {name}_p GROUP BY doc_id)"""


ORACLE_SQL = {
    "op4_embedding_dedup": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {vectors.MIN_COSINE}),
reach AS (
  SELECT a AS s, b AS t FROM links UNION SELECT r.s, l.b FROM reach r JOIN links l ON r.t = l.a),
roots AS (SELECT s AS vec_id, min(t) AS low FROM reach GROUP BY s),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN roots USING (vec_id) LEFT JOIN n USING (vec_id)
""",
    "op8_substring_dedup": f"""
WITH words AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {substring.WINDOW} + 2)) AS i FROM words),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + {substring.WINDOW} - 1], ' ') AS s FROM w),
d AS (SELECT s FROM k GROUP BY s HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT j) AS js FROM (
  SELECT doc_id, unnest(range(i, i + {substring.WINDOW})) AS j FROM k JOIN d USING (s)) GROUP BY doc_id),
each AS (SELECT doc_id, ws, coalesce(js, []) AS js FROM words LEFT JOIN gone USING (doc_id)),
place AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM words),
bad AS (SELECT doc_id, unnest(js) AS i FROM gone),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM place ANTI JOIN bad USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(js)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM each LEFT JOIN kept USING (doc_id)
""",
    # Repeats of at least m words cover what the repeated windows of m words cover, and a
    # repeat is longer than n words exactly when a window of n + 1 words is repeated.
    "op10_repetition": f"""
WITH words AS (SELECT doc_id, text, {_WORDS} AS ws FROM documents),
{_covered("base", repetition.WINDOW)},
{_covered("rep", repetition.MIN_REPEAT_WORDS)},
{_covered("long", repetition.MAX_REPEAT_WORDS + 1)},
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
stats AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')), 0)::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(base.n, 0)::BIGINT AS n_repeat_words,
    coalesce(rep.n, 0)::BIGINT AS covered_words, coalesce(long.n, 0) AS n_long
  FROM words LEFT JOIN dup USING (doc_id) LEFT JOIN base USING (doc_id)
    LEFT JOIN rep USING (doc_id) LEFT JOIN long USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words,
  n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > {repetition.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > {repetition.MAX_REPEAT_PERCENT} * n_words)
    AND covered_words <= {repetition.MAX_COVERED} * n_words AND n_long = 0 AS kept
FROM stats
""",
    "op11_fill_in_middle": f"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS us,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT doc_id, text, us, len(us)::BIGINT AS n,
    ('0x' || substr(h, 1, 8))::BIGINT % (len(us) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(us) + 1) AS b,
    text = '' OR contains(text, '{middle.PREFIX}') OR contains(text, '{middle.SUFFIX}')
      OR contains(text, '{middle.MIDDLE}') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= {middle.PLAIN_FROM} AS plain,
    ('0x' || substr(h, 25, 8))::BIGINT % 100 < {middle.SPM_BELOW} AS spm FROM units),
parts AS (
  SELECT doc_id, text, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(us[1:least(a, b)], '') AS p, array_to_string(us[least(a, b) + 1:greatest(a, b)], '') AS m,
    array_to_string(us[greatest(a, b) + 1:], '') AS s FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '{middle.PREFIX}' || p || '{middle.SUFFIX}' || s || '{middle.MIDDLE}' || m
    ELSE '{middle.SUFFIX}' || s || '{middle.PREFIX}' || p || '{middle.MIDDLE}' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
""",
    "op12_filter_audit": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
first AS (SELECT t, min(doc_id) AS low FROM words GROUP BY t),
marked AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
bits AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(ws) < {filters.MIN_WORDS} THEN 16 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(ws)) < {filters.MIN_DISTINCT_PERCENT} * len(ws) THEN 8 ELSE 0 END
    + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > {filters.MAX_CAPITAL_PERCENT} * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 2 ELSE 0 END
    + CASE WHEN doc_id > low THEN 1 ELSE 0 END AS mask
  FROM words JOIN first USING (t) LEFT JOIN marked USING (doc_id)),
counts AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM bits GROUP BY part, mask),
letters(f, bit) AS (VALUES ('A', 16), ('B', 8), ('C', 4), ('D', 2), ('E', 1)),
orders(o, steps) AS (
  SELECT '', 0 UNION ALL SELECT o || f, steps + 1 FROM orders, letters WHERE NOT contains(o, f)),
places AS (
  SELECT o AS filter_order, s AS step, substr(o, s, 1) AS f, substr(o, 1, s - 1) AS before
  FROM (SELECT o, unnest(range(1, 6)) AS s FROM orders WHERE steps = 5)),
each AS (
  SELECT filter_order, step, f, bit, coalesce((SELECT sum(l.bit) FROM letters l WHERE contains(before, l.f)), 0)::INT AS earlier
  FROM places JOIN letters USING (f)),
out AS (
  SELECT part, filter_order, step::INT AS step, f,
    sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & earlier <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM each CROSS JOIN counts GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM out
""",
}

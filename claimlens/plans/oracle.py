"""Check SQL (DuckDB) for the registered queries, over the same tables.

Written from the definitions and not from the Spark code: joins on buckets and words,
window ranks and plain CASE chains.
"""

from __future__ import annotations

SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
WORD_GAP = r"[^\p{L}\p{N}]+"
TIME = "%Y-%m-%d %H:%M:%S"


def clean(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SPACE}+', ' ', 'g'))"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def words(c: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(lower({c}), '{WORD_GAP}'), lambda t: t <> '')"
    )


def label(c: str) -> str:
    low = f"lower({c})"
    return f"""CASE
      WHEN contains({low}, 'true') AND NOT contains({low}, 'mostly') THEN 'True'
      WHEN contains({low}, 'false') OR contains({low}, 'pants-fire')
        OR contains({low}, 'barely-true') THEN 'Fake'
      ELSE 'Uncertain' END"""


def raw_label(c: str) -> str:
    return f"""CASE {c} % 7 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'half-true'
      WHEN 3 THEN 'mostly-true' WHEN 4 THEN 'barely-true' WHEN 5 THEN 'pants-fire'
      ELSE 'unproven' END"""


MARK = """CASE doc_id % 5 WHEN 0 THEN ' debunked' WHEN 1 THEN ' scientific consensus'
  WHEN 2 THEN ' confirm' WHEN 3 THEN ' unclear' ELSE '' END"""


# --- encoder -----------------------------------------------------------------

EVIDENCE = f"ev AS (SELECT doc_id AS id, text || {MARK} AS text, source FROM documents)"
PLAIN_DOCS = "ev AS (SELECT doc_id AS id, text, source FROM documents)"
CLAIMS = """cl AS (SELECT item_id AS id, text || CASE WHEN item_id % 2 = 0 THEN ' flat' ELSE '' END AS text
  FROM benchmark)"""


def counts(t: str) -> str:
    return f"""{t}_tf AS MATERIALIZED (SELECT id, tok, count(*) AS tf FROM
      (SELECT id, unnest({words('text')}) AS tok FROM {t}) GROUP BY id, tok)"""


LEXICON = """lex AS MATERIALIZED (SELECT tok, count(*) AS df FROM ev_tf GROUP BY tok)"""


def weights(t: str) -> str:
    return f"""{t}_w AS MATERIALIZED (SELECT id,
        ('0x' || substr(md5({t}_tf.tok), 1, 8))::BIGINT % 256 AS bucket,
        sum(tf * CAST(round(ln(((SELECT count(*) FROM ev) + 1.0::DOUBLE)
          / (coalesce(df, 0) + 1.0::DOUBLE)) * 1e6) AS BIGINT))::BIGINT AS weight
      FROM {t}_tf LEFT JOIN lex ON {t}_tf.tok = lex.tok GROUP BY 1, 2)"""


def unit(t: str) -> str:
    return f"""{t}_v AS MATERIALIZED (SELECT id, bucket, CAST(weight / nullif(norm, 0) AS FLOAT)::DOUBLE AS v
      FROM (SELECT *, sqrt(sum(weight::DOUBLE * weight::DOUBLE) OVER (PARTITION BY id)) AS norm
            FROM {t}_w))"""


def encoded(t: str) -> list[str]:
    return [counts(t), weights(t), unit(t)]


# --- keyword sources ---------------------------------------------------------

TITLE = "regexp_extract(html, '<title>([^<]*)', 1)"
BODY = clean("regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>', ' ', 'g')")
FIRST = clean("regexp_replace(regexp_extract(html, '(?s)<p>(.*?)</p>', 1), '<[^>]*>', ' ', 'g')")
DESCRIPTION = f"nullif({FIRST}, '')"
LEAD = r"trim(regexp_extract(body, '(?s)^((?:.*?[.!?](?:\s+|$)){1,2})', 1))"

WIKI = f"""wiki AS MATERIALIZED (SELECT id, 'https://en.wikipedia.org/wiki/' || replace(title, ' ', '_') AS source,
    CASE WHEN {LEAD} <> '' THEN {LEAD} ELSE trim(body) END AS text, title || ' ' || body AS body
  FROM (SELECT page_id AS id, {TITLE} AS title, {BODY} AS body FROM pages))"""
NEWS = f"""news AS MATERIALIZED (SELECT page_id AS id, url AS source,
    left({TITLE} || '. ' || coalesce({DESCRIPTION}, ''), 1000) AS text,
    concat_ws(' ', {TITLE}, {DESCRIPTION}, {BODY}) AS body
  FROM pages WHERE regexp_extract(html, 'lang="([a-z]+)"', 1) = 'en')"""


def distinct_words(t: str, col: str) -> str:
    return f"""{t}_terms AS MATERIALIZED
      (SELECT DISTINCT id, tok FROM (SELECT id, unnest({words(col)}) AS tok FROM {t}))"""


def lexical(t: str, depth: int) -> list[str]:
    return [
        distinct_words(t, "body"),
        f"""{t}_idf AS (SELECT tok, 1 + CAST(round(ln(((SELECT count(*) FROM {t}) + 1.0::DOUBLE)
          / (count(*) + 1.0::DOUBLE)) * 1e6) AS BIGINT) AS w FROM {t}_terms GROUP BY tok)""",
        f"""{t}_hits AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER
            (PARTITION BY claim_id ORDER BY relevance DESC, item_id) AS pos
          FROM (SELECT c.id AS claim_id, a.id AS item_id, sum(w)::BIGINT AS relevance
            FROM cl_terms c JOIN {t}_terms a ON c.tok = a.tok JOIN {t}_idf i ON i.tok = a.tok
            GROUP BY 1, 2)) WHERE pos <= {depth})""",
    ]


# --- retrieval ---------------------------------------------------------------

LOCAL_HITS = """local_hits AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER
    (PARTITION BY claim_id ORDER BY score DESC, item_id) AS pos
  FROM (SELECT c.id AS claim_id, e.id AS item_id, round(sum(c.v * e.v), 6) AS score
    FROM cl_v c JOIN ev_v e ON c.bucket = e.bucket GROUP BY 1, 2)) WHERE pos <= 6)"""

BASE = [EVIDENCE, CLAIMS, *encoded("ev")[:1], LEXICON, *encoded("ev")[1:], *encoded("cl"), LOCAL_HITS]
SOURCES = [
    WIKI,
    NEWS,
    distinct_words("cl", "text"),
    *lexical("wiki", 2),
    *lexical("news", 3),
]
CANDIDATES = """cand AS (
  SELECT claim_id, 0 AS source_rank, pos, item_id, score FROM local_hits
  UNION ALL SELECT claim_id, 1, pos, item_id, NULL FROM wiki_hits
  UNION ALL SELECT claim_id, 2, pos, item_id, NULL FROM news_hits)"""


def rescored(t: str, rank: int) -> str:
    return f"""SELECT h.claim_id, {rank} AS source_rank, h.pos, h.item_id,
        round(coalesce(sum(c.v * a.v), 0), 6) AS score
      FROM {t}_hits h LEFT JOIN cl_v c ON c.id = h.claim_id
        LEFT JOIN {t}_v a ON a.id = h.item_id AND a.bucket = c.bucket
      GROUP BY 1, 2, 3, 4"""


RETRIEVE = [
    *BASE,
    *SOURCES,
    *encoded("wiki"),
    *encoded("news"),
    f"""scored AS (SELECT claim_id, 0 AS source_rank, pos, item_id, score FROM local_hits
      UNION ALL {rescored('wiki', 1)} UNION ALL {rescored('news', 2)})""",
    """items AS (SELECT 0 AS source_rank, id AS item_id, source, text FROM ev
      UNION ALL SELECT 1, id, source, text FROM wiki
      UNION ALL SELECT 2, id, source, text FROM news)""",
    """hits AS MATERIALIZED (SELECT claim_id, rank, source_rank, item_id, source, text, score
      FROM (SELECT *, row_number() OVER (PARTITION BY claim_id
              ORDER BY score DESC NULLS LAST, source_rank, pos) AS rank FROM scored)
      JOIN items USING (source_rank, item_id) WHERE rank <= 6)""",
    """found AS (SELECT claim_id, count(*) AS n, max(score) AS best,
        string_agg(text, ' ' ORDER BY rank) FILTER (WHERE text <> '') AS all_text,
        string_agg(source || ':' || printf('%.6f', score), '|' ORDER BY rank) AS evidence
      FROM hits GROUP BY claim_id)""",
    """five AS (SELECT claim_id, string_agg(text, ' ' ORDER BY rank) AS text FROM
        (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY rank) AS n
         FROM hits WHERE text <> '') WHERE n <= 5 GROUP BY claim_id)""",
]


def letters(t: str) -> str:
    """Unit vectors of letter counts, as (id, bucket, v)."""
    count = "length(text) - length(replace(replace(text, chr((97 + b)::INTEGER), ''), chr((65 + b)::INTEGER), ''))"
    return f"""{t}_v AS MATERIALIZED (SELECT id, bucket, CAST(n / norm AS FLOAT)::DOUBLE AS v
      FROM (SELECT *, nullif(sqrt(sum(n * n) OVER (PARTITION BY id)), 0) AS norm
        FROM (SELECT id, b AS bucket, ({count})::DOUBLE AS n FROM {t}, range(26) r(b))))"""


RETRIEVE_BY_LETTERS = [
    EVIDENCE,
    CLAIMS,
    letters("ev"),
    letters("cl"),
    LOCAL_HITS,
    *SOURCES,
    letters("wiki"),
    letters("news"),
    *RETRIEVE[-5:-2],
]
BLANKED = f"""{CLAIMS}, bl AS (SELECT id AS claim_id, CASE WHEN id % 5 = 0 THEN ''
    ELSE {strip('text')} END AS text FROM cl)"""


def sql(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


# --- verdicts ----------------------------------------------------------------

PLAIN = "trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'))"
RAW = f"""CASE (conv_id + turn) % 10
    WHEN 0 THEN '{{"label":"Fake","confidence":0.9,"explanation":"' || {PLAIN} || '"}}'
    WHEN 1 THEN ' {{"label":"True","confidence":"0.8","counterfactual":"' || {PLAIN} || '"}}' || chr(10)
    WHEN 2 THEN '{{}}'
    WHEN 3 THEN '{{"confidence":null,"explanation":"' || {PLAIN} || '"}}'
    WHEN 4 THEN '{{"label":null,"confidence":0.7}}'
    WHEN 5 THEN '{{"label":"True" ' || {PLAIN}
    WHEN 6 THEN '{{"reasoning":["a","' || {PLAIN} || '"]}}'
    WHEN 7 THEN text || ' This is not true.'
    WHEN 8 THEN 'That is true: ' || text
    ELSE text END"""


def json_field(key: str, default: str) -> str:
    return f"CASE WHEN json_exists(doc, '$.{key}') THEN doc ->> '$.{key}' ELSE {default} END"


def parsed(source: str, ids: str) -> list[str]:
    """`parsed` from a table with `ids` and raw_output: label, confidence, ..., reasoning."""
    return [
        f"""p0 AS (SELECT *, {strip('raw_output')} AS t FROM {source})""",
        """p1 AS (SELECT *, starts_with(t, '{') AS is_json,
             CASE WHEN starts_with(t, '{') AND json_valid(raw_output) THEN raw_output END AS doc,
             CASE WHEN contains(lower(raw_output), 'not true') OR contains(lower(raw_output), 'false')
               THEN 'Fake' WHEN contains(lower(raw_output), 'true') THEN 'True'
               ELSE 'Uncertain' END AS kw FROM p0)""",
        """p2 AS (SELECT *, CASE WHEN json_exists(doc, '$.confidence')
             THEN try_cast(doc ->> '$.confidence' AS DOUBLE) ELSE 0.6 END AS conf FROM p1)""",
        f"""parsed AS (SELECT {ids}, raw_output,
            CASE WHEN raw_output IS NULL THEN NULL WHEN NOT is_json THEN kw
              WHEN doc IS NULL OR conf IS NULL THEN 'Uncertain'
              ELSE {json_field('label', "'Uncertain'")} END AS label,
            CASE WHEN raw_output IS NULL THEN NULL
              WHEN NOT is_json THEN CASE WHEN kw = 'Uncertain' THEN 0.5 ELSE 0.8 END
              WHEN doc IS NULL OR conf IS NULL THEN 0.5 ELSE conf END::DOUBLE AS confidence,
            CASE WHEN NOT is_json OR doc IS NULL OR conf IS NULL THEN t
              ELSE {json_field('explanation', "''")} END AS explanation,
            CASE WHEN raw_output IS NULL THEN NULL WHEN NOT is_json OR doc IS NULL OR conf IS NULL
              THEN '' ELSE {json_field('counterfactual', "''")} END AS counterfactual,
            CASE WHEN raw_output IS NULL THEN NULL
              WHEN NOT is_json OR doc IS NULL OR conf IS NULL OR NOT json_exists(doc, '$.reasoning')
              THEN '' ELSE array_to_string(from_json(doc -> '$.reasoning', '["VARCHAR"]'), '|')
              END AS reasoning FROM p2)""",
    ]


def ruled(e: str, c: str) -> str:
    """The corrected columns; e and c are lower-cased evidence and claim."""
    one = " OR ".join(
        f"contains({e}, '{w}')"
        for w in ("anti-scientific", "not true", "false", "hoax", "conspiracy", "debunked")
    )
    two = f"contains({e}, 'scientific consensus') AND contains({c}, 'flat')"
    three = f"contains({e}, 'confirm') OR contains({e}, 'proves')"
    four = f"contains({e}, 'no evidence') OR contains({e}, 'unclear')"
    return f"""
      CASE WHEN {one} OR {two} THEN 'Fake' WHEN {three} THEN 'True'
        WHEN {four} THEN 'Uncertain' ELSE label END AS label,
      CASE WHEN {one} THEN greatest(coalesce(confidence, 0.7), 0.9) WHEN {two} THEN 0.95
        WHEN {three} THEN 0.9 WHEN {four} THEN 0.6 ELSE confidence END::DOUBLE AS confidence,
      CASE WHEN {one} THEN 'Evidence indicates the claim contradicts scientific consensus.'
        WHEN {two} THEN 'Scientific consensus confirms Earth is spherical, not flat.'
        ELSE explanation END AS explanation,
      CASE WHEN {one} THEN 'If verified empirical data supported the claim, it could be true.'
        WHEN {two} THEN 'If all scientific and satellite data were falsified, the claim might appear true.'
        ELSE counterfactual END AS counterfactual, reasoning"""


OUTPUTS = f"""outputs AS (SELECT conv_id AS claim_id, arg_min({RAW}, turn) AS raw_output
  FROM conversations WHERE role = 'assistant' GROUP BY conv_id)"""

ANALYSIS = [
    *RETRIEVE,
    OUTPUTS,
    *parsed("outputs", "claim_id"),
    f"""joined AS (SELECT cl.id AS claim_id, cl.text, raw_output, label, confidence, explanation,
        counterfactual, reasoning, coalesce(lower(all_text), '') AS e, lower(cl.text) AS c,
        coalesce(evidence, '') AS evidence, coalesce(n, 0) AS n
      FROM cl LEFT JOIN parsed ON parsed.claim_id = cl.id LEFT JOIN found ON found.claim_id = cl.id)""",
    f"""ruled AS (SELECT claim_id, text, raw_output, n, evidence, {ruled('e', 'c')} FROM joined)""",
    """analysis AS (SELECT claim_id, text,
        CASE WHEN raw_output IS NULL THEN 'Uncertain' ELSE label END AS label,
        CASE WHEN raw_output IS NULL THEN 0.5 ELSE confidence END AS confidence,
        CASE WHEN raw_output IS NULL THEN 'No output' ELSE explanation END AS explanation,
        CASE WHEN raw_output IS NULL THEN NULL ELSE counterfactual END AS counterfactual,
        CASE WHEN raw_output IS NULL THEN NULL ELSE reasoning END AS reasoning,
        '1 updates, loss=0.450' AS status, evidence, n FROM ruled)""",
]

PROMPT_HEAD = "'You are a fact verification model.' || chr(10) || 'Claim: '"
PROMPT_TAIL = (
    "'Decide whether the claim is True, Fake, or Uncertain based only on the evidence. "
    "Then explain briefly why and give a counterfactual — what would make the claim true. "
    "Respond ONLY in JSON format with keys: label, confidence, explanation, counterfactual.'"
)
BREAK = "chr(10) || chr(10)"

# --- evaluation --------------------------------------------------------------

PREDICTIONS = f"""pr AS (SELECT doc_id, {label(raw_label('doc_id'))} AS gold,
    CASE WHEN quality = 1 AND doc_id % 3 = 0 THEN 'True' END AS label,
    CASE WHEN toxic = 1 AND doc_id % 2 = 0 THEN 'Fake' END AS predicted,
    lower(text || CASE doc_id % 4 WHEN 0 THEN ' fake' WHEN 1 THEN ' true' WHEN 2 THEN ''
      ELSE ' Fake or true' END) AS raw
  FROM documents JOIN labels USING (doc_id)),
  pairs AS (SELECT doc_id, gold, coalesce(label, predicted,
    CASE WHEN contains(raw, 'fake') THEN 'Fake' WHEN contains(raw, 'true') THEN 'True'
      ELSE 'Uncertain' END) AS pred FROM pr)"""
CONFUSION = """universe AS (SELECT gold AS label FROM pairs UNION SELECT pred FROM pairs),
  conf AS (SELECT label, (SELECT count(*) FROM pairs WHERE gold = label AND pred = label) AS tp,
    (SELECT count(*) FROM pairs WHERE gold = label) AS n_gold,
    (SELECT count(*) FROM pairs WHERE pred = label) AS n_pred FROM universe)"""
MACRO = """SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall,
    round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1
  FROM (SELECT CASE WHEN n_pred > 0 THEN tp::DOUBLE / n_pred ELSE 0 END AS p,
    CASE WHEN n_gold > 0 THEN tp::DOUBLE / n_gold ELSE 0 END AS r FROM conf)"""

# --- ledger ------------------------------------------------------------------

LEDGER = [
    """b AS (SELECT event_type AS run_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS batch_seq,
      count(*) AS n_rows, min(ts) AS started_at, max(ts) AS finished_at FROM events GROUP BY 1, 2)""",
    """l AS (SELECT *, (sum(n_rows) OVER w)::BIGINT AS steps, count(*) OVER w AS updates,
      max(finished_at) OVER w AS last_update FROM b
      WINDOW w AS (PARTITION BY run_id ORDER BY batch_seq))""",
]
LOSS = "round(greatest(0.01, 0.5 - 0.05 * updates)::DOUBLE, 6)"

# Batches of which some have no rows: these change nothing.
GAPS = [
    LEDGER[0].replace("b AS (", "b0 AS ("),
    "b AS (SELECT * REPLACE (CASE WHEN batch_seq % 4 = 3 THEN 0 ELSE n_rows END AS n_rows) FROM b0)",
    """l AS (SELECT *, (sum(n_rows) OVER w)::BIGINT AS steps, count(*) FILTER (n_rows > 0) OVER w AS updates,
      max(finished_at) FILTER (n_rows > 0) OVER w AS last_update FROM b
      WINDOW w AS (PARTITION BY run_id ORDER BY batch_seq))""",
]

# A row is late if its window ended two hours before the latest event of earlier deliveries.
LATE_EVENTS = """e AS (SELECT event_id, ts, event_type, time_bucket(INTERVAL '1 hour', ts) AS w,
      date_diff('day', DATE '2024-01-01', ts::DATE) // 8 + CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS d
      FROM events),
    m AS (SELECT d, max(max(ts)) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      - INTERVAL '2 hours' AS mark FROM e GROUP BY d),
    s AS (SELECT e.*, coalesce(w + INTERVAL '1 hour' <= mark, false) AS late FROM e JOIN m USING (d))"""

STREAM_ROWS = f"""SELECT doc_id AS id, {clean('text')} AS text, {label(raw_label('doc_id'))} AS label,
    strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id % 1000), '{TIME}') AS timestamp,
    'sim' AS platform"""

KNN = """SELECT vec_id, item_id, score, rank FROM (SELECT *, row_number() OVER
    (PARTITION BY vec_id ORDER BY score DESC, item_id) AS rank
  FROM (SELECT a.vec_id, b.vec_id AS item_id,
      round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
    FROM embeddings a CROSS JOIN embeddings b)) WHERE rank <= 6"""

# Vectors as `knn_dirty_vectors` changes them, without those that take no part.
CLEAN = """(SELECT vec_id, CASE WHEN vec_id % 7 = 2 THEN list_transform(embedding, lambda x: 0.0::FLOAT)
    ELSE embedding END AS embedding FROM embeddings WHERE vec_id % 7 NOT IN (1, 3, 4, 5))"""


def article_candidates(t: str, depth: int) -> str:
    return sql(
        [CLAIMS, WIKI if t == "wiki" else NEWS, distinct_words("cl", "text"), *lexical(t, depth)],
        f"""SELECT claim_id, pos, item_id, source, text, relevance
          FROM {t}_hits JOIN {t} ON {t}.id = item_id""",
    )


ORACLE_SQL: dict[str, str] = {
    "evidence_scan": "SELECT doc_id AS evidence_id, text, source AS source_url FROM documents",
    "clean_text": f"SELECT doc_id, {clean('text')} AS text FROM documents",
    "label_normalize": f"""SELECT doc_id, {raw_label('doc_id')} AS raw_label,
        {label(raw_label('doc_id'))} AS label FROM documents""",
    "evidence_csv_roundtrip": f"""SELECT doc_id AS evidence_id, CASE WHEN doc_id % 7 = 3 THEN NULL
        WHEN doc_id % 7 = 5 THEN ''
        WHEN doc_id % 2 = 0 THEN '"' || text || {MARK} || '", he said,' || chr(13) || chr(10) || '""'
        ELSE text || {MARK} END AS text, source AS source_url FROM documents""",
    "claims_csv_roundtrip": f"""SELECT CASE doc_id % 5 WHEN 0 THEN 'nan' WHEN 1 THEN ''
        ELSE {clean('text')} END AS text, {label(raw_label('doc_id'))} AS label, source
        FROM documents JOIN labels USING (doc_id)""",
    "claims_load": f"""SELECT * FROM (SELECT {clean('text')} AS text,
        {label(raw_label('doc_id'))} AS label, source
        FROM documents JOIN labels USING (doc_id)) WHERE text <> ''""",
    "corpus_stats": """SELECT count(*) AS n_rows, count(DISTINCT source) AS n_sources
        FROM documents""",
    "source_sketch": f"""SELECT count(*) AS n_rows, count(DISTINCT source) AS exact_source,
        count(DISTINCT text) AS exact_text, count(DISTINCT word) AS exact_word,
        true AS near_source, true AS near_text, true AS near_word
        FROM (SELECT source, text, unnest({words('text')}) AS word FROM documents)""",
    "corpus_append": sql(
        [EVIDENCE, counts("ev"), LEXICON, weights("ev")],
        "SELECT id AS evidence_id, source AS source_url, bucket, weight FROM ev_w JOIN ev USING (id)",
    ),
    "optional_index": """SELECT item_id AS claim_id, least(6, (SELECT count(*) FROM documents)) AS n_hits,
        0::BIGINT AS n_missing FROM benchmark""",
    "hashed_embedding": sql(
        [PLAIN_DOCS, counts("ev"), LEXICON, weights("ev")],
        "SELECT id AS doc_id, bucket, weight FROM ev_w",
    ),
    "l2_normalize": """SELECT vec_id, pos, round(v[pos + 1] / norm, 6) AS value FROM (
        SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm, unnest(range(len(v))) AS pos
        FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (label + 1)) AS v
          FROM embeddings))""",
    "cosine_rescore": """SELECT a.vec_id, b.vec_id AS other_id,
        round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
        FROM embeddings a JOIN embeddings b ON a.label = b.label
        WHERE b.vec_id = (SELECT min(vec_id) FROM embeddings c WHERE c.label = a.label)""",
    "knn_topk": KNN,
    "knn_topk_cells": KNN,
    "knn_dirty_vectors": KNN.replace("FROM embeddings a CROSS JOIN embeddings b", f"FROM {CLEAN} a CROSS JOIN {CLEAN} b"),
    "knn_with_meta": sql(
        BASE,
        """SELECT claim_id, pos, item_id, source, text, score
        FROM local_hits JOIN ev ON ev.id = item_id""",
    ),
    "knn_with_meta_bucketed": sql(
        BASE,
        """SELECT claim_id, pos, item_id, source, text, score
        FROM local_hits JOIN ev ON ev.id = item_id""",
    ),
    "wiki_candidates": article_candidates("wiki", 2),
    "wiki_candidates_probe": article_candidates("wiki", 2),
    "wiki_candidates_blocks": article_candidates("wiki", 2),
    "wiki_candidates_index": article_candidates("wiki", 2),
    "news_candidates": article_candidates("news", 3),
    "candidates": sql([*BASE, *SOURCES, CANDIDATES], "SELECT * FROM cand"),
    "retrieve": sql(RETRIEVE, "SELECT * FROM hits"),
    "retrieve_custom_encoder": sql(RETRIEVE_BY_LETTERS, "SELECT * FROM hits"),
    "analyze_exits": f"""WITH {BLANKED}, p AS (SELECT *, length({PROMPT_HEAD} || text || {BREAK}
          || 'Evidence:' || chr(10) || 'No relevant evidence found.' || {BREAK} || {PROMPT_TAIL}) AS len
        FROM bl), e AS (SELECT *, CASE WHEN text = '' THEN 'blank' WHEN ends_with(text, ' flat') THEN 'error'
          WHEN len % 3 = 0 THEN 'none' ELSE 'ok' END AS kind FROM p)
        SELECT claim_id, text, CASE kind WHEN 'ok' THEN 'True' ELSE 'Uncertain' END AS label,
          CASE kind WHEN 'ok' THEN 0.9 WHEN 'blank' THEN 0.0 ELSE 0.5 END::DOUBLE AS confidence,
          CASE kind WHEN 'ok' THEN len || ' 4' WHEN 'blank' THEN 'Empty input.' WHEN 'error' THEN 'refused'
            ELSE 'No output' END AS explanation,
          CASE kind WHEN 'ok' THEN '' END AS counterfactual, CASE kind WHEN 'ok' THEN '' END AS reasoning,
          CASE kind WHEN 'blank' THEN 'No input provided.' ELSE '1 updates, loss=0.450' END AS status,
          '' AS evidence FROM e""",
    "analyze_no_generator": f"""WITH {BLANKED}
        SELECT claim_id, text, 'Uncertain' AS label, CASE WHEN text = '' THEN 0.0 ELSE 0.5 END::DOUBLE AS confidence,
          CASE WHEN text = '' THEN 'Empty input.' ELSE 'Generator not available.' END AS explanation,
          NULL::VARCHAR AS counterfactual, NULL::VARCHAR AS reasoning,
          CASE WHEN text = '' THEN 'No input provided.' ELSE 'Skipped (no generator)' END AS status,
          '' AS evidence FROM bl""",
    "retrieve_stats": sql(
        RETRIEVE,
        """SELECT cl.id AS claim_id, coalesce(n, 0) AS n_hits, best
        FROM cl LEFT JOIN found ON claim_id = cl.id""",
    ),
    "prompt": sql(
        RETRIEVE,
        f"""SELECT cl.id AS claim_id, {PROMPT_HEAD} || cl.text || {BREAK} || 'Evidence:' || chr(10)
          || coalesce(five.text, 'No relevant evidence found.') || {BREAK} || {PROMPT_TAIL} AS prompt
        FROM cl LEFT JOIN five ON claim_id = cl.id""",
    ),
    "param_defaults": """SELECT event_id, 256.0::DOUBLE AS max_length,
        CASE WHEN event_type = 'error' THEN 0.7 ELSE coalesce(value, 0.7) END::DOUBLE AS temperature,
        CASE WHEN event_type = 'error' THEN 4.0
          ELSE coalesce(try_cast(props ->> '$.k' AS DOUBLE), 4.0) END::DOUBLE AS num_beams,
        1.2::DOUBLE AS repetition_penalty FROM events""",
    "parse_output": sql(
        [
            f"turns AS (SELECT conv_id, turn, {RAW} AS raw_output FROM conversations)",
            *parsed("turns", "conv_id, turn"),
        ],
        """SELECT conv_id, turn, label, confidence, explanation, counterfactual, reasoning
        FROM parsed""",
    ),
    "verdict_rules": f"""SELECT doc_id, {ruled('e', 'c')} FROM (SELECT doc_id,
        lower(text || CASE WHEN doc_id % 2 = 0 THEN ' flat' ELSE '' END) AS c,
        lower(text || {MARK}) AS e, 'True' AS label, 0.95 AS confidence, 'e' AS explanation,
        '' AS counterfactual, '' AS reasoning FROM documents)""",
    "analyze": sql(
        ANALYSIS,
        """SELECT claim_id, text, label, confidence, explanation, counterfactual, reasoning,
        status, evidence FROM analysis""",
    ),
    "analyze_turns": sql(
        [
            f"outputs AS (SELECT conv_id, turn, {RAW} AS raw_output FROM conversations WHERE role = 'assistant')",
            *parsed("outputs", "conv_id, turn"),
        ],
        f"""SELECT conv_id * 1000 + turn AS claim_id, {strip('b.text')} AS text,
        CASE WHEN {strip('b.text')} = '' THEN 'Uncertain' ELSE label END AS label,
        CASE WHEN {strip('b.text')} = '' THEN 0.0 ELSE confidence END AS confidence,
        CASE WHEN {strip('b.text')} = '' THEN 'Empty input.' ELSE explanation END AS explanation,
        CASE WHEN {strip('b.text')} <> '' THEN counterfactual END AS counterfactual,
        CASE WHEN {strip('b.text')} <> '' THEN reasoning END AS reasoning, '' AS evidence
        FROM parsed p JOIN conversations b USING (conv_id) WHERE b.turn = p.turn - 1""".replace(
            "conv_id * 1000 + turn", "conv_id * 1000 + p.turn"
        ),
    ),
    "report": sql(
        ANALYSIS,
        """SELECT claim_id, coalesce(label, 'Uncertain') AS label,
        printf('%.2f', coalesce(confidence, 0.0)) AS confidence,
        coalesce(explanation, '') AS explanation,
        CASE WHEN coalesce(counterfactual, '') = '' THEN '—' ELSE counterfactual END AS counterfactual,
        status, n::INTEGER AS n_evidence FROM analysis""",
    ),
    "history_rows": sql(
        ANALYSIS,
        """SELECT claim_id, left(text, 80) AS preview, coalesce(label, 'Uncertain') AS label,
        confidence, status FROM analysis""",
    ),
    "eval_label": f"WITH {PREDICTIONS} SELECT doc_id, gold, pred FROM pairs",
    "confusion": f"WITH {PREDICTIONS}, {CONFUSION} SELECT * FROM conf",
    "macro_prf": f"WITH {PREDICTIONS}, {CONFUSION} {MACRO}",
    "evaluation": sql(
        [
            *ANALYSIS,
            f"""pairs AS (SELECT {label(raw_label('claim_id'))} AS gold,
              coalesce(label, 'Uncertain') AS pred FROM analysis)""",
            CONFUSION,
        ],
        MACRO,
    ),
    "ledger": sql(
        LEDGER,
        f"""SELECT run_id, batch_seq, n_rows, strftime(started_at, '{TIME}') AS started_at,
        strftime(finished_at, '{TIME}') AS finished_at, steps, updates,
        strftime(last_update, '{TIME}') AS last_update, {LOSS} AS loss FROM l""",
    ),
    "ledger_report": sql(
        LEDGER,
        """SELECT run_id, max(steps) AS steps, max(updates) AS updates,
        printf('%d updates, loss=%.3f', max(updates), greatest(0.01, 0.5 - 0.05 * max(updates))::DOUBLE)
          AS status,
        strftime(max(last_update), '%a %b ') || lpad(day(max(last_update))::VARCHAR, 2, ' ')
          || strftime(max(last_update), ' %H:%M:%S %Y') AS last_update,
        round(sum(epoch_us(finished_at) - epoch_us(started_at)) / 1e6, 2) AS seconds
        FROM l GROUP BY run_id""",
    ),
    "loss_curve": sql(LEDGER, f"SELECT run_id, updates AS update, {LOSS} AS loss FROM l"),
    "recent_history": """SELECT event_id, user_id, event_type, value FROM events
        ORDER BY event_id DESC LIMIT 10""",
    "history_tail": sql(
        [CLAIMS, OUTPUTS, *parsed("outputs", "claim_id")],
        """SELECT id % 2 AS seq, id AS claim_id, left(cl.text, 80) AS preview,
        CASE WHEN raw_output IS NULL THEN 'Uncertain' ELSE coalesce(label, 'Uncertain') END AS label,
        CASE WHEN raw_output IS NULL THEN 0.5 ELSE confidence END AS confidence
        FROM cl LEFT JOIN parsed ON claim_id = id ORDER BY id % 2 DESC, id DESC LIMIT 10""",
    ),
    "vectors_roundtrip": sql(
        [EVIDENCE, counts("ev"), LEXICON, weights("ev"), unit("ev")],
        """SELECT ev.id AS evidence_id, source AS source_url, bucket::INTEGER AS pos,
        round(v, 6) AS value FROM ev_v JOIN ev USING (id) WHERE v <> 0""",
    ),
    "claim_stream_rows": STREAM_ROWS
    + ", md5('42:' || doc_id) AS arrival FROM documents JOIN labels USING (doc_id)",
    "stream_ingest": STREAM_ROWS + " FROM documents JOIN labels USING (doc_id)",
    "stream_analyze": sql(
        ANALYSIS,
        """SELECT claim_id, text, label, confidence, explanation, counterfactual, reasoning,
        evidence FROM analysis""",
    ),
    "stream_knn": KNN,
    "stream_knn_append": f"SELECT * FROM ({KNN}) WHERE vec_id % 100 = 0",
    "stream_run_state": sql(
        GAPS,
        f"""SELECT run_id, batch_seq, n_rows, strftime(started_at, '{TIME}') AS started_at,
        strftime(finished_at, '{TIME}') AS finished_at, steps, updates,
        strftime(last_update, '{TIME}') AS last_update FROM l""",
    ),
    "stream_windowed_append": f"""WITH {LATE_EVENTS}
        SELECT 'window' AS kind, strftime(w, '{TIME}') AS window_start, event_type, count(*) AS n,
          NULL::BIGINT AS event_id FROM s
        WHERE NOT late AND w + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '2 hours' FROM s WHERE NOT late)
        GROUP BY w, event_type
        UNION ALL SELECT 'late', strftime(w, '{TIME}'), event_type, NULL, event_id FROM s WHERE late""",
    "stream_ledger": f"""SELECT event_type, count(*) AS steps,
        strftime(max(ts), '{TIME}') AS last_update FROM events GROUP BY 1""",
    "stream_dedup": f"SELECT event_id, strftime(ts, '{TIME}') AS ts, event_type FROM events",
    "stream_windowed": f"""SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '{TIME}')
        AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2""",
}

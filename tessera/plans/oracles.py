"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from tessera.functions import text as tx
from tessera.plans.parameters import LABEL, QUERY, QUERY_VECTOR, REPEATED, STOPWORD_QUERY

TOKENS = "regexp_extract_all(strip_accents(lower(coalesce({0}, ''))), '[a-z0-9]+')"
VECTOR = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY_VECTOR) + "]"
BM25_TERM = "q.qtf * ln(1 + (s.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * tf.l / s.avgdl))"


def text_list(items) -> str:
    return ", ".join("'" + i.replace("'", "''") + "'" for i in items)


def bm25_ctes(query: str, docs: str = "SELECT doc_id AS id, text AS document FROM documents") -> str:
    terms = tx.query_terms(query)
    rows = ", ".join(f"('{t}', {n}, {i})" for i, (t, n) in enumerate(terms))
    values = f"(VALUES {rows}) v(term, qtf, ord)" if terms else "(SELECT '' AS term, 0 AS qtf, 0 AS ord WHERE false) v"
    return f"""
d AS (SELECT id, {TOKENS.format('document')} AS t FROM ({docs})),
s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
q AS (SELECT * FROM {values}),
p AS (SELECT id, len(t) AS l, unnest(t) AS term FROM d),
tf AS (SELECT p.id, p.l, p.term, count(*) AS tf FROM p JOIN q ON p.term = q.term GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT tf.id, sum({BM25_TERM}) AS score, min(q.ord) AS ord
       FROM tf JOIN q ON tf.term = q.term JOIN df ON tf.term = df.term, s GROUP BY tf.id),
ranked AS (SELECT id, score, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, ord, id) - 1 AS INTEGER) AS rank FROM sc)"""


def bm25(query: str, k: int) -> str:
    return f"WITH {bm25_ctes(query)} SELECT id, round(score, 6) AS score, rank FROM ranked WHERE rank < {k}"


def nearest(where: str = "true") -> str:
    return f"""
SELECT id, distance, CAST(row_number() OVER (ORDER BY round(distance, 9), id) - 1 AS INTEGER) AS rank FROM (
  SELECT vec_id AS id, 1 - list_inner_product(e, {VECTOR})
         / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product({VECTOR}, {VECTOR}))) AS distance
  FROM (SELECT *, embedding::DOUBLE[] AS e FROM embeddings WHERE {where}))"""


EMBEDDED = (
    "SELECT d.doc_id AS id, d.text AS document, d.source AS video_id, e.label, e.embedding "
    "FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id"
)


def hybrid_ctes(query: str, weight: float = 1.0, where: str = "true", least: float = 0.0, lexical: bool = True) -> str:
    """found: (id, video_id, distance, vector_rank, lexical_rank, score, pos)."""
    return f"""
{bm25_ctes(query, EMBEDDED)},
corpus AS ({EMBEDDED}),
v AS (SELECT * FROM ({nearest(f"{where} AND vec_id IN (SELECT doc_id FROM documents)")}) WHERE rank < 50),
l AS (SELECT r.id, row_number() OVER (ORDER BY r.rank) - 1 AS rank FROM ranked r JOIN corpus c ON r.id = c.id
      WHERE r.rank < 50 AND {where} AND {str(lexical).lower()}),
f AS (SELECT coalesce(v.id, l.id) AS id, v.distance, v.rank AS vr, l.rank AS lr FROM v FULL JOIN l ON v.id = l.id),
g AS (SELECT *, CASE WHEN (SELECT count(*) FROM l) = 0 THEN 1.0::DOUBLE / (60 + vr)
                ELSE coalesce(1.0::DOUBLE / (61 + vr), 0) + coalesce({weight}::DOUBLE / (61 + lr), 0) END AS score FROM f),
found AS (SELECT g.id, c.video_id, g.distance, CAST(vr AS INTEGER) AS vector_rank, CAST(lr AS INTEGER) AS lexical_rank, score,
    CAST(row_number() OVER (ORDER BY round(score, 12) DESC, lr IS NULL, coalesce(lr, vr), g.id) - 1 AS INTEGER) AS pos
  FROM g JOIN corpus c ON g.id = c.id WHERE score >= {least})"""


SHOWN = """SELECT id, coalesce(round(distance, 6), -1.0::DOUBLE) AS distance, coalesce(vector_rank, -1) AS vector_rank,
  coalesce(lexical_rank, -1) AS lexical_rank, pos, round(score, 8) AS score FROM """


def hybrid(*args, **named) -> str:
    return f"WITH {hybrid_ctes(*args, **named)} {SHOWN} found"


LINES = """
SELECT conv_id AS video_id, CAST(turn * 1000 + line AS INTEGER) AS pos, (turn * 1000 + line) * 10.0::DOUBLE AS start,
       (turn * 1000 + line) * 10.0::DOUBLE + 9 AS "end", text
FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line
      FROM conversations)"""
STRIPPED = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
KEYWORD = rf"(?i)(^|[^\p{{L}}\p{{N}}_])({tx.NOT_SPEECH})($|[^\p{{L}}\p{{N}}_])"
STOP = r"""[.!?…]+["''”’)\]]*\s*$"""


def noise(c: str) -> str:
    wrapped = r"^[\[\(*{<]+\s*([^\n]*?)\s*[\]\)}*>]+$"
    words = rf"regexp_extract_all({c}, '\S+')"
    return f"""({c} = '' OR NOT regexp_matches({c}, '[\\p{{L}}\\p{{N}}]')
  OR (regexp_matches({c}, '{wrapped}') AND regexp_matches(regexp_extract({c}, '{wrapped}', 1), '{KEYWORD}'))
  OR (len({words}) >= 4 AND len(list_distinct({words})) = 1))"""


CHUNKS = rf"""
a AS (SELECT video_id, pos, start, "end", {STRIPPED.format('text')} AS text FROM ({LINES})),
b AS (SELECT video_id AS v, start, "end", text, CAST(row_number() OVER (PARTITION BY video_id ORDER BY pos) - 1 AS INTEGER) AS seg,
             count(*) OVER (PARTITION BY video_id) AS n, len(regexp_extract_all(text, '\S+')) AS w,
             regexp_matches(text, '{STOP}') AS stop
      FROM a WHERE NOT {noise('text')}),
fold AS (
  SELECT v, seg, CASE WHEN w >= 160 AND seg + 1 < n THEN 0 ELSE w END AS acc,
         CASE WHEN w >= 160 AND seg + 1 < n THEN 1 ELSE 0 END AS cut FROM b WHERE seg = 0
  UNION ALL
  SELECT b.v, b.seg, CASE WHEN f.acc + b.w >= 160 AND b.seg + 1 < b.n THEN 0 ELSE f.acc + b.w END,
         CASE WHEN f.acc + b.w >= 160 AND b.seg + 1 < b.n THEN 1 ELSE 0 END
  FROM fold f JOIN b ON b.v = f.v AND b.seg = f.seg + 1),
c AS (SELECT b.*, coalesce(sum(f.cut) OVER (PARTITION BY b.v ORDER BY b.seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS passed,
             sum(f.cut) OVER (PARTITION BY b.v) AS cuts,
             coalesce(max(CASE WHEN f.cut = 1 THEN b.seg + 1 END) OVER (PARTITION BY b.v), 0) AS tail
      FROM b JOIN fold f ON b.v = f.v AND b.seg = f.seg),
e AS (SELECT *, max(CASE WHEN stop AND seg > tail THEN seg END) OVER (PARTITION BY v) AS stop_at FROM c),
greedy AS (SELECT v, start, "end", text, seg, w,
             CAST(CASE WHEN seg < tail THEN passed WHEN stop_at IS NOT NULL AND seg <= stop_at THEN cuts
                  ELSE cuts + seg - coalesce(stop_at, tail) END AS INTEGER) AS block FROM e),
m1 AS (SELECT *, sum(w) OVER (PARTITION BY v, block) AS bw, row_number() OVER (PARTITION BY v, block ORDER BY seg) = 1 AS head FROM greedy),
m2 AS (SELECT *, CAST(sum(CASE WHEN head AND bw >= 25 THEN 1 ELSE 0 END) OVER (PARTITION BY v ORDER BY seg) AS INTEGER) AS grp FROM m1),
m3 AS (SELECT *, coalesce(sum(CASE WHEN grp = 0 THEN w END) OVER (PARTITION BY v), 0) AS lead_words, max(grp) OVER (PARTITION BY v) AS groups FROM m2),
merged AS (SELECT v, start, "end", text, seg, w,
             CASE WHEN lead_words < 25 AND groups > 0 THEN greatest(grp, 1) ELSE grp END AS block FROM m3),
t1 AS (SELECT *, row_number() OVER (PARTITION BY v, block ORDER BY seg) AS i, sum(w) OVER (PARTITION BY v, block) AS total,
              last_value(w) OVER (PARTITION BY v, block ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_w,
              min(block) OVER (PARTITION BY v) AS first_block FROM merged),
trimmed AS (SELECT v, start, "end", text, seg, w, block FROM t1
  WHERE NOT (i = 1 AND block > first_block AND w < 30 AND total - last_w >= 30
             AND list_contains([{text_list(tx.LINKING_WORDS)}], trim(lower(regexp_extract(text, '\S+')), ',.;:'))))"""


def clock(seconds: str) -> str:
    x = f"CAST(round_even(greatest(coalesce({seconds}, 0), 0), 0) AS BIGINT)"
    return f"CASE WHEN {x} // 3600 > 0 THEN printf('%02d:%02d:%02d', {x} // 3600, ({x} % 3600) // 60, {x} % 60) ELSE printf('%02d:%02d', ({x} % 3600) // 60, {x} % 60) END"


def stamp(seconds: str) -> str:
    x = f"CAST(round_even(greatest(coalesce({seconds}, 0), 0) * 1000, 0) AS BIGINT)"
    return f"printf('%02d:%02d:%02d.%03d', {x} // 3600000, ({x} % 3600000) // 60000, ({x} % 60000) // 1000, {x} % 1000)"


def chunked(name: str) -> str:
    return f"WITH RECURSIVE {CHUNKS} SELECT v AS video_id, seg, block FROM {name}"


CHUNK_FULL = rf"""
WITH RECURSIVE {CHUNKS},
j AS (SELECT v, block, string_agg(text, ' ' ORDER BY seg) AS document, arg_min(start, seg) AS st, arg_max("end", seg) AS en FROM trimmed GROUP BY v, block),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY v ORDER BY block) - 1 AS INTEGER) AS i, CAST(count(*) OVER (PARTITION BY v) AS INTEGER) AS total FROM j)
SELECT v || '_chunk_' || printf('%04d', i) AS id, document, CAST(v AS VARCHAR) AS video_id, 'Vídeo sem título' AS title,
       '{tx.WATCH_URL}' || v || '&t=' || CAST(floor(st) AS BIGINT) || 's' AS timestamp_url, st AS start_time, en AS end_time,
       {clock('st')} AS start_str, {clock('en')} AS end_str, i AS chunk_index, total AS total_chunks,
       CAST(len(regexp_extract_all(document, '\S+')) AS INTEGER) AS word_count, CAST(length(document) AS INTEGER) AS char_count
FROM k"""

ENTITIES = [("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def cleaned(c: str) -> str:
    """Entities that the tables hold; one pass each, the ampersand last, so that nothing is decoded twice."""
    out = rf"regexp_replace(regexp_replace({c}, '(?i)</?c[^>]*>|</?v[^>]*>|\{{\\[^}}]*\}}', '', 'g'), '<[^>]+>', '', 'g')"
    for name, char in ENTITIES:
        out = f"replace({out}, '{name}', '{char}')"
    out = rf"regexp_replace({out}, '&amp([^;a-z0-9]|$)', '&\1', 'g')"
    return rf"trim(regexp_replace(trim(regexp_replace({out}, '\s+', ' ', 'g')), '{tx.TIMING}', '', 'g'))"


CUES = rf"""
r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pos) AS i, lag(text) OVER (PARTITION BY video_id ORDER BY pos) AS prev
      FROM ({LINES}) WHERE trim(text) <> ''),
raw AS (SELECT video_id AS path, i, start, "end", CASE WHEN i % 2 = 0 THEN concat_ws(' ', prev, text) ELSE text END AS t FROM r),
cues AS (SELECT path, i, start, "end", {cleaned("replace(t, '-->', '->')")} AS text FROM raw),
useful AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY i) AS i, start, "end", text,
                  regexp_extract_all(text, '\S+') AS w FROM cues WHERE regexp_matches(text, '[\p{{L}}\p{{N}}]'))"""
DEDUPE = rf"""
said AS (
  SELECT path, i, start, "end", w AS said, w AS last, text AS t FROM useful WHERE i = 1
  UNION ALL
  SELECT path, i, start, "end", said, CASE WHEN said IS NULL THEN last ELSE said END, array_to_string(said, ' ') FROM (
    SELECT u.path, u.i, u.start, u."end", s.last,
           CASE WHEN cut = 0 AND s.last = u.w THEN NULL
                WHEN len(u.w) - cut = 0 OR NOT regexp_matches(array_to_string(u.w[cut + 1:], ' '), '[\p{{L}}\p{{N}}]') THEN NULL
                ELSE u.w[cut + 1:] END AS said
    FROM said s JOIN (SELECT * FROM useful) u ON u.path = s.path AND u.i = s.i + 1,
         LATERAL (SELECT coalesce(list_filter(range(least(len(s.last), len(u.w)), 1, -1),
                  lambda n: s.last[len(s.last) - n + 1:] = u.w[1:n])[1], 0) AS cut))),
segments AS (SELECT path, i, start, greatest(start, "end") AS "end", t AS text FROM said WHERE said IS NOT NULL)"""

MANIFEST = """
SELECT doc_id AS k, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 13 * 300.0::DOUBLE END AS m, CASE WHEN doc_id % 4 <> 0 THEN 2 END AS c FROM labels"""


def selection(force: bool) -> str:
    f = str(force).lower()
    return f"""
SELECT doc_id AS video_id,
       CASE WHEN k IS NULL OR c IS DISTINCT FROM 2 OR {f} OR n_chars > coalesce(m, 0) THEN 'process' ELSE 'skip' END AS action,
       k IS NOT NULL AND (c IS DISTINCT FROM 2 OR (NOT {f} AND n_chars > coalesce(m, 0))) AS altered
FROM documents LEFT JOIN ({MANIFEST}) ON doc_id = k"""


# Fixed values, which results depend on; written out, so that they check the registry.
REGISTRY = r"""
  ('Alibaba-NLP/gte-Qwen2-1.5B-instruct', 1536, 'Instruct: Given a web search query, retrieve relevant passages that answer the query' || chr(10) || 'Query: ', NULL, false, true, 'e934663d506a3fa8'),
  ('infly/inf-retriever-v1-1.5b', 1536, 'query: ', 'passage: ', false, true, '9c73fcff80873f7f'),
  ('dunzhang/stella_en_1.5B_v5', 1536, 's2p_query: ', 's2p_document: ', false, true, 'c871eca8a0073d91'),
  ('BAAI/bge-m3', 1024, NULL, NULL, false, true, '644c5ecc5cb0d23b'),
  ('intfloat/multilingual-e5-large', 1024, 'query: ', 'passage: ', false, true, 'b8dc4f7aae6f4d26'),
  ('sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2', 384, NULL, NULL, false, true, '5c0a45719eeccf97'),
  ('text-embedding-3-small', 1536, NULL, NULL, false, true, '932e7020eee92bdc'),
  ('text-embedding-3-large', 3072, NULL, NULL, false, true, '1ebf40ea2ed715b7')"""
RESOLVED = """
  ('BAAI/bge-m3', 'BAAI/bge-m3'), ('infly/inf-retriever-v1-5b', 'infly/inf-retriever-v1-1.5b'),
  ('someone/STELLA-large', 'dunzhang/stella_en_1.5B_v5'), ('text-embedding-3-small', 'text-embedding-3-small'),
  ('me/unknown-model', NULL), ('x/multilingual-e5-base', 'intfloat/multilingual-e5-large')"""
EXPORT = f"SELECT video_id, {{0}} AS content FROM ({LINES}) GROUP BY video_id"

ORACLES: dict[str, str] = {
    "tokenize_docs": f"SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)",
    "term_frequency": f"SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY ALL",
    "document_frequency": f"SELECT term, count(DISTINCT id) AS df FROM (SELECT doc_id AS id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY term",
    "corpus_stats": f"SELECT count(*) AS n, round(coalesce(avg(len({TOKENS.format('text')})), 0), 6) AS avgdl FROM documents",
    "bm25_topk": bm25(QUERY, 20),
    "bm25_repeated_term": bm25(REPEATED, 20),
    "bm25_stopword_only": bm25(STOPWORD_QUERY, 20),
    "bm25_multi_query": f"""
WITH d AS (SELECT doc_id AS id, {TOKENS.format('text')} AS t FROM documents),
s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
p AS (SELECT id, len(t) AS l, unnest(t) AS term FROM d),
tf AS (SELECT id, l, term, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
b AS (SELECT item_id AS qid, list_filter({TOKENS.format('text')}, lambda x: NOT list_contains([{text_list(sorted(set(tx.STOPWORDS)))}], x)) AS t FROM benchmark),
q AS (SELECT qid, term, count(*) AS qtf, min(ord) AS ord FROM (SELECT qid, unnest(t) AS term, generate_subscripts(t, 1) AS ord FROM b) GROUP BY ALL),
sc AS (SELECT q.qid, tf.id, sum({BM25_TERM}) AS score, min(q.ord) AS ord FROM tf JOIN q ON tf.term = q.term JOIN df ON tf.term = df.term, s GROUP BY ALL)
SELECT qid, id, round(score, 6) AS score, rank FROM (
  SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, ord, id) - 1 AS INTEGER) AS rank FROM sc) WHERE rank < 5""",
    "cosine_topk": f"SELECT id, round(distance, 6) AS distance, rank FROM ({nearest()}) WHERE rank < 20",
    "cosine_topk_filtered": f"SELECT id, round(distance, 6) AS distance, rank FROM ({nearest(f'label = {LABEL}')}) WHERE rank < 20",
    "l2_normalize": """
SELECT vec_id, pos - 1 AS pos, round(e[pos] / sqrt(list_inner_product(e, e)), 6) AS x
FROM (SELECT vec_id, embedding::DOUBLE[] AS e, generate_subscripts(embedding, 1) AS pos FROM embeddings)""",
    "dim_validate": "SELECT vec_id FROM embeddings WHERE len(embedding) = 64",
    "rrf_fusion": hybrid(QUERY),
    "rrf_weighted": hybrid(QUERY, weight=5.0),
    "rrf_vector_only": hybrid(QUERY, lexical=False),
    "hybrid_empty_lexical": hybrid("xyzzy plugh"),
    "hybrid_filtered": hybrid(QUERY, where=f"label = {LABEL}"),
    "hybrid_min_score": hybrid(QUERY, least=0.014),
    "hybrid_diversified": f"""
WITH {hybrid_ctes(QUERY)},
o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pos) > 1 AS over_most FROM found),
r AS (SELECT * REPLACE (CAST(row_number() OVER (ORDER BY over_most, pos) - 1 AS INTEGER) AS pos) FROM o)
{SHOWN} r WHERE pos < 10""",
    "result_labels": f"""
WITH {hybrid_ctes(QUERY)}
SELECT id, concat_ws(' + ', 'vetorial #' || (vector_rank + 1), 'lexical #' || (lexical_rank + 1)) AS origin,
       CASE WHEN distance IS NULL THEN 'lexical' ELSE printf('cosseno %.3f', distance) END AS distance_label, printf('RRF %.4f', score) AS score_label
FROM found""",
    "diversify": """
WITH o AS (SELECT doc_id, source AS video_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS pos FROM documents),
m AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pos) > 2 AS over_most FROM o)
SELECT doc_id, video_id, CAST(row_number() OVER (ORDER BY over_most, pos) - 1 AS INTEGER) AS pos FROM m""",
    "point_lookup": "SELECT doc_id AS id, source AS video_id FROM documents WHERE source <> 'src0' AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "noise_filter": f"""
SELECT doc_id, line, {noise('c')} AS noise, regexp_matches(t, '{STOP}') AS stop FROM (
  SELECT doc_id, line, t, {STRIPPED.format('t')} AS c FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents))""",
    "segments_valid": """
SELECT user_id AS video_id, event_id AS pos, least(a, z) AS start, greatest(a, z) AS "end", event_type AS text FROM (
  SELECT *, value AS a, CASE WHEN event_id % 3 = 0 OR k = 0 THEN value ELSE k END AS z
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)) WHERE event_type <> 'error'""",
    "chunk_greedy": chunked("greedy"),
    "chunk_merged": chunked("merged"),
    "chunk_trimmed": chunked("trimmed"),
    "chunk_full": CHUNK_FULL,
    "format_seconds": f"SELECT event_id, {clock('value * CASE WHEN event_id % 2 = 0 THEN 1.0::DOUBLE ELSE 50.0::DOUBLE END')} AS label FROM events",
    "vtt_timestamp": f"SELECT event_id, {stamp('value')} AS label FROM events",
    "timestamp_url": r"""
SELECT page_id, base || '?' || CASE WHEN q <> '' THEN q || '&' ELSE '' END || 't=' || CAST(floor(page_id * 7.9::DOUBLE) AS BIGINT) || 's' || frag AS url FROM (
  SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS base, regexp_extract(url, '\?([^#]*)', 1) AS q, regexp_extract(url, '(#.+)$', 1) AS frag FROM pages)""",
    "caption_time_parse": """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0.0::DOUBLE
       ELSE round(round_even(value * 1000, 0) / 1000, 3) END AS seconds FROM events""",
    "caption_clean": f"SELECT page_id, {cleaned('html')} AS text FROM pages",
    "caption_cues": f'WITH {CUES} SELECT path, start, "end", text FROM useful',
    "caption_dedupe": f'WITH RECURSIVE {CUES}, {DEDUPE} SELECT path, start, "end", text FROM segments',
    "caption_best_source": f"""
WITH RECURSIVE {CUES}, {DEDUPE},
n AS (SELECT path, count(*) AS b, count(*) FILTER (WHERE i <= 3) AS a FROM segments GROUP BY path)
SELECT CAST(path AS VARCHAR) AS video_id, path || CASE WHEN a >= b THEN '/a' ELSE '/b' END AS path, greatest(a, b) AS n_segments FROM n""",
    "anti_join_pending": "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "duration_filter": """
SELECT event_id FROM events WHERE event_type <> 'error' AND (event_id % 7 = 0 OR event_id % 11 = 0 OR value >= 60)""",
    "incremental_select": selection(False),
    "incremental_forced": selection(True),
    "incremental_counts": f"""
SELECT count(*) FILTER (WHERE action = 'process') AS to_process, count(*) FILTER (WHERE action = 'skip') AS ignored,
       count(*) FILTER (WHERE altered) AS altered FROM ({selection(False)})""",
    "manifest_rebuild": "SELECT source AS video_id, count(*) AS chunks FROM documents WHERE coalesce(source, '') <> '' GROUP BY source",
    "upsert_replace": """
SELECT doc_id AS id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, CAST(quality - 10 AS BIGINT) FROM labels""",
    "delete_by_key": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "bot_errors": "SELECT event_id, event_type = 'error' AND event_id % 5 = 3 AS bot FROM events",
    "video_url": f"""
SELECT page_id, CASE WHEN u LIKE 'http%' THEN u ELSE '{tx.WATCH_URL}' || page_id END AS url FROM (
  SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 2 = 0 THEN 'id' || page_id ELSE url END AS u FROM pages)""",
    "model_registry": f"SELECT * FROM (VALUES {REGISTRY}) r(name, dimension, query_prefix, document_prefix, lowercase, normalize, fingerprint)",
    "model_resolve": f"SELECT * FROM (VALUES {RESOLVED}) r(model, registered)",
    "embed_prepare": rf"""
SELECT doc_id, 'passage: ' || {STRIPPED.format("coalesce(text, '')")} AS input, {STRIPPED.format("replace(text, chr(10), ' ')")} AS line FROM documents""",
    "vtt_export": EXPORT.format(
        "'WEBVTT' || chr(10) || chr(10) || string_agg("
        + stamp("start") + " || ' --> ' || " + stamp('"end"') + " || chr(10) || replace(text, '-->', '->') || chr(10), chr(10) ORDER BY pos)"
    ),
    "txt_export": EXPORT.format(STRIPPED.format("string_agg(text, chr(10) ORDER BY pos)") + " || chr(10)"),
    "output_names": r"""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '20240101' ELSE 'SEM_DATA' END || ' - '
       || left(trim(regexp_replace(strip_accents(url), '[^A-Za-z0-9._-]+', '_', 'g'), ' ._'), 110) || ' [' || page_id || ']' AS name FROM pages""",
    "index_end_to_end": f"""
SELECT id, document, video_id, start_time, end_time, CAST(16 AS INTEGER) AS dimension, 1.0::DOUBLE AS norm FROM ({CHUNK_FULL})""",
    "index_limit": f"""
SELECT video_id, count(*) AS chunks, CAST(video_id AS DOUBLE) AS mtime, CAST(2 AS INTEGER) AS chunker, left(sha256('{{"dimensao": 16, "lowercase": false, "nome": "stub", "normalizar": true, "prefixo_documento": "passage: ", "prefixo_query": null}}'), 16) AS fingerprint
FROM ({CHUNK_FULL}) WHERE CAST(video_id AS BIGINT) IN (SELECT conv_id FROM conversations GROUP BY conv_id ORDER BY conv_id LIMIT 100) GROUP BY video_id""",
    "index_manifest": f"""
SELECT video_id, count(*) AS chunks, CAST(video_id AS DOUBLE) AS mtime, CAST(2 AS INTEGER) AS chunker FROM ({CHUNK_FULL}) GROUP BY video_id""",
    "result_blocks": f"""
WITH {hybrid_ctes(QUERY)}
SELECT f.id, f.pos, concat_ws(chr(10),
  printf('[%d] %s | RRF %.4f | ', pos + 1, CASE WHEN distance IS NULL THEN 'lexical' ELSE printf('cosseno %.3f', distance) END, score)
    || concat_ws(' + ', 'vetorial #' || (vector_rank + 1), 'lexical #' || (lexical_rank + 1)),
  '  Vídeo:  ' || coalesce(f.video_id, '(sem título)'), CASE WHEN f.id % 2 = 0 THEN '  Data:   20240229' END,
  '  Momento: ' || {clock('f.id')} || ' → ??:??  (bloco ' || (f.id + 1) || ' de 9)', '  Link:   ' || coalesce('https://h/' || f.video_id, ''),
  '  Trecho:', '    ' || {STRIPPED.format('c.document')}) AS block
FROM found f JOIN corpus c ON f.id = c.id WHERE pos < 10""",
    "bot_failure_runs": """
WITH r AS (SELECT user_id AS run, event_id AS pos, event_type = 'click' AS ok, event_type <> 'click' AND event_id % 4 <> 0 AS bot FROM events),
s AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY pos) AS since FROM r),
f AS (SELECT *, CAST(sum(CASE WHEN bot THEN 1 ELSE 0 END) OVER (PARTITION BY run, since ORDER BY pos) AS BIGINT) AS failures FROM s),
m AS (SELECT run, min(pos) AS last FROM f WHERE failures >= 3 AND bot GROUP BY run)
SELECT f.run, f.pos, failures, coalesce(f.pos = m.last, false) AS stop FROM f LEFT JOIN m ON f.run = m.run WHERE m.last IS NULL OR f.pos <= m.last""",
    "asr_segments": f"""
SELECT video_id, start, "end", {STRIPPED.format('text')} AS text FROM ({LINES}) WHERE {STRIPPED.format('text')} <> ''""",
    "asr_language": "SELECT doc_id, CASE WHEN doc_id % 3 <> 1 THEN lower(lang) END AS language FROM documents",
    "done_list": "SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM labels",
}

"""The fixtures as DuckDB SQL: common table expressions that the queries' SQL builds on."""

from codexmill.functions.text import FOLD_FROM, FOLD_TO

WRITES = """
writes AS (
  SELECT d.doc_id AS seq, 'node:' || substr(regexp_replace(lower(d.source), '[^a-z0-9]+', '-', 'g'), 1, 24) || ':' || substr(sha256(d.text), 1, 12) AS id, d.text AS body,
         CASE WHEN d.doc_id % 10 = 0 THEN 'exogenous' ELSE 'endogenous' END AS type, substr(d.text, 1, 40) AS title, '' AS summary, d.source AS original_document_name, sha256(d.text) AS source_material_hash,
         CASE WHEN l.toxic = 1 THEN 'deleted' WHEN l.quality = 0 THEN 'stale' ELSE 'active' END AS status, CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE d.lang END AS cluster,
         strftime(TIMESTAMP '2024-01-01' + to_seconds(d.doc_id), '%Y-%m-%dT%H:%M:%S') AS written_at
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
NODES = WRITES + """,
nodes AS (
  SELECT id, body, type, title, summary, original_document_name, source_material_hash, status, cluster, first_at AS created_at, written_at AS updated_at
  FROM (SELECT *, min(written_at) OVER (PARTITION BY id) AS first_at, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM writes) WHERE rn = 1)"""
EDGE_WRITES = NODES + """,
ties AS (
  SELECT seq, id AS s, lead(id) OVER (PARTITION BY original_document_name ORDER BY seq) AS t, 'follows' AS label FROM writes
  UNION ALL SELECT a.seq, a.id, b.id, 'supports' FROM writes a JOIN writes b ON b.seq = CASE WHEN a.seq % 10 = 0 THEN a.seq + 30 ELSE (a.seq // 10 + 1) * 10 END
  UNION ALL SELECT a.seq, a.id, b.id, 'reference' FROM writes a JOIN writes b ON b.seq = a.seq + 1 WHERE a.seq % 10 = 0
  UNION ALL SELECT a.seq, a.id, b.id, 'contradicts' FROM writes a JOIN writes b ON b.seq = a.seq + 7 WHERE a.seq % 13 = 0
  UNION ALL SELECT a.seq, b.id, a.id, 'related' FROM writes a JOIN writes b ON b.seq = a.seq + 7 WHERE a.seq % 26 = 0
  UNION ALL SELECT seq, id, 'node:missing:' || seq, 'related' FROM writes WHERE seq % 250 = 1),
edge_writes AS (
  SELECT seq, 'edge:' || substr(sha256(s || '|' || t || '|' || label), 1, 16) AS id, s AS source_node_id, t AS target_node_id, label,
         strftime(TIMESTAMP '2024-01-01' + to_seconds(seq), '%Y-%m-%dT%H:%M:%S') AS created_at, CASE WHEN seq % 11 = 0 THEN strftime(TIMESTAMP '2024-01-01' + to_seconds(seq), '%Y-%m-%dT%H:%M:%S') END AS invalid_at
  FROM ties WHERE t IS NOT NULL)"""
EDGES = EDGE_WRITES + """,
edges AS (SELECT * EXCLUDE (rn, seq) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM edge_writes) WHERE rn = 1),
live AS (SELECT * FROM edges WHERE invalid_at IS NULL),
active AS (SELECT id FROM nodes WHERE status = 'active')"""


def chunk_sql(size: int, overlap: int, source: str = "nodes") -> str:
    """(id, ordinal, start, end, chunk) of the windows of ``body``; ordinals count windows that are not blank."""
    step = size - overlap
    return f"""
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS ordinal, i * {step} AS start_char, least(i * {step} + {size}, length(body)) AS end_char, substr(body, i * {step} + 1, {size}) AS chunk
  FROM (SELECT id, body, unnest(range(0, greatest(0, ceil((length(body) - {size}) / {step}::DOUBLE))::BIGINT + 1)) AS i FROM {source} WHERE body <> '')
  WHERE regexp_matches(substr(body, i * {step} + 1, {size}), '[^\\s]')"""


def terms(column: str) -> str:
    """The keyword index's terms of a column."""
    return f"regexp_extract_all(translate(lower({column}), '{FOLD_FROM}', '{FOLD_TO}'), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"


def tokens(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '[a-z0-9_./:-]+')"


def bm25_sql(docs: str, queries: str) -> str:
    """CTEs up to ``scores`` (query_id, id, score) from CTEs docs (id, text) and queries (query_id, text)."""
    return f"""
doc_terms AS (SELECT id, {terms('text')} AS t FROM {docs}),
stats AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM doc_terms),
asked AS (SELECT query_id, term, count(*) AS weight FROM (SELECT query_id, unnest({terms('text')}) AS term FROM {queries}) GROUP BY ALL),
tf AS (SELECT id, len(t) AS length, term, count(*) AS tf FROM (SELECT id, t, unnest(t) AS term FROM doc_terms) WHERE term IN (SELECT term FROM asked) GROUP BY id, t, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scores AS (
  SELECT query_id, id, round(sum(weight * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))), 9) AS score
  FROM tf JOIN df USING (term) JOIN asked USING (term) CROSS JOIN stats GROUP BY query_id, id)"""


QUESTIONS = f"questions AS (SELECT item_id::VARCHAR AS query_id, array_to_string(list_slice(list_distinct_ordered, 1, 3), ' ') AS text FROM (SELECT item_id, list_transform(list_filter(list_zip(t, range(1, len(t) + 1)), lambda x: list_position(t, x[1]) = x[2]), lambda x: x[1]) AS list_distinct_ordered FROM (SELECT item_id, {terms('text')} AS t FROM benchmark)))"
INDEX = "docs AS (SELECT id, concat_ws(' ', nullif(title, ''), nullif(body, '')) AS text FROM nodes WHERE status <> 'deleted')"
PAGES = "pages_ AS (SELECT 'conv' || conv_id AS document, turn AS ord, conv_id || ':' || turn AS id, coalesce(text, '') AS body, role FROM conversations)"
LOG = """log AS (
  SELECT user_id AS job_id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'cancelled' ELSE 'queued' END AS status,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id, value FROM events),
jobs AS (SELECT job_id, arg_max(status, seq) AS status, arg_min(event_id, seq) AS created FROM log GROUP BY job_id)"""
KNN = """vec AS (SELECT 'v' || vec_id AS id, vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
dist AS (SELECT q.id AS query_id, c.id AS id, list_distance(q.v, c.v) AS d FROM vec q CROSS JOIN vec c WHERE q.vec_id < 10),
knn AS (SELECT query_id, rank, id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM dist) WHERE rank <= {k})"""
#: The parts that pages are compared by: normalised claims, keywords and tokens (tok) as sets, and the entity.
COMPARED = f"""sha256(body) AS hash, list_filter(list_distinct(list_transform(string_split(body, '. ')[1:3], lambda c: array_to_string({tokens('c')}, ' '))), lambda x: x <> '') AS claims,
  list_distinct(tok) AS words, list_transform(list_filter(list_zip(tok, range(1, len(tok) + 1)), lambda z: list_position(tok, z[1]) = z[2])[1:6], lambda z: z[1]) AS keywords, coalesce(tok[1], '') AS entity"""
REVISIONS = f"""d AS (SELECT source AS document, doc_id AS ord, doc_id::VARCHAR AS id, text AS body FROM documents),
old AS (SELECT * EXCLUDE (tok), {COMPARED} FROM (SELECT *, {tokens('body')} AS tok FROM d WHERE ord % 2 = 0)),
new AS (SELECT * EXCLUDE (tok), {COMPARED} FROM (SELECT *, {tokens('body')} AS tok FROM (SELECT * FROM d WHERE ord % 2 = 1 UNION ALL SELECT document, ord, 'n' || id, body FROM d WHERE ord % 4 = 0 UNION ALL SELECT document, ord, 'n' || id, body || ' revised edition' FROM d WHERE ord % 8 = 2)))"""


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


def shared(part: str) -> str:
    """CTE ``{part}_j`` (o, n, j): the Jaccard measure of a part for pairs of a document that share something of it."""
    side = lambda t: f"(SELECT document, id, len({part}) AS size, unnest({part}) AS x FROM {t})"
    return f"{part}_j AS (SELECT a.id AS o, b.id AS n, count(*)::DOUBLE / (any_value(a.size) + any_value(b.size) - count(*)) AS j FROM {side('old')} a JOIN {side('new')} b ON a.document = b.document AND a.x = b.x GROUP BY a.id, b.id)"


#: All pairs of a document with their score.
SCORED = f"""{shared('claims')}, {shared('keywords')}, {shared('words')}, scored AS (
  SELECT o.document, o.id AS old_id, o.ord AS old_ord, n.id AS new_id, n.ord AS new_ord,
         least(1.0, greatest(coalesce(c.j, 0.0), 0.8 * coalesce(k.j, 0.0), 0.65 * coalesce(w.j, 0.0)) + CASE WHEN o.entity <> '' AND o.entity = n.entity THEN 0.2 ELSE 0.0 END) AS score
  FROM old o JOIN new n ON o.document = n.document LEFT JOIN claims_j c ON c.o = o.id AND c.n = n.id LEFT JOIN keywords_j k ON k.o = o.id AND k.n = n.id LEFT JOIN words_j w ON w.o = o.id AND w.n = n.id)"""


def set_digest(table: str, name: str) -> str:
    """CTEs up to one row ``name``_root (its digest, its number) over the ids of a table: leaves of about 256 by hash prefix, then levels of 16."""
    return f"""
{name}_size AS (SELECT count(DISTINCT id) AS n, greatest(0, ceil(ln(greatest(1, count(DISTINCT id)) / 256.0) / ln(16) - 1e-9))::INTEGER AS depth FROM {table}),
{name}_leaf AS (SELECT substr(sha256(id), 1, depth) AS p, sha256(string_agg(id, '|' ORDER BY id)) AS d, any_value(depth) AS depth, any_value(n) AS n FROM (SELECT DISTINCT id FROM {table}), {name}_size GROUP BY 1),
{name}_two AS (SELECT substr(p, 1, 2) AS p, CASE WHEN any_value(depth) > 2 THEN sha256(string_agg(p || ':' || d, '|' ORDER BY p)) ELSE any_value(d) END AS d, any_value(depth) AS depth, any_value(n) AS n FROM {name}_leaf GROUP BY 1),
{name}_one AS (SELECT substr(p, 1, 1) AS p, CASE WHEN any_value(depth) > 1 THEN sha256(string_agg(p || ':' || d, '|' ORDER BY p)) ELSE any_value(d) END AS d, any_value(depth) AS depth, any_value(n) AS n FROM {name}_two GROUP BY 1),
{name}_root AS (SELECT CASE WHEN any_value(depth) > 0 THEN sha256(string_agg(p || ':' || d, '|' ORDER BY p)) ELSE any_value(d) END AS {name}d, any_value(n) AS {name}n FROM {name}_one)"""

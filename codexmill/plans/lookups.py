"""Queries of the three kinds of lookup, of item rows, titles of notes, and the dump of the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexmill.functions import text
from codexmill.operators import knn, search, store, views

from . import fixtures as fx
from . import sql as q
from .queries import query

HITS = f"""{q.INDEX}, {q.QUESTIONS}, {q.bm25_sql('docs', 'questions')},
  top AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM scores WHERE id IN (SELECT id FROM active)) WHERE r <= 50)"""


@query(f"WITH {q.EDGES}, {HITS} SELECT DISTINCT query_id, e.id, label FROM edges e JOIN top ON top.id IN (source_node_id, target_node_id)")
def query_by_keyword(spark, d):
    n = fx.nodes(spark, d)
    hits = search.keyword_search(fx.live_docs(n), None, fx.questions(spark, d), 50)
    return views.query("Keyword", hits, n, fx.edges(spark, d))[1]


# Vectors with an id that 100 divides ask for the 5 nearest nodes; each is found with what lies two hops around.
@query(f"""WITH {q.EDGES}, body AS (SELECT n.id, e.embedding::DOUBLE[] AS v, seq FROM (SELECT id, max(seq) AS seq FROM writes GROUP BY id) n JOIN embeddings e ON e.vec_id = n.seq),
  near AS (SELECT 'q' || a.vec_id AS query_id, b.id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.v), b.id) AS r FROM embeddings a CROSS JOIN body b WHERE a.vec_id % 100 = 0),
  starts AS (SELECT query_id AS seed, id FROM near WHERE r <= 5),
  ends AS (SELECT source_node_id AS a, target_node_id AS b FROM live UNION ALL SELECT target_node_id, source_node_id FROM live),
  one AS (SELECT DISTINCT seed, b AS id FROM starts JOIN ends ON a = id WHERE b IN (SELECT id FROM active) EXCEPT SELECT seed, id FROM starts),
  two AS (SELECT DISTINCT seed, b AS id FROM one JOIN ends ON a = one.id WHERE b IN (SELECT id FROM active) EXCEPT (SELECT seed, id FROM one UNION SELECT seed, id FROM starts))
  SELECT seed, id, 0::BIGINT AS depth FROM starts UNION ALL SELECT seed, id, 1 FROM one UNION ALL SELECT seed, id, 2 FROM two""")
def query_by_vector(spark, d):
    asked = fx.table(spark, d, "embeddings").filter(F.col("vec_id") % 100 == 0).select(F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("query_id"), F.col("embedding").alias("v"))
    hits = knn.knn(asked, fx.body_vectors(spark, d), 5)
    return views.query("vector", hits, fx.nodes(spark, d), fx.edges(spark, d), 5)[0]


@query(f"""WITH {q.NODES}, {q.QUESTIONS}, items AS (SELECT id AS node_id, 'small_chunk' AS field, ordinal, start_char, end_char, chunk AS text FROM ({q.chunk_sql(512, 80)}) UNION ALL SELECT id, 'title', 0, NULL, NULL, title FROM nodes WHERE title <> ''),
  docs AS (SELECT substr(sha256(node_id || '|' || field || '|' || ordinal), 1, 12) AS id, * FROM items), {q.bm25_sql('docs', 'questions')}
  SELECT query_id, rank, id, node_id, field, ordinal::BIGINT AS ordinal, start_char::BIGINT AS start_char, end_char::BIGINT AS end_char, round(score, 6) AS score FROM (
    SELECT s.query_id, s.score, d.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s.id) AS rank FROM scores s JOIN docs d ON d.id = s.id JOIN nodes n ON n.id = node_id WHERE status = 'active') WHERE rank <= 150""")
def item_hits(spark, d):
    """The 150 best titles and small chunks of each question, with all columns of the item but its text."""
    n = fx.nodes(spark, d)
    items = fx.items(n).filter(F.col("field") != "big_chunk")
    hits = search.keyword_search(items.select("id", "text", "live"), None, fx.questions(spark, d), 150)
    return views.item_rows(hits, items).select("query_id", "rank", "id", "node_id", "field", "ordinal", "start_char", "end_char", F.round("score", 6).alias("score"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'what of ' || doc_id || '?' WHEN doc_id % 3 = 0 THEN 'Head ' || doc_id WHEN doc_id % 2 = 0 THEN 'of ' || source WHEN doc_id % 3 = 1 THEN lang || ' line' ELSE 'Agent note' END AS title FROM documents""")
def note_titles(spark, d):
    """Titles of notes whose question, heading, origin or first line is there or not."""
    doc, nothing = F.col("doc_id").cast("string"), F.lit("")
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# Head "), doc, F.lit("\nx"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("\n "), "lang", F.lit(" line \nmore"))).otherwise(nothing)
    origin = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("agent: of "), "source")).otherwise(nothing)
    question = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("  what   of "), doc, F.lit("? "))).otherwise(nothing)
    return fx.table(spark, d, "documents").select("doc_id", text.note_title(body, origin, question).alias("title"))


@query(f"""WITH {q.NODES}, parts AS (SELECT id AS node_id, 'title' AS field, 0 AS ordinal, NULL AS start_char, title AS text FROM nodes UNION ALL SELECT id, 'summary', 0, NULL, substr(body, 1, 100) FROM nodes
    UNION ALL SELECT id, 'claim', i - 1, NULL, string_split(body, '. ')[i] FROM nodes, (SELECT unnest([1, 2, 3]) AS i) WHERE i <= len(string_split(body, '. '))
    UNION ALL SELECT id, 'small_chunk', ordinal, start_char, chunk FROM ({q.chunk_sql(512, 80)}) UNION ALL SELECT id, 'big_chunk', ordinal, start_char, chunk FROM ({q.chunk_sql(3000, 300)})),
  bare AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS said FROM parts)
  SELECT substr(sha256(node_id || '|' || field || '|' || ordinal), 1, 12) AS id, node_id, field, ordinal::BIGINT AS ordinal, start_char::BIGINT AS start_char, sha256(said) AS text_hash FROM bare WHERE said <> ''""")
def evidence_items(spark, d):
    return fx.all_items(fx.nodes(spark, d)).select("id", "node_id", "field", "ordinal", "start_char", F.sha2("text", 256).alias("text_hash"))


@query(f"""WITH {q.EDGES} SELECT 'node' AS kind, id, '{{"id":"' || id || '","type":"' || type || '","status":"' || status || '"}}' AS json FROM nodes
  UNION ALL SELECT 'edge', id, '{{"id":"' || id || '","source_node_id":"' || source_node_id || '","target_node_id":"' || target_node_id || '","label":"' || label || '"}}' FROM edges""")
def graph_dump(spark, d):
    n, e = fx.nodes(spark, d), fx.edges(spark, d)
    return views.dump(n.select("id", "type", "status"), e.select("id", "source_node_id", "target_node_id", "label"))

"""Queries of the write path: change sets, stored tables, the incremental keyword index, sessions and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.functions import ids, segments, text
from codexmill.operators import changes, graph, keyword_index, store
from codexmill.operators.lineage import cut, new_folder, written
from codexmill.sources import bucketed
from codexmill.streaming import jobqueue

from . import fixtures as fx
from . import sql as q
from .queries import query

NOW = "2025-01-01T00:00:00"
BUCKETS = 16


def tables(spark: SparkSession, d: str) -> changes.Tables:
    """The graph with titles as items, and every document but src4 known by name."""
    n = written(fx.described(fx.nodes(spark, d)))
    titles = n.filter(F.col("title") != "").select(ids.item_id(F.col("id"), F.lit("title"), F.lit(0)).alias("id"), F.col("id").alias("node_id"), F.lit("title").alias("field"), F.col("title").alias("text"), F.lit(0).alias("ordinal"))
    known = n.select(F.col("original_document_name").alias("document_name")).distinct().filter(F.col("document_name") != "src4").withColumn("source_hash", F.lit("v0"))
    return changes.Tables(n, written(fx.edges(spark, d)), titles, known).conformed()


def picked(spark: SparkSession, d: str, every: int, rest: int) -> DataFrame:
    return fx.writes(spark, d).filter(F.col("seq") % every == rest).select("seq", "id")


# links


@query(f"""WITH {q.NODES}, cited AS (SELECT DISTINCT a.id AS note, coalesce(b.id, 'node:missing') AS source FROM writes a LEFT JOIN writes b ON b.seq = a.seq + 3 WHERE a.seq % 10 = 0),
  known AS (SELECT * FROM cited WHERE source IN (SELECT id FROM nodes)),
  tied AS (SELECT source AS s, note AS t, 'supports' AS label FROM known UNION ALL SELECT note, source, 'reference' FROM known)
  SELECT 'edge:' || substr(sha256(s || '|' || t || '|' || label), 1, 16) AS id, s AS source_node_id, t AS target_node_id, label, CASE label WHEN 'supports' THEN 'Source node supports this derived node.' ELSE 'Derived note references this source node.' END AS summary FROM tied""")
def link_notes(spark, d):
    w = fx.writes(spark, d).select("seq", "id")
    cited = w.filter(F.col("seq") % 10 == 0).join(w.select((F.col("seq") - 3).alias("seq"), F.col("id").alias("_s")), "seq", "left").select(F.col("id").alias("note"), F.coalesce("_s", F.lit("node:missing")).alias("source"))
    made = changes.links(cited, fx.nodes(spark, d), NOW, 1)
    return changes.folded(fx.edges(spark, d).limit(0), made, "edges").select("id", "source_node_id", "target_node_id", "label", "summary")


@query(f"""WITH {q.EDGES}, hit AS (SELECT DISTINCT e.id FROM live e JOIN edges c ON c.label = 'contradicts' AND least(e.source_node_id, e.target_node_id) = least(c.source_node_id, c.target_node_id) AND greatest(e.source_node_id, e.target_node_id) = greatest(c.source_node_id, c.target_node_id) WHERE e.label <> 'contradicts')
  SELECT id, label, created_at, CASE WHEN id IN (SELECT id FROM hit) THEN '{NOW}' ELSE invalid_at END AS invalid_at, CASE WHEN id IN (SELECT id FROM hit) THEN '{NOW}' END AS expired_at FROM edges""")
def invalidate_edges(spark, d):
    e = fx.edges(spark, d)
    made = cut(changes.invalidated(e, e.filter(F.col("label") == "contradicts"), NOW, 1))
    return changes.folded(changes.folded(e, made, "edges"), made, "edges").select("id", "label", "created_at", "invalid_at", "expired_at")


@query(f"""WITH {q.NODES}, pair AS (SELECT a.id AS x, b.id AS y, row_number() OVER (PARTITION BY a.id ORDER BY a.seq) AS r FROM writes a JOIN writes b ON b.seq = a.seq + 1 WHERE a.seq % 6 = 0 AND a.id <> b.id),
  ways AS (SELECT x AS s, y AS t, x || ',' || y AS episodes FROM pair WHERE r = 1 UNION ALL SELECT y, x, x || ',' || y FROM pair WHERE r = 1)
  SELECT 'edge:' || substr(sha256(s || '|' || t || '|same-as'), 1, 16) AS id, s AS source_node_id, t AS target_node_id, min(episodes) AS episodes, '{NOW}' AS valid_at FROM ways GROUP BY s, t""")
def same_as_links(spark, d):
    """A judge that calls every third pair the same; every second is a candidate."""
    w = fx.writes(spark, d).select("seq", "id")
    pair = w.join(w.select((F.col("seq") - 1).alias("seq"), F.col("id").alias("target")), "seq")
    judged = store.newest(pair.filter(F.col("seq") % 6 == 0).filter(F.col("id") != F.col("target")), ["id"], [F.col("seq")]).select("id", "target", F.lit(True).alias("is_same"))
    others = pair.filter(F.col("seq") % 6 == 3).select("id", "target", F.lit(True).alias("is_same")).join(judged.select("id"), "id", "left_anti")
    candidates = pair.filter(F.col("seq") % 2 == 0).select("id", F.col("target").alias("candidate"))
    given = others.join(candidates.select("id"), "id", "left_anti").unionByName(judged)
    made = changes.same_as(given, candidates, NOW, 1)
    return changes.folded(fx.edges(spark, d).limit(0), made, "edges").select("id", "source_node_id", "target_node_id", F.array_join("source_episode_ids", ",").alias("episodes"), "valid_at")


@query(f"""WITH {q.NODES}, t AS (SELECT *, {q.tokens('body')} AS tok, arg.seq AS s FROM nodes JOIN (SELECT id AS i, max(seq) AS seq FROM writes GROUP BY id) arg ON arg.i = nodes.id),
  k AS (SELECT id, body, s, list_transform(list_filter(list_zip(tok, range(1, len(tok) + 1)), lambda z: list_position(tok, z[1]) = z[2])[1:2], lambda z: z[1]) AS two, string_split(body, '. ')[1] AS claim FROM t)
  SELECT id, sha256(body) AS source_material_hash, CASE WHEN s % 2 = 0 THEN 'given' ELSE array_to_string(two, ' ') END AS keywords, CASE WHEN s % 3 = 0 THEN 'said' ELSE claim END AS claim,
         CASE WHEN s % 5 = 0 THEN 'own' WHEN s % 3 <> 0 AND s % 7 <> 0 THEN 'entity ' || s WHEN s % 2 = 0 THEN 'given' ELSE two[1] END AS entity, CASE WHEN s % 4 = 0 THEN 'short' ELSE 'about ' || substr(id, 1, 9) END AS summary FROM k""")
def derived_fields(spark, d):
    """What nodes lack is filled in from an extraction that stands for the port's."""
    n = fx.nodes(spark, d).join(fx.writes(spark, d).groupBy(F.col("id").alias("_i")).agg(F.max("seq").alias("s")), F.col("id") == F.col("_i")).drop("_i")
    has = lambda k, value, kind: F.when(F.col("s") % k == 0, value).otherwise(F.lit(None).cast(kind))
    lacking = n.withColumns({"keywords": has(2, F.array(F.lit("given")), "array<string>"), "claims": has(3, F.array(F.lit("said")), "array<string>"), "entity": F.when(F.col("s") % 5 == 0, "own").otherwise(""), "summary": F.when(F.col("s") % 4 == 0, "short").otherwise(" "), "source_material_hash": F.lit("")})
    found = n.select("id", F.concat(F.lit(" about "), F.substring("id", 1, 9)).alias("summary"), F.slice(F.array_distinct(text.tokens(F.col("body"))), 1, 2).alias("keywords"), F.slice(F.split("body", r"\. "), 1, 1).alias("claims"), F.when(F.col("s") % 7 != 0, F.concat(F.lit("entity "), F.col("s").cast("string"))).alias("entity"))
    return changes.filled(lacking, found).select("id", "source_material_hash", F.array_join("keywords", " ").alias("keywords"), F.array_join("claims", " ").alias("claim"), "entity", "summary")


# change sets; each is applied twice, which must leave what applying it once does


def twice(t: changes.Tables, made: DataFrame) -> changes.Tables:
    kept = cut(made)
    once = changes.applied(t, kept)
    return changes.applied(changes.Tables(*[written(getattr(once, k)) for k in ("nodes", "edges", "items", "sources")]), kept)


def state(t: changes.Tables) -> DataFrame:
    """(kind, id, state) of the whole graph: nodes by status and version, edges by label and validity, items by node, sources by version."""
    text_of = lambda *cs: F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("-")) for c in cs])
    return (
        t.nodes.select(F.lit("node").alias("kind"), "id", text_of("status", "type", "original_document_name", "created_at").alias("state"))
        .unionByName(t.edges.select(F.lit("edge").alias("kind"), "id", text_of("label", "source_node_id", "target_node_id").alias("state")))
        .unionByName(t.items.select(F.lit("item").alias("kind"), "id", text_of("node_id").alias("state")))
        .unionByName(t.sources.select(F.lit("source").alias("kind"), F.col("document_name").alias("id"), text_of("source_hash").alias("state")))
    )


#: Notes at most three "supports" edges from what has changed: e3 (a, b) are these edges, s0 (id) what has changed.
REACHED = """
  notes AS (SELECT id FROM n0 WHERE type = 'exogenous' AND status = 'active'),
  s1 AS (SELECT DISTINCT b AS id FROM s0 JOIN e3 ON a = s0.id WHERE b IN (SELECT id FROM notes) AND b NOT IN (SELECT id FROM s0)),
  s2 AS (SELECT DISTINCT b AS id FROM s1 JOIN e3 ON a = s1.id WHERE b IN (SELECT id FROM notes) AND b NOT IN (SELECT id FROM s0 UNION SELECT id FROM s1)),
  s3 AS (SELECT DISTINCT b AS id FROM s2 JOIN e3 ON a = s2.id WHERE b IN (SELECT id FROM notes) AND b NOT IN (SELECT id FROM s0 UNION SELECT id FROM s1 UNION SELECT id FROM s2))"""
#: The first hundred of them, and all.
CASCADE = f"{REACHED},\n  hit AS (SELECT id FROM (SELECT id, 1 AS depth FROM s1 UNION ALL SELECT id, 2 FROM s2 UNION ALL SELECT id, 3 FROM s3) ORDER BY depth, id LIMIT 100)"
CASCADE_ALL = f"{REACHED},\n  hit AS (SELECT id FROM s1 UNION ALL SELECT id FROM s2 UNION ALL SELECT id FROM s3)"
STATES = """SELECT 'node' AS kind, id, status || '|' || type || '|' || original_document_name || '|' || created_at AS state FROM n1
  UNION ALL SELECT 'edge', id, label || '|' || s || '|' || t FROM e1
  UNION ALL SELECT 'item', id, node_id FROM i1
  UNION ALL SELECT 'source', document_name, source_hash FROM c1"""
ITEMS = "items AS (SELECT substr(sha256(id || '|title|0'), 1, 12) AS id, id AS node_id FROM nodes WHERE title <> '')"
SOURCES = "sources AS (SELECT DISTINCT original_document_name AS document_name, 'v0' AS source_hash FROM nodes WHERE original_document_name <> 'src4')"


def edge_sql(s: str, t: str, label: str) -> str:
    return f"'edge:' || substr(sha256({s} || '|' || {t} || '|' || {label}), 1, 16)"


@query(f"""WITH {q.EDGES}, {ITEMS}, {SOURCES}, s0 AS (SELECT DISTINCT id FROM writes WHERE seq % 40 = 5),
  n0 AS (SELECT id, type, CASE WHEN id IN (SELECT id FROM s0) THEN 'deleted' ELSE status END AS status FROM nodes), e3 AS (SELECT source_node_id AS a, target_node_id AS b FROM edges WHERE label = 'supports'), {CASCADE},
  n1 AS (SELECT id, type, original_document_name, created_at, CASE WHEN id IN (SELECT id FROM hit) THEN 'stale' ELSE status END AS status FROM nodes WHERE id NOT IN (SELECT id FROM s0)),
  e1 AS (SELECT id, label, source_node_id AS s, target_node_id AS t FROM edges WHERE source_node_id NOT IN (SELECT id FROM s0) AND target_node_id NOT IN (SELECT id FROM s0)),
  i1 AS (SELECT * FROM items WHERE node_id NOT IN (SELECT id FROM s0)), c1 AS (SELECT * FROM sources)
  {STATES}""")
def delete_nodes(spark, d):
    t = tables(spark, d)
    return state(twice(t, changes.deleted(picked(spark, d, 40, 5).select("id"), t, NOW, 1)))


@query(f"""WITH {q.EDGES}, {ITEMS}, {SOURCES}, pick AS (SELECT DISTINCT id FROM writes WHERE seq % 15 = 0), m AS (SELECT n.*, n.body || ' edited' AS new_body FROM nodes n JOIN pick USING (id)),
  swap AS (SELECT id AS old, CASE WHEN type = 'exogenous' THEN 'exo:' || substr(sha256(new_body), 1, 12) ELSE 'node:' || substr(regexp_replace(lower(original_document_name), '[^a-z0-9]+', '-', 'g'), 1, 24) || ':' || substr(sha256(new_body), 1, 12) END AS new, type, original_document_name FROM m),
  tied AS (SELECT e.id, e.label, e.created_at, coalesce(a.new, source_node_id) AS s, coalesce(b.new, target_node_id) AS t, (a.new IS NOT NULL OR b.new IS NOT NULL) AND label IN ('follows', 'reference', 'supports') AS moves, source_node_id AS s_old, target_node_id AS t_old
           FROM edges e LEFT JOIN swap a ON a.old = source_node_id LEFT JOIN swap b ON b.old = target_node_id),
  e0 AS (SELECT id, label, s_old AS s, t_old AS t FROM tied WHERE NOT moves UNION SELECT {edge_sql('s', 't', 'label')}, label, s, t FROM tied WHERE moves AND s <> t),
  e1 AS (SELECT * FROM e0 UNION SELECT {edge_sql('old', 'new', "'superseded_by'")}, 'superseded_by', old, new FROM swap UNION SELECT {edge_sql('new', 'old', "'supersedes'")}, 'supersedes', new, old FROM swap),
  n0 AS (SELECT id, type, status FROM nodes UNION ALL SELECT new, type, 'active' FROM swap), e3 AS (SELECT s AS a, t AS b FROM e0 WHERE label = 'supports'), s0 AS (SELECT old AS id FROM swap UNION SELECT new FROM swap), {CASCADE_ALL},
  n1 AS (SELECT id, type, original_document_name, created_at, CASE WHEN id IN (SELECT id FROM hit) THEN 'stale' WHEN id IN (SELECT old FROM swap) THEN 'superseded' ELSE status END AS status FROM nodes
         UNION ALL SELECT new, type, original_document_name, '{NOW}', CASE WHEN new IN (SELECT id FROM hit) THEN 'stale' ELSE 'active' END FROM swap),
  i1 AS (SELECT * FROM items WHERE node_id NOT IN (SELECT id FROM pick)), c1 AS (SELECT * FROM sources)
  {STATES}""")
def update_nodes(spark, d):
    t = tables(spark, d)
    edits = t.nodes.join(picked(spark, d, 15, 0).select("id").distinct(), "id", "left_semi").select("id", F.concat("body", F.lit(" edited")).alias("body"))
    return state(twice(t, changes.updated(edits, t, NOW, 1)))


@query(f"""WITH {q.EDGES}, {ITEMS}, {SOURCES}, made AS (
    SELECT DISTINCT 'exo:' || substr(sha256('agent' || chr(10) || chr(10) || item_id || ' ?' || chr(10) || chr(10) || text), 1, 12) AS id, item_id FROM benchmark WHERE text <> ''),
  cited AS (SELECT DISTINCT m.id AS note, w.id AS source FROM made m JOIN writes w ON w.seq % 50 = m.item_id % 50),
  n1 AS (SELECT id, type, original_document_name, created_at, status FROM nodes UNION ALL SELECT id, 'exogenous', '-', '{NOW}', 'active' FROM made),
  e1 AS (SELECT id, label, source_node_id AS s, target_node_id AS t FROM edges UNION SELECT {edge_sql('source', 'note', "'supports'")}, 'supports', source, note FROM cited UNION SELECT {edge_sql('note', 'source', "'reference'")}, 'reference', note, source FROM cited),
  i1 AS (SELECT * FROM items), c1 AS (SELECT * FROM sources)
  {STATES}""")
def create_notes(spark, d):
    t = tables(spark, d)
    cited = fx.writes(spark, d).select((F.col("seq") % 50).alias("_k"), "id").groupBy("_k").agg(F.collect_set("id").alias("sources"))
    b = fx.table(spark, d, "benchmark").filter(F.col("text") != "")
    asked = b.select(F.col("text").alias("body"), F.lit("agent").alias("origin"), F.concat(F.col("item_id").cast("string"), F.lit("  ? ")).alias("question"), F.lit("").alias("title"), (F.col("item_id") % 50).alias("_k")).join(cited, "_k", "left").drop("_k")
    none = t.nodes.select(F.col("id").alias("note"), "cluster").limit(0)
    return state(twice(t, changes.created_note(asked, t.nodes, none, NOW, 1)))


def read_again(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pages of documents as they are read again, and their chains: of every source the even pages, some edited, and a new one for some."""
    w = fx.writes(spark, d).filter((F.col("seq") % 2 == 0) & (F.col("type") == "endogenous"))
    edited = w.withColumn("body", F.when(F.col("seq") % 8 == 2, F.concat("body", F.lit(" revised edition"))).when(F.col("seq") % 16 == 4, F.concat(F.lit("quite new words about page "), F.col("seq").cast("string"))).otherwise(F.col("body")))
    pages = edited.withColumn("id", ids.node_id(F.col("body"), F.col("original_document_name"))).withColumn("source_material_hash", ids.source_hash(F.col("body"))).withColumn("source_version", F.lit("v1")).withColumn("status", F.lit("active"))
    pages = store.newest(pages, ["id"], [F.col("seq")]).withColumnsRenamed({"seq": "ord"})
    stamped = pages.withColumns({"created_at": F.lit(NOW), "updated_at": F.lit(NOW)})
    chain = graph.chain_edges(stamped, "original_document_name", "ord").select(F.col("source").alias("a"), F.col("target").alias("b"))
    return cut(fx.described(stamped.drop("ord")).join(stamped.select(F.col("id").alias("_i"), "ord"), F.col("id") == F.col("_i")).drop("_i")), changes.edges_of(chain, "follows", "", NOW)


@query()
def ingest_documents(spark, d):
    """Known documents are revised, src4 is new; a page of it with a vector counts as complete."""
    t = tables(spark, d)
    pages, follows = read_again(spark, d)
    made, _ = changes.ingested(pages, follows, fx.body_vectors(spark, d), t, NOW, 1)
    return state(twice(t, made))


@query()
def create_documents(spark, d):
    """Each source gets a document of one page: its first old page, as it was or edited."""
    t = tables(spark, d)
    firsts = store.newest(store.active(t.nodes).filter(F.col("type") == "endogenous"), ["original_document_name"], [F.col("id")])
    body = F.when(F.crc32(F.col("original_document_name").cast("binary")) % 3 == 0, F.col("body")).otherwise(F.concat("body", F.lit(" and more")))
    documents = firsts.select(F.col("original_document_name").alias("document_name"), body.alias("body"), F.lit("").alias("title"), "claims", "keywords", "entity")
    made, _ = changes.created_document(documents, t, NOW, 1)
    return state(twice(t, made))


# stored tables and the index


@query(f"WITH {q.NODES} SELECT id, title, status, cluster, created_at, updated_at FROM nodes")
def upsert_stored(spark, d):
    """The writes of even documents as a stored table, into which those of odd ones are merged."""
    w = fx.writes(spark, d)
    path = new_folder(spark, "nodes")
    first = w.groupBy("id").agg(F.min("seq").alias("s")).select(F.col("id").alias("_i"), "s")
    # created_at stays that of the first write, so an id's first write must be in the table already, or none of its writes.
    early = w.join(first, F.col("id") == F.col("_i")).filter((F.col("seq") % 2 == 0) | (F.col("seq") == F.col("s"))).filter(F.col("s") % 16 < 12).drop("_i", "s")
    bucketed.create(store.upsert_nodes(None, early, "seq"), path, "id", BUCKETS)
    bucketed.merge(spark, path, "id", BUCKETS, w, lambda old, new: store.upsert_nodes(old, new, "seq"))
    return bucketed.read(spark, path).select("id", "title", "status", "cluster", "created_at", "updated_at")


@query(f"""WITH {q.NODES}, {q.INDEX}, {q.QUESTIONS}, {q.bm25_sql('docs', 'questions')} SELECT query_id, id, round(score, 6) AS score FROM scores""")
def incremental_index(spark, d):
    """An index of other texts and ids, brought to the nodes' by changes in two steps, then searched."""
    docs = written(fx.index_docs(fx.nodes(spark, d)))
    third = F.crc32(F.col("id").cast("binary")) % 3
    begun = docs.filter(third != 0).withColumn("text", F.when(third == 1, F.concat("text", F.lit(" old words"))).otherwise(F.col("text")))
    gone = docs.filter(third == 2).select(F.concat(F.lit("x"), "id").alias("id"), "text")
    index = keyword_index.built(begun.unionByName(gone))
    index = keyword_index.changed(index, docs.filter(third == 0), gone.select("id"))
    index = keyword_index.changed(keyword_index.compacted(index), docs.filter(third == 1), docs.select("id").limit(0))
    return keyword_index.search(index, fx.questions(spark, d)).withColumn("score", F.round("score", 6))


# time


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM g GROUP BY user_id, k""")
def event_sessions(spark, d):
    e = fx.table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = jobqueue.sessions(e, "user_id", "ts", "12 hours")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query()
def bounded_queue(spark, d):
    """The events as commands of queues, one for each tenth of the users, run as a stream over the table."""
    command = F.create_map(*[F.lit(x) for x in ("view", "enqueue", "click", "take", "purchase", "finish", "error", "fail", "signup", "cancel")])[F.col("event_type")]
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobqueue.STORE)
    try:
        events = spark.readStream.schema(fx.table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
        commands = events.select((F.col("user_id") % 10).cast("string").alias("queue"), F.col("event_id").alias("seq"), F.concat(F.lit("job"), F.col("event_id").cast("string")).alias("job_id"), command.alias("command"))
        out, at = new_folder(spark, "queue"), new_folder(spark, "queue-state")
        stream = jobqueue.queue_states(commands, 5).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
        stream.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept) if kept else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.parquet(out)



# markdown


@query("""WITH u AS (SELECT doc_id, substr(text, 1, 60) AS before, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'about ' || doc_id || ' & <more>' END AS said, CASE WHEN doc_id % 5 = 0 THEN '' ELSE doc_id || '.png' END AS src, substr(text, 61, 60) AS after FROM documents),
  m AS (SELECT *, '<image-unit><image-media><img src="' || src || '" alt="a ' || doc_id || '"></image-media><image-description> ' || said || ' </image-description></image-unit>' AS unit FROM u),
  r AS (SELECT doc_id, 0 AS o, 'markdown' AS kind, before AS raw, NULL AS src, NULL AS alt, NULL AS description, NULL AS problem FROM m WHERE before <> ''
        UNION ALL SELECT doc_id, 1, 'image', unit, src, 'a ' || doc_id, said, CASE WHEN src <> '' AND said = '' THEN 'image without description' END FROM m
        UNION ALL SELECT doc_id, 2, 'markdown', after, NULL, NULL, NULL, NULL FROM m WHERE after <> '')
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS position, kind, raw, src, alt, description, problem FROM r""")
def markdown_segments(spark, d):
    doc = F.col("doc_id").cast("string")
    said = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("about "), doc, F.lit(" & <more>")))
    src = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(doc, F.lit(".png")))
    unit = F.concat(F.lit('<image-unit><image-media><img src="'), src, F.lit('" alt="a '), doc, F.lit('"></image-media><image-description> '), said, F.lit(" </image-description></image-unit>"))
    rows = fx.table(spark, d, "documents").select("doc_id", F.concat(F.substring("text", 1, 60), unit, F.substring("text", 61, 60)).alias("text"))
    return segments.segments(rows, "doc_id", "text").drop("title")

"""Small readings of the graph and its logs: lookups with fallbacks, neighbours, rankings, merged reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexmill.functions.ids import or_else

from . import graph, store

#: Evidence shown of a candidate, and the characters of each piece.
SHOWN, SHOWN_CHARS = 3, 280
KINDS = ("id", "keyword", "vector")


def read_nodes(refs: DataFrame, nodes: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """ref and the node it means: the id itself, else the id with ``node:`` before it, else the best keyword hit.

    ``found`` holds keyword hits (query_id, rank, id) of the refs; the first of them that is
    a node counts. A ref that means nothing has no row.
    """
    asked = refs.toDF("ref").distinct()
    tries = asked.select("ref", F.col("ref").alias("_id"), F.lit(0).alias("_try")).unionByName(asked.select("ref", F.concat(F.lit("node:"), "ref").alias("_id"), F.lit(1).alias("_try")))
    if found is not None:
        tries = tries.unionByName(found.join(asked, F.col("query_id") == F.col("ref"), "left_semi").select(F.col("query_id").alias("ref"), F.col("id").alias("_id"), (F.lit(1) + F.col("rank")).cast("int").alias("_try")))
    met = tries.join(nodes, F.col("_id") == F.col("id"))
    return store.newest(met, ["ref"], [F.col("_try")]).drop("_id", "_try")


def query(kind: str, hits: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 50) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a query of a kind: id, keyword or vector.

    hits (query_id, rank, id) are the ids asked for, or the results of a keyword or vector
    search; the first k of each count. Ids and keywords give the edges at their nodes,
    vectors the nodes two hops around them and the edges among these.
    """
    kind = kind.strip().lower()
    if kind not in KINDS:
        raise ValueError(f"unknown kind of query: {kind}")
    top = hits.filter(F.col("rank") <= k).select("query_id", "id")
    if kind == "vector":
        near, among = graph.k_hop(top.select(F.col("query_id").alias("seed"), "id"), edges, nodes)
        return near, among
    own = top.join(nodes.select("id"), "id", "left_semi")
    ends = edges.select("id", "label", F.explode(F.array_distinct(F.array("source_node_id", "target_node_id"))).alias("_end"))
    at = ends.join(top.select("query_id", F.col("id").alias("_node")), F.col("_end") == F.col("_node")).select("query_id", "id", "label").distinct()
    return own, at


def replace_items(old: DataFrame, items: DataFrame, node_ids: DataFrame | None = None) -> DataFrame:
    """The items with those of every node that has new ones, or is among node_ids, replaced as a whole; so a node of node_ids may end with none."""
    gone = items.select("node_id") if node_ids is None else items.select("node_id").unionByName(node_ids.toDF("node_id"))
    return old.join(gone.distinct(), "node_id", "left_anti").select(*old.columns).unionByName(items.select(*old.columns))


def valid_structure(edges: DataFrame, nodes: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Edges of the labels whose ends both exist and are active."""
    ids = store.active(nodes).select(F.col("id").alias("_n"))
    own = edges.filter(F.col("label").isin(*labels))
    return own.join(ids, F.col("source_node_id") == F.col("_n"), "left_semi").join(ids, F.col("target_node_id") == F.col("_n"), "left_semi")


def successors(targets: DataFrame, edges: DataFrame, nodes: DataFrame, replaced: DataFrame | None = None) -> DataFrame:
    """(id, successor): the live node that an id stands for; ids that stand for none have no row.

    An id that ``replaced`` (old, new) names gives way to its replacement. That node counts
    if it is active; if it is superseded, the active target of its newest superseded_by
    edge does, ties to the smaller id; in any other state nothing does.
    """
    own = targets.toDF("id").distinct()
    start = own.withColumn("_start", F.col("id"))
    if replaced is not None:
        swap = replaced.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
        start = own.join(swap, F.col("id") == F.col("_old"), "left").select("id", F.coalesce("_new", "id").alias("_start"))
    met = start.join(nodes.select(F.col("id").alias("_n"), "status"), F.col("_start") == F.col("_n"))
    ids = store.active(nodes).select(F.col("id").alias("successor"))
    hops = edges.filter(F.col("label") == "superseded_by").select(F.col("source_node_id").alias("_from"), F.col("target_node_id").alias("successor"), F.col("created_at").alias("_at"))
    led = met.filter(F.col("status") == "superseded").join(hops, F.col("_start") == F.col("_from")).join(ids, "successor", "left_semi")
    newest = store.newest(led, ["id"], [F.col("_at").desc(), F.col("successor")]).select("id", "successor")
    return met.filter(F.col("status") == "active").select("id", F.col("_start").alias("successor")).unionByName(newest)


def semantic_edges(hits: DataFrame, within: float) -> DataFrame:
    """(source_node_id, target_node_id, label) both ways for k-NN hits (query_id, id, distance) no farther than ``within``."""
    near = hits.filter((F.col("distance") <= within) & (F.col("query_id") != F.col("id")))
    one = near.select(F.col("query_id").alias("source_node_id"), F.col("id").alias("target_node_id"))
    both = one.unionByName(one.select(F.col("target_node_id").alias("source_node_id"), F.col("source_node_id").alias("target_node_id"))).distinct()
    return both.withColumn("label", F.lit("related"))


def neighbours_in_order(pages: DataFrame, group: str, order: str) -> DataFrame:
    """id with the ids before and after it in its group."""
    w = Window.partitionBy(group).orderBy(order)
    return pages.select("id", F.lag("id").over(w).alias("prev"), F.lead("id").over(w).alias("next"))


def last(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The last n rows of each group, in order."""
    w = Window.partitionBy(group).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def starts(refs: DataFrame, n: int = 3) -> DataFrame:
    """(query_id, position, id) of the first n different nodes among refs (query_id, ord, id)."""
    firsts = refs.groupBy("query_id", "id").agg(F.min("ord").alias("_ord"))
    position = F.row_number().over(Window.partitionBy("query_id").orderBy("_ord", "id"))
    return firsts.withColumn("position", position).filter(F.col("position") <= n).select("query_id", "position", "id")


def in_library_order(documents: DataFrame) -> DataFrame:
    """Documents (name, recency): the newest first, then by name."""
    return documents.orderBy(F.col("recency").desc(), F.lower("name"), "name")


def sidebar(documents: DataFrame, asked: str) -> DataFrame:
    """Documents (name, cluster) whose name or cluster holds what is asked, in any case; topics without any have no row."""
    said = asked.strip().lower()
    return documents.filter(F.contains(F.lower("name"), F.lit(said)) | F.contains(F.lower("cluster"), F.lit(said)))


def in_placement_order(groups: DataFrame) -> DataFrame:
    """Groups (cluster, score, size): by score, size, the chapter number in the name, and the name."""
    chapter = F.coalesce(F.regexp_extract("cluster", r"(\d+)", 1).try_cast("long"), F.lit(2**62))
    return groups.orderBy(F.col("score").desc(), F.col("size").desc(), chapter, "cluster")


def batch_summary(results: DataFrame) -> DataFrame:
    """status, n, lines: counts by status and the lines replaced, of results (status, lines)."""
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("lines"), F.lit(0)).cast("long").alias("lines"))


def nearest_preset(value: Column, levels: Sequence[float]) -> Column:
    """The place of the level nearest to a value, the first of equally near ones."""
    steps = F.array(*[F.struct(F.abs(value - F.lit(float(x))).alias("d"), F.lit(i).alias("i")) for i, x in enumerate(levels)])
    return F.array_min(steps)["i"]


def merged_reports(reports: DataFrame) -> DataFrame:
    """(query_id, report, citations): numbered blocks in order, and all cited ids, each once, in order of first mention."""
    parts = F.array_sort(F.collect_list(F.struct("ord", "text", "citations")))
    merged = reports.groupBy("query_id").agg(parts.alias("_p"))
    blocks = F.transform("_p", lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p["text"]))
    return merged.select("query_id", F.array_join(blocks, "\n\n").alias("report"), F.array_distinct(F.flatten(F.transform("_p", lambda p: p["citations"]))).alias("citations"))


def described(evidence: Column, kind: Column) -> Column:
    """A candidate in words: its kind and the first pieces of evidence, white space folded and cut."""
    said = F.transform(F.slice(evidence, 1, SHOWN), lambda e: F.substring(F.trim(F.regexp_replace(e, r"\s+", " ")), 1, SHOWN_CHARS))
    return F.concat_ws(" | ", F.when(kind == "endogenous", "agent_note").otherwise("source"), F.array_join(F.filter(said, lambda e: e != ""), " | "))


def citations(answers: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, position, id, title): cited and referenced ids, each once in order, with what there is to show."""
    each = answers.select("query_id", F.posexplode(F.array_distinct(F.concat("cited", "refs"))).alias("position", "id"))
    shown = nodes.select(F.col("id").alias("_id"), or_else(F.col("title"), F.col("summary"), F.col("original_document_name")).alias("_title"))
    return each.join(shown, F.col("id") == F.col("_id"), "left").select("query_id", "position", "id", F.coalesce("_title", "id").alias("title"))


def lines_in_chunks(text: Column, n: int) -> Column:
    """The text's lines in pieces of n lines."""
    lines = F.split(text, "\n", -1)
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / n).cast("int")), lambda i: F.array_join(F.slice(lines, i * n + 1, n), "\n"))


def list_to_json(values: Column) -> Column:
    return F.to_json(F.coalesce(values, F.array().cast("array<string>")))


def list_from_json(text: Column) -> Column:
    """A stored list; null, empty and unreadable ones are empty."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def clamped(score: Column) -> Column:
    """A judge's score within 0 and 100; none is 0."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(score.cast("double"), F.lit(0.0))))


def item_rows(hits: DataFrame, items: DataFrame) -> DataFrame:
    """Hits (query_id, rank, id, score) with all columns of the items they are."""
    own = items.select(F.col("id").alias("_i"), *[c for c in items.columns if c != "id"])
    return hits.join(own, F.col("id") == F.col("_i")).drop("_i")


def dump(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, id, json): every row of the graph as JSON, nodes and edges."""
    told = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", F.to_json(F.struct("*")).alias("json"))
    return told(nodes, "node").unionByName(told(edges, "edge"))

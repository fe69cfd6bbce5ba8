"""Graph operators over node and edge tables: links, hops, health, cascades, chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .store import DIRECTIONS, live

MOST_HOPS, MOST_NODES = 3, 100


def follow_link(starts: DataFrame, edges: DataFrame, nodes: DataFrame, label: str | None = None, direction: str = "out", limit: int = 50) -> DataFrame:
    """(start, position, id, label, way): active neighbours of each start over live edges.

    Outgoing ones come first; missing and inactive neighbours are dropped before the limit.
    """
    direction = direction.strip().lower()
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    own = live(edges)
    if label:
        own = own.filter(F.col("label") == label)
    ways = {"out": ("source_node_id", "target_node_id", 0), "in": ("target_node_id", "source_node_id", 1)}
    starts = starts.toDF("start").distinct()
    found = None
    for way in ("out", "in") if direction == "both" else (direction,):
        a, b, order = ways[way]
        one = own.join(starts, F.col(a) == F.col("start")).select("start", F.col(b).alias("id"), "label", F.lit(way).alias("way"), F.lit(order).alias("_o"), "created_at", F.col("id").alias("_edge"))
        found = one if found is None else found.unionByName(one)
    active = nodes.filter(F.col("status") == "active").select(F.col("id").alias("_id"))
    w = Window.partitionBy("start").orderBy("_o", F.col("created_at").desc(), "_edge")
    kept = found.join(active, F.col("id") == F.col("_id"), "left_semi").withColumn("position", F.row_number().over(w))
    return kept.filter(F.col("position") <= limit).select("start", "position", "id", "label", "way")


def k_hop(starts: DataFrame, edges: DataFrame, nodes: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around the starts (seed, id): nodes as (seed, id, depth), active ones only, edges as (seed, edge_id).

    Each hop joins the frontier with both ends of the live edges and takes away what was
    seen; edges to inactive nodes are kept, those nodes are not walked through.
    """
    own = live(edges).select(F.col("id").alias("edge_id"), F.col("source_node_id").alias("s"), F.col("target_node_id").alias("t"))
    ends = own.select("edge_id", F.col("s").alias("_from"), F.col("t").alias("_to")).unionByName(own.select("edge_id", F.col("t").alias("_from"), F.col("s").alias("_to")))
    active = nodes.filter(F.col("status") == "active").select(F.col("id").alias("_id"))
    seen = starts.toDF("seed", "id").distinct().withColumn("depth", F.lit(0))
    frontier, found = seen, None
    for depth in range(1, hops + 1):
        step = frontier.join(ends, F.col("id") == F.col("_from"))
        now = step.select("seed", "edge_id").distinct()
        found = now if found is None else found.unionByName(now)
        new = step.select("seed", F.col("_to").alias("id")).distinct().join(active, F.col("id") == F.col("_id"), "left_semi")
        frontier = new.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.unionByName(frontier)
    return seen, found.distinct()


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, other): distinct undirected neighbours within the node set; a loop makes a node its own."""
    ids = nodes.select("id").distinct()
    a, b = ids.select(F.col("id").alias("_a")), ids.select(F.col("id").alias("_b"))
    inside = edges.select(F.col("source_node_id").alias("s"), F.col("target_node_id").alias("t")).join(a, F.col("s") == F.col("_a"), "left_semi").join(b, F.col("t") == F.col("_b"), "left_semi")
    return inside.select(F.col("s").alias("id"), F.col("t").alias("other")).unionByName(inside.select(F.col("t").alias("id"), F.col("s").alias("other"))).distinct()


def overlaps(adjacency: DataFrame) -> DataFrame:
    """(id, other, overlap) of adjacent pairs id < other: the Jaccard measure of their neighbourhoods.

    Common neighbours are counted by joining wedges with the pairs themselves, so no
    neighbour list is gathered and only wedges that close are kept.
    """
    degree = adjacency.groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    pairs = adjacency.filter(F.col("id") < F.col("other"))
    left = adjacency.select(F.col("id").alias("_a"), F.col("other").alias("_c"))
    right = adjacency.select(F.col("id").alias("_b"), F.col("other").alias("_c2"))
    closed = pairs.join(left, F.col("id") == F.col("_a")).join(right, (F.col("other") == F.col("_b")) & (F.col("_c") == F.col("_c2")))
    common = closed.groupBy("id", "other").agg(F.count(F.lit(1)).alias("common"))
    sized = pairs.join(common, ["id", "other"], "left").join(degree.toDF("id", "d1"), "id").join(degree.toDF("other", "d2"), "other")
    shared = F.coalesce(F.col("common"), F.lit(0))
    return sized.select("id", "other", (shared / (F.col("d1") + F.col("d2") - shared)).alias("overlap"))


def health(nodes: DataFrame, edges: DataFrame, node: str | None = None) -> DataFrame:
    """One row of figures of the graph; clusters are in ``cluster_sizes``.

    Nodes are all but the deleted, edges all there are; density and averages are 0 where
    there is nothing to divide by. With ``node`` the node set is that one, so its degree
    is 0 unless it has a loop. Rounded half to even: degree 3, density 5, overlap 4 places.
    """
    own = nodes.filter(F.col("status") != "deleted")
    if node is not None:
        own = own.filter(F.col("id") == node)
    adjacency = neighbours(own, edges)
    degree = adjacency.groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    n = F.count(F.lit(1))
    facts = own.join(degree, "id", "left").withColumn("d", F.coalesce("d", F.lit(0))).agg(
        n.alias("total_nodes"), F.coalesce(count(F.col("status") == "active"), F.lit(0)).alias("active_nodes"), F.coalesce(count(F.col("type") == "endogenous"), F.lit(0)).alias("endogenous_nodes"), F.coalesce(count(F.col("type") == "exogenous"), F.lit(0)).alias("exogenous_nodes"),
        F.coalesce(count(F.col("d") == 0), F.lit(0)).alias("isolated_nodes"), F.when(n > 0, F.bround(F.sum("d") / n, 3)).otherwise(0.0).alias("avg_degree"), F.when(n > 1, F.bround((F.sum("d") / 2) / (n * (n - 1) / 2), 5)).otherwise(0.0).alias("density"),
    )
    mean = overlaps(adjacency).agg(F.coalesce(F.bround(F.avg("overlap"), 4), F.lit(0.0)).alias("mean_overlap"))
    total = edges.agg(F.count(F.lit(1)).alias("total_edges"))
    return facts.crossJoin(total).crossJoin(mean)  # one row each


def cluster_sizes(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("status") != "deleted").groupBy(F.coalesce(F.nullif(F.col("cluster"), F.lit("")), F.lit("Unclustered")).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree) of a directed multigraph; edges need both ends in the node set."""
    ids = nodes.select("id")
    both = edges.join(ids.toDF("_a"), F.col("source_node_id") == F.col("_a"), "left_semi").join(ids.toDF("_b"), F.col("target_node_id") == F.col("_b"), "left_semi")
    ends = both.select(F.col("source_node_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(both.select(F.col("target_node_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return ids.join(sums, "id", "left").select("id", zero("in_degree").alias("in_degree"), zero("out_degree").alias("out_degree"), (zero("in_degree") + zero("out_degree")).alias("degree"))


def edge_weights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, weight) of the undirected graph of active nodes: parallel and reverse edges add up, loops don't count."""
    ids = nodes.filter(F.col("status") == "active").select("id")
    both = edges.filter(F.col("source_node_id") != F.col("target_node_id")).join(ids.toDF("_a"), F.col("source_node_id") == F.col("_a"), "left_semi").join(ids.toDF("_b"), F.col("target_node_id") == F.col("_b"), "left_semi")
    return both.groupBy(F.least("source_node_id", "target_node_id").alias("a"), F.greatest("source_node_id", "target_node_id").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is not in the node table, and which."""
    ids = nodes.select("id")
    side = lambda c: edges.join(ids.toDF("_a"), F.col(c) == F.col("_a"), "left_anti").select("id", F.col(c).alias("missing"))
    return side("source_node_id").unionByName(side("target_node_id")).distinct()


def invalidated_by(edges: DataFrame, contradictions: DataFrame) -> DataFrame:
    """(id, by): live edges of other labels between the two ends of a contradiction, in either direction."""
    pair = lambda d: d.withColumn("_lo", F.least("source_node_id", "target_node_id")).withColumn("_hi", F.greatest("source_node_id", "target_node_id"))
    own = pair(live(edges).filter(F.col("label") != "contradicts")).select("id", "_lo", "_hi")
    by = pair(contradictions).select(F.col("id").alias("by"), F.col("_lo").alias("_l"), F.col("_hi").alias("_h"))
    return own.join(by, (F.col("_lo") == F.col("_l")) & (F.col("_hi") == F.col("_h"))).groupBy("id").agg(F.min("by").alias("by"))


def chain_edges(rows: DataFrame, group: str, order: str) -> DataFrame:
    """(source, target): each row of a group with the next in order."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("target", F.lead("id").over(w)).filter(F.col("target").isNotNull()).select(F.col("id").alias("source"), "target")


def cascade(changed: DataFrame, edges: DataFrame, nodes: DataFrame, hops: int = MOST_HOPS, most: int | None = MOST_NODES) -> DataFrame:
    """(id, depth): active notes that rest on changed nodes through "supports", breadth first.

    At most ``hops`` away; of a level that would pass ``most`` nodes in all, the first by id; with None, all of them.
    """
    ties = edges.filter(F.col("label") == "supports").select(F.col("source_node_id").alias("_s"), F.col("target_node_id").alias("_t"))
    notes = nodes.filter((F.col("type") == "exogenous") & (F.col("status") == "active")).select(F.col("id").alias("_id"))
    seen = frontier = cut(changed.toDF("id").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, hops + 1):
        new = frontier.join(ties, F.col("id") == F.col("_s")).select(F.col("_t").alias("id")).distinct()
        frontier = new.join(notes, F.col("id") == F.col("_id"), "left_semi").join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth))
        frontier = cut(frontier)
        seen = seen.unionByName(frontier)
    found = seen.filter(F.col("depth") > 0)
    return found if most is None else found.orderBy("depth", "id").limit(most)


def chain_order(nodes: DataFrame, links: DataFrame, rounds: int = 20) -> DataFrame:
    """(id, head, depth) along chains (source, target), by pointer doubling: 2^rounds steps at most.

    A head has no one before it; nodes on a loop are stragglers and keep a null head.
    """
    before = links.groupBy(F.col("target").alias("id")).agg(F.min("source").alias("up"))
    state = nodes.select("id").join(before, "id", "left").withColumn("head", F.coalesce("up", "id")).withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1))
    state = cut(state.select("id", "up", "head", "depth"))
    for _ in range(rounds):
        far = state.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("depth").alias("_d"), F.col("head").alias("_h"))
        going = state.filter(F.col("up").isNotNull())
        if not going.limit(1).count():
            break
        state = cut(state.join(far, F.col("up") == F.col("_id"), "left").select("id", F.col("_up").alias("up"), F.coalesce("_h", "head").alias("head"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth")))
    return state.select("id", F.when(F.col("up").isNull(), F.col("head")).alias("head"), F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def collapse_same_as(ordered: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, position, id) without nodes that a kept, earlier one is the same as: greedy, in order.

    Where "same as" holds among all of a group, the greedy rule keeps the first of each
    group; in general it is a walk through each query's list, which is bounded by its k.
    """
    import pandas as pd

    same = edges.filter(F.col("label") == "same-as").select(F.col("source_node_id").alias("_s"), F.col("target_node_id").alias("_t"))
    both = same.unionByName(same.select(F.col("_t").alias("_s"), F.col("_s").alias("_t"))).distinct()
    inside = ordered.select(F.col("query_id").alias("_q"), F.col("id").alias("_o"))
    partners = ordered.join(both, F.col("id") == F.col("_s")).join(inside, (F.col("query_id") == F.col("_q")) & (F.col("_t") == F.col("_o"))).groupBy("query_id", "id").agg(F.collect_set("_t").alias("partners"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        seen, keep = set(), []
        for row in pdf.sort_values("position").itertuples():
            if row.id not in seen:
                keep.append((row.query_id, row.position, row.id))
                seen.update(row.partners if row.partners is not None else ())
        return pd.DataFrame(keep, columns=["query_id", "position", "id"])

    rows = ordered.join(partners, ["query_id", "id"], "left").select(F.col("query_id").cast("string").alias("query_id"), F.col("position").cast("int").alias("position"), "id", "partners")
    return rows.groupBy("query_id").applyInPandas(walk, "query_id string, position int, id string")

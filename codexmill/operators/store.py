"""Reading and changing the graph's tables. Every change gives a new DataFrame.

Windows keep the newest row of a key; deletes are anti joins; a snapshot written by
``sources.snapshots`` makes several changes take effect at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexmill.functions.ids import edge_id, or_else
from codexmill.schema import ACTIVE, DELETED, SUPERSEDED

DIRECTIONS = ("out", "in", "both")


def active(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("status") == ACTIVE)


def not_deleted(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("status") != DELETED)


def live(edges: DataFrame) -> DataFrame:
    """Edges that are neither invalidated nor expired."""
    return edges.filter(or_else(F.col("invalid_at")).isNull() & or_else(F.col("expired_at")).isNull())


def all_nodes(nodes: DataFrame, include_deleted: bool = False) -> DataFrame:
    """Newest first."""
    return (nodes if include_deleted else not_deleted(nodes)).orderBy(F.col("updated_at").desc(), "id")


def nodes_of_document(nodes: DataFrame, name: str, active_only: bool = False) -> DataFrame:
    own = nodes.filter(F.col("original_document_name") == name)
    return (active(own) if active_only else own).orderBy(F.col("updated_at").desc(), "id")


def by_ids(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is in a table of one column of ids."""
    return table.join(ids.toDF(key).distinct(), key, "left_semi")


def incident(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with either end among the ids, each once; two equi joins, not one with OR."""
    ids = ids.toDF("_x").distinct()
    out = edges.join(ids, F.col("source_node_id") == F.col("_x"), "left_semi")
    into = edges.join(ids, F.col("target_node_id") == F.col("_x"), "left_semi").join(ids, F.col("source_node_id") == F.col("_x"), "left_anti")
    return out.unionByName(into)


def all_edges(edges: DataFrame) -> DataFrame:
    """Newest first."""
    return edges.orderBy(F.col("created_at").desc(), "id")


def _at(edges: DataFrame, end: str, nodes: str | DataFrame, label: str | None) -> DataFrame:
    own = edges.filter(F.col("label") == label) if label else edges
    if isinstance(nodes, str):
        return own.filter(F.col(end) == nodes)
    return own.join(nodes.toDF("_x").distinct(), F.col(end) == F.col("_x"), "left_semi")


def outgoing(edges: DataFrame, nodes: str | DataFrame, label: str | None = None) -> DataFrame:
    """Edges from a node, or from any of a table of one column of ids."""
    return _at(edges, "source_node_id", nodes, label)


def incoming(edges: DataFrame, nodes: str | DataFrame, label: str | None = None) -> DataFrame:
    return _at(edges, "target_node_id", nodes, label)


def source(current: DataFrame, name: str) -> DataFrame:
    """The current version of a document by its name."""
    return current.filter(F.col("document_name") == name)


def newest(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order given."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1).drop("_n")


def upsert_nodes(old: DataFrame | None, new: DataFrame, seq: str) -> DataFrame:
    """The last write of each id wins, by ``seq``; created_at is that of the first."""
    both = new if old is None else old.withColumn(seq, F.lit(-1).cast("long")).unionByName(new)
    of_id = Window.partitionBy("id")
    first = F.min_by("created_at", seq).over(of_id)
    return newest(both.withColumn("created_at", first), ["id"], [F.col(seq).desc()]).drop(seq)


def upsert_edges(old: DataFrame | None, new: DataFrame, seq: str) -> DataFrame:
    """As for nodes, but the ends and created_at stay those of the first write."""
    both = new if old is None else old.withColumn(seq, F.lit(-1).cast("long")).unionByName(new)
    of_id = Window.partitionBy("id")
    fixed = {c: F.min_by(c, seq).over(of_id) for c in ("source_node_id", "target_node_id", "created_at")}
    return newest(both.withColumns(fixed), ["id"], [F.col(seq).desc()]).drop(seq)


def keep_first(df: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    return newest(df, key, [F.col(seq)]).drop(seq)


def keep_last(df: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    return newest(df, key, [F.col(seq).desc()]).drop(seq)


def set_status(nodes: DataFrame, ids: DataFrame, status: str, now: str) -> DataFrame:
    hit = ids.toDF("_x").distinct()
    joined = nodes.join(hit, F.col("id") == F.col("_x"), "left")
    return joined.withColumn("status", F.when(F.col("_x").isNotNull(), status).otherwise(F.col("status"))).withColumn("updated_at", F.when(F.col("_x").isNotNull(), now).otherwise(F.col("updated_at"))).drop("_x")


def without(table: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    return table.join(ids.toDF("_x").distinct(), F.col(column) == F.col("_x"), "left_anti")


def delete_items(nodes: DataFrame, items: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, vectors) without the items of the nodes and the vectors of these items."""
    gone = items.join(nodes.toDF("_x").distinct(), F.col("node_id") == F.col("_x"), "left_semi").select("id")
    return without(items, "node_id", nodes), without(vectors, "id", gone)


def delete_nodes(ids: DataFrame, nodes: DataFrame, edges: DataFrame, items: DataFrame, vectors: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, DataFrame]]:
    """Nodes with their edges, items and vectors; item vectors go with their items."""
    gone_items = items.join(ids.toDF("_x").distinct(), F.col("node_id") == F.col("_x"), "left_semi").select("id")
    kept_edges = without(without(edges, "source_node_id", ids), "target_node_id", ids)
    kept = {name: without(v, "id", gone_items if name == "search_item" else ids) for name, v in vectors.items()}
    return without(nodes, "id", ids), kept_edges, without(items, "node_id", ids), kept


def delete_labelled_among(edges: DataFrame, label: str, ids: DataFrame) -> DataFrame:
    """Edges of the label with both ends among the ids go."""
    a, b = ids.toDF("_a").distinct(), ids.toDF("_b").distinct()
    hit = edges.filter(F.col("label") == label).join(a, F.col("source_node_id") == F.col("_a"), "left_semi").join(b, F.col("target_node_id") == F.col("_b"), "left_semi").select(F.col("id").alias("_x"))
    return edges.join(hit, F.col("id") == F.col("_x"), "left_anti")


def record_sources(events: DataFrame, seq: str) -> tuple[DataFrame, DataFrame]:
    """(current hash of each document, first ingestion of each version)."""
    return keep_last(events, ["document_name"], seq), keep_first(events, ["document_name", "source_hash"], seq)


def supersede(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, items: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """pairs (old, new): both edges between them, the old node superseded, its items gone."""
    def tie(a: str, b: str, label: str) -> DataFrame:
        return pairs.select(edge_id(F.col(a), F.col(b), F.lit(label)).alias("id"), F.col(a).alias("source_node_id"), F.col(b).alias("target_node_id"), F.lit(label).alias("label"), F.lit(now).alias("created_at"))

    ties = tie("old", "new", "superseded_by").unionByName(tie("new", "old", "supersedes"))
    all_edges = edges.unionByName(ties, allowMissingColumns=True).withColumn("_o", F.col("created_at")).transform(lambda d: newest(d, ["id"], [F.col("_o")])).drop("_o")
    return set_status(nodes, pairs.select("old"), SUPERSEDED, now), all_edges, without(items, "node_id", pairs.select("old"))


def remap_edges(edges: DataFrame, pairs: DataFrame, labels: Sequence[str] = ("follows", "reference", "supports")) -> DataFrame:
    """Edges of the labels moved from old to new nodes under new ids; loops that would arise are left out."""
    old, new = F.col("_old"), F.col("_new")
    source = pairs.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    moved = edges.filter(F.col("label").isin(*labels))
    moved = moved.join(source, F.col("source_node_id") == old, "left").withColumn("_s", F.coalesce(new, F.col("source_node_id"))).drop("_old", "_new")
    moved = moved.join(source, F.col("target_node_id") == old, "left").withColumn("_t", F.coalesce(new, F.col("target_node_id"))).drop("_old", "_new")
    moved = moved.filter(F.col("_s") != F.col("_t")).withColumn("id", edge_id(F.col("_s"), F.col("_t"), F.col("label"))).withColumn("source_node_id", F.col("_s")).withColumn("target_node_id", F.col("_t")).drop("_s", "_t")
    return edges.filter(~F.col("label").isin(*labels)).unionByName(newest(moved, ["id"], [F.col("created_at")]))

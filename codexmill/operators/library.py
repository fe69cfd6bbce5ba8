"""The document library: grouping, topics, reading order, reconstruction, layout figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexmill.functions.ids import or_else


def mode_of(rows: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """group columns and the most frequent value; of ties the one that reaches the count first in ``order``."""
    w = Window.partitionBy(*group, value)
    counted = rows.withColumn("_c", F.count(F.lit(1)).over(w)).groupBy(*group, value).agg(F.max("_c").alias("n"), F.max(order).alias("_reached"))
    best = Window.partitionBy(*group).orderBy(F.col("n").desc(), "_reached", value)
    return counted.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") == 1).select(*group, value)


def documents(nodes: DataFrame, agent_document: str = "Agent notes") -> DataFrame:
    """(name, pages, cluster, any_exogenous, recency): one row per document, cluster by majority."""
    named = nodes.withColumn("name", F.coalesce(or_else(F.col("original_document_name")), F.when(F.col("type") == "exogenous", agent_document).otherwise("Untitled")))
    named = named.withColumn("_cluster", F.coalesce(or_else(F.col("cluster")), F.lit("Uncategorized"))).withColumn("_o", F.struct("updated_at", "id"))
    facts = named.groupBy("name").agg(F.count(F.lit(1)).alias("pages"), F.max(F.when(F.col("type") == "exogenous", 1).otherwise(0)).alias("any_exogenous"), F.max(F.greatest("updated_at", "created_at")).alias("recency"))
    return facts.join(mode_of(named, ["name"], "_cluster", "_o"), "name").select("name", "pages", F.col("_cluster").alias("cluster"), "any_exogenous", "recency")


def topics(nodes: DataFrame) -> DataFrame:
    """(cluster, documents, nodes): the two-level topic view, counted."""
    named = nodes.select(F.coalesce(or_else(F.col("cluster")), F.lit("Uncategorized")).alias("cluster"), F.coalesce(or_else(F.col("original_document_name")), F.lit("Untitled")).alias("name"))
    return named.groupBy("cluster", "name").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("nodes"))


def reconstructed(pages: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(document, body, first_lines) from pages (document, ord, body): bodies joined in order, and where each begins.

    A document is one row of the result, so its pages do meet in one place.
    """
    gathered = pages.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("ord", "body"))).alias("p"))
    bodies = F.transform("p", lambda x: x["body"])
    return gathered.select("document", F.array_join(bodies, separator).alias("body"))


def line_offsets(pages: DataFrame, between: int = 1) -> DataFrame:
    """(document, ord, first_line): the running number of lines before each page."""
    w = Window.partitionBy("document").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    lines = F.size(F.split("body", "\n")) + between
    return pages.withColumn("_n", lines).select("document", "ord", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("first_line"))


def group_stats(nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """(cluster, size, degree_sum, degree_max, leaves, score): score = 1.7 * max + mean degree."""
    own = nodes.select("id", F.coalesce(or_else(F.col("cluster")), F.lit("Misc")).alias("cluster")).join(degrees.select("id", "degree"), "id")
    return own.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum("degree").alias("degree_sum"), F.max("degree").alias("degree_max"), F.sum(F.when(F.col("degree") <= 1, 1).otherwise(0)).alias("leaves"), F.round(1.7 * F.max("degree") + F.avg("degree"), 6).alias("score"))


def cluster_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, n): edges between different clusters, by unordered pair."""
    own = nodes.select("id", F.coalesce(or_else(F.col("cluster")), F.lit("Misc")).alias("cluster"))
    a, b = own.toDF("_i", "_ca"), own.toDF("_j", "_cb")
    tied = edges.join(a, F.col("source_node_id") == F.col("_i")).join(b, F.col("target_node_id") == F.col("_j")).filter(F.col("_ca") != F.col("_cb"))
    return tied.groupBy(F.least("_ca", "_cb").alias("a"), F.greatest("_ca", "_cb").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def extents(points: DataFrame) -> DataFrame:
    """(cluster, x, y, max_dev, rms_dev) from points (cluster, x, y)."""
    w = Window.partitionBy("cluster")
    dx, dy = F.col("x") - F.avg("x").over(w), F.col("y") - F.avg("y").over(w)
    off = points.withColumn("_d", F.sqrt(dx * dx + dy * dy))
    return off.groupBy("cluster").agg(F.round(F.avg("x"), 6).alias("cx"), F.round(F.avg("y"), 6).alias("cy"), F.round(F.max("_d"), 6).alias("max_dev"), F.round(F.sqrt(F.avg(F.col("_d") ** 2)), 6).alias("rms_dev"))


def grouping_key(nodes: DataFrame, share: float = 0.4) -> DataFrame:
    """One row: whether clusters are so many (over 0.4 of the nodes) that coarse names should group them."""
    return nodes.agg((F.countDistinct(F.coalesce(or_else(F.col("cluster")), F.lit("Misc"))) > share * F.count(F.lit(1))).alias("coarse"))


def mean_vectors(vectors: DataFrame, group: str) -> DataFrame:
    """(group, embedding): element-wise means, by position."""
    parts = vectors.select(group, F.posexplode("embedding").alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: F.round(e["x"], 6)).alias("embedding"))

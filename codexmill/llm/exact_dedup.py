"""Exact deduplication with a split between frequent and ordinary digests.

Method: a Misra-Gries style frequent-items sketch (Spark's ``approx_top_k``, which
merges partial sketches on the map side) proposes frequent digests. An exact count
verifies them, and their winners, at most ``heavy`` rows, are broadcast, so rows of
huge groups are settled where they lie. Only the other digests are shuffled, and no
group among those can be large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, take, text_hash, text_of

#: Frequent digests at most, hence the row bound of the broadcast.
HEAVY = 256
#: Counters that each partial sketch keeps.
TRACKED = 4096


def exact_dedup(docs: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, text_hash.

    * Texts are equal when identical; a null text equals an empty one.
    * The row with the largest doc_id stays. Null doc_ids rank last, so keep_id is
      null only where every doc_id of the group is null.
    * Rows that repeat both doc_id and text are copies as well: exactly one stays.
    * An empty table gives no rows; other columns of the input play no part.
    """
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text_of(), 256).alias("text_sha256"), text_hash().alias("text_hash")).withColumn("_tag", F.monotonically_increasing_id()))
    winners = F.broadcast(verified(rows, candidates(rows, heavy, tracked)))

    marked = rows.join(winners, rows["text_sha256"] == winners["_digest"], "left")
    settled = marked.filter(F.col("_digest").isNotNull()).select("doc_id", F.col("_top.doc_id").alias("keep_id"), "group_size", (F.col("_tag") == F.col("_top._tag")).alias("kept"), "text_sha256", "text_hash")

    group = Window.partitionBy("text_sha256")
    first = group.orderBy(F.col("doc_id").desc_nulls_last(), "_tag")
    whole = first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shuffled = marked.filter(F.col("_digest").isNull()).select(
        "doc_id", F.first("doc_id").over(whole).alias("keep_id"), F.count(F.lit(1)).over(whole).alias("group_size"), (F.row_number().over(first) == 1).alias("kept"), "text_sha256", "text_hash"
    )
    return settled.unionByName(shuffled)


def candidates(rows: DataFrame, heavy: int, tracked: int) -> DataFrame:
    """At most ``heavy`` digests that the sketch holds for frequent."""
    sketch = rows.agg(F.expr(f"approx_top_k(text_sha256, {heavy}, {tracked})").alias("top"))
    return sketch.select(F.explode("top.item").alias("_digest"))


def verified(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Exact size and winner of each candidate; the winner is the largest doc_id, ties to the first row."""
    own = rows.join(F.broadcast(found), rows["text_sha256"] == found["_digest"])
    best = F.max(F.struct(F.col("doc_id"), (-F.col("_tag")).alias("_tag"))).alias("_top")
    return own.groupBy("_digest").agg(best, F.count(F.lit(1)).alias("group_size")).select("_digest", "group_size", F.struct(F.col("_top.doc_id").alias("doc_id"), (-F.col("_top._tag")).alias("_tag")).alias("_top"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that ``exact_dedup`` keeps, with all their columns."""
    return take(docs, exact_dedup(docs).select("doc_id", "text_hash", F.col("kept").cast("int").alias("n")))

"""Evidence-first hybrid retrieval: pools, rank fusion, caps, relevance, diversity, nodes.

Queries are a table, so any number of questions share one plan. Hits are rows
(query_id, pool, rank, weight, node_id, field, item_id, text, start_char); pool numbers
settle ties in the order of the pools.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexmill.functions.ids import strip
from codexmill.functions.text import snippet, token_set

RRF_K = 60
#: Weight of a vector hit by the field of its item; others count as small chunks. Fixed values.
ITEM_WEIGHTS = {"title": 1.30, "claim": 1.25, "small_chunk": 1.15, "summary": 1.00, "big_chunk": 0.95}
#: Pools: (number, size, weight). The item vector pool weighs by field. Fixed values.
NODE_BM25, BODY_VEC, SUMMARY_VEC, ITEM_VEC, ITEM_BM25 = (0, 50, 0.90), (1, 50, 0.75), (2, 50, 1.00), (3, 300, None), (4, 150, 1.35)
PER_NODE, PER_FIELD, REGION = 3, 2, 200
POOL_CAP, LAMBDA, LIMIT = 120, 0.75, 50


def item_weight(field: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in ITEM_WEIGHTS.items() for x in pair])[field], F.lit(ITEM_WEIGHTS["small_chunk"]))


def contribution(weight: Column, rank: Column, k: int = RRF_K) -> Column:
    return weight / (k + rank)


def fused(hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, node_id, rrf): the sum of a node's contributions over all pools."""
    return hits.groupBy("query_id", "node_id").agg(F.round(F.sum(contribution(F.col("weight"), F.col("rank"), k)), 6).alias("rrf"))


def why(hits: DataFrame) -> DataFrame:
    """(query_id, node_id, why): the best rank of each field, best first."""
    best = hits.groupBy("query_id", "node_id", "field").agg(F.min("rank").alias("rank"))
    return best.groupBy("query_id", "node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "field"))), lambda x: F.concat_ws("#", x["field"], x["rank"].cast("string"))).alias("why"))


def active_hits(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hits on active nodes; an empty text becomes the node's snippet."""
    own = nodes.filter(F.col("status") == "active").select(F.col("id").alias("_id"), snippet(F.col("summary"), F.col("title")).alias("_snippet"))
    return hits.join(own, F.col("node_id") == F.col("_id")).withColumn("text", F.when(strip(F.coalesce("text", F.lit(""))) == "", F.col("_snippet")).otherwise(F.col("text"))).drop("_id", "_snippet")


def capped(hits: DataFrame, per_node: int = PER_NODE, per_field: int = PER_FIELD, region: int = REGION) -> DataFrame:
    """Evidence of each node: at most per_node hits, per_field of a field, one of an item or text, chunks ``region`` apart.

    One pass over the node's hits, best contribution first, inside the JVM: the
    accumulator is the list of what is kept. A node's hits are bounded by the pools.
    """
    order = F.struct((-F.round(contribution(F.col("weight"), F.col("rank")), 9)).alias("o"), "pool", "rank", "weight", "field", "item_id", "text", "start_char")
    rows = hits.groupBy("query_id", "node_id").agg(F.array_sort(F.collect_list(order)).alias("hits"))
    key = lambda h: F.coalesce(F.nullif(h["item_id"], F.lit("")), F.substring(h["text"], 1, 80))
    chunk = lambda h: h["field"].isin("small_chunk", "big_chunk") & h["start_char"].isNotNull()

    def step(kept: Column, h: Column) -> Column:
        room = (F.size(kept) < per_node) & (strip(F.coalesce(h["text"], F.lit(""))) != "")
        new = ~F.exists(kept, lambda x: key(x) == key(h)) & (F.size(F.filter(kept, lambda x: x["field"] == h["field"])) < per_field)
        apart = ~(chunk(h) & F.exists(kept, lambda x: chunk(x) & (F.abs(x["start_char"] - h["start_char"]) < region)))
        return F.when(room & new & apart, F.concat(kept, F.array(h))).otherwise(kept)

    kept = F.aggregate("hits", F.slice("hits", 1, 0), step)
    return rows.select("query_id", "node_id", F.explode(kept).alias("h")).select("query_id", "node_id", "h.pool", "h.rank", "h.weight", "h.field", "h.item_id", "h.text", "h.start_char")


def relevance(evidence: DataFrame, scores: Column | None = None, cap: int = POOL_CAP) -> DataFrame:
    """The pool of each query, ``cap`` best by contribution, with rel from 0 to 1 (all 1 where they are equal).

    scores: of a reranker, null counting as 0; without one, contributions stand.
    """
    rows = evidence.withColumn("contribution", contribution(F.col("weight"), F.col("rank"))).filter(strip("text") != "")
    w = Window.partitionBy("query_id").orderBy(F.round("contribution", 9).desc(), "pool", "rank", "node_id")
    rows = rows.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= cap)
    rows = rows.withColumn("_s", F.coalesce(scores, F.lit(0.0)) if scores is not None else F.col("contribution"))
    q = Window.partitionBy("query_id")
    low, high = F.min("_s").over(q), F.max("_s").over(q)
    return rows.withColumn("rel", F.when(high - low < 1e-9, 1.0).otherwise((F.col("_s") - low) / (high - low))).drop("_s")


def mmr_order(sets: list[set], rel: list[float], lam: float) -> list[int]:
    """Greedy order by lam * rel - (1 - lam) * the closest overlap with what is chosen; ties to the first."""
    n = len(sets)
    closest, left, order = np.zeros(n), np.ones(n, dtype=bool), []
    rel_ = np.asarray(rel, dtype=float)
    for _ in range(n):
        score = np.where(left, lam * rel_ - (1 - lam) * closest, -np.inf)
        best = int(score.argmax())
        order.append(best)
        left[best] = False
        for j in np.flatnonzero(left):
            union = len(sets[best] | sets[j])
            if sets[best] and sets[j]:
                closest[j] = max(closest[j], len(sets[best] & sets[j]) / union)
    return order


def diversified(pool: DataFrame, lam: float = LAMBDA) -> DataFrame:
    """The pool with mmr, its place in the greedy order, from 0; at most POOL_CAP rows a query are in one group."""
    schema = "query_id string, node_id string, field string, item_id string, text string, rel double, position int, mmr int"

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position").reset_index(drop=True)
        order = mmr_order([set(t) for t in pdf["_tokens"]], pdf["rel"].tolist(), lam)
        pdf["mmr"] = pd.Series(range(len(order)), index=order, dtype="int32")
        return pdf.drop(columns="_tokens")[["query_id", "node_id", "field", "item_id", "text", "rel", "position", "mmr"]]

    rows = pool.select(F.col("query_id").cast("string").alias("query_id"), "node_id", "field", "item_id", "text", "rel", F.col("position").cast("int").alias("position"), token_set(F.col("text")).alias("_tokens"))
    return rows.groupBy("query_id").applyInPandas(place, schema)


def hybrid(hits: DataFrame, nodes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(query_id, rank, node_id, score, why, evidence): the whole pipeline from the pools' hits on.

    score is the best relevance of the node's evidence in the pool, or 0, plus its
    fused rank score; evidence is its texts in the order of diversity.
    """
    own = active_hits(hits.withColumn("query_id", F.col("query_id").cast("string")), nodes)
    placed = diversified(relevance(capped(own)))
    per_node = placed.groupBy("query_id", "node_id").agg(F.max("rel").alias("best"), F.transform(F.array_sort(F.collect_list(F.struct("mmr", "field", "text"))), lambda x: x["text"]).alias("evidence"))
    scored = fused(own).join(per_node, ["query_id", "node_id"], "left").withColumn("score", F.round(F.coalesce("best", F.lit(0.0)) + F.col("rrf"), 6))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "node_id")
    top = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return top.join(why(own), ["query_id", "node_id"]).select("query_id", "rank", "node_id", "score", "why", F.slice(F.coalesce("evidence", F.array().cast("array<string>")), 1, PER_NODE).alias("evidence"))

"""Exact nearest neighbours by Euclidean distance for tables of queries and vectors.

Vectors are packed into segments, queries into batches, a copy of each batch to each
segment; one pair of them is a bounded piece of numpy work, and only the k nearest of
each pair go on. Nothing is collected and no side needs to be small.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEGMENT, BATCH = 8192, 512


def pack(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """part, ids, n, m: one row for each part of rows (key, v)."""
    def packed(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        m = np.array(t["v"].to_pylist(), dtype=np.float64)
        return pa.table({"part": t["part"].slice(0, 1), "ids": pa.array([t["id"].to_pylist()], pa.list_(pa.string())), "n": pa.array([len(m)], pa.int32()), "m": pa.array([m.tobytes()], pa.binary())})

    dealt = rows.select(F.col(key).cast("string").alias("id"), F.col("v").cast("array<double>").alias("v")).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    return dealt.groupBy("part").applyInArrow(packed, "part int, ids array<string>, n int, m binary")


def nearest(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            m, q = (np.frombuffer(row[c], dtype=np.float64).reshape(row[n], -1) for c, n in (("m", "n"), ("q_m", "q_n")))
            ids, q_ids = np.array(row["ids"], dtype=object), row["q_ids"]
            out: dict[str, list] = {"query_id": [], "id": [], "distance": []}
            for at in range(0, len(q), 32):
                d = np.sqrt(((q[at : at + 32, None, :] - m[None]) ** 2).sum(-1))
                for j, row_d in enumerate(d):
                    near = np.flatnonzero(row_d <= np.partition(row_d, k - 1)[k - 1]) if len(row_d) > k else np.arange(len(row_d))
                    order = near[np.lexsort((ids[near], row_d[near]))][:k]
                    out["query_id"] += [q_ids[at + j]] * len(order)
                    out["id"] += ids[order].tolist()
                    out["distance"] += row_d[order].tolist()
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(out["query_id"], pa.string()), "id": pa.array(out["id"], pa.string()), "distance": pa.array(out["distance"], pa.float64())})


def knn(queries: DataFrame, vectors: DataFrame, k: int, segment: int = SEGMENT, batch: int = BATCH) -> DataFrame:
    """(query_id, rank, id, distance) for queries (query_id, v) against vectors (id, v), both ids as text.

    The limit comes before any filter on state; join the result with active nodes
    afterwards, which may leave fewer than k. Null vectors take no part.
    """
    vectors, queries = vectors.filter(F.col("v").isNotNull()), queries.filter(F.col("v").isNotNull())
    segments, batches = max(1, math.ceil(vectors.count() / segment)), max(1, math.ceil(queries.count() / batch))
    docs = pack(vectors, "id", segments)
    sent = pack(queries, "query_id", batches).select(F.col("ids").alias("q_ids"), F.col("n").alias("q_n"), F.col("m").alias("q_m"), F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("q_to"))
    pairs = docs.join(sent, F.col("part") == F.col("q_to"))
    hits = pairs.mapInArrow(lambda b: nearest(b, k), "query_id string, id string, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


def candidates(hits: DataFrame, active_ids: DataFrame, k: int) -> DataFrame:
    """Neighbours of each query over several vector pools: (query_id, pool, rank, id, distance) in;
    keep-first by (pool, rank), self dropped, active only, at most k."""
    one = Window.partitionBy("query_id", "id").orderBy("pool", "rank")
    first = hits.filter(F.col("query_id") != F.col("id")).withColumn("_n", F.row_number().over(one)).filter(F.col("_n") == 1).drop("_n")
    kept = first.join(active_ids.toDF("id"), "id", "left_semi")
    w = Window.partitionBy("query_id").orderBy("pool", "rank", "id")
    return kept.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k).select("query_id", "position", "id")


def nearest_cluster(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, id, cluster) of the nearest active neighbour, not itself, that has a cluster."""
    named = nodes.filter((F.col("status") == "active") & (F.coalesce(F.col("cluster"), F.lit("")) != "")).select("id", "cluster")
    found = hits.filter(F.col("query_id") != F.col("id")).join(named, "id")
    w = Window.partitionBy("query_id").orderBy("rank")
    return found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1).select("query_id", "id", "cluster")

"""Exact top-k by inner product with block-at-a-time pruning.

Vectors are dealt to the nearest of a fixed number of pivots, and these cells to segments
of bounded size; in a segment they are put in an order that keeps alike ones together and
cut into ranges, the blocks. A block keeps its rows (the forward index) and, for every
dimension, its largest and smallest value. A query's bound on a block is the sum over
dimensions of the larger product with the two, which no score in the block can pass.
Blocks are scored in falling order of their bounds until the bound falls below the k-th
score found.

There are two passes. The first scores every query in its own segment, where its like
are, which gives it a k-th score to begin with. The second takes it, with that score, to
those other segments whose own bounds reach it. Segments are packed once and meet all
queries of a slice together, so it is the queries that move.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K = 5
#: Rows of a block and of a segment, about.
BLOCK, SEGMENT = 32, 4096
#: Cells that vectors are dealt to; larger cells are cut into several segments.
PIVOTS = 64
#: Queries that meet a segment at a time, and segments whose bounds a query meets at a time, about.
SLICE, GROUP = 8192, 256
QUERY = "q_id long, q_tag long, q_v array<long>, home int, slice int, floor long"


def integers(embedding: Column) -> Column:
    """floor(256 * x) of every component as long; null if the vector or a component is null or not finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(embedding.isNotNull() & ~bad, F.transform(embedding, lambda x: F.floor(x.cast("double") * 256)))


def exact_topk(vectors: DataFrame, k: int = K, every: int = 50, block: int = BLOCK, segment: int = SEGMENT, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query.

    * Queries are the rows whose vec_id is divisible by ``every``, candidates all rows
      but the query's own; ties go to the smaller vec_id.
    * Vectors that are null or hold null or non-finite components take no part, nor do
      rows without vec_id. Shorter vectors count as padded with zeros.
    * Rows that repeat a vec_id are separate rows: each is a candidate, and each is a
      query of its own under the same query_id.
    * Fewer than k candidates give all of them; an empty table gives no rows.
    * Components so large that a score could leave the range of a long are an error.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding").cast("array<double>")).alias("v"))
    rows = cut(rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).withColumn("tag", F.monotonically_increasing_id()))
    placed, segments = dealt_to_segments(rows, segment, pivots)
    if not segments:
        return placed.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.col("tag").alias("score")).limit(0)
    packed = "part int, n int, d int, ids binary, tags binary, m binary, high binary, low binary"
    docs = cut(placed.select("part", "vec_id", "tag", "v").groupBy("part").applyInArrow(pack, packed))

    asked = placed.filter(F.pmod("vec_id", F.lit(every)) == 0)
    slices = max(1, math.ceil(asked.count() / SLICE))
    slice_ = F.floor(F.col("part") * slices / segments).cast("int")
    asked = asked.select(F.col("vec_id").alias("q_id"), F.col("tag").alias("q_tag"), F.col("v").alias("q_v"), F.col("part").alias("home"), slice_.alias("slice"))
    first = cut(visited(docs, asked.withColumns({"floor": F.lit(None).cast("long"), "part": F.col("home")}), k, block))

    known = first.groupBy(F.col("q_tag").alias("_q")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    told = asked.join(known, F.col("q_tag") == F.col("_q"), "left").drop("_q")
    hits = first.unionByName(visited(docs, reached(docs, told, segments), k, block))
    best = Window.partitionBy("q_id", "q_tag").orderBy(F.col("score").desc(), "vec_id", "tag")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(F.col("q_id").alias("query_id"), "rank", "vec_id", "score")


def dealt_to_segments(rows: DataFrame, segment: int, pivots: int) -> tuple[DataFrame, int]:
    """The rows with their segment (part), and how many segments there are.

    A row's cell is that of the pivot it is nearest to by direction; a cell of more than
    ``segment`` rows is cut by hash. Pivots and sizes of cells are all the driver sees.
    """
    chosen = [r["v"] for r in rows.orderBy(F.xxhash64("tag"), "tag").select("v").limit(pivots).collect()]
    celled = cut(rows.mapInArrow(lambda b: in_cells(b, chosen), "vec_id long, v array<long>, tag long, cell int"))
    table, at = [], 0
    for cell, n in sorted(map(tuple, celled.groupBy("cell").count().collect())):
        table.append((cell, at, math.ceil(n / segment)))
        at += table[-1][2]
    places = rows.sparkSession.createDataFrame(table, "cell int, _first int, _parts int")
    part = (F.col("_first") + F.pmod(F.xxhash64("tag"), F.col("_parts"))).cast("int")
    return celled.join(F.broadcast(places), "cell").select("vec_id", "v", "tag", part.alias("part")), at


def matrix(lists: pa.ListArray) -> np.ndarray:
    """Rows of equal length, shorter ones padded with zeros."""
    lengths = np.diff(lists.offsets.to_numpy())
    m = np.zeros((len(lists), int(lengths.max(initial=0))), dtype=np.int64)
    at = np.repeat(np.arange(len(lists)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    m[at] = lists.flatten().to_numpy()
    return m


def widened(*arrays: np.ndarray) -> list[np.ndarray]:
    """The matrices with as many columns as the widest."""
    d = max(a.shape[1] for a in arrays)
    return [np.pad(a, ((0, 0), (0, d - a.shape[1]))) for a in arrays]


def exactly(queries: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """All as doubles where every product sum is exact so, else as longs."""
    queries, *others = widened(queries, *others)
    most = max((float(np.abs(x.astype(float)).max(initial=0)) for x in others), default=0.0)
    largest = most * float(np.abs(queries.astype(float)).max(initial=0)) * max(1, queries.shape[1])
    if largest >= 2**63:
        raise ValueError("an inner product could leave the range of a long")
    kind = np.float64 if largest < 2**53 else np.int64
    return [x.astype(kind) for x in (queries, *others)]


def upper(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What no product of a query with a row between low and high can pass."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def nearest(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    m, pivots = widened(m, pivots)
    norms = np.maximum(np.linalg.norm(pivots.astype(float), axis=1), 1)
    return (m.astype(float) @ (pivots / norms[:, None]).T).argmax(axis=1) if len(pivots) and len(m) else np.zeros(len(m), int)


def in_cells(batches: Iterator[pa.RecordBatch], chosen: list[list[int]]) -> Iterator[pa.RecordBatch]:
    pivots = matrix(pa.array(chosen, pa.list_(pa.int64())))
    for b in batches:
        yield pa.RecordBatch.from_pydict({"vec_id": b["vec_id"], "v": b["v"], "tag": b["tag"], "cell": pa.array(nearest(matrix(b["v"]), pivots), pa.int32())})


def pack(group: pa.Table) -> pa.Table:
    """One row with the ids, the matrix and the outer bounds of a segment, alike vectors side by side."""
    m = matrix(group["v"].combine_chunks())
    ids, tags = group["vec_id"].to_numpy(), group["tag"].to_numpy()
    order = np.lexsort((tags, nearest(m, m[np.argsort(tags, kind="stable")[:: max(1, len(m) // 48)]])))
    data = {c: [x.tobytes()] for c, x in (("ids", ids[order]), ("tags", tags[order]), ("m", m[order]), ("high", m.max(axis=0)), ("low", m.min(axis=0)))}
    return pa.table({"part": pa.array([group["part"][0].as_py()], pa.int32()), "n": pa.array([m.shape[0]], pa.int32()), "d": pa.array([m.shape[1]], pa.int32())} | data)


def numbers(row: dict, name: str) -> np.ndarray:
    return np.frombuffer(row[name], dtype=np.int64)


def reached(docs: DataFrame, asked: DataFrame, segments: int) -> DataFrame:
    """The queries with each other segment whose bound is no less than their k-th score so far."""
    groups = math.ceil(segments / GROUP)
    bounds = docs.select(F.floor(F.col("part") / GROUP).alias("_group"), F.struct("part", "high", "low").alias("_s")).groupBy("_group").agg(F.collect_list("_s").alias("_segments"))
    own = asked.groupBy("home", "slice").agg(F.collect_list(F.struct("q_id", "q_tag", "q_v", "floor")).alias("_queries"))
    met = own.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(bounds, F.col("_to") == F.col("_group")).select("home", "slice", "_queries", "_segments")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                others = [s for s in row["_segments"] if s["part"] != row["home"]]
                if not others:
                    continue
                high, low = (matrix(pa.array([numbers(s, c) for s in others], pa.list_(pa.int64()))) for c in ("high", "low"))
                m = matrix(pa.array([q["q_v"] for q in row["_queries"]], pa.list_(pa.int64())))
                q, h, w = exactly(m, high, low)
                floors = np.array([-np.inf if x["floor"] is None else x["floor"] for x in row["_queries"]])
                who, which = np.nonzero(upper(q, h, w) >= floors[:, None])
                if len(who):
                    some = pa.array(row["_queries"], pa.struct([("q_id", pa.int64()), ("q_tag", pa.int64()), ("q_v", pa.list_(pa.int64())), ("floor", pa.int64())])).take(pa.array(who))
                    same = lambda x: pa.array(np.full(len(who), x), pa.int32())  # noqa: E731, B023
                    parts = np.array([s["part"] for s in others])[which]
                    yield pa.RecordBatch.from_pydict({c: some.field(c) for c in ("q_id", "q_tag", "q_v")} | {"home": same(row["home"]), "slice": same(row["slice"]), "floor": some.field("floor"), "part": pa.array(parts, pa.int32())})

    return met.mapInArrow(pairs, f"{QUERY}, part int")


def visited(docs: DataFrame, wanted: DataFrame, k: int, block: int) -> DataFrame:
    """The k best rows of each wanted segment for each query that wants it; a segment travels once for each slice that does."""
    called = wanted.select(F.col("part").alias("_part"), F.col("slice").alias("_slice")).distinct()
    here = docs.join(called, F.col("part") == F.col("_part")).select("_part", "_slice", "n", "d", "ids", "tags", "m")
    found = lambda a, b: searched(a, b, k, block)
    return here.groupBy("_part", "_slice").cogroup(wanted.groupBy("part", "slice")).applyInArrow(found, "q_id long, q_tag long, vec_id long, tag long, score long")


def searched(docs: pa.Table, wanted: pa.Table, k: int, block: int) -> pa.Table:
    row, q_ids, q_tags = docs.select(["n", "d", "ids", "tags", "m"]).to_pylist()[0], wanted["q_id"].to_numpy(), wanted["q_tag"].to_numpy()
    ids, tags, m = numbers(row, "ids"), numbers(row, "tags"), numbers(row, "m").reshape(row["n"], row["d"])
    floors = np.array([-np.inf if x is None else x for x in wanted["floor"].to_pylist()])
    q, at, score, _ = best_of(m, ids, tags, matrix(wanted["q_v"].combine_chunks()), q_tags, floors, k, block)
    return pa.table({"q_id": q_ids[q], "q_tag": q_tags[q], "vec_id": ids[at], "tag": tags[at], "score": score})


def best_of(docs: np.ndarray, ids: np.ndarray, tags: np.ndarray, queries: np.ndarray, q_tags: np.ndarray, floors: np.ndarray, k: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(query, row, score) of each query's k best rows but its own, by score and then smaller id, and the share of blocks not scored.

    Rows below a query's floor may be left out.
    """
    queries, docs = exactly(queries, docs)
    starts = np.arange(0, len(docs), block)
    bounds = upper(queries, np.maximum.reduceat(docs, starts), np.minimum.reduceat(docs, starts))
    order = np.argsort(-bounds, axis=1, kind="stable")

    nothing = -np.iinfo(np.int64).max
    m, scored = len(queries), 0
    score, row = np.full((m, k), nothing, dtype=np.int64), np.full((m, k), -1)
    rank_of = np.empty(len(docs), dtype=np.int64)  # position by (id, tag), to settle ties
    rank_of[np.lexsort((tags, ids))] = np.arange(len(docs))
    for turn in range(len(starts)):
        mine = order[:, turn]
        bound = bounds[np.arange(m), mine]
        going = np.flatnonzero((bound >= floors) & ((row[:, -1] < 0) | (bound >= score[:, -1])))
        if not len(going):
            break
        scored += len(going)
        by_block = going[np.argsort(mine[going], kind="stable")]
        for own in np.split(by_block, np.flatnonzero(np.diff(mine[by_block])) + 1):
            at = np.arange(starts[mine[own[0]]], min(starts[mine[own[0]]] + block, len(docs)))
            found = (queries[own] @ docs[at].T).astype(np.int64)
            found = np.where(tags[at][None, :] == q_tags[own][:, None], nothing, found)
            rows = np.where(found == nothing, -1, at[None, :])
            scores = np.concatenate([score[own], found], axis=1)
            rows = np.concatenate([row[own], rows], axis=1)
            ties = np.where(rows < 0, len(docs), rank_of[rows])
            best = np.lexsort((ties, -scores), axis=1)[:, :k]
            score[own], row[own] = np.take_along_axis(scores, best, 1), np.take_along_axis(rows, best, 1)
    q, place = np.nonzero(row >= 0)
    return q, row[q, place], score[q, place], 1 - scored / max(1, m * len(starts))

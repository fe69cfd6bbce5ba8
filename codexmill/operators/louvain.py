"""Communities by modularity over levels: nodes move, communities become nodes, and again.

A level's rounds move nodes to the neighbouring community with the largest gain, as joins
and sums. Nodes that move at once may spoil each other's gain, so a round of half of
the nodes counts only if modularity has risen; else a round follows in which every
community loses or takes one node at most: moves between separate pairs of communities
add up exactly. When no move gains any more, communities are contracted to nodes of the
next level, edges inside them to loops, until a level raises modularity no further.

Ids are numbered in their order, so that rounds shuffle numbers alone. A round tells each
node's community and that community's total along the edges, and shuffles what they carry
once more, by the node it is told to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import written

#: Rise in modularity below which a round or a level counts for nothing.
ROUND_RISE, LEVEL_RISE = 1e-3, 1e-7
#: Rounds whose draws of half of the nodes are kept as bits of one number.
DRAWS = 62


def numbered(ids: DataFrame) -> DataFrame:
    """(name, id): the distinct ids (one column) by numbers that are in order as they are."""
    spread = ids.toDF("name").distinct().repartitionByRange("name").sortWithinPartitions("name")
    return written(spread.withColumn("id", F.monotonically_increasing_id()))


def draws(names: DataFrame, first: int) -> DataFrame:
    """(id, draws): a bit for each of the ``DRAWS`` rounds from ``first`` on, set if the name is drawn in it."""
    bits = [F.when(F.pmod(F.xxhash64("name", F.lit(first + i)), F.lit(2)) == 0, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(DRAWS)]
    return names.select("id", F.aggregate(F.array(*bits), F.lit(0).cast("long"), lambda x, y: x + y).alias("draws"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(id, other, weight) in either direction, without loops; edges: a, b, weight."""
    apart = edges.filter(F.col("a") != F.col("b"))
    return apart.select(F.col("a").alias("id"), F.col("b").alias("other"), "weight").unionByName(apart.select(F.col("b").alias("id"), F.col("a").alias("other"), "weight"))


def start(edges: DataFrame) -> DataFrame:
    """(id, k, inside, community): every node of an edge alone; k its degree, to which a loop adds twice, and inside twice its loop."""
    ends = both_ways(edges).select("id", F.col("weight").alias("k"), F.lit(0.0).alias("inside"))
    loops = edges.filter(F.col("a") == F.col("b")).select(F.col("a").alias("id"), (2 * F.col("weight")).alias("k"), (2 * F.col("weight")).alias("inside"))
    return ends.unionByName(loops).groupBy("id").agg(F.sum("k").alias("k"), F.sum("inside").alias("inside")).withColumn("community", F.col("id"))


def best_moves(near: DataFrame, state: DataFrame, twice: float, resolution: float) -> DataFrame:
    """(id, k, inside, draws, community, to, gain, own): each node's best community, its own if none gains; ties to the smaller one.

    near: both_ways with the degree k of id; gain: what the move adds to modularity, times
    half of ``twice``. own: the node's weight to its own community.
    """
    sums = state.groupBy("community").agg(F.sum("k").alias("total"))
    told = state.join(sums, "community")
    none = F.lit(None)
    met = near.join(told.select(F.col("id").alias("other"), "community", "total"), "other").select("id", "community", "total", "k", F.col("weight").alias("w"), none.cast("double").alias("inside"), none.cast("long").alias("draws"))
    stay = told.select("id", "community", "total", "k", F.lit(0.0).alias("w"), "inside", "draws")
    # Both groupings find their rows where the one shuffle by id has put them.
    options = met.unionByName(stay).repartition("id").groupBy("id", "community").agg(F.sum("w").alias("w"), *[F.max(c).alias(c) for c in ("total", "k", "inside", "draws")])
    at_home = F.col("inside").isNotNull()
    other = F.col("total") - F.when(at_home, F.col("k")).otherwise(0.0)
    # Rounded, so that the order in which sums were added up decides no tie.
    value = F.round(F.col("w") - resolution * F.col("k") * other / twice, 9)
    valued = options.withColumn("value", value)
    found = valued.groupBy("id").agg(
        F.min(F.struct((-F.col("value")).alias("loss"), (~at_home).alias("away"), "community")).alias("best"), F.max(F.when(at_home, F.struct("value", "w", "k", "inside", "draws", "community"))).alias("home")
    )
    gain = F.round(-F.col("best.loss") - F.col("home.value"), 9)
    return found.select("id", "home.k", "home.inside", "home.draws", "home.community", F.col("best.community").alias("to"), gain.alias("gain"), F.col("home.w").alias("own"))


def modularity_of(moves: DataFrame, twice: float, resolution: float) -> float:
    per = moves.groupBy("community").agg(F.sum(F.col("own") + F.col("inside")).alias("inside"), F.sum("k").alias("total"))
    found = per.agg(F.sum(F.col("inside") / twice - resolution * (F.col("total") / twice) ** 2)).first()[0]
    return found or 0.0


def apart(moves: DataFrame) -> DataFrame:
    """Of the moves those that are the best one of both communities they touch."""
    touched = moves.select("id", "gain", F.explode(F.array("community", "to")).alias("c"))
    best = touched.groupBy("c").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "id")).alias("b")).select("c", F.col("b.id").alias("_best"))
    kept = moves.join(best.toDF("community", "_one"), "community").join(best.toDF("to", "_two"), "to")
    return kept.filter((F.col("_one") == F.col("id")) & (F.col("_two") == F.col("id")))


def moved(moves: DataFrame, chosen: DataFrame) -> DataFrame:
    now = chosen.select("id", F.col("to").alias("_to"))
    return moves.join(now, "id", "left").select("id", "k", "inside", "draws", F.coalesce("_to", "community").alias("community"))


def one_level(edges: DataFrame, names: DataFrame, resolution: float) -> tuple[DataFrame, float, float]:
    """((id, community), modularity before, modularity after) of one level's moves."""
    state = written(start(edges).join(draws(names, 0), "id"))
    twice = state.agg(F.sum("k")).first()[0] or 0.0
    if not twice:
        return state.select("id", "community"), 0.0, 0.0
    near = written(both_ways(edges).join(state.select("id", "k"), "id"))
    now = written(best_moves(near, state, twice, resolution))
    first = reached = modularity_of(now, twice, resolution)
    turn = 0
    while True:
        if turn and turn % DRAWS == 0:
            now = written(now.drop("draws").join(draws(names, turn), "id"))
        gains = (F.col("gain") > 0) & (F.col("to") != F.col("community"))
        drawn = F.col("draws").bitwiseAND(F.lit(1 << turn % DRAWS).cast("long")) != 0
        half = now.withColumn("community", F.when(gains & drawn, F.col("to")).otherwise(F.col("community"))).drop("to", "gain", "own")
        rise = 0.0
        for choice in (lambda now=now, half=half: half, lambda now=now, gains=gains: moved(now, apart(now.filter(gains)))):
            tried = written(best_moves(near, choice(), twice, resolution))
            value = modularity_of(tried, twice, resolution)
            if value - reached > ROUND_RISE:
                rise, reached, now = value - reached, value, tried
                break
        if not rise:
            return now.select("id", "community"), first, reached
        turn += 1


def contracted(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between communities, those inside one as a loop."""
    ends = edges.join(labels.toDF("a", "_a"), "a").join(labels.toDF("b", "_b"), "b")
    return ends.groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.sum("weight").alias("weight"))


def louvain(nodes: DataFrame, weights: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(id, community) of all nodes (id); a community is named by its smallest node.

    weights: a, b, weight of undirected edges, each pair once; loops (a = b) may be there.
    Nodes without edges stay alone. The result depends on nothing but the input.
    """
    weights = written(weights.select("a", "b", F.col("weight").cast("double").alias("weight")))
    names = numbered(weights.select("a").union(weights.select("b")))
    ends = weights.join(names.toDF("a", "_a"), "a").join(names.toDF("b", "_b"), "b")
    edges = written(ends.groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.sum("weight").alias("weight")))
    labels = None
    while True:
        own, before, after = one_level(edges, names, resolution)
        if labels is not None and after - before <= LEVEL_RISE:
            break
        labels = written(own if labels is None else labels.join(own.toDF("community", "_up"), "community").select("id", F.col("_up").alias("community")))
        if after - before <= LEVEL_RISE:
            break
        edges = written(contracted(edges, own))
    first = labels.groupBy("community").agg(F.min("id").alias("_first")).join(names.toDF("_name", "_first"), "_first")
    named = labels.join(first, "community").join(names.toDF("_id", "id"), "id").select("_id", "_name")
    return nodes.select("id").distinct().join(named, F.col("id") == F.col("_id"), "left").select("id", F.coalesce("_name", "id").alias("community"))


def relabelled(nodes: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, changed): nodes with the labels of the mapping (id, label), and of these the rows whose label is another now."""
    met = nodes.join(mapping.select(F.col("id").alias("_id"), F.col("label").alias("_label")), F.col("id") == F.col("_id"), "left")
    new = F.coalesce(F.nullif(F.col("_label"), F.lit("")), F.col("cluster"))
    marked = met.withColumn("_changed", ~new.eqNullSafe(F.col("cluster"))).withColumn("cluster", new).drop("_id", "_label")
    return marked.drop("_changed"), marked.filter("_changed").drop("_changed")

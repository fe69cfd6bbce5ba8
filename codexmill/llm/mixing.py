"""Mixing sources to target weights by Pareto order sampling.

A source's share of all words is set by its weight and capped at ``most`` times its
own words; what a cap cuts off is dealt to the others by weight. Of target / size the
whole part is certain: so many copies every document of the source gets. What is left is
drawn by documents of unequal chances. Every word of the source is as likely as any
other to draw its document, so a document's inclusion probability is p = min(1, r * size),
with the rate r such that the sum of p * size over the source is what is left; documents
with p = 1 are certain too. Every other document draws a uniform number u and ranks by
its random odds over its inclusion odds, q = (u/(1-u)) / (p/(1-p)); a source takes
documents in that order until the words asked for are there.

The ranking is never sorted as a whole. Words are summed by the leading 12 bits of
the rank, then, in the one bucket where the wanted sum is crossed, by the next 12,
and only the rows of the crossing slice are put in order. The rate comes from counts by
distinct size. So a source with a third of all rows costs no task more than its share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, take, text_hash, text_of

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: No source, and no document, is taken more often than this.
MOST = 3.0
#: Buckets of each level of the rank.
BUCKETS = 4096
#: Up to so many sources their one-row summaries are broadcast; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 20_000

WORD = r"[^\x20\x09-\x0D]+"


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 17) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, copies, taken, p, text_hash.

    * size counts the maximal runs of characters other than space and the ASCII
      controls 9 to 13; a null text has none.
    * Null sources form one source, ranked last. Sources without words have target 0.
    * copies is how often the mix takes the whole document, taken is size * copies; p is
      the inclusion probability of the copy beyond the whole ones, null without words.
    * The draw is a hash of doc_id and text: reruns agree, whatever the partitions.
      Rows repeated in full draw the same number and are told apart by position only.
    * A long document in the draw's last place can leave a gap. It is closed with the
      first documents of the rank not drawn, one for each class of sizes at most; where
      these leave more open than a longer document would exceed, that is taken too.
    * An empty table gives no rows.
    """
    bits = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), text_of(), F.lit(seed)), 11)
    rows = cut(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"), ((bits.cast("double") + 0.5) / F.lit(float(2**53))).alias("_u"), text_hash().alias("text_hash"))
        .withColumn("_tag", F.monotonically_increasing_id())
    )
    plan = targets(cut(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), weights, most)
    plan = plan.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = cut(plan.withColumn("_left", F.greatest(F.col("target") - F.col("_whole") * F.col("source_size"), F.lit(0.0))))
    small = plan.count() <= BROADCAST_SOURCES
    of = lambda df: F.broadcast(df) if small else df
    plan = cut(on_source(plan, of(rates(rows, plan, of)), how="left").withColumn("_want", F.col("_left") - F.coalesce("_certain", F.lit(0.0))))

    # sigmoid(logit u - logit p) orders as q does and lies between 0 and 1
    odds = F.col("_u") / (1 - F.col("_u")) * (1 - F.col("_p")) / F.col("_p")
    ranked = on_source(rows, of(plan)).withColumn("_p", F.when(F.col("size") > 0, F.when(F.col("size") >= F.col("_from"), 1.0).otherwise(F.least(F.lit(1.0), F.col("_rate") * F.col("size")))))
    ranked = ranked.withColumn("_sure", F.coalesce(F.col("_p") >= 1, F.lit(False))).withColumn("_v", F.when((F.col("_p") > 0) & ~F.col("_sure"), odds / (1 + odds)))
    ranked = ranked.withColumn("_b1", F.floor(F.col("_v") * BUCKETS)).withColumn("_b2", F.floor((F.col("_v") * BUCKETS - F.col("_b1")) * BUCKETS))

    first = crossing(ranked, F.lit(True), "_b1", F.col("_want"))
    ranked = on_source(ranked, of(first.select("source", F.col("_at").alias("_at1"), F.col("_before").alias("_before1"))), how="left")
    second = crossing(ranked, F.col("_b1") == F.col("_at1"), "_b2", F.col("_want") - F.col("_before1"))
    ranked = on_source(ranked, of(second.select("source", F.col("_at").alias("_at2"), F.col("_before").alias("_before2"))), how="left")

    # a document without words changes no sum, and is left out of the draw
    alive = F.col("_v").isNotNull() & (F.col("size") > 0)
    in_slice = alive & (F.col("_b1") == F.col("_at1")) & (F.col("_b2") == F.col("_at2"))
    order = Window.partitionBy("source").orderBy("_v", "doc_id", "size", "_tag").rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("_want") - F.col("_before1") - F.col("_before2")
    slice_ = ranked.filter(in_slice).withColumn("_in", F.sum("size").over(order) <= left)
    sure = alive & (F.col("_b1") < F.col("_at1")) | alive & (F.col("_b1") == F.col("_at1")) & (F.col("_b2") < F.col("_at2")) | alive & F.col("_at1").isNull()
    drawn = ranked.filter(~F.coalesce(in_slice, F.lit(False))).withColumn("_in", F.coalesce(sure, F.lit(False)) | F.col("_sure")).unionByName(slice_)
    drawn = cut(drawn.select("doc_id", "source", "size", "source_size", "target", "_whole", "_want", "_p", "_v", "_tag", "_in", "text_hash"))

    got = drawn.groupBy("source").agg(F.sum(F.when(F.col("_in") & F.col("_v").isNotNull(), F.col("size")).otherwise(0)).alias("_got"))
    rest = on_source(drawn.filter(~F.col("_in") & F.col("_v").isNotNull() & (F.col("size") > 0)), of(got)).withColumn("_gap", F.col("_want") - F.col("_got"))
    out = on_source(drawn, of(closing(rest)), how="left")
    copies = F.col("_whole") + F.when(F.col("_in") | F.coalesce(F.array_contains("_closing", F.col("_tag")), F.lit(False)), 1).otherwise(0)
    return out.withColumn("copies", copies.cast("long")).select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), F.col("_p").alias("p"), "text_hash")


def closing(rest: DataFrame) -> DataFrame:
    """Per source, the tags of further documents that fill the gap to the words wanted.

    Of each class of sizes (a factor of 1.25 wide, so some tens of classes) the first
    document in the rank can be had; from the largest down, each is added that fits.
    The smallest document over the gap comes last, if it leaves less over than its
    absence leaves open.
    """
    over = F.col("size") > F.col("_gap")
    kind = F.when(over, -1).otherwise(F.floor(F.log("size") / F.log(F.lit(1.25))))
    first = F.struct(F.when(over, F.col("size").cast("double")).otherwise(F.col("_v")).alias("_o"), "_v", "_tag", "size")
    one = rest.groupBy("source", kind.alias("_class")).agg(F.min(first).alias("_d"), F.first("_gap").alias("_gap"))
    each = one.groupBy("source").agg(F.sort_array(F.collect_list(F.struct(F.col("_d.size").alias("size"), F.col("_d._tag").alias("tag"))), asc=False).alias("_ds"), F.first("_gap").alias("_gap"))
    nothing = F.struct(F.col("_gap").alias("gap"), F.expr("cast(array() as array<bigint>)").alias("tags"))
    add = lambda acc, d: F.when(d["size"] <= acc["gap"], F.struct((acc["gap"] - d["size"]).alias("gap"), F.concat(acc["tags"], F.array(d["tag"])).alias("tags"))).otherwise(acc)
    filled = each.select("source", F.aggregate("_ds", nothing, add).alias("_f"), F.filter("_ds", lambda d: d["size"] > F.col("_gap")).alias("_over"))
    last = F.transform(F.filter("_over", lambda d: d["size"] < 2 * F.col("_f.gap")), lambda d: d["tag"])
    return filled.select("source", F.concat("_f.tags", last).alias("_closing"))


def numbered(sources: DataFrame) -> DataFrame:
    """The rows with _n, their place in code point order, null last.

    The sort deals them into ranges; each range numbers its own rows, and only the
    ranges' sizes, one row for each, are added up in one place.
    """
    ranged = cut(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_id", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_id", 33))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select(F.col("_part").alias("_p"), (before - F.col("_first")).alias("_offset")))
    return ranged.join(offsets, F.col("_part") == F.col("_p")).withColumn("_n", F.col("_id") + F.col("_offset")).drop("_id", "_part", "_p", "_offset")


def targets(sources: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """source, source_size, target: water filling over one row per source.

    All shares are level * weight but for the capped ones. The level rises from the one
    that no cap holds down: each step takes the sources that it puts over their caps as
    capped, once and for all, until none is. Sums alone come to the driver.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    caps = cut(numbered(sources).select("source", "source_size", weight.alias("_w"), (F.lit(float(most)) * F.col("source_size")).alias("_cap")))
    total = caps.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1
    while True:
        over = F.col("_cap") <= F.lit(level) * F.col("_w")
        capped, taken, free = caps.agg(F.count(F.when(over, 1)), F.sum(F.when(over, F.col("_cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("_w")))).first()
        if capped == before or not free:
            break
        level, before = (total - taken) / free, capped
    target = F.when(over, F.col("_cap")).otherwise(F.lit(level) * F.col("_w"))
    return caps.select("source", "source_size", target.alias("target"))


def rates(rows: DataFrame, plan: DataFrame, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """source, _from, _rate, _certain: documents of _from words or more are certain, others have p = _rate * size.

    Over the source's distinct sizes, from the largest down: with all larger ones
    certain, what is left over the sum of the squares of the others is the rate, and the
    right place is the first where the next size's chance is below 1.
    """
    sizes = on_source(rows.filter(F.col("size") > 0).groupBy("source", "size").agg(F.count(F.lit(1)).alias("_docs")), of(plan.select("source", "_left")))
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    up = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    words = F.col("size").cast("double") * F.col("_docs")
    larger = F.coalesce(F.sum(words).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    steps = sizes.withColumn("_certain", larger).withColumn("_rate", (F.col("_left") - larger) / F.sum(words * F.col("size")).over(up)).withColumn("_from", F.lag("size").over(down))
    fits = steps.filter(F.col("_rate") * F.col("size") < 1)
    best = fits.groupBy("source").agg(F.max_by(F.struct("_from", "_rate", "_certain"), "size").alias("_x"))
    return best.select("source", "_x._from", F.greatest("_x._rate", F.lit(0.0)).alias("_rate"), "_x._certain")


def on_source(rows: DataFrame, summary: DataFrame, how: str = "inner") -> DataFrame:
    summary = summary.withColumnRenamed("source", "_source")
    return rows.join(summary, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def crossing(ranked: DataFrame, among: Column, bucket: str, want: Column) -> DataFrame:
    """Per source, the bucket in which the running sum of words passes ``want`` and the words before it."""
    sums = ranked.filter(among & F.col("_v").isNotNull() & (F.col("size") > 0)).groupBy("source", bucket).agg(F.sum("size").alias("_words"), F.first(want).alias("_goal"))
    running = F.sum("_words").over(Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0))
    over = sums.withColumn("_before", running - F.col("_words")).filter(F.col("_before") + F.col("_words") > F.col("_goal"))
    return over.groupBy("source").agg(F.min(F.struct(F.col(bucket).alias("at"), F.col("_before").alias("before"))).alias("_x")).select("source", F.col("_x.at").alias("_at"), F.col("_x.before").alias("_before"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 17) -> DataFrame:
    """The mix itself: rows of docs, with all their columns, each as often as it is taken."""
    return take(docs, mix_sources(docs, weights, most, seed).select("doc_id", "text_hash", F.col("copies").alias("n")))

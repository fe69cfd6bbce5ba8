"""A keyword index that is kept up by differences: base, delta and tombstones.

A document that changes or goes leaves a tombstone on its old row and puts a new one into
the delta; the numbers that scores rest on (documents of each term, documents in all,
their length in all) are kept up by what is added less what is taken off, so a query
reads no more than the postings of its own terms. ``compacted`` writes base and delta as
one. A document is one row with its terms and their counts, written once; rows have
numbers, and these, not rows, are what tombstones are and what is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut, written
from .search import B, K1, LEAST_IDF, MOST_TERMS, postings, term_table

#: Tombstones that are sent to all tasks, and tables of a delta that are read side by side, at most.
MOST_GONE, MANY = 1 << 20, 8


@dataclass(frozen=True)
class Index:
    """base and delta: (id, length, terms, tf, row); gone: (row) that don't count, and how many; df: (term, df); n and total: number and length of live documents; begin: the first free number; parts: tables of the delta."""

    base: DataFrame
    delta: DataFrame
    gone: DataFrame
    df: DataFrame
    n: int
    total: int
    dead: int = 0
    begin: int = 0
    parts: int = 0


def stored(docs: DataFrame, begin: int) -> tuple[DataFrame, int]:
    """Rows of docs (id, text) under numbers from ``begin`` on, and the first number after them."""
    rows = written(postings(docs.select("id", "text")).withColumn("row", F.monotonically_increasing_id() + F.lit(begin)))
    return rows, int(rows.agg(F.coalesce(F.max("row") + 1, F.lit(begin))).first()[0])


def counted(rows: DataFrame, sign: int) -> DataFrame:
    """(term, df, length) by which rows change the counts, where the term null stands for documents themselves."""
    one = F.lit(sign).cast("long")
    return rows.select(F.col("length").cast("long").alias("length"), F.explode(F.concat("terms", F.array(F.lit(None).cast("string")))).alias("term")).select("term", one.alias("df"), F.when(F.col("term").isNull(), one * F.col("length")).otherwise(F.lit(0)).alias("length"))


def settled(changes: DataFrame) -> tuple[DataFrame, int, int]:
    """(term, df) that are left of counts, and the number of documents and their length in all."""
    sums = written(changes.groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length")).filter(F.col("df") != 0))
    row = sums.filter(F.col("term").isNull()).first()
    return sums.filter(F.col("term").isNotNull()).select("term", "df"), int(row["df"]) if row else 0, int(row["length"]) if row else 0


def built(docs: DataFrame) -> Index:
    """The index of docs (id, text), ids distinct."""
    base, begin = stored(docs, 0)
    return Index(base, base.limit(0), base.select("row").limit(0), *settled(counted(base, 1)), begin=begin)


def at(rows: DataFrame, numbers: DataFrame, n: int, how: str) -> DataFrame:
    """Rows that are (left_semi) or aren't (left_anti) among the numbers (row); up to ``MOST_GONE`` numbers go to where the rows lie."""
    own = numbers.select(F.col("row").alias("_r"))
    return rows.join(F.broadcast(own) if n <= MOST_GONE else own, F.col("row") == F.col("_r"), how)


def live(index: Index) -> DataFrame:
    rows = index.base.unionByName(index.delta) if index.parts else index.base
    return at(rows, index.gone, index.dead, "left_anti") if index.dead else rows


def changed(index: Index, docs: DataFrame, removed: DataFrame) -> Index:
    """The index after docs (id, text) are put, new or again, and removed (id) go; an id in both is put."""
    fresh, begin = stored(docs, index.begin)
    touched = fresh.select("id").unionByName(removed.select("id")).distinct().select(F.col("id").alias("_t"))
    # Ids and numbers alone are looked through for the rows of touched documents.
    hit = written(live(index).select("id", "row").join(touched, F.col("id") == F.col("_t"), "left_semi").select("row"))
    n = hit.count()
    kept = index.df.select("term", "df", F.lit(0).cast("long").alias("length"))
    whole = index.df.sparkSession.createDataFrame([(None, index.n, index.total)], "term string, df long, length long")
    counts = settled(kept.unionByName(whole).unionByName(counted(at(live(index), hit, n, "left_semi"), -1)).unionByName(counted(fresh, 1)))
    after = Index(index.base, index.delta.unionByName(fresh) if index.parts else fresh, written(index.gone.unionByName(hit)), *counts, dead=index.dead + n, begin=begin, parts=index.parts + 1)
    return replace(after, delta=written(at(after.delta, after.gone, after.dead, "left_anti")), parts=1) if after.parts > MANY else after


def compacted(index: Index) -> Index:
    """Base and delta as one base."""
    base = written(live(index))
    return replace(index, base=base, delta=base.limit(0), gone=index.gone.limit(0), dead=0, parts=0)


def search(index: Index, queries: DataFrame, k1: float = K1, b: float = B, most: int = MOST_TERMS) -> DataFrame:
    """(query_id, id, score) as ``search.bm25`` over the live documents, for words; the index has no places, hence no phrases.

    Up to ``most`` terms of queries are sent to where the documents lie, more are shuffled.
    """
    asked = term_table(queries).filter(F.size("words") == 1).drop("words")
    idf = F.greatest(F.log((F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    weights = cut(index.df.join(asked.withColumnRenamed("term", "_q"), F.col("term") == F.col("_q")).select("query_id", F.col("term").alias("_q"), (F.col("weight") * idf).alias("_w")))
    weights = F.broadcast(weights) if weights.count() <= most else weights
    tf = live(index).select("id", "length", F.explode(F.arrays_zip("terms", "tf")).alias("_p")).select("id", "length", F.col("_p.terms").alias("term"), F.col("_p.tf").alias("tf"))
    mean = index.total / index.n if index.n else 1.0
    part = F.col("_w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(mean)))
    return tf.join(weights, F.col("term") == F.col("_q")).groupBy("query_id", "id").agg(F.round(F.sum(part), 9).alias("score"))

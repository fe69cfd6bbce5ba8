"""Helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Share of the rows from which a key is hot.
HOT_SHARE = 0.001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read through Spark alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there.

    A lost executor then costs a re-read, not the lineage. The folder is the
    session's ``spark.checkpoint.dir``; only where that is unset and all of Spark runs in
    one local process is a folder of our own made, else that is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="codexmill-"))
    return df.checkpoint(eager=True)


def on_hot(rows: DataFrame, on: str, summary: DataFrame, key: str, size: str, total: int, share: float = HOT_SHARE) -> DataFrame:
    """Inner join of rows with a summary of one row for each key, hot keys settled where their rows lie.

    ``size`` is a key's number of rows and ``total`` that of all rows. Keys with at least
    ``share`` of the rows, which are 1 / share at most at any size, are broadcast; only rows
    of the other keys are shuffled, and no key among those is large.
    """
    hot = F.broadcast(summary.filter(F.col(size) >= share * total).select(*[F.col(c).alias(f"_hot_{c}") for c in summary.columns]))
    marked = rows.join(hot, F.col(on) == F.col(f"_hot_{key}"), "left")
    settled = marked.filter(F.col(f"_hot_{key}").isNotNull()).select(*rows.columns, *[F.col(f"_hot_{c}").alias(c) for c in summary.columns])
    return settled.unionByName(marked.filter(F.col(f"_hot_{key}").isNull()).select(*rows.columns).join(summary.filter(F.col(size) < share * total), F.col(on) == F.col(key)))


def text_of(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_hash() -> Column:
    """Tells the rows of one doc_id apart when decisions about rows meet the rows again."""
    return F.xxhash64(text_of())


def take(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows of docs, with its columns, as often as ``decided`` (doc_id, text_hash, n) says in sum.

    Rows that repeat both doc_id and text are one here: their decisions add up. Where
    they differ in other columns, the one with the smallest hash over all columns stays.
    """
    sums = decided.filter(F.col("n") > 0).groupBy(F.col("doc_id").alias("_cm_id"), F.col("text_hash").alias("_cm_hash")).agg(F.sum("n").cast("int").alias("_cm_n"))
    own = docs.withColumn("_cm_own", text_hash()).withColumn("_cm_row", F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns]))
    met = own.join(sums, F.col("doc_id").cast("long").eqNullSafe(F.col("_cm_id")) & (F.col("_cm_own") == F.col("_cm_hash")))
    one = Window.partitionBy("_cm_id", "_cm_own").orderBy("_cm_row")
    met = met.withColumn("_cm_rank", F.row_number().over(one)).filter(F.col("_cm_rank") == 1)
    return met.withColumn("_cm_k", F.explode(F.sequence(F.lit(1), F.col("_cm_n")))).select(*[F.col(f"`{c}`") for c in docs.columns])

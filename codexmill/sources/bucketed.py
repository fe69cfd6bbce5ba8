"""Stored tables in buckets of the key, so that a change rewrites the buckets it touches and no others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.operators.lineage import cut

BUCKET = "_bucket"


def bucket_of(key: str, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def create(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Writes a table anew; each bucket is a folder, written by one task or by several if it is large."""
    df.withColumn(BUCKET, bucket_of(key, buckets)).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def merge(spark: SparkSession, path: str, key: str, buckets: int, changed: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """Merges rows into a table: ``merged`` (old, changed) sees the old rows of the touched buckets alone. The touched buckets.

    Only their folders are read (partition pruning) and written (dynamic overwrite); a
    bucket that ends empty is taken away. The result is written out before any old file
    goes, so a run that fails before can be made again, and one that fails while it
    replaces folders ends the same when it is, if ``merged`` is an upsert: there is one
    writer at a time.
    """
    rows = cut(changed.withColumn(BUCKET, bucket_of(key, buckets)))
    touched = sorted(r[0] for r in rows.select(BUCKET).distinct().collect())  # at most ``buckets``
    if not touched:
        return []
    old = spark.read.parquet(path).filter(F.col(BUCKET).isin(touched)).drop(BUCKET)
    new = cut(merged(old, rows.drop(BUCKET)).withColumn(BUCKET, bucket_of(key, buckets)))
    left = {r[0] for r in new.select(BUCKET).distinct().collect()}
    new.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    for bucket in set(touched) - left:
        remove(spark, f"{path}/{BUCKET}={bucket}")
    return touched


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it lies."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

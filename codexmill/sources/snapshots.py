"""Snapshots: several tables written as one version that readers see all at once or not at all.

A version's tables are plain Parquet folders; a row in the table of commits, written
last, makes the version current. All of it goes through Spark, so any store will do.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def current_version(spark: SparkSession, root: str) -> int | None:
    try:
        commits = spark.read.schema("version long").parquet(f"{root}/commits")
        return commits.agg(F.max("version")).first()[0]
    except AnalysisException:
        return None


def write(tables: dict[str, DataFrame], root: str, partitions: dict[str, str] | None = None) -> int:
    """Writes the tables as the next version and commits it."""
    spark = next(iter(tables.values())).sparkSession
    version = (current_version(spark, root) or 0) + 1
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if partitions and name in partitions:
            writer = writer.partitionBy(partitions[name])
        writer.parquet(f"{root}/version={version}/{name}")
    spark.range(1).select(F.lit(version).cast("long").alias("version")).coalesce(1).write.mode("append").parquet(f"{root}/commits")
    return version


def read(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    version = current_version(spark, root) if version is None else version
    if version is None:
        raise FileNotFoundError(f"no committed version in {root}")
    return spark.read.parquet(f"{root}/version={version}/{name}")


def stale_steps(meta: DataFrame, wanted: dict[str, str]) -> list[str]:
    """Keys whose stored value differs from the one wanted: the steps that must be rebuilt."""
    have = {r["key"]: r["value"] for r in meta.filter(F.col("key").isin(*wanted)).collect()}  # a handful of keys
    return [k for k, v in wanted.items() if have.get(k) != v]


def check_dimension(vectors: DataFrame, dim: int) -> None:
    wrong = vectors.filter(F.size("embedding") != dim).limit(1).count()
    if wrong:
        raise ValueError(f"vectors must have {dim} components")


def save_described(files: DataFrame, root: str) -> None:
    """Described markdown (path, content), as Parquet by source path; equal input gives equal output."""
    files.select(F.regexp_replace("path", r"\.md$", ".described.md").alias("path"), "content").write.mode("overwrite").parquet(root)


def cached(results: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of requests (hash, ...) in a cache of results by content hash."""
    return requests.join(results, "hash"), requests.join(results.select("hash"), "hash", "left_anti")

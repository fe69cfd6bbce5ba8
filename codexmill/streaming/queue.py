"""The write queue and its counters as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KINDS = ("update_node", "delete_node", "create_exogenous", "create_document", "recluster", "cascading_update", "ingest", "localise_clusters")


def run_queue(source: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]], out: str, checkpoint: str) -> StreamingQuery:
    """Applies each micro-batch of jobs (id, type, payload, seq) by type, in one writer, and records the outcomes.

    Outcomes (id, type, status, error, batch) go to a folder of the batch's number that
    is written over, so a batch that is replayed leaves the same result.
    """
    def apply(batch: DataFrame, number: int) -> None:
        done = None
        batch = batch.persist()
        for kind, handler in handlers.items():
            part = handler(batch.filter(F.col("type") == kind)).select("id", "type", "status", "error")
            done = part if done is None else done.unionByName(part)
        unknown = batch.filter(~F.col("type").isin(*handlers)).select("id", "type", F.lit("failed").alias("status"), F.lit("unknown job type").alias("error"))
        (unknown if done is None else done.unionByName(unknown)).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.unpersist()

    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outcomes(spark: SparkSession, out: str) -> DataFrame | None:
    try:
        return spark.read.parquet(out)
    except AnalysisException:
        return None


def counters(source: DataFrame, every: int = 10) -> DataFrame:
    """(key, fires, since) per key of a stream: a counter that fires at ``every`` additions and begins anew."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fires, since = state.get if state.exists else (0, 0)
        n = since + sum(len(b) for b in batches)
        fires, since = fires + n // every, n % every
        state.update((fires, since))
        yield pd.DataFrame({"key": [key[0]], "fires": [fires], "since": [since]})

    return source.groupBy("key").applyInPandasWithState(step, "key long, fires long, since long", "fires long, since long", "update", GroupStateTimeout.NoTimeout)


def windows(source: DataFrame, time: str, length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) per tumbling window; beyond the reference, for event streams."""
    own = source.withWatermark(time, late)
    return own.groupBy(F.window(time, length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")

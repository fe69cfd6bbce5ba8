"""The write-job log as a table: states, queue positions, pruning, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEPT, LAST = 500, ("done", "failed", "cancelled")
QUEUE = 100


def current(log: DataFrame) -> DataFrame:
    """(job_id, status, seq): the latest entry of each job."""
    return log.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def queue_positions(jobs: DataFrame) -> DataFrame:
    """(job_id, position) of queued jobs by creation, from 1. The queue is bounded (QUEUE), so one window over it is small."""
    queued = jobs.filter(F.col("status") == "queued")
    return queued.select("job_id", F.row_number().over(Window.partitionBy("status").orderBy("created", "job_id")).alias("position"))


def listed(jobs: DataFrame, status: str | None = None, limit: int = 100) -> DataFrame:
    own = jobs.filter(F.col("status") == status) if status else jobs
    return own.orderBy(F.col("created").desc(), F.col("job_id").desc()).limit(limit)


def pruned(jobs: DataFrame, kept: int = KEPT) -> DataFrame:
    """All unfinished jobs and the ``kept`` newest finished ones, found by a top-k and not by a sort of all."""
    done = jobs.filter(F.col("status").isin(*LAST))
    return jobs.filter(~F.col("status").isin(*LAST)).unionByName(done.orderBy(F.col("created").desc(), F.col("job_id").desc()).limit(kept))


def cancellable(jobs: DataFrame) -> DataFrame:
    return jobs.select("job_id", (F.col("status") == "queued").alias("can_cancel"))


def fired(counts: DataFrame, every: int = 10) -> DataFrame:
    """(key, fires, since): how often a counter of ``every`` has fired after n additions, and where it stands."""
    return counts.select("key", F.floor(F.col("n") / every).cast("long").alias("fires"), (F.col("n") % every).cast("long").alias("since"))


def task_states(messages: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, state): the last message, unless output is there (completed), the worker lives (processing) or not (failed)."""
    last = messages.groupBy("task_id").agg(F.max_by("state", "seq").alias("said"))
    return tasks.join(last, "task_id", "left").select("task_id", F.coalesce("said", F.when(F.col("has_output"), "completed").when(F.col("alive"), "processing").otherwise("failed")).alias("state"))


def best_attempt(attempts: DataFrame, stop: float = 95.0) -> DataFrame:
    """(task_id, attempt, score): the best score, the first of equals, of the attempts up to the first that reaches ``stop``."""
    w = Window.partitionBy("task_id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    made = attempts.withColumn("_before", F.coalesce(F.max("score").over(w), F.lit(-1.0))).filter(F.col("_before") < stop)
    best = Window.partitionBy("task_id").orderBy(F.col("score").desc(), "attempt")
    return made.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") == 1).select("task_id", "attempt", "score")

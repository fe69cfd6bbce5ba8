"""Bounded job queues, spaced enrichment and sessions, with state that Spark keeps and recovers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CAPACITY, FULL = 100, "write queue is full"
#: Seconds between two jobs of enrichment.
SPACING = 3.0
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class BoundedQueue(StatefulProcessor):
    """Commands of one queue, in order, to states of its jobs.

    enqueue: queued, or failed if as many as ``capacity`` wait; take: the first that waits
    is running, but for cancelled ones, which leave with no further state; finish and fail:
    what runs is done or failed; cancel: only while queued. A cancelled job keeps its
    place until it is taken. Each row tells how many wait afterwards.
    """

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "job_id string, cancelled boolean")
        self.running = handle.getValueState("running", "job_id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting = [[job, bool(gone)] for job, gone in self.waiting.get()]
        running = self.running.get()[0] if self.running.exists() else None
        out: list[tuple] = []
        commands = pd.concat(list(rows)).sort_values("seq")
        for seq, job, command in zip(commands["seq"], commands["job_id"], commands["command"], strict=True):
            told: tuple[str, str, str | None] | None = None
            if command == "enqueue":
                told = (job, "failed", FULL) if len(waiting) >= self.capacity else (job, "queued", None)
                if told[1] == "queued":
                    waiting.append([job, False])
            elif command == "take" and running is None:
                while waiting and running is None:
                    first, gone = waiting.pop(0)
                    running = None if gone else first
                told = (running, "running", None) if running else None
            elif command in ("finish", "fail") and running is not None:
                told, running = (running, "done" if command == "finish" else "failed", None), None
            elif command == "cancel":
                held = next((w for w in waiting if w[0] == job and not w[1]), None)
                if held:
                    held[1], told = True, (job, "cancelled", None)
            if told:
                out.append((str(key[0]), int(seq), *told, len(waiting)))
        self.waiting.put([tuple(w) for w in waiting]) if waiting else self.waiting.clear()
        self.running.update((running,)) if running else self.running.clear()
        yield pd.DataFrame(out, columns=["queue", "seq", "job_id", "status", "error", "depth"])

    def close(self) -> None:
        pass


def queue_states(commands: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(queue, seq, job_id, status, error, depth) from a stream of commands (queue, seq, job_id, command).

    Needs the RocksDB state store (``STORE``). Commands of a queue must come in order of
    seq from batch to batch.
    """
    return commands.groupBy("queue").transformWithStateInPandas(BoundedQueue(capacity), "queue string, seq long, job_id string, status string, error string, depth int", "Append", "None")


class Spaced(StatefulProcessor):
    """Jobs of one worker, done one by one with some time between; what fails is told and stops no other."""

    def __init__(self, handler: Callable[[str, str], str | None], spacing: float = SPACING):
        self.handler, self.spacing = handler, spacing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getListState("jobs", "job_id string, payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        idle = not self.jobs.exists()
        new = pd.concat(list(rows)).sort_values("seq")
        self.jobs.appendList([(str(j), str(p)) for j, p in zip(new["job_id"], new["payload"], strict=True)])
        if idle:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1)
        yield pd.DataFrame({"job_id": pd.Series(dtype=str), "status": pd.Series(dtype=str), "error": pd.Series(dtype=str), "at": pd.Series(dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = list(self.jobs.get())
        now = timerValues.getCurrentProcessingTimeInMs()
        (job, payload), rest = waiting[0], waiting[1:]
        status, error = "done", None
        try:
            self.handler(job, payload)
        except Exception as problem:  # one bad job must not stop the others
            status, error = "failed", f"{type(problem).__name__}: {problem}"
        if rest:
            self.jobs.put(rest)
            self.handle.registerTimer(now + int(1000 * self.spacing))
        else:
            self.jobs.clear()
        yield pd.DataFrame([(job, status, error, now)], columns=["job_id", "status", "error", "at"])

    def close(self) -> None:
        pass


def enriched(jobs: DataFrame, handler: Callable[[str, str], str | None], spacing: float = SPACING) -> DataFrame:
    """(job_id, status, error, at) from a stream of jobs (worker, seq, job_id, payload), with at least ``spacing`` seconds between two of a worker.

    ``handler`` (job_id, payload) runs in the worker's task; at is the time of the run in
    milliseconds. Rows with status failed make the table of failures.
    """
    return jobs.groupBy("worker").transformWithStateInPandas(Spaced(handler, spacing), "job_id string, status string, error string, at long", "Append", "ProcessingTime")


def sessions(events: DataFrame, key: str, time: str, gap: str, late: str = "1 day") -> DataFrame:
    """(key, start, end, n): events of a key with no gap as long as ``gap`` between them; end is the last event's time plus the gap.

    Works on a table and, with a watermark for what comes late, on a stream.
    """
    own = events.withWatermark(time, late) if events.isStreaming else events
    grouped = own.groupBy(F.col(key), F.session_window(time, gap).alias("_w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(key, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")

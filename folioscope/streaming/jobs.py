"""Crawl jobs: their states, limits and expiry, in batch and kept by a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.text import elapsed

#: Seconds that a crawl may take, that a finished job is kept, and that a poll waits.
TIME_LIMIT, KEPT, DEADLINE = 120, 3600, 300
STATE = "status string, started timestamp, updated timestamp, events long"
CHANGES = "job_id long, status string, updated timestamp, events long"
OPEN = "processing"


def latest(events: DataFrame) -> DataFrame:
    """(job_id, status, ts, n) from events(job_id, status, ts, event_id): the last event by time decides."""
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n"))


def upserted(table: DataFrame, changes: DataFrame) -> DataFrame:
    """The job table after changes of the same columns(job_id, ts, ...): of each job the row of the latest time."""
    every = table.unionByName(changes)
    rest = [c for c in table.columns if c != "job_id"]
    return every.groupBy("job_id").agg(F.max_by(F.struct(*rest), "ts").alias("r")).select("job_id", "r.*").select(*table.columns)


def _seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


def _now(jobs: DataFrame) -> DataFrame:
    return jobs.crossJoin(F.broadcast(jobs.agg(F.max("ts").alias("now"))))  # one row


def unexpired(jobs: DataFrame, ttl_seconds: int = KEPT, open_status: str = OPEN) -> DataFrame:
    """Jobs still open or finished no longer ago than the limit, seen from the last time in the table."""
    return _now(jobs).where((F.col("status") == open_status) | (_seconds(F.col("now"), F.col("ts")) <= ttl_seconds)).drop("now")


def timed_out(jobs: DataFrame, limit: int = TIME_LIMIT, open_status: str = OPEN) -> DataFrame:
    """jobs(job_id, status, ts, ...) with error: open ones older than the limit become timeout, seen from the last time in the table."""
    late = (F.col("status") == open_status) & (_seconds(F.col("now"), F.col("ts")) > limit)
    error = F.when(late, F.lit(f"Crawl exceeded maximum time of {limit} seconds"))
    return _now(jobs).withColumns({"error": error, "status": F.when(late, "timeout").otherwise(F.col("status"))}).drop("now")


def polled(jobs: DataFrame, job_ids: list[int], open_status: str = OPEN) -> DataFrame:
    """Of the asked jobs(job_id, status, ts, elapsed_seconds): the state, with seconds so far, in tenths, while a job is open. Unknown ids have no row."""
    live = elapsed(_seconds(F.col("now"), F.col("ts")), F.lit(True))
    return _now(jobs).where(F.col("job_id").isin(job_ids)).select("job_id", "status", F.coalesce("elapsed_seconds", F.when(F.col("status") == open_status, live)).alias("elapsed_seconds"))


def batch_outcome(submitted: DataFrame, finished: DataFrame, deadline: int = DEADLINE) -> DataFrame:
    """submitted(job_id, url, ts) with the status of finished(job_id, status, ts); those without one by the deadline are timeout."""
    f = finished.select(F.col("job_id").alias("_id"), F.col("status").alias("_status"), F.col("ts").alias("_ts"))
    known = F.col("_id").isNotNull() & (_seconds(F.col("_ts"), F.col("ts")) <= deadline)
    out = submitted.join(f, F.col("job_id") == F.col("_id"), "left")
    return out.select("job_id", "url", F.when(known, F.col("_status")).otherwise("timeout").alias("status"), F.when(~F.coalesce(known, F.lit(False)), "Polling timed out").alias("error"))


# ---- kept by a stream ------------------------------------------------------------------------------------------------


def _update(limit: int, kept: int):
    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        """An event sets a job's state; the timer ends an open job, then forgets a finished one."""
        if state.hasTimedOut:
            status, started, updated, n = state.get
            due = pd.Timestamp(updated) + pd.Timedelta(seconds=limit if status == OPEN else kept)
            if status == OPEN:
                state.update(("timeout", started, due.to_pydatetime(), n))
                state.setTimeoutTimestamp(int((due + pd.Timedelta(seconds=kept)).timestamp() * 1000))
                yield pd.DataFrame({"job_id": [key[0]], "status": ["timeout"], "updated": [due], "events": [n]})
            else:
                state.remove()
                yield pd.DataFrame({"job_id": [key[0]], "status": ["expired"], "updated": [due], "events": [n]})
            return
        status, started, updated, n = state.get if state.exists else (None, None, None, 0)
        for pdf in batches:
            pdf = pdf.sort_values(["ts", "event_id"])
            last = pdf.iloc[-1]
            started = started or pdf.iloc[0].ts.to_pydatetime()
            if updated is None or last.ts >= pd.Timestamp(updated):
                status, updated = last.status, last.ts.to_pydatetime()
            n += len(pdf)
        state.update((status, started, updated, n))
        due = pd.Timestamp(updated) + pd.Timedelta(seconds=limit if status == OPEN else kept)
        state.setTimeoutTimestamp(max(int(due.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "updated": [pd.Timestamp(updated)], "events": [n]})

    return step


def job_stream(events: DataFrame, limit: int = TIME_LIMIT, kept: int = KEPT, delay: str = "1 minute") -> DataFrame:
    """A streaming events(job_id, status, ts, event_id) to each change of a job's state.

    Event time drives the timers: an open job is timeout `limit` seconds after its last event, and a finished one is
    expired and its state dropped after `kept`, once the watermark has passed. State thus follows the jobs of the last hours, not all."""
    return (
        events.withWatermark("ts", delay).groupBy("job_id")
        .applyInPandasWithState(_update(limit, kept), CHANGES, STATE, "update", "EventTimeTimeout")
    )


class Progress(StreamingQueryListener):
    """Messages of running queries, as a list of (kind, rows)."""

    def __init__(self):
        self.messages: list[tuple[str, int]] = []

    def onQueryStarted(self, event):
        self.messages.append(("running", 0))

    def onQueryProgress(self, event):
        self.messages.append(("result", event.progress.numInputRows))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.messages.append(("failed" if event.exception else "done", 0))


def run_until(query: StreamingQuery, deadline: float = DEADLINE) -> bool:
    """Waits for a query until the deadline, in seconds, then cancels it. Whether it ended by itself."""
    ended = query.awaitTermination(deadline)
    if not ended:
        query.stop()
    return bool(ended)

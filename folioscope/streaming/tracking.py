"""Crawl jobs kept by a stateful processor with event-time timers, joined while both sides stream, and replayed from tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..sources import shared
from .jobs import DEADLINE, KEPT, OPEN, TIME_LIMIT
from .upserts import Upserts

STATES = "job_id long, status string, updated timestamp, events long, timeouts long, changes long"
TOLD = "job string, status string, updated long, events long, timeouts long, changes long"
COLUMNS = ["job", "status", "updated", "events", "timeouts", "changes"]
#: Fixed, as state is kept by them.
BUCKETS = 1024
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class JobTracker(StatefulProcessor):
    """An event sets its job's state; a timer ends an open job after `limit` seconds, and forgets a finished one after `kept`.

    Timers fire when the watermark passes them, which depends on how events are cut into batches. So an event first settles what fell
    due before it, and the states follow from the events' times alone.

    Each key costs calls from Python to the JVM and an Arrow batch of its own, however few its events. So a key is a bucket of jobs, by hash: its state is the list of
    those kept, its one timer the first time at which one of them falls due. A bucket's events of one batch are held together, to be put in order.
    Without `every`, a batch tells the last of a job's changes only."""

    def __init__(self, limit: int, kept: int, every: bool = True):
        self.limit, self.kept, self.every = limit, kept, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getListState("jobs", TOLD)

    def _due(self, status: str, updated: int) -> int:
        """Milliseconds; times of events are microseconds."""
        return updated // 1000 + 1000 * (self.limit if status == OPEN else self.kept)

    def _first(self, states: dict[str, tuple]) -> int | None:
        return min((self._due(s[0], s[1]) for s in states.values()), default=None)

    def _settled(self, state: tuple | None, now: int) -> tuple[tuple | None, list[tuple]]:
        """The state as timers up to `now` leave it, and what they did."""
        told = []
        while state is not None and self._due(state[0], state[1]) <= now:
            status, updated, events, timeouts, changes = state
            at, open_ = self._due(status, updated) * 1000, status == OPEN
            state = ("timeout", at, events, timeouts + 1, changes + 1) if open_ else None
            told.append(state or ("expired", at, events, timeouts, changes + 1))
        return state, told

    def _read(self) -> dict[str, tuple]:
        return {job: tuple(state) for job, *state in self.jobs.get()}

    def _keep(self, states: dict[str, tuple], timer: int | None) -> None:
        """Keeps states, and their timer in place of `timer`."""
        if states:
            self.jobs.put([(job, *state) for job, state in states.items()])
        else:
            self.jobs.clear()
        first = self._first(states)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)

    def _fallen(self, states: dict[str, tuple], now: int) -> tuple[dict[str, tuple], list[tuple]]:
        """States as timers up to `now` leave them, and what these did; a timer can't be set for a time that has passed."""
        left, told = {}, []
        for job, state in states.items():
            state, fell = self._settled(state, now)
            told += [(job, *f) for f in fell]
            if state is not None:
                left[job] = state
        return left, told

    def _frames(self, told: list[tuple]) -> Iterator[pd.DataFrame]:
        if told:
            yield pd.DataFrame(told if self.every else list({t[0]: t for t in told}.values()), columns=COLUMNS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        states, told = self._read(), []
        timer = self._first(states)
        events = pd.concat(list(rows)).sort_values(["us", "event_id", "status"])
        for job, status, us in zip(events["job"].tolist(), events["status"].tolist(), events["us"].tolist()):
            state, fell = self._settled(states.get(job), us // 1000)
            _, _, n, timeouts, changes = state or (None, None, 0, 0, 0)
            states[job] = state = (status, us, n + 1, timeouts, changes + 1)
            told += [(job, *f) for f in (*fell, state)]
        states, fell = self._fallen(states, timerValues.getCurrentWatermarkInMs())
        self._keep(states, timer)
        yield from self._frames(told + fell)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        states, told = self._fallen(self._read(), timerValues.getCurrentWatermarkInMs())
        self._keep(states, None)  # Spark deletes the timer that fired
        yield from self._frames(told)

    def close(self) -> None:
        pass


def tracked(events: DataFrame, limit: int = TIME_LIMIT, kept: int = KEPT, delay: str = "1 minute", every: bool = True) -> DataFrame:
    """A streaming events(job_id, status, ts, event_id) to each change of a job's state, timers' included: STATES; without `every` to the last of a job's changes in each batch.

    Events without a time are left out; a null status is empty. Needs RocksDB's state store (see ROCKS): state is kept on disk, checkpointed by change, and holds the jobs of the last hours only. State that
    expires by the clock, which Spark offers for live services, can't be had beside timers of event time, so a timer forgets old jobs here."""
    job = F.coalesce(F.col("job_id").cast("string"), F.lit("")).alias("job")  # pandas would make floats of ids beside a null
    bucket = F.pmod(F.xxhash64("job_id"), F.lit(BUCKETS)).alias("bucket")
    rows = events.where("ts is not null").select(bucket, job, F.coalesce("status", F.lit("")).alias("status"), "ts", F.coalesce("event_id", F.lit(-1)).alias("event_id"), F.unix_micros("ts").alias("us")).withWatermark("ts", delay)
    out = rows.groupBy("bucket").transformWithStateInPandas(JobTracker(limit, kept, every), StructType.fromDDL(TOLD), "Update", "EventTime")
    return out.select(F.nullif(F.col("job"), F.lit("")).cast("long").alias("job_id"), "status", F.timestamp_micros("updated").alias("updated"), "events", "timeouts", "changes")


def outcomes(submitted: DataFrame, finished: DataFrame, deadline: int = DEADLINE, delay: str = "1 minute") -> DataFrame:
    """Streaming submitted(job_id, url, ts) with the status of streaming finished(job_id, status, ts) that comes within the deadline, in seconds.

    A left outer join of two streams: each side is kept until the watermark says that no partner can come any more; jobs without one then come
    out as timeout. An answer at the deadline itself still counts."""
    s = submitted.withWatermark("ts", delay)
    f = finished.select(F.col("job_id").alias("_id"), F.col("status").alias("_status"), F.col("ts").alias("_ts")).withWatermark("_ts", delay)
    within = (F.col("job_id") == F.col("_id")) & (F.col("_ts") >= F.col("ts")) & (F.col("_ts") <= F.col("ts") + F.expr(f"INTERVAL {deadline} SECONDS"))
    late = F.when(F.col("_id").isNull(), "Polling timed out")
    return s.join(f, within, "left_outer").select("job_id", "url", "ts", F.coalesce("_status", F.lit("timeout")).alias("status"), late.alias("error"))


def replay(spark: SparkSession, tables: dict[str, DataFrame], cuts: list, path: str, start: Callable[[dict[str, DataFrame]], StreamingQuery]) -> None:
    """Feeds tables(ts, ...) to a stream in as many parts as the cuts in time make, one after another. `start` starts the query over streaming tables of the
    same names, with one checkpoint; it ends with each part's data and goes on from its checkpoint at the next."""
    stream = spark.newSession()
    for key, value in ROCKS.items():
        stream.conf.set(key, value)
    stream.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:]):
        for name, rows in tables.items():
            part = rows if low is None else rows.where(F.col("ts") >= F.lit(low))
            (part if high is None else part.where(F.col("ts") < F.lit(high))).write.mode("append").parquet(f"{path}/{name}")
        query = start({name: stream.readStream.schema(rows.schema).parquet(f"{path}/{name}") for name, rows in tables.items()})
        query.awaitTermination()


def _cuts(rows: DataFrame, parts: int) -> list:
    """Times that cut the rows' range evenly."""
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    return [] if low is None else [low + (high - low) * i / parts for i in range(1, parts)]


def replayed_jobs(events: DataFrame, parts: int = 3) -> DataFrame:
    """Final states of jobs after events(job_id, status, ts, event_id) went through the stream in parts, kept by an upsert table."""
    spark = events.sparkSession
    path = shared.folder(spark, "jobs")
    table = Upserts(spark, f"{path}/table", STATES, ["job_id"], ["updated", "changes"])

    def start(streams):
        into = Upserts(streams["events"].sparkSession, table.path, STATES, ["job_id"], ["updated", "changes"])
        return tracked(streams["events"], every=False).writeStream.foreachBatch(into.write).outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()

    replay(spark, {"events": events}, _cuts(events, parts), path, start)
    table.compact()
    return table.read()


def replayed_outcomes(submitted: DataFrame, finished: DataFrame, parts: int = 2, deadline: int = DEADLINE) -> DataFrame:
    """Outcomes of all submitted jobs after both tables went through the join in parts. A last row far beyond them on both sides moves the
    watermark, as later jobs would; it isn't returned."""
    spark = submitted.sparkSession
    path = shared.folder(spark, "outcomes")
    last = submitted.agg(F.max("ts")).first()[0]
    beyond = (F.lit(last).cast("timestamp") + F.expr(f"INTERVAL {10 * deadline} SECONDS")).alias("ts")
    # Ids that differ, and no nulls: a filter would be pushed below the watermark, which then stands still.
    end = lambda job, text: spark.range(1).select(F.lit(job).cast("long").alias("job_id"), F.lit("").alias(text), beyond)
    tables = {"submitted": submitted.unionByName(end(-1, "url")), "finished": finished.unionByName(end(-2, "status"))}
    schema = "job_id long, url string, ts timestamp, status string, error string"

    def start(streams):
        return outcomes(streams["submitted"], streams["finished"], deadline).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()

    replay(spark, tables, _cuts(submitted, parts), path, start)
    return spark.read.schema(schema).parquet(f"{path}/out").where(F.col("ts") <= F.lit(last)).select("job_id", "url", "status", "error")

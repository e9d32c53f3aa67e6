"""The stateful processor, the join of two streams and the upsert table: restarts, repeats and limits."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from folioscope.sources import shared
from folioscope.streaming import tracking
from folioscope.streaming.upserts import Upserts

START = dt.datetime(2024, 1, 1)
EVENTS = "job_id long, status string, ts timestamp, event_id long"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def test_upserts(spark, tmp_path):
    """A batch written twice counts once, also after compaction; a folder half written doesn't count; equal orders go to the later batch."""
    table = Upserts(spark, str(tmp_path), "id long, v string, n long", ["id"], ["n"])
    rows = lambda *r: spark.createDataFrame(list(r), "id long, v string, n long, more int".replace(", more int", ""))
    state = lambda: sorted(tuple(r) for r in table.read().collect())
    assert state() == [] and table.version() == -1 and table.compact() == -1
    table.write(rows((1, "a", 1), (1, "b", 2), (2, "a", 5)), 0)
    table.write(rows((1, "c", 2), (3, None, 1)), 1)
    want = [(1, "c", 2), (2, "a", 5), (3, None, 1)]
    assert state() == want
    table.write(rows((1, "c", 2), (3, None, 1)), 1)
    assert state() == want and table.compact() == 1 and state() == want
    table.write(rows((2, "lost", 9)), 1)  # a batch that the base has
    table.vacuum()
    assert state() == want and shared.names(spark, str(tmp_path)) == ["base-1"]
    table.write(rows((2, "z", 4), (4, "new", 0)), 2)
    (tmp_path / "delta-3").mkdir()
    rows((9, "half", 1)).write.mode("overwrite").parquet(str(tmp_path / "delta-3"))
    (tmp_path / "delta-3" / "_SUCCESS").unlink()
    assert state() == [*want, (4, "new", 0)] and table.version() == 2


def test_job_states_do_not_depend_on_batches(spark):
    """Open jobs end at the limit, finished ones are forgotten, late answers count anew; however events are cut into runs."""
    rows = [(1, "processing", at(0), 1), (1, "completed", at(119), 2), (2, "processing", at(5), 3), (2, "completed", at(125), 4), (3, "processing", at(7), 5), (4, "completed", at(9), 6), (4, "processing", at(9 + 3600), 7), (5, "processing", at(11), 8), (5, "processing", at(100), 9),
            (6, "processing", at(20), 10), (6, "completed", at(20), 11), (None, "processing", at(30), 12), (7, None, at(3000), None), (8, "processing", None, 13), (9, "completed", at(7700), 14)]
    events = spark.createDataFrame(rows, EVENTS)
    found = [sorted((tuple(r) for r in tracking.replayed_jobs(events, parts).select("job_id", "status", "updated", "events", "timeouts").collect()), key=repr) for parts in (1, 4)]
    want = [(1, "expired", at(3719), 2, 0), (2, "expired", at(3725), 2, 1), (3, "expired", at(3727), 1, 1), (4, "expired", at(7329), 1, 1), (5, "expired", at(3820), 2, 1), (6, "expired", at(3620), 2, 0), (None, "expired", at(3750), 1, 1), (7, "expired", at(6600), 1, 0), (9, "completed", at(7700), 1, 0)]
    assert found[0] == found[1] == sorted(want, key=repr)


def test_an_event_at_the_time_of_expiry(spark):
    """It begins the job anew, and is what the table keeps, not the expiry of the same time; so too at the limit of an open job."""
    rows = [(1, "completed", at(0), 1), (1, "processing", at(3600), 2), (2, "completed", at(0), 3), (2, "completed", at(3600), 4), (3, "processing", at(3480), 5), (3, "completed", at(3600), 6)]
    for parts in (1, 3):
        got = sorted(tuple(r) for r in tracking.replayed_jobs(spark.createDataFrame(rows, EVENTS), parts).select("job_id", "status", "updated", "events", "timeouts").collect())
        assert got == [(1, "processing", at(3600), 1, 0), (2, "completed", at(3600), 1, 0), (3, "completed", at(3600), 2, 1)]


class Calls:
    """A handle, its one list state and its watermark, that count what is asked of them: each is a way to the JVM and back."""

    def __init__(self):
        self.kept, self.timers, self.n, self.now = [], set(), 0, 0

    def getListState(self, name, schema):
        return self

    def get(self):
        self.n += 1
        return iter(self.kept)

    def put(self, rows):
        self.n, self.kept = self.n + 1, rows

    def clear(self):
        self.put([])

    def registerTimer(self, at):
        self.n += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.n += 1
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return self.now


def test_calls_do_not_grow_with_jobs_and_events():
    """Of many jobs of many events in one batch: a few calls in all, one timer and a row for each job; every change where that is asked for."""
    jobs, events = 300, 40
    rows = lambda start: iter([pd.DataFrame([(str(j), "completed", e, (start + 60 * e) * 1_000_000 + j) for e in range(events) for j in range(jobs)], columns=["job", "status", "event_id", "us"])])
    for every in (False, True):
        calls = Calls()
        tracker = tracking.JobTracker(120, 3600, every)
        tracker.init(calls)
        told = list(tracker.handleInputRows((0,), rows(0), calls))
        assert sum(map(len, told)) == jobs * (events if every else 1) and calls.n == 3
        assert calls.timers == {(60 * (events - 1) + 3600) * 1000}
        told = pd.concat(tracker.handleInputRows((0,), rows(4000), calls))  # all within an hour of the last ones
        assert told.groupby("job").last().events.tolist() == [2 * events] * jobs and calls.n == 7 and len(calls.timers) == 1
        calls.now = 10_000_000
        told = list(tracker.handleExpiredTimer((0,), calls, None))
        assert sum(map(len, told)) == jobs and set(told[0].status) == {"expired"} and calls.n == 9 and not calls.kept


def test_outcomes(spark):
    """An answer at the deadline counts, one after it doesn't, nor one before the job; unfinished jobs are timeouts; the next run goes on with open ones."""
    submitted = spark.createDataFrame([(i, f"u{i}", at(t)) for i, t in enumerate([0, 0, 0, 0, 900, 1000])], "job_id long, url string, ts timestamp")
    finished = spark.createDataFrame([(0, "completed", at(300)), (1, "completed", at(301)), (2, "failed", at(0)), (3, "completed", at(-1)), (4, "completed", at(1000))], "job_id long, status string, ts timestamp")
    got = {r.job_id: (r.status, r.error) for r in tracking.replayed_outcomes(submitted, finished, 3).collect()}
    late = ("timeout", "Polling timed out")
    assert got == {0: ("completed", None), 1: late, 2: ("failed", None), 3: late, 4: ("completed", None), 5: late}
    assert tracking.replayed_outcomes(submitted.where("false"), finished).where(F.lit(True)).collect() == []

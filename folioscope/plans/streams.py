"""Queries that feed tables through streams, to the states that SQL computes at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import jobs, tracking
from .register import query, read


@query("""WITH e AS (SELECT user_id AS job_id, event_id, epoch_us(ts) AS us, epoch_us(ts) // 1000 AS ms, CASE event_type WHEN 'view' THEN 'processing' ELSE 'completed' END AS status FROM events),
w AS (SELECT max(ms) - 60000 AS w FROM e),
h AS (SELECT e.*, coalesce(lead(ms) OVER (PARTITION BY job_id ORDER BY us, event_id), w) AS until, lead(ms) OVER (PARTITION BY job_id ORDER BY us, event_id) IS NULL AS last FROM e, w),
d AS (SELECT *, status = 'processing' AND ms + 120000 <= until AS late, CASE status WHEN 'processing' THEN ms + 3720000 ELSE ms + 3600000 END <= until AS gone FROM h),
s AS (SELECT *, coalesce(sum(gone::INT) OVER (PARTITION BY job_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM d),
c AS (SELECT *, count(*) OVER (PARTITION BY job_id, life) AS events, sum(late::INT) OVER (PARTITION BY job_id, life) AS timeouts FROM s)
SELECT job_id, CASE WHEN gone THEN 'expired' WHEN late THEN 'timeout' ELSE status END AS status, make_timestamp(CASE WHEN gone AND status = 'processing' THEN (ms + 3720000) * 1000 WHEN gone THEN (ms + 3600000) * 1000 WHEN late THEN (ms + 120000) * 1000 ELSE us END) AS updated,
events, timeouts::BIGINT AS timeouts FROM c WHERE last""")
def t1_t2_k5_job_stream(spark, sf_dir):
    """Jobs' final states after all events went through the stream in three runs, each from the checkpoint of the one before it."""
    status = F.when(F.col("event_type") == "view", jobs.OPEN).otherwise("completed")
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return tracking.replayed_jobs(events).select("job_id", "status", F.col("updated").cast("timestamp_ntz").alias("updated"), "events", "timeouts")


@query("""SELECT o_orderkey AS job_id, o_orderpriority || '/' || o_orderkey AS url, CASE WHEN o_orderstatus <> 'O' AND floor(o_totalprice)::BIGINT % 400 <= 300 THEN CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'failed' END ELSE 'timeout' END AS status,
CASE WHEN o_orderstatus <> 'O' AND floor(o_totalprice)::BIGINT % 400 <= 300 THEN NULL ELSE 'Polling timed out' END AS error FROM orders""")
def t5_outcome_stream(spark, sf_dir):
    """Orders as jobs: open ones never end, others after up to 400 seconds, by their price; 300 are waited for."""
    at = F.col("o_orderdate").cast("timestamp")
    o = read(spark, sf_dir, "orders").withColumn("ts", at)
    submitted = o.select(F.col("o_orderkey").alias("job_id"), F.concat("o_orderpriority", F.lit("/"), F.col("o_orderkey").cast("string")).alias("url"), "ts")
    took = F.floor("o_totalprice").cast("long") % 400
    status = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed")
    finished = o.where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("job_id"), status.alias("status"), F.timestamp_seconds(F.unix_seconds("ts") + took).alias("ts"))
    return tracking.replayed_outcomes(submitted, finished)

"""Queries that run the streams over the events that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidenza.streaming import jobs


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.file_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All days, as an end row closes the last."""
    return jobs.drained(jobs.tumbling(jobs.with_end(_events(spark, sf_dir), "ts"), "ts", ["event_type"], "value")).withColumn("total", F.round("total", 4))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.drained(jobs.sessions(jobs.with_end(_events(spark, sf_dir), "ts"), "ts", "user_id"))


def stream_first_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.drained(jobs.first_deliveries(_events(spark, sf_dir), ["event_id"], "ts").select("event_id", "event_type"))


def stream_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "click", "claimed").otherwise("enqueued")
    log = _events(spark, sf_dir).select(F.col("user_id").alias("job"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), kind.alias("event"))
    return jobs.drained(jobs.retry_transitions(log))


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sessions, stream_first_deliveries, stream_retries)}
ORACLE = {
    "stream_first_deliveries": "SELECT DISTINCT event_id, event_type FROM events",
    "stream_tumbling": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_sessions": "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, k",
    "stream_retries": """WITH e AS (SELECT user_id AS job, event_id AS seq, ts, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'claimed' ELSE 'enqueued' END AS event FROM events),
      b AS (SELECT *, coalesce(count(*) FILTER (WHERE event = 'failed') OVER w, 0) AS f, coalesce(count(*) FILTER (WHERE event = 'done') OVER w, 0) AS d FROM e WINDOW w AS (PARTITION BY job ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      s AS (SELECT job, seq, f + CASE WHEN event = 'failed' THEN 1 ELSE 0 END AS failures, event FROM b WHERE f < 3 AND d = 0)
      SELECT job, seq, CASE WHEN event = 'failed' AND failures >= 3 THEN 'dead_letter' WHEN event = 'failed' THEN 'retry_wait' WHEN event = 'done' THEN 'ready' WHEN event = 'claimed' THEN 'running' ELSE 'pending' END AS state, failures,
        CASE WHEN event = 'failed' AND failures < 3 THEN least(300.0, pow(2, failures - 1)) END AS wait_s FROM s""",
}

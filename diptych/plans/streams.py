"""Streams over the events table, run over all of it and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diptych.streaming import queues

from .catalog import Tables, query


def _events(t: Tables) -> DataFrame:
    return queues.events(t.spark, f"{t.folder}/events.parquet")


@query("""
SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1,2""")
def stream_tumbling(t: Tables) -> DataFrame:
    out = queues.finished(queues.tumbling(_events(t), "1 day", "40 days"), ["start", "event_type"])
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM g GROUP BY user_id, k""")
def stream_session(t: Tables) -> DataFrame:
    """Sessions in complete mode, in which the last batch has all of them, those still open too."""
    out = queues.finished(queues.sessions(_events(t), "user_id", "2 hours", "40 days"), None, "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("SELECT user_id, event_type, CAST(1 AS BIGINT) AS n FROM events GROUP BY 1,2")
def stream_dedup(t: Tables) -> DataFrame:
    out = queues.finished(queues.first_only(_events(t).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "40 days"), None, "append")
    return out.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH e AS (SELECT user_id, event_type = 'error' AS bad, row_number() OVER w AS i, lag(event_type = 'error', 1, false) OVER w AS bad1, lag(event_type = 'error', 2, false) OVER w AS bad2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
u AS (SELECT user_id, count(*) AS n_events, bool_or(bad AND bad1 AND bad2) AS spent, count(*) - coalesce(max(i) FILTER (NOT bad), 0) AS last_run FROM e GROUP BY 1)
SELECT user_id, CASE WHEN spent THEN 'failed' WHEN last_run > 0 THEN 'retrying' ELSE 'running' END AS state, CAST(CASE WHEN spent THEN 3 ELSE last_run END AS INTEGER) AS errors, n_events FROM u""")
def stream_state_machine(t: Tables) -> DataFrame:
    """Users by three errors in a row; one batch has all that is there, so that it is in time order."""
    out = queues.finished(queues.retry_machine(_events(t), "user_id"), ["key"])
    return out.select(F.col("key").alias("user_id"), "state", "errors", "n_events")


@query("""
SELECT event_type, event_type <> 'error' AS accepted, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2""")
def stream_queue(t: Tables) -> DataFrame:
    """Events worked off as a queue, in which all but errors are accepted; counts of what it kept."""
    work = queues.Queue(t.spark)
    rows = _events(t).select("event_id", "event_type", F.col("value").cast("decimal(18,2)").alias("value"))
    work.run(rows, lambda batch: batch.withColumn("accepted", F.col("event_type") != "error"))
    kept = work.results("event_id long, event_type string, value decimal(18,2), accepted boolean")
    return kept.groupBy("event_type", "accepted").agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("double").alias("total"))

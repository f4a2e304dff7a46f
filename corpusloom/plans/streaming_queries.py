"""Catalogue: the streaming operators in their batch form, at a fixed clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.registry import inline, query, table
from corpusloom.streaming import debounce, schedule


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n, max_by(event_type, (ts, event_type)) AS event_type FROM s GROUP BY user_id, session""")
def session_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as paths: the last event of each burst, parted by half an hour of quiet."""
    found = debounce.quiet_sessions(table(spark, sf_dir, "events"), F.col("user_id"), "ts", "30 minutes", "event_type")
    return found.withColumnRenamed("key", "user_id")


@query("""SELECT event_id AS id, CASE WHEN event_type = 'click' THEN 'writer heartbeat expired' ELSE 'queued job was never started' END AS error FROM events
WHERE event_type IN ('click', 'view') AND epoch(TIMESTAMP '2024-01-15 00:00:00')::BIGINT - epoch(date_trunc('second', ts))::BIGINT > 1200""")
def job_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as running jobs, views as queued ones."""
    state = F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "queued").otherwise("complete")
    jobs = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), state.alias("state"), F.col("ts").alias("created_at"), F.lit(None).cast("timestamp").alias("heartbeat_at"))
    return schedule.expired(jobs, "2024-01-15 00:00:00")


T = "TIMESTAMP'2024-01-01 {}'".format



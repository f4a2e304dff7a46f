"""Jobs and schedules as functions of tables and a clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_POLL = 60
POLL = {"local": 600, "google_drive": 300}
FULL = 43_200
QUEUE_TIMEOUT = 1200


def seconds(now: str, at: Column) -> Column:
    return F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(at)


def expired(jobs: DataFrame, now: str, timeout: int = QUEUE_TIMEOUT) -> DataFrame:
    """id, error of jobs that ran without a heartbeat, or waited, for over ``timeout`` seconds."""
    silent = (F.col("state") == "running") & (seconds(now, F.coalesce("heartbeat_at", "created_at")) > timeout)
    waiting = (F.col("state") == "queued") & (seconds(now, F.col("created_at")) > timeout)
    return jobs.filter(silent | waiting).select("id", F.when(silent, "writer heartbeat expired").otherwise("queued job was never started").alias("error"))


def admit(active: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, outcome for wanted jobs: the same as the active one joins it, another is rejected, else it is queued."""
    keys = ["kind", "source", "target", "reextract", "full"]
    one = active.filter(F.col("state").isin("queued", "running")).select(*[F.col(k).alias(f"a_{k}") for k in keys]).limit(1)
    both = wanted.join(one, F.lit(True), "left")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"a_{k}"))
    return both.select("id", F.when(F.col("a_kind").isNull(), "queued").when(same, "coalesced").otherwise("rejected").alias("outcome"))


def due(sources: DataFrame, now: str, started: str) -> DataFrame:
    """source, work (full or incremental), reference of the sources that are due.

    sources: source, kind, poll, last_sync_at, last_job_at, last_full_at, last_full_try_at, created_at.
    """
    poll = F.greatest(F.coalesce("poll", F.when(F.col("kind") == "google_drive", POLL["google_drive"]).otherwise(POLL["local"])), F.lit(LEAST_POLL))
    start = F.lit(started).cast("timestamp")
    reference = F.greatest(F.coalesce("last_sync_at", start), F.col("last_job_at"))
    full_age = seconds(now, F.coalesce("last_full_at", "created_at", start))
    throttled = F.coalesce(seconds(now, F.col("last_full_try_at")) < poll, F.lit(False))
    work = F.when((F.col("kind") == "google_drive") & (full_age >= FULL) & ~throttled, "full").when(seconds(now, reference) >= poll, "incremental")
    return sources.select("source", work.alias("work"), reference.alias("reference")).filter("work is not null")


def next_source(due_sources: DataFrame) -> DataFrame:
    """The most overdue source; of equals the first by name."""
    first = F.min(F.struct("reference", "source", "work")).alias("s")
    return due_sources.agg(first).select("s.source", "s.work").filter("source is not null")

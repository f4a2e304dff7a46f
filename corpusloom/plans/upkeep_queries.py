"""Catalogue: upkeep of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import upkeep
from corpusloom.plans.registry import inline, query, table


@query("""SELECT doc_id, source <> 'src4' AS checked, CASE WHEN source <> 'src4' THEN n_chars % 10 <> 0 END AS matches, CASE WHEN source = 'src4' THEN 'file_missing' END AS reason FROM documents""")
def integrity_rehash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded hashes of documents, some of another text, against their files, some of which are gone (both made up)."""
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "doc_id").alias("path")
    recorded = F.sha2(F.when(F.col("n_chars") % 10 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256)
    files = d.filter("source <> 'src4'").select(path, F.col("text").cast("binary").alias("content"))
    return upkeep.integrity(d.select(F.col("doc_id").alias("id"), path, recorded.alias("content_hash")), files).withColumnRenamed("id", "doc_id")


@query("SELECT event_id FROM events WHERE event_type <> 'purchase' AND ts < TIMESTAMP '2024-01-20 11:00:00'")
def artifact_garbage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as written files, purchases as those that a document references."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("name"), F.col("ts").alias("written_at"), "event_type")
    return upkeep.garbage(e, e.filter("event_type = 'purchase'"), "2024-01-20 12:00:00", complete=True).withColumnRenamed("name", "event_id")


@query("""SELECT doc_id, CASE WHEN quality = 0 AND toxic = 0 THEN 'open' ELSE 'resolved' END AS status, CASE WHEN toxic = 1 THEN 'removed' END AS resolution FROM labels""")
def reviews_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as reviews, the toxic ones decided."""
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, "open").otherwise("resolved").alias("status"), "toxic")
    reviews = rows.select("id", "status", F.lit(None).cast("string").alias("resolution"), F.lit(None).cast("timestamp").alias("updated_at"))
    out = upkeep.resolve(reviews, rows.filter("toxic = 1").select("id", F.lit("removed").alias("resolution")), "2024-01-01 00:00:00")
    return out.select(F.col("id").alias("doc_id"), "status", "resolution")


@query("""WITH e AS (SELECT event_type, epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(max(ts)) > 3 * 10800 AS late FROM events WHERE event_type <> 'error' GROUP BY 1),
c AS (SELECT 'sources' AS "check", CASE WHEN count(*) > 0 THEN 'ok' ELSE 'error' END AS status, count(*) AS n FROM e
  UNION ALL SELECT 'sync', CASE WHEN count(*) FILTER (late) > 0 OR count(*) = 0 THEN 'warning' ELSE 'ok' END, count(*) FILTER (late) FROM e
  UNION ALL SELECT 'reviews', CASE WHEN count(*) > 0 THEN 'warning' ELSE 'ok' END, count(*) FROM labels WHERE quality = 0 AND toxic = 0
  UNION ALL SELECT 'vectors', CASE WHEN count(*) > 0 THEN 'warning' ELSE 'ok' END, count(*) FROM (SELECT DISTINCT doc_id FROM documents) d WHERE NOT EXISTS (FROM embeddings v WHERE v.vec_id = d.doc_id))
SELECT * FROM c UNION ALL SELECT 'all', CASE WHEN bool_or(status = 'error') THEN 'blocked' WHEN bool_or(status = 'warning') THEN 'degraded' ELSE 'ready' END, count(*) FILTER (status <> 'ok') FROM c""")
def readiness_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as sources polled every three hours, labels as reviews (toxic ones of a complex layout), documents as chunks."""
    of_type = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_sync_at"))
    sources = of_type.select("*", (F.col("name") != "error").alias("enabled"), F.lit(10800).alias("poll"), F.lit(None).cast("string").alias("last_error"))
    reviews = table(spark, sf_dir, "labels").select(
        F.when(F.col("quality") == 0, "open").otherwise("resolved").alias("status"), F.when(F.col("toxic") == 1, "complex_layout").otherwise("low_confidence").alias("reason")
    )
    chunks = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("chunk_hash"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_hash"))
    return upkeep.readiness(sources, reviews, chunks, vectors, "2024-02-01 00:00:00")


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'complex_layout' ELSE role END AS reason FROM conversations)
SELECT conv_id, count(*) FILTER (reason <> 'complex_layout') AS reviews, coalesce(string_agg(DISTINCT reason, ',') FILTER (reason = 'complex_layout'), '') AS flags,
  coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (reason = 'complex_layout'), '') AS pages FROM c GROUP BY conv_id""")
def layout_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as artifacts, turns as reviews, an assistant's as those of a complex layout."""
    c = table(spark, sf_dir, "conversations").withColumn("reason", F.when(F.col("role") == "assistant", "complex_layout").otherwise(F.col("role")))
    a = c.groupBy("conv_id").agg(F.collect_list(F.struct("reason", F.col("turn").alias("page"))).alias("reviews"))
    out = upkeep.flagged(a)
    pages = F.concat_ws(",", F.transform("layout_pages", lambda p: p.cast("string")))
    return out.select("conv_id", F.size("reviews").cast("long").alias("reviews"), F.concat_ws(",", "layout_flags").alias("flags"), pages.alias("pages"))



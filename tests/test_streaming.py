"""Change feed and debounce, as batches and as streams."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.sources.feed import ChangeFeed, item_error, needs_full_scan
from corpusloom.streaming import debounce, schedule


def write_page(folder, n, *changes):
    (folder / f"{n:04d}.jsonl").write_text("# page\n" + "\n".join(map(json.dumps, changes)))


def test_feed(spark, tmp_path):
    spark.dataSource.register(ChangeFeed)
    feed = tmp_path / "feed"
    feed.mkdir()
    write_page(feed, 1, {"id": "a", "kind": "file", "name": "x"}, {"id": "b", "removed": True})
    assert spark.read.format("changefeed").option("path", str(feed)).load().count() == 2

    def run():
        stream = spark.readStream.format("changefeed").option("path", str(feed)).load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted((r["page"], r["id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [(1, "a"), (1, "b")]
    write_page(feed, 2, {"id": "c", "kind": "folder"})
    assert run() == [(1, "a"), (1, "b"), (2, "c")]  # goes on from the committed cursor


def test_feed_is_dealt(spark, tmp_path, monkeypatch):
    """Pages are read by as many tasks as there are ranges of them."""
    spark.dataSource.register(ChangeFeed)
    for n in range(1, 151):
        write_page(tmp_path, n, {"id": f"f{n}", "kind": "file"})
    rows = spark.read.format("changefeed").option("path", str(tmp_path)).load()
    assert rows.rdd.getNumPartitions() == 3 and sorted(r["page"] for r in rows.collect()) == list(range(1, 151))
    (tmp_path / "none").mkdir()
    assert spark.read.format("changefeed").option("path", str(tmp_path / "none")).load().count() == 0


def test_feed_rules():
    assert needs_full_scan({"removed": True}) and needs_full_scan({"kind": "folder"}) and not needs_full_scan({"kind": "file"})
    assert item_error(404, "") and item_error(403, "cannotDownloadFile") and not item_error(403, "rateLimitExceeded") and not item_error(500, "")


def test_debounce_stream(spark, tmp_path):
    source = tmp_path / "events"
    source.mkdir()
    schema = "path string, kind string, target string, at timestamp"
    rows = [
        ("a", "created", None, "2024-01-01 00:00:00.000"), ("a", "modified", None, "2024-01-01 00:00:00.200"),
        ("b", "moved", "old", "2024-01-01 00:00:00.000"), ("b", "modified", None, "2024-01-01 00:00:00.100"),
        ("c", "moved", "old2", "2024-01-01 00:00:00.000"), ("c", "deleted", None, "2024-01-01 00:00:00.100"),
    ]
    frame = lambda r: spark.createDataFrame(r, "path string, kind string, target string, at string").withColumn("at", F.col("at").cast("timestamp"))
    frame(rows).coalesce(1).write.mode("append").json(str(source))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = debounce.debounce(spark.readStream.schema(schema).json(str(source)))
    q = stream.writeStream.format("memory").queryName("released").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        frame([("z", "created", None, "2024-01-01 01:00:00")]).coalesce(1).write.mode("append").json(str(source))
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r["path"]: (r["kind"], r["target"]) for r in spark.table("released").collect()}
    assert got == {"a": ("modified", None), "b": ("moved", "old"), "c": ("deleted", None)}
    actions = {r["path"]: r["action"] for r in debounce.apply_changes(spark.table("released")).collect()}
    assert actions == {"a": "index", "b": "move", "c": "remove"}


def test_quiet_sessions_as_stream_and_batch(spark):
    rows = [("a", "2024-01-01 00:00:00.000", "x"), ("a", "2024-01-01 00:00:00.300", "y"), ("a", "2024-01-01 00:00:01.000", "z")]
    events = spark.createDataFrame(rows, "path string, at string, kind string").withColumn("at", F.col("at").cast("timestamp"))
    got = debounce.quiet_sessions(events, F.col("path"), "at", "350 milliseconds", "kind").orderBy("first").collect()
    assert [(r["n"], r["kind"]) for r in got] == [(2, "y"), (1, "z")]


@pytest.mark.parametrize(("age", "state", "error"), [(1200, "queued", None), (1201, "queued", "queued job was never started"), (1201, "running", "writer heartbeat expired"), (5000, "complete", None)])
def test_expiry(spark, age, state, error):
    jobs = spark.createDataFrame([(1, state)], "id int, state string").withColumn("created_at", (F.lit("2024-01-01 12:00:00").cast("timestamp") - F.make_interval(secs=F.lit(age))))
    got = schedule.expired(jobs.withColumn("heartbeat_at", F.col("created_at")), "2024-01-01 12:00:00").collect()
    assert [r["error"] for r in got] == ([error] if error else [])

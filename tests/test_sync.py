"""A change feed applied to an index by micro-batches: once each, whatever fails or is replayed."""

import json
from pathlib import Path

import pytest

from corpusloom.engine import Index
from corpusloom.plans.search import Options
from corpusloom.settings import Settings
from corpusloom.sources.feed import ChangeFeed
from corpusloom.streaming import sync


def test_follow(spark, tmp_path):
    class Files:
        """Items' bytes in a folder; an item whose file is named ``<id>.error`` cannot be had, ``<id>.down`` takes the source down."""

        def __init__(self, path):
            self.path = str(path)

        def content(self, item):
            at = Path(self.path) / item
            if at.with_suffix(".down").exists():
                raise ConnectionError("the source is down")
            if at.with_suffix(".error").exists():
                raise sync.ItemError("cannotDownloadFile")
            with open(at.with_suffix(".read"), "a") as f:
                f.write("x")
            return at.read_bytes()

    spark.dataSource.register(ChangeFeed)
    feed, store = tmp_path / "feed", tmp_path / "store"
    feed.mkdir()
    store.mkdir()
    index = Index(spark, str(tmp_path / "index"), settings=Settings(chunk_strategy="window"), fanout=20)
    page = lambda n, *rows: (feed / f"{n:04d}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    file = lambda i, name, *parents, **more: {"id": i, "kind": "file", "name": name, "parents": list(parents), **more}

    def run():
        rows = spark.readStream.format("changefeed").option("path", str(feed)).load()
        follow = sync.follow(index, "d1", "drive", "root", Files(store))
        rows.writeStream.foreachBatch(follow).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()

    found = lambda text: {r["path"] for r in index.search(text, Options(match="all")).collect() if r["matched_via"] == "content"}
    read = lambda i: len((store / i).with_suffix(".read").read_text())
    (store / "a").write_text("apples of the orchard")
    (store / "b").write_text("pears of the orchard")
    page(1, {"id": "F", "kind": "folder", "name": "fruit", "parents": ["root"]}, file("a", "a.txt", "F"), file("b", "b.txt", "root"), file("lost", "x.txt", "nowhere"))
    run()
    assert index.manifest.cursors == {"d1": 1} and found("orchard") == {"fruit/a.txt", "b.txt"}
    ids = {r["external_id"]: r["id"] for r in index.documents.collect()}
    # A replay (a lost checkpoint) changes nothing.
    changes = spark.read.format("changefeed").option("path", str(feed)).load()
    assert not sync.apply(index, changes, "d1", "drive", "root", Files(store)) and index.version() == 1
    # A batch that fails leaves nothing behind and comes again.
    (store / "b").write_text("quinces of the orchard")
    (store / "b.down").touch()
    page(2, file("b", "b.txt", "root"))
    with pytest.raises(Exception, match="down"):
        run()
    assert index.version() == 1 and found("pears") == {"b.txt"}
    (store / "b.down").unlink()
    run()
    assert index.manifest.cursors == {"d1": 2} and found("quinces") == {"b.txt"} and not found("pears")
    # A folder is renamed: its file moves with it and is not read again.
    page(3, {"id": "F", "kind": "folder", "name": "harvest", "parents": ["root"]})
    run()
    assert found("apples") == {"harvest/a.txt"} and read("a") == 1
    # The trash hides what is below a folder, restoring brings it back, without reading.
    page(4, {"id": "F", "trashed": True})
    run()
    assert not found("apples") and index.documents.filter("external_id = 'a'").first()["trashed_at"] is not None
    page(5, {"id": "F", "trashed": False})
    run()
    assert found("apples") == {"harvest/a.txt"} and read("a") == 1 and {r["action"] for r in index.actions().collect()} == {"restore", "unchanged"}
    # An item that cannot be had keeps its last good document; one that is removed goes; two pages in one batch.
    (store / "b.error").touch()
    page(6, file("b", "b.txt", "root"))
    page(7, {"id": "a", "removed": True})
    run()
    assert index.manifest.cursors == {"d1": 7} and found("quinces") == {"b.txt"} and not found("apples")
    assert [(r["path"], r["status"], r["error"]) for r in index.failures().collect()] == [("b.txt", "stale", "cannotDownloadFile")]
    assert {r["external_id"]: r["id"] for r in index.documents.collect()} == {"b": ids["b"]}
    rows = index.segments.table("sizes", index.manifest)
    assert index.manifest.sums["chunk_rows"] == rows.filter("kind = 'chunk'").agg({"n": "sum"}).first()[0] == index.chunks.count()

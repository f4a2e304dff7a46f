"""A drive's whole listing and the bytes kept beside an index."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.engine import Index
from corpusloom.plans.search import Options
from corpusloom.settings import Settings
from corpusloom.sources import drive as dr
from corpusloom.sources.raw import RawStore
from corpusloom.streaming import sync


def shelf_at(path):
    """A drive in one folder; its class is made here, so that it travels to the tasks whole."""

    class Shelf:
        """A drive in one folder: ``tree.json`` has folders' children, ``head`` the cursor, ``content/<id>`` bytes; pages of two items."""

        def __init__(self, path):
            self.path = str(path)

        def write(self, head, children, **more):
            Path(self.path, "tree.json").write_text(json.dumps({"head": head, "children": children} | more))

        def state(self):
            return json.loads(Path(self.path, "tree.json").read_text())

        def head(self):
            return self.state()["head"]

        def children(self, folder, token):
            s = self.state()
            at = int(token or 0)
            if [folder, at] in s.get("broken", []):
                raise dr.ItemError("insufficientFilePermissions")
            if folder in s.get("down", []):
                raise ConnectionError("the drive is down")
            items = s["children"].get(folder, [])
            more = at + 2 < len(items) or folder in s.get("endless", [])
            return items[at : at + 2], str(min(at + 2, len(items))) if more else None

        def content(self, item):
            at = Path(self.path, "content", item)
            if not at.exists():
                raise dr.ItemError("cannotDownloadFile")
            with open(Path(self.path, f"{item}.read"), "a") as f:
                f.write("x")
            return at.read_bytes()

        def put(self, item, text):
            Path(self.path, "content").mkdir(exist_ok=True)
            Path(self.path, "content", item).write_text(text)

        def reads(self, item):
            at = Path(self.path, f"{item}.read")
            return len(at.read_text()) if at.exists() else 0

    return Shelf(path)


def file(i, name, version="1", **more):
    return {"id": i, "kind": "file", "name": name, "version": version} | more


def folder(i, name, **more):
    return {"id": i, "kind": "folder", "name": name} | more


def test_walk(spark, tmp_path):
    shelf = shelf_at(tmp_path)
    # Pages, a loop of folders, an item in two folders, a trashed folder with an item, rows without an id.
    children = {
        "root": [folder("A", "a"), folder("B", "b"), file("1", "one.txt"), file("2", "two.txt"), file("3", "three.txt")],
        "A": [folder("B", "b"), file("1", "one.txt"), {"kind": "file", "name": "nameless"}],
        "B": [folder("A", "a"), folder("root", "top"), folder("C", "c", trashed=True)],
        "C": [file("4", "four.txt")],
    }
    shelf.write(7, children)
    walked = dr.walk(spark, shelf, "root")
    got = {r["id"]: (r["kind"], r["trashed"], r["parents"]) for r in walked.items.collect()}
    assert walked.cursor == 7 and walked.failed.isEmpty()
    assert got == {
        "A": ("folder", False, ["B", "root"]), "B": ("folder", False, ["A", "root"]), "C": ("folder", True, ["B"]), "1": ("file", False, ["A", "root"]),
        "2": ("file", False, ["root"]), "3": ("file", False, ["root"]), "4": ("file", False, ["C"]),
    }
    # A page that cannot be had: what came before it counts, the folder is named; tokens that come again end the folder.
    shelf.write(8, children, broken=[["root", 4]], endless=["C"])
    walked = dr.walk(spark, shelf, "root")
    assert {r["id"] for r in walked.items.collect()} == {"A", "B", "C", "1", "2", "4"}
    assert {tuple(r) for r in walked.failed.collect()} == {("root", "insufficientFilePermissions"), ("C", "pageTokenRepeated")}
    shelf.write(8, {})
    assert dr.walk(spark, shelf, "root").items.count() == 0
    shelf.write(8, children, down=["B"])
    with pytest.raises(Exception, match="down"):
        dr.walk(spark, shelf, "root").items.count()


def test_rescan(spark, tmp_path):
    shelf, raw = shelf_at(tmp_path), RawStore(spark, str(tmp_path / "raw"))
    index = Index(spark, str(tmp_path / "index"), settings=Settings(chunk_strategy="window"), fanout=20)
    found = lambda text: {r["path"] for r in index.search(text, Options(match="all", mode="full_text")).collect() if r["matched_via"] == "content"}
    scan = lambda **more: sync.rescan(index, shelf, "d1", "drive", "root", shelf, raw=raw, **more)
    changes = lambda *rows: spark.createDataFrame([{"removed": None, "trashed": None, "parents": None, "name": None, "kind": None, "version": None} | r for r in rows], "page int, id string, kind string, removed boolean, trashed boolean, name string, parents array<string>, version string")
    apply = lambda *rows: sync.apply(index, changes(*rows), "d1", "drive", "root", shelf, raw=raw)
    for item, text in {"a": "apples of the orchard", "b": "pears of the orchard", "c": "plums of the orchard"}.items():
        shelf.put(item, text)
    base = {"root": [folder("F", "fruit"), file("b", "b.txt")], "F": [file("a", "a.txt"), file("c", "c.txt")]}
    shelf.write(3, base)
    assert scan() and index.manifest.cursors == {"d1": 3} and found("orchard") == {"b.txt", "fruit/a.txt", "fruit/c.txt"}
    # The same again reads nothing; pages up to the cursor are known.
    ids = {r["external_id"]: r["id"] for r in index.documents.collect()}
    assert scan() and [shelf.reads(i) for i in "abc"] == [1, 1, 1] and not apply({"page": 3, "id": "b", "removed": True})
    # A change during the walk: the listing has it already, the feed brings it again.
    shelf.put("b", "quinces of the orchard")
    assert apply({"page": 4, "id": "b", "version": "2"}) and found("quinces") == {"b.txt"} and shelf.reads("b") == 2
    # A new version is read, a renamed one is not; a new suffix is extracted from the kept bytes.
    shelf.put("a", "cherries of the orchard")
    shelf.write(4, {"root": [folder("F", "fruit"), file("b", "b.md", "2")], "F": [file("a", "a.txt", "2"), file("c", "plum.txt")]})
    assert scan() and found("orchard") == {"b.md", "fruit/a.txt", "fruit/plum.txt"} and found("cherries") == {"fruit/a.txt"} and not found("apples")
    assert [shelf.reads(i) for i in "abc"] == [2, 2, 1]
    # A folder that cannot be listed: nothing goes, the cursor stays, the source is partial.
    shelf.write(9, {"root": [folder("F", "fruit")], "F": []}, broken=[["F", 0]])
    assert not scan() and index.manifest.cursors == {"d1": 4} and found("orchard") == {"b.md", "fruit/a.txt", "fruit/plum.txt"}
    assert [(r["path"], r["stage"], r["error"]) for r in index.failures().collect()] == [("fruit", "listing", "insufficientFilePermissions")]
    assert index.coverage().first()["status"] == "partial" and sync.listing_complete(index, "d1") is False
    assert apply({"page": 5, "id": "c", "version": "1"}) and sync.listing_complete(index, "d1") is False and index.failures().count() == 1
    # ``follow`` lists such a source again; items that are not listed then go, and so do their bytes once they are old.
    shelf.write(9, {"root": [folder("F", "fruit")], "F": [file("c", "plum.txt")]})
    sync.follow(index, "d1", "drive", "root", shelf, raw=raw, drive=shelf)(changes({"page": 6, "id": "a", "removed": True}), 0)
    assert sync.listing_complete(index, "d1") and index.manifest.cursors == {"d1": 9} and index.failures().count() == 0
    assert {r["external_id"]: r["id"] for r in index.documents.collect()} == {"c": ids["c"]} and raw.table().count() == 5
    assert scan(now="2100-01-01 00:00:00") and [r["content"].decode() for r in raw.table().collect()] == ["plums of the orchard"]
    # What changes in the trash is read when it leaves it.
    assert apply({"page": 10, "id": "F", "trashed": True}) and not found("plums")
    shelf.put("c", "medlars of the orchard")
    assert apply({"page": 11, "id": "c", "version": "5"}) and shelf.reads("c") == 1
    assert apply({"page": 12, "id": "F", "trashed": False}) and found("medlars") == {"fruit/plum.txt"} and shelf.reads("c") == 2


def test_raw_store(spark, tmp_path):
    raw = RawStore(spark, str(tmp_path / "raw"))
    files = lambda rows: spark.createDataFrame([(i, None if t is None else t.encode()) for i, t in rows], "id string, content binary").withColumn("content_hash", F.sha2("content", 256))
    held = lambda wanted: {bytes(r["content"]).decode() for r in raw.get(wanted).collect()}
    assert raw.table().count() == 0 and held(files([("1", "x")])) == set()
    raw.put(files([]))
    one = files([("1", "first"), ("2", "first"), ("3", "second" * 1000), ("4", ""), ("5", None)])
    raw.put(one)
    assert len(raw.batches()) == 1 and raw.table().count() == 3 and held(one) == {"first", "second" * 1000, ""}
    raw.put(files([("9", "first")]))
    assert len(raw.batches()) == 1  # nothing new
    # A batch that was not committed does not count.
    (tmp_path / "raw" / "b-0123").mkdir()
    assert len(raw.batches()) == 1
    docs = one.select("id", "content_hash").unionByName(files([("7", "absent")]).select("id", "content_hash"))
    state = lambda: {r["id"]: (r["checked"], r["matches"], r["reason"]) for r in raw.verify(docs).collect()}
    good, none = (True, True, None), (False, None, "no_raw_cache")
    assert state() == {"1": good, "2": good, "3": good, "4": good, "5": none, "7": none}
    # Bytes that are not what their hash says are found, are no answer, and are stored anew.
    wrong = raw.table().select(F.sha2(F.lit("third"), 256).alias("content_hash"), "size", "written_at", F.lit(b"thirb").alias("content")).limit(1)
    raw._write(wrong)
    third = files([("8", "third")])
    assert held(third) == set() and raw.verify(third).first()["matches"] is False
    raw.put(third)
    assert held(third) == {"third"} and raw.verify(third).first()["matches"] is True
    # A file that cannot be read is as good as absent, and stops a clean-up.
    raw.put(files([("10", "fourth" * 10)]))
    new = max((tmp_path / "raw").glob("b-*"), key=lambda p: p.stat().st_mtime_ns)
    for part in new.glob("*.parquet"):
        part.write_bytes(b"PAR1 not a table")
    for crc in new.glob(".*.crc"):
        crc.unlink()
    fourth = files([("10", "fourth" * 10)])
    assert held(fourth) == set()
    raw.put(fourth)
    assert held(fourth) == {"fourth" * 10} and held(third) == {"third"}


def test_raw_clean(spark, tmp_path):
    raw = RawStore(spark, str(tmp_path / "raw"))
    files = lambda *texts: spark.createDataFrame([(t, t.encode()) for t in texts], "id string, content binary").withColumn("content_hash", F.sha2("content", 256))
    kept = lambda: {bytes(r["content"]).decode() for r in raw.table().collect()}
    raw.put(files("aaaa", "bbbb"))
    raw.put(files("cccc", "dddd", "eeee", "ffff"))
    late, soon = "2100-01-01 00:00:00", spark.sql("SELECT cast(current_timestamp() AS string)").first()[0]
    # Young contents are spared, and all after an incomplete listing.
    assert raw.clean(files("aaaa"), soon, True) == 0 and raw.clean(files("aaaa"), late, False) == 0 and len(kept()) == 6
    # A batch of which little is garbage stays.
    second = [b for b in raw.batches() if raw.table([b]).count() == 4]
    assert raw.clean(files("aaaa", "cccc", "dddd", "eeee"), late, True) == 1 and kept() == {"aaaa", "cccc", "dddd", "eeee", "ffff"}
    assert second[0] in raw.batches()
    assert raw.clean(files("aaaa", "cccc"), late, True) == 3 and kept() == {"aaaa", "cccc"}
    # Many small batches become one.
    for i in range(9):
        raw.put(files(f"small{i}"))
    everything = raw.table().select("content_hash")
    assert len(raw.batches()) == 11 and raw.clean(everything, late, True) == 0
    assert len(raw.batches()) == 1 and len(kept()) == 11
    assert raw.clean(files("none"), late, True) == 11 and kept() == set()

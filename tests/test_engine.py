"""Files to an index to answers."""

import os
import random
from collections import Counter
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.engine import Index
from corpusloom.operators import lexical, segments, semantic, upkeep
from corpusloom.operators.vectors import Filled, Model
from corpusloom.plans.search import Options
from corpusloom.settings import Settings
from corpusloom.sources import documents as D

LAW = "Số: 99/2026/NĐ-CP\nNGHỊ ĐỊNH\nVề thử nghiệm\n\nĐiều 1. Phạm vi\nQuy định về cây cam.\nĐiều 2. Hợp đồng\nHợp đồng mua đường.\nĐiều 3. Thi hành\nHiệu lực."


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    (root / "sub").mkdir()
    (root / "law.txt").write_text(LAW)
    (root / "notes.md").write_text("# Orchard\nharvest of apples\n\n## Pears\npears and apples in autumn\n")
    (root / "sub" / "long.txt").write_text("orchard harvest " * 200)
    (root / "sub" / "copy.txt").write_text("orchard harvest " * 200)
    (root / "data.json").write_text('{"fruit": "apples", "n": 3}')
    (root / "bad.json").write_text("{")
    (root / ".git").mkdir()
    (root / ".git" / "x.txt").write_text("apples that are not to be found")
    (root / "tool.bin").write_bytes(b"apples")
    out = Index(spark, str(tmp_path_factory.mktemp("index")))
    assert out.version() == 0
    out.build(str(root), "s1", "notes")
    return out, root


def found(hits):
    return [(r["cite_key"], r["document_ref"]) for r in hits.orderBy("place").collect()]


def test_structured_keys_and_accents(index):
    index = index[0]
    for query in ("hợp đồng", "hop dong", "ĐƯỜNG"):
        assert found(index.search(query))[0][0] == "99/2026/NĐ-CP#dieu-2"
    assert found(index.search("pears"))[0][1] == "notes:notes.md"


def test_match_modes(index):
    index = index[0]
    assert {r for _, r in found(index.search("apples fruit", Options(match="all")))} == {"notes:data.json"}
    assert {r for _, r in found(index.search("apples fruit", Options(match="any")))} == {"notes:data.json", "notes:notes.md"}
    assert found(index.search("apples fruit"))[0][1] == "notes:data.json"
    assert {r for _, r in found(index.search("harvest of apples", Options(match="phrase")))} == {"notes:notes.md"}
    assert found(index.search("zzznothing")) == []


def test_filters_and_copies(index):
    index = index[0]
    scoped = found(index.search("harvest", Options(scope="sub", limit=20)))
    assert {r for _, r in scoped} <= {"notes:sub/long.txt", "notes:sub/copy.txt"} and scoped
    assert found(index.search("harvest", Options(scope="su"))) == []
    assert {r for _, r in found(index.search("apples", Options(media_type="application/json")))} == {"notes:data.json"}
    assert found(index.search("apples", Options(source="other"))) == []
    one = found(index.search("orchard harvest", Options(per_document=1, limit=20)))
    assert len([r for _, r in one if r.startswith("notes:sub")]) <= 2
    for bad in (Options(limit=0), Options(match="x"), Options(scope="../x"), Options(modified_after="2026-01-02", modified_before="2026-01-01")):
        with pytest.raises(ValueError):
            index.search("x", bad)
    with pytest.raises(ValueError):
        index.search("!!")


def test_vectors_and_rerank(spark, index):
    index = index[0]
    hashes = index.chunks.select("chunk_hash").distinct().orderBy("chunk_hash")
    index.vectors = hashes.select("chunk_hash", F.array(F.conv(F.substring("chunk_hash", 1, 4), 16, 10).cast("float"), F.lit(100.0).cast("float")).alias("embedding"))
    asked = spark.createDataFrame([(1, "apples")], "query_id int, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query array<float>")
    hybrid = index.search(asked, Options(limit=20), query_vectors=vectors)
    assert {r["matched_via"] for r in hybrid.collect()} >= {"semantic"}
    only = index.search(asked, Options(mode="semantic", limit=5), query_vectors=vectors).orderBy("place").collect()
    assert [r["score"] for r in only] == sorted((r["score"] for r in only), reverse=True)

    @F.pandas_udf("double")
    def marker(question: pd.Series, text: pd.Series) -> pd.Series:
        return text.str.count("pears").astype(float)

    assert "Pears" in index.search(asked, Options(limit=5), rerank=marker).orderBy("place").first()["text"]


def test_reads(index):
    index = index[0]
    row = index.read("notes:law.txt", start=0, size=20).first()
    assert row["start"] == 0 and row["stop"] == 20 and row["next_start"] == 20 and row["spans"]
    with pytest.raises(ValueError):
        index.read("notes:none.txt")
    keys = {r["cite_key"] for r in index.get_chunk("99/2026/NĐ-CP#dieu-2", 1).collect()}
    assert keys == {"99/2026/NĐ-CP#dieu-1", "99/2026/NĐ-CP#dieu-2", "99/2026/NĐ-CP#dieu-3"}
    seen, after = [], None
    while True:
        page, after = index.list_documents(2, after)
        seen += [r["id"] for r in page.collect()]
        if not after:
            break
    assert seen == sorted(set(seen)) and len(seen) == 5
    status = {r["id"]: r["warnings"] for r in index.check_status("2026-01-01").collect()}
    assert sum("DUPLICATE_SHA256" in w for w in status.values()) == 2 and all("UNKNOWN_VALIDITY" in w for w in status.values())


def test_status_of_scans(spark, tmp_path):
    """Text of a recognition backend is unverified, and what the backend reports is an open review."""
    files = {"clear.png": b"read me", "poor.pdf": b"smudged words", "blank.jpg": b" ", "plain.txt": b"typed by hand"}
    (tmp_path / "files").mkdir()
    for name, data in files.items():
        (tmp_path / "files" / name).write_bytes(data)

    def backend(suffix, data):
        reviews = ["low_quality_ocr"] if suffix == ".pdf" else [] if data.strip() else ["blank_or_failed_ocr"]
        return [("pdf_page", "page:1", data.decode())], reviews

    plain = Settings(chunk_strategy="window")
    scans = Index(spark, str(tmp_path / "index"), settings=plain)
    scans.build(str(tmp_path / "files"), "s1", "scans", backend)
    names = {r["id"]: r["relative_path"] for r in scans.documents.collect()}
    got = {names[r["id"]]: set(r["warnings"]) - {"UNKNOWN_VALIDITY"} for r in scans.check_status("2026-01-01").collect()}
    assert got == {"clear.png": {"OCR_UNVERIFIED"}, "poor.pdf": {"OCR_UNVERIFIED", "OPEN_REVIEWS"}, "blank.jpg": {"OPEN_REVIEWS"}, "plain.txt": set()}
    bare = Index(spark, str(tmp_path / "bare"), settings=plain)
    bare.build(str(tmp_path / "files"), "s1", "scans")
    assert sum("OPEN_REVIEWS" in r["warnings"] for r in bare.check_status("2026-01-01").collect()) == 3


def test_evaluate(spark, index):
    questions = spark.createDataFrame([(1, "hợp đồng", ["99/2026/NĐ-CP#dieu-2"]), (2, "pears", ["none#x"])], "id int, question string, gold array<string>")
    got = index[0].evaluate(questions).first()
    assert got["count"] == 2 and got["recall_1"] == 0.5 and got["mrr_10"] == 0.5
    by = {r["diacritics"]: (r["count"], r["recall_1"]) for r in index[0].evaluate(questions, by=["diacritics"]).collect()}
    assert by == {True: (1, 1.0), False: (1, 0.0)}
    typed = questions.withColumn("type", F.lit("fact"))
    assert [(r["type"], r["count"]) for r in index[0].evaluate(typed, by=["type"]).collect()] == [("fact", 2)]


def test_metadata_numbers_locations_and_warnings(spark, index):
    index = index[0]
    # Only the metadata of data.json holds the word columns' keys; titles are metadata too.
    by_title = index.search("copy", Options(match="any", limit=20, per_document=20)).collect()
    assert [(r["matched_via"], r["document_ref"]) for r in by_title if r["cite_key"] is None] == [("automatic", "notes:sub/copy.txt")]
    assert all(r["text"].startswith("automatic: copy") for r in by_title if r["cite_key"] is None)
    # A question that is a number, and a number beside one, together with plain questions in a batch.
    asked = spark.createDataFrame([(1, "99/2026/NĐ-CP"), (2, "orchard harvest"), (3, "zzznothing")], "query_id int, text string")
    rows = index.search(asked, Options(limit=5)).orderBy("query_id", "place").collect()
    first = [r for r in rows if r["query_id"] == 1]
    assert [r["matched_via"] for r in first[:3]] == ["doc_no"] * 3 and {r["doc_no"] for r in first[:3]} == {"99/2026/NĐ-CP"} and first[0]["score"] == 1.0
    assert not [r for r in rows if r["query_id"] == 3]
    beside = index.search("apples", Options(doc_no="99/2026/NĐ-CP", limit=5)).orderBy("place").collect()
    assert [r["matched_via"] for r in beside[:3]] == ["doc_no"] * 3 and beside[3]["document_ref"] != "notes:law.txt"
    # Both copies of a body are its locations; only one of them is a hit.
    copied = [r for r in rows if r["query_id"] == 2 and r["n_locations"] > 1]
    assert copied and {x["path"] for x in copied[0]["locations"]} == {"sub/long.txt", "sub/copy.txt"}
    assert {r["path"] for r in index.locations(index.search("orchard harvest")).collect()} >= {"sub/long.txt", "sub/copy.txt", "notes.md"}
    assert len({r["body_hash"] for r in rows if r["query_id"] == 2}) == len([r for r in rows if r["query_id"] == 2 and r["cite_key"]])
    # Citation and provenance of a structured chunk.
    hit = next(r for r in index.search("hợp đồng").collect() if r["cite_key"] == "99/2026/NĐ-CP#dieu-2")
    assert hit["citation"]["path"] == "law.txt" and hit["citation"]["doc_no"] == "99/2026/NĐ-CP" and hit["citation"]["locators"][0].startswith("line:")
    assert hit["section_path"] and hit["provenance"][0]["kind"] == "line" and hit["warnings"] and hit["effective_mode"] == "full_text" and hit["ocr"] is False
    assert {r["effective_match"] for r in index.search("apples zzznothing").collect()} == {"any"}
    assert not index.search("apples", Options(mode="full_text")).first()["warnings"]


def test_rebuild_reads_only_what_changed(index, monkeypatch):
    index, root = index
    before = {r["relative_path"]: r["id"] for r in index.documents.collect()}
    chunks = {r["row_id"]: r["text"] for r in index.chunks.collect()}
    (root / "new.txt").write_text("a new file about quinces")
    (root / "notes.md").rename(root / "sub" / "moved.md")
    (root / "data.json").write_text("{broken")
    (root / "sub" / "copy.txt").unlink()
    asked, contents = [], D.contents
    monkeypatch.setattr(D, "contents", lambda spark, root, wanted: (asked.append({r["relative_path"] for r in wanted.collect()}), contents(spark, root, wanted))[1])
    index.build(str(root), "s1", "notes")
    after = {r["relative_path"]: r["id"] for r in index.documents.collect()}
    assert index.version() == 2 and asked[0] == {"new.txt", "sub/moved.md", "data.json", "bad.json"} and "law.txt" not in asked[1]
    assert after["law.txt"] == before["law.txt"] and after["sub/moved.md"] == before["notes.md"] and after["new.txt"] > max(before.values())
    assert after["data.json"] == before["data.json"] and "sub/copy.txt" not in after and "notes.md" not in after
    assert {(r["path"], r["status"], r["error"]) for r in index.failures().collect()} == {("data.json", "stale", "format_parse_failed"), ("bad.json", "unindexed", "format_parse_failed")}
    assert [tuple(r) for r in index.coverage().collect()] == [("s1", "partial", 2, 0)]
    assert {r["action"]: r["files"] for r in index.actions().collect()} == {"unchanged": 2, "moved": 1, "moved_away": 1, "extract": 2, "cached_reindex": 1, "deleted": 1}
    assert found(index.search("quinces"))[0][1] == "notes:new.txt"
    assert "notes:data.json" in {r for _, r in found(index.search("apples", Options(match="any")))}  # the last good one
    assert {r for _, r in found(index.search("pears"))} == {"notes:sub/moved.md"}
    kept = {r["row_id"]: r["text"] for r in index.chunks.filter(F.col("document") == after["law.txt"]).collect()}
    assert kept and all(chunks[k] == v for k, v in kept.items())
    n = index.inverted.stats.first()["n"]
    assert n == index.chunks.count() and index.inverted.postings.select("row_id").distinct().count() == n
    got = {r["id"]: (r["checked"], r["matches"]) for r in index.integrity(str(root)).collect()}
    assert got[after["law.txt"]] == (True, True) and got[after["data.json"]] == (True, False)


def test_segments(spark, tmp_path):
    """Builds write what changed; a search over segments, tombstones and merges equals one over a fresh index."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(5, 60)))
    root = tmp_path / "files"
    root.mkdir()
    for i in range(12):
        (root / f"f{i}.txt").write_text(text())
    (root / "twin.txt").write_text((root / "f3.txt").read_text())
    plain = Settings(chunk_strategy="window", chunk_chars=120, chunk_overlap=20)
    index = Index(spark, str(tmp_path / "index"), settings=plain, fanout=3)
    index.build(str(root), "s1", "notes")
    rows = lambda n, name: spark.read.parquet(index.segments.path(n, name)).count()
    assert rows(1, "documents") == 13
    (root / "f0.txt").write_text(text() + " quince")
    (root / "new.txt").write_text("a quince and w1")
    (root / "f1.txt").unlink()
    os.utime(root / "f2.txt", (1, 1))
    index.build(str(root), "s1", "notes")
    # Two documents were made, one was restated; two tombstones hide rows, three hide documents.
    assert (rows(2, "documents"), rows(2, "extractions")) == (3, 2)
    made = {r["document"] for r in spark.read.parquet(index.segments.path(2, "chunks")).collect()}
    assert len(made) == 2 and rows(2, "chunks") < 12 and {r["relative_path"] for r in index.documents.filter(F.col("id").isin(*made)).collect()} == {"f0.txt", "new.txt"}
    assert Counter(r["part"] for r in spark.read.parquet(index.segments.path(2, "dead")).collect()) == {"rows": 2, "document": 3}
    restated = index.documents.filter("relative_path = 'f2.txt'").first()
    assert restated["modified_us"] == 1_000_000 and index.chunks.filter(F.col("document") == restated["id"]).count() > 0
    (root / "new.txt").unlink()
    (root / "late.txt").write_text("quince " * 3 + text())
    index.build(str(root), "s1", "notes")  # the third segment: all are merged
    assert index.manifest.segments == [[4, 1]] and not index.manifest.dead and index.manifest.latest == 3
    # The highest id was given up with new.txt and is not given again.
    ids = {r["relative_path"]: r["id"] for r in index.documents.collect()}
    assert ids["late.txt"] > max(i for p, i in ids.items() if p != "late.txt") + 1
    assert index.vacuum() == [1, 2] and index.version() == 4
    fresh = Index(spark, str(tmp_path / "fresh"), settings=plain)
    fresh.build(str(root), "s1", "notes")
    asked = spark.createDataFrame([(1, "quince w1"), (2, "w3 w4 w5"), (3, "w7"), (4, "late")], "query_id int, text string")
    seen = lambda x, o: [(r["query_id"], r["place"], r["path"], r["chunk_ordinal"], r["score"], r["matched_via"], r["n_locations"]) for r in x.search(asked, o).orderBy("query_id", "place").collect()]
    names = lambda x: {r["row_id"]: (r["text"], r["cite_key"][r["cite_key"].index("#"):]) for r in x.chunks.collect()}
    assert sorted(names(index).values()) == sorted(names(fresh).values())
    assert [r[0] for r in index.inverted.stats.collect()] == [r[0] for r in fresh.inverted.stats.collect()] == [fresh.chunks.count()]
    assert index.inverted.stats.first()["mean"] == fresh.inverted.stats.first()["mean"] and index.inverted_metadata.stats.first() == fresh.inverted_metadata.stats.first()
    costs = lambda x: sorted((r["cost"] for r in lexical.bm25_postings(x.inverted, asked).select(F.round("cost", 9).alias("cost")).collect()))
    assert costs(index) == costs(fresh)
    for o in (Options(limit=8), Options(match="phrase")):
        assert {x[2] for x in seen(index, o)} == {x[2] for x in seen(fresh, o)} and len(seen(index, o)) == len(seen(fresh, o))
    assert index.build(str(root), "s1", "notes") is None and rows(5, "documents") == 0 and not (tmp_path / "index" / "v=5" / "dead").is_dir() or rows(5, "dead") == 0


def scanned(df, column):
    """Rows that the scans of a column's table read, by Spark's own counts."""
    df.collect()
    found = []

    def walk(node):
        if node.nodeName().startswith("Scan parquet") and column in node.toString():
            found.append(node.metrics().get("numOutputRows").get().value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_keyed_reads(spark, tmp_path, monkeypatch):
    """Rows are fetched by their keys: of a table in the order of its key only the pages that hold them are read."""
    store = segments.Segments(spark, str(tmp_path / "s"))
    rows = spark.range(300_000).select(F.concat_ws("/", "id", F.lit("0")).alias("row_id"), F.col("id").alias("document"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    store.write(1, "chunks", rows.coalesce(1))
    store.commit(segments.Manifest(1, [[1, 0]], [], {}, 300_000, 1))
    wanted = spark.createDataFrame([(f"{12_340 + i}/0",) for i in range(12)], "row_id string")
    few = segments.fetch(store.table("chunks", store.manifest()), "row_id", wanted)
    assert few.count() == 12 and sum(scanned(few, "text")) <= 80_000
    many = segments.fetch(store.table("chunks", store.manifest()), "row_id", spark.range(2000).select(F.concat_ws("/", "id", F.lit("0")).alias("row_id")))
    assert many.count() == 2000
    # A column that a later form adds is null in rows that were written before, and there in new ones.
    monkeypatch.setitem(segments.ADDED, "chunks", {"lang": "string"})
    assert store.table("chunks", store.manifest()).filter("lang is null").count() == 300_000
    store.write(2, "chunks", rows.limit(5).withColumn("lang", F.lit("en")))
    store.commit(segments.Manifest(2, [[1, 0], [2, 0]], [], {}, 300_000, 2))
    assert store.table("chunks", store.manifest()).groupBy("lang").count().count() == 2
    store.commit(segments.Manifest(3, [], [], {}, 0, 3, format=99))
    with pytest.raises(ValueError):
        store.manifest()


def test_vectors_stay_where_they_are(spark, index, monkeypatch):
    """No exchange of a semantic search carries a vector, and copies of a chunk share one."""
    index = index[0]
    given = index._vectors
    index.vectors = index.chunks.select("chunk_hash").distinct().select("chunk_hash", F.array(F.conv(F.substring("chunk_hash", 1, 4), 16, 10).cast("float"), F.lit(100.0).cast("float")).alias("embedding"))
    plans, nearest = [], semantic.nearest

    def spied(*args, **more):
        out = nearest(*args, **more)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(semantic, "nearest", spied)
    asked = spark.createDataFrame([(1, "apples")], "query_id int, text string")
    hits = index.search(asked, Options(mode="semantic", limit=20, per_document=20), query_vectors=spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query array<float>"))
    assert hits.count() > 3
    below = plans[0].split("MapInArrow", 1)
    assert len(below) == 2 and "embedding" not in below[0]
    index.vectors = given


def test_corrections_and_model(spark, tmp_path):
    """A corrected page changes hits, spans and vectors, and survives a build that makes the document anew."""
    root = tmp_path / "files"
    root.mkdir()
    (root / "scan.pdf").write_bytes(b"ornge tree|second page")
    (root / "other.txt").write_text("a pear tree")

    def backend(suffix, data):
        return [("pdf_page", f"page:{i + 1}", t) for i, t in enumerate(data.decode().split("|"))], ["low_quality_ocr"]

    def factory():
        class Letters:
            def embed(self, texts):
                return [[t.count("o") + 1, t.count("e") + 1] for t in texts]

        return Letters()

    model = Model("letters#1", factory, 2)
    index = Index(spark, str(tmp_path / "index"), settings=Settings(chunk_strategy="window"), model=model)
    index.build(str(root), "s1", "scans", backend)
    assert index.embed() == Filled(index.chunks.select("chunk_hash").distinct().count(), 0, None) and index.embed().embedded == 0
    found = lambda text: {r["path"] for r in index.search(text, Options(match="all", mode="full_text")).collect()}
    assert not found("orange") and found("ornge") == {"scan.pdf"}
    one = index.documents.filter("relative_path = 'scan.pdf'").first()["id"]
    index.correct(spark.createDataFrame([(one, 1, "an orange tree of old"), (one, 9, "no such page")], "document long, page int, text string"))
    index.correct(spark.createDataFrame([(one, 1, "an orange tree")], "document long, page int, text string"))
    row = index.documents.filter(F.col("id") == one).first()
    assert row["text"] == "an orange tree\n\nsecond page" and [(s["start"], s["stop"]) for s in row["spans"]] == [(0, 14), (16, 27)] and row["word_count"] == 5
    assert found("orange") == {"scan.pdf"} and not found("ornge") and not found("old") and index.documents.count() == 2
    assert index.embed().embedded == 1
    hits = index.search("orange", Options(limit=5)).collect()
    assert {r["effective_mode"] for r in hits} == {"hybrid"} and "semantic" in {r["matched_via"] for r in hits} | {"semantic"}
    (root / "scan.pdf").rename(root / "moved.pdf")  # made anew from its bytes
    index.build(str(root), "s1", "scans", backend)
    assert found("orange") == {"moved.pdf"} and not found("ornge")
    (root / "moved.pdf").write_bytes(b"ornge again|second page")  # other bytes: the revision was not of these
    index.build(str(root), "s1", "scans", backend)
    assert found("ornge") == {"moved.pdf"} and not found("orange")


def test_limits_are_settings(spark, tmp_path):
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "big.csv").write_text("a,b\n" + "1,2\n" * 50)
    (tmp_path / "files" / "small.csv").write_text("a,b\n1,2\n")
    index = Index(spark, str(tmp_path / "index"), settings=Settings(max_csv_rows=10, chunk_strategy="window"))
    index.build(str(tmp_path / "files"), "s1", "notes")
    assert [r["relative_path"] for r in index.documents.collect()] == ["small.csv"]
    assert [(r["path"], r["error"]) for r in index.failures().collect()] == [("big.csv", "format_too_large")]


def test_readiness(spark, index):
    rows = {r["check"]: (r["status"], r["n"]) for r in index[0].readiness("2000-01-01 00:00:00").collect()}
    assert rows["sources"] == ("ok", 1) and rows["sync"] == ("ok", 0)
    assert rows["vectors"][0] == "warning" and rows["all"][0] == "degraded"


def test_readiness_levels(spark):
    made = lambda rows: spark.createDataFrame(rows, "name string, enabled boolean, created_at timestamp, last_sync_at timestamp, poll int, last_error string")
    nothing = spark.createDataFrame([], "reason string, status string"), spark.createDataFrame([], "chunk_hash string"), spark.createDataFrame([], "chunk_hash string")
    day = [datetime(2024, 1, 1, 0, m) for m in range(2)]
    status = lambda rows: {r["check"]: r["status"] for r in upkeep.readiness(made(rows), *nothing, "2024-01-01 00:05:00").collect()}
    assert status([]) == {"sources": "error", "sync": "warning", "reviews": "ok", "vectors": "ok", "all": "blocked"}
    assert status([("a", True, day[0], day[1], 100, None), ("b", False, day[0], None, 1, "x")])["all"] == "ready"
    assert status([("a", True, day[0], None, 60, "")])["sync"] == "warning"  # never synced: from its creation
    assert status([("a", True, day[0], day[1], 100, "refused")])["all"] == "blocked"

"""Rules that no table query pins: validation, cursors, decisions, maintenance."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import filters, fusion, governance, lexical, maintain, reads, upkeep
from corpusloom.streaming import schedule


def test_validity_fields():
    assert governance.validity_fields({"effective_from": "2026-01-01", "effective_to": "2027-01-01"})["amended_by"] == []
    for bad in ({"x": 1}, {"effective_from": "2026"}, {"effective_from": "2026-01-02", "effective_to": "2026-01-02"}, {"effective_to": "2026-01-01"}, {"amended_by": "x"}, {"replaced_by": 5}):
        with pytest.raises(ValueError):
            governance.validity_fields(bad)


@pytest.mark.parametrize(("day", "status"), [("2025-12-31", "not_yet_effective"), ("2026-01-01", "valid"), ("2026-12-31", "valid"), ("2027-01-01", "expired")])
def test_status_on(spark, day, status):
    d = lambda s: F.lit(s).cast("date")
    assert spark.range(1).select(governance.status_on(d(day), d("2026-01-01"), d("2027-01-01")).alias("s")).first()["s"] == status


@pytest.mark.parametrize("text", ["", "x", "bm90IGpzb24=", reads.cursor("s", 1)[:-1], reads.cursor("s", 1) + "=", "WyJzIiwgdHJ1ZV0=", "WyJzIiwgIjEiXQ=="])
def test_bad_cursors(text):
    with pytest.raises(ValueError):
        reads.parse_cursor(text)


@pytest.mark.parametrize("limit", [1, 2, 3, 5, 13, 14])
def test_pages_leave_nothing_out(spark, limit):
    rows = spark.createDataFrame([(f"s{i % 3}", i) for i in range(14)], "source_id string, id long")
    seen, after = [], None
    while True:
        page, after = reads.page(rows, limit, after)
        seen += [tuple(r) for r in page.collect()]
        if after is None:
            break
    assert seen == sorted((f"s{i % 3}", i) for i in range(14))


def test_resolve_errors(spark):
    rows = spark.createDataFrame(
        [(1, "s", "n", "local", "a", None, None), (2, "t", "m", "local", "a", None, None), (3, "t", "m", "local", "b", None, "2026")],
        "id int, source_id string, source_name string, kind string, relative_path string, external_id string, trashed_at string",
    )
    assert reads.resolve(rows, "n:a").first()["id"] == 1
    for bad in ("a", "b", "zzz"):
        with pytest.raises(ValueError):
            reads.resolve(rows, bad)
    assert reads.resolve(rows, "m:b", include_trashed=True).first()["id"] == 3


@pytest.mark.parametrize("scope", ["/abs", "../x", "a/../b", "id:", ".", "/"])
def test_bad_scopes(scope):
    with pytest.raises(ValueError):
        filters.folder_scope(scope)


def test_ndcg_credits_each_gold_once(spark):
    questions = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x"]), (3, [])], "id int, gold array<string>")
    hits = spark.createDataFrame([(1, 1, "a-khoan-1"), (1, 2, "a"), (1, 3, "c"), (2, 11, "x")], "id int, rank int, cite_key string")
    got = {r["id"]: r for r in governance.judge(questions, hits, hits.select("cite_key")).collect()}
    ideal = 1 + 1 / 1.584962500721156 + 0.5
    assert got[1]["rank"] == 1 and got[1]["ndcg"] == pytest.approx((1 + 0.5) / ideal)
    assert got[2]["rank"] == 11 and got[2]["failure"] == "ranked_below_10" and got[3]["ndcg"] == 0


def test_prioritise_doc_no(spark):
    hits = spark.createDataFrame([(1, "c1", "D1", 1, 0.5, "content"), (1, "c2", "D2", 2, 0.4, "content")], "query_id int, row_id string, document string, rank int, score double, matched_via string")
    wanted = spark.createDataFrame([(1, f"w{i}", "D2", i, False) for i in range(5)], "query_id int, row_id string, document string, ordinal int, number_query boolean")
    up = fusion.prioritise(hits, wanted)
    assert [r["row_id"] for r in up.orderBy("place").collect()] == ["c2", "c1"]
    brought = fusion.prioritise(hits.filter("document = 'D1'"), wanted)
    assert [r["row_id"] for r in brought.orderBy("place").collect()] == ["w0", "w1", "w2", "c1"]


def test_classify_incomplete_listing_deletes_nothing(spark):
    kind = "path string, size long, modified long, hash string"
    known = spark.createDataFrame([("a", 1, 1, "h1"), ("b", 2, 1, "h2")], kind)
    listed = spark.createDataFrame([("a", 1, 1, "h1")], kind)
    act = lambda c: {r["path"]: r["action"] for r in maintain.classify(known, listed, known.select("hash"), c).collect()}
    assert act(True) == {"a": "unchanged", "b": "deleted"} and act(False) == {"a": "unchanged", "b": "kept"}


def test_sync_with_errors_keeps(spark):
    known = spark.createDataFrame([("d", "k", "p", ["root", "bin"], False)], "id string, content string, place string, ancestors array<string>, was_trashed boolean")
    listed = spark.createDataFrame([], "id string, content string, place string")
    trash = spark.createDataFrame([("bin",)], "id string")
    assert maintain.sync_decisions(known, listed, trash, True).first()["decision"] == "kept"
    assert maintain.sync_decisions(known, listed, trash, False).first()["decision"] == "trash"


def test_upsert_and_ids(spark):
    old = spark.createDataFrame([(1, "a"), (7, "b")], "id long, k string")
    new = maintain.assign_ids(old, spark.createDataFrame([("d",), ("c",)], "k string"), "k")
    assert [tuple(r) for r in new.select("id", "k").orderBy("id").collect()] == [(8, "c"), (9, "d")]
    assert sorted(tuple(r) for r in maintain.upsert(old, spark.createDataFrame([(7, "z")], "id long, k string"), ["id"]).collect()) == [(1, "a"), (7, "z")]


def test_phrase_stays_in_a_column(spark):
    rows = spark.createDataFrame([(1, "red apple", "pie"), (2, "pie red", "apple"), (3, "x", "y")], "id int, a string, b string")
    hits = lexical.phrase(lexical.token_rows(rows, "id", "a", "b"), ["red", "apple"])
    assert [r["row_id"] for r in hits.collect()] == [1]
    with pytest.raises(ValueError):
        lexical.pool(101)
    assert lexical.pool(2) == 20 and lexical.pool(2, 30) == 120


def test_shared_content(spark):
    docs = spark.createDataFrame([(1, "a", "h1"), (2, "b", "h2"), (3, None, "h3"), (4, "a", "h1"), (5, "b", "h5")], "id int, doc_no string, content_hash string")
    chunks = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "y"), (5, "x"), (5, "x")], "document int, body_hash string")
    got = {r["id"]: r["same_content"] for r in governance.shared_content(docs, chunks).collect()}
    assert got == {1: 2, 2: 3, 3: 2, 5: 3}
    assert {r["id"] for r in governance.shares_content(docs, chunks).collect()} == set(got)


def test_holders_of_short_passages(spark):
    """Passages of any number of words, as parts of words too; each is found where it is and nowhere else."""
    texts = [(1, "the quick brown fox jumps over the lazy dog"), (2, "a quick brown foxes jump"), (3, "quick"), (4, ""), (5, "over  the lazy")]
    passages = [(1, "quick brown fox jumps over the lazy"), (2, "quick brown fox"), (3, "uick"), (4, "ver the"), (5, "brown fox"), (6, "none of these words is there at all"), (7, "over  the lazy")]
    t, p = spark.createDataFrame(texts, "doc_id long, whole string"), spark.createDataFrame(passages, "item_id long, text string")
    want = {(i, d) for i, passage in passages for d, whole in texts if passage in whole}
    assert {tuple(r) for r in governance.holders(p, t).collect()} == want
    assert governance.holders(p.limit(0), t).count() == 0


def test_trash_and_sync(spark):
    """An item is in the trash by itself or a folder above it, unless it is listed; what a full scan decides."""
    frame = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    items = frame([("f1", ["root", "dir"], False), ("f2", ["root"], False), ("f3", ["root"], False), ("f4", ["dir"], True)], "id string, ancestors array<string>, listed boolean")
    assert {tuple(r) for r in maintain.trashed(items, frame([("dir",), ("f3",)], "id string")).collect()} == {("f1", True), ("f2", False), ("f3", True), ("f4", False)}
    known = frame([(i, k, p, a, w) for i, k, p, a, w in (("a", "k1", "p1", ["root"], False), ("b", "k2", "p2", ["root"], False), ("c", "k3", "p3", ["root"], False), ("d", "k4", "p4", ["root", "bin"], False), ("e", "k5", "p5", ["root"], False), ("g", "k7", "p7", ["root"], True))], "id string, content string, place string, ancestors array<string>, was_trashed boolean")
    listed = frame([("a", "k1", "p1"), ("b", "k2x", "p2"), ("c", "k3", "p3x"), ("f", "k6", "p6"), ("g", "k7", "p7")], "id string, content string, place string")
    decided = lambda errors: {tuple(r) for r in maintain.sync_decisions(known, listed, frame([("bin",)], "id string"), errors).collect()}
    assert decided(False) == {("a", "unchanged"), ("b", "index"), ("c", "metadata"), ("d", "trash"), ("e", "delete"), ("f", "index"), ("g", "restore")}
    assert {x for x in decided(True) if x[0] in "de"} == {("d", "kept"), ("e", "kept")}


def test_tree_with_loops(spark):
    """A loop of folders, an item in two of them, a folder in the trash and an item out of reach."""
    rows = [("a", "A", True, ["root"], False), ("b", "B", True, ["a"], False), ("c", "c.txt", False, ["b", "a"], False), ("d", "D", True, ["b", "e"], False), ("e", "E", True, ["d"], True), ("f", "f.txt", False, ["e"], False), ("x", "x.txt", False, ["lost"], False)]
    items = spark.createDataFrame(rows, "id string, name string, folder boolean, parents array<string>, trashed boolean")
    got = {(r["id"], r["path"], r["trashed"]) for r in upkeep.tree(items, "root").collect()}
    assert got == {("a", "A", False), ("b", "A/B", False), ("c", "A/c.txt", False), ("d", "A/B/D", False), ("e", "A/B/D/E", True), ("f", "A/B/D/E/f.txt", True)}


def test_display_segments(spark):
    names = [("a/b", "a%2Fb"), ("a%2Fb", "a%252Fb"), (".", "%2E"), ("..", "%2E%2E"), ("", "%EMPTY"), ("Hợp đồng 1.txt", "Hợp đồng 1.txt"), ("x\\y", "x%5Cy")]
    rows = spark.createDataFrame([(a,) for a, _ in names], "name string")
    assert {tuple(r) for r in rows.select("name", upkeep.display_segment(F.col("name"))).collect()} == set(names)


def test_refused_facts(spark):
    """A name of two documents names none; every kind of evidence that is refused."""
    docs = spark.createDataFrame(
        [(1, "notes", "a.txt", None, "local:s1:1"), (2, "drive", "a.md", "X9", "drive:X9"), (3, "notes", "sub/b.txt", None, "local:s1:3"), (4, "other", "a.txt", None, "local:s2:4")],
        "id int, source_name string, relative_path string, external_id string, stable_ref string",
    )
    e = lambda p, at, quote: (p, at, quote)
    facts = [
        (1, "sub/b.txt", [e("drive:X9", "page:1", "")]), (2, "notes:a.txt", [e("notes:a.txt", "", "as it says")]), (3, "a.txt", [e("X9", "page:1", "")]), (4, "X9", []),
        (5, "X9", [e("", "l", "")]), (6, "X9", [e("X9", "", "")]), (7, "X9", [e("none.txt", "l", "")]), (8, "none.txt", [e("X9", "l", "")]),
    ]
    rows = spark.createDataFrame(facts, "fact int, path string, evidence array<struct<path:string,locator:string,quote:string>>").select("*", F.lit("topic").alias("key"), F.lit("law").alias("value"))
    got = {r["fact"]: (r["document"], r["refused"]) for r in upkeep.judged_facts(docs, rows).collect()}
    assert got == {
        1: (3, None), 2: (1, None), 3: (None, "unknown document"), 4: (None, "evidence is required"), 5: (None, "evidence names no path"),
        6: (None, "evidence has no locator and no quote"), 7: (None, "evidence is of no document"), 8: (None, "unknown document"),
    }


def test_schedules(spark):
    """Sources that are due, the most overdue first; a job that joins another, and one that is refused."""
    at = lambda x: datetime.fromisoformat(f"2024-01-01 {x}") if x else None
    rows = [
        ("a", "local", None, "11:00:00", None, None, None), ("b", "local", None, "11:55:00", None, None, None), ("c", "google_drive", None, "11:59:00", None, None, None),
        ("d", "google_drive", None, "11:59:00", None, None, "11:58:00"), ("e", "local", 10, "11:58:30", "11:59:30", None, None), ("f", "google_drive", 300, "11:00:00", None, "09:00:00", None), ("g", "local", 60, None, None, None, None),
    ]
    made = spark.createDataFrame(
        [(n, k, p, at(s), at(j), at(f), at(t), at("00:00:00")) for n, k, p, s, j, f, t in rows],
        "source string, kind string, poll int, last_sync_at timestamp, last_job_at timestamp, last_full_at timestamp, last_full_try_at timestamp, created_at timestamp",
    )
    due = schedule.due(made, "2024-01-01 12:00:00", "2024-01-01 11:58:00")
    assert {(r["source"], r["work"]) for r in due.collect()} == {("a", "incremental"), ("c", "full"), ("f", "incremental"), ("g", "incremental")}
    assert tuple(schedule.next_source(due).first()) == ("a", "incremental")
    jobs = "id int, kind string, source string, target string, reextract boolean, full boolean"
    active = spark.createDataFrame([(0, "reconcile", "s", None, False, False, "running")], jobs + ", state string")
    wanted = spark.createDataFrame([(1, "reconcile", "s", None, False, False), (2, "reconcile", "s", None, False, True)], jobs)
    assert {tuple(r) for r in schedule.admit(active, wanted).collect()} == {(1, "coalesced"), (2, "rejected")}
    assert {r["outcome"] for r in schedule.admit(active.limit(0), wanted).collect()} == {"queued"}

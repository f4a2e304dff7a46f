"""Catalogue queries against their SQL over small tables with rows that the smallest given tables lack."""

import datetime as dt
import time

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from corpusloom.functions.batches import ROWS, pieces
from corpusloom.operators import lexical, semantic
from corpusloom.plans import catalogue


@pytest.fixture
def same(spark, tmp_path):
    """Writes tables and checks a query against its SQL; gives its rows, sorted."""

    def check(name, **tables):
        con = duckdb.connect()
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        df = catalogue.QUERIES[name](spark, str(tmp_path))
        got = sorted(map(repr, map(tuple, df.collect())))
        assert got == sorted(map(repr, con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.SQL[name]})").fetchall()))
        return df.collect()

    return check


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
IDS = (7, 8, 998, 999, 1000, 1001, 51281, 1234567, 1234568)


def laws():
    day = dt.date(1995, 1, 1)
    return {
        "documents": ([(i, f"text {i % 4}", "en", "s", 6) for i in IDS], DOCUMENTS),
        "orders": ([(i, day, "F") for i in IDS], "o_orderkey long, o_orderdate date, o_orderstatus string"),
        "labels": ([(8, 0, 0), (1000, 1, 0)], "doc_id long, quality int, toxic int"),
    }


def test_warnings_of_long_serials(same):
    rows = same("doc_warnings", **laws())
    assert {r["id"] for r in rows if "CITES_EXPIRED" in r["warnings"]} == {7, 998, 999, 1000, 1234567}


def test_citations_of_long_serials(same):
    rows = same("expired_citations", **laws())
    assert {r["cited"] for r in rows} == {f"{i}/2020/NĐ-CP" for i in (8, 999, 1000, 1001, 1234568)}


def test_numbers_of_long_serials(same):
    rows = same("number_extract", documents=laws()["documents"])
    assert {r["numbers"] for r in rows} == {f"{i}/2026/NĐ-CP;01/TT-BTC" for i in IDS}


def test_titles_with_open_references(same):
    titles = ["a&amp;&amp", "&lt;b&gt &quot", "AT&T &", "&amp;amp &am", "&amp;lt;", None]
    pages = [(i, "u", t and f"<html><head><title>{t}</title></head><body>x</body></html>") for i, t in enumerate(titles)]
    rows = same("html_titles", pages=(pages, "page_id long, url string, html string"))
    assert {r["page_id"]: r["raw_title"] for r in rows} == {0: "a&&amp", 1: "<b&gt &quot", 2: "AT&T &", 3: "&amp &am", 4: "&lt;", 5: ""}


def test_every_place_of_a_body(same):
    rows = same("duplicate_locations", documents=([(i, "copy" if i % 3 else "other", "en", "s", 4) for i in range(90)] + [(90, "single", "en", "s", 6)], DOCUMENTS))
    assert sorted(len(r["locations"].split(",")) for r in rows) == [1, 30, 60] and all(r["n"] == len(r["locations"].split(",")) for r in rows)


def test_csv_files_beyond_the_row_limit(spark, tmp_path):
    """More customers of a nation than one file may have rows."""
    n = 200_005
    spark.range(n).selectExpr("id + 1 as c_custkey", "concat('C', id) as c_name", "cast(id div 200004 as int) as c_nationkey", "'M' as c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    rows = {(r["nation"], r["locator"]): r["text"] for r in catalogue.QUERIES["extract_csv_rows"](spark, str(tmp_path)).collect()}
    assert len(rows) == n and rows[0, "row:2"] == "custkey: 1; name: C0; segment: M" and rows[0, "row:200005"] == "custkey: 200004; name: C200003; segment: M" and rows[1, "row:2"].startswith("custkey: 200005;")


def test_index_of_a_long_text(spark, tmp_path):
    """Time of a row goes with its words, not with words times terms; rows without words count too."""
    long = " ".join(f"w{i % 9000} x" for i in range(60_000))
    texts = [("a", [long, "w1 x Straße"]), ("b", ["", ""]), ("c", [None, "x w1 x w1"])]
    rows = spark.createDataFrame([(i, *t) for i, t in texts], "id string, t string, u string")
    tokens = lexical.token_rows(rows, "id", "t", "u")
    began = time.time()
    index = lexical.Inverted.write(f"{tmp_path}/index", tokens)
    got = {(r["term"], r["row_id"]): (r["dl"], r["tf"], r["positions"]) for r in index.postings.collect()}
    assert time.time() - began < 60
    want = {}
    for i, columns in texts:
        at, words = 0, []
        for c in columns:
            words += [(at + n, w) for n, w in enumerate((c or "").lower().split())]
            at += len((c or "").split()) + 1
        for place, w in words:
            want.setdefault((w, i), (len(words), []))[1].append(place)
    assert got == {k: (dl, len(p), p) for k, (dl, p) in want.items()}
    assert tuple(index.stats.first()) == (3, (120_003 + 0 + 4) / 3)
    asked = spark.createDataFrame([(1, "w1 x w1"), (2, "x w1"), (3, "w1 straße")], "query_id int, text string")
    hits = lexical.phrase_postings(index, asked).select("query_id", "row_id").collect()
    assert {tuple(r) for r in hits} == {(1, "c"), (2, "a"), (2, "c")}


def test_pieces_of_batches():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["x"])
    found = list(pieces([batch, batch.slice(0, 0), batch.slice(0, 3)]))
    assert max(map(len, found)) == ROWS and [x for b in found for x in b.column(0).to_pylist()] == [*range(1000), 0, 1, 2]


def test_a_task_keeps_the_best_rows_of_a_question(spark):
    """However many batches and tiles it has, and however many rows tie."""
    rows = spark.range(0, 25_000, 1, 1).selectExpr("id AS vec_id", "array(cast(id % 3 AS float), 1.0f) AS embedding")
    asked = [(i, [1.0, i / 700]) for i in range(700)]
    kept = semantic._products(rows, asked, T.LongType(), 5, 6, "query_id long, vec_id long, score double")
    assert kept.count() == 5 * len(asked)
    found = semantic.nearest(rows, spark.createDataFrame(asked[:1] + asked[-1:], "query_id long, query array<double>"), 5).collect()
    assert {(r["query_id"], r["vec_id"]) for r in found} == {(0, 2 + 3 * i) for i in range(5)} | {(699, 1 + 3 * i) for i in range(5)}

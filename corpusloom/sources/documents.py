"""Files to documents: scan, extract, assemble text with spans, chunk, key."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.sources.formats import Backend, Limits, read_file

EXTRACTED = (
    "path string, content_hash string, size long, modified_us long, media_type string, text string, "
    "spans array<struct<kind:string,locator:string,start:int,stop:int>>, metadata map<string,string>, reviews array<string>, error string"
)
COLUMNS = re.findall(r"(?:^|, )(\w+) ", EXTRACTED)


#: Files whose contents are asked for by name; more are read by going through the whole root.
NAMED = 10_000


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Every file below a root: path, size, modified_us, content (read only if it is used)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified_us"), "content")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, size, modified_us of every file below a root; no file is read."""
    return scan(spark, root).drop("content")


def contents(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` files (path, size, modified_us and others) with their content; few are opened by name, so no other file is read."""
    few = [r["path"] for r in wanted.select("path").limit(NAMED + 1).collect()]
    if not few:
        return wanted.withColumn("content", F.lit(None).cast("binary"))
    if len(few) > NAMED:
        return wanted.join(scan(spark, root).select("path", "content"), "path")
    named = spark.read.format("binaryFile").load([re.sub(r"([\\{}\[\]*?,])", r"\\\1", p) for p in few]).select("path", "content")
    return wanted.join(named, "path")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def hashed(files: DataFrame) -> DataFrame:
    """Files with content_hash and suffix, which together name an extraction."""
    return files.withColumns({"content_hash": F.sha2("content", 256), "suffix": suffix(F.col("path"))})


#: Extractions, and their characters, that go on together.
TOGETHER, TOGETHER_CHARS = 256, 4 << 20


def extract(files: DataFrame, backend: Backend | None = None, limits: Limits = Limits()) -> DataFrame:
    """Extractions of files (path, size, modified_us, content and, where it is known, content_hash)."""
    todo = files if "content_hash" in files.columns else hashed(files)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            rows, size = [], 0
            for f in files.itertuples(index=False):
                row = read_file(f.path, bytes(f.content), backend, limits)
                row |= joined(row["parts"]) | {"content_hash": f.content_hash, "size": f.size, "modified_us": f.modified_us}
                rows.append(row)
                size += len(row["text"]) + 100 * len(row["parts"])
                del row["parts"]
                if len(rows) == TOGETHER or size > TOGETHER_CHARS:
                    yield pd.DataFrame(rows)[COLUMNS]
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows)[COLUMNS]

    return todo.select("path", "content_hash", "size", "modified_us", "content").mapInPandas(run, EXTRACTED)


def reuse(files: DataFrame, cached: DataFrame) -> DataFrame:
    """The extraction of every file (with content_hash and suffix), from extractions of whatever file had its content and suffix."""
    own = cached.withColumn("suffix", suffix(F.col("path"))).drop("path", "size", "modified_us").dropDuplicates(["content_hash", "suffix"])
    return files.select("path", "size", "modified_us", "content_hash", "suffix").join(own, ["content_hash", "suffix"]).select(*COLUMNS)


def parts(extracted: DataFrame) -> DataFrame:
    """path, kind, locator, text of every span; the time goes with a text's length, not with length times spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                spans = b.column(2).slice(i, 1).flatten()
                if not len(spans):
                    continue
                text, (kind, locator, start, stop) = b.column(1)[i].as_py(), spans.flatten()
                found = pa.array([text[x:y] for x, y in zip(start.to_pylist(), stop.to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays([pa.repeat(b.column(0)[i], len(spans)), kind, locator, found], names=["path", "kind", "locator", "text"])

    return extracted.select("path", "text", "spans").mapInArrow(run, "path string, kind string, locator string, text string")


def joined(parts: list[dict]) -> dict:
    """Text of parts parted by blank lines, and the code-point span of each."""
    spans, at = [], 0
    for p in parts:
        spans.append({"kind": p["kind"], "locator": p["locator"], "start": at, "stop": at + len(p["text"])})
        at += len(p["text"]) + 2
    return {"text": "\n\n".join(p["text"] for p in parts), "spans": spans}


def spans_of(rows: DataFrame, by: list[str], order: str, text_col: str, kind: str) -> DataFrame:
    """by, spans: rows of text as the parts of one document for each ``by``, joined by blank lines."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text_col) + 2).over(before), F.lit(0)).cast("int")
    placed = rows.withColumn("start", start)
    span = F.struct(
        "start", (F.col("start") + F.length(text_col)).alias("stop"), F.lit(kind).alias("kind"), F.concat(F.lit(kind + ":"), F.col(order).cast("string")).alias("locator")
    )
    return placed.groupBy(*by).agg(F.array_sort(F.collect_list(span)).alias("spans"))


def documents(extracted: DataFrame) -> DataFrame:
    """Extractions with title and word count; failed files keep only their error."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    first = F.regexp_replace(T.first_line(F.col("text")), r"^[# ]+|[# ]+$", "")
    title = F.when(F.rlike("path", F.lit(r"(?i)\.(md|markdown)$")) & (first != ""), F.substring(first, 1, 160)).otherwise(stem)
    return extracted.withColumns({"title": F.coalesce(F.col("metadata")["title"], title), "word_count": T.words(F.col("text")), "source_positions": F.size("spans")})


def overlapping(spans: Column, start: Column, stop: Column) -> Column:
    """Spans that share a character with [start, stop)."""
    return F.filter(spans, lambda s: (s["stop"] > start) & (s["start"] < stop))


def window_chunks(docs: DataFrame, id_col: str, text_col: str = "text", context: Column | None = None, size: int = 1200, overlap: int = 150) -> DataFrame:
    """id, ordinal, start, stop, body_hash, chunk_hash, text of every window of every document."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("whole"), (context if context is not None else F.lit("")).alias("context"))
    rows = rows.withColumn("w", F.explode(T.windows(F.col("whole"), size, overlap)))
    body = F.expr("substring(whole, w.start + 1, w.stop - w.start)")
    stored = T.stored_text(F.col("context"), body)
    return rows.select(id_col, "w.ordinal", "w.start", "w.stop", F.sha2(body, 256).alias("body_hash"), F.sha2(stored, 256).alias("chunk_hash"), stored.alias("text"))


def pages(spans: Column) -> Column:
    """Struct (first, last, only) of the PDF pages among spans."""
    numbers = F.transform(
        F.filter(spans, lambda s: (s["kind"] == "pdf_page") & F.startswith(s["locator"], F.lit("page:"))), lambda s: F.substring(s["locator"], 6, 9).cast("int")
    )
    return F.struct(
        F.array_min(numbers).alias("first"), F.array_max(numbers).alias("last"),
        F.when(F.size(F.array_distinct(numbers)) == 1, F.get(numbers, 0)).alias("only"),
    )

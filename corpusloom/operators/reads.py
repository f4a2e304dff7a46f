"""Point reads and listings: resolve, slice, neighbours, pages, metadata, counts."""

from __future__ import annotations

import base64
import binascii
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.documents import overlapping

READ_LIMIT = 40_000


def resolve(documents: DataFrame, reference: str, include_trashed: bool = False) -> DataFrame:
    """The one document that a stable reference, ``source:path``, path or external id names; none or several is an error.

    ``documents``: id, source_id, source_name, kind, relative_path, external_id, trashed_at.
    """
    c = F.col
    stable = F.when(c("kind") == "google_drive", F.concat(F.lit("drive:"), "external_id")).otherwise(F.concat_ws(":", F.lit("local"), "source_id", c("id").cast("string")))
    names = [stable, F.concat_ws(":", "source_name", "relative_path"), c("relative_path"), c("external_id")]
    fits = documents.withColumn("how", F.coalesce(*[F.when(n == reference, F.lit(i)) for i, n in enumerate(names)])).filter("how is not null")
    best = fits.filter(c("how") == (fits.agg(F.min("how")).first()[0] or 0))
    rows = best.limit(2).collect()  # two at most
    if not rows:
        raise ValueError(f"unknown document: {reference}")
    if len(rows) > 1:
        raise ValueError(f"ambiguous document: {reference}")
    if rows[0]["trashed_at"] is not None and not include_trashed:
        raise ValueError(f"document is in the trash: {reference}")
    return best.drop("how")


def slice_bounds(length: Column, start: int = 0, size: int = READ_LIMIT, around: int | None = None, window: int = 4000) -> tuple[Column, Column]:
    """Code-point range of a read, by start and size or centred on a place, kept inside the text."""
    if not 1 <= size <= READ_LIMIT or not 1 <= window <= READ_LIMIT or start < 0:
        raise ValueError(f"start must not be negative and sizes must be 1 to {READ_LIMIT}")
    if around is not None:
        start, size = max(0, around - window // 2), window
    begin = F.least(F.lit(start), length)
    return begin, F.least(begin + size, length)


def read(documents: DataFrame, keep: list[str], text_col: str = "text", spans_col: str | None = None, **bounds) -> DataFrame:
    """keep, start, stop, next_start (null at the end), text and the spans it touches."""
    begin, end = slice_bounds(F.length(text_col), **bounds)
    out = documents.withColumns({"start": begin, "stop": end})
    spans = [overlapping(F.col(spans_col), F.col("start"), F.col("stop")).alias("spans")] if spans_col else []
    piece = F.expr(f"substring({text_col}, start + 1, stop - start)").alias("text")
    return out.select(*keep, "start", "stop", F.when(F.col("stop") < F.length(text_col), F.col("stop")).alias("next_start"), piece, *spans)


def neighbours(chunks: DataFrame, wanted: DataFrame, around: int = 1) -> DataFrame:
    """Chunks at most ``around`` (0 to 3) ordinals from a wanted one. Both: document, ordinal."""
    if not 0 <= around <= 3:
        raise ValueError("neighbors must be 0 to 3")
    near = wanted.select("document", F.col("ordinal").alias("centre")).withColumn("ordinal", F.explode(F.sequence(F.col("centre") - around, F.col("centre") + around)))
    return chunks.join(near, ["document", "ordinal"])


def cursor(source: str, document_id: int) -> str:
    return base64.urlsafe_b64encode(json.dumps([source, document_id]).encode()).decode()


def parse_cursor(text: str) -> tuple[str, int]:
    """Strict: anything but what :func:`cursor` writes is an error."""
    try:
        value = json.loads(base64.b64decode(text.encode(), altchars=b"-_", validate=True))
    except (binascii.Error, ValueError) as e:
        raise ValueError("bad cursor") from e
    if not (isinstance(value, list) and len(value) == 2 and isinstance(value[0], str) and type(value[1]) is int) or cursor(*value) != text:
        raise ValueError("bad cursor")
    return value[0], value[1]


def page(documents: DataFrame, limit: int, after: str | None = None) -> tuple[DataFrame, str | None]:
    """One page in the order (source_id, id) and the cursor of the next."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    rows = documents
    if after:
        source, last = parse_cursor(after)
        rows = rows.filter((F.col("source_id") > source) | ((F.col("source_id") == source) & (F.col("id") > last)))
    ordered = rows.orderBy("source_id", "id")
    probe = ordered.select("source_id", "id").limit(limit + 1).collect()
    more = len(probe) > limit
    return ordered.limit(limit), cursor(*probe[limit - 1]) if more else None


def offset_page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    if offset < 0 or not 1 <= limit <= 100:
        raise ValueError("offset must not be negative and limit must be 1 to 100")
    return rows.orderBy(*order).offset(offset).limit(limit)


def with_chunk_counts(documents: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    counts = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("chunk_count"))
    return documents.join(counts, key, "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def related(documents: DataFrame, edges: DataFrame) -> DataFrame:
    """document, relation, other, direction for both ends of every edge (source, target, relation)."""
    named = lambda p: documents.select(F.col("id").alias(p), F.col("relative_path").alias(f"{p}_path"))
    both = edges.join(named("source"), "source").join(named("target"), "target")
    out = both.select(F.col("source").alias("document"), "relation", F.col("target_path").alias("other"), F.lit("out").alias("direction"))
    return out.unionByName(both.select(F.col("target").alias("document"), "relation", F.col("source_path").alias("other"), F.lit("in").alias("direction")))


def metadata_entries(documents: DataFrame, agent: DataFrame, edges: DataFrame) -> DataFrame:
    """document, kind, content: what the metadata index holds of each document."""
    automatic = documents.select(F.col("id").alias("document"), F.lit("automatic").alias("kind"), F.concat_ws(" ", "title", "metadata").alias("content"))
    added = agent.select("document", F.lit("agent_metadata").alias("kind"), F.concat_ws(" ", "key", "value").alias("content"))
    named = lambda p: documents.select(F.col("id").alias(p), F.col("relative_path").alias(f"{p}_path"))
    both = edges.join(named("source"), "source").join(named("target"), "target").withColumn("content", F.concat_ws(" ", "relation", "source_path", "target_path"))
    ends = both.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("document"), F.lit("relationship").alias("kind"), "content")
    return automatic.unionByName(added).unionByName(ends)


def newest_first(jobs: DataFrame, limit: int) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def latest_by(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of the last row of each key."""
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, "last.*")


def nth(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))

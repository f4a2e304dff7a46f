"""A drive kept as an index: its whole listing, then its change feed; one batch is one version, or none.

``follow`` gives the function for ``foreachBatch``. A batch changes the source's items (files and folders, kept as a
table beside the index), walks the folder tree anew, fetches in tasks what changed, and commits documents, tombstones,
items and the feed's cursor with one manifest. The manifest's cursor is the last page applied: a batch that
is replayed after it finds no page left, one that failed before it leaves nothing behind, so every change counts once
whatever Spark's own checkpoint says. A file that moved or was renamed (or a folder above it) keeps its document
and its extraction; the trash hides a document and restoring shows it again without reading it.

``rescan`` applies a whole listing (:mod:`corpusloom.sources.drive`) in the same way: items that it does not name are gone, the
cursor is that from before the walk, and only items of another version than the known one are read. A listing with a folder that
could not be listed removes nothing and leaves the cursor where it was; the source counts as incompletely listed, and
``follow`` lists it again before the next batch.

With a :class:`~corpusloom.sources.raw.RawStore` the bytes are kept: a file that gets another suffix is extracted anew from them.

Edge cases: of several changes of an item in a batch the one of the last page counts; fields that a change lacks stay
as they were; a change without a version may be one of the content, so its item is read; what changes in the trash is read when it leaves it; an item out of reach of the
root is gone; an item that cannot be fetched keeps its last good document, is named in :meth:`Index.failures` and tried again when
it is named or listed; an error that is not the item's own fails the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.engine import Index
from corpusloom.operators import upkeep
from corpusloom.sources import documents as D
from corpusloom.sources.drive import FOLDER, ITEMS, Drive, ItemError, walk
from corpusloom.sources.formats import Backend
from corpusloom.sources.raw import RawStore

#: Names of an item's fields that a change may lack.
FIELDS = ("kind", "trashed", "name", "parents", "version")
NAMED = "id string, version string"

class Store(Protocol):
    """Gives an item's bytes; raises :class:`ItemError` if only this item cannot be had."""

    def content(self, item: str) -> bytes: ...


class Folder:
    """Items' bytes as files of a folder that all tasks see, named by their ids."""

    def __init__(self, path: str):
        self.path = path

    def content(self, item: str) -> bytes:
        try:
            return (Path(self.path) / item).read_bytes()
        except FileNotFoundError as e:
            raise ItemError("notFound") from e


def merged(items: DataFrame, changes: DataFrame) -> DataFrame:
    """The items after some changes (page and the fields of an item, ``removed``)."""
    last = changes.groupBy("id").agg(F.max_by(F.struct("removed", *FIELDS), "page").alias("c"))
    both = items.withColumn("known", F.lit(True)).join(last, "id", "full_outer").filter("not coalesce(c.removed, false)")
    return both.select("id", *[F.coalesce(F.col(f"c.{f}"), F.col(f)).alias(f) for f in FIELDS]).withColumn("trashed", F.coalesce("trashed", F.lit(False)))


def fetched(wanted: DataFrame, store: Store) -> DataFrame:
    """``wanted`` (id) with content, or with error if the item cannot be had; read in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item in b.column(0).to_pylist():
                content = error = None
                try:
                    content = store.content(item)
                except ItemError as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([item]), pa.array([content], pa.binary()), pa.array([error], pa.string())], names=["id", "content", "error"])

    tasks = wanted.sparkSession.sparkContext.defaultParallelism
    return wanted.select("id").repartition(tasks, "id").mapInArrow(run, "id string, content binary, error string")


def _items(index: Index, source_id: str) -> DataFrame:
    """The items of a source as the newest version has them."""
    m, key = index.manifest, f"items-{source_id}"
    return index.spark.read.schema(ITEMS).parquet(index.segments.path(m.whole[key], key)) if key in m.whole else index.spark.createDataFrame([], ITEMS)


def listing_complete(index: Index, source_id: str) -> bool | None:
    """Whether the source's last listing was whole; none before the first."""
    if not index.manifest.latest:
        return None
    row = index._latest("sources").filter(F.col("source_id") == source_id).select("listing_complete").first()
    return row and row[0]


def apply(
    index: Index, changes: DataFrame, source_id: str, source_name: str, root: str, store: Store, backend: Backend | None = None, raw: RawStore | None = None
) -> bool:
    """Apply a batch of changes; False if its pages were applied before."""
    index.refresh()
    fresh_pages = changes.filter(F.col("page") > index.manifest.cursors.get(source_id, 0))
    stop = fresh_pages.agg(F.max("page")).first()[0]
    if stop is None:
        return False
    n = index.segments.begin(index.manifest)
    changes = index._write(n, "changes", fresh_pages)
    # The last word on an item; one without a version may be of its content.
    last = changes.groupBy("id").agg(F.max_by(F.struct("removed", "trashed", "version"), "page").alias("c"))
    named = last.filter("not coalesce(c.removed, false) and not coalesce(c.trashed, false)").select("id", "c.version")
    told = index.failures().filter((F.col("source_id") == source_id) & (F.col("stage") == "listing")) if index.manifest.latest else None
    complete = listing_complete(index, source_id)
    _commit(index, n, merged(_items(index, source_id), changes), named, changes.select("id").distinct(), told, source_id, source_name, root, store, backend, raw, stop, complete is not False)
    return True


def rescan(
    index: Index, drive: Drive, source_id: str, source_name: str, root: str, store: Store, backend: Backend | None = None, raw: RawStore | None = None, now: str | None = None
) -> bool:
    """Apply the whole listing of a drive; whether it was complete. Then bytes that no document has any more go too, from ``now`` on."""
    index.refresh()
    spark, cursor = index.spark, index.manifest.cursors.get(source_id, 0)
    walked = walk(spark, drive, root)
    n = index.segments.begin(index.manifest)
    seen = index._write(n, "listing", walked.items)
    complete = walked.failed.isEmpty()
    items, before = seen, _items(index, source_id)
    told = None
    if not complete:
        items = seen.unionByName(before.join(seen.select("id"), "id", "left_anti"))
        paths = upkeep.tree(_shape(items, root), root).select(F.col("id").alias("folder"), F.col("path"))
        told = walked.failed.join(paths, "folder", "left").select(
            F.lit(source_id).alias("source_id"), F.coalesce("path", F.lit("")).alias("path"), F.lit("partial").alias("status"), F.lit("listing").alias("stage"), "error"
        )
    stop = max(cursor, walked.cursor) if complete else cursor
    _commit(index, n, items, seen.filter("not trashed").select("id", "version"), seen.select("id"), told, source_id, source_name, root, store, backend, raw, stop, complete)
    if raw is not None and complete:
        at = now or spark.sql("SELECT cast(current_timestamp() AS string)").first()[0]
        raw.clean(index.documents.select("content_hash"), at, complete)
    return complete


def _shape(items: DataFrame, root: str) -> DataFrame:
    return items.select("id", F.coalesce("name", "id").alias("name"), (F.col("kind") == FOLDER).alias("folder"), F.coalesce("parents", F.array(F.lit(root))).alias("parents"), "trashed")


def _commit(
    index: Index, n: int, after: DataFrame, named: DataFrame, touched: DataFrame, told: DataFrame | None, source_id: str, source_name: str, root: str,
    store: Store, backend: Backend | None, raw: RawStore | None, cursor: int, complete: bool,
) -> None:
    """Commit the items of a source as they are ``after`` a batch.

    ``named`` (id, version): items whose content may be another; ``touched`` (id): those whose earlier failures no longer
    count; ``told``: failures of the listing.
    """
    spark, m = index.spark, index.manifest
    key, later = f"items-{source_id}", f"unread-{source_id}"
    before = _items(index, source_id)
    unread = spark.read.parquet(index.segments.path(m.whole[later], later)) if later in m.whole else spark.createDataFrame([], "item string")
    items = index._write(n, key, after)
    placed = upkeep.tree(_shape(items, root), root).join(items.filter(F.col("kind") != FOLDER).select("id", "name"), "id")
    placed = index._write(n, "placed", placed.select(F.col("id").alias("item"), "name", F.col("path").alias("relative_path"), "ancestors", F.col("trashed").alias("in_trash")))
    own = index.documents.filter(F.col("source_id") == source_id)
    known = own.select(F.col("external_id").alias("item"), "id", F.col("content_hash").alias("old_hash"), F.col("relative_path").alias("old_path"), F.col("trashed_at").isNotNull().alias("was_in_trash"), F.col("ancestors").alias("old_ancestors"))
    suffix = D.suffix(F.col("name"))
    cached = index._extractions()
    extracted = cached.select("content_hash", D.suffix(F.col("path")).alias("suffix")).distinct()
    failed = index.failures().filter((F.col("source_id") == source_id) & (F.col("stage") == "extract")).select(F.col("path").alias("relative_path")) if m.latest else None
    # Bytes are read for new items, and for named ones of another version (or without one) and those that failed before.
    unknown = placed.join(known, "item", "left_anti").select("item")
    other = named.join(before.select("id", F.col("version").alias("old_version")), "id", "left").filter("version is null or old_version is null or version <> old_version").select(F.col("id").alias("item"))
    wanted = unknown.unionByName(other).unionByName(unread)
    if failed is not None:
        again = placed.join(failed, "relative_path", "left_semi").select("item")
        wanted = wanted.unionByName(again.join(named.select(F.col("id").alias("item")), "item", "left_semi"))
    due = index._write(n, "due", placed.select("item", "in_trash").join(wanted.distinct(), "item", "left_semi"))
    wanted = due.filter("not in_trash").select("item")
    index._write(n, later, due.filter("in_trash").select("item"))  # they are read when they leave the trash
    # Known bytes under a suffix that none were extracted by: those that are kept, else fetched.
    renamed = placed.filter("not in_trash").join(wanted, "item", "left_anti").join(known, "item").filter(F.col("relative_path") != F.col("old_path"))
    renamed = renamed.select("item", F.col("old_hash").alias("content_hash"), suffix.alias("suffix")).join(extracted, ["content_hash", "suffix"], "left_anti")
    renamed = index._write(n, "renamed", renamed.select("item", "content_hash"))
    held = renamed.join(raw.get(renamed), "content_hash") if raw is not None else renamed.withColumn("content", F.lit(None).cast("binary")).limit(0)
    held = index._write(n, "held", held.select(F.col("item").alias("id"), "content", F.lit(None).cast("string").alias("error")))
    asked = wanted.unionByName(renamed.select("item")).withColumnRenamed("item", "id").join(held.select("id"), "id", "left_anti")
    files = fetched(asked, store)
    files = index._write(n, "hashed", files.unionByName(held).withColumn("content_hash", F.sha2("content", 256)))
    if raw is not None:
        raw.put(files)
    both = placed.join(files.select(F.col("id").alias("item"), F.col("content_hash").alias("new_hash"), "error"), "item", "left").join(known, "item", "left")
    both = index._write(n, "items-seen", both.withColumn("content_hash", F.coalesce("new_hash", "old_hash")))
    remade = (F.col("content_hash") != F.coalesce("old_hash", F.lit(""))) | (F.col("relative_path") != F.coalesce("old_path", F.lit("")))
    todo = both.filter(remade & F.col("error").isNull() & F.col("content_hash").isNotNull() & ~F.col("in_trash"))
    # What no build has extracted yet.
    lacking = todo.select("item", "content_hash", suffix.alias("suffix")).join(extracted, ["content_hash", "suffix"], "left_anti")
    paths = placed.select("item", F.col("name").alias("path"))
    zero = F.lit(0).cast("long").alias("modified_us")
    bytes_of = files.join(lacking.select(F.col("item").alias("id")), "id", "left_semi").join(paths.withColumnRenamed("item", "id"), "id")
    new = D.extract(bytes_of.select("path", "content_hash", F.octet_length("content").cast("long").alias("size"), zero, "content"), backend, index.settings.limits)
    cached = cached.unionByName(index._extracted(n, new))
    asked = todo.select("item", F.col("name").alias("path"), "content_hash", suffix.alias("suffix"), F.lit(0).cast("long").alias("size"), zero)
    texts = D.documents(D.reuse(asked.select("path", "content_hash", "suffix", "size", "modified_us").distinct(), cached))
    at = todo.select("item", F.col("name").alias("path"), "content_hash", "relative_path", "ancestors", "in_trash")
    found = index._write(n, "found", texts.join(at, ["path", "content_hash"]))
    bad = found.filter("error is not null").select("item", "relative_path", "error").unionByName(both.filter("error is not null").select("item", "relative_path", "error"))
    ids = known.select("item", "id")
    made = index._drive_documents(found.filter("error is null"), ids, source_id, source_name)
    fresh = index._write(n, "fresh", index._corrected(made, index._corrections()))
    gone_items = known.join(placed, "item", "left_anti").select("id").unionByName(fresh.join(known.select("id"), "id", "left_semi").select("id"))
    gone = index._write(n, "gone", gone_items.select(F.col("id").alias("document")))
    moved = both.filter(F.col("id").isNotNull()).join(gone.withColumnRenamed("document", "id"), "id", "left_anti").filter("in_trash <> was_in_trash or ancestors <> old_ancestors")
    moved = own.join(moved.select("id", "in_trash", F.col("ancestors").alias("new_ancestors")), "id")
    moved = moved.withColumns({"trashed_at": F.when(F.col("in_trash"), F.coalesce("trashed_at", F.current_timestamp())), "ancestors": F.col("new_ancestors")}).select(*own.columns)
    status = F.when(F.col("id").isNotNull(), "stale").otherwise("unindexed").alias("status")
    gaps = bad.join(ids, "item", "left").select(F.lit(source_id).alias("source_id"), F.col("relative_path").alias("path"), status, F.lit("extract").alias("stage"), "error")
    # Failures of earlier batches stay until their item comes again or goes.
    if m.latest:
        quiet = placed.join(touched.select(F.col("id").alias("item")), "item", "left_anti").select(F.col("relative_path").alias("path"))
        gaps = gaps.unionByName(index.failures().filter((F.col("source_id") == source_id) & (F.col("stage") == "extract")).join(quiet, "path", "left_semi").select(*gaps.columns))
    if told is not None:
        gaps = gaps.unionByName(told.select(*gaps.columns))
    decision = (
        F.when(F.col("error").isNotNull(), "failed").when(F.col("id").isNull(), "index").when(F.col("in_trash") & ~F.col("was_in_trash"), "trash")
        .when(~F.col("in_trash") & F.col("was_in_trash"), "restore").when(F.col("content_hash") != F.col("old_hash"), "index").when(F.col("relative_path") != F.col("old_path"), "move").otherwise("unchanged")
    )
    deleted = known.join(placed, "item", "left_anti").select(F.col("old_path").alias("relative_path"), F.lit("delete").alias("action"))
    index._write(n, "actions", both.select("relative_path", decision.alias("action")).unionByName(deleted))
    index._finish(n, source_id, source_name, own, fresh, gone, moved, gaps, cursors={source_id: cursor}, whole={key: n, later: n}, complete=complete)


def follow(
    index: Index, source_id: str, source_name: str, root: str, store: Store, backend: Backend | None = None, raw: RawStore | None = None, drive: Drive | None = None
) -> Callable[[DataFrame, int], None]:
    """The function for ``writeStream.foreachBatch`` that keeps an index up with a feed; with a ``drive``, sources not yet listed whole are listed first."""

    def batch(changes: DataFrame, number: int) -> None:
        index.refresh()
        if drive is not None and not listing_complete(index, source_id):
            rescan(index, drive, source_id, source_name, root, store, backend, raw)
        apply(index, changes, source_id, source_name, root, store, backend, raw)

    return batch

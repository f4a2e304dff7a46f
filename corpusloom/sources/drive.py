"""The whole listing of a drive: a walk through its folders, whose pages are read in tasks.

The feed's cursor is taken before the walk, so what changes during it comes again with the feed. Each pass lists the
folders of one level, a task follows the page tokens of its folders, and the folders found there that no pass has
listed are the next level; the driver holds the number of the levels only.

Edge cases: a folder below itself is listed once; an item met below several folders is one item with all of them as
parents; trashed folders are walked too, so what is below them stays known; a folder of which a page
cannot be had keeps the pages before it and is named in ``failed``; an error that is not the item's own fails the walk.
A folder's pages follow one another, so one folder is one task's, page by page.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.shared import stored

FOLDER = "folder"
ITEMS = "id string, kind string, trashed boolean, name string, parents array<string>, version string"
LISTED = "folder string, id string, kind string, trashed boolean, name string, version string, error string"
FIELDS = ("id", "kind", "trashed", "name", "version")


class ItemError(Exception):
    """One item cannot be had; the message is its code."""


class Drive(Protocol):
    """``head`` is the feed's newest cursor; ``children`` gives one page of a folder's items and the next page's token, or none."""

    def head(self) -> int: ...

    def children(self, folder: str, token: str | None) -> tuple[list[dict], str | None]: ...


@dataclass(frozen=True)
class Walk:
    """``items``: as ``ITEMS``; ``failed``: folder, error of the folders that were not listed to their end."""

    cursor: int
    items: DataFrame
    failed: DataFrame


def _pages(drive: Drive, folder: str) -> Iterator[list[dict]]:
    """A folder's pages; a token that comes again would never end."""
    token, seen = None, set()
    while True:
        items, token = drive.children(folder, token)
        yield items
        if not token:
            return
        if token in seen:
            raise ItemError("pageTokenRepeated")
        seen.add(token)


def listed(folders: DataFrame, drive: Drive) -> DataFrame:
    """The children of folders (id), read in tasks; a row with an error for each folder that is not listed to its end."""
    names = ["folder", *FIELDS, "error"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string()]

    def batch(folder: str, items: list[dict], error: str | None = None) -> pa.RecordBatch:
        rows = [(folder, *(i.get(f) for f in FIELDS), None) for i in items] + ([(folder, *[None] * len(FIELDS), error)] if error else [])
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder in b.column(0).to_pylist():
                try:
                    for items in _pages(drive, folder):
                        yield batch(folder, [i for i in items if i.get("id")])
                except ItemError as e:
                    yield batch(folder, [], str(e) or "unknown")

    tasks = folders.sparkSession.sparkContext.defaultParallelism
    return folders.select("id").repartition(tasks, "id").mapInArrow(run, LISTED)


def walk(spark: SparkSession, drive: Drive, root: str) -> Walk:
    """Everything below a root, with the feed's cursor from before the walk."""
    cursor = drive.head()
    level = spark.createDataFrame([(root,)], "id string")
    walked, levels = [level], []
    while True:
        levels.append(stored(listed(level, drive), "drive-level"))
        below = levels[-1].filter(F.col("kind") == FOLDER).select("id").distinct()
        level = stored(below.join(reduce(DataFrame.unionByName, walked), "id", "left_anti"), "drive-folders")
        if level.isEmpty():
            break
        walked.append(level)
    rows = reduce(DataFrame.unionByName, levels)
    own = F.struct("version", "kind", "name", F.coalesce("trashed", F.lit(False)).alias("trashed"))
    once = rows.filter("error is null").groupBy("id").agg(F.max(own).alias("i"), F.array_sort(F.collect_set("folder")).alias("parents"))
    items = once.filter(F.col("id") != root).select("id", "i.kind", "i.trashed", "i.name", "parents", "i.version")
    return Walk(cursor, items, rows.filter("error is not null").select("folder", "error"))

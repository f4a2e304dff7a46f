"""A change feed with a cursor, as a Python data source for batch and streaming reads.

The feed is whatever a backend (a protocol of two methods) gives: ``head()`` is the newest
cursor, ``changes(start, stop)`` the changes between two cursors. The stream's offset is the
cursor, so it moves on only when a batch has been committed. A directory of JSON lines, one
file for each page of changes, is the backend that needs no network.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "page int, id string, kind string, removed boolean, trashed boolean, name string, parents array<string>, version string"

#: Reasons and codes of errors that concern one item, not the whole source.
ITEM_STATUS = (404, 410)
ITEM_REASONS = ("cannotDownloadFile", "downloadQuotaExceeded", "exportSizeLimitExceeded", "insufficientFilePermissions")

#: What a hosted document is exported as.
EXPORTS = {
    "application/vnd.google-apps.document": ("text/markdown", ".md"),
    "application/vnd.google-apps.spreadsheet": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ".xlsx"),
    "application/vnd.google-apps.presentation": ("application/vnd.openxmlformats-officedocument.presentationml.presentation", ".pptx"),
}


class Backend(Protocol):
    def head(self) -> int: ...

    def changes(self, start: int, stop: int) -> Iterator[dict]: ...


class Directory:
    """Pages ``0001.jsonl``, ``0002.jsonl`` ... of one folder."""

    def __init__(self, path: str):
        self.path = Path(path)

    def head(self) -> int:
        return max((int(p.stem) for p in self.path.glob("*.jsonl")), default=0)

    def changes(self, start: int, stop: int) -> Iterator[dict]:
        for page in range(start + 1, stop + 1):
            for line in (self.path / f"{page:04d}.jsonl").read_text().splitlines():
                if line.strip() and not line.startswith("#"):
                    yield {"page": page} | json.loads(line)


FIELDS = [f.split()[0] for f in re.split(r", (?![^<]*>)", SCHEMA)]


def _row(change: dict) -> tuple:
    return tuple(change.get(name) for name in FIELDS)


#: Pages of changes that one task reads.
PAGES = 64


class _Pages(InputPartition):
    """Changes after one cursor, up to another."""

    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


def _dealt(start: int, stop: int) -> list[_Pages]:
    """Ranges of pages for the tasks; the driver holds cursors only."""
    return [_Pages(at, min(at + PAGES, stop)) for at in range(start, stop, PAGES)]


class _Batch(DataSourceReader):
    def __init__(self, backend: Backend):
        self.backend = backend

    def partitions(self) -> list[_Pages]:
        return _dealt(0, self.backend.head()) or [_Pages(0, 0)]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        return (_row(c) for c in self.backend.changes(partition.start, partition.stop))


class _Stream(DataSourceStreamReader):
    def __init__(self, backend: Backend):
        self.backend = backend

    def initialOffset(self) -> dict:
        return {"cursor": 0}

    def latestOffset(self) -> dict:
        return {"cursor": self.backend.head()}

    def partitions(self, start: dict, end: dict) -> list[_Pages]:
        return _dealt(start["cursor"], end["cursor"])

    def read(self, partition: _Pages) -> Iterator[tuple]:
        return (_row(c) for c in self.backend.changes(partition.start, partition.stop))

    def commit(self, end: dict) -> None:
        """Nothing to do: a page that was read may be read again."""


class ChangeFeed(DataSource):
    """``spark.read.format("changefeed").option("path", folder)``, also with ``readStream``."""

    @classmethod
    def name(cls) -> str:
        return "changefeed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(Directory(self.options["path"]))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(Directory(self.options["path"]))


def needs_full_scan(change: dict) -> bool:
    """Removals, trash and folder events cannot be resolved from the change alone."""
    return bool(change.get("removed") or change.get("trashed") or change.get("kind") == "folder")


def item_error(status: int, reason: str) -> bool:
    """Whether an error concerns the item (go on) or the source (stop)."""
    return status in ITEM_STATUS or status == 403 and reason in ITEM_REASONS

"""Tables of an index as immutable segments: a build adds one, tombstones hide what it replaced, merges keep them few.

Below one folder every version is a folder ``v=N``. A build writes a segment there: the rows that it made, each
with the segment's number, and ``dead``, the documents whose rows of earlier segments no longer count. The
version counts when its manifest is written, the last file of all: the live segments with their levels,
and sums over the live rows. A table is the union of its segments' rows without the dead ones; sums are those of the
version before, plus what the build added, minus what it hid, so no statistic is counted anew.

When ``fanout`` segments have one level, they are merged into one of the next in a version of its own, without the
rows that are dead, so a row is written a logarithmic number of times. Versions are never changed; :meth:`vacuum`
removes the folders that the newest manifest does not name.

Tables are stored in the order of the key by which they are asked (``KEYS``), so a filter on a few literal
keys skips all other pages of the files.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.shared import hadoop

#: The key of each segmented table, and what of a document hides its rows: its row in ``documents``, or what was made of its text.
KEYS = {
    "documents": "id", "chunks": "row_id", "hashes": "chunk_hash", "places": "body_hash", "postings": "term", "metadata": "row_id", "metadata-postings": "term",
    "sizes": "document", "extractions": "content_hash",
}
#: Keys that very many rows may have; their rows are dealt by the document too.
HOT = ("hashes", "places", "postings", "metadata-postings")
OWNER = {"documents": "id"}
DEAD = "document long, part string, below int"
#: Keys up to which rows are fetched by literals.
LITERALS = 1000
#: The form of the tables; a folder of a later one is not read.
FORMAT = 1
#: Columns that a later form added to tables, with their kinds: rows that were written before have none, and read as null.
ADDED: dict[str, dict[str, str]] = {}


def any_of(key: Column, values: Iterable) -> Column:
    """Whether a key is one of some values, as a tree of equalities: unlike a long list, it reaches the files as it is."""
    tests = [key == v for v in values]
    while len(tests) > 1:
        tests = [tests[i] | tests[i + 1] if i + 1 < len(tests) else tests[i] for i in range(0, len(tests), 2)]
    return tests[0] if tests else F.lit(False)


def fetch(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows with one of the ``wanted`` keys (a column of that name): by literals if they are few, else by a join."""
    few = [r[0] for r in wanted.select(key).distinct().limit(LITERALS + 1).collect()]
    if len(few) <= LITERALS:
        return rows.filter(any_of(F.col(key), [v for v in few if v is not None]))
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


@dataclass
class Manifest:
    """What a version consists of. ``segments``: [number, level]; ``dead``: versions with tombstones; ``sums``: over live rows."""

    version: int = 0
    segments: list[list[int]] = field(default_factory=list)
    dead: list[int] = field(default_factory=list)
    sums: dict[str, int] = field(default_factory=dict)
    last_id: int = 0
    latest: int = 0  # the version of the last build, whose other tables count
    format: int = FORMAT
    cursors: dict[str, int] = field(default_factory=dict)  # of feeds, by source
    whole: dict[str, int] = field(default_factory=dict)  # other tables, by name, with the version that wrote them


class Segments:
    def __init__(self, spark: SparkSession, folder: str, fanout: int = 8):
        self.spark, self.folder, self.fanout = spark, folder, fanout

    def path(self, version: int, name: str) -> str:
        return f"{self.folder}/v={version}/{name}"

    def begin(self, manifest: Manifest) -> int:
        """The number of the version after a manifest's, whose folder is empty: what a broken build left is removed (one writer at a time)."""
        n = manifest.version + 1
        fs, path = hadoop(self.spark, self.folder)
        fs.delete(path(f"{self.folder}/v={n}"), True)
        return n

    def versions(self) -> list[int]:
        """Numbers of the folders, whole or not."""
        fs, path = hadoop(self.spark, self.folder)
        if not fs.exists(path(self.folder)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.folder))]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())

    def manifest(self) -> Manifest:
        """The newest whole version's."""
        fs, path = hadoop(self.spark, self.folder)
        for n in reversed(self.versions()):
            if fs.exists(at := path(self.path(n, "_MANIFEST"))):
                stream = fs.open(at)
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                stream.close()
                found = Manifest(**json.loads(text))
                if found.format > FORMAT:
                    raise ValueError(f"this index has form {found.format}; this release reads up to {FORMAT}")
                return found
        return Manifest()

    def commit(self, manifest: Manifest) -> None:
        """Make a version count: its manifest, under another name first, takes its place whole."""
        fs, path = hadoop(self.spark, self.folder)
        draft, target = path(self.path(manifest.version, "_DRAFT")), path(self.path(manifest.version, "_MANIFEST"))
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(asdict(manifest)).encode()))
        stream.close()
        if not fs.rename(draft, target):
            raise RuntimeError(f"version {manifest.version} of {self.folder} is another writer's")

    def write(self, version: int, name: str, rows: DataFrame) -> None:
        """A table of a segment, each of its files in the order of its key."""
        key = KEYS[name]
        dealt = rows.repartition(F.col(key), F.pmod(F.xxhash64("document"), F.lit(16))) if name in HOT else rows.repartition(F.col(key))
        dealt.withColumn("segment", F.lit(version)).sortWithinPartitions(key).write.parquet(self.path(version, name))

    def bury(self, version: int, dead: DataFrame) -> int:
        """Write tombstones (document, part) of a version; their number."""
        dead.select(F.col("document").cast("long"), "part", F.lit(version).alias("below")).distinct().write.parquet(self.path(version, "dead"))
        return self.spark.read.parquet(self.path(version, "dead")).count()

    def tombstones(self, manifest: Manifest, part: str) -> DataFrame | None:
        if not manifest.dead:
            return None
        rows = self.spark.read.schema(DEAD).parquet(*[self.path(v, "dead") for v in manifest.dead])
        return rows.filter(F.col("part") == part)

    def table(self, name: str, manifest: Manifest, only: Sequence[int] | None = None) -> DataFrame:
        """The live rows of a table, of all segments or some."""
        found = [n for n, _ in manifest.segments if only is None or n in only]
        rows = self.spark.read.option("mergeSchema", "true").parquet(*[self.path(n, name) for n in found]) if name in ADDED else self.spark.read.parquet(*[self.path(n, name) for n in found])
        rows = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in ADDED.get(name, {}).items() if c not in rows.columns})
        if name == "extractions":
            return rows
        owner = OWNER.get(name, "document")
        dead = self.tombstones(manifest, "document" if name in OWNER else "rows")
        if dead is None:
            return rows
        gone = dead.groupBy(F.col("document").alias("__document")).agg(F.max("below").alias("__below"))
        return rows.join(gone, (rows[owner] == gone["__document"]) & (rows["segment"] < gone["__below"]), "left_anti")

    def full(self, manifest: Manifest) -> list[int]:
        """The segments of the lowest level that is full; none if no level is."""
        by_level: dict[int, list[int]] = {}
        for number, level in manifest.segments:
            by_level.setdefault(level, []).append(number)
        return next((by_level[k] for k in sorted(by_level) if len(by_level[k]) >= self.fanout), [])

    def merge(self, manifest: Manifest, numbers: list[int]) -> Manifest:
        """A version in which one segment stands for some; tombstones that hide no row any more are left out."""
        n = self.begin(manifest)
        level = max(k for s, k in manifest.segments if s in numbers) + 1
        for name in KEYS:
            rows = self.table(name, manifest, numbers).drop("segment")
            self.write(n, name, rows.dropDuplicates(["content_hash", "path"]) if name == "extractions" else rows)
        rest = [s for s in manifest.segments if s[0] not in numbers]
        oldest = min([s for s, _ in rest], default=n)
        buried = 0
        if manifest.dead:
            rows = self.spark.read.schema(DEAD).parquet(*[self.path(v, "dead") for v in manifest.dead]).filter(F.col("below") > oldest)
            rows.write.parquet(self.path(n, "dead"))
            buried = self.spark.read.parquet(self.path(n, "dead")).count()
        merged = Manifest(n, [*rest, [n, level]], [n] if buried else [], manifest.sums, manifest.last_id, manifest.latest, cursors=manifest.cursors, whole=manifest.whole)
        self.commit(merged)
        return merged

    def vacuum(self, manifest: Manifest) -> list[int]:
        """Remove the versions that the newest manifest does not need; for times without readers. Their numbers."""
        fs, path = hadoop(self.spark, self.folder)
        needed = {manifest.version, manifest.latest, *manifest.dead, *manifest.whole.values(), *(n for n, _ in manifest.segments)}
        gone = [n for n in self.versions() if n not in needed]
        for n in gone:
            fs.delete(path(f"{self.folder}/v={n}"), True)
        return gone

"""Bytes of a source's items, kept by their hash beside an index.

Each batch of contents is a table of its own below one folder, in the order of the hashes, and counts once Spark has
committed it. What is read is hashed again: bytes that are no longer what their hash says, and files that
cannot be read at all, are as good as absent, so whoever asked fetches them again and ``put`` stores them anew.
``clean`` removes what nothing references; what is younger than an hour is spared, as a running build may have
stored it and not yet committed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import upkeep
from corpusloom.operators.segments import fetch
from corpusloom.sources.shared import hadoop, remove, stored

STORED = "content_hash string, size long, written_at timestamp, content binary"
#: Rows of contents may be very large, so a writer looks at its pages' size after each; contents have no dictionary.
WRITER = {"parquet.page.size.row.check.min": "1", "parquet.enable.dictionary#content": "false"}
#: Share of a batch's bytes that nothing references from which the batch is written again, batches of less than ``SMALL`` bytes that may stay apart.
SHARE, SMALL, FANOUT = 0.5, 128 << 20, 8


class RawStore:
    """One folder of contents; any number of writers, one cleaner at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def batches(self) -> list[str]:
        """Names of the batches that Spark has committed."""
        fs, path = hadoop(self.spark, self.folder)
        if not fs.exists(path(self.folder)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.folder))]
        return sorted(n for n in names if n.startswith("b-") and fs.exists(path(f"{self.folder}/{n}/_SUCCESS")))

    def table(self, batches: list[str] | None = None, strict: bool = False) -> DataFrame:
        """Every stored row with its batch; files that cannot be read have no rows, unless ``strict``, when they are an error."""
        found = self.batches() if batches is None else batches
        if not found:
            return self.spark.createDataFrame([], STORED).withColumn("batch", F.lit(""))
        rows = self.spark.read.schema(STORED).option("ignoreCorruptFiles", str(not strict).lower()).parquet(*[f"{self.folder}/{n}" for n in found])
        return rows.withColumn("batch", F.regexp_extract(F.input_file_name(), "/(b-[0-9a-f]+)/[^/]*$", 1))

    def get(self, wanted: DataFrame) -> DataFrame:
        """content_hash, content of the ``wanted`` hashes (content_hash) whose bytes are there and whole, once each."""
        rows = fetch(self.table().select("content_hash", "content"), "content_hash", wanted)
        return rows.filter(F.sha2("content", 256) == F.col("content_hash")).dropDuplicates(["content_hash"])

    def put(self, files: DataFrame) -> None:
        """Store the contents of files (id, content_hash, content) that are not there whole; of equal ones that of the least id.

        Ids are different and not null; files without content or hash are passed over.
        """
        files = files.filter("content is not null and content_hash is not null")
        known = self.get(files.select("content_hash")).select("content_hash")
        one = stored(files.groupBy("content_hash").agg(F.min("id").alias("id")).join(known, "content_hash", "left_anti"), "raw-new")
        if not one.isEmpty():
            new = files.join(one, ["content_hash", "id"], "left_semi")
            self._write(new.select("content_hash", F.octet_length("content").cast("long").alias("size"), F.current_timestamp().alias("written_at"), "content"))

    def _write(self, rows: DataFrame) -> None:
        rows.sortWithinPartitions("content_hash").write.options(**WRITER).parquet(f"{self.folder}/b-{uuid.uuid4().hex}")

    def verify(self, documents: DataFrame) -> DataFrame:
        """id, checked, matches, reason of documents (id, content_hash): whether the bytes kept for one are still those it was made of."""
        kept = self.table().select("content_hash", (F.sha2("content", 256) == F.col("content_hash")).alias("whole"))
        state = kept.groupBy("content_hash").agg(F.max("whole").alias("matches"))
        both = documents.select("id", "content_hash").join(state, "content_hash", "left")
        there = F.col("matches").isNotNull()
        return both.select("id", there.alias("checked"), "matches", F.when(~there, "no_raw_cache").alias("reason"))

    def clean(self, referenced: DataFrame, now: str, complete: bool, grace: int = upkeep.GRACE, share: float = SHARE) -> int:
        """Remove contents that no row of ``referenced`` (content_hash) names; the number of rows that went.

        Batches with less garbage than ``share`` of their bytes stay as they are, so the work goes with what is removed.
        Batches that are small are written as one when there are over ``FANOUT`` of them. After an incomplete
        listing nothing goes. A file that cannot be read stops the clean-up before anything is removed.
        """
        rows = self.table().select(F.col("content_hash").alias("name"), "size", "written_at", "batch")
        gone = upkeep.garbage(rows.select("name", "written_at"), referenced.select(F.col("content_hash").alias("name")), now, complete, grace).distinct()
        marked = rows.join(gone.withColumn("gone", F.lit(True)), "name", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
        sums = marked.groupBy("batch").agg(F.count_if("gone").alias("n"), F.sum(F.when(F.col("gone"), F.col("size")).otherwise(0)).alias("dead"), F.sum("size").alias("size")).collect()  # a row for each batch
        chosen = {r["batch"] for r in sums if r["n"] and r["dead"] >= share * r["size"]}
        small = {r["batch"] for r in sums if r["size"] < SMALL}
        chosen |= small if len(small) > FANOUT else set()
        if not chosen:
            return 0
        stays = self.table(sorted(chosen), strict=True).join(gone.withColumnRenamed("name", "content_hash"), "content_hash", "left_anti").drop("batch")
        self._write(stays)
        for name in sorted(chosen):
            remove(self.spark, f"{self.folder}/{name}")
        return sum(r["n"] for r in sums if r["batch"] in chosen)

"""Incremental maintenance on snapshots: classify, move, upsert, purge, decide.

A table is never changed in place: the next snapshot is what an operation leaves of the last
one, joined with what it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moves(known: DataFrame, listed: DataFrame) -> DataFrame:
    """old_path, path: files that left one path and came to another with a (size, hash) unique on both sides.

    Both: path, size, hash.
    """
    def lone(rows: DataFrame, other: DataFrame, name: str) -> DataFrame:
        gone = rows.join(other.select("path"), "path", "left_anti")
        return gone.groupBy("size", "hash").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias(name)).filter("n = 1").drop("n")

    return lone(known, listed, "old_path").join(lone(listed, known, "path"), ["size", "hash"]).select("old_path", "path")


def classify(known: DataFrame, listed: DataFrame, cached: DataFrame, complete: bool = True) -> DataFrame:
    """path, action for every file of either side.

    known: path, size, modified, hash; listed the same; cached: hash of what was extracted before.
    Equal size and time need no hash. An incomplete listing deletes nothing.
    """
    moved = moves(known, listed)
    k = known.select("path", F.col("size").alias("k_size"), F.col("modified").alias("k_modified"), F.col("hash").alias("k_hash"))
    both = k.join(listed, "path", "full_outer")
    both = both.join(cached.select("hash").distinct().withColumn("is_cached", F.lit(True)), "hash", "left")
    both = both.join(moved.select("path").withColumn("came", F.lit(True)), "path", "left")
    both = both.join(moved.select(F.col("old_path").alias("path")).withColumn("left_it", F.lit(True)), "path", "left")
    gone = F.when(F.col("left_it"), "moved_away").otherwise("deleted" if complete else "kept")
    action = (
        F.when(F.col("size").isNull(), gone)
        .when(F.col("came"), "moved")
        .when((F.col("size") == F.col("k_size")) & (F.col("modified") == F.col("k_modified")), "unchanged")
        .when(F.col("hash") == F.col("k_hash"), "stat_refresh")
        .when(F.col("is_cached"), "cached_reindex")
        .otherwise("extract")
    )
    return both.select("path", action.alias("action"))


def assign_ids(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows with ids above the highest that was ever given, in key order."""
    high = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("high"))
    # Numbers within ranges of the key, offset by the sizes of the ranges before.
    ranged = new.repartitionByRange(key).withColumn("_p", F.spark_partition_id())
    own = Window.partitionBy("_p").orderBy(key)
    numbered = ranged.withColumn("_n", F.row_number().over(own))
    sizes = numbered.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    return numbered.join(F.broadcast(before), "_p").crossJoin(F.broadcast(high)).withColumn("id", F.col("high") + F.col("_before") + F.col("_n")).drop("_p", "_n", "_before", "high")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The next snapshot: rows that were not touched, and the new ones."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def pending(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_hash", text: str = "text") -> DataFrame:
    """Hashes without a vector, each once with one text."""
    return chunks.groupBy(key).agg(F.min(text).alias(text)).join(vectors, key, "left_anti")


def orphans(rows: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Rows whose key nothing uses any more."""
    return rows.join(used.select(key), key, "left_anti")


def related_ids(documents: DataFrame, edges: DataFrame, source: str) -> DataFrame:
    """Documents of other sources at the far end of an edge from one that goes (their metadata is stale)."""
    gone = documents.filter(F.col("source") == source).select("id")
    ends = lambda a, b: edges.join(gone.select(F.col("id").alias(a)), a, "left_semi").select(F.col(b).alias("id"))
    return ends("a", "b").union(ends("b", "a")).distinct().join(gone, "id", "left_anti")


def same_content(old: Column, new: Column) -> Column:
    """Whether two content keys (kind, value, size, mime) are known to be equal; missing evidence never is."""
    size = old["size"].isNull() | new["size"].isNull() | (old["size"] == new["size"])
    both = (old["kind"] == new["kind"]) & (old["value"] == new["value"]) & (old["mime"] == new["mime"])
    return F.coalesce((old["value"] != "") & both & ((old["kind"] != "checksum") | size), F.lit(False))


def trashed(items: DataFrame, trash: DataFrame) -> DataFrame:
    """Items in the trash by their own id or an ancestor's; items that are listed are live.

    items: id, ancestors, listed; trash: id.
    """
    reach = items.select("id", "listed", F.explode(F.array_distinct(F.concat(F.array("id"), "ancestors"))).alias("at"))
    hit = reach.join(trash.select(F.col("id").alias("at")), "at", "left_semi").select("id").distinct()
    marked = items.join(hit.withColumn("in_trash", F.lit(True)), "id", "left")
    return marked.select("id", (F.coalesce("in_trash", F.lit(False)) & ~F.col("listed")).alias("trashed"))


def sync_decisions(known: DataFrame, listed: DataFrame, trash: DataFrame, scan_errors: bool) -> DataFrame:
    """id, decision for every item of a change feed's full scan.

    known: id, content, place, ancestors, was_trashed; listed: id, content, place. A scan with errors
    neither trashes nor deletes.
    """
    k = known.select("id", F.col("content").alias("k_content"), F.col("place").alias("k_place"), "ancestors", "was_trashed")
    both = k.join(listed, "id", "full_outer").withColumn("listed", F.col("content").isNotNull())
    marked = both.join(trashed(both.select("id", F.coalesce("ancestors", F.array().cast("array<string>")).alias("ancestors"), "listed"), trash), "id")
    gone = F.lit("kept") if scan_errors else F.when(F.col("trashed"), "trash").otherwise("delete")
    decision = (
        F.when(~F.col("listed"), gone)
        .when(F.col("k_content").isNull(), "index")
        .when(F.col("was_trashed"), "restore")
        .when(F.col("content") != F.col("k_content"), "index")
        .when(F.col("place") != F.col("k_place"), "metadata")
        .otherwise("unchanged")
    )
    return marked.select("id", decision.alias("decision"))


def corrections(revisions: DataFrame) -> DataFrame:
    """Text rebuilt from the last revision of every page: document, text."""
    last = revisions.groupBy("document", "page").agg(F.max_by("text", "id").alias("text"))
    pages = last.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("page", F.trim("text").alias("text")))).alias("pages"))
    kept = F.filter(F.transform("pages", lambda p: p["text"]), lambda t: t != "")
    return pages.select("document", F.concat_ws("\n\n", kept).alias("text"))


def relocate(path: Column, old: str, new: str) -> Column:
    """A path below ``old`` moved below ``new``; others stay."""
    old, new = old.rstrip("/"), new.rstrip("/")
    return F.when(path == old, F.lit(new)).when(F.startswith(path, F.lit(old + "/")), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(path)

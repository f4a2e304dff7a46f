"""Upkeep of what an index keeps: integrity, garbage, reviews, sources, readiness, added facts, folder trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.sources.shared import stored

#: Seconds an unreferenced file is spared, the shortest interval of a schedule, and the intervals without a sync after which a source is stale.
GRACE, LEAST_POLL, STALE_POLLS = 3600, 60, 3


def integrity(documents: DataFrame, files: DataFrame) -> DataFrame:
    """id, checked, matches, reason: every document's recorded hash against the bytes that are there now.

    documents: id, path, content_hash; files: path, content. A file that is gone is not checked.
    """
    now = files.select("path", F.sha2("content", 256).alias("now"))
    both = documents.select("id", "path", "content_hash").join(now, "path", "left")
    there = F.col("now").isNotNull()
    return both.select("id", there.alias("checked"), F.when(there, F.col("now") == F.col("content_hash")).alias("matches"), F.when(~there, "file_missing").alias("reason"))


def garbage(written: DataFrame, referenced: DataFrame, now: str, complete: bool, grace: int = GRACE) -> DataFrame:
    """name of every written file (name, written_at) that nothing references and that is older than ``grace`` seconds.

    After an incomplete scan nothing is garbage: what it did not see may be in use.
    """
    old = F.col("written_at").cast("timestamp") < F.lit(now).cast("timestamp") - F.make_interval(secs=F.lit(grace))
    return written.filter(F.lit(complete) & old).join(referenced.select("name"), "name", "left_anti").select("name")


def resolve(reviews: DataFrame, decided: DataFrame, now: str) -> DataFrame:
    """The next snapshot of reviews (id, status, resolution, updated_at): the decided ones (id, resolution) are resolved; texts stay.

    An id that no review has is an error.
    """
    if unknown := decided.join(reviews.select("id"), "id", "left_anti").select("id").first():
        raise ValueError(f"review not found: {unknown['id']}")
    d = decided.select("id", F.col("resolution").alias("_new"))
    hit = F.col("_new").isNotNull()
    return reviews.join(d, "id", "left").withColumns(
        {
            "status": F.when(hit, "resolved").otherwise(F.col("status")),
            "resolution": F.coalesce("_new", "resolution"),
            "updated_at": F.when(hit, F.lit(now).cast("timestamp")).otherwise(F.col("updated_at")),
        }
    ).drop("_new").select(*reviews.columns)


def check_source(name: str, kind: str, locator: str, account: str = "", credentials: int = 0, home: str | None = None) -> None:
    """Refuses a source that cannot be registered, whatever is registered already."""
    local = kind == "local"
    inside = local and home is not None and (locator.rstrip("/") + "/").startswith(home.rstrip("/") + "/")
    rules = {
        "a name is not empty and holds no slash, backslash or colon": name.strip() != "" and not set("/\\:") & set(name),
        "a kind is local or google_drive": kind in ("local", "google_drive"),
        "a source has a root": locator.strip() != "",
        "the folder of an index is no source": not inside,
        "a drive needs an account and one kind of credentials": local or (account.strip() != "" and credentials == 1),
    }
    for broken, holds in rules.items():
        if not holds:
            raise ValueError(broken)


def register(sources: DataFrame, name: str, kind: str, locator: str, **more) -> DataFrame:
    """The sources (name, kind, locator, enabled, poll_seconds) and one more; a root or a name is registered once."""
    check_source(name, kind, locator, **more)
    root = locator.rstrip("/") or "/"
    if sources.filter((F.col("name") == name) | ((F.col("kind") == kind) & (F.col("locator") == root))).limit(1).count():
        raise ValueError(f"already registered: {name} at {root}")
    new = sources.sparkSession.createDataFrame([(name, kind, root, True, None)], "name string, kind string, locator string, enabled boolean, poll_seconds int")
    return sources.unionByName(new)


def changed(sources: DataFrame, name: str, enabled: bool | None = None, poll_seconds: int | None = None) -> DataFrame:
    """The sources with one switched on or off or polled at another interval."""
    if poll_seconds is not None and poll_seconds < LEAST_POLL:
        raise ValueError(f"poll_seconds must be at least {LEAST_POLL}")
    if enabled is None and poll_seconds is None:
        raise ValueError("nothing to change")
    if not sources.filter(F.col("name") == name).limit(1).count():
        raise ValueError(f"unknown source: {name}")
    given = {"enabled": enabled, "poll_seconds": poll_seconds}
    return sources.withColumns({c: F.when(F.col("name") == name, F.lit(v)).otherwise(F.col(c)) for c, v in given.items() if v is not None})


def readiness(sources: DataFrame, reviews: DataFrame, chunks: DataFrame, vectors: DataFrame, now: str) -> DataFrame:
    """check, status (ok, warning, error), n: what hinders an index, a row for each check and one, ``all``, for their sum.

    sources: name, enabled, created_at, last_sync_at, poll, last_error; only enabled ones count, and one that was never
    synced ages from its creation. reviews: reason, status. A chunk_hash of chunks without vectors is a warning.
    ``all`` is blocked after an error, degraded after a warning, else ready; its n is the number of checks that are not ok.
    """
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.coalesce("last_sync_at", "created_at"))
    late, broken = age > STALE_POLLS * F.col("poll"), F.coalesce("last_error", F.lit("")) != ""
    synced = sources.filter("enabled").agg(F.count(F.lit(1)).alias("enabled"), F.count_if(broken).alias("broken"), F.count_if(late).alias("late"))
    row = lambda name, status, n: F.struct(F.lit(name).alias("check"), status.alias("status"), n.cast("long").alias("n"))
    sync = F.when(F.col("broken") > 0, "error").when((F.col("late") > 0) | (F.col("enabled") == 0), "warning").otherwise("ok")
    of_sources = synced.select(
        F.inline(
            F.array(
                row("sources", F.when(F.col("enabled") > 0, "ok").otherwise("error"), F.col("enabled")),
                row("sync", sync, F.when(F.col("broken") > 0, F.col("broken")).otherwise(F.col("late"))),
            )
        )
    )
    left = {
        "reviews": reviews.filter((F.col("status") == "open") & (F.col("reason") != "complex_layout")),
        "vectors": chunks.select("chunk_hash").distinct().join(vectors.select("chunk_hash"), "chunk_hash", "left_anti"),
    }
    checks = of_sources
    for name, rows in left.items():
        counted = rows.agg(F.count(F.lit(1)).alias("n"))
        checks = checks.unionByName(counted.select(F.lit(name).alias("check"), F.when(F.col("n") > 0, "warning").otherwise("ok").alias("status"), "n"))
    bad = lambda s: F.count_if(F.col("status") == s)
    whole = F.when(bad("error") > 0, "blocked").when(bad("warning") > 0, "degraded").otherwise("ready")
    checks = stored(checks, "readiness")  # four rows; the tables are not read again for their sum
    return checks.unionByName(checks.agg(F.lit("all").alias("check"), whole.alias("status"), (bad("error") + bad("warning")).alias("n")))


def names_of(documents: DataFrame) -> DataFrame:
    """name, document: every name that means one document (stable reference, ``source:path``, path, external id)."""
    every = F.array("stable_ref", F.concat_ws(":", "source_name", "relative_path"), "relative_path", "external_id")
    names = documents.select(F.explode(F.array_distinct(F.array_compact(every))).alias("name"), F.col("id").alias("document"))
    return names.groupBy("name").agg(F.min("document").alias("document"), F.max("document").alias("_last")).filter("document = _last").drop("_last")


def judged_facts(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts with the id of their document, or with the reason for which they are refused.

    facts: fact, path, key, value, evidence (array of structs path, locator, quote). Every item of evidence
    names a document of the index and a locator or a quote.
    """
    names = names_of(documents)
    known = lambda rows, at: rows.join(names.select(F.col("name").alias(at), F.col("document").alias("_d")), at, "left")
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    items = facts.select("fact", F.explode_outer("evidence").alias("e")).select("fact", F.col("e").isNull().alias("none"), F.col("e.path").alias("name"), (given(F.col("e.locator")) | given(F.col("e.quote"))).alias("placed"))
    rank = F.when(F.col("none"), 1).when(F.coalesce("name", F.lit("")) == "", 2).when(~F.col("placed"), 3).when(F.col("_d").isNull(), 4)
    worst = known(items, "name").groupBy("fact").agg(F.min(rank).alias("worst"))
    reasons = F.array(*[F.lit(x) for x in ("evidence is required", "evidence names no path", "evidence has no locator and no quote", "evidence is of no document")])
    owned = facts.join(names.select(F.col("name").alias("path"), "document"), "path", "left").join(worst, "fact")
    reason = F.when(F.col("worst").isNotNull(), F.get(reasons, F.col("worst") - 1)).when(F.col("document").isNull(), "unknown document")
    return owned.select("fact", F.when(reason.isNull(), F.col("document")).alias("document"), "key", "value", reason.alias("refused"))


def display_segment(name: Column) -> Column:
    """A path component to show: composed, with ``%``, slashes and control or format characters as percent codes.

    ``.`` and ``..`` are written in codes and an empty name as ``%EMPTY``, so different names stay different.
    """
    chars = F.filter(F.split(T.nfc(name), ""), lambda c: c != "")
    code = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    shown = F.array_join(F.transform(chars, lambda c: F.when(F.rlike(c, F.lit(r"^[%/\\\p{C}]$")), code(c)).otherwise(c)), "")
    return F.when(name == "", "%EMPTY").when(name.isin(".", ".."), F.repeat(F.lit("%2E"), F.length(name))).otherwise(shown)


def flagged(artifacts: DataFrame) -> DataFrame:
    """Artifacts (id, reviews: structs reason, page) whose reviews of a complex layout became flags: layout_flags, layout_pages."""
    layout = F.filter("reviews", lambda r: r["reason"] == "complex_layout")
    has = F.size(layout) > 0
    return artifacts.withColumns(
        {
            "reviews": F.filter("reviews", lambda r: ~r["reason"].eqNullSafe(F.lit("complex_layout"))),
            "layout_flags": F.when(has, F.array(F.lit("complex_layout"))).otherwise(F.array().cast("array<string>")),
            "layout_pages": F.array_sort(F.array_distinct(F.transform(layout, lambda r: r["page"]))),
        }
    )


def tree(items: DataFrame, root: str) -> DataFrame:
    """id, path, ancestors, trashed of every item below a root: a full scan, a level of folders in each pass.

    items: id, name, folder (is it one), parents, trashed. An item met before is not followed again, so loops of
    folders end; with several parents the first path in order counts. A trashed folder's items are listed as trashed.
    """
    edges = items.select("id", F.explode("parents").alias("parent"), "name", "folder", "trashed")
    start = items.sparkSession.createDataFrame([(root, "", [], False)], "id string, path string, ancestors array<string>, trashed boolean")
    levels, level = [start], start
    while True:
        above = level.select(F.col("id").alias("parent"), F.col("path").alias("base"), F.col("ancestors").alias("over"), F.col("trashed").alias("gone"))
        path = F.concat(F.when(F.col("base") == "", "").otherwise(F.concat("base", F.lit("/"))), display_segment(F.col("name")))
        seen = reduce(DataFrame.unionByName, levels)
        met = edges.join(above, "parent").join(seen.select("id"), "id", "left_anti")
        met = met.select("id", path.alias("path"), F.concat("over", F.array("parent")).alias("ancestors"), (F.col("trashed") | F.col("gone")).alias("trashed"), "folder")
        first = Window.partitionBy("id").orderBy("path", F.array_join("ancestors", "/"))
        level = stored(met.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n"), "tree-level")
        if level.isEmpty():
            return seen.filter(F.col("id") != root)
        levels.append(level.drop("folder"))  # each item is written once
        level = level.filter("folder").drop("folder")

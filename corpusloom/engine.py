"""The index of a collection: build it from files, keep it as tables, ask it questions.

Tables live below one folder as segments (:mod:`corpusloom.operators.segments`): a build writes the rows that it made
and tombstones of those that they replace, so its work goes with what changed; readers take the newest
version that is whole.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import structure
from corpusloom.functions import text as T
from corpusloom.operators import filters, governance, lexical, maintain, reads, segments, upkeep
from corpusloom.operators.vectors import Filled, Model, VectorStore
from corpusloom.plans import search as plan
from corpusloom.settings import Settings
from corpusloom.sources import documents as D
from corpusloom.sources.formats import SCANNED_MEDIA, Backend
from corpusloom.sources.shared import hadoop, stored

VALIDITY = "id long, effective_from date, effective_to date, amended_by array<string>, replaced_by string, status_checked_on date, status_source string"
VECTORS = "chunk_hash string, embedding array<float>"
CORRECTIONS = "id long, document long, page int, text string, content_hash string"
AGENT = "document long, key string, value string"
EDGES = "source long, target long, relation string"
DOCUMENTS = (
    "id long, source_id string, source_name string, kind string, enabled boolean, path string, relative_path string, content_hash string, size long, modified_us long, "
    "modified_at timestamp, indexed_at timestamp, media_type string, title string, metadata map<string,string>, word_count long, doc_no string, doc_no_key string, "
    "external_id string, source_url string, ancestors array<string>, trashed_at timestamp, text string, "
    "spans array<struct<kind:string,locator:string,start:int,stop:int>>, reviews array<string>, stable_ref string"
)
DOCUMENT_COLUMNS = [c.split()[0] for c in re.split(r", (?![^<]*>)", DOCUMENTS)]
COVERAGE = "source_id string, path string, status string, stage string, error string"
SOURCES = "source_id string, source_name string, listing_complete boolean, running boolean, last_sync_at timestamp"
CACHED = ("manifest", "documents", "chunks", "metadata", "hashes", "places", "inverted", "inverted_metadata")
#: What a build does to a file's document without reading the file.
KEPT = ("unchanged", "stat_refresh", "kept")


class Index:
    """``validity``, ``vectors``, ``agent`` (facts that were added to documents) and ``edges`` (between documents) are tables kept elsewhere."""

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        validity: DataFrame | None = None,
        vectors: DataFrame | None = None,
        agent: DataFrame | None = None,
        edges: DataFrame | None = None,
        settings: Settings = Settings(),
        fanout: int = 8,
        model: Model | None = None,
    ):
        self.spark, self.folder, self.settings = spark, folder.rstrip("/"), settings
        self.segments = segments.Segments(spark, self.folder, fanout)
        self.model = model
        given = ((validity, VALIDITY), (vectors, VECTORS), (agent, AGENT), (edges, EDGES))
        self._vectors = vectors
        self.validity, _, self.agent, self.edges = (x if x is not None else spark.createDataFrame([], kind) for x, kind in given)

    @property
    def vectors(self) -> DataFrame:
        """chunk_hash, embedding: those given, else those of the model, else none."""
        if self._vectors is not None:
            return self._vectors
        return VectorStore(self.spark, self.folder, self.model).table() if self.model else self.spark.createDataFrame([], VECTORS)

    @vectors.setter
    def vectors(self, rows: DataFrame) -> None:
        self._vectors = rows

    def embed(self, round_rows: int = 100_000) -> Filled:
        """Ask the model for the vectors that chunks lack; what a stopped run got is kept."""
        if self.model is None:
            raise ValueError("no embedding model is configured")
        return VectorStore(self.spark, self.folder, self.model).fill(self.chunks.select("chunk_hash", "text"), round_rows)

    @cached_property
    def manifest(self) -> segments.Manifest:
        return self.segments.manifest()

    def version(self) -> int:
        """Newest whole version; 0 before the first build."""
        return self.segments.manifest().version

    def _latest(self, name: str) -> DataFrame:
        """A table that every build writes whole."""
        return self.spark.read.parquet(self.segments.path(self.manifest.latest, name))

    @cached_property
    def documents(self) -> DataFrame:
        if not self.manifest.segments:
            return self.spark.createDataFrame([], DOCUMENTS)
        return self.segments.table("documents", self.manifest).select(*DOCUMENT_COLUMNS)

    @cached_property
    def chunks(self) -> DataFrame:
        return self.segments.table("chunks", self.manifest).drop("segment")

    @cached_property
    def hashes(self) -> DataFrame:
        """chunk_hash, row_id, document of every chunk."""
        return self.segments.table("hashes", self.manifest).drop("segment")

    @cached_property
    def places(self) -> DataFrame:
        """body_hash, document, ordinal, start, stop, cite_key of every chunk."""
        return self.segments.table("places", self.manifest).drop("segment")

    @cached_property
    def metadata(self) -> DataFrame:
        return self.segments.table("metadata", self.manifest).drop("segment").unionByName(self._latest("facts"))

    def _stats(self, *kinds: str) -> DataFrame:
        rows, terms = (sum(self.manifest.sums.get(f"{k}_{of}", 0) for k in kinds) for of in ("rows", "terms"))
        return self.spark.range(1).select(F.lit(rows).cast("long").alias("n"), F.lit(terms / rows if rows else 0.0).alias("mean"))

    @cached_property
    def inverted(self) -> lexical.Inverted:
        return lexical.Inverted(self.segments.table("postings", self.manifest).drop("segment"), self._stats("chunk"))

    @cached_property
    def inverted_metadata(self) -> lexical.Inverted:
        posted = self.segments.table("metadata-postings", self.manifest).drop("segment").unionByName(self._latest("facts-postings"))
        return lexical.Inverted(posted, self._stats("metadata", "fact"))

    def _write(self, version: int, name: str, df: DataFrame) -> DataFrame:
        """Write a table of a version and read it back: what is built on it does not build it again."""
        path = self.segments.path(version, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _extractions(self) -> DataFrame:
        """What was extracted by any build, by content."""
        if not self.manifest.segments:
            return self.spark.createDataFrame([], D.EXTRACTED)
        return self.segments.table("extractions", self.manifest).drop("segment")

    def build(self, root: str, source_id: str, source_name: str, backend: Backend | None = None) -> None:
        """Index (or index again) every file below a root as one source; other sources stay as they are.

        Only files whose size or time changed are read; a file that moved keeps its document's id, and one
        that cannot be extracted any more keeps its last good document, marked stale in the coverage. What is
        written is a segment of the documents that changed, and tombstones. ``actions`` says what became of
        each file.
        """
        self.refresh()
        before = self.documents
        n = self.segments.begin(self.manifest)
        own = before.filter(F.col("source_id") == source_id)
        base = F.lit(root.removeprefix("file://").rstrip("/") + "/")
        relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), F.concat(F.lit("^\\Q"), base, F.lit("\\E")), "")
        listed = D.listing(self.spark, root).filter(filters.accepted(relative, self.settings.extensions, self.settings.excluded))
        listed = self._write(n, "listed", listed.withColumn("relative_path", relative))
        actions, hashed = self._classified(n, root, own, listed)
        cached = self._extractions()
        new = D.extract(D.contents(self.spark, root, hashed.join(cached.select("content_hash", D.suffix(F.col("path")).alias("suffix")).distinct(), ["content_hash", "suffix"], "left_anti")), backend, self.settings.limits)
        cached = cached.unionByName(self._extracted(n, new))
        again = actions.filter(~F.col("action").isin(*KEPT, "deleted", "moved_away"))
        changed = hashed.join(again.select("path", "old_path"), "path")
        found = self._write(n, "found", D.documents(D.reuse(changed, cached)).join(changed.select("path", "relative_path", "old_path"), "path"))
        good, bad = found.filter("error is null"), found.filter("error is not null").select("relative_path", "old_path", "error")
        ids = own.select("id", F.col("relative_path").alias("was"))
        fresh = self._write(n, "fresh", self._corrected(self._documents(good, ids, source_id, source_name), self._corrections()))
        # Documents that stay: those of files that did not change, and the last good ones of files that failed.
        failed = bad.select(F.coalesce("old_path", "relative_path").alias("relative_path"))
        stays = actions.filter(F.col("action").isin(*KEPT)).select("relative_path").unionByName(failed)
        gone = self._write(n, "gone", own.join(stays, "relative_path", "left_anti").select(F.col("id").alias("document")))
        same = actions.filter(F.col("action").isin(*KEPT)).select("relative_path")
        moved = self._restated(own.join(same, "relative_path", "left_semi"), listed)
        status = F.when(F.col("was").isNotNull(), "stale").otherwise("unindexed").alias("status")
        gaps = bad.join(ids, F.coalesce(bad.old_path, bad.relative_path) == ids.was, "left").select(
            F.lit(source_id).alias("source_id"), F.col("relative_path").alias("path"), status, F.lit("extract").alias("stage"), "error"
        )
        self._finish(n, source_id, source_name, own, fresh, gone, moved, gaps)

    def _extracted(self, n: int, new: DataFrame) -> DataFrame:
        """New extractions, written to a version's segment."""
        self.segments.write(n, "extractions", new)
        return self.spark.read.parquet(self.segments.path(n, "extractions")).drop("segment")

    def _finish(
        self, n: int, source_id: str | None, source_name: str | None, own: DataFrame, fresh: DataFrame, gone: DataFrame, moved: DataFrame, gaps: DataFrame | None,
        cursors: dict[str, int] | None = None, whole: dict[str, int] | None = None, complete: bool = True,
    ) -> None:
        """Write the segment of a source's fresh documents, without those ``gone`` and with those restated (``moved``), and commit it.

        Without a source, what is told of sources stays as it is.
        """
        self.segments.write(n, "documents", fresh.unionByName(moved))
        part = lambda rows, name: rows.select("document", F.lit(name).alias("part"))
        written = self.spark.read.parquet(self.segments.path(n, "documents")).select(F.col("id").alias("document"))
        dead = part(gone, "rows").unionByName(part(gone, "document")).unionByName(part(written.join(own.select(F.col("id").alias("document")), "document", "left_semi"), "document"))
        buried = self.segments.bury(n, dead)
        sums = self._index(n, fresh, gone)
        if source_id is None:
            for name in ("coverage", "sources", "actions"):
                self._write(n, name, self._latest(name))
            self._extracted(n, self._extractions().limit(0))
        else:
            sources = self.spark.range(1).select(
                F.lit(source_id).alias("source_id"), F.lit(source_name).alias("source_name"), F.lit(complete).alias("listing_complete"), F.lit(False).alias("running"), F.current_timestamp().alias("last_sync_at")
            )
            for name, rows in (("coverage", gaps), ("sources", sources)):
                others = self._latest(name).filter(F.col("source_id") != source_id) if self.manifest.latest else rows.limit(0)
                self._write(n, name, others.unionByName(rows))
        last = max(self.manifest.last_id, fresh.agg(F.max("id")).first()[0] or 0)
        old = self.manifest
        manifest = segments.Manifest(
            n, [*old.segments, [n, 0]], [*old.dead, n] if buried else old.dead, sums, last, n, cursors=old.cursors | (cursors or {}), whole=old.whole | (whole or {})
        )
        self._facts(n, manifest)
        self.segments.commit(manifest)
        while full := self.segments.full(manifest):
            manifest = self.segments.merge(manifest, full)
        fs, path = hadoop(self.spark, self.folder)
        for name in ("listed", "hashed", "found", "fresh", "gone", "changes", "placed", "items-seen", "listing", "due", "renamed", "held"):
            fs.delete(path(self.segments.path(n, name)), True)
        self.refresh()

    def correct(self, revisions: DataFrame) -> None:
        """Replace the text of some documents' pages (document, page, text): the last revision of a page counts, also in later builds of the same bytes."""
        self.refresh()
        n = self.segments.begin(self.manifest)
        before = self._corrections()
        new = revisions.select(F.col("document").cast("long"), F.col("page").cast("int"), "text").join(self.documents.select(F.col("id").alias("document"), "content_hash"), "document")
        high = before.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id"))
        numbered = maintain.assign_ids(high, new, "document").select("id", "document", "page", "text", "content_hash")
        self._write(n, "corrections", before.unionByName(numbered))
        own = self.documents.join(numbered.select(F.col("document").alias("id")).distinct(), "id", "left_semi").select(*DOCUMENT_COLUMNS)
        fresh = self._write(n, "fresh", self._corrected(own, self.spark.read.parquet(self.segments.path(n, "corrections"))))
        gone = self._write(n, "gone", fresh.select(F.col("id").alias("document")))
        self._finish(n, None, None, own, fresh, gone, own.limit(0), None, whole={"corrections": n})

    def _corrections(self) -> DataFrame:
        at = self.manifest.whole.get("corrections")
        return self.spark.read.parquet(self.segments.path(at, "corrections")) if at else self.spark.createDataFrame([], CORRECTIONS)

    def _corrected(self, docs: DataFrame, corrections: DataFrame) -> DataFrame:
        """Documents with the last revisions of their pages in place of the pages' text, and their spans moved accordingly."""
        last = corrections.groupBy("document", "content_hash", "page").agg(F.max_by("text", "id").alias("text"))
        pages = last.groupBy(F.col("document").alias("id"), "content_hash").agg(F.map_from_entries(F.collect_list(F.struct("page", "text"))).alias("__new"))
        both = docs.join(pages, ["id", "content_hash"], "left")
        page = lambda s: F.regexp_extract(s["locator"], r"^page:(\d+)$", 1).try_cast("int")
        old = lambda s: F.substring("text", s["start"] + 1, s["stop"] - s["start"])
        parts = F.transform("spans", lambda s: F.coalesce(F.try_element_at("__new", page(s)), old(s)))
        start = F.array(F.lit(0))
        starts = F.aggregate("__parts", start, lambda a, p: F.concat(a, F.array(F.element_at(a, F.lit(-1)) + F.length(p) + 2)))
        moved = F.zip_with(F.arrays_zip("spans", "__parts"), F.slice("__starts", 1, F.size("spans")), lambda x, at: F.struct(x["spans"]["kind"].alias("kind"), x["spans"]["locator"].alias("locator"), at.alias("start"), (at + F.length(x["__parts"])).alias("stop")))
        hit = F.col("__new").isNotNull()
        made = both.withColumn("__parts", parts).withColumn("__starts", starts)
        made = made.withColumns({"spans": F.when(hit, moved).otherwise(F.col("spans")), "text": F.when(hit, F.array_join("__parts", "\n\n")).otherwise(F.col("text"))})
        return made.withColumn("word_count", T.words(F.col("text")).cast(docs.schema["word_count"].dataType)).select(*DOCUMENT_COLUMNS)

    def refresh(self) -> None:
        """See what other builds have written since this object last looked."""
        for name in CACHED:
            self.__dict__.pop(name, None)

    def vacuum(self) -> list[int]:
        """Remove the folders of versions that no longer count; for times without readers. Their numbers."""
        self.refresh()
        return self.segments.vacuum(self.manifest)

    def _restated(self, stay: DataFrame, listed: DataFrame) -> DataFrame:
        """The documents that stay whose file has another path, size or time than they say, as they are to be written."""
        seen = listed.select("relative_path", F.col("path").alias("new_path"), F.col("size").alias("new_size"), F.col("modified_us").alias("new_us"))
        both = stay.join(seen, "relative_path").filter("path <> new_path or size <> new_size or modified_us <> new_us")
        told = both.withColumns({"path": F.col("new_path"), "size": F.col("new_size"), "modified_us": F.col("new_us")})
        return told.withColumn("modified_at", F.timestamp_micros("modified_us")).select(*DOCUMENT_COLUMNS)

    def _classified(self, n: int, root: str, own: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What to do with every file (relative_path, action, path, old_path), and the hashes of files that are new or touched."""
        known = own.select("relative_path", "size", "modified_us", "content_hash")
        touched = listed.join(known, ["relative_path", "size", "modified_us"], "left_anti")
        hashed = self._write(n, "hashed", D.hashed(D.contents(self.spark, root, touched)).drop("content"))
        with_hash = listed.join(known, ["relative_path", "size", "modified_us"], "left").join(hashed.select("path", F.col("content_hash").alias("fresh")), "path", "left")
        shape = lambda d, h: d.select(F.col("relative_path").alias("path"), "size", F.col("modified_us").alias("modified"), h.alias("hash"))
        a, b = shape(known, F.col("content_hash")), shape(with_hash, F.coalesce("fresh", "content_hash"))
        decided = maintain.classify(a, b, self._extractions().select(F.col("content_hash").alias("hash")))
        moved = maintain.moves(a, b)
        actions = decided.join(moved, "path", "left").withColumnRenamed("path", "relative_path").join(listed.select("relative_path", "path"), "relative_path", "left")
        return self._write(n, "actions", actions), hashed

    def _drive_documents(self, good: DataFrame, ids: DataFrame, source_id: str, source_name: str) -> DataFrame:
        """Documents of a drive's items (item, ancestors, in_trash): the id is that of the item, or a new one."""
        own = good.withColumns({"external_id": F.col("item"), "trashed_at": F.when(F.col("in_trash"), F.current_timestamp()), "kind": F.lit("google_drive"), "old_path": F.lit(None).cast("string")})
        return self._documents(own, ids.withColumnRenamed("item", "was"), source_id, source_name, key="item")

    def _documents(self, good: DataFrame, ids: DataFrame, source_id: str, source_name: str, key: str | None = None) -> DataFrame:
        """Documents of extracted files; the id is that of the path, or of the path the file left (or that of ``key``), or a new one."""
        number = structure.own_number(T.snippet(F.col("text"), 3000))
        absent = lambda kind: F.lit(None).cast(kind)
        rest = {"kind": F.lit("local"), "external_id": absent("string"), "trashed_at": absent("timestamp"), "ancestors": F.array().cast("array<string>")}
        named = good.withColumns(
            {name: value for name, value in rest.items() if name not in good.columns}
            | {
                "source_id": F.lit(source_id), "source_name": F.lit(source_name), "enabled": F.lit(True), "modified_at": F.timestamp_micros("modified_us"),
                "indexed_at": F.current_timestamp(), "doc_no": number, "doc_no_key": T.make_key(number), "source_url": absent("string"),
            }
        )
        known = named.join(ids, (F.coalesce("old_path", "relative_path") if key is None else named[key]) == ids.was, "left")
        given = self.spark.range(1).select(F.lit(self.manifest.last_id).cast("long").alias("id"))
        numbered = maintain.assign_ids(given, known.filter("id is null").drop("id"), key or "relative_path")
        both = known.filter("id is not null").unionByName(numbered)
        ref = F.when(F.col("kind") == "google_drive", F.concat(F.lit("drive:"), "external_id")).otherwise(F.concat_ws(":", F.lit("local"), "source_id", F.col("id").cast("string")))
        return both.withColumn("stable_ref", ref).select(*DOCUMENT_COLUMNS)

    def _index(self, n: int, fresh: DataFrame, gone: DataFrame) -> dict[str, int]:
        """Write what is made of the fresh documents' texts; the sums over all live rows, without the ``gone`` documents'."""
        write = lambda name, rows: (self.segments.write(n, name, rows), self.spark.read.parquet(self.segments.path(n, name)).drop("segment"))[1]
        chunks = write("chunks", self._chunks(fresh))
        write("hashes", chunks.select("chunk_hash", "row_id", "document"))
        write("places", chunks.select("body_hash", "document", "ordinal", "start", "stop", "cite_key"))
        none = self.agent.limit(0), self.edges.limit(0)
        entries = write("metadata", self._entries(fresh, *none))
        titles = fresh.select(F.col("id").alias("document"), "title")
        sizes = []
        for kind, name, rows, texts, of in (
            ("chunk", "postings", chunks.join(titles, "document"), ("text", "title"), F.substring_index("row_id", "/", 1)),
            ("metadata", "metadata-postings", entries, ("content",), F.split("row_id", "/")[1]),
        ):
            tokens = lexical.token_rows(rows, "row_id", *texts)
            write(name, lexical.postings(tokens).withColumn("document", of.cast("long")))
            sizes.append(lexical.lengths(tokens).groupBy(of.cast("long").alias("document")).agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("terms")).withColumn("kind", F.lit(kind)))
        sized = write("sizes", sizes[0].unionByName(sizes[1]))
        sums = dict(self.manifest.sums)
        signed = sized.select("kind", "n", "terms")
        if self.manifest.segments:
            hidden = self.segments.table("sizes", self.manifest).join(gone, "document", "left_semi")
            signed = signed.unionByName(hidden.select("kind", (-F.col("n")).alias("n"), (-F.col("terms")).alias("terms")))
        for kind, rows, terms in signed.groupBy("kind").agg(F.sum("n"), F.sum("terms")).collect():
            sums[f"{kind}_rows"] = sums.get(f"{kind}_rows", 0) + rows
            sums[f"{kind}_terms"] = sums.get(f"{kind}_terms", 0) + terms
        return sums

    def _entries(self, docs: DataFrame, agent: DataFrame, edges: DataFrame) -> DataFrame:
        """Metadata entries with their row ids."""
        entries = reads.metadata_entries(docs.select("id", "title", "relative_path", F.to_json("metadata").alias("metadata")), agent, edges).filter("content <> ''")
        return entries.withColumn("row_id", F.concat_ws("/", F.lit("m"), "document", F.sha2(F.concat_ws("\0", "kind", "content"), 256))).dropDuplicates(["row_id"])

    def _facts(self, n: int, manifest: segments.Manifest) -> None:
        """The entries of facts and edges, tables kept elsewhere, of documents that there are; written whole in each build."""
        docs = self.segments.table("documents", manifest).select("id", "title", "relative_path", "metadata")
        entries = self._entries(docs, self.agent, self.edges).filter(F.col("kind") != "automatic").join(docs.select(F.col("id").alias("document")), "document", "left_semi")
        facts = self._write(n, "facts", entries.select("document", "kind", "content", "row_id"))
        tokens = lexical.token_rows(facts, "row_id", "content")
        self._write(n, "facts-postings", lexical.postings(tokens).withColumn("document", F.split("row_id", "/")[1].cast("long")))
        rows, terms = lexical.lengths(tokens).agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        manifest.sums |= {"fact_rows": rows, "fact_terms": terms}

    def actions(self) -> DataFrame:
        """What the last build did: files by action."""
        return self._latest("actions").groupBy("action").agg(F.count(F.lit(1)).alias("files"))

    def coverage(self) -> DataFrame:
        """source, status, failed, pending of every source; failed files by name are in :meth:`failures`."""
        sources = self._latest("sources").withColumnRenamed("source_id", "source")
        return governance.coverage(sources, self.failures().withColumnRenamed("source_id", "source"))

    def failures(self) -> DataFrame:
        """Files without a current document: source_id, path, status (stale: the last good one is kept; partial: a folder not listed to its end), stage, error."""
        return self._latest("coverage")

    def _chunks(self, docs: DataFrame) -> DataFrame:
        """Structured sections where a text has them, windows elsewhere; cite keys are unique in a document."""
        head = T.snippet(F.col("text"), 3000)
        rows = docs.withColumn("document", F.col("id")).withColumn("name", structure.document_name(head, F.col("doc_no")))
        sought = rows if self.settings.chunk_strategy == "structure" else rows.limit(0)
        laws = structure.legal_chunks(sought.filter("media_type <> 'text/markdown'"), "document", limit=self.settings.structure_max_chars)
        marked = structure.markdown_sections(sought.filter("media_type = 'text/markdown'"), "document")
        marked = marked.select("document", "part", "path", F.col("start"), (F.col("start") + F.length("text")).alias("stop"), F.col("text").alias("body"))
        # The line above a section names its document and the headings it stands under.
        within = F.filter("path", lambda x: ~F.rlike(x, F.lit("^(khoản|điểm) |^Mở đầu$")))
        parts = laws.unionByName(marked).join(rows.select("document", "doc_no", "name"), "document")
        context = T.context_line(F.col("doc_no"), F.col("name"), F.array_join(within, " | "))
        parts = parts.select("document", "part", F.col("path").alias("section_path"), "start", "stop", T.stored_text(context, F.col("body")).alias("text"))
        parts = reads.nth(parts, ["document"], [F.col("start"), F.col("part")]).withColumn("ordinal", F.col("n") - 1).drop("n")
        parts = stored(parts, "parts")
        hashed = parts.withColumn("chunk_hash", F.sha2("text", 256)).withColumn("body_hash", F.col("chunk_hash"))
        rest = rows.join(parts.select("document").distinct(), "document", "left_anti")
        windows = D.window_chunks(
            rest, "document", context=T.context_line(F.col("title"), F.col("relative_path")), size=self.settings.chunk_chars, overlap=self.settings.chunk_overlap
        ).withColumns({"part": F.concat(F.lit("c"), "ordinal"), "section_path": F.lit(None).cast("array<string>")})
        both = stored(hashed.unionByName(windows.select(hashed.columns)), "chunks")
        prefix = rows.select("document", F.coalesce("doc_no", "stable_ref").alias("prefix"))
        keyed = structure.cite_keys(both.join(prefix, "document"), "document", "prefix", "part", "ordinal").drop("prefix")
        # All text of these media comes from the recognition backend.
        scanned = rows.select("document", F.coalesce(F.col("media_type").isin(*SCANNED_MEDIA), F.lit(False)).alias("ocr"))
        return keyed.withColumn("row_id", F.concat_ws("/", "document", "ordinal")).join(scanned, "document")

    def search(self, queries: DataFrame | str, options: plan.Options = plan.Options(), **more) -> DataFrame:
        if isinstance(queries, str):
            options.check(queries)
            queries = self.spark.createDataFrame([(1, queries)], "query_id int, text string")
        if self.model and options.mode != "full_text" and "query_vectors" not in more:
            more["query_vectors"] = VectorStore(self.spark, self.folder, self.model, "questions").of_questions(queries)
        return plan.search(self, queries, options, **more)

    def locations(self, hits: DataFrame, options: plan.Options = plan.Options()) -> DataFrame:
        """Every place of the bodies of some hits, as rows."""
        return plan.all_locations(self, hits, options)

    def read(self, reference: str, **bounds) -> DataFrame:
        return reads.read(reads.resolve(self.documents, reference), ["id", "stable_ref", "title"], spans_col="spans", **bounds)

    def list_documents(self, limit: int = 20, after: str | None = None, options: plan.Options = plan.Options()) -> tuple[DataFrame, str | None]:
        rows, nxt = reads.page(plan.visible(self.documents, self.validity, options), limit, after)
        return reads.with_chunk_counts(rows.select("source_id", "id", "stable_ref", "title", "media_type"), self.chunks.withColumnRenamed("document", "id"), "id"), nxt

    def get_chunk(self, cite_key: str, around: int = 1) -> DataFrame:
        wanted = self.chunks.filter(F.col("cite_key") == cite_key).select("document", "ordinal")
        return reads.neighbours(self.chunks, wanted, around)

    def check_status(self, day: str) -> DataFrame:
        """Status and warnings of every document on a day; a review is open until a build no longer reports it."""
        reviews = self.documents.select(F.col("id").alias("document"), F.explode("reviews").alias("reason"), F.lit("open").alias("status"))
        return governance.document_warnings(self.documents, self.validity, self.chunks, reviews, day)

    def readiness(self, now: str, poll: int = 3600) -> DataFrame:
        """What hinders the index: its sources, builds older than three intervals, open reviews, chunks without vectors."""
        sources = self._latest("sources").select(
            F.col("source_id").alias("name"), F.lit(True).alias("enabled"), F.col("last_sync_at").alias("created_at"), "last_sync_at",
            F.lit(poll).alias("poll"), F.lit(None).cast("string").alias("last_error"),
        )
        reviews = self.documents.select(F.explode("reviews").alias("reason"), F.lit("open").alias("status"))
        return upkeep.readiness(sources, reviews, self.chunks, self.vectors, now)

    def integrity(self, root: str) -> DataFrame:
        """Every local document's recorded hash against its file's bytes now."""
        return upkeep.integrity(self.documents.filter("kind = 'local'"), D.scan(self.spark, root))

    def evaluate(self, questions: DataFrame, options: plan.Options = plan.Options(limit=10, per_document=10), by: Sequence[str] = ()) -> DataFrame:
        """Metrics over questions (id, question, gold and others), in all or ``by`` some of their columns; ``diacritics`` is one of them."""
        asked = questions if "diacritics" in questions.columns else questions.withColumn("diacritics", governance.has_diacritics(F.col("question")))
        hits = self.search(asked.select(F.col("id").alias("query_id"), F.col("question").alias("text")), options)
        results = hits.select(F.col("query_id").alias("id"), F.col("place").alias("rank"), "cite_key")
        return governance.metrics(governance.judge(asked, results, self.chunks), list(by))

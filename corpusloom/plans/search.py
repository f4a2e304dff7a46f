"""One search plan for a table of questions: content and metadata, semantic, fused, reranked, numbers first, diversified.

``queries``: query_id, text. ``index``: the tables of :class:`corpusloom.engine.Index`. Filters are
applied before any cut-off, so they never starve a result list.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import filters, fusion, lexical, semantic
from corpusloom.operators.segments import fetch
from corpusloom.sources import documents as D
from corpusloom.sources.shared import stored


@dataclass(frozen=True)
class Options:
    mode: str = "hybrid"
    match: str = "auto"
    limit: int = 10
    per_document: int = 3
    source: str | None = None
    scope: str | None = None
    media_type: str | None = None
    modified_after: str | None = None
    modified_before: str | None = None
    doc_no: str | None = None
    doc_type: str | None = None
    valid_on: str | None = None
    rerank_top_n: int = 30

    def check(self, text: str) -> None:
        filters.search_arguments(text, self.mode, self.match, self.limit, self.per_document)
        if self.scope:
            filters.folder_scope(self.scope)
        filters.modified(F.lit(None).cast("timestamp"), self.modified_after, self.modified_before)


def visible(documents: DataFrame, validity: DataFrame, o: Options) -> DataFrame:
    """Documents that the options let through, of enabled sources and out of the trash."""
    d = documents.filter(F.col("enabled") & filters.live(F.col("trashed_at")))
    if o.source:
        d = d.filter(filters.of_source(o.source, F.col("source_id"), F.col("source_name")))
    if o.scope and o.scope.startswith("id:"):
        d = d.filter((F.col("kind") == "google_drive") & filters.in_drive_folder(o.scope[3:], F.col("external_id"), F.col("ancestors")))
    elif o.scope:
        d = d.filter(filters.in_folder(F.col("relative_path"), filters.folder_scope(o.scope)))
    if o.media_type:
        d = d.filter(F.col("media_type") == o.media_type)
    if o.modified_after or o.modified_before:
        d = d.filter(filters.modified(F.col("modified_at"), o.modified_after, o.modified_before))
    if o.doc_type:
        d = d.filter(filters.of_type(o.doc_type, F.col("doc_no_key")))
    return filters.valid_on(d, validity, o.valid_on, "id") if o.valid_on else d


#: Columns of a hit that only chunks have.
CHUNK_FIELDS = ("cite_key", "chunk_hash", "ordinal", "start", "stop", "section_path", "ocr")
#: Locations of a body that a hit lists; :func:`all_locations` has every one.
LOCATIONS = 20
#: A notice beside text from a scan, and warnings of a search that falls back.
OCR_NOTICE = "OCR, chưa kiểm chứng: mở trang gốc trước khi trích dẫn"
FALLBACK = "semantic search unavailable; using full_text: "


def _words(index, ids: DataFrame, queries: DataFrame, match: str, pool: int) -> DataFrame:
    """query_id, row_id, rank, matched_via and effective_match: chunks in accent-exact order within their pool, then metadata.

    ``ids`` (document): those in scope. ``auto`` puts complete hits before all others. Texts are fetched for the pool only.
    """
    terms = lexical.literals(queries)
    modes = ("all", "any") if match == "auto" else (match,)

    def best(inverted: lexical.Inverted, of: Column, listed: str) -> list[DataFrame]:
        scored = (lexical.phrase_postings if match == "phrase" else lexical.bm25_postings)(inverted, queries, terms)
        scored = scored.withColumn("document", of.cast("long")).join(ids, "document", "left_semi")
        tops = [lexical.top(scored.filter("matched = n_terms") if m == "all" else scored, pool) for m in modes]
        return [t.select("query_id", "row_id", "rank", F.lit(m).alias("pass"), F.lit(listed).alias("list")) for t, m in zip(tops, modes)]

    tops = [*best(index.inverted, F.substring_index("row_id", "/", 1), "content"), *best(index.inverted_metadata, F.split("row_id", "/")[1], "metadata")]
    found = stored(reduce(DataFrame.unionByName, tops), "search-tops")  # one job, whose passes share the scores
    of = lambda listed: found.filter(F.col("list") == listed)
    texts = fetch(index.chunks.select("row_id", "text"), "row_id", of("content"))
    kinds = fetch(index.metadata.select("row_id", "kind"), "row_id", of("metadata"))
    asked = queries.select("query_id", T.query_terms(F.col("text")).alias("asked"))
    content = of("content").join(texts, "row_id").join(asked, "query_id")
    about = of("metadata").join(kinds, "row_id")
    ranked = stored(
        reduce(
            DataFrame.unionByName,
            [
                lexical.second_list(
                    lexical.accent_resort(content.filter(F.col("pass") == m), F.col("asked")).select("query_id", "row_id", F.col("lexical_rank").alias("rank")), about.filter(F.col("pass") == m)
                ).select("query_id", "row_id", F.col("lexical_rank").alias("rank"), "matched_via", F.lit(m).alias("pass"))
                for m in modes
            ],
        ),
        "search-passes",
    )
    if match != "auto":
        return ranked.withColumnRenamed("pass", "effective_match")
    complete, partial = (ranked.filter(F.col("pass") == m).drop("pass") for m in modes)
    return lexical.merge_auto(complete, partial).select("query_id", "row_id", F.col("merged_rank").alias("rank"), "matched_via", "effective_match")


def _near(index, ids: DataFrame, query_vectors: DataFrame, pool: int) -> DataFrame:
    """query_id, row_id, rank, score: distinct vectors are scored where they are, and find their chunks after the cut."""
    held = index.hashes.join(ids, "document", "left_semi")
    vectors = index.vectors.withColumnRenamed("chunk_hash", "vec_id")
    best = stored(semantic.nearest(vectors, query_vectors, pool, among=held.select(F.col("chunk_hash").alias("vec_id"))), "search-vectors")
    rows = fetch(held, "chunk_hash", best.select(F.col("vec_id").alias("chunk_hash"))).select("row_id", F.col("chunk_hash").alias("vec_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    return best.drop("rank").join(rows, "vec_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= pool).select("query_id", "row_id", "rank", "score")


def _wanted(index, queries: DataFrame, docs: DataFrame, o: Options) -> DataFrame:
    """The first chunks of the documents whose number a query is, or that the options name."""
    number = T.is_number(F.col("text")) if o.doc_no is None else F.lit(False)
    asked = F.when(number, F.trim("text")) if o.doc_no is None else F.lit(o.doc_no)
    keyed = queries.select("query_id", number.alias("number_query"), T.make_key(asked).alias("doc_no_key")).filter("doc_no_key <> ''")
    named = fetch(docs.select(F.col("id").alias("document"), "doc_no_key"), "doc_no_key", keyed)
    found = keyed.join(named, "doc_no_key")
    chunks = fetch(index.chunks.select("document", "ordinal", "row_id"), "document", found)
    order = Window.partitionBy("query_id").orderBy("document", "ordinal")
    return found.join(chunks, "document").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= o.limit).drop("n", "doc_no_key")


def _items(index, rows: DataFrame) -> DataFrame:
    """row_id, document, text, body_hash and the chunk fields of some chunks and metadata entries, fetched by their row_id."""
    chunks = fetch(index.chunks, "row_id", rows).select("row_id", "document", "text", "body_hash", *CHUNK_FIELDS)
    of = [F.lit(None).cast(chunks.schema[c].dataType).alias(c) for c in CHUNK_FIELDS]
    entries = fetch(index.metadata, "row_id", rows).select("row_id", "document", F.concat_ws(": ", "kind", "content").alias("text"), F.lit("").alias("body_hash"), *of)
    return chunks.unionByName(entries)


def search(
    index,
    queries: DataFrame,
    options: Options = Options(),
    query_vectors: DataFrame | None = None,
    rerank: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Hits of every question: query_id, place and the fields of :func:`_project`.

    ``query_vectors``: query_id, query; a question without a vector, or an index without vectors, is answered by
    full text, with a warning in a hybrid search. ``rerank``: a function of the question's and the chunk's text
    to a score column (a pandas UDF for a model).
    """
    o = options
    pool = lexical.pool(o.limit, o.rerank_top_n if rerank else 0)
    docs = visible(index.documents, index.validity, o)
    ids = docs.select(F.col("id").alias("document"))
    if o.mode == "semantic" and query_vectors is None:
        raise ValueError("semantic search unavailable: no query vectors")
    key = queries.schema["query_id"].dataType.simpleString()
    words = index.spark.createDataFrame([], f"query_id {key}, row_id string, rank int, matched_via string, effective_match string")
    near = index.spark.createDataFrame([], f"query_id {key}, row_id string, rank int, score double")
    if o.mode != "semantic":
        words = stored(_words(index, ids, queries, o.match, pool), "search-words")
    if o.mode != "full_text" and query_vectors is not None:
        near = stored(_near(index, ids, query_vectors, pool), "search-near")
    found = stored(fusion.combine(words, near, o.mode), "search-found")
    bodies = stored(_items(index, found).select("row_id", "document", "text", "body_hash", "cite_key"), "search-bodies")
    hits = found.join(bodies, "row_id").withColumn("score", fusion.appendix_penalty(F.col("score"), F.col("cite_key")))
    own = Window.partitionBy("query_id")
    meant = F.max(F.col("semantic_rank").isNotNull()).over(own)
    hits = hits.withColumns({"rank": F.row_number().over(own.orderBy(F.desc("score"), "rank")), "meant": meant}).drop("lexical_rank", "semantic_rank")
    if rerank:
        asked = queries.select("query_id", F.col("text").alias("question"))
        hits = fusion.respread(hits.join(asked, "query_id"), rerank(F.col("question"), F.col("text")), o.rerank_top_n)
        hits = hits.withColumns({"score": F.col("new_score"), "rank": F.col("place") + 1}).drop("place", "new_score", "question")
    else:
        hits = hits.withColumns({"reranked": F.lit(False), "rerank_score": F.lit(None).cast("double")})
    wanted = stored(_wanted(index, queries, docs, o), "search-wanted")
    first = stored(fusion.prioritise(hits.drop("text", "body_hash", "cite_key"), wanted).drop("rank").withColumnRenamed("place", "rank"), "search-first")
    first = first.join(_items(index, first).select("row_id", "body_hash"), "row_id")
    # A page of rows for each question, from here on without the plan that found them.
    chosen = stored(fusion.diversify(first, o.per_document, o.limit).drop("rank"), "search-chosen")
    matches = words.groupBy("query_id").agg(F.max("effective_match").alias("effective_match"))
    return _project(chosen.join(matches, "query_id", "left"), index, ids, o, query_vectors is not None)


def _project(chosen: DataFrame, index, ids: DataFrame, o: Options, asked: bool) -> DataFrame:
    """The fields of a hit, its citation, its first locations, and how its question was answered."""
    docs = fetch(index.documents, "id", chosen.select(F.col("document").alias("id"))).select(
        F.col("id").alias("document"), "source_id", "source_name", "kind", "relative_path", "title", "doc_no", "stable_ref", "content_hash", "external_id", "source_url",
        "media_type", "indexed_at", "modified_at", "metadata", "spans",
    )
    rows = chosen.drop("body_hash").join(_items(index, chosen).drop("document"), "row_id").join(docs, "document")
    touched = D.overlapping(F.col("spans"), F.col("start"), F.col("stop"))
    spans = F.when(F.col("start").isNotNull(), touched).otherwise(F.slice("spans", 1, 0))
    rows = rows.withColumns({"touched": spans, "page": D.pages(spans), "document_ref": F.concat_ws(":", "source_name", "relative_path")})
    provenance = F.transform(F.slice("touched", 1, 4), lambda s: F.struct(F.col("relative_path").alias("path"), s["kind"].alias("kind"), s["locator"].alias("locator")))
    citation = lambda locators: F.struct(
        F.col("source_name").alias("source"), "external_id", F.col("source_url").alias("url"), F.col("relative_path").alias("path"), "content_hash",
        F.col("page.only").alias("page"), "cite_key", F.col("page.first").alias("page_start"), F.col("page.last").alias("page_end"), "doc_no", locators.alias("locators"),
    )
    mode = F.when(F.coalesce("meant", F.lit(False)) | F.lit(o.mode != "hybrid"), o.mode).otherwise("full_text")
    lacking = "the index has no vectors for it" if asked else "no query vectors"
    warnings = F.when((mode == "full_text") & F.lit(o.mode == "hybrid"), F.array(F.lit(FALLBACK + lacking))).otherwise(F.array().cast("array<string>"))
    ocr = F.coalesce("ocr", F.lit(False))
    out = rows.select(
        "query_id", "place", F.round("score", 6).alias("score"), "matched_via", F.coalesce("reranked", F.lit(False)).alias("reranked"), "rerank_score",
        "cite_key", F.col("page.first").alias("page_start"), F.col("page.last").alias("page_end"), ocr.alias("ocr"), F.when(ocr, OCR_NOTICE).alias("ocr_notice"),
        "section_path", F.when(F.col("media_type") == "text/markdown", F.col("section_path")).alias("heading_path"), "doc_no", F.col("source_name").alias("source"),
        F.col("kind").alias("source_kind"), F.col("relative_path").alias("path"), "document_ref", "stable_ref", "chunk_hash", F.when(F.col("body_hash") != "", F.col("body_hash")).alias("body_hash"),
        F.col("ordinal").alias("chunk_ordinal"), F.col("start").alias("start_char"), F.col("stop").alias("end_char"), "indexed_at", F.col("modified_at").alias("source_modified_at"),
        "title", T.snippet(F.col("text")).alias("text"), provenance.alias("provenance"), citation(F.transform(provenance, lambda p: p["locator"])).alias("citation"),
        F.coalesce(F.split(F.col("metadata")["layout_flags"], ","), F.array().cast("array<string>")).alias("layout_flags"), "metadata",
        F.coalesce("effective_match", F.lit("any" if o.match == "auto" else o.match)).alias("effective_match"), mode.alias("effective_mode"), warnings.alias("warnings"),
    )
    bodies = chosen.filter("body_hash <> ''").select("body_hash").distinct().withColumn("row_id", F.col("body_hash"))
    held = fetch(index.places, "body_hash", bodies).join(ids, "document", "left_semi")
    # The first places of each body, then the documents that these are in.
    places = stored(fusion.locations(bodies, held, LOCATIONS), "search-places")
    each = places.select("body_hash", F.posexplode("locations").alias("i", "at")).select("body_hash", "i", "at.*")
    named = fetch(index.documents, "id", each.select(F.col("document").alias("id")))
    listed = _located(each, named).groupBy("body_hash").agg(F.array_sort(F.collect_list(F.struct("i", F.struct(*LOCATION).alias("at")))).alias("l"))
    places = places.select("body_hash", "n_locations").join(listed, "body_hash").select("body_hash", "n_locations", F.transform("l", lambda x: x["at"]).alias("locations"))
    return out.join(places, "body_hash", "left").withColumn("n_locations", F.coalesce("n_locations", F.lit(0).cast("long")))


#: Fields of a location.
LOCATION = ("stable_ref", "document_ref", "source", "path", "chunk_ordinal", "start_char", "end_char", "cite_key")


def _located(places: DataFrame, docs: DataFrame) -> DataFrame:
    """Places (document, ordinal, start, stop, cite_key) with the fields of a location."""
    d = docs.select(F.col("id").alias("document"), "stable_ref", F.concat_ws(":", "source_name", "relative_path").alias("document_ref"), F.col("source_name").alias("source"), F.col("relative_path").alias("path"))
    return places.join(d, "document").withColumns({"chunk_ordinal": F.col("ordinal"), "start_char": F.col("start"), "end_char": F.col("stop")}).drop("start", "stop")


def all_locations(index, hits: DataFrame, options: Options = Options()) -> DataFrame:
    """Every place in scope of the bodies of some hits, as rows: query_id, place and the fields of a location."""
    docs = visible(index.documents, index.validity, options)
    asked = stored(hits.select("query_id", "place", "body_hash"), "search-asked")
    held = fetch(index.places, "body_hash", asked.filter("body_hash <> ''"))
    return _located(fusion.location_rows(asked, held), docs).drop("document", "ordinal")

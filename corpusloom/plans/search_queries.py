"""Catalogue: full-text, vector and hybrid search over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import filters, fusion, lexical, semantic
from corpusloom.plans.registry import inline, query, table
from corpusloom.sources.shared import fresh_path, hadoop, stored

TERMS = "anea thble lying"
ENABLED = ("src0", "src3", "src5", "src7", "src11")
SQL_TOKENS = r"""
tok AS (SELECT doc_id AS row_id, source, regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[\p{L}\p{N}]+') AS terms FROM documents),
sized AS (SELECT row_id, source, terms, len(terms) AS dl FROM tok),
stats AS (SELECT count(*) AS n, avg(dl) AS mean FROM sized),
each AS (SELECT row_id, dl, unnest(terms) AS term FROM sized),
tf AS (SELECT row_id, dl, term, count(*) AS tf FROM each GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
"""
SQL_SCORE = """
part AS (SELECT w.query_id, tf.row_id, w.n_terms,
  w.weight * (CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END)
  * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * tf.dl / mean)) AS s
  FROM tf JOIN wanted w USING (term) JOIN df USING (term), stats),
scored AS (SELECT query_id, row_id, round(-sum(s), 6) AS cost, count(*) AS matched, any_value(n_terms) AS n_terms FROM part GROUP BY ALL)
"""


def _wanted(*queries: tuple[int, str]) -> str:
    rows = ", ".join(f"({i}, '{t}')" for i, t in queries)
    return f"""wanted AS (SELECT query_id, term, count(*) AS weight, count(*) OVER (PARTITION BY query_id) AS n_terms
      FROM (SELECT query_id, unnest(regexp_extract_all(lower(strip_accents(t)), '[\\p{{L}}\\p{{N}}]+')) AS term FROM (VALUES {rows}) q(query_id, t)) GROUP BY query_id, term)"""


def _queries(spark: SparkSession, *queries: tuple[int, str]) -> DataFrame:
    return spark.createDataFrame([(i, t) for i, t in queries], "query_id int, text string")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.token_rows(_docs(spark, sf_dir), "doc_id", "text")


_BUILT: dict[tuple[str, str], tuple[str, lexical.Inverted]] = {}


def _index(spark: SparkSession, sf_dir: str) -> lexical.Inverted:
    """The inverted index of the documents, written below the shared folder once in an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _BUILT:
        folder, index = _BUILT[key]
        fs, path = hadoop(spark, folder)
        if fs.exists(path(folder)):  # else it was cleaned up
            return index
    folder = fresh_path(spark, "inverted")
    _BUILT[key] = folder, lexical.Inverted.write(folder, _tokens(spark, sf_dir))
    return _BUILT[key][1]


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[\p{L}\p{N}]+') AS terms FROM documents)
SELECT count(*) AS documents, round(avg(len(terms)), 6) AS mean, (SELECT count(*) FROM (SELECT DISTINCT doc_id, unnest(terms) FROM t)) AS postings FROM t""")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds the index that the queries below ask, if this application has none yet, and sums it up."""
    index = _index(spark, sf_dir)
    return index.stats.select(F.col("n").alias("documents"), F.round("mean", 6).alias("mean")).crossJoin(F.broadcast(index.postings.agg(F.count(F.lit(1)).alias("postings"))))


@query(f"""WITH {SQL_TOKENS}, {_wanted((1, TERMS))}, {SQL_SCORE},
ok AS (SELECT s.* FROM scored s JOIN documents d ON d.doc_id = s.row_id WHERE d.source IN {ENABLED} AND d.n_chars % 10 <> 0)
SELECT row_id AS doc_id, cost, rank FROM (SELECT *, row_number() OVER (ORDER BY cost, row_id)::INT AS rank FROM ok) WHERE rank <= 20""")
def bm25_any_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any-term BM25 over enabled sources and live rows (a made-up trash flag); statistics of the whole index."""
    scored = lexical.bm25_postings(_index(spark, sf_dir), _queries(spark, (1, TERMS)))
    seen = _docs(spark, sf_dir).filter(F.col("source").isin(*ENABLED) & (F.col("n_chars") % 10 != 0))
    visible = scored.join(seen.select(F.col("doc_id").alias("row_id")), "row_id", "left_semi")
    return lexical.top(visible, 20).select(F.col("row_id").alias("doc_id"), "cost", "rank")


@query(f"""WITH {SQL_TOKENS}, {_wanted((1, TERMS))}, {SQL_SCORE}
SELECT row_id AS doc_id, cost, rank FROM (SELECT *, row_number() OVER (ORDER BY cost, row_id)::INT AS rank FROM scored WHERE matched = n_terms) WHERE rank <= 20""")
def bm25_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lexical.bm25_postings(_index(spark, sf_dir), _queries(spark, (1, TERMS)))
    return lexical.top(scored.filter("matched = n_terms"), 20).select(F.col("row_id").alias("doc_id"), "cost", "rank")


@query(f"""WITH {SQL_TOKENS},
hit AS (SELECT row_id, dl, len(list_filter(generate_series(1, dl - 1), lambda i: terms[i] = 'of' AND terms[i + 1] = 'the')) AS tf FROM sized),
s AS (SELECT count(*) FILTER (tf > 0) AS df FROM hit),
c AS (SELECT row_id, round(-(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END)
  * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)), 6) AS cost FROM hit, s, stats WHERE tf > 0)
SELECT row_id AS doc_id, cost, rank FROM (SELECT *, row_number() OVER (ORDER BY cost, row_id)::INT AS rank FROM c) WHERE rank <= 20""")
def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = lexical.phrase_postings(_index(spark, sf_dir), _queries(spark, (1, "of the")))
    return lexical.top(hits, 20).select(F.col("row_id").alias("doc_id"), "cost", "rank")


@query(f"""WITH {SQL_TOKENS}, q(query_id, p) AS (VALUES (1, ['of', 'the']), (2, ['anea']), (3, ['zzz', 'nothing']), (4, ['die', 'und', 'die'])),
hit AS (SELECT query_id, row_id, dl, len(list_filter(generate_series(1, dl - len(p) + 1), lambda i: terms[i:i + len(p) - 1] = p)) AS tf FROM sized, q),
s AS (SELECT query_id, count(*) AS df FROM hit WHERE tf > 0 GROUP BY query_id),
c AS (SELECT query_id, row_id, round(-(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END)
  * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)), 6) AS cost FROM hit JOIN s USING (query_id), stats WHERE tf > 0)
SELECT query_id, row_id AS doc_id, cost, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cost, row_id)::INT AS rank FROM c) WHERE rank <= 20""")
def phrase_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several phrases in one plan."""
    asked = _queries(spark, (1, "of the"), (2, "anea"), (3, "zzz nothing"), (4, "die und die"))
    return lexical.top(lexical.phrase_postings(_index(spark, sf_dir), asked), 20).select("query_id", F.col("row_id").alias("doc_id"), "cost", "rank")


@query(f"""WITH {SQL_TOKENS},
hit AS (SELECT row_id, dl, len(list_filter(generate_series(1, dl - 1), lambda i: terms[i] = 'of' AND terms[i + 1] = 'the')) AS tf FROM sized),
s AS (SELECT count(*) FILTER (tf > 0) AS df FROM hit),
c AS (SELECT row_id, round(-(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END)
  * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)), 6) AS cost FROM hit, s, stats WHERE tf > 0)
SELECT row_id AS doc_id, cost, rank FROM (SELECT *, row_number() OVER (ORDER BY cost, row_id)::INT AS rank FROM c) WHERE rank <= 20""")
def phrase_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase without an index."""
    return lexical.top(lexical.phrase(_tokens(spark, sf_dir), ["of", "the"]), 20).select(F.col("row_id").alias("doc_id"), "cost", "rank")


@query(f"""WITH {SQL_TOKENS}, {_wanted((1, TERMS), (2, "die und"))}, {SQL_SCORE}
SELECT query_id, row_id AS doc_id, cost, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cost, row_id)::INT AS rank FROM scored) WHERE rank <= 20""")
def bm25_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 without an index."""
    scored = lexical.bm25(_tokens(spark, sf_dir), _queries(spark, (1, TERMS), (2, "die und")))
    return lexical.top(scored, 20).select("query_id", F.col("row_id").alias("doc_id"), "cost", "rank")


@query(f"""WITH {SQL_TOKENS}, {_wanted((1, TERMS), (2, "Réeuxan mentê queeau"), (3, "die und heit die"), (4, "zzz nothing"))}, {SQL_SCORE}
SELECT query_id, row_id AS doc_id, cost, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cost, row_id)::INT AS rank FROM scored) WHERE rank <= 10""")
def bm25_query_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = _queries(spark, (1, TERMS), (2, "Réeuxan mentê queeau"), (3, "die und heit die"), (4, "zzz nothing"))
    return lexical.top(lexical.bm25_postings(_index(spark, sf_dir), batch), 10).select("query_id", F.col("row_id").alias("doc_id"), "cost", "rank")


@query(f"""WITH {SQL_TOKENS}, {_wanted((1, TERMS), (2, "anea zzznothing"))}, {SQL_SCORE},
c AS (SELECT query_id, row_id, rank, 0 AS partial FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cost, row_id) AS rank FROM scored WHERE matched = 
  (SELECT count(*) FROM wanted w WHERE w.query_id = scored.query_id)) WHERE rank <= 20),
p AS (SELECT query_id, row_id, rank, 1 AS partial FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cost, row_id) AS rank FROM scored) WHERE rank <= 20),
b AS (SELECT * FROM c UNION ALL SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.query_id = p.query_id AND c.row_id = p.row_id))
SELECT query_id, row_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY partial, rank)::INT AS merged_rank,
  CASE WHEN min(partial) OVER (PARTITION BY query_id) = 1 THEN 'any' ELSE 'all' END AS effective_match FROM b""")
def bm25_auto_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lexical.bm25_postings(_index(spark, sf_dir), _queries(spark, (1, TERMS), (2, "anea zzznothing")))
    complete = lexical.top(scored.filter("matched = n_terms"), 20).select("query_id", "row_id", "rank")
    merged = lexical.merge_auto(complete, lexical.top(scored, 20).select("query_id", "row_id", "rank"))
    return merged.select("query_id", F.col("row_id").alias("doc_id"), "merged_rank", "effective_match")


@query(f"""WITH {SQL_TOKENS}, {_wanted((1, "réeuxan éch"))}, {SQL_SCORE},
c AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY cost, row_id) AS rank FROM scored) WHERE rank <= 40),
h AS (SELECT c.row_id, c.rank, contains(lower(d.text), 'réeuxan')::INT + contains(lower(d.text), 'éch')::INT AS held FROM c JOIN documents d ON d.doc_id = c.row_id)
SELECT row_id AS doc_id, held, row_number() OVER (ORDER BY held DESC, rank)::INT AS lexical_rank FROM h""")
def accent_resort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accent-exact order within a candidate pool that BM25 cut off before."""
    best = lexical.top(lexical.bm25_postings(_index(spark, sf_dir), _queries(spark, (1, "réeuxan éch"))), lexical.pool(10))
    texts = _docs(spark, sf_dir).select(F.col("doc_id").alias("row_id"), "text")
    ordered = lexical.accent_resort(texts.join(F.broadcast(best), "row_id"), F.array(F.lit("réeuxan"), F.lit("éch")))
    return ordered.select(F.col("row_id").alias("doc_id"), "held", "lexical_rank")


@query(f"""WITH {SQL_TOKENS}, {_wanted((1, "src3 anea"))}, {SQL_SCORE},
c AS (SELECT row_id, rank, 'content' AS via, 0 AS l FROM (SELECT *, row_number() OVER (ORDER BY cost, row_id) AS rank FROM scored) WHERE rank <= 20),
m AS (SELECT doc_id AS row_id, row_number() OVER (ORDER BY doc_id) AS rank, 'automatic' AS via, 1 AS l FROM documents WHERE source = 'src3' QUALIFY rank <= 20),
b AS (SELECT * FROM c UNION ALL SELECT * FROM m)
SELECT row_id AS doc_id, via AS matched_via, row_number() OVER (ORDER BY l, rank)::INT AS lexical_rank FROM b""")
def metadata_second_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata hits (language and source as metadata text) behind every chunk hit."""
    asked = _queries(spark, (1, "src3 anea"))
    chunks = lexical.top(lexical.bm25_postings(_index(spark, sf_dir), asked), 20)
    about = _docs(spark, sf_dir).select("doc_id", F.concat_ws(" ", "lang", "source").alias("content"))
    metadata = lexical.top(lexical.bm25(lexical.token_rows(about, "doc_id", "content"), asked), 20).withColumn("kind", F.lit("automatic"))
    both = lexical.second_list(chunks, metadata)
    return both.select(F.col("row_id").alias("doc_id"), "matched_via", "lexical_rank")


@query(f"WITH {SQL_TOKENS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_stats(_tokens(spark, sf_dir))


@query(f"WITH {SQL_TOKENS} SELECT row_id AS doc_id, dl::BIGINT AS n_tokens, sha256(array_to_string(terms, ' ')) AS digest FROM sized")
def fold_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms of every text, as a digest."""
    return _tokens(spark, sf_dir).select(F.col("row_id").alias("doc_id"), F.size("terms").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", "terms"), 256).alias("digest"))


@query(f"""WITH {SQL_TOKENS}, p AS (SELECT row_id, generate_subscripts(terms, 1) - 1 AS position, unnest(terms) AS term FROM sized)
SELECT term, count(DISTINCT row_id) AS rows, count(*) AS places, sum(position)::BIGINT AS position_sum FROM p GROUP BY term""")
def posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index, summed up by term."""
    lists = lexical.postings(_tokens(spark, sf_dir))
    total = F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a + x)
    return lists.groupBy("term").agg(F.count(F.lit(1)).alias("rows"), F.sum("tf").alias("places"), F.sum(total).alias("position_sum"))


SQL_COSINE = """CASE WHEN sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x))) > 0
  THEN list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]))
  / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x)))) ELSE 0 END"""


def _knn_sql(where: str, k: int) -> str:
    return f"""WITH s AS (SELECT b.vec_id AS query_id, a.vec_id, round(greatest(0, ({SQL_COSINE} + 1) / 2), 6) AS score FROM embeddings a, embeddings b WHERE {where}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) SELECT query_id, vec_id, score, rank FROM r WHERE rank <= {k}"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


@query(_knn_sql("b.vec_id = 7", 20))
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _vectors(spark, sf_dir).filter("vec_id = 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return semantic.nearest(_vectors(spark, sf_dir).select("vec_id", "embedding"), asked, 20)


@query(_knn_sql("b.label = 3", 5))
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _vectors(spark, sf_dir).filter("label = 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return semantic.nearest(_vectors(spark, sf_dir).select("vec_id", "embedding"), asked, 5)


@query(_knn_sql("b.vec_id IN (3, 11)", 10))
def knn_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    asked = v.filter("vec_id IN (3, 11)").orderBy("vec_id").collect()  # two named vectors
    return semantic.nearest_arrow(v, [r["vec_id"] for r in asked], [list(r["embedding"]) for r in asked], 10)


SQL_HYBRID = f"""{SQL_TOKENS}, {_wanted((1, TERMS))}, {SQL_SCORE},
l AS (SELECT * FROM (SELECT row_id, row_number() OVER (ORDER BY cost, row_id) AS lexical_rank FROM scored) WHERE lexical_rank <= 40),
cs AS (SELECT a.vec_id AS row_id, round(greatest(0, ({SQL_COSINE} + 1) / 2), 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 7),
s AS (SELECT * FROM (SELECT row_id, row_number() OVER (ORDER BY score DESC, row_id) AS semantic_rank FROM cs) WHERE semantic_rank <= 40),
f AS (SELECT coalesce(l.row_id, s.row_id) AS row_id, lexical_rank, semantic_rank,
  round(coalesce(1.0 / (60 + lexical_rank), 0) + coalesce(1.0 / (60 + semantic_rank), 0), 6) AS score,
  CASE WHEN semantic_rank IS NULL THEN 'content' WHEN lexical_rank IS NULL THEN 'semantic' ELSE 'content+semantic' END AS matched_via
  FROM l FULL JOIN s ON l.row_id = s.row_id),
fused AS (SELECT *, row_number() OVER (ORDER BY score DESC, lexical_rank NULLS LAST, semantic_rank NULLS LAST, row_id)::INT AS rank FROM f)"""


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.top(lexical.bm25_postings(_index(spark, sf_dir), _queries(spark, (1, TERMS))), lexical.pool(10))
    asked = _vectors(spark, sf_dir).filter("vec_id = 7").select(F.lit(1).alias("query_id"), F.col("embedding").alias("query"))
    near = semantic.nearest(_vectors(spark, sf_dir).select("vec_id", "embedding"), asked, 40)
    return fusion.combine(found, near.withColumnRenamed("vec_id", "row_id"))


@query(f"WITH {SQL_HYBRID} SELECT row_id AS doc_id, lexical_rank::INT AS lexical_rank, semantic_rank::INT AS semantic_rank, matched_via, score, rank FROM fused")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: BM25 and vector search fused by reciprocal ranks."""
    return _hybrid(spark, sf_dir).select(F.col("row_id").alias("doc_id"), "lexical_rank", "semantic_rank", "matched_via", "score", "rank")


@query(f"""WITH {SQL_HYBRID},
h AS (SELECT fused.row_id, fused.rank, fused.score, CASE WHEN fused.rank <= 30 THEN d.n_chars::DOUBLE END AS rerank_score FROM fused JOIN documents d ON d.doc_id = fused.row_id),
o AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN rank <= 30 THEN 0 ELSE 1 END, rerank_score DESC NULLS LAST, rank) - 1 AS place,
  max(score) FILTER (rank <= 30) OVER () AS top, coalesce(max(score) FILTER (rank = 31) OVER (), 0) AS floor, count(*) FILTER (rank <= 30) OVER () AS n FROM h)
SELECT row_id AS doc_id, rank <= 30 AND n > 1 AS reranked, rerank_score,
  CASE WHEN rank <= 30 AND n > 1 THEN round(floor + greatest(top - floor, n * 1e-6) * (n - place) / n, 6) ELSE score END AS new_score FROM o""")
def rerank_respread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reranking with text length as a stand-in model."""
    sizes = _docs(spark, sf_dir).select(F.col("doc_id").alias("row_id"), F.col("n_chars").cast("double").alias("model"))
    out = fusion.respread(_hybrid(spark, sf_dir).join(sizes, "row_id"), F.col("model"))
    return out.select(F.col("row_id").alias("doc_id"), "reranked", "rerank_score", "new_score")


@query("""SELECT sha256(text) AS body_hash, count(*) AS n, array_to_string(list_transform(list(doc_id ORDER BY doc_id), lambda x: x::VARCHAR), ',') AS locations FROM documents GROUP BY 1""")
def duplicate_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every body once, with its number of places and all of them; only ids are listed, so a row of many copies stays small."""
    places = _bodies(spark, sf_dir)
    found = fusion.locations(places.select("body_hash").distinct().withColumn("row_id", F.col("body_hash")), places)
    ids = F.transform("locations", lambda x: x["document"].cast("string"))
    return found.select("body_hash", F.col("n_locations").alias("n"), F.concat_ws(",", ids).alias("locations"))


@query("SELECT doc_id, sha256(text) AS body_hash, min(doc_id) OVER (PARTITION BY text) AS first FROM documents")
def duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of every body as a row: which body a document has, and the first document with it."""
    places = _bodies(spark, sf_dir)
    firsts = stored(places.groupBy("body_hash").agg(F.min("document").alias("first")), "first-places")  # one row for each body, so Spark can split a hot one's places
    return fusion.location_rows(firsts, places).select(F.col("document").alias("doc_id"), "body_hash", "first")


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("document"), F.lit(0).alias("ordinal"), F.sha2("text", 256).alias("body_hash"))


@query(f"""WITH {SQL_HYBRID}
SELECT f.rank, f.row_id AS doc_id, d.source || ':' || 'docs/' || d.doc_id || '.txt' AS document_ref, 'local:' || d.source || ':' || d.doc_id AS stable_ref,
  'local:' || d.source || ':' || d.doc_id || '#c0' AS cite_key, substr(d.text, 1, 1200) AS text, sha256(d.text) AS chunk_hash, f.score, f.matched_via
FROM fused f JOIN documents d ON d.doc_id = f.row_id WHERE f.rank <= 10""")
def hit_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of a hit and its citation, one chunk for each document."""
    d = _docs(spark, sf_dir).withColumnRenamed("doc_id", "row_id")
    ref = F.concat_ws(":", F.lit("local"), "source", "row_id")
    hits = _hybrid(spark, sf_dir).filter("rank <= 10").join(d, "row_id")
    return hits.select(
        "rank", F.col("row_id").alias("doc_id"), F.concat("source", F.lit(":docs/"), "row_id", F.lit(".txt")).alias("document_ref"), ref.alias("stable_ref"),
        F.concat(ref, F.lit("#c0")).alias("cite_key"), T.snippet(F.col("text")).alias("text"), F.sha2("text", 256).alias("chunk_hash"), "score", "matched_via",
    )


# Filters


@query("SELECT doc_id FROM documents WHERE source IN ('src1', 'src12')")
def source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).withColumn("name", F.concat(F.lit("name-"), "source"))
    return d.filter(filters.of_source("src1", F.col("source"), F.col("name")) | filters.of_source("name-src12", F.col("source"), F.col("name"))).select("doc_id")


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-07 12:30:00'")
def date_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(filters.modified(F.col("ts"), "2024-01-05", "2024-01-07T12:30:00Z")).select("event_id")


@query("SELECT page_id FROM pages WHERE regexp_extract(url, '\\.([a-z]+)$', 1) = 'html'")
def media_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.regexp_extract("url", r"\.([a-z]+)$", 1) == "html", "text/html").otherwise("text/plain")
    return table(spark, sf_dir, "pages").withColumn("media_type", kind).filter(F.col("media_type") == "text/html").select("page_id")


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate::DATE <= DATE '1996-06-01' AND o_orderdate::DATE + 90 > DATE '1996-06-01'""")
def valid_on_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders valid on a day, from their date for 90 days."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("effective_from"))
    validity = o.withColumn("effective_to", F.date_add("effective_from", 90))
    return filters.valid_on(o.select("o_orderkey"), validity, "1996-06-01", "o_orderkey")



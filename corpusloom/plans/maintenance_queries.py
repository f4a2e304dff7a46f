"""Catalogue: reads, listings, maintenance, governance, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import filters, governance, maintain, reads
from corpusloom.plans.registry import inline, query, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# Reads and listings


@query("SELECT doc_id, source FROM documents WHERE source > 'src12' OR (source = 'src12' AND doc_id > 100) ORDER BY source, doc_id LIMIT 25")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select(F.col("source").alias("source_id"), F.col("doc_id").alias("id"))
    found, _ = reads.page(rows, 25, reads.cursor("src12", 100))
    return found.select(F.col("id").alias("doc_id"), F.col("source_id").alias("source"))


@query("SELECT d.doc_id, count(turn) AS chunk_count FROM documents d LEFT JOIN conversations c ON c.conv_id = d.doc_id GROUP BY d.doc_id")
def listing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "doc_id")
    return reads.with_chunk_counts(_docs(spark, sf_dir).select("doc_id"), turns, "doc_id")


@query("SELECT conv_id, turn FROM conversations ORDER BY conv_id, turn LIMIT 15 OFFSET 40")
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.offset_page(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id", "turn"], 40, 15)


@query("""WITH b AS (SELECT doc_id, text, least(300, length(text)) AS s, least(least(300, length(text)) + 500, length(text)) AS e FROM documents)
SELECT doc_id, s::INT AS start, e::INT AS stop, CASE WHEN e < length(text) THEN e::INT END AS next_start, substr(text, s + 1, e - s) AS text FROM b""")
def read_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.read(_docs(spark, sf_dir), ["doc_id"], around=550, window=500)


@query("""WITH w AS (SELECT conv_id, turn AS centre FROM conversations WHERE role = 'system')
SELECT c.conv_id, centre, c.turn FROM conversations c JOIN w ON c.conv_id = w.conv_id AND c.turn BETWEEN centre - 2 AND centre + 2""")
def chunk_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document"), F.col("turn").alias("ordinal"), "role")
    near = reads.neighbours(turns, turns.filter("role = 'system'"), 2)
    return near.select(F.col("document").alias("conv_id"), "centre", F.col("ordinal").alias("turn"))


@query("""SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM conversations) AS chunks, (SELECT count(*) FROM embeddings) AS vectors,
(SELECT count(*) FROM labels WHERE quality = 0) AS open_reviews, (SELECT count(DISTINCT source) FROM documents) AS sources""")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name, agg, where="true": table(spark, sf_dir, name).filter(where).agg(agg)
    parts = [
        one("documents", F.count(F.lit(1)).alias("documents")), one("conversations", F.count(F.lit(1)).alias("chunks")),
        one("embeddings", F.count(F.lit(1)).alias("vectors")), one("labels", F.count(F.lit(1)).alias("open_reviews"), "quality = 0"),
        one("documents", F.countDistinct("source").alias("sources")),
    ]
    out = parts[0]
    for p in parts[1:]:  # each is one row
        out = out.crossJoin(p)
    return out


@query("SELECT doc_id, toxic FROM labels WHERE quality = 0 ORDER BY doc_id")
def reviews_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id", "toxic").orderBy("doc_id")


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 50")
def job_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "events").filter("event_type <> 'purchase'").select(F.col("ts").alias("created_at"), F.col("event_id").alias("id"), "event_type")
    return reads.newest_first(jobs, 50).select(F.col("id").alias("event_id"), "event_type")


@query("SELECT user_id, min(ts) AS oldest, min_by(event_id, (ts, event_id)) AS first_event, count(*) AS jobs, sum(value)::BIGINT AS total FROM (SELECT user_id, ts, event_id, round(value)::BIGINT AS value FROM events) GROUP BY user_id")
def job_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("v", F.round("value").cast("long"))
    return e.groupBy("user_id").agg(F.min("ts").alias("oldest"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"), F.count(F.lit(1)).alias("jobs"), F.sum("v").alias("total"))


@query("""SELECT n_nationkey::BIGINT AS document, 'in region' AS relation, r_name AS other, 'out' AS direction FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 1000 + r_regionkey, 'in region', n_name, 'in' FROM nation JOIN region ON n_regionkey = r_regionkey""")
def relationship_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions as documents, membership as the edge."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    docs = n.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("relative_path")).unionByName(
        r.select((F.col("r_regionkey") + 1000).cast("long").alias("id"), F.col("r_name").alias("relative_path"))
    )
    edges = n.select(F.col("n_nationkey").cast("long").alias("source"), (F.col("n_regionkey") + 1000).cast("long").alias("target"), F.lit("in region").alias("relation"))
    return reads.related(docs, edges)


# Maintenance


@query("""SELECT sha256(text) AS chunk_hash, min(doc_id) AS sample FROM documents WHERE sha256(text) NOT IN
(SELECT sha256(d.text) FROM documents d JOIN labels USING (doc_id)) GROUP BY 1""")
def anti_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents without a label, each once."""
    d = _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("chunk_hash"))
    done = d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return maintain.pending(d, done, text="doc_id").select("chunk_hash", F.col("doc_id").alias("sample"))


@query("SELECT count(DISTINCT sha256(text)) AS pending FROM documents WHERE sha256(text) NOT IN (SELECT sha256(d.text) FROM documents d JOIN labels USING (doc_id))")
def pending_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anti_pending(spark, sf_dir).agg(F.count(F.lit(1)).alias("pending"))


@query("SELECT vec_id FROM embeddings WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = embeddings.vec_id)")
def orphan_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id")
    return maintain.orphans(v, table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "vec_id"), "vec_id")


@query("""WITH e AS (SELECT l_orderkey AS a, l_partkey AS b FROM lineitem), d AS (SELECT doc_id AS id, source FROM documents), g AS (SELECT id FROM d WHERE source = 'src4')
SELECT id FROM (SELECT b AS id FROM e WHERE a IN (SELECT id FROM g) UNION SELECT a FROM e WHERE b IN (SELECT id FROM g)) WHERE id NOT IN (SELECT id FROM g)""")
def purge_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stale when a source goes: documents at the far end of its edges (order lines as edges)."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"))
    return maintain.related_ids(_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "source"), edges, "src4")


SNAPSHOTS = """old AS (SELECT 'p/' || doc_id AS path, n_chars AS size, doc_id % 5 AS modified, sha256(text) AS hash FROM documents WHERE doc_id % 7 <> 0),
fresh AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'q/' ELSE 'p/' END || doc_id AS path, n_chars AS size, CASE WHEN doc_id % 13 = 0 THEN 9 ELSE doc_id % 5 END AS modified,
  CASE WHEN doc_id % 26 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS hash FROM documents WHERE doc_id % 17 <> 0),
o1 AS (SELECT size, hash, min(path) AS old_path FROM old WHERE path NOT IN (SELECT path FROM fresh) GROUP BY size, hash HAVING count(*) = 1),
n1 AS (SELECT size, hash, min(path) AS path FROM fresh WHERE path NOT IN (SELECT path FROM old) GROUP BY size, hash HAVING count(*) = 1),
moved AS (SELECT old_path, path FROM o1 JOIN n1 USING (size, hash)),
act AS (SELECT coalesce(f.path, o.path) AS path, CASE WHEN f.path IS NULL AND o.path IN (SELECT old_path FROM moved) THEN 'moved_away' WHEN f.path IS NULL THEN 'deleted'
  WHEN f.path IN (SELECT path FROM moved) THEN 'moved' WHEN f.size = o.size AND f.modified = o.modified THEN 'unchanged' WHEN f.hash = o.hash THEN 'stat_refresh'
  WHEN f.hash IN (SELECT hash FROM old) THEN 'cached_reindex' ELSE 'extract' END AS action FROM old o FULL JOIN fresh f ON o.path = f.path)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An older and a newer listing of the documents: some missing, moved, touched or changed (the listings are the fixture)."""
    d = _docs(spark, sf_dir)
    n = F.col("doc_id")
    old = d.filter(n % 7 != 0).select(F.concat(F.lit("p/"), n).alias("path"), F.col("n_chars").alias("size"), (n % 5).alias("modified"), F.sha2("text", 256).alias("hash"))
    fresh = d.filter(n % 17 != 0).select(
        F.concat(F.when(n % 11 == 0, "q/").otherwise("p/"), n).alias("path"), F.col("n_chars").alias("size"), F.when(n % 13 == 0, 9).otherwise(n % 5).alias("modified"),
        F.sha2(F.when(n % 26 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("hash"),
    )
    return old, fresh


@query(f"WITH {SNAPSHOTS} SELECT path, action FROM act")
def classify_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, fresh = _snapshots(spark, sf_dir)
    return maintain.classify(old, fresh, old.select("hash"))


@query(f"WITH {SNAPSHOTS} SELECT old_path, path FROM moved")
def detect_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.moves(*_snapshots(spark, sf_dir))


@query(f"WITH {SNAPSHOTS} SELECT action, count(*) AS files FROM act GROUP BY action")
def reconcile_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_snapshot(spark, sf_dir).groupBy("action").agg(F.count(F.lit(1)).alias("files"))


@query("SELECT source, lang, (SELECT coalesce(max(doc_id), 0) FROM documents) + row_number() OVER (ORDER BY source || '/' || lang) AS id FROM (SELECT DISTINCT source, lang FROM documents)")
def assign_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids for new rows above the high-water mark."""
    new = _docs(spark, sf_dir).select("source", "lang").distinct().withColumn("k", F.concat_ws("/", "source", "lang"))
    return maintain.assign_ids(_docs(spark, sf_dir).select(F.col("doc_id").alias("id")), new, "k").select("source", "lang", "id")


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY role) AS text FROM (SELECT conv_id, role, trim(max_by(text, turn)) AS text FROM conversations GROUP BY conv_id, role) WHERE text <> '' GROUP BY conv_id")
def corrections_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last text of each role of a conversation, as the last revision of each page."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document"), F.col("role").alias("page"), F.col("turn").alias("id"), "text")
    return maintain.corrections(turns).select(F.col("document").alias("conv_id"), "text")


# Governance


@query("SELECT quality, toxic, count(*) AS reviews FROM labels GROUP BY quality, toxic")
def review_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("reviews"))


@query("SELECT conv_id, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS pages FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'assistant') GROUP BY conv_id")
def layout_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations").filter("role = 'assistant'").groupBy("conv_id").agg(F.sort_array(F.collect_set("turn")).alias("p"))
    return pages.select("conv_id", F.concat_ws(",", F.transform("p", lambda x: x.cast("string"))).alias("pages"))


@query("""SELECT event_type AS source, epoch(TIMESTAMP '2024-01-30 12:00:00')::BIGINT - epoch(date_trunc('second', max(ts)))::BIGINT AS age,
epoch(TIMESTAMP '2024-01-30 12:00:00')::BIGINT - epoch(date_trunc('second', max(ts)))::BIGINT > 1800 AS stale FROM events WHERE ts < TIMESTAMP '2024-01-30 12:00:00' GROUP BY 1""")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as sources, their last event as the last sync, polled every ten minutes, at a fixed clock."""
    e = table(spark, sf_dir, "events").filter(filters.modified(F.col("ts"), before="2024-01-30T12:00:00Z"))
    last = e.groupBy(F.col("event_type").alias("source")).agg(F.max("ts").alias("last_sync_at")).withColumn("poll", F.lit(600))
    return governance.freshness(last, "2024-01-30 12:00:00")


@query("SELECT o_orderkey, CASE WHEN DATE '1996-06-01' < o_orderdate::DATE THEN 'not_yet_effective' WHEN DATE '1996-06-01' >= o_orderdate::DATE + 90 THEN 'expired' ELSE 'valid' END AS status FROM orders")
def validity_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", governance.status_on(F.lit("1996-06-01").cast("date"), start, F.date_add(start, 90)).alias("status"))


# Evaluation: benchmark passages as questions, the documents that hold them as gold


GOLD = """gold AS (SELECT b.item_id AS id, list('d' || d.doc_id ORDER BY d.doc_id) AS gold FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id),
q AS (SELECT b.item_id AS id, coalesce(g.gold, ['none']) AS gold FROM benchmark b LEFT JOIN gold g ON g.id = b.item_id),
r AS (SELECT id, unnest(generate_series(1, 12)) AS rank, gold FROM q),
hit AS (SELECT id, rank, gold, CASE WHEN (rank + id) % 3 = 0 AND rank > id % 12 THEN gold[((rank - 1) % len(gold)) + 1] ELSE 'x' || rank END AS cite_key FROM r WHERE id % 9 <> 0),
seen AS (SELECT id, cite_key, min(rank) AS rank FROM hit WHERE list_contains(gold, cite_key) GROUP BY id, cite_key),
judged AS (SELECT q.id, (SELECT min(rank) FROM seen s WHERE s.id = q.id) AS rank,
  coalesce((SELECT sum(1 / log2(rank + 1)) FROM seen s WHERE s.id = q.id AND rank <= 10), 0) / list_sum(list_transform(generate_series(1, least(len(gold), 10)), lambda i: 1 / log2(i + 1))) AS ndcg,
  gold, EXISTS (SELECT 1 FROM hit WHERE hit.id = q.id) AS any_hit FROM q)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as questions, the documents that hold them as gold; a made-up ranking of 12 results for each."""
    b, d = table(spark, sf_dir, "benchmark"), _docs(spark, sf_dir)
    held = governance.holders(b, d.select("doc_id", F.col("text").alias("whole"))).groupBy("item_id").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    q = b.join(held, "item_id", "left").select(F.col("item_id").alias("id"), F.coalesce(F.transform("ids", lambda x: F.concat(F.lit("d"), x)), F.array(F.lit("none"))).alias("gold"))
    r = q.filter("id % 9 <> 0").withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(12))))
    key = F.when(((F.col("rank") + F.col("id")) % 3 == 0) & (F.col("rank") > F.col("id") % 12), F.get("gold", (F.col("rank") - 1) % F.size("gold"))).otherwise(F.concat(F.lit("x"), "rank"))
    known = d.select(F.concat(F.lit("d"), "doc_id").alias("cite_key"))
    return governance.judge(q, r.select("id", "rank", key.alias("cite_key")), known)


@query(f"""WITH {GOLD} SELECT count(*) AS count, round(avg(CASE WHEN rank <= 1 THEN 1 ELSE 0 END), 4) AS recall_1, round(avg(CASE WHEN rank <= 3 THEN 1 ELSE 0 END), 4) AS recall_3,
round(avg(CASE WHEN rank <= 10 THEN 1 ELSE 0 END), 4) AS recall_10, round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0 END), 4) AS mrr_10, round(avg(ndcg), 4) AS ndcg_10 FROM judged""")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.metrics(_judged(spark, sf_dir))


@query(f"""WITH {GOLD} SELECT failure, count(*) AS questions FROM (SELECT CASE WHEN rank > 10 THEN 'ranked_below_10' WHEN gold = ['none'] THEN 'gold_not_indexed'
WHEN NOT any_hit THEN 'no_results' ELSE 'wrong_document' END AS failure FROM judged WHERE rank IS NULL OR rank > 10) GROUP BY failure""")
def eval_failure_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).filter("failure is not null").groupBy("failure").agg(F.count(F.lit(1)).alias("questions"))

"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import alignment, bpe, exact_dedup, jaccard, mixing, negatives, simhash, suffix_dedup, token_rollup, topk, toxicity, url_filter, warc
from corpusloom.llm.common import stored, table, text_or_empty, word_count


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def _change(rows: DataFrame, op: str, version: str, n: str) -> DataFrame:
    return rows.select("doc_id", F.lit(version).alias("version"), F.lit(op).alias("op"), "source", "lang", F.col(n).alias("n_tokens"))


def _one_per_id(sizes: DataFrame) -> DataFrame:
    """Rows of one doc_id (null too) are one document: the one with the largest digest, source and language counts."""
    rest = [c for c in sizes.columns if c not in ("doc_id", "digest", "source", "lang")]
    return sizes.groupBy("doc_id").agg(F.max(F.struct("digest", "source", "lang", *rest)).alias("r")).select("doc_id", "r.*")


def _copies(sizes: DataFrame) -> DataFrame:
    """Documents whose text one with a smaller id has too (a null id sorts last)."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id")
    firsts = sizes.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = stored(firsts.select("digest", F.col("first.doc_id").alias("first_id")), "token-firsts")
    return sizes.join(firsts, "digest").filter(~F.col("doc_id").eqNullSafe(F.col("first_id"))).drop("first_id", "n")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and byte-level BPE tokens of all documents: inserts (the tokens estimated by bytes), a revision by
    true counts, the deletion of copies, and replays of two batches. A ledger knows one document for each id, so rows
    that share an id (a null one too) count as one document, the one with the largest digest, source and language."""
    docs = table(spark, sf_dir, "documents")
    sized = docs.select(
        F.col("doc_id").cast("long"), "source", "lang", "text", word_count("text").alias("words"),
        (F.octet_length(text_or_empty("text")).cast("long") / 4).cast("long").alias("estimate"), F.sha2(text_or_empty("text"), 256).alias("digest"),
    )
    counted = bpe.token_counts(sized, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, name="tokens")
    sizes = stored(_one_per_id(counted), "token-sizes")
    copies = stored(_copies(sizes), "token-copies")
    batches = {
        "words-1": _change(sizes, "insert", "words@1", "words"),
        "bpe-1": _change(sizes, "insert", "byte_bpe_50k", "estimate"),
        "bpe-2": _change(sizes, "revise", "byte_bpe_50k", "tokens"),
        "copies": _change(copies, "delete", "words@1", "words").unionByName(_change(copies, "delete", "byte_bpe_50k", "tokens")),
    }
    rollup = token_rollup.TokenRollup(spark)
    for name in [*batches, "copies", "words-1"]:
        rollup.apply(name, batches[name])
    return rollup.totals()


def token_rollup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rollup over counts that SQL knows: words and bytes."""
    docs = table(spark, sf_dir, "documents")
    sizes = docs.select(
        F.col("doc_id").cast("long"), "source", "lang", word_count("text").alias("words"),
        F.octet_length(text_or_empty("text")).cast("long").alias("bytes"), F.sha2(text_or_empty("text"), 256).alias("digest"),
    )
    sizes = stored(_one_per_id(sizes), "token-sizes")
    copies = stored(_copies(sizes), "token-copies")
    rollup = token_rollup.TokenRollup(spark)
    rollup.apply("words-1", _change(sizes, "insert", "words@1", "words"))
    rollup.apply("bytes-1", _change(sizes, "insert", "bytes@1", "words"))
    rollup.apply("copies", _change(copies, "delete", "words@1", "words").unionByName(_change(copies, "delete", "bytes@1", "words")))
    rollup.compact()
    rollup.apply("bytes-2", _change(sizes.join(copies.select("doc_id"), "doc_id", "left_anti"), "revise", "bytes@1", "bytes"))
    rollup.apply("copies", _change(copies, "delete", "words@1", "words"))
    return rollup.totals()


TOKEN_ROLLUP_SQL = """
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM d),
v AS (SELECT source, lang, 'words@1' AS version, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS tokens FROM k WHERE n = 1
  UNION ALL SELECT source, lang, 'bytes@1', octet_length(encode(text)) FROM k WHERE n = 1)
SELECT source, lang, version, count(*) AS docs, sum(tokens)::BIGINT AS tokens FROM v GROUP BY ALL
"""


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="high")


OP5_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.text) AS text_sha256
FROM d JOIN g ON d.text = g.text
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = stored(docs.select("doc_id", "source", word_count("text").alias("words")), "mix-words")  # counted once
    return mixing.mix(sized, F.array("source"), size_col="words").select("row.doc_id", "size", "source_size", "target", "taken")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(warc.read(warc.write(table(spark, sf_dir, "pages"))))


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_table(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.build_index(spark, url_filter.RULES))


OP10_SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
cut AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id,
  translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM cut),
fit AS (SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
  row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS n
  FROM p LEFT JOIN rules r ON (p.host = r.host OR suffix(p.host, '.' || r.host)) AND prefix(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE n = 1
"""


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.withColumn("groups_sha256", digest).drop("groups")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same,
    list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 100 * s.score BETWEEN 30 * positive_score AND 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_toxicity": op2_toxicity,
        "op3_token_counts": op3_token_counts,
        "token_rollup_words": token_rollup_words,
        "op4_simhash": op4_simhash,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_mixing": op6_mixing,
        "op7_warc": op7_warc,
        "op8_exact_topk": op8_exact_topk,
        "op9_bpe": op9_bpe,
        "op10_url_filter": op10_url_filter,
        "op11_jaccard": op11_jaccard,
        "op12_alignment": op12_alignment,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"token_rollup_words": TOKEN_ROLLUP_SQL, "op5_exact_dedup": OP5_SQL, "op7_warc": OP7_SQL, "op8_exact_topk": OP8_SQL, "op10_url_filter": OP10_SQL, "op13_hard_negatives": OP13_SQL}

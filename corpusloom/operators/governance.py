"""Validity, warnings, coverage, freshness and retrieval evaluation for whole tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

CUTS = (1, 3, 10)


def status_on(day: Column, start: Column, end: Column) -> Column:
    """unknown, not_yet_effective, expired or valid on a day; the interval is [start, end)."""
    return F.when(start.isNull(), "unknown").when(day < start, "not_yet_effective").when(end.isNotNull() & (day >= end), "expired").otherwise("valid")


#: Kinds of the fields of a validity record.
VALIDITY = {"effective_from": "day", "effective_to": "day", "status_checked_on": "day", "replaced_by": "text", "status_source": "text", "amended_by": "list"}


def validity_fields(fields: dict) -> dict:
    """A whole validity record from some fields, or an error: empty ones are null, days have the
    form YYYY-MM-DD, and an end needs an earlier start."""
    fits = {
        "day": lambda x: isinstance(x, str) and re.fullmatch(r"\d{4}-\d{2}-\d{2}", x),
        "text": lambda x: isinstance(x, str),
        "list": lambda x: isinstance(x, list) and all(isinstance(y, str) for y in x),
    }
    for name, value in fields.items():
        if name not in VALIDITY:
            raise ValueError(f"unknown validity field: {name}")
        if value and not fits[VALIDITY[name]](value):
            raise ValueError(f"{name} is no {VALIDITY[name]}: {value!r}")
    record = {name: fields.get(name) or ([] if kind == "list" else None) for name, kind in VALIDITY.items()}
    if record["effective_to"] and not (record["effective_from"] or "9") < record["effective_to"]:
        raise ValueError("the (exclusive) end needs a start before it")
    return record


def expired_citations(documents: DataFrame, validity: DataFrame, day: str) -> DataFrame:
    """document, cited: numbers a document's text cites whose validity has ended on the day.

    documents: id, doc_no, text; of several documents with a number the lowest id counts.
    """
    cited = documents.select("id", F.explode(T.find_numbers(F.col("text"))).alias("number")).withColumn("key", T.make_key(F.col("number")))
    targets = documents.select(F.col("id").alias("target"), "doc_no", T.make_key(F.col("doc_no")).alias("key")).join(
        validity.select(F.col("id").alias("target"), "effective_from", "effective_to"), "target"
    )
    hits = cited.join(targets, "key").filter("id <> target").groupBy("id", "key").agg(F.min_by(F.struct("doc_no", "effective_from", "effective_to"), "target").alias("t"))
    over = status_on(F.lit(day).cast("date"), F.col("t.effective_from"), F.col("t.effective_to")) == "expired"
    return hits.filter(over).select(F.col("id").alias("document"), F.col("t.doc_no").alias("cited")).distinct()


def same_bytes(documents: DataFrame) -> DataFrame:
    """id and the number of other documents with its content hash."""
    own = Window.partitionBy("content_hash")
    return documents.select("id", (F.count(F.lit(1)).over(own) - 1).alias("copies")).filter("copies > 0")


def shared_content(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """id and the number of different document numbers (none is one too) of files that share a chunk body but not all bytes.

    A document meets the different (number, bytes) pairs of its bodies, not every copy of them.
    """
    c = chunks.select(F.col("document").alias("id"), "body_hash").distinct().join(documents.select("id", "doc_no", "content_hash"), "id")
    other = c.select("body_hash", F.coalesce("doc_no", F.lit("\0")).alias("o_no"), F.col("content_hash").alias("o_hash")).distinct()
    pairs = c.join(other, "body_hash").filter("content_hash <> o_hash")
    return pairs.select("id", "o_no").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("same_content"))


def shares_content(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """id of files with a chunk body that a file of other bytes has too; one row for each body is joined."""
    c = chunks.select(F.col("document").alias("id"), "body_hash").join(documents.select("id", "content_hash"), "id")
    mixed = c.groupBy("body_hash").agg((F.min("content_hash") < F.max("content_hash")).alias("mixed")).filter("mixed")
    return c.join(mixed.select("body_hash"), "body_hash", "left_semi").select("id").distinct()


def document_warnings(documents: DataFrame, validity: DataFrame, chunks: DataFrame, reviews: DataFrame, day: str) -> DataFrame:
    """id, status and the warning codes of every document, at once."""
    d = F.lit(day).cast("date")
    flag = lambda rows, name: rows.select("id").distinct().withColumn(name, F.lit(True))
    x = documents.join(validity.select("id", "effective_from", "effective_to", "replaced_by"), "id", "left")
    x = x.join(flag(same_bytes(documents), "copies"), "id", "left").join(flag(shares_content(documents, chunks), "shares"), "id", "left")
    x = x.join(flag(expired_citations(documents, validity, day).withColumnRenamed("document", "id"), "cites"), "id", "left")
    x = x.join(flag(chunks.filter("ocr").withColumnRenamed("document", "id"), "scanned"), "id", "left")
    x = x.join(flag(reviews.filter("status = 'open'").withColumnRenamed("document", "id"), "open"), "id", "left")
    x = x.withColumn("status", status_on(d, F.col("effective_from"), F.col("effective_to")))
    codes = [
        (F.col("status") == "unknown", "UNKNOWN_VALIDITY"), (~F.col("status").isin("unknown", "valid"), "NOT_VALID_ON_DATE"),
        (F.coalesce("replaced_by", F.lit("")) != "", "REPLACED_BY"), (F.col("cites"), "CITES_EXPIRED"), (F.col("copies"), "DUPLICATE_SHA256"),
        (F.col("shares"), "DUPLICATE_CONTENT"), (F.col("scanned"), "OCR_UNVERIFIED"), (F.col("open"), "OPEN_REVIEWS"),
    ]
    return x.select("id", "status", F.array_compact(F.array(*[F.when(c, code) for c, code in codes])).alias("warnings"))


def coverage(sources: DataFrame, files: DataFrame) -> DataFrame:
    """source, status, failed, pending of every source.

    sources: source, listing_complete, running; files: source, status (pending, stale or unindexed), stage.
    """
    counts = files.groupBy("source").agg(
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(F.col("status") != "pending").alias("failed"),
        F.count_if(F.col("stage") == "listing").alias("listing"),
    )
    x = sources.join(counts, "source", "left").fillna(0, ["pending", "failed", "listing"])
    status = (
        F.when((F.col("failed") > 0) | (F.col("listing") > 0), "partial")
        .when((F.col("pending") > 0) | F.col("running"), "pending")
        .when(F.col("listing_complete"), "complete")
        .otherwise("unknown")
    )
    return x.select("source", status.alias("status"), "failed", "pending")


def freshness(sources: DataFrame, now: str) -> DataFrame:
    """source, age in seconds, stale: no sync for three poll intervals (or ever)."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last_sync_at")
    return sources.select("source", age.alias("age"), (age.isNull() | (age > 3 * F.col("poll"))).alias("stale"))


def gold_match(cite_key: Column, gold: Column) -> Column:
    """A gold key accepts itself and its clauses."""
    return (cite_key == gold) | F.startswith(cite_key, F.concat(gold, F.lit("-khoan-")))


#: Words beside each other by which passages and texts are brought together, and passages up to which a text's grams are compared with them where it is.
GRAM, LITERALS = 5, 1000


def holders(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """item_id, doc_id of every text (doc_id, whole) that holds a passage (item_id, text) as it is.

    A passage's words but the first and last, which may be parts of words in the text, are words of the text too. So
    the two meet by a hash of the first ``GRAM`` of them, or of all if they are fewer (an equi-join), and ``contains``
    decides. Only passages of one or two words are sought in every text.
    """
    words = lambda c: F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    cut = passages.select("item_id", "text", words(F.col("text")).alias("w")).withColumn("g", F.least(F.size("w") - 2, F.lit(GRAM)))
    keyed = cut.filter("g > 0").select("item_id", "text", "g", F.xxhash64(F.slice("w", F.lit(2), F.col("g"))).alias("gram"))
    few = [r["gram"] for r in keyed.select("gram").distinct().limit(LITERALS + 1).collect()]
    split = texts.select("doc_id", "whole", words(F.col("whole")).alias("w"))
    found = []
    for r in keyed.select("g").distinct().collect():  # at most GRAM lengths
        g = r["g"]
        each = F.transform(F.sequence(F.lit(1), F.size("w") - g + 1), lambda i: F.xxhash64(F.slice("w", i, g)))
        each = F.when(F.size("w") >= g, F.array_distinct(F.filter(each, lambda x: x.isin(*few)) if len(few) <= LITERALS else each))
        pairs = split.select("doc_id", "whole", F.explode(each).alias("gram")).join(keyed.filter(F.col("g") == g).select("item_id", "text", "gram"), "gram")
        found.append(pairs.filter(F.contains("whole", "text")).select("item_id", "doc_id"))
    short = cut.filter("g <= 0").select("item_id", "text")
    if not short.isEmpty():
        found.append(texts.join(short, F.contains("whole", "text")).select("item_id", "doc_id"))
    return reduce(DataFrame.unionByName, found).distinct() if found else texts.sparkSession.createDataFrame([], "item_id long, doc_id long")


def judge(questions: DataFrame, results: DataFrame, known: DataFrame) -> DataFrame:
    """For each question: rank of the first gold hit, nDCG@10, failure group (null if found in the first ten).

    questions: id, gold (array of keys) and columns to group by, which are kept; results: id, rank, cite_key; known: cite_key of every chunk.
    Each result takes the first gold that is left and that it matches, in rank order.
    """
    more = [c for c in questions.columns if c not in ("id", "gold", "rank", "ndcg", "failure")]
    q = questions.select("id", "gold", F.size("gold").alias("n_gold"), *more)
    listed = results.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "cite_key"))).alias("hits"))
    x = q.join(listed, "id", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<rank:int,cite_key:string>>")))
    hit = lambda h, gold: F.exists(gold, lambda g: gold_match(h["cite_key"], g))
    first = F.get(F.filter("hits", lambda h: hit(h, F.col("gold"))), 0)["rank"]
    start = F.struct(F.col("gold").alias("left"), F.lit(0.0).alias("gain"))

    def take(s: Column, h: Column) -> Column:
        g = F.get(F.filter(s["left"], lambda k: gold_match(h["cite_key"], k)), 0)
        at = F.array_position(s["left"], g).cast("int")
        rest = F.when(g.isNull(), s["left"]).otherwise(F.concat(F.slice(s["left"], 1, at - 1), F.slice(s["left"], at + 1, F.size(s["left"]))))
        gain = F.when(g.isNotNull() & (h["rank"] <= 10), 1 / F.log2(h["rank"] + 1)).otherwise(0.0)
        return F.struct(rest.alias("left"), (s["gain"] + gain).alias("gain"))

    dcg = F.aggregate(F.filter("hits", lambda h: h["rank"] <= 10), start, take)["gain"]
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_gold", F.lit(10))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    held = q.select("id", F.explode("gold").alias("g")).join(known.select(F.col("cite_key").alias("k")).distinct(), F.col("k") == F.col("g"), "left_semi").select("id").distinct()
    x = x.withColumns({"rank": first, "ndcg": F.when(F.col("n_gold") > 0, dcg / ideal).otherwise(0.0)}).join(held.withColumn("indexed", F.lit(True)), "id", "left")
    stem = lambda k: F.substring_index(k, "#", 1)
    right = F.arrays_overlap(F.transform("gold", stem), F.transform("hits", lambda h: stem(F.coalesce(h["cite_key"], F.lit("")))))
    group = (
        F.when(F.col("rank") <= max(CUTS), F.lit(None)).when(F.col("rank").isNotNull(), "ranked_below_10").when(F.col("indexed").isNull(), "gold_not_indexed")
        .when(F.size("hits") == 0, "no_results").when(right, "wrong_chunk_right_document").otherwise("wrong_document")
    )
    return x.select("id", "rank", "ndcg", group.alias("failure"), *more)


def has_diacritics(question: Column) -> Column:
    """Whether a question has a letter with a mark, as one typed with accents has."""
    return T.fold(F.lower(question)) != F.lower(question)


def metrics(judged: DataFrame, by: list[str] = ()) -> DataFrame:
    """count, recall@1/3/10, MRR@10 and nDCG@10, rounded to four digits."""
    rank = F.col("rank")
    recall = [F.round(F.avg(F.when(rank <= k, 1.0).otherwise(0.0)), 4).alias(f"recall_{k}") for k in CUTS]
    mrr = F.round(F.avg(F.when(rank <= 10, 1 / rank).otherwise(0.0)), 4).alias("mrr_10")
    return judged.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), *recall, mrr, F.round(F.avg("ndcg"), 4).alias("ndcg_10"))


PUBLIC = ("source", "status", "failed", "pending")


def redacted(rows: DataFrame, allowed: tuple[str, ...] = PUBLIC) -> DataFrame:
    """Only the columns that a reader may see."""
    return rows.select([c for c in rows.columns if c in allowed])

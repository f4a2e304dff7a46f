"""Fusing, reranking, prioritising and diversifying ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
APPENDIX = 0.85  # forms rank below articles


def rrf(*ranks: Column) -> Column:
    """Reciprocal rank fusion; a missing rank adds nothing."""
    return sum((F.coalesce(1 / (RRF_K + r), F.lit(0.0)) for r in ranks), F.lit(0.0))


def combine(lexical: DataFrame, semantic: DataFrame, mode: str = "hybrid", digits: int = 6) -> DataFrame:
    """query_id, row_id, lexical_rank, semantic_rank, matched_via, score, rank.

    ``lexical``: query_id, row_id, rank and, where hits are not all of content, matched_via;
    ``semantic``: query_id, row_id, rank, score. Equal scores keep lexical order, then semantic
    order. A hybrid query without any semantic row is scored as a full-text one.
    """
    if mode not in ("hybrid", "full_text", "semantic"):
        raise ValueError(f"unknown mode: {mode}")
    named = F.col("matched_via") if "matched_via" in lexical.columns else F.lit("content")
    a = lexical.select("query_id", "row_id", F.col("rank").alias("lexical_rank"), named.alias("listed"))
    b = semantic.select("query_id", "row_id", F.col("rank").alias("semantic_rank"), F.col("score").alias("cosine_score"))
    both = a.join(b, ["query_id", "row_id"], "full_outer")
    via = F.when(F.col("semantic_rank").isNull() | (F.col("listed") != "content"), F.col("listed")).when(F.col("lexical_rank").isNull(), "semantic").otherwise("content+semantic")
    alone = F.coalesce(1 / F.col("lexical_rank"), F.lit(0.0))
    meant = F.max(F.col("semantic_rank").isNotNull()).over(Window.partitionBy("query_id"))
    raw = {
        "hybrid": F.when(meant, rrf(F.col("lexical_rank"), F.col("semantic_rank"))).otherwise(alone),
        "full_text": alone,
        "semantic": F.coalesce("cosine_score", F.lit(0.0)),
    }[mode]
    scored = both.select("query_id", "row_id", "lexical_rank", "semantic_rank", via.alias("matched_via"), F.round(raw, digits).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("lexical_rank"), F.asc_nulls_last("semantic_rank"), "row_id")
    return scored.withColumn("rank", F.row_number().over(order))


def appendix_penalty(score: Column, cite_key: Column, digits: int = 6) -> Column:
    return F.when(F.contains(cite_key, F.lit("#phu-luc")), F.round(score * APPENDIX, digits)).otherwise(score)


def respread(ranked: DataFrame, rerank_score: Column, top_n: int = 30, digits: int = 6) -> DataFrame:
    """Reorders the first ``top_n`` by ``rerank_score`` and spreads their scores above the tail's first score.

    ``ranked``: query_id, row_id, score, rank. Adds reranked and new_score.
    """
    own = Window.partitionBy("query_id")
    head = F.col("rank") <= top_n
    x = ranked.withColumn("rerank_score", F.when(head, rerank_score))
    x = x.withColumns(
        {
            "top": F.max(F.when(head, F.col("score"))).over(own),
            "floor": F.coalesce(F.max(F.when(F.col("rank") == top_n + 1, F.col("score"))).over(own), F.lit(0.0)),
            "n": F.sum(head.cast("int")).over(own),
            "place": F.row_number().over(own.orderBy(F.when(head, 0).otherwise(1), F.desc("rerank_score"), "rank")) - 1,
        }
    )
    span = F.greatest(F.col("top") - F.col("floor"), F.col("n") * 1e-6)
    spread = F.round(F.col("floor") + span * (F.col("n") - F.col("place")) / F.col("n"), digits)
    return x.withColumn("new_score", F.when(head & (F.col("n") > 1), spread).otherwise(F.col("score"))).withColumn("reranked", head & (F.col("n") > 1)).drop("top", "floor", "n")


def prioritise(results: DataFrame, wanted: DataFrame, inject: int = 3) -> DataFrame:
    """Chunks of a wanted document first: place in each query, with the other columns of ``results``.

    ``results``: query_id, row_id, document, rank, score, matched_via. ``wanted``: query_id, row_id,
    document, ordinal and number_query, of the documents with the number asked for. A query that is a
    number puts all of them first (with score 1); a number given beside it moves their hits up, or
    brings in the first ``inject`` if there are none.
    """
    of = wanted.select("query_id", "document").distinct().withColumn("is_wanted", F.lit(True))
    marked = results.join(of, ["query_id", "document"], "left").withColumn("is_wanted", F.coalesce("is_wanted", F.lit(False)))
    own = marked.withColumns({"priority": F.when(F.col("is_wanted"), 1).otherwise(2), "within": F.col("rank")}).drop("is_wanted")
    met = marked.filter("is_wanted").select("query_id").distinct().withColumn("met", F.lit(True))
    first = wanted.withColumn("within", F.row_number().over(Window.partitionBy("query_id").orderBy("document", "ordinal")))
    first = first.join(met, "query_id", "left").filter(F.col("number_query") | (F.col("met").isNull() & (F.col("within") <= inject)))
    added = first.select("query_id", "row_id", "document", F.lit(1.0).alias("score"), F.lit("doc_no").alias("matched_via"), F.lit(0).alias("priority"), "within")
    both = own.unionByName(added, allowMissingColumns=True)
    return both.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("priority", "within"))).drop("priority", "within")


def diversify(ranked: DataFrame, per_document: int, limit: int) -> DataFrame:
    """Greedy choice in rank order: a body once, a document at most ``per_document`` times, ``limit`` in all.

    ``ranked``: query_id, rank, row_id, document, body_hash and columns that are carried along; a query's
    candidates are a page of results (a few hundred at most), folded in order.
    """
    fields = ["rank", *[c for c in ranked.columns if c not in ("query_id", "rank")]]
    listed = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("hits"))
    start = F.slice("hits", 1, 0)

    def step(chosen: Column, x: Column) -> Column:
        fresh = ~F.coalesce(F.exists(chosen, lambda c: c["body_hash"] == x["body_hash"]), F.lit(False)) | (F.coalesce(x["body_hash"], F.lit("")) == "")
        room = F.size(F.filter(chosen, lambda c: c["document"] == x["document"])) < per_document
        return F.when((F.size(chosen) < limit) & fresh & room, F.concat(chosen, F.array(x))).otherwise(chosen)

    chosen = listed.select("query_id", F.aggregate("hits", start, step).alias("hits"))
    return chosen.select("query_id", F.posexplode("hits").alias("place", "hit")).select("query_id", (F.col("place") + 1).alias("place"), "hit.*")


def location_rows(selected: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every chunk with the body of a selected one: the selection's key columns and the chunk's.

    ``selected``: body_hash and key columns; ``chunks``: body_hash, document, ordinal and others.
    """
    return selected.filter("body_hash <> ''").join(chunks, "body_hash")


def locations(selected: DataFrame, chunks: DataFrame, first: int | None = None) -> DataFrame:
    """row_id, body_hash, n_locations, locations: the chunks with a selected body in document order.

    ``selected``: row_id, body_hash (one row each); ``chunks``: document, ordinal, body_hash and others. With
    ``first``, a body that very many chunks have lists only that many of them (:func:`location_rows` has all).
    """
    found = location_rows(selected, chunks)
    place = [c for c in chunks.columns if c not in ("body_hash", "document", "ordinal")]
    each = F.array_sort(F.collect_list(F.struct("document", "ordinal", *place))).alias("locations")
    if first is None:
        return found.groupBy("row_id", "body_hash").agg(F.count(F.lit(1)).alias("n_locations"), each)
    listed = found.withColumn("__n", F.row_number().over(Window.partitionBy("row_id", "body_hash").orderBy("document", "ordinal"))).filter(F.col("__n") <= first)
    counts = found.groupBy("row_id", "body_hash").agg(F.count(F.lit(1)).alias("n_locations"))
    return counts.join(listed.groupBy("row_id", "body_hash").agg(each), ["row_id", "body_hash"])

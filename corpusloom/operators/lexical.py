"""Ranked full-text search: tokens, postings, BM25, match modes, accent-exact order.

Every operator takes a table of queries and keys its result by ``query_id``, so that one
query and a batch are the same job. Statistics are those of the whole index: they are made
before any filter, so rows that a filter hides still count.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.batches import pieces

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6  # stands for an idf of zero or less
BLOCK_ROWS = 512  # rows whose postings are made together


def token_rows(rows: DataFrame, id_col: str, *text_cols: str) -> DataFrame:
    """row_id, terms (all columns), parts (one token array for each column)."""
    parts = [T.tokens(F.coalesce(F.col(c), F.lit(""))) for c in text_cols]
    return rows.select(F.col(id_col).alias("row_id"), F.array(*parts).alias("parts")).withColumn("terms", F.flatten("parts"))


def postings(tokens: DataFrame) -> DataFrame:
    """term, row_id, tf, positions, dl (terms of the row): the inverted index.

    Positions run on from column to column with a gap, so that no phrase spans two columns.
    """
    return _exploded(blocks(tokens))


def blocks(tokens: DataFrame) -> DataFrame:
    """The inverted index in blocks of some rows: term, words (its places), row_ids, dls, positions (arrays side by side).

    A block's words are sorted by (row, term) as one array of numbers, so its time goes with its words
    however long a row is; nothing is exchanged, as a row's words are at one place.
    """
    kind = tokens.schema["row_id"].dataType.simpleString()
    return tokens.select("row_id", "parts").mapInArrow(_invert, f"term string, words long, row_ids array<{kind}>, dls array<int>, positions array<array<int>>")


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, BLOCK_ROWS):
        columns = b.column(1).flatten()
        words = columns.flatten()
        if not len(words):
            continue
        of_row = np.repeat(np.arange(len(b)), b.column(1).value_lengths().to_numpy(zero_copy_only=False))  # columns to rows
        first = np.searchsorted(of_row, np.arange(len(b)))  # a row's first column
        of_column = np.repeat(np.arange(len(columns)), columns.value_lengths().to_numpy(zero_copy_only=False))  # words to columns
        row = of_row[of_column]
        dl = np.bincount(row, minlength=len(b))
        position = np.arange(len(words)) - (np.cumsum(dl) - dl)[row] + of_column - first[row]
        named = words.dictionary_encode()
        key = named.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(b) + row
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        begin = np.flatnonzero(np.diff(sorted_key, prepend=-1))  # a posting's first word
        term, at = np.divmod(sorted_key[begin], len(b))
        cut = np.flatnonzero(np.diff(term, prepend=-1))  # a term's first posting
        ends = lambda starts, n: pa.array(np.append(starts, n), pa.int32())
        lists = lambda values: pa.ListArray.from_arrays(ends(cut, len(begin)), values)
        places = pa.ListArray.from_arrays(ends(begin, len(words)), pa.array(position[order], pa.int32()))
        places_of = np.diff(np.append(begin, len(words))[np.append(cut, len(begin))])
        columns = [named.dictionary.take(pa.array(term[cut])), pa.array(places_of, pa.int64()), lists(b.column(0).take(pa.array(at))), lists(pa.array(dl[at], pa.int32())), lists(places)]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "words", "row_ids", "dls", "positions"])


def _exploded(packed: DataFrame) -> DataFrame:
    """The postings of blocks."""
    each = packed.select("term", F.inline(F.arrays_zip("row_ids", "dls", "positions"))).withColumnsRenamed({"row_ids": "row_id", "dls": "dl"})
    return each.select("term", "row_id", "dl", F.size("positions").cast("long").alias("tf"), "positions")


def lengths(tokens: DataFrame) -> DataFrame:
    """row_id, dl: every row of the index with its number of terms."""
    return tokens.select("row_id", F.size("terms").alias("dl"))


def term_stats(tokens: DataFrame) -> DataFrame:
    """term, rows that hold it, its occurrences: one exchange, combined on the map side.

    Each row's terms are sorted, so a term's first place in its row can be told from the others.
    """
    own = tokens.select(F.array_sort("terms").alias("t"))
    marked = F.transform("t", lambda x, i: F.struct(x.alias("term"), ((i == 0) | (F.get("t", i - 1) != x)).cast("long").alias("first")))
    return own.select(F.explode(marked).alias("m")).groupBy("m.term").agg(F.sum("m.first").alias("df"), F.count(F.lit(1)).alias("cf"))


def terms_of(queries: DataFrame) -> DataFrame:
    """query_id, term, weight (how often the query has it), n_terms (different ones)."""
    each = queries.select("query_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    counted = each.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("weight"))
    return counted.withColumn("n_terms", F.count(F.lit(1)).over(Window.partitionBy("query_id")))


def saturation(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def idf(total: Column, holding: Column) -> Column:
    raw = F.log((total - holding + 0.5) / (holding + 0.5))
    return F.when(raw > 0, raw).otherwise(LEAST_IDF)


#: Different query terms up to which a scan looks for them as literals.
LITERALS = 1000


def bm25(tokens: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, row_id, cost (ascending: minus the BM25 sum), matched, n_terms, by a scan of all rows.

    A short list of terms is looked up inside each row, so only hits leave it; a longer one is joined.
    """
    wanted = terms_of(queries)
    sized = tokens.select("row_id", "terms", F.size("terms").alias("dl"))
    named = [r["term"] for r in wanted.select("term").distinct().limit(LITERALS + 1).collect()]
    found = F.filter("terms", lambda t: t.isin(*named)) if 0 < len(named) <= LITERALS else F.col("terms")
    hits = sized.select("row_id", "dl", F.explode(found).alias("term")).join(wanted.select("term").distinct(), "term", "left_semi")
    hits = hits.groupBy("row_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    return _sum(hits, wanted, statistics(sized))


@dataclass(frozen=True)
class Inverted:
    """An inverted index as tables: postings in term order, and one row of statistics (n, mean) of all rows."""

    postings: DataFrame
    stats: DataFrame

    @classmethod
    def write(cls, folder: str, tokens: DataFrame) -> Inverted:
        """The blocks of each input partition as a file in term order, without an exchange; a query's filter on terms skips all other pages."""
        blocks(tokens).sortWithinPartitions("term").write.parquet(f"{folder}/postings")
        words = tokens.sparkSession.read.parquet(f"{folder}/postings").agg(F.sum("words").alias("words"))  # no text is cut into words again
        mean = F.when(F.col("n") > 0, F.coalesce("words", F.lit(0)) / F.col("n")).otherwise(0.0).alias("mean")
        tokens.agg(F.count(F.lit(1)).alias("n")).crossJoin(words).select("n", mean).write.parquet(f"{folder}/stats")
        return cls.read(tokens.sparkSession, folder)

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Inverted:
        return cls(_exploded(spark.read.parquet(f"{folder}/postings")), spark.read.parquet(f"{folder}/stats"))


def statistics(sized: DataFrame) -> DataFrame:
    """One row: number of rows and their mean length."""
    return sized.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("mean"))


def bm25_postings(index: Inverted, queries: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """As :func:`bm25` from the inverted index, of which only the wanted terms' part is read; ``terms`` are those of :func:`literals`."""
    wanted = terms_of(queries)
    hits = _listed(index.postings, literals(queries) if terms is None else terms).join(wanted.select("term").distinct(), "term", "left_semi").select("row_id", "dl", "term", "tf")
    return _sum(hits, wanted, index.stats)


def literals(queries: DataFrame) -> list[str]:
    """The different terms of some queries, as far as they are few (``LITERALS``)."""
    each = queries.select(F.explode(T.tokens(F.col("text"))).alias("term")).distinct().limit(LITERALS + 1)
    return [r["term"] for r in each.collect()]


def _listed(posted: DataFrame, terms: list[str]) -> DataFrame:
    """The postings of some terms; a literal filter reaches the scan of an index sorted by term."""
    return posted.filter(F.col("term").isin(*terms)) if len(terms) <= LITERALS else posted


def _sum(hits: DataFrame, wanted: DataFrame, stats: DataFrame) -> DataFrame:
    holding = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = hits.join(wanted, "term").join(holding, "term").crossJoin(F.broadcast(stats))
    part = F.col("weight") * idf(F.col("n"), F.col("df")) * saturation(F.col("tf"), F.col("dl"), F.col("mean"))
    return scored.groupBy("query_id", "row_id").agg(
        (-F.sum(part)).alias("cost"), F.count(F.lit(1)).alias("matched"), F.first("n_terms").alias("n_terms")
    )


def _phrase_cost(counted: DataFrame, stats: DataFrame) -> DataFrame:
    """query_id, row_id, cost from query_id, row_id, dl and tf (over 0) of the rows that hold a phrase."""
    holding = counted.groupBy("query_id").agg(F.count(F.lit(1)).alias("df"))
    hits = counted.join(holding, "query_id").crossJoin(F.broadcast(stats))
    return hits.select("query_id", "row_id", (-idf(F.col("n"), F.col("df")) * saturation(F.col("tf"), F.col("dl"), F.col("mean"))).alias("cost"))


def phrase(tokens: DataFrame, terms: Sequence[str]) -> DataFrame:
    """query_id (1), row_id, cost of the phrase, which counts as one term and never spans two columns, by a scan of all rows."""
    # Terms are letters and digits, so spaces part them; the look-ahead finds overlapping places too.
    pattern = F.lit("(?= " + " ".join(terms) + " )")
    count = lambda part: F.regexp_count(F.concat(F.lit(" "), F.array_join(part, " "), F.lit(" ")), pattern)
    tf = F.aggregate(F.transform("parts", count), F.lit(0), lambda a, x: a + x)
    sized = tokens.select(F.lit(1).alias("query_id"), "row_id", F.size("terms").alias("dl"), tf.alias("tf"))
    return _phrase_cost(sized.filter("tf > 0"), statistics(sized))


def phrase_postings(index: Inverted, queries: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """query_id, row_id, cost of every query as a phrase, from the inverted index: places where all terms agree on the phrase's start."""
    asked = queries.select("query_id", T.tokens(F.col("text")).alias("terms"))
    wanted = asked.select("query_id", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("i", "term"))
    hits = _listed(index.postings, literals(queries) if terms is None else terms).join(wanted, "term")
    # A row's places of each term, moved back to the phrase's start, meet as arrays.
    starts = hits.select("query_id", "row_id", "dl", "n_terms", F.transform("positions", lambda p: p - F.col("i")).alias("starts"))
    rows = starts.groupBy("query_id", "row_id", "dl", "n_terms").agg(F.collect_list("starts").alias("s")).filter(F.size("s") == F.col("n_terms"))
    tf = F.size(F.aggregate("s", F.get("s", 0), F.array_intersect))
    return _phrase_cost(rows.select("query_id", "row_id", "dl", tf.cast("long").alias("tf")).filter("tf > 0"), index.stats)


def top(scored: DataFrame, limit: int, score_digits: int = 6, by: str = "query_id") -> DataFrame:
    """The ``limit`` cheapest rows of each query with their ranks; equal rounded costs go by row id."""
    rounded = scored.withColumn("cost", F.round("cost", score_digits))
    order = Window.partitionBy(by).orderBy("cost", "row_id")
    return rounded.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def merge_auto(complete: DataFrame, partial: DataFrame) -> DataFrame:
    """Rows with all terms first, then the others, ranked anew; effective match is ``any`` without a complete row.

    Both sides: query_id, row_id, rank and other columns alike.
    """
    rest = partial.join(complete.select("query_id", "row_id"), ["query_id", "row_id"], "left_anti").select(*complete.columns)
    both = complete.withColumn("partial", F.lit(0)).unionByName(rest.withColumn("partial", F.lit(1)))
    own = Window.partitionBy("query_id")
    ranked = both.withColumn("merged_rank", F.row_number().over(own.orderBy("partial", "rank")))
    return ranked.withColumn("effective_match", F.when(F.min("partial").over(own) == 1, "any").otherwise("all"))


def fold_case(col: Column) -> Column:
    """Lower case with the sharp s written out, as full case folding does."""
    return F.replace(F.lower(col), F.lit("ß"), F.lit("ss"))


def accent_resort(candidates: DataFrame, asked: Column, text_col: str = "text", by: str = "query_id") -> DataFrame:
    """Candidates (after their cut-off) by how many of the ``asked`` terms (array) their text holds as substrings, then by rank."""
    text = fold_case(F.col(text_col))
    held = F.size(F.filter(asked, lambda t: F.contains(text, fold_case(t))))
    order = Window.partitionBy(by).orderBy(F.desc("held"), "rank")
    return candidates.withColumn("held", held).withColumn("lexical_rank", F.row_number().over(order))


def second_list(chunks: DataFrame, metadata: DataFrame) -> DataFrame:
    """Metadata hits after every chunk hit. Both: query_id, row_id, rank; metadata also kind."""
    own = Window.partitionBy("query_id")
    both = chunks.select("query_id", "row_id", "rank", F.lit("content").alias("matched_via"), F.lit(0).alias("list"))
    both = both.unionByName(metadata.select("query_id", "row_id", "rank", F.col("kind").alias("matched_via"), F.lit(1).alias("list")))
    return both.withColumn("lexical_rank", F.row_number().over(own.orderBy("list", "rank"))).drop("list")


def pool(limit: int, reranked: int = 0) -> int:
    """Candidates to fetch for ``limit`` results; a reranker's own pool widens it."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    return max(20, 4 * max(limit, reranked))

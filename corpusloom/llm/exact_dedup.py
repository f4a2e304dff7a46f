"""Exact dedup by a log-structured merge index of text digests (DataFrame functions only).

* A batch of (digest, id) rows is *flushed* as one run: one row per digest with the smallest and the
  largest identifier and the row count, and a Bloom filter of its digests. The aggregation combines on
  the map side, so a group of copies of any size moves as one row per task.
* *Compaction* merges the runs of a level into one run of the next level and removes them. Runs are
  merged by hash, so they are not sorted.
* A *lookup* finds the digests of a batch that earlier runs hold. It probes the filters of those runs
  with the batch's digests and the batch's filter with the runs' rows, so only what passes is joined.
* A digest met once is settled by the index alone. Digests met more often (hits: twice in a batch, or
  found by a lookup) go into a Bloom filter of their own, which is probed before any text moves: only
  the texts that pass it are shuffled. They are grouped by digest **and bytes**, with the texts of
  earlier batches, so a digest collision splits into its true groups.

A filter is one row, an array of words made by ``bit_or``; it grows with the number of its digests up
to ``MOST_WORDS``. Beyond that more texts pass it in vain, but no result changes.

An index that is given (``index=``) takes any number of batches: it keeps one copy of each text that
a batch brings, and the ids and sizes of later batches cover the earlier ones. Its state is a log of
small entries (runs and texts that count), so what a lost driver left behind is never read, and of
two writers one fails. Without one, the table is dealt by a hash of its ids into ``BATCHES`` batches that pass
through an index of the query's own: copies in different batches are found by lookups alone.

Edge cases: a null text counts as the empty text; a null id sorts below every id, and a
group of null ids alone has a null ``keep_id``. Rows that repeat both id and text all
count in ``group_size`` and share one ``kept`` flag; :func:`drop_copies` keeps one of them.
An empty table gives an empty result. Other columns are never read by :func:`exact_groups`.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Log, fresh_path, remove, stored, text_or_empty

RUN_SCHEMA = "digest binary, low long, high long, n long"
FILTER_SCHEMA = "bits array<long>, words int"
TEXT_SCHEMA = "digest binary, text string, low long, high long, n long"
HASHES = 4
MOST_WORDS = 1 << 21  # of 64 bits: 16 MB
BATCHES = 3  # of a query's own index
FANOUT = 2  # of that index: the last batch is looked up in one merged run


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def words_for(n: int) -> int:
    """Words of a filter of n digests: 16 bits each, within bounds."""
    return min(MOST_WORDS, 1 << max(6, (n // 4).bit_length()))


def _spot(digest: Column, i: int, words: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(i), digest), F.lit(words * 64))


def bloom(digests: DataFrame, words: int) -> DataFrame:
    """One row: the filter of a ``digest`` column as an array of words."""
    spots = digests.select(F.explode(F.array(*[_spot(F.col("digest"), i, words) for i in range(HASHES)])).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))
    ones = spots.select(F.shiftright("at", 6).alias("word"), bit.alias("bits"))
    zeros = digests.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    merged = ones.unionByName(zeros).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return merged.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bits"))


class Filter(NamedTuple):
    """A stored one-row filter."""

    row: DataFrame
    words: int

    def passes(self, digest: Column) -> Column:
        """False only for digests that are not in the filter."""
        bits = self.row.scalar()

        def is_set(at: Column) -> Column:
            word = F.get(bits, F.shiftright(at, 6).cast("int"))
            return F.call_function("shiftright", word, at.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1

        return reduce(lambda a, b: a & b, [is_set(_spot(digest, i, self.words)) for i in range(HASHES)])


class DigestIndex:
    """Runs of (digest, low id, high id, row count) below one folder; every write makes a new run folder.

    ``fanout`` runs on a level are merged into one run of the next level, so a row is
    rewritten a logarithmic number of times however many batches arrive. Opened anew on the
    same ``path``, an index goes on where its log ends.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 8):
        self.spark, self.fanout = spark, fanout
        self.path = path or fresh_path(spark, "digest-index")
        self.log = Log(spark, f"{self.path}/log")
        self._at = self.log.last()  # an entry holds the whole state, so the last one is all that counts
        state = json.loads(self.log.text(self._at)) if self._at else {"levels": [[]], "texts": []}
        self.levels: list[list[str]] = state["levels"]
        self.texts: list[str] = state["texts"]
        self._words: dict[str, int] = {}  # of the filters that this index wrote or read

    def _commit(self) -> None:
        self._at += 1
        if not self.log.add(self._at, json.dumps({"levels": self.levels, "texts": self.texts})):
            raise RuntimeError("another writer changed this index; open it anew")
        self.log.cut(self._at - 1)  # one entry stays before the last, for who opens the index just now

    def _write(self, rows: DataFrame) -> str:
        name = fresh_path(self.spark, "run").rsplit("/", 1)[1]
        target = f"{self.path}/{name}"
        rows.write.parquet(f"{target}/rows")
        written = self._rows([target])
        words = self._words[target] = words_for(written.count())
        bloom(written, words).withColumn("words", F.lit(words)).write.parquet(f"{target}/filter")
        return target

    def _rows(self, runs: list[str]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], RUN_SCHEMA)
        return self.spark.read.schema(RUN_SCHEMA).parquet(*[f"{r}/rows" for r in runs])

    @staticmethod
    def _one_each(rows: DataFrame) -> DataFrame:
        return rows.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))

    def _merged(self, runs: list[str]) -> DataFrame:
        return self._one_each(self._rows(runs))

    def runs(self) -> list[str]:
        return [x for level in self.levels for x in level]

    def rows(self) -> DataFrame:
        """The rows of all runs; a digest has one in each run that met it."""
        return self._rows(self.runs())

    def _filter(self, run: str) -> Filter:
        row = self.spark.read.schema(FILTER_SCHEMA).parquet(f"{run}/filter")
        if run not in self._words:
            self._words[run] = row.select("words").first()[0]
        return Filter(row.select("bits"), self._words[run])

    def flush(self, rows: DataFrame) -> DataFrame:
        """A batch of (digest, id) as a run; the index does not hold it yet."""
        one = rows.select("digest", F.col("id").alias("low"), F.col("id").alias("high"), F.lit(1).cast("long").alias("n"))
        self._flushed = self._write(self._one_each(one))
        return self._rows([self._flushed])

    def lookup(self) -> DataFrame:
        """The digests of the flushed batch that the index holds; the filters of both are probed first."""
        runs, digest = self.runs(), F.col("digest")
        if not runs:
            return self._rows([]).select("digest")
        may = reduce(lambda a, b: a | b, [self._filter(r).passes(digest) for r in runs])
        asked = self._rows([self._flushed]).select("digest").filter(may)
        held = self.rows().select("digest").filter(self._filter(self._flushed).passes(digest))
        return asked.join(held, "digest", "left_semi")

    def met_again(self) -> DataFrame:
        """The digests of the flushed batch that it has more than once or that the index holds, written out."""
        repeated = self._rows([self._flushed]).filter("n > 1").select("digest")
        return stored(repeated.unionByName(self.lookup()).distinct(), "digest-met")

    def commit(self, texts: DataFrame | None = None) -> None:
        """Take in the flushed batch (and its distinct texts), then compact levels that are full."""
        if texts is not None:
            target = f"{self.path}/{fresh_path(self.spark, 'texts').rsplit('/', 1)[1]}"
            texts.write.parquet(target)
            self.texts.append(target)
        self.levels[0].append(self._flushed)
        self._commit()
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def insert(self, rows: DataFrame) -> None:
        self.flush(rows)
        self.commit()

    def compact(self, level: int) -> None:
        """Merge all runs of a level into one run of the next and remove them."""
        merged = self._write(self._merged(self.levels[level]))
        old, self.levels[level] = self.levels[level], []
        if len(self.levels) == level + 1:
            self.levels.append([])
        self.levels[level + 1].append(merged)
        self._commit()
        for run in old:
            remove(self.spark, run)

    def compact_all(self) -> DataFrame:
        """Merge every level; the index with one row for each digest."""
        merged, old = self._write(self._merged(self.runs())), self.runs()
        self.levels = [[] for _ in self.levels] + [[merged]]
        self._commit()
        for run in old:
            remove(self.spark, run)
        return self._rows([merged])

    def stored_texts(self) -> DataFrame:
        return self.spark.read.schema(TEXT_SCHEMA).parquet(*self.texts) if self.texts else self.spark.createDataFrame([], TEXT_SCHEMA)


class _Settled(NamedTuple):
    single: DataFrame  # digest, low: texts that no other row has
    verified: DataFrame  # digest, id, text, keep_id, group_size
    hits: Filter


def _through_batches(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The runs of an index that takes (digest, id) in batches, and the digests that it met more than once."""
    spark = keyed.sparkSession
    index, path = DigestIndex(spark, fanout=FANOUT), fresh_path(spark, "digests")
    part = F.pmod(F.xxhash64("id"), F.lit(BATCHES)).cast("int")
    keyed.select("digest", "id", part.alias("part")).write.partitionBy("part").parquet(path)
    rows, met = spark.read.schema("digest binary, id long, part int").parquet(path), []
    for k in range(BATCHES):
        index.flush(rows.filter(F.col("part") == k))
        met.append(index.met_again())
        index.commit()
    return index.rows(), stored(reduce(DataFrame.unionByName, met).distinct(), "digest-hits")


def _settle(keyed: DataFrame, keep: str, index: DigestIndex | None = None) -> _Settled:
    """Single and repeated texts of a batch (id, text, digest), which the index takes in."""
    best = "high" if keep == "high" else "low"
    if index:
        runs = index.flush(keyed.select("digest", "id"))
        hits = index.met_again()
    else:
        runs, hits = _through_batches(keyed)
    words = words_for(hits.count())
    known = Filter(stored(bloom(hits, words), "hits-filter"), words)
    passes = known.passes(F.col("digest"))
    once = runs.filter("n = 1")
    single = once.filter(~passes).unionByName(once.filter(passes).join(hits, "digest", "left_anti").select(*once.columns))
    rows = stored(keyed.filter(passes).join(hits, "digest", "left_semi").select("digest", "id", "text"), "hit-rows")
    # Written out, so that the join below reads both sides through exchanges of its own and
    # Spark can split a hot group of copies.
    each = [F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")]
    groups = stored(rows.groupBy("digest", "text").agg(*each), "hit-groups")
    total = groups
    if index and index.texts:
        before = index.stored_texts().filter(passes).join(hits, "digest", "left_semi").select(*groups.columns)
        summed = groups.unionByName(before).groupBy("digest", "text")
        total = stored(summed.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")), "hit-totals")
    verified = rows.join(total, ["digest", "text"]).select("digest", "id", "text", F.col(best).alias("keep_id"), F.col("n").alias("group_size"))
    if index:
        fresh = keyed.filter(~passes).unionByName(keyed.filter(passes).join(hits, "digest", "left_anti").select(*keyed.columns))
        fresh = fresh.select("digest", "text", F.col("id").alias("low"), F.col("id").alias("high"), F.lit(1).cast("long").alias("n"))
        verified, single = stored(verified, "verified"), stored(single, "single")  # compaction removes what they read
        index.commit(fresh.unionByName(groups))
    return _Settled(single, verified, known)


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "high",
    digest: Callable[[Column], Column] = sha256,
    index: DigestIndex | None = None,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``keep``: ``low`` keeps the smallest id of equal texts, ``high`` the largest.
    ``digest``: the index key; any function of the text is right, as bytes are compared (but a text
    whose digest is met once then has no ``text_sha256``). With ``index``, the groups cover the
    batches that the index took before, and ``docs`` is taken in.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    found = _settle(rows.withColumn("digest", digest(F.col("text"))), keep, index)
    # A digest met once needs no text: with SHA-256 the index row is the result row.
    own = digest is sha256
    named = F.lower(F.hex("digest"))
    single = found.single.select(
        F.col("low").alias("id"), F.col("low").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), (named if own else F.lit(None).cast("string")).alias("text_sha256")
    )
    verified = found.verified.select("id", "keep_id", "group_size", (named if own else F.sha2(F.col("text").cast("binary"), 256)).alias("text_sha256"))
    return single.unionByName(verified).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "high") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each distinct text.

    Repeated rows (same id, same text) give one row; rows that share an id but not a
    text are judged apart. Only rows that pass the filter of repeated digests are shuffled.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    found = _settle(rows.withColumn("digest", sha256(F.col("text"))), keep)
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    keyed = docs.withColumns({"__digest": sha256(text_or_empty(text_col)), "__id": name(F.col(id_col).cast("long"))})
    passes = found.hits.passes(F.col("__digest"))
    keepers = found.verified.filter(F.col("id").eqNullSafe(F.col("keep_id"))).select("digest", "id")
    keepers = keepers.unionByName(found.single.filter(found.hits.passes(F.col("digest"))).select("digest", F.col("low").alias("id")))
    keepers = keepers.select(F.col("digest").alias("__digest"), name(F.col("id")).alias("__id"))
    # Joined by digest and id, which is even however large a group of copies is.
    again = keyed.filter(passes).join(keepers, ["__digest", "__id"], "left_semi").dropDuplicates(["__digest", "__id"])
    return keyed.filter(~passes).unionByName(again.select(*keyed.columns)).select(*docs.columns)

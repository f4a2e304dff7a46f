"""Vectors that a model made, kept as a table: filled in rounds that can be stopped, asked for questions without a second call.

A store holds one model's vectors (its identity is the folder's name) by a key. :meth:`VectorStore.fill` asks the model
for texts whose key is not there, in calls of exactly ``BATCH`` texts but for the last, and commits what it got round
by round; a run that was stopped, or that a model ended by failing, goes on where it was. Questions are kept likewise by
the digest of their text, so a repeated question makes no call.

Edge cases: equal texts under one key are asked once; an empty table asks nothing; a failing call leaves its texts
without a vector and ends its task's calls and the rounds, what other calls got is kept; one writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import maintain
from corpusloom.operators.models import BATCH, Embedder, unit
from corpusloom.sources.shared import hadoop

VECTORS = "chunk_hash string, embedding array<float>"
ASKED = "chunk_hash string, embedding array<float>, error string"


@dataclass(frozen=True)
class Model:
    """A model's identity, how a worker makes it, and the width of its vectors where it is known."""

    identity: str
    factory: Callable[[], Embedder]
    dimensions: int | None = None


@dataclass(frozen=True)
class Remote:
    """A model behind a service: ``send`` takes a request and gives the reply, whose items carry their index."""

    send: Callable[[dict], dict]
    model: str
    dimensions: int | None = None

    def embed(self, texts: Sequence[str]) -> list[Sequence[float]]:
        request = {"model": self.model, "input": list(texts)} | ({"dimensions": self.dimensions} if self.dimensions else {})
        items = self.send(request)["data"]
        by_index = {item["index"]: item["embedding"] for item in items}
        if len(items) != len(texts) or sorted(by_index) != list(range(len(texts))):
            raise ValueError("the service answered other texts than it was asked")
        return [by_index[i] for i in range(len(texts))]


class Unavailable:
    """Stands for a model that is not set up: it cannot embed, and says why."""

    def __init__(self, why: str):
        self.why = why

    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]:
        raise RuntimeError(self.why)


def readiness(model: Model | None) -> tuple[bool, str, str | None]:
    """Whether a model can be asked, its state (ready, disabled, unavailable or failing) and what is wrong."""
    if model is None:
        return False, "disabled", "no embedding model is configured"
    try:
        made = model.factory()
        if isinstance(made, Unavailable):
            return False, "unavailable", made.why
        unit(made.embed(["probe"]), 1, model.dimensions)
    except Exception as e:
        return False, "failing", str(e)
    return True, "ready", None


@dataclass(frozen=True)
class Filled:
    embedded: int
    left: int
    warning: str | None


class VectorStore:
    """``kind``: what the vectors are of (``chunks`` or ``questions``)."""

    def __init__(self, spark: SparkSession, folder: str, model: Model, kind: str = "chunks"):
        self.spark, self.model = spark, model
        self.folder = f"{folder}/vectors/{kind}/{model.identity}"

    def _rounds(self) -> list[str]:
        fs, path = hadoop(self.spark, self.folder)
        if not fs.exists(path(self.folder)):
            return []
        return sorted(f"{self.folder}/{n}" for s in fs.listStatus(path(self.folder)) if (n := s.getPath().getName()).startswith("round-"))

    def table(self) -> DataFrame:
        """chunk_hash, embedding of every text that has one."""
        found = self._rounds()
        return self.spark.read.schema(VECTORS).parquet(*found) if found else self.spark.createDataFrame([], VECTORS)

    def fill(self, texts: DataFrame, round_rows: int = 100_000) -> Filled:
        """Vectors for the ``texts`` (chunk_hash, text) that lack one, ``round_rows`` at a time."""
        embedded, warning = 0, None
        while not warning:
            lacking = maintain.pending(texts, self.table().select("chunk_hash")).limit(round_rows)
            got, failed, error = self._round(lacking)
            embedded += got
            warning = error
            if not got and not failed:
                break
        left = maintain.pending(texts, self.table().select("chunk_hash")).count() if warning else 0
        return Filled(embedded, left, warning)

    def _round(self, lacking: DataFrame) -> tuple[int, int, str | None]:
        """Ask for some texts and commit what came: vectors got, texts that failed, the first error."""
        fs, path = hadoop(self.spark, self.folder)
        attempt = f"{self.folder}/_{uuid.uuid4().hex}"
        numbered = maintain.assign_ids(self.spark.range(1).select(F.lit(0).cast("long").alias("id")), lacking, "chunk_hash")
        batches = numbered.withColumn("batch", F.floor((F.col("id") - 1) / BATCH)).select("batch", "chunk_hash", "text")
        cores = self.spark.sparkContext.defaultParallelism
        asked = batches.repartition(cores, "batch").sortWithinPartitions("batch", "chunk_hash").mapInPandas(self._ask(), ASKED)
        asked.write.parquet(f"{attempt}/asked")
        asked = self.spark.read.schema(ASKED).parquet(f"{attempt}/asked")
        got, failed, error = asked.agg(F.count("embedding"), F.count("error"), F.min("error")).first()
        if got:
            asked.filter("error is null").select("chunk_hash", "embedding").write.parquet(f"{attempt}/round")
            if not fs.rename(path(f"{attempt}/round"), path(f"{self.folder}/round-{len(self._rounds()):08d}")):
                raise RuntimeError(f"another writer fills {self.folder}")
        fs.delete(path(attempt), True)
        return got, failed, error

    def _ask(self) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        factory, dimensions = self.model.factory, self.model.dimensions

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model, error, held = None, None, None

            def call(rows: pd.DataFrame) -> pd.DataFrame:
                nonlocal model, error
                vectors = [None] * len(rows)
                if error is None:
                    try:
                        model = model or factory()
                        vectors = list(unit(model.embed(rows.text.tolist()), len(rows), dimensions))
                    except Exception as e:  # this call's texts stay without a vector
                        error = str(e) or type(e).__name__
                return pd.DataFrame({"chunk_hash": rows.chunk_hash.tolist(), "embedding": vectors, "error": [error] * len(rows)})

            for part in parts:
                rows = part if held is None else pd.concat([held, part])
                last = rows.batch.iloc[-1] if len(rows) else None  # its batch may go on
                for _, group in rows[rows.batch != last].groupby("batch"):
                    yield call(group)
                held = rows[rows.batch == last]
            if held is not None and len(held):
                yield call(held)

        return run

    def of_questions(self, queries: DataFrame) -> DataFrame:
        """query_id, query: the vectors of some questions (query_id, text); only texts that were never asked go to the model."""
        plain = T.strip(F.regexp_replace("text", r"\s+", " "))
        keyed = queries.select("query_id", plain.alias("text")).withColumn("chunk_hash", F.sha2("text", 256))
        filled = self.fill(keyed.select("chunk_hash", "text"))
        if filled.warning:
            return keyed.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, query array<float>")
        return keyed.join(self.table(), "chunk_hash").select("query_id", F.col("embedding").alias("query"))

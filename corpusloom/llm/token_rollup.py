"""Token counts as delta-maintained rollups.

A rollup is a log of committed batches. A batch of changes (insert, delete, revise) is turned
into signed differences against the ledger, which knows the count of every document under every
tokenizer version: an insert adds a document and its tokens, a delete takes them away, a revision
adds new minus old (also when the source or language changes, which moves the document from one
group to another). The batch's folder holds the ledger rows that changed and one row of sums for
each (source, lang, version); totals are the sum of those rows over all batches, so reading them
costs nothing that depends on the number of documents.

Commits are idempotent: a batch is written to a folder of its own attempt and counts once its entry
(batch id and folder) is the next one of the log, which the file system gives to one writer only. The
number is that after the entries in which the batch id was sought, so who missed a batch loses the race
and starts again from the changed log: its batch id may be there now, and then nothing changes, or the
ledger may have moved, and then the differences are made anew. Folders without an entry, of a lost
driver, are never read. After ``fanout`` batches the ledger and the sums are merged into one folder, so a
batch reads a ledger of bounded age, not all history; the merge's entry names all batches before it, and the
entries that it stands for are removed by the merge after it.

Changes: doc_id, version, op, source, lang, n_tokens, and ``seq`` where a batch changes a document
more than once (the last counts; ties go to the largest row). Edge cases: an insert of a known
document is a revision and a revision of an unknown one an insert; a delete of an unknown one does
nothing; a null n_tokens counts 0; null ids, sources, languages and versions are values of their
own; an empty batch is committed and empty; groups without documents and tokens are not reported.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Log, fresh_path, hadoop, remove

LEDGER = "doc_id long, version string, number long, source string, lang string, n_tokens long"
SUMS = "source string, lang string, version string, docs long, tokens long"
GROUP = ["source", "lang", "version"]


class State(NamedTuple):
    """The log up to an entry: ids of the batches, and the folders that count (the last merged one and the batches after it)."""

    number: int
    batches: list[str]
    folders: list[str]


class TokenRollup:
    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 8):
        self.spark, self.fanout = spark, fanout
        self.path = path or fresh_path(spark, "token-rollup")
        self.log = Log(spark, f"{self.path}/log")

    def _state(self) -> State:
        """What the entries say so far, with the last one's number."""
        state = State(0, [], [])
        for number, text in self.log.entries():
            entry = json.loads(text)
            if entry["batch"] is None:  # a merge stands for all entries before it
                state = State(number, entry["batches"], [entry["folder"]])
            else:
                state = State(number, [*state.batches, entry["batch"]], [*state.folders, entry["folder"]])
        return state

    def batches(self) -> list[str]:
        """Ids of the committed batches, in order."""
        return self._state().batches

    def _read(self, part: str, schema: str, folders: list[str]) -> DataFrame:
        found = [f"{self.path}/data/{f}/{part}" for f in folders]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def ledger(self, of: DataFrame | None = None) -> DataFrame:
        """Latest count of every document and version, or of those in ``of``; n_tokens is null where it was deleted."""
        return self._ledger(self._state().folders, of)

    def _ledger(self, folders: list[str], of: DataFrame | None = None) -> DataFrame:
        rows = self._read("ledger", LEDGER, folders)
        if of is not None:  # before the exchange: a small batch leaves the rest of the ledger where it is
            rows = rows.join(of, rows.doc_id.eqNullSafe(of.doc_id) & rows.version.eqNullSafe(of.version), "left_semi")
        latest = F.max_by(F.struct("number", "source", "lang", "n_tokens"), "number").alias("at")
        return rows.groupBy("doc_id", "version").agg(latest).select("doc_id", "version", "at.*")

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit a batch of changes; False if the id was committed before."""
        if not batch_id:
            raise ValueError(f"bad batch id: {batch_id!r}")
        while batch_id not in (state := self._state()).batches:
            folder = self._prepare(changes, state)
            if self.log.add(state.number + 1, json.dumps({"batch": batch_id, "folder": folder})):
                if len(state.folders) >= self.fanout:
                    self.compact()
                return True
            remove(self.spark, f"{self.path}/data/{folder}")
        return False

    def _prepare(self, changes: DataFrame, state: State) -> str:
        """Write a batch's ledger rows and sums against the ledger as it is; the name of its folder."""
        number = state.number + 1
        seq = F.col("seq").cast("long") if "seq" in changes.columns else F.lit(0).cast("long")
        rows = changes.select(
            F.col("doc_id").cast("long"), "version", seq.alias("seq"), "source", "lang",
            F.when(F.col("op") != "delete", F.coalesce(F.col("n_tokens").cast("long"), F.lit(0))).alias("n_tokens"),
        )
        last = rows.groupBy("doc_id", "version").agg(F.max(F.struct("seq", F.col("n_tokens").isNull().alias("gone"), "n_tokens", "source", "lang")).alias("new"))
        moves = last.select("doc_id", "version", F.lit(None).cast("struct<source:string,lang:string,n_tokens:long>").alias("old"), "new")
        if state.folders:
            old = self._ledger(state.folders, last.select("doc_id", "version")).filter("n_tokens is not null")
            same = last.doc_id.eqNullSafe(old.doc_id) & last.version.eqNullSafe(old.version)
            known = F.when(old.n_tokens.isNotNull(), F.struct(old.source, old.lang, old.n_tokens)).alias("old")
            moves = last.join(old, same, "left").select(last.doc_id, last.version, known, "new")
        folder = uuid.uuid4().hex
        target = f"{self.path}/data/{folder}"
        moves.filter("old is not null or new.n_tokens is not null").select(
            "doc_id", "version", F.lit(number).cast("long").alias("number"),
            F.when(F.col("new.n_tokens").isNotNull(), F.struct("new.source", "new.lang", "new.n_tokens")).alias("now"), F.col("old").alias("was"),
        ).write.parquet(f"{target}/moves")
        moves = self.spark.read.parquet(f"{target}/moves")
        moves.select("doc_id", "version", "number", "now.source", "now.lang", "now.n_tokens").write.parquet(f"{target}/ledger")
        signed = moves.select(
            "version", F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("now").alias("at")), F.struct(F.lit(-1).alias("sign"), F.col("was").alias("at")))).alias("s")
        ).filter("s.at is not null")
        sums = signed.groupBy(F.col("s.at.source").alias("source"), F.col("s.at.lang").alias("lang"), "version").agg(
            F.sum(F.col("s.sign").cast("long")).alias("docs"), F.sum(F.col("s.sign") * F.col("s.at.n_tokens")).alias("tokens")
        )
        sums.filter("docs <> 0 or tokens <> 0").write.parquet(f"{target}/sums")
        remove(self.spark, f"{target}/moves")
        return folder

    def compact(self) -> bool:
        """Merge all that counts into one folder, without documents that are gone; False if a batch came in between.

        What was merged stays until :meth:`vacuum`, for readers that hold them.
        """
        state, folder = self._state(), uuid.uuid4().hex
        merges = [n for n, text in self.log.entries() if json.loads(text)["batch"] is None]
        self._ledger(state.folders).filter("n_tokens is not null").select(*[c.split()[0] for c in LEDGER.split(", ")]).write.parquet(f"{self.path}/data/{folder}/ledger")
        self._summed(state.folders).write.parquet(f"{self.path}/data/{folder}/sums")
        if self.log.add(state.number + 1, json.dumps({"batch": None, "folder": folder, "batches": state.batches})):
            if merges:  # a writer that still reads older entries finds the number taken
                self.log.cut(merges[-1])
            return True
        remove(self.spark, f"{self.path}/data/{folder}")
        return False

    def vacuum(self) -> None:
        """Remove the folders that no longer count, also those of lost drivers; for times without readers and writers."""
        live = set(self._state().folders)
        fs, path = hadoop(self.spark, f"{self.path}/data")
        for found in fs.listStatus(path(f"{self.path}/data")) if fs.exists(path(f"{self.path}/data")) else []:
            if (folder := found.getPath().getName()) not in live:
                remove(self.spark, f"{self.path}/data/{folder}")

    def _summed(self, folders: list[str]) -> DataFrame:
        sums = self._read("sums", SUMS, folders).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.filter("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens."""
        return self._summed(self._state().folders)

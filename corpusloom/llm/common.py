"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.spread import spread
from corpusloom.sources.shared import cleanup, fresh_path, hadoop, remove, shared_dir, stored

__all__ = ["Log", "WORD", "cleanup", "fresh_path", "partitions", "remove", "shared_dir", "stored", "table", "text_or_empty", "word_count"]

#: Word separators of the contracts: space and the ASCII controls 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"


class Log:
    """Numbered entries of a few bytes below a folder; of two writers of one number, one fails.

    An entry is written under a name of its own and then published under its number, whole or not at all: on a
    local file system by a hard link, elsewhere by a rename that fails where the name is taken, which
    the file system must do for one caller only (HDFS does; a store without such a rename needs one writer). A
    writer takes the number after those that it read, so it fails if it missed any.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.fs, self.path = hadoop(spark, folder)
        self.fs.mkdirs(self.path(folder))
        self._read: dict[int, str] = {}

    def _numbers(self) -> list[int]:
        names = [x.getPath().getName() for x in self.fs.listStatus(self.path(self.folder))]
        floor = max((int(n[6:]) for n in names if n.startswith("floor-")), default=0)
        return sorted(int(n) for n in names if n.isdigit() and int(n) >= floor)

    def entries(self) -> list[tuple[int, str]]:
        """(number, text) of every entry, in order; an entry is read once."""
        while True:
            numbers = self._numbers()
            try:
                return [(n, self.text(n)) for n in numbers]
            except Exception:
                if self._numbers() == numbers:  # else entries were cut meanwhile
                    raise

    def text(self, number: int) -> str:
        if number not in self._read:
            stream = self.fs.open(self.path(f"{self.folder}/{number:010d}"))
            self._read[number] = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
        return self._read[number]

    def last(self) -> int:
        """The highest number; 0 without any."""
        return max(self._numbers(), default=0)

    def add(self, number: int, text: str) -> bool:
        """Publish an entry; False if its number is taken."""
        own, target = self.path(f"{self.folder}/_{uuid.uuid4().hex}"), self.path(f"{self.folder}/{number:010d}")
        stream = self.fs.create(own, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        jvm = self.spark.sparkContext._jvm
        try:
            if self.fs.getUri().getScheme() == "file":
                at = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(at(target), at(own))
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf())
                options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                context.rename(own, target, options)
        except Exception:
            if self.fs.exists(target):
                return False
            raise
        finally:
            self.fs.delete(own, False)
        if number not in self._numbers():  # the number was free only because the log was cut above it
            self.fs.delete(target, False)
            return False
        return True

    def cut(self, number: int) -> None:
        """Remove the entries below a number whose own entry stands for them; no entry below it counts from now on."""
        names = [x.getPath().getName() for x in self.fs.listStatus(self.path(self.folder))]
        self.fs.create(self.path(f"{self.folder}/floor-{number:010d}"), True).close()
        for name in names:
            if (name.isdigit() and int(name) < number) or (name.startswith("floor-") and int(name[6:]) < number):
                self.fs.delete(self.path(f"{self.folder}/{name}"), False)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def word_count(col: str | Column) -> Column:
    """Number of words of a text, as the contracts define words; null counts 0."""
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one with fewer splits than cores is dealt over them."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))

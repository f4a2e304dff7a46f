"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders named by this process, for :func:`cleanup`.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A folder set by ``SparkContext.setCheckpointDir`` counts too. Where the session names none, a
    ``local`` master (tests) gets a temporary folder, made once and also set as the checkpoint
    folder; any other master is an error, as its executors would write to disks of their own.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop(spark: SparkSession, folder: str):
    """The file system of a folder, and its class of paths."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, folder: str) -> None:
    fs, path = hadoop(spark, folder)
    fs.delete(path(folder), True)


def cleanup(spark: SparkSession) -> None:
    """Remove the tables that operators wrote for results not read yet; call it once those are written."""
    while _MADE:
        remove(spark, _MADE.pop())

"""Dealing a small scan over the cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than there are cores, dealt anew; larger scans stay as they are.

    One file of one row group is one task however many cores wait; with more splits than cores
    the exchange would only cost.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)

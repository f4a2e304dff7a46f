"""Change events released once their path has been quiet.

:func:`quiet_sessions` is the plain rule as a session window, for batches and streams alike.
:func:`debounce` keeps state for each path, for the rules a window cannot say: a pending move
outlives later events that are no delete.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

QUIET = 0.35  # seconds


def quiet_sessions(events: DataFrame, key: Column, at: str, gap: str, *values: str) -> DataFrame:
    """key, first, last, n and the values of the last event of each session of a key."""
    last = F.max_by(F.struct(*values), F.struct(at, *values)).alias("v")
    sessions = events.groupBy(key.alias("key"), F.session_window(at, gap).alias("w"))
    return sessions.agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"), last).select("key", "first", "last", "n", "v.*")


class _Quiet(StatefulProcessor):
    """One pending event for each path, released by an event-time timer after the quiet time."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "kind string, target string, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.pending.get() if self.pending.exists() else None
        for frame in rows:
            for e in frame.sort_values("at").itertuples():
                at = int(e.at.timestamp() * 1000)
                if held is not None and held[0] == "moved" and e.kind != "deleted":
                    held = ("moved", held[1], at)
                else:
                    held = (e.kind, e.target, at)
        if held is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.pending.update(held)
            self.handle.registerTimer(held[2] + self.quiet_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kind, target, at = self.pending.get()
        self.pending.clear()
        yield pd.DataFrame({"path": [key[0]], "kind": [kind], "target": [target], "at": [pd.Timestamp(at, unit="ms")]})

    def close(self) -> None:
        pass


def debounce(events: DataFrame, quiet: float = QUIET, late: str = "1 second") -> DataFrame:
    """Streaming: path, kind, target, at of each event that its path's quiet time released.

    events: path, kind (created, modified, moved, deleted), target, at.
    """
    return (
        events.withWatermark("at", late)
        .groupBy("path")
        .transformWithStateInPandas(
            _Quiet(int(quiet * 1000)), outputStructType="path string, kind string, target string, at timestamp", outputMode="Append", timeMode="EventTime"
        )
    )


def apply_changes(released: DataFrame) -> DataFrame:
    """path, action: what a released event asks of the index (a move names both ends)."""
    action = F.when(F.col("kind") == "deleted", "remove").when(F.col("kind") == "moved", "move").otherwise("index")
    return released.select("path", action.alias("action"), F.when(F.col("kind") == "moved", F.col("target")).alias("target"))

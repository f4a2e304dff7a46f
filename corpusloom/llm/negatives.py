"""Hard-negative mining: k-means inverted lists searched by Cauchy-Schwarz bounds.

Every row goes to the list of its nearest centroid; a list stores its centroid m and radius r, the
largest distance from the centroid to one of its rows. For an anchor q,
``q.m - |q| r <= q.x <= q.m + |q| r`` for every row x of the list. Lists are visited in the order of
their upper bound, and an anchor stops when the next bound is strictly below its k-th score, so ties are
seen. For negatives a list is skipped if its bounds lie outside the window that the positive's score sets;
what is above the window ends at the window, and lists wholly above it are never read. The search is
exact.

Centroids are fitted on a bounded sample (``sample`` rows, the ones of least hash; ``iterations`` rounds of
Lloyd's algorithm from evenly dealt rows), one for every ``list_rows`` rows of a shard, at most ``most_lists``;
every row is in a list. The fit changes the speed only.

Rows are dealt to shards by a hash of their id, never by list, so a list that holds a third of all
rows is spread evenly; each shard has its own lists of all centroids. Anchors are packed
into blocks and every (anchor block, shard) pair is one task's work, first for the positives, whose best
are merged by anchor, then for the negatives of each anchor's windows, merged by anchor and positive.
Nothing but the centroids is broadcast.

Each component x counts as floor(scale * x); scores are integers computed in doubles (exact below 2^53).
Edge cases: rows with a null label, a null vector, a null or non-finite component, or a null id take no part;
vectors of different length are compared as if the shorter ended in zeros; equal scores go to the smaller id.
Rows that repeat an id are one row, the one with the smallest label and then vector. An anchor
without other rows of its label has no row in the result, nor has a positive whose window holds no row of
another label (a negative positive score has an empty window). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import stored
from corpusloom.llm.topk import _matrix, _wide, whole_number

BLOCK = "block int, ids binary, labels binary, vectors binary, width int, windows binary"
SLACK = 1e-9


def centroids(rows: np.ndarray, k: int, iterations: int) -> np.ndarray:
    """k-means centroids of the rows by Lloyd's algorithm; a centroid without rows stays where it is."""
    found = rows[np.linspace(0, len(rows) - 1, min(k, len(rows))).astype(np.int64)].copy()
    for _ in range(iterations):
        near = nearest(rows, found)
        n = np.bincount(near, minlength=len(found))
        sums = np.zeros_like(found)
        np.add.at(sums, near, rows)
        found[n > 0] = sums[n > 0] / n[n > 0, None]
    return found


def nearest(rows: np.ndarray, found: np.ndarray, at_once: int = 1 << 14) -> np.ndarray:
    """The nearest centroid of each row."""
    dims = max(rows.shape[1], found.shape[1])
    found = _wide(found, dims)
    half = (found * found).sum(1) / 2
    parts = [np.argmin(half - _wide(rows[i : i + at_once], dims) @ found.T, axis=1) for i in range(0, len(rows), at_once)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


class Lists:
    """The inverted lists of a shard: rows sorted by centroid and id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, found: np.ndarray):
        dims = max(rows.shape[1], found.shape[1])
        rows, found = _wide(rows, dims), _wide(found, dims)
        near = nearest(rows, found)
        order = np.lexsort((ids, near))
        self.ids, self.labels, self.rows, self.dims = ids[order], labels[order], np.ascontiguousarray(rows[order]), dims
        near = near[order]
        self.start = np.flatnonzero(np.r_[True, near[1:] != near[:-1]])
        self.stop = np.r_[self.start[1:], len(near)]
        self.centre = found[near[self.start]]
        self.radius = np.maximum.reduceat(np.sqrt(((self.rows - found[near]) ** 2).sum(1)), self.start)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bound of every list's scores for each query, with a slack for rounding."""
        middle, reach = queries @ self.centre.T, np.sqrt((queries * queries).sum(1))[:, None] * self.radius[None]
        slack = SLACK * (1 + np.abs(middle) + reach)
        return middle + reach + slack, middle - reach - slack

    def best(self, anchor: int, q: np.ndarray, label: int, same: bool, windows: np.ndarray, k: int, upper: np.ndarray, lower: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (low, high) the (ids, scores) of the k best rows of the label (or of other labels) in it, without the anchor's own.

        Lists are visited from the highest bound down, until no window can gain by the next one.
        """
        low, high = windows[:, 0].astype(float), windows[:, 1].astype(float)
        found = [(np.empty(0, np.int64), np.empty(0)) for _ in windows]
        least = low.copy()  # what a row must score at least: the window's low end, then its k-th best
        for at in np.argsort(-upper, kind="stable").tolist():
            top = upper[at]
            if (top < least).all():
                break
            open_ = (np.minimum(top, high) >= least) & (lower[at] <= high)
            if not open_.any():
                continue
            i, j = self.start[at], self.stop[at]
            score = self.rows[i:j] @ q
            fit = np.flatnonzero((score >= least[open_].min()) & (score <= high[open_].max()) & ((self.labels[i:j] == label) == same) & (self.ids[i:j] != anchor))
            if not len(fit):
                continue
            some, names = score[fit], self.ids[i:j][fit]
            for w in np.flatnonzero(open_).tolist():
                inside = (some >= least[w]) & (some <= high[w])
                if inside.any():
                    ids, scores = np.concatenate((found[w][0], names[inside])), np.concatenate((found[w][1], some[inside]))
                    keep = np.lexsort((ids, -scores))[:k]
                    found[w] = ids[keep], scores[keep]
                    if len(keep) == k:
                        least[w] = scores[keep[-1]]
        return found


def _sides(batches: Iterator[pa.RecordBatch]) -> tuple[list, list]:
    """The blocks of a pair: rows of the shard and of the anchors."""
    sides: tuple[list, list] = ([], [])
    for b in batches:
        for r in b.to_pylist():
            ids = np.frombuffer(r["ids"], np.int64)
            sides[r["side"]].append(
                (ids, np.frombuffer(r["labels"], np.int64), np.frombuffer(r["vectors"]).reshape(len(ids), r["width"]), np.frombuffer(r["windows"], np.int64).reshape(len(ids), -1))
            )
    return sides


def _joined(parts: list) -> tuple[np.ndarray, ...]:
    dims = max(p[2].shape[1] for p in parts)
    return tuple(np.concatenate(x) for x in zip(*[(p[0], p[1], _wide(p[2], dims), p[3]) for p in parts]))


def _packed(rows: DataFrame, n: int) -> DataFrame:
    """Rows (id, label, v, windows) as blocks of one row for each of n hash blocks and batch."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            block, ids, labels = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            x, windows = _matrix(b.column(3)), b.column(4)
            flat = windows.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            order = np.argsort(block, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                fields = [int(block[part[0]]), ids[part].tobytes(), labels[part].tobytes(), x[part].tobytes(), x.shape[1], flat[part].astype(np.int64).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([f], t) for f, t in zip(fields, (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary()))], names=[c.split()[0] for c in BLOCK.split(", ")])

    block = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    return rows.select(block, "id", "label", "v", "windows").mapInArrow(pack, BLOCK)


def _search(shards: DataFrame, n_shards: int, anchors: DataFrame, n_blocks: int, found: np.ndarray, k: int, same: bool) -> DataFrame:
    """anchor, window (its number), id, score: the k best rows of each shard for every anchor's windows.

    ``same``: rows of the anchor's label, else of other labels. A window is three numbers: name, low, high.
    """
    centres = shards.sparkSession.sparkContext.broadcast(found)

    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, queries = _sides(batches)
        if not rows or not queries:
            return
        ids, labels, x, _ = _joined(rows)
        lists = Lists(ids, labels, x, centres.value)
        out: list[list[np.ndarray]] = [[], [], [], []]
        anchors, own, vectors, windows = _joined(queries)
        vectors = _wide(vectors[:, : lists.dims], lists.dims)  # what the rows do not have counts zero
        upper, lower = lists.bounds(vectors)
        for i, (anchor, label, q) in enumerate(zip(anchors.tolist(), own.tolist(), vectors)):
            asked = windows[i].reshape(-1, 3)
            for name, (got, scores) in zip(asked[:, 0].tolist(), lists.best(anchor, q, label, same, asked[:, 1:], k, upper[i], lower[i])):
                if len(got):
                    for at, value in enumerate((np.full(len(got), anchor), np.full(len(got), name), got, scores.astype(np.int64))):
                        out[at].append(value)
        columns = [pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in out]
        yield pa.RecordBatch.from_arrays(columns, names=["anchor", "window", "id", "score"])

    # Every shard meets every anchor block; the key is the pair of their numbers.
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = shards.withColumnsRenamed({"block": "shard"}).withColumn("side", F.lit(0)).withColumn("block", every(n_blocks))
    queries = _packed(anchors, n_blocks).withColumn("side", F.lit(1)).withColumn("shard", every(n_shards))
    both = rows.unionByName(queries)
    return both.groupBy("shard", "block").applyInArrow(meet, "anchor long, window long, id long, score long")


def mine(
    rows: DataFrame,
    is_anchor: Column,
    label: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: float = 256.0,
    most_lists: int = 1024,
    sample: int = 16384,
    iterations: int = 5,
    list_rows: int = 256,
    block_bytes: int = 32 << 20,
    least_rows: int = 2048,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    The window of a positive with score p: ``low * p <= 100 * score <= high * p``.
    """
    spark = rows.sparkSession
    v = F.col(vector_col)
    sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = rows.filter(sound & F.col(id_col).isNotNull() & label.isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
        F.transform(v, lambda x: whole_number(F.lit(scale) * x.cast("double"))).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("q"),
    )
    whole = stored(whole.groupBy("id").agg(F.min(F.struct("label", "v", "q")).alias("r")).select("id", "r.*"), "negative-rows")
    total, n_anchors, width = whole.agg(F.count(F.lit(1)), F.count_if("q"), F.max(F.size("v"))).first()
    if not total or not n_anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    # A bounded sample: rows below a hash that lets some more than `sample` pass, and of these `sample` by their hash.
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 31)) <= int((1 << 31) * min(1.0, (1.2 * sample + 100) / total))
    fit = whole.filter(share).select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(sample).select("v").toArrow()
    fit = _matrix(fit.column("v").combine_chunks() if fit.num_rows else pa.array([], pa.list_(pa.float64())))
    cores = spark.sparkContext.defaultParallelism
    most = max(1, block_bytes // (8 * (width + 2)))
    n_blocks = -(-n_anchors // most)
    n_shards = max(-(-total // most), min(-(-2 * cores // n_blocks), -(-total // least_rows)))
    found = centroids(fit, max(1, min(most_lists, total // n_shards // list_rows)), iterations)
    no_window = F.array(*[F.lit(x).cast("long") for x in (0, -(2**62), 2**62)])
    shards = stored(_packed(whole.withColumn("windows", no_window), n_shards), "negative-shards")
    anchors = whole.filter("q").select("id", "label", "v")

    def ranked(found: DataFrame, key: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*key).orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    near = _search(shards, n_shards, anchors.withColumn("windows", no_window), n_blocks, found, positives, True)
    best = stored(ranked(near, ["anchor"], positives).select("anchor", F.col("id").alias("positive"), F.col("score").alias("p")), "negative-positives")
    # low * p <= 100 * s <= high * p for whole s: from ceil(low * p / 100) to floor(high * p / 100).
    windows = best.withColumns({"low": _ceil_div(F.col("p") * low), "high": _floor_div(F.col("p") * high)}).filter("low <= high")
    windows = windows.groupBy("anchor").agg(F.collect_list(F.array("positive", "low", "high")).alias("w")).select("anchor", F.flatten("w").alias("windows"))
    # At most `positives` windows for each anchor; missing ones are empty.
    empty = F.array(*[F.lit(x).cast("long") for x in (0, 1, 0)])
    filled = F.flatten(F.array(F.col("windows"), F.flatten(F.array_repeat(empty, F.lit(positives) - (F.size("windows") / 3).cast("int")))))
    asked = anchors.join(windows, anchors.id == windows.anchor).select("id", "label", "v", filled.alias("windows"))
    far = _search(shards, n_shards, asked, n_blocks, found, negatives, False).withColumnRenamed("window", "positive")
    best_far = ranked(far, ["anchor", "positive"], negatives)
    return best_far.join(best, ["anchor", "positive"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        F.col("p").alias("positive_score"), F.col("score").alias("negative_score"),
    )


def _floor_div(x: Column) -> Column:
    """floor(x / 100) of whole numbers."""
    return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))


def _ceil_div(x: Column) -> Column:
    return -_floor_div(-x)

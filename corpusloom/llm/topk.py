"""Exact top-k inner products by pivot-table elimination.

Maximum inner product becomes nearest neighbour when each candidate gets one more
component, sqrt(M - |c|^2) with M the largest squared norm, and each query a zero: then
``d(q, c)^2 = |q|^2 + M - 2 q.c``. A table of distances from every candidate to many pivots
is made once; for a query, ``max over pivots |d(q, p) - d(c, p)|`` bounds ``d(q, c)`` from
below. Candidates are evaluated in the order of that bound until the next bound exceeds
the k-th best distance found, which is exact; bounds get a slack for rounding, and scores
are integers computed in doubles (exact below 2^53).

Spark shuffles blocks, not pairs: candidates are packed into blocks with their pivot table (single
precision; components in 32-bit integers where they fit), queries into blocks likewise, and every
(query block, candidate block) pair is one row. What moves is candidates times query blocks plus
queries times candidate blocks, so blocks are as large as ``block_bytes`` lets them be, or as there
are pairs enough for all cores. Only each pair's k best go on, and a window for each query merges
them. Neither side is broadcast; the pivots (a fixed number of rows) are.

Each component x counts as floor(scale * x). Edge cases: a vector that is null or holds a
null or non-finite component takes no part; vectors of different length are compared as if
the shorter ended in zeros; equal scores go to the smaller id, null ids take no part;
repeated ids are candidates each on its own but never for a query with that id. A query
with fewer than k candidates returns them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_SCHEMA = "side int, block long, ids binary, vectors binary, narrow boolean, table binary, rows int"


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Rows of floats, padded with zeros to the longest."""
    length = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(length), int(length.max()) if len(length) else 0))
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(length)), length)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out


def _wide(x: np.ndarray, dims: int) -> np.ndarray:
    return x if x.shape[1] == dims else np.pad(x, ((0, 0), (0, dims - x.shape[1])))


def _distances(x: np.ndarray, tail: np.ndarray, pivots: np.ndarray, top: float) -> np.ndarray:
    """Distances in the lifted space from rows (x, tail) to the pivots (lifted likewise)."""
    dims = max(x.shape[1], pivots.shape[1])
    x, p = _wide(x, dims), _wide(pivots, dims)
    end = np.sqrt(np.maximum(top - (p * p).sum(1), 0))
    square = ((x * x).sum(1) + tail * tail)[:, None] + ((p * p).sum(1) + end * end)[None] - 2 * (x @ p.T + tail[:, None] * end[None])
    return np.sqrt(np.maximum(square, 0))


def search(
    q_ids: np.ndarray, q: np.ndarray, q_table: np.ndarray, c_ids: np.ndarray, c: np.ndarray, c_table: np.ndarray, top: float, k: int
) -> Iterator[tuple[int, int, int]]:
    """(query id, candidate id, score) of the k best in this block for each query; pivot elimination."""
    dims = max(q.shape[1], c.shape[1])
    q, c = _wide(q, dims), _wide(c, dims)
    norm = (q * q).sum(1)
    slack = 1e-3 * (1 + np.sqrt(top + norm.max(initial=0)))  # far above the rounding of the table
    c_pivots, q_pivots = np.ascontiguousarray(c_table.T.astype(np.float32)), q_table.astype(np.float32)
    step = max(4 * k, 64)
    for i in range(len(q_ids)):
        bound = np.abs(c_pivots[0] - q_pivots[i, 0])
        for p in range(1, len(c_pivots)):
            np.maximum(bound, np.abs(c_pivots[p] - q_pivots[i, p]), out=bound)
        best_s, best_i = np.empty(0), np.empty(0, dtype=np.int64)
        left, limit = np.arange(len(bound)), np.inf
        size = step
        while True:
            # Next candidates in bound order among those the limit has not eliminated.
            left = left[bound[left] <= limit]
            if not len(left):
                break
            if len(left) > size:
                cut = np.argpartition(bound[left], size - 1)
                now, left = left[cut[:size]], left[cut[size:]]
            else:
                now, left = left, left[:0]
            now = now[c_ids[now] != q_ids[i]]
            best_s, best_i = np.concatenate((best_s, c[now] @ q[i])), np.concatenate((best_i, c_ids[now]))
            order = np.lexsort((best_i, -best_s))[:k]
            best_s, best_i = best_s[order], best_i[order]
            if len(best_s) == k:
                limit = np.sqrt(max(norm[i] + top - 2 * best_s[-1], 0)) + slack
            size *= 4
        for s, j in zip(best_s.tolist(), best_i.tolist()):
            yield int(q_ids[i]), j, int(s)


def whole_number(x: Column) -> Column:
    """The floor of a double as a double; from 2^52 on a double is its own floor (and may be no long)."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def _blocks(total: int, n_queries: int, width: int, n_pivots: int, cores: int, block_bytes: int, least_rows: int) -> tuple[int, int]:
    """Numbers of candidate and query blocks: as few as memory allows, but pairs for every core."""
    most = max(1, block_bytes // (8 * (width + 1) + 4 * n_pivots))
    n, q = -(-total // most), -(-n_queries // most)
    return max(n, min(-(-2 * cores // q), -(-total // least_rows))), q


def top_k(
    rows: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 256.0,
    n_pivots: int = 24,
    block_bytes: int = 32 << 20,
    least_rows: int = 1024,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows of each query row."""
    spark = rows.sparkSession
    v = F.col(vector_col)
    sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = rows.filter(sound & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(v, lambda x: whole_number(F.lit(scale) * x.cast("double"))).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("q"),
    )
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    total, top, n_queries, width = whole.agg(F.count(F.lit(1)), F.max(squares), F.count_if("q"), F.max(F.size("v"))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not total or not n_queries:
        return spark.createDataFrame([], schema)
    # Pivots: a fixed number of rows, in the order of a hash.
    pivots = [r["v"] for r in whole.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(n_pivots).collect()]
    widest = max(map(len, pivots))
    pivots = np.array([x + [0.0] * (widest - len(x)) for x in pivots])
    n_blocks, q_blocks = _blocks(total, n_queries, width, n_pivots, spark.sparkContext.defaultParallelism, block_bytes, least_rows)
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    candidates = whole.select(F.lit(0).alias("side"), block(n_blocks).alias("block"), "id", "v")
    queries = whole.filter("q").select(F.lit(1).alias("side"), block(q_blocks).alias("block"), "id", "v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a partition to one row for each (side, block) and batch, with the pivot table."""
        for b in batches:
            if not b.num_rows:
                continue
            side, block_id, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            x = _matrix(b.column(3))
            last = np.where(side == 0, np.sqrt(np.maximum(top - (x * x).sum(1), 0)), 0.0)
            near = _distances(x, last, pivots, top)
            keys = block_id * 2 + side
            order = np.argsort(keys, kind="stable")
            out = []
            for part in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
                own = x[part]
                narrow = bool((np.abs(own) < 1 << 31).all())
                packed = own.astype(np.int32 if narrow else np.float64).tobytes()
                out.append((int(side[part[0]]), int(block_id[part[0]]), ids[part].tobytes(), packed, narrow, near[part].astype(np.float32).tobytes(), len(part)))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=kinds)

    names = ["side", "block", "ids", "vectors", "narrow", "table", "rows"]
    kinds = pa.schema(list(zip(names, [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.binary(), pa.int32()])))
    c = candidates.mapInArrow(pack, BLOCK_SCHEMA).drop("side")
    q = queries.mapInArrow(pack, BLOCK_SCHEMA).drop("side")
    # Every candidate block meets every query block: the key is the pair of block numbers.
    pair = lambda d, own, other, n: d.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumnRenamed("block", own)
    c = pair(c, "c_block", "q_block", q_blocks).withColumn("side", F.lit(0))
    q = pair(q, "q_block", "c_block", n_blocks).withColumn("side", F.lit(1))

    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[list, list] = ([], [])
        for b in batches:
            for r in b.to_pylist():
                n = r["rows"]
                x = np.frombuffer(r["vectors"], np.int32 if r["narrow"] else np.float64).astype(np.float64)
                sides[r["side"]].append((np.frombuffer(r["ids"], np.int64), x.reshape(n, -1), np.frombuffer(r["table"], np.float32).reshape(n, -1)))
        if not sides[0] or not sides[1]:
            return
        joined = []
        for parts in sides:
            dims = max(x.shape[1] for _, x, _ in parts)
            joined += [np.concatenate([p[0] for p in parts]), np.concatenate([_wide(p[1], dims) for p in parts]), np.concatenate([p[2] for p in parts])]
        c_ids, c_x, c_t, q_ids, q_x, q_t = joined
        found = list(search(q_ids, q_x, q_t, c_ids, c_x, c_t, top, k))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

    both = c.select("q_block", "c_block", "side", "ids", "vectors", "narrow", "table", "rows").unionByName(q.select("q_block", "c_block", "side", "ids", "vectors", "narrow", "table", "rows"))
    found = both.groupBy("q_block", "c_block").applyInArrow(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

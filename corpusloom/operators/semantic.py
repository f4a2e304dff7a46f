"""Exact vector search by cosine: as an expression, and as matrix products over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from corpusloom.functions.batches import pieces


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length, empty ones and those of norm zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def score(cos: Column) -> Column:
    """Cosine as a score from 0 to 1."""
    return F.greatest(F.lit(0.0), (cos + 1) / 2)


#: Bytes of question vectors that one pass over the vectors carries along, and that one batch may hold.
PASS_BYTES, MOST_BYTES = 32 << 20, 512 << 20
#: Rows and questions that meet in one matrix product: what a task holds is this, its questions and their best rows.
ROW_TILE, QUERY_TILE = 2048, 512


def nearest(vectors: DataFrame, queries: DataFrame, limit: int, digits: int = 6, among: DataFrame | None = None) -> DataFrame:
    """query_id, vec_id, score, rank: exact top vectors for each query vector (``query``), ties by id.

    ``among`` (vec_id): only these count; scores meet them before the cut, vectors never move. With it, all that tie with
    the last are there.

    Questions are a batch of checked size: they go to every task, so no vector is shuffled; more than one pass
    holds take several, and more than ``MOST_BYTES`` are an error (ask in several batches).
    """
    size = queries.agg(F.sum(F.size("query").cast("long") * 8)).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"question vectors of {size} bytes; at most {MOST_BYTES} in a batch")
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, score double"
    asked = [(r["query_id"], list(r["query"])) for r in queries.select("query_id", "query").filter("query is not null").collect()]
    found, at = [], 0
    while at < len(asked):
        part, used = [], 0
        while at < len(asked) and (not part or used + 8 * len(asked[at][1]) <= PASS_BYTES):
            part.append(asked[at])
            used += 8 * len(asked[at][1])
            at += 1
        found.append(_products(vectors, part, queries.schema["query_id"].dataType, limit if among is None else None, digits, kinds))
    if not found:
        return queries.sparkSession.createDataFrame([], kinds + ", rank int")
    every = reduce(DataFrame.unionByName, found)
    if among is not None:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"))
        return every.join(among, "vec_id", "left_semi").withColumn("rank", F.rank().over(order)).filter(F.col("rank") <= limit)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def _products(vectors: DataFrame, asked: list[tuple], kind: DataType, limit: int | None, digits: int, kinds: str) -> DataFrame:
    """Matrix products of tiles of rows and questions; of each task the ``limit`` best rows of a question go on, or all."""
    by_size: dict[int, list[int]] = {}
    for i, (_, v) in enumerate(asked):
        by_size.setdefault(len(v), []).append(i)
    groups = [(n, at, np.array([[float("nan") if x is None else x for x in asked[i][1]] for i in at], dtype=np.float64).reshape(len(at), n)) for n, at in by_size.items()]
    shared = vectors.sparkSession.sparkContext.broadcast(groups)
    names = pa.array([q for q, _ in asked], to_arrow_type(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, pa.Table] = {}  # the best of the task's rows so far, for each group of questions
        for b in pieces(batches, ROW_TILE):
            length = np.nan_to_num(b.column(1).value_lengths().to_numpy(zero_copy_only=False))
            part = 0
            for n, at, q in shared.value:
                same = np.flatnonzero(length == n) if n else np.empty(0, np.int64)
                x = b.column(1).take(pa.array(same)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n) if n else np.empty((0, 0))
                own = np.sqrt((x * x).sum(1))
                for first in range(0, len(at), QUERY_TILE):
                    part += 1
                    if not len(same):
                        continue
                    some = q[first : first + QUERY_TILE]
                    below = own[:, None] * np.sqrt((some * some).sum(1))[None]
                    with np.errstate(invalid="ignore"):
                        cos = np.divide(x @ some.T, below, out=np.zeros_like(below), where=below > 0)
                    s = np.round(np.nan_to_num(np.maximum(0, (cos + 1) / 2), nan=0.5), digits)  # as cosine 0
                    if limit and len(same) > limit:
                        row, query = np.nonzero(s >= np.partition(s, -limit, axis=0)[-limit])
                    else:
                        row, query = (i.ravel() for i in np.indices(s.shape))
                    columns = [pa.array(np.asarray(at)[first + query]), b.column(0).take(pa.array(same[row])), pa.array(s[row, query])]
                    found = pa.Table.from_arrays(columns, names=["query", "vec_id", "score"])
                    if limit is None:
                        yield from sent(found)
                    else:
                        held[part] = best(pa.concat_tables([held[part], found]) if part in held else found)
        for found in held.values():
            yield from sent(found)

    def best(found: pa.Table) -> pa.Table:
        """The ``limit`` best rows of each question, ties by id."""
        ordered = found.sort_by([("query", "ascending"), ("score", "descending"), ("vec_id", "ascending")], null_placement="at_start")
        query = ordered.column(0).to_numpy()
        begin = np.flatnonzero(np.diff(query, prepend=-1))
        place = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query))))
        return ordered.filter(pa.array(place < limit)).combine_chunks()

    def sent(found: pa.Table) -> Iterator[pa.RecordBatch]:
        for b in found.to_batches(max_chunksize=100_000):
            yield pa.RecordBatch.from_arrays([names.take(b.column(0)), b.column(1), b.column(2)], names=["query_id", "vec_id", "score"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, kinds)


def nearest_arrow(vectors: DataFrame, query_ids: list[int], query_vectors: list[list[float]], limit: int, digits: int = 6) -> DataFrame:
    """As :func:`nearest` for a list of query vectors."""
    asked = vectors.sparkSession.createDataFrame(list(zip(query_ids, query_vectors)), "query_id long, query array<double>")
    return nearest(vectors, asked, limit, digits)

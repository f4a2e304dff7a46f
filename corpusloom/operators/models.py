"""Embedding and reranking models behind two small protocols, run in Arrow batches.

A model is made once for each Python worker by a factory, so nothing heavy is sent with a task.
Tests use made-up models; nothing here reaches a network by itself.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.maintain import pending

BATCH = 128


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class Reranker(Protocol):
    def rerank(self, query: str, texts: Sequence[str]) -> Sequence[float]: ...


def identity(provider: str, model: str, endpoint: str = "local", dimensions: int | None = None) -> str:
    """The name under which a model's vectors are kept; another endpoint or width is another name."""
    import hashlib

    said = json.dumps({"provider": provider, "model": model, "endpoint": endpoint, "dimensions": dimensions}, sort_keys=True, separators=(",", ":"))
    return f"{model}#{hashlib.sha256(said.encode()).hexdigest()[:20]}"


def unit(vectors: Sequence[Sequence[float]], count: int, dimensions: int | None = None) -> np.ndarray:
    """Vectors of length one (zero stays zero); a wrong count or width is an error."""
    x = np.asarray(vectors, dtype=np.float64)
    if len(x) != count or x.ndim != 2 or dimensions and x.shape[1] != dimensions:
        raise ValueError("the model returned vectors of another number or width")
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return (x / np.where(norm > 0, norm, 1)).astype(np.float32)


def embed_pending(chunks: DataFrame, vectors: DataFrame, factory: Callable[[], Embedder], dimensions: int | None = None) -> DataFrame:
    """chunk_hash, embedding of every chunk text without a vector, each different text once, in calls of at most 128."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for rows in batches:
            for at in range(0, len(rows), BATCH):
                part = rows.iloc[at : at + BATCH]
                model = model or factory()
                found = unit(model.embed(part.text.tolist()), len(part), dimensions)
                yield pd.DataFrame({"chunk_hash": part.chunk_hash.tolist(), "embedding": list(found)})

    return pending(chunks, vectors).select("chunk_hash", "text").mapInPandas(run, "chunk_hash string, embedding array<float>")


def reranked(factory: Callable[[], Reranker]) -> Callable[[Column, Column], Column]:
    """A function of question and text columns to a score column; null scores (keep the order) if the model fails."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = None
        for questions, texts in batches:
            out = pd.Series([None] * len(texts), dtype="float64")
            try:
                model = model or factory()
                for question, group in texts.groupby(questions):
                    scores = list(model.rerank(question, group.tolist()))
                    if len(scores) == len(group):
                        out.loc[group.index] = scores
            except Exception:  # search goes on in the order it had
                pass
            yield out

    return score

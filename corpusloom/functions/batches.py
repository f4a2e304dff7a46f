"""Arrow batches in small pieces, so that a task's Python holds the objects of a few rows at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Rows of a piece.
ROWS = 128


def pieces(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of batches (or of arrays); an empty batch gives none."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)

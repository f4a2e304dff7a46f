"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary (hash and displace: a bucket of keys
shares one displacement that sends each to a free slot, a lone key's bucket names its slot)
resolves whole pre-tokens that are vocabulary entries; the stored bytes are compared, so
strangers are refused. Tier two: a miss is merged from single bytes, pairs taken from a heap
by rank and position, over a doubly linked list; time n log n for a pre-token of n bytes.

Each distinct pre-token of a task is resolved once and then reused; the memo is bounded and
restarted when full, which changes time but no result. Texts are encoded whole, in slices
of whole documents. Null counts as the empty text (no ids). Repeated rows repeat their
result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 1 << 20  # characters handled at once
MEMO = 500_000  # distinct pre-tokens remembered by a task, and as many parts of them
_K1, _K2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
_MASK = (1 << 64) - 1


def load_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file (base64 and rank on each line) in rank order."""
    fs, base = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    pairs = [line.split() for line in fs.open_input_stream(base).readall().splitlines() if line]
    ranks = {int(b): base64.b64decode(a) for a, b in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks are not 0 to n - 1")
    return [ranks[i] for i in range(len(ranks))]


def _slot(h: int, d: int, n: int) -> int:
    x = ((h ^ (d * _K1 & _MASK)) * _K2) & _MASK
    return (x >> 32) % n


class PerfectHash:
    """Minimal perfect hash of byte strings to their index; -1 for strangers."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.keys, self.n, self.r = keys, n, max(1, n // 3)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        buckets: dict[int, list[int]] = {}
        for i, h in enumerate(hashes):
            buckets.setdefault(h % self.r, []).append(i)
        moved, owner = np.zeros(self.r, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        taken = bytearray(n)
        free = n - 1
        for b, members in sorted(buckets.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                while taken[free]:
                    free -= 1
                moved[b], slots = -free - 1, [free]
            else:
                d = 1
                while True:
                    slots = [_slot(hashes[i], d, n) for i in members]
                    if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                        break
                    d += 1
                moved[b] = d
            for s, i in zip(slots, members):
                taken[s], owner[s] = 1, i
        self.moved, self.owner = moved, owner
        self._moved, self._owner = moved.tolist(), owner.tolist()

    def find(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self._moved[h % self.r]
        i = self._owner[-d - 1 if d < 0 else _slot(h, d, self.n)]
        return i if i >= 0 and self.keys[i] == key else -1

    def find_all(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.empty(0, dtype=np.int64)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys))
        d = self.moved[(h % np.uint64(self.r)).astype(np.int64)]
        x = (h ^ (d.astype(np.uint64) * np.uint64(_K1))) * np.uint64(_K2)
        slots = np.where(d < 0, -d - 1, ((x >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64))
        found = self.owner[slots]
        same = np.fromiter((self.keys[i] == k for i, k in zip(found.tolist(), keys)), dtype=bool, count=len(keys))
        return np.where(same, found, -1)


class _Parts(dict):
    """Part of a pre-token to its id or -1, remembered."""

    def __init__(self, table: PerfectHash):
        self.find = table.find

    def __missing__(self, key: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        self[key] = out = self.find(key)
        return out


def merge(piece: bytes, parts: _Parts) -> list[int]:
    """Ids of a pre-token that is no vocabulary entry: heap of pairs over linked bytes."""
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))  # where the part that starts here ends; 0: merged away
    ids = [parts[piece[i : i + 1]] for i in range(n)]
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := parts[piece[i : i + 2]]) >= 0]
    heapq.heapify(heap)
    pop, add = heapq.heappop, heapq.heappush
    while heap:
        rank, i, stop = pop(heap)
        j = after[i] if end[i] else n
        if not end[i] or j >= n or end[j] != stop:
            continue  # one of the two parts has changed since
        ids[i], end[i], end[j], after[i] = rank, stop, 0, (k := after[j])
        if k < n:
            before[k] = i
            if (rank := parts[piece[i : end[k]]]) >= 0:
                add(heap, (rank, i, end[k]))
        if (h := before[i]) >= 0 and (rank := parts[piece[h:stop]]) >= 0:
            add(heap, (rank, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ``range(start, start + length)``."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) if total else np.empty(0, dtype=np.int64)
    return shift + np.arange(total, dtype=np.int64)


class _Memo(dict):
    """Pre-token to code; new ones are noted."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = code = len(self)
        self.new.append(key)
        return code


class Codec:
    """Encodes lists of texts and decodes ids with one vocabulary."""

    def __init__(self, vocabulary: list[bytes], pattern: str):
        self.table = PerfectHash(vocabulary)
        self.parts = _Parts(self.table)
        self.split = regex.compile(pattern)
        self.flat = np.frombuffer(b"".join(vocabulary), dtype=np.uint8)
        self.size = np.array([len(x) for x in vocabulary], dtype=np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self._restart()

    def _restart(self) -> None:
        self.memo = _Memo()
        self.ids, self.start, self.length = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _resolve(self) -> None:
        pieces = [x.encode() for x in self.memo.new]
        self.memo.new = []
        found = [[i] if i >= 0 else merge(p, self.parts) for i, p in zip(self.table.find_all(pieces).tolist(), pieces)]
        if not found:
            return
        length = np.array([len(x) for x in found], dtype=np.int64)
        self.start = np.concatenate((self.start, len(self.ids) + np.concatenate(([0], np.cumsum(length)[:-1]))))
        self.length = np.concatenate((self.length, length))
        self.ids = np.concatenate((self.ids, np.array([i for x in found for i in x], dtype=np.uint32)))

    def _codes(self, texts: list[str]) -> list[np.ndarray]:
        """The resolved pre-tokens of each text, by their number in the memo."""
        if len(self.memo) > MEMO:
            self._restart()
        memo, codes = self.memo, []
        for text in texts:
            pieces = self.split.findall(text)
            codes.append(np.fromiter(map(memo.__getitem__, pieces), dtype=np.int64, count=len(pieces)))
        self._resolve()
        return codes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, little-endian unsigned 32 bit."""
        return [self.ids[_ranges(self.start[c], self.length[c])].astype("<u4") for c in self._codes(texts)]

    def count(self, texts: list[str]) -> list[int]:
        """Number of ids of each text."""
        return [int(self.length[c].sum()) for c in self._codes(texts)]

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        return self.flat[_ranges(self.at[ids], self.size[ids])].tobytes()


_OPEN: dict[str, Codec] = {}


def _codec(key: str, vocabulary, pattern: str) -> Codec:
    """This worker's codec, kept from task to task."""
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Codec(vocabulary.value, pattern)
    return _OPEN[key]


def _slices(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``SLICE`` characters."""
    lo = 0
    while lo < len(lengths):
        hi, size = lo, 0
        while hi < len(lengths) and (hi == lo or size + lengths[hi] <= SLICE):
            size += lengths[hi]
            hi += 1
        yield lo, hi
        lo = hi


def token_counts(docs: DataFrame, path: str, pattern: str, text_col: str = "text", name: str = "n_tokens") -> DataFrame:
    """The columns of ``docs`` but the text, and the number of its tokens."""
    vocabulary = load_ranks(path)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    key = hashlib.sha256(pattern.encode() + b"\0".join(vocabulary)).hexdigest()
    others = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, shared, pattern)
        for b in batches:
            at, counts = b.num_columns - 1, []
            for lo, hi in _slices([x or 0 for x in b.column(at).to_pylist()]):
                counts += codec.count([x or "" for x in b.column(at - 1)[lo:hi].to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[: at - 1], pa.array(counts, pa.int64())], names=[*others, name])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others] + [f"{name} long"])
    return docs.select(*others, text_col, F.length(text_col).alias("__length")).mapInArrow(run, schema)


def encode_table(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256 (and ``ids`` where asked for)."""
    vocabulary = load_ranks(path)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    key = hashlib.sha256(pattern.encode() + b"\0".join(vocabulary)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, shared, pattern)
        for b in batches:
            for lo, hi in _slices([x or 0 for x in b.column(2).to_pylist()]):
                found = codec.encode([x or "" for x in b.column(1)[lo:hi].to_pylist()])
                columns = [
                    b.column(0)[lo:hi],
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in found], pa.string()),
                    pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in found], pa.string()),
                ]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col), F.length(text_col).alias("n"))
    return rows.mapInArrow(run, schema)

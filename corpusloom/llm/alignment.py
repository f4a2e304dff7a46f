"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Tokenizer A (byte-level BPE, a ``tokenizers`` file) encodes a space and the text, tokenizer B
(a ``sentencepiece`` model, which adds the space itself) the text. Both cut the same bytes. A *link* is
a pair of an A and a B token whose byte ranges overlap; a *group* ends where both have a token end.

Each task takes the rows of its Arrow partition in chunks of ``chunk_bytes`` of text. Texts are cut
into segments before a single space between two characters that are no white space: there A's
pattern always starts a new piece, and no piece of B has a space after another character (checked
when the model is loaded; else texts are not cut), so no merge of either crosses the place. The
distinct segments of a chunk are encoded once and laid on one byte axis, and DuckDB joins the tables of
token intervals: ASOF joins find each B token's first and last A token, a range join lists those
between, and window sums over the common ends number the groups. A text's numbers are sums over
its segments.

A chunk is stored as one row: the codes of its texts' segments, and for each distinct segment its links
(as positions in the chunk's table of pairs), groups and token counts. The chunks' pair counts are
merged in Spark and looked up when the stored chunks are read again; they reach that pass in
slices of whole B ids, at most ``slice_pairs`` pairs each (24 bytes a pair, counted before), one pass
for each slice, so what is broadcast has a fixed bound however many pairs a corpus has.

Edge cases: a null or empty text, or one that either tokenizer does not give back byte for byte (B
reads U+2581 as a space), has no tokens: zeros and an empty ``groups``, and its links count
nowhere. Texts of white space alone are encoded like any other. Repeated rows count each time and
repeat their result; ids may be null or repeated; other columns are not read; an empty table gives an
empty result. Very long texts are cut into segments like others; one without any space is one segment.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import re
from collections.abc import Iterator
from itertools import chain

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh_path, remove, stored

#: White space, what stands for it in B, and characters that regular expression engines do not agree on; no cut beside them.
_ODD = r"\s\x1c-\x1f\x85" + "".join(map(chr, [0x180E, *range(0x200B, 0x2010), 0x2028, 0x2029, 0x2060, 0x2581, 0xFEFF]))
CUT = re.compile(rf"(?<=[^{_ODD}]) (?=[^{_ODD}])")
#: Segments encoded as one text.
TOGETHER = 512

CHUNKS = "keys array<long>, chunk binary, best array<long>, total array<long>, a array<long>, b array<long>, n array<long>"
KIND = pa.schema([("keys", pa.list_(pa.int64())), ("chunk", pa.binary()), *[(c, pa.list_(pa.int64())) for c in ("best", "total", "a", "b", "n")]])
TOTALS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [i for i in range(256) if i not in set(prints)]
    return {i: chr(i) for i in prints} | {i: chr(0x100 + n) for n, i in enumerate(rest)}


class Tokenizers:
    """Both tokenizers and the bytes of their tokens.

    A file whose merges are in the order of their ids is a table of ranks, which the rank encoder
    takes as it is; other files go through ``tokenizers``.
    """

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        model = json.loads(a)["model"]
        letters, vocab = {c: i for i, c in byte_letters().items()}, model["vocab"]
        plain = {bytes(letters[c] for c in entry): i for entry, i in vocab.items() if all(c in letters for c in entry)}
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged == list(range(256, 256 + len(merged))) and not model.get("ignore_merges"):
            ranks = {k: i for k, i in plain.items() if len(k) == 1 or i >= 256}
            ranked = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode_a = ranked.encode_ordinary
        else:
            whole = Tokenizer.from_str(a.decode())
            whole.encode_special_tokens = True
            self.encode_a = lambda text: whole.encode(text, add_special_tokens=False).ids
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for entry, i in plain.items():
            self.a_bytes[i] = entry
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.a_size, self.b_size = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))

    def segments(self, text: str) -> list[str]:
        """The text, with a space before it, cut; every segment without its first space."""
        return CUT.split(text) if self.cuts else [text]

    def encode(self, segments: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]:
        """(ids, tokens of each segment) for A and for B, and whether both give back a segment's bytes.

        Segments are encoded many at a time where they may be cut; if a text of many does not come back,
        they are encoded one by one.
        """
        parts: list[tuple[list[int], list[int], np.ndarray, np.ndarray, np.ndarray]] = []
        step = TOGETHER if self.cuts else 1
        for i in range(0, len(segments), step):
            some = segments[i : i + step]
            found = self._together(some)
            parts += [found] if found else [self._alone(s) for s in some]
        if not parts:
            none = np.empty(0, np.int64)
            return (none, none), (none, none), np.empty(0, bool)
        a, b = (np.fromiter(chain.from_iterable(p[i] for p in parts), dtype=np.int64) for i in (0, 1))
        return (a, np.concatenate([p[2] for p in parts])), (b, np.concatenate([p[3] for p in parts])), np.concatenate([p[4] for p in parts])

    def _together(self, segments: list[str]) -> tuple | None:
        text = " ".join(segments)
        want = b" " + text.encode()
        ends = np.cumsum(pc.binary_length(pa.array(segments, pa.string())).to_numpy().astype(np.int64) + 1)
        both, counts = (self.encode_a(" " + text), self.b.encode(text)), []
        for ids, table, size in zip(both, (self.a_bytes, self.b_bytes), (self.a_size, self.b_size)):
            stops = np.cumsum(size[ids])
            at = np.searchsorted(stops, ends)
            if b"".join(map(table.__getitem__, ids)) != want or at[-1] >= len(stops) or (stops[at] != ends).any():
                return None
            counts.append(np.diff(at, prepend=-1))
        return (*both, *counts, np.ones(len(segments), bool))

    def _alone(self, segment: str) -> tuple:
        a, b = self.encode_a(" " + segment), self.b.encode(segment)
        want = b" " + segment.encode()
        sound = b"".join([self.a_bytes[x] for x in a]) == want == b"".join([self.b_bytes[x] for x in b])
        a, b = (a, b) if sound else ([], [])
        return a, b, np.array([len(a)]), np.array([len(b)]), np.array([sound])


class Aligner:
    """Interval joins over the distinct segments of a chunk, in DuckDB."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.con = duckdb.connect(config={"threads": 1, "temp_directory": ""})

    def _make(self, name: str, query: str) -> None:
        self.con.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS {query}")

    def load(self, segments: list[str]) -> None:
        """Token intervals ``a`` and ``b`` of the segments on one byte axis, and ``links`` (seg, a, b)."""
        (a, self.n_a), (b, self.n_b), self.sound = self.tokenizers.encode(segments)
        for name, ids, n, size in (("a", a, self.n_a, self.tokenizers.a_size), ("b", b, self.n_b, self.tokenizers.b_size)):
            stop = np.cumsum(size[ids])
            rows = {"k": np.arange(len(ids)), "seg": np.repeat(np.arange(len(n)), n), "start": stop - size[ids], "stop": stop, "id": ids}
            whole = pa.int32() if not len(stop) or stop[-1] < 1 << 31 else pa.int64()
            self.con.register(f"{name}_tokens", pa.table({c: pa.array(x).cast(whole) for c, x in rows.items()}))
            self._make(name, f"SELECT * FROM {name}_tokens")
        self._make("firsts", "SELECT b.seg, b.id AS b, b.stop, a.k AS first, a.id AS first_a FROM b ASOF JOIN a ON a.start <= b.start")
        self._make("spans", "SELECT f.seg, f.b, f.first, f.first_a, a.k AS last, a.id AS last_a FROM firsts f ASOF JOIN a ON a.start < f.stop")
        self.con.execute("DROP TABLE firsts")
        self._make(
            "links",
            """SELECT seg, first_a AS a, b FROM spans UNION ALL SELECT seg, last_a, b FROM spans WHERE last > first
            UNION ALL SELECT s.seg, a.id, s.b FROM (SELECT * FROM spans WHERE last > first + 1) s JOIN a ON a.k > s.first AND a.k < s.last""",
        )
        self.con.execute("DROP TABLE spans")
        self._make("pairs", "SELECT row_number() OVER () - 1 AS pair, a, b FROM (SELECT DISTINCT a, b FROM links) ORDER BY pair")

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Segment and pair of every link, and the A and B id of every pair."""
        found = self.con.sql("SELECT seg, pair FROM links JOIN pairs USING (a, b) ORDER BY seg").to_arrow_table()
        pairs = self.con.sql("SELECT a, b FROM pairs ORDER BY pair").to_arrow_table()
        return (*(found.column(c).to_numpy() for c in ("seg", "pair")), *(pairs.column(c).to_numpy() for c in "ab"))

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """For each segment the number of its groups, and the groups as text."""
        self._make("cuts", "SELECT a.stop FROM a JOIN b USING (stop)")
        numbered = """SELECT {0} AS side, k, seg, id, coalesce(sum((c.stop IS NOT NULL)::INTEGER) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g
            FROM {1} LEFT JOIN cuts c USING (stop)"""
        found = self.con.sql(f"{numbered.format(0, 'a')} UNION ALL {numbered.format(1, 'b')} ORDER BY g, side, k").to_arrow_table()
        side, seg, ids, g = (found.column(c).to_numpy() for c in ("side", "seg", "id", "g"))
        n, texts = np.zeros(len(self.sound), np.int64), np.full(len(self.sound), "", dtype=object)
        if len(g):
            new_seg, new_g, new_side = (np.r_[True, x[1:] != x[:-1]] for x in (seg, g, side))
            mark = np.where(new_seg, 0, np.where(new_g, 1, np.where(new_side, 2, 3)))
            names = np.array(list(map(str, range(int(ids.max()) + 1))), dtype=object)
            parts = (np.array(["", ";", "|", ","], dtype=object)[mark] + names[ids]).tolist()
            at = np.flatnonzero(new_seg)
            n[seg[at]] = np.add.reduceat(new_g.astype(np.int64), at)
            texts[seg[at]] = np.array(["".join(parts[i:j]) for i, j in zip(at.tolist(), [*at[1:].tolist(), len(parts)])], dtype=object)
        return n, texts


_LOADED: dict[str, Tokenizers] = {}


def _tokenizers(files: Broadcast) -> Tokenizers:
    """The tokenizers of a broadcast pair of files, loaded once in a worker."""
    digest, a, b = files.value
    if digest not in _LOADED:
        _LOADED.clear()
        _LOADED[digest] = Tokenizers(a, b)
    return _LOADED[digest]


def _files(spark: SparkSession, a_path: str, b_path: str) -> Broadcast:
    """Both tokenizer files (a few MB of fixed size) for the tasks."""
    both = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            both.append(f.read())
    if (kind := json.loads(both[0])["model"]["type"]) != "BPE":
        raise ValueError(f"tokenizer A is {kind}, not BPE")
    return spark.sparkContext.broadcast((hashlib.sha256(b"".join(both)).hexdigest(), *both))


def _texts(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """(key, text) rows in lists of about so many bytes of text."""
    rows, size = [], 0
    for b in batches:
        for row in zip(b.column(0).to_pylist(), b.column(1)):
            rows.append((row[0], text := row[1].as_py()))
            size += len(text or "")
            if size >= chunk_bytes:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _summed(codes: np.ndarray, stops: np.ndarray, sound: np.ndarray, by_segment: np.ndarray) -> np.ndarray:
    """Sums over the segments of each text; 0 for texts that are not sound."""
    total = np.r_[0, np.cumsum(by_segment[codes])]
    return np.where(sound, total[stops[1:]] - total[stops[:-1]], 0)


def _chunk(aligner: Aligner, rows: list[tuple[int | None, str | None]]) -> dict:
    """A chunk of rows as one row of CHUNKS."""
    known: dict[str, int] = {}
    cut, parts, stops = aligner.tokenizers.segments, [], [0]
    for _, text in rows:
        own = [known.setdefault(s, len(known)) for s in cut(text)] if text else []
        parts.append(np.array(own, dtype=np.uint32))
        stops.append(stops[-1] + len(own))
    codes, stops = np.concatenate(parts), np.array(stops)
    aligner.load(list(known))
    bad = np.r_[0, np.cumsum(~aligner.sound[codes])]
    sound = (bad[stops[1:]] == bad[stops[:-1]]) & (stops[1:] > stops[:-1])
    weight = np.bincount(codes[np.repeat(sound, np.diff(stops))], minlength=len(known)).astype(np.int64)
    seg, pair, a, b = aligner.links()
    n = np.zeros(len(a), np.int64)
    np.add.at(n, pair, weight[seg])
    n_groups, groups = aligner.groups()
    small = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
    state = {
        "codes": small(codes), "stops": stops, "sound": sound, "n_a": small(aligner.n_a), "n_b": small(aligner.n_b), "n_groups": small(n_groups),
        "n_links": small(np.bincount(seg, minlength=len(known))), "pair": small(pair), "a": a, "b": b, "groups": "\n".join(groups.tolist()),
    }
    packed = zstandard.ZstdCompressor(level=1).compress(pickle.dumps(state, protocol=5))
    met = n > 0
    return {"keys": [r[0] for r in rows], "chunk": packed, "best": [], "total": [], "a": a[met], "b": b[met], "n": n[met]}


def chunks(docs: DataFrame, files: Broadcast, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """One row of CHUNKS for every so many bytes of text of a task; the pair counts are those of the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for rows in _texts(batches, chunk_bytes):
            aligner = aligner or Aligner(_tokenizers(files))
            yield pa.RecordBatch.from_pylist([_chunk(aligner, rows)], schema=KIND)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, CHUNKS)


def pair_counts(found: DataFrame) -> DataFrame:
    """a, b, n: how many links of the corpus hold the pair of ids, from stored chunks."""
    each = found.select(F.explode(F.arrays_zip("a", "b", "n")).alias("p"))
    return each.groupBy("p.a", "p.b").agg(F.sum("p.n").alias("n"))


def _slices(pairs: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges of B ids (from, to) with at most so many pairs each; one B id at least. Reads one row for each B id."""
    out: list[tuple[int, int]] = []
    size = 0
    for b, n in pairs.groupBy("b").count().orderBy("b").collect():
        if not out or size + n > most:
            out.append((b, b))
            size = 0
        out[-1] = (out[-1][0], b)
        size += n
    return out


def _counts(pairs: DataFrame, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (B id, A id) of a slice, their counts, and the highest count of each one's B id."""
    found = pairs.filter(F.col("b").between(low, high)).select(F.shiftleft("b", 32).bitwiseOR(F.col("a")).alias("key"), "n").toArrow()
    order = np.argsort(key := found.column("key").to_numpy())
    key, n = key[order], found.column("n").to_numpy()[order]
    if not len(key):
        return key, n, n
    first = np.flatnonzero(np.r_[True, (key[1:] >> 32) != (key[:-1] >> 32)])
    return key, n, np.repeat(np.maximum.reduceat(n, first), np.diff(np.r_[first, len(key)]))


def _looked_up(row: dict, counts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[dict, np.ndarray, np.ndarray]:
    """The state of a chunk, and n_best and count_sum of its texts with the counts of one slice added."""
    state = pickle.loads(zstandard.ZstdDecompressor().decompress(row["chunk"]))
    key, n, top = counts
    own = (state["b"].astype(np.int64) << 32) | state["a"]
    value, best = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    if len(key) and len(own):
        at = np.minimum(np.searchsorted(key, own), len(key) - 1)
        met = key[at] == own
        value, best = np.where(met, n[at], 0), (met & (n[at] == top[at])).astype(np.int64)
    stops = np.r_[0, np.cumsum(state["n_links"], dtype=np.int64)]
    codes, doc_stops, sound = state["codes"], state["stops"], state["sound"]
    sums = []
    for x, before in ((best, row["best"]), (value, row["total"])):
        total = np.r_[0, np.cumsum(x[state["pair"]])]
        new = _summed(codes, doc_stops, sound, total[stops[1:]] - total[stops[:-1]])
        sums.append(new + np.array(before, dtype=np.int64) if before else new)
    return state, *sums


def _documents(row: dict, counts: tuple) -> Iterator[pa.RecordBatch]:
    """The rows of a chunk's texts, in batches of a few MB."""
    state, best, total = _looked_up(row, counts)
    codes, stops, sound = (state[c] for c in ("codes", "stops", "sound"))
    columns = [_summed(codes, stops, sound, state[c].astype(np.int64)) for c in ("n_a", "n_b", "n_groups", "n_links")] + [best, total]
    named = np.array(state["groups"].split("\n"), dtype=object)
    start, size, groups = 0, 0, []
    for i in range(len(sound)):
        groups.append(";".join(named[codes[stops[i] : stops[i + 1]]].tolist()) if sound[i] else "")
        size += len(groups[-1])
        if size > 1 << 22 or i == len(sound) - 1:
            cut = slice(start, i + 1)
            yield pa.RecordBatch.from_arrays([pa.array(row["keys"][cut], pa.int64()), *[pa.array(c[cut], pa.int64()) for c in columns], pa.array(groups, pa.string())], names=["key", *TOTALS, "groups"])
            start, size, groups = i + 1, 0, []


def align(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", slice_pairs: int = 1 << 21, chunk_bytes: int = 2 << 20
) -> DataFrame:
    """One row per input row: id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (``a1,a2|b1;a3|b2,b3``)."""
    spark = docs.sparkSession
    found = stored(chunks(docs, _files(spark, a_path, b_path), id_col, text_col, chunk_bytes), "alignment-chunks")
    pairs = stored(pair_counts(found), "alignment-pairs")
    slices = _slices(pairs, slice_pairs) or [(0, 0)]
    for i, (low, high) in enumerate(slices[:-1]):  # driver and tasks hold one slice at a time
        counts = spark.sparkContext.broadcast(_counts(pairs, low, high))

        def add(batches: Iterator[pa.RecordBatch], counts: Broadcast = counts) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    _, best, total = _looked_up(row, counts.value)
                    yield pa.RecordBatch.from_pylist([row | {"best": best, "total": total}], schema=KIND)

        path = fresh_path(spark, "alignment-chunks")
        found.mapInArrow(add, CHUNKS).write.parquet(path)
        if i:
            remove(spark, before)
        found, before = spark.read.schema(found.schema).parquet(path), path
        counts.destroy()
    counts = spark.sparkContext.broadcast(_counts(pairs, *slices[-1]))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                yield from _documents(row, counts.value)

    rows = found.mapInArrow(last, f"key long, {', '.join(c + ' long' for c in TOTALS)}, groups string")
    return rows.select(F.col("key").alias(id_col), *TOTALS, "groups")

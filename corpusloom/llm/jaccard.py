"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, by a count-vector R-tree.

A document's set: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, its distinct shingles of ``width``
words (fewer words: the whole sequence as one; none: the empty set). A shingle is known by 64 bits of
hash, within the sets of two documents compared. Two documents link when
``100 * |both| >= percent * |either|``; equal sets are one node from the start, empty sets link with nothing.

* *Keys.* A set's shingles are put in one order for all (rarest first by a bounded sample, then by
  hash; the order changes the speed only). Two sets that link share a shingle among the first
  ``n - ceil(n * percent / 100) + 1`` of each, so these are its keys. The nodes of a key are a bucket; equal buckets,
  which near copies make by the hundred, are one. Where a key has very many nodes (``CROWD`` in what a task
  combines before it sends, ``LARGE`` in all), they are named by one of them, so such a key moves as few rows.
* *R-tree.* A set's shingles are hashed to ``GROUPS`` groups; the counts by group are a point. Points are
  bulk-loaded into pages, whose corners bound what their points can share with another page's:
  the sum over the groups of the smaller of both maxima. Pairs of pages are followed together from
  the root while that bound reaches what the smallest sizes need, and left when all points below are linked
  already. A first tree over each bucket's points finds the pairs that pass the bound; their connected
  components are the regions. A second tree over each region verifies what passes on the sets.
* *Large regions*, of more than ``region_bytes`` of text, are cut into blocks. Each block is solved alone, then the
  middle nodes of the blocks' largest components, then every node outside the region's largest component
  against all others, in pairs of blocks. A group of copies of any size is so read about three times,
  and no pair of documents is left out.

What goes on is always a spanning forest of the links, never the pairs.

Edge cases: null counts as the empty text; null ids sort above every id, so only a component without
any id has a null name; rows that repeat an id or a text are rows like others; other columns are not read; an
empty table gives an empty result; very long texts are one set like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import stored
from corpusloom.llm.exact_dedup import Filter, bloom, words_for
from corpusloom.llm.simhash import LAST, _check, _id, _roots, _union, components, named

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PRIMES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5]
GROUPS = 256
PAGE, FAN = 16, 8
AT_ONCE = 1 << 14
COMBINED = 1 << 20
CROWD, LARGE = 64, 1 << 14

ROWS = "id long, check long, digest binary, name long, n long, size long, counts binary, keys array<long>"
EDGES = "a binary, b binary"


def shingles(text: str, width: int = 4) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - width + 1)
    own = np.full(n, min(width, len(h)), dtype=np.uint64)  # so that a short sequence is no shingle of a longer text
    for i in range(min(width, len(h))):
        own = (own ^ (own >> np.uint64(29))) * np.uint64(_PRIMES[i % 4]) + h[i : i + n]
    own ^= own >> np.uint64(32)
    return np.unique(own * np.uint64(_PRIMES[0]))


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of two linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


class Tree:
    """Pages over points sorted by (region, tile), level by level up to one page for each region."""

    def __init__(self, region: np.ndarray, points: np.ndarray, size: np.ndarray):
        self.points, self.size = points, size
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # start, stop (of the level below), corner, least size
        owner, corner, least, step = region, points, size, PAGE
        while True:
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            within = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
            start = np.flatnonzero(within % step == 0)
            corner, least = np.maximum.reduceat(corner, start, axis=0), np.minimum.reduceat(least, start)
            self.levels.append((start, np.r_[start[1:], len(owner)], corner, least))
            owner, step = owner[start], FAN
            if len(np.unique(owner)) == len(owner):
                break

    def span(self, level: int, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last point, exclusive, below pages of a level."""
        low, high = self.levels[level][0][pages], self.levels[level][1][pages]
        for start, stop, _, _ in reversed(self.levels[:level]):
            low, high = start[low], stop[high - 1]
        return low, high


def _crossed(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (i, j) of the ranges of each pair, i <= j where both are one page; and the pair's number."""
    wide, high = a1 - a0, b1 - b0
    n = wide * high
    pair = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    i, j = a0[pair] + at // high[pair], b0[pair] + at % high[pair]
    keep = ~same[pair] | (i <= j)
    return i[keep], j[keep], pair[keep]


def _tiles(region: np.ndarray, points: np.ndarray, size: np.ndarray) -> np.ndarray:
    """An order that keeps near points of a region together: slabs of one coordinate, then another."""
    half = points[:, : points.shape[1] // 2].sum(1, dtype=np.int64)
    even = points[:, ::2].sum(1, dtype=np.int64)
    order = np.lexsort((half, size, region))
    first = np.flatnonzero(np.r_[True, np.diff(region[order]) != 0])
    count = np.diff(np.r_[first, len(order)])
    within = np.arange(len(order)) - np.repeat(first, count)
    slab = within // np.maximum(PAGE, np.sqrt(count * PAGE).astype(np.int64)).repeat(count)
    return order[np.lexsort((even[order], half[order], slab, region[order]))]


def counted(sets: list[np.ndarray]) -> np.ndarray:
    """The count vector of each set."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    group = (np.concatenate([np.empty(0, np.uint64), *sets]) >> np.uint64(40)).astype(np.int64) % GROUPS
    return np.bincount(owner * GROUPS + group, minlength=n * GROUPS).reshape(n, GROUPS)


def narrow(counts: np.ndarray) -> np.ndarray:
    """In the smallest unsigned kind that holds them."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def forest(
    region: np.ndarray, given: np.ndarray, counts: np.ndarray, size: np.ndarray, percent: int, sets: list[np.ndarray] | None = None
) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Edges (positions) of a spanning forest of the links inside each region, and each region's middle nodes as a mask.

    Nodes with the same ``given`` number count as linked already. Without ``sets``, pairs that pass the bound
    on their points count as linked.
    """
    n = len(size)
    order = _tiles(region, counts, size)
    region, given, counts, size = region[order], given[order], counts[order], size[order]
    sets = [sets[i] for i in order] if sets is not None else None
    _, first, back = np.unique(given, return_index=True, return_inverse=True)
    parent = first[back].astype(np.int64)
    edges: list[tuple[int, int]] = []

    def bound(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the summed minima of two points reach what their sizes need."""
        out = np.empty(len(i), dtype=bool)
        for k in range(0, len(i), AT_ONCE):
            x, y = i[k : k + AT_ONCE], j[k : k + AT_ONCE]
            out[k : k + AT_ONCE] = np.minimum(counts[x], counts[y]).sum(1, dtype=np.int64) >= needed(size[x], size[y], percent)
        return out

    def verify(i: np.ndarray, j: np.ndarray) -> None:
        """Add the edges of those pairs that link and are not linked already."""
        nonlocal parent
        i, j = i[(open_ := bound(i, j))], j[open_]
        root = parent.tolist()

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in zip(i.tolist(), j.tolist()):
            rx, ry = find(x), find(y)
            if rx == ry:
                continue
            if sets is None:
                root[max(rx, ry)] = min(rx, ry)
                edges.append((x, y))
                continue
            a, b = (sets[x], sets[y]) if len(sets[x]) <= len(sets[y]) else (sets[y], sets[x])
            at = np.searchsorted(b, a)
            both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
            if 100 * both >= percent * (len(a) + len(b) - both):
                root[max(rx, ry)] = min(rx, ry)
                edges.append((x, y))
        parent = _roots(np.array(root, dtype=np.int64))

    # Near-copies first: neighbours in the order of tiles, and every node with its region's middle node.
    starts = np.flatnonzero(np.r_[True, region[1:] != region[:-1]])
    stops = np.r_[starts[1:], n]
    middle = np.empty(len(starts), dtype=np.int64)
    for r, (i, j) in enumerate(zip(starts, stops)):
        away = np.abs(counts[i:j].astype(np.int64) - np.median(counts[i:j], axis=0).astype(np.int64)[None]).sum(1) if j - i > 2 else np.zeros(j - i)
        middle[r] = i + int(np.argmin(away))
    pivot = np.repeat(middle, stops - starts)
    each = np.arange(n)
    verify(pivot[pivot != each], each[pivot != each])
    next_ = each[:-1][region[1:] == region[:-1]]
    verify(next_, next_ + 1)
    tree = Tree(region, counts, size)
    stack = [(len(tree.levels) - 1, tops := np.arange(len(tree.levels[-1][0])), tops)]
    while stack:
        level, a, b = stack.pop()
        if len(a) > 256:
            stack.append((level, a[256:], b[256:]))
            a, b = a[:256], b[:256]
        if level >= 0:
            # Left when all points below both are linked already: their roots never change along the order.
            change = np.r_[0, np.cumsum(parent[1:] != parent[:-1])]
            (a0, a1), (b0, b1) = tree.span(level, a), tree.span(level, b)
            done = (change[a1 - 1] == change[a0]) & (change[b1 - 1] == change[b0]) & (parent[a0] == parent[b0])
            corner, least = tree.levels[level][2:]
            near = np.minimum(corner[a], corner[b]).sum(1, dtype=np.int64) >= needed(least[a], least[b], percent)
            a, b = a[near & ~done], b[near & ~done]
            if not len(a):
                continue
            start, stop = tree.levels[level][:2]
            i, j, _ = _crossed(start[a], stop[a], start[b], stop[b], a == b)
            if level:
                stack.append((level - 1, i, j))
            else:
                open_ = (parent[i] != parent[j]) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
                verify(i[open_], j[open_])
    mask = np.zeros(n, dtype=bool)
    mask[order[middle]] = True
    return [(int(order[i]), int(order[j])) for i, j in edges], mask


def _order(docs: DataFrame, text_col: str, width: int, sample: int, most: int) -> Broadcast:
    """Sorted hashes of the commonest shingles of a sample of the rows, at most ``most`` of them, and their counts."""
    spark = docs.sparkSession
    total = docs.count()
    share = F.pmod(F.xxhash64(F.xxhash64(text_col)), F.lit(1 << 31)) < int((1 << 31) * min(1.0, sample / max(1, total)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                found = shingles(x.as_py() or "", width).view(np.int64)
                for i in range(0, len(found), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(found[i : i + (1 << 16)], pa.int64())], names=["h"])

    each = docs.filter(share).select(text_col).distinct().mapInArrow(run, "h long")
    common = each.groupBy("h").count().filter("count > 1").orderBy(F.desc("count"), "h").limit(most).toArrow()
    h, n = (common.column(c).to_numpy() for c in ("h", "count"))
    order = np.argsort(h.view(np.uint64))
    return spark.sparkContext.broadcast((h.view(np.uint64)[order], n[order]))


def document_sets(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, common: Broadcast) -> DataFrame:
    """ROWS: a digest of each row's set, its first 8 bytes, its size, the length of the text, the set's point and its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n = common.value
        for b in batches:
            out: list[tuple] = []
            for i, check, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = text.as_py() or ""
                own = shingles(text, width)
                digest = xxhash.xxh3_128_digest(own.tobytes())
                keys = own
                if len(own):
                    at = np.minimum(np.searchsorted(h, own), len(h) - 1) if len(h) else None
                    count = np.where(h[at] == own, n[at], 0) if len(h) else np.zeros(len(own), np.int64)
                    keys = own[np.lexsort((own, count))[: len(own) - -(-len(own) * percent // 100) + 1]]
                point = narrow(counted([own])).tobytes()
                out.append((i, check, digest, int.from_bytes(digest[:8], "big", signed=True), len(own), len(text), point, keys.view(np.int64)))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=[c.split()[0] for c in ROWS.split(", ")])

    return docs.select(_id(id_col), _check(text_col), F.col(text_col)).mapInArrow(run, ROWS)


def buckets(rows: DataFrame) -> DataFrame:
    """bucket, a, b: the nodes (names of sets) of every key that has several, a = b; and edges (bucket 0) from nodes of crowded keys to one of them."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, a, b): a = b is a node of a key; edges from all but one node of a crowd in the task's rows, keyed by themselves."""
        kept: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            both = np.unique(np.concatenate(kept), axis=0)
            key, node = both[:, 0], both[:, 1]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            count = np.diff(np.r_[start, len(key)])
            lead = np.repeat(node[start], count)
            crowd = np.repeat(count > CROWD, count) & (node != lead)
            edges = np.unique(np.stack((node[crowd], lead[crowd]), axis=1), axis=0)
            columns = (np.r_[key[~crowd], edges[:, 0]], np.r_[node[~crowd], edges[:, 0]], np.r_[node[~crowd], edges[:, 1]])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "a", "b"])

        for b in batches:
            keys = b.column(1)
            kept.append(np.stack((keys.flatten().to_numpy(), np.repeat(b.column(0).to_numpy(), keys.value_lengths().to_numpy())), axis=1))
            size += len(kept[-1])
            if size >= COMBINED:
                yield out()
                kept, size = [], 0
        if size:
            yield out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets of whole keys, from rows sorted by key and node."""
        seen: set[int] = set()

        def out(key: np.ndarray, node: np.ndarray, edges: list[np.ndarray]) -> pa.RecordBatch:
            new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])] if len(key) else np.empty(0, bool)
            key, node = key[new], node[new]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
            count = np.diff(np.r_[start, len(key)])
            mixed = node.view(np.uint64) * np.uint64(_PRIMES[1])
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(_PRIMES[2])
            names = (np.add.reduceat(mixed, start) if len(start) else mixed[:0]).view(np.int64)
            large = count > LARGE
            fresh = np.zeros(len(names), dtype=bool)
            for i in np.flatnonzero((count > 1) & ~large).tolist():
                if (name := int(names[i])) not in seen:
                    seen.add(name)
                    fresh[i] = True
            if len(seen) > COMBINED:
                seen.clear()
            member = np.repeat(fresh, count)
            lead, far = np.repeat(node[start], count), np.repeat(large, count)
            far &= node != lead
            edges = np.unique(np.concatenate([*edges, np.stack((node[far], lead[far]), axis=1)]), axis=0)
            columns = (np.r_[np.repeat(names, count)[member], np.zeros(len(edges), np.int64)], np.r_[node[member], edges[:, 0]], np.r_[node[member], edges[:, 1]])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["bucket", "a", "b"])

        keys, nodes, edges, size = [], [], [], 0
        for b in batches:
            key, a, c = (x.to_numpy() for x in b.columns)
            edges.append(np.stack((a[a != c], c[a != c]), axis=1))
            key, a = key[a == c], a[a == c]
            if not len(key):
                continue
            keys.append(key)
            nodes.append(a)
            size += len(key)
            if size > 16 * LARGE:
                key, a = np.concatenate(keys), np.concatenate(nodes)
                cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
                if cut:
                    yield out(key[:cut], a[:cut], edges)
                    keys, nodes, edges, size = [key[cut:]], [a[cut:]], [], len(key) - cut
                else:  # one key so far: its nodes are named by the first
                    edges.append(np.stack((a[1:], np.full(len(a) - 1, a[0])), axis=1)[a[1:] != a[0]])
                    yield out(key[:0], a[:0], edges)
                    keys, nodes, edges, size = [key[:1]], [a[:1]], [], 1
        if keys or edges:
            yield out(np.concatenate([np.empty(0, np.int64), *keys]), np.concatenate([np.empty(0, np.int64), *nodes]), edges)

    keyed = rows.filter("n > 0").select("name", "keys").mapInArrow(combine, "key long, a long, b long")
    return keyed.repartition("key").sortWithinPartitions("key", "a").mapInArrow(meet, "bucket long, a long, b long")


def regions(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """node, root: connected components of nodes (name, n, counts) that share a bucket and whose points pass the bound; lone nodes are not named."""
    found = stored(buckets(rows), "jaccard-buckets")
    members = found.filter("a = b").select("bucket", F.col("a").alias("name")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        size = 0

        def out(rows: pa.Table) -> pa.RecordBatch:
            name, size = rows.column("name").to_numpy(), rows.column("n").to_numpy()
            wide = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}
            counts = [np.frombuffer(x, wide[len(x) // GROUPS]) for x in rows.column("counts").to_pylist()]
            edges, _ = forest(rows.column("bucket").to_numpy(), np.arange(len(rows)), narrow(np.stack(counts).astype(np.int64)), size, percent)
            return pa.RecordBatch.from_arrays([pa.array(name[[e[k] for e in edges]].astype(np.int64)) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            kept.append(b)
            size += b.num_rows
            if size >= LARGE:
                rows = pa.Table.from_batches(kept)
                key = rows.column("bucket").to_numpy()
                cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0  # the last bucket may go on
                if cut:
                    yield out(rows.slice(0, cut))
                    kept = rows.slice(cut).to_batches()
                    size -= cut
        if kept:
            yield out(pa.Table.from_batches(kept))

    placed = members.join(nodes.select("name", "n", "counts"), "name").select("bucket", "name", "n", "counts")
    near = placed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")
    linked = stored(components(near.unionByName(found.filter("a <> b").select("a", "b"))), "jaccard-shared")
    return linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct())


def _solve(work: DataFrame, width: int, percent: int, at_once: int, with_middle: bool = False) -> DataFrame:
    """Forest edges of the links in each group of rows (task, given, digest, text); ``with_middle``: a = b for its middle node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        size = 0

        def out(rows: list[tuple]) -> pa.RecordBatch:
            numbers = {g: i for i, g in enumerate(dict.fromkeys(r[0] for r in rows))}
            given = {g: i for i, g in enumerate(dict.fromkeys(r[1] for r in rows))}
            sets = [shingles(r[3], width) for r in rows]
            size = np.array([len(x) for x in sets], dtype=np.int64)
            edges, middle = forest(np.array([numbers[r[0]] for r in rows]), np.array([given[r[1]] for r in rows]), narrow(counted(sets)), size, percent, sets)
            if with_middle:
                edges += [(i, i) for i in np.flatnonzero(middle).tolist()]
            return pa.RecordBatch.from_arrays([pa.array([rows[e[k]][2] for e in edges], pa.binary()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns[:3]], b.column(3)):
                row = (*row[:3], row[3].as_py())
                if size > at_once and row[0] != kept[-1][0]:  # whole groups only
                    yield out(kept)
                    kept, size = [], 0
                kept.append(row)
                size += len(row[3])
        if kept:
            yield out(kept)

    dealt = work.select("task", "given", "digest", "text").repartition("task").sortWithinPartitions("task")
    return dealt.mapInArrow(run, EDGES)


def _links(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, width: int, percent: int, region_bytes: int) -> DataFrame:
    """Forest edges between the digests of nodes (digest, name, least, size, root) that share a region."""
    # Only texts whose row passes the filter of chosen rows move.
    words = words_for(nodes.count())
    chosen = Filter(stored(bloom(nodes.select(F.col("least.check").alias("digest")), words), "jaccard-filter"), words)
    texts = docs.select(_id(id_col), _check(text_col), F.col(text_col).alias("text")).filter(chosen.passes(F.col("check")))
    keyed = nodes.select(F.col("least.id").alias("id"), F.col("least.check").alias("check"), "digest", "root")
    found = texts.join(keyed, ["id", "check"]).dropDuplicates(["digest"])
    total = nodes.groupBy("root").agg(F.sum("size").alias("bytes"))
    large = stored(total.filter(F.col("bytes") > region_bytes).withColumn("blocks", F.ceil(F.col("bytes") / region_bytes)), "jaccard-large")
    if large.isEmpty():
        return _solve(found.select(F.col("root").alias("task"), "digest", "text", F.col("digest").alias("given")), width, percent, region_bytes)
    found = stored(found, "jaccard-texts")
    small = found.join(large, "root", "left_anti").select(F.col("root").alias("task"), F.col("digest").alias("given"), "digest", "text")
    edges = _solve(small, width, percent, region_bytes)
    # Rows of a large region: `large` has one row for each, so Spark can split what it meets.
    rows = stored(found.join(large, "root").withColumn("block", F.pmod(F.xxhash64("digest"), "blocks")), "jaccard-blocks")
    named_ = lambda *c: F.xxhash64(*c)
    first = stored(_solve(rows.select(named_("root", "block").alias("task"), F.col("digest").alias("given"), "digest", "text"), width, percent, region_bytes, True), "jaccard-first")
    middles = rows.join(first.filter("a = b").select(F.col("a").alias("digest")), "digest", "left_semi")
    across = stored(_solve(middles.select(F.col("root").alias("task"), F.col("digest").alias("given"), "digest", "text"), width, percent, region_bytes), "jaccard-middles")
    so_far = first.filter("a <> b").unionByName(across)
    joined = components(so_far).select(F.col("node").alias("digest"), F.col("root").alias("part"))
    placed = stored(rows.join(joined, "digest", "left").withColumn("part", F.coalesce("part", "digest")), "jaccard-placed")
    parts = placed.groupBy("root", "part").agg(F.sum("size" if "size" in placed.columns else F.length("text")).alias("bytes"))
    main = stored(parts.groupBy("root").agg(F.max(F.struct("bytes", "part")).alias("m"), F.sum("bytes").alias("all")), "jaccard-main")
    # Outside the largest part: every node against all others of the region.
    main = main.select("root", F.col("m.part").alias("main"), F.ceil((F.col("all") - F.col("m.bytes")) / region_bytes).alias("outer"))
    sided = placed.join(main.filter("outer > 0"), "root")
    sided = sided.withColumn("row", F.pmod(F.xxhash64("digest"), F.when(F.col("part") == F.col("main"), F.col("blocks")).otherwise(F.col("outer"))))
    inner, outer = sided.filter("part = main"), sided.filter("part <> main")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    give = lambda d, *key: d.select(named_("root", *key).alias("task"), F.col("part").alias("given"), "digest", "text")
    mixed = give(inner.withColumn("o", every("outer")), F.lit("i"), "o", "row").unionByName(give(outer.withColumn("i", every("blocks")), F.lit("i"), "row", "i"))
    twice = outer.withColumn("other", every("outer"))
    alone = give(twice, F.lit("o"), F.least("row", "other"), F.greatest("row", "other"))
    second = _solve(mixed.unionByName(alone), width, percent, region_bytes)
    return edges.unionByName(so_far).unionByName(second)


def join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85,
    sample: int = 8192, most_common: int = 1 << 20, region_bytes: int = 16 << 20,
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable by links)."""
    common = _order(docs, text_col, width, sample, most_common)
    rows = stored(document_sets(docs, id_col, text_col, width, percent, common), "jaccard-rows")
    values = [F.min(F.struct("id", "check")).alias("least"), *[F.max(c).alias(c) for c in ("size", "n", "counts")]]
    nodes = stored(rows.filter("n > 0").groupBy("digest", "name").agg(*values), "jaccard-nodes")
    shared = regions(rows, nodes, percent)
    held = stored(nodes.join(shared, nodes.name == shared.node).select("digest", "name", "least", "size", "root"), "jaccard-regions")
    edges = _links(docs, held, id_col, text_col, width, percent, region_bytes)
    least = stored(named(nodes.select("digest", "least"), "digest", edges), "jaccard-components")
    known = lambda c: F.when(c != LAST, c)
    linked = rows.filter("n > 0").select("id", "n", "digest").join(least, "digest").select("id", "n", F.col("least.id").alias("component"))
    alone = rows.filter("n = 0").select("id", "n", F.col("id").alias("component"))
    return linked.unionByName(alone).select(known(F.col("id")).alias(id_col), F.col("n").alias("n_shingles"), known(F.col("component")).alias("component_id"))

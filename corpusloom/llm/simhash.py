"""SimHash near-duplicates: a binary-trie self-join and connected components.

Fingerprints: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of ``width`` words joined
by one space and taken with their repeats (fewer words: the whole sequence), 64 bits, a bit
set if it is set in over half of the shingles' XXH64 (seed 42). A text without words has
fingerprint zero, which is linked like any other.

Links: two fingerprints link at ``budget`` or fewer differing bits. Equal fingerprints are one
node from the start. The nodes are dealt to sub-tries: the 64 bits are cut into ``blocks``
blocks, and as ``budget`` differing bits leave at least ``blocks - budget`` blocks alike, each
node goes to one sub-trie for every choice of that many blocks (7 blocks, 4 bits: 35 choices
of 27 bits), named by the choice and the bits in it. Each pair that links meets in at least
one. A sub-trie is sorted once; pairs of its nodes are traversed together from the root, a
pair being dropped as soon as its differing bits exceed the budget, and also when all leaves
below both already belong to one component, so a dense group costs far less than its pairs.
What goes on is a spanning forest of each sub-trie, never the pairs.

Components: the forests' edges are contracted by large-star and small-star rounds, whose
aggregates combine on the map side; rounds are checkpointed. No fingerprint, edge or
component is gathered on the driver.

Edge cases: null counts as the empty text; null ids sort above every id, so only a component
without any id has a null name; repeated rows repeat their result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import stored, text_or_empty

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LAST = (1 << 63) - 1  # the id that stands for null
HOT = 4096


def fingerprint(text: str, width: int = 4) -> int:
    """SimHash of one text."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    start = np.concatenate(([0], np.cumsum(size[:-1] + 1)))
    last = np.minimum(np.arange(n) + width - 1, len(words) - 1)
    stops = (start[last] + size[last]).tolist()
    counts, done = np.zeros(64, dtype=np.int64), 0
    starts = start[:n].tolist()
    while done < n:  # in slices, so a very long text needs little memory
        part = slice(done, min(done + 65536, n))
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[part], stops[part])], dtype=">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        done = part.stop
    return int(np.packbits(2 * counts > n).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id (LAST for null), check (tells texts apart), fp (signed 64 bit): one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(x.as_py() or "", width) for x in b.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.int64())], names=["id", "check", "fp"])

    return docs.select(_id(id_col), _check(text_col), F.col(text_col)).mapInArrow(run, "id long, check long, fp long")


def _id(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id")


def _check(text_col: str) -> Column:
    return F.xxhash64(text_or_empty(text_col)).alias("check")


def _roots(parent: np.ndarray) -> np.ndarray:
    """Fully compressed union-find parents."""
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the sets of a[i] and b[i] for all i; the smaller root stays."""
    while len(a):
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        np.minimum.at(parent, hi, lo)
        parent = _roots(parent)
    return parent


def trie_components(trie: np.ndarray, fps: np.ndarray, budget: int, at_once: int = 1 << 16) -> np.ndarray:
    """Component root (an index) of each node, nodes sorted by (trie, fp), both uint64 arrays.

    Pairs of trie nodes are ranges of the sorted array. A stack holds blocks of pairs of one
    depth; the last block, the deepest, goes first, so near nodes are joined before far ones.
    """
    n = len(fps)
    parent = np.arange(n)
    edges = np.flatnonzero(np.r_[True, trie[1:] != trie[:-1], True])
    lo, hi = edges[:-1], edges[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    stack = [(0, lo, hi, lo, hi, np.zeros(len(lo), dtype=np.int8))]
    change, stale = None, True
    while stack:
        depth, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > at_once:
            stack.append((depth, a0[at_once:], a1[at_once:], b0[at_once:], b1[at_once:], err[at_once:]))
            a0, a1, b0, b1, err = (x[:at_once] for x in (a0, a1, b0, b1, err))
        if stale:  # leaves of a range are of one component if no root changes inside it
            change, stale = np.r_[0, np.cumsum(parent[1:] != parent[:-1])], False
        same = (change[a1 - 1] == change[a0]) & (change[b1 - 1] == change[b0]) & (parent[a0] == parent[b0])
        keep = ~same
        a0, a1, b0, b1, err = (x[keep] for x in (a0, a1, b0, b1, err))
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            x, y = a0[leaf], b0[leaf]
            near = np.bitwise_count(fps[x] ^ fps[y]) <= budget
            if near.any():
                parent, stale = _union(parent, x[near], y[near]), True
            a0, a1, b0, b1, err = (v[~leaf] for v in (a0, a1, b0, b1, err))
        if not len(a0):
            continue
        bit = (fps >> np.uint64(63 - depth)) & np.uint64(1) if depth < 64 else None
        if bit is None:
            continue
        ones = np.r_[0, np.cumsum(bit.astype(np.int64))]
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        self_ = a0 == b0  # a node paired with itself
        nxt = []
        for x0, x1, y0, y1, more, pick in (
            (am, a1, b0, bm, 1, ~self_),
            (a0, am, bm, b1, 1, np.ones(len(a0), bool)),
            (a0, am, b0, bm, 0, np.ones(len(a0), bool)),
            (am, a1, bm, b1, 0, np.ones(len(a0), bool)),
        ):
            e = err + more
            ok = pick & (x1 > x0) & (y1 > y0) & (e <= budget) & ~((x0 == y0) & (x1 - x0 == 1))
            if ok.any():
                nxt.append((x0[ok], x1[ok], y0[ok], y1[ok], e[ok]))
        if nxt:
            # Pairs that agree in this bit come last and so are followed first.
            far = [x for x in nxt[:2]] if len(nxt) > 2 else []
            for group in ([far, nxt[len(far) :]] if far else [nxt]):
                stack.append((depth + 1, *[np.concatenate([g[i] for g in group]) for i in range(5)]))
    return parent


def _choices(blocks: int, budget: int) -> list[int]:
    """Masks of the bits in each choice of ``blocks - budget`` blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << (63 - j) for j in range(cuts[i], cuts[i + 1])) for i in range(blocks)]
    return [sum(c) for c in combinations(masks, max(1, blocks - budget))]


def links(nodes: DataFrame, budget: int, blocks: int) -> DataFrame:
    """Edges (a, b) of spanning forests over the links between distinct fingerprints ``fp``."""
    masks = _choices(blocks, budget)
    as_long = lambda m: m - (1 << 64) if m >> 63 else m
    keyed = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(as_long(m))).alias("bits")) for i, m in enumerate(masks)])).alias("k"))
    keyed = keyed.select("fp", F.xxhash64("k.choice", "k.bits").alias("trie"))
    # Nodes of a sub-trie come to one task, many sub-tries to each task, sorted in the JVM.
    dealt = keyed.repartition("trie").sortWithinPartitions("trie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def solve(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            fp, trie = (np.concatenate([p[i] for p in parts]).view(np.uint64) for i in range(2))
            _, where, count = np.unique(trie, return_inverse=True, return_counts=True)
            many = count[where] > 1
            fp, trie = fp[many], trie[many]
            order = np.lexsort((fp, trie))
            fp, trie = fp[order], trie[order]
            root = trie_components(trie, fp, budget) if len(fp) else np.empty(0, np.int64)
            own = np.flatnonzero(root != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[x].view(np.int64), pa.int64()) for x in (own, root[own])], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            fp, trie = (b.column(i).to_numpy() for i in range(2))
            kept.append((fp, trie))
            size += len(fp)
            if size > 500_000 and trie[0] != trie[-1]:  # all but the last sub-trie are whole
                cut = int(np.flatnonzero(trie != trie[-1])[-1]) + 1
                kept[-1] = (fp[:cut], trie[:cut])
                yield solve(kept)
                kept, size = [(fp[cut:], trie[cut:])], len(fp) - cut
        if kept:
            yield solve(kept)

    return dealt.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of an edge (a, b): root is the smallest node it reaches.

    Alternating large-star and small-star rounds; they end when a round changes nothing.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct().checkpoint()
    before = None
    while True:
        # Large star: every larger neighbour of a node goes to the node's smallest neighbour.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # Written out, so that the neighbours of a hub meet it in a join that Spark can split.
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: the smaller neighbours of a node, and itself, go to the smallest of them.
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        small = small.unionByName(floor.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        now = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        edges = small
        if now == before or not now[0]:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def named(nodes: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """``nodes`` (key, least) with the ``least`` of all nodes that they reach."""
    roots = components(edges)
    placed = stored(nodes.join(roots, nodes[key] == roots.node, "left").select(key, "least", F.coalesce("root", key).alias("root")), "component-roots")
    found = stored(placed.groupBy("root").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("n")), "component-least")
    # Components with more than one in HOT of the nodes are HOT at most: sent to all tasks, so that no task gets one whole.
    total = found.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > total // HOT
    large = placed.join(F.broadcast(found.filter(hot).select("root", F.col("least").alias("hot_least"))), "root", "left")
    small = large.filter("hot_least is null").select(key, "root").join(found.filter(~hot).select("root", "least"), "root")
    return large.filter("hot_least is not null").select(key, F.col("hot_least").alias("least")).unionByName(small.select(key, "least"))


def _components_of(docs: DataFrame, id_col: str, text_col: str, width: int, budget: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, check, fp) and, for each fp, the least (id, check) of its component."""
    rows = stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min(F.struct("id", "check")).alias("least")), "fingerprint-nodes")
    # Written out, so that a hot fingerprint's rows meet it in a join that Spark can split.
    return rows, stored(named(nodes, "fp", links(nodes.select("fp"), budget, blocks)), "fingerprint-components")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, budget: int = 4, blocks: int = 7
) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    rows, named = _components_of(docs, id_col, text_col, width, budget, blocks)
    known = lambda c: F.when(c != LAST, c)
    return rows.join(named, "fp").select(
        known(F.col("id")).alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), known(F.col("least.id")).alias("component_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, budget: int = 4, blocks: int = 7) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each near-duplicate group.

    Of a group the row with the smallest id stays; rows that repeat its id and text stay once.
    """
    _, named = _components_of(docs, id_col, text_col, width, budget, blocks)
    keep = named.select(F.col("least.id").alias("__id"), F.col("least.check").alias("__check")).distinct()
    keyed = docs.withColumns({"__id": _id(id_col), "__check": _check(text_col)})
    return keyed.join(keep, ["__id", "__check"], "left_semi").dropDuplicates(["__id", "__check"]).select(*docs.columns)

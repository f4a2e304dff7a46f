"""Repeated substrings across documents by difference-cover suffix sorting.

A byte is removed if it lies in a string of ``length`` bytes that also starts in a document
with a smaller id. The suffixes that can matter are first brought together, then sorted:

* *Dealing.* Every window of ``length`` bytes contains ``length - GRAM + 1`` grams; the one with
  the least hash (the leftmost of equals) is its anchor, so equal windows have equal anchors.
  Neighbouring windows with equal anchor grams form a fragment of ``RUN`` windows at most, so
  periodic text is cut in few pieces; a task packs its fragments by a hash of
  the anchor gram, one compressed block for each target bucket. Of equal fragments in a task
  only the one with the smallest id travels: the windows of the others are already known to
  repeat, so a hot passage moves once for each task. Grams that would gather more than
  ``HOT_BYTES`` of fragments (estimated on a sample of documents, ``MOST_HOT`` grams at most) are
  anchors only of windows that hold no other gram. The sample decides how the work is dealt, never
  a result: any set of such grams is right, as every task uses the same.
* *Sorting* (in each bucket, over the distinct fragments whose anchor occurs in several
  documents): difference cover modulo 3. Triples at positions 1 and 2 modulo 3 are sorted and
  named, the names are sorted by recursion until they tell ``length`` bytes apart, the suffixes
  at positions 0 modulo 3 are sorted by their first byte and the rank of the next suffix, and
  the two orders are merged. Adjacent suffixes with equal prefixes form a class; a window
  repeats for an id if its class holds a smaller id.
* *Cutting.* The byte ranges, joined where they touch, go to the documents, dealt by id; documents stream past them.

Buckets and document parts are as many as the session's shuffle partitions, and more where a
partition would get over ``PART_BYTES`` of text, so a task's memory does not grow with the input.

Edge cases: null counts as the empty text; rows with one id are one document as far as
"smaller id" goes, each with its own result; a null id counts as larger than every id; texts
under ``length`` bytes lose nothing; a text longer than a slice is handled in overlapping
slices; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import partitions, text_or_empty

GRAM = 12
SIDE = 16
CHUNK = 1 << 18  # bytes of fragments made, and of fragments sorted, together
SLICE_BITS = 22
SLICE = 1 << SLICE_BITS  # bytes handled at once
LAST = (1 << 63) - 1  # the id that stands for null
PART_BYTES = 256 << 20  # of text for each partition, on average
RUN = 4096  # windows of a fragment
HOT_BYTES = 64 << 20  # of fragments of one anchor
MOST_HOT = 1 << 20
SAMPLE_BYTES = 1 << 20  # of text at least in which hot grams are sought
SEEN = 64  # times that a gram just hot is met in the sample, as far as that asks for a larger one
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_ODD = 0x5851F42D4C957F2D


def _words(data: np.ndarray) -> np.ndarray:
    """Little-endian 64-bit word at every byte of ``data`` (uint8), without copying."""
    return np.ndarray(max(0, len(data) - 7), dtype="<u8", buffer=data, strides=(1,))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _C[0]
    x ^= x >> np.uint64(32)
    x += b
    x *= _C[1]
    x ^= x >> np.uint64(29)
    x *= _C[2]
    x ^= x >> np.uint64(32)
    return x


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ``range(start, start + length)``."""
    ends = np.cumsum(lengths)
    out = np.ones(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    if not len(out):
        return out
    full = lengths > 0
    starts, lengths = starts[full], lengths[full]
    heads = np.cumsum(lengths)[:-1]
    out[0] = starts[0]
    out[heads] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(out, out=out)


def _grams(words: np.ndarray, at: np.ndarray | slice, behind: np.ndarray | slice) -> np.ndarray:
    """Hash of the gram that starts at each place (``behind``: the same places, 4 bytes on)."""
    return _mix(words[at], words[behind])


class HotGrams:
    """A sorted set of gram hashes."""

    BITS = 22

    def __init__(self, grams: np.ndarray):
        self.grams = np.sort(grams)
        self.near = np.zeros(1 << self.BITS, dtype=bool)
        self.near[(self.grams & np.uint64(len(self.near) - 1)).astype(np.int64)] = True

    def places(self, grams: np.ndarray) -> np.ndarray:
        """Where ``grams`` are of the set."""
        at = np.flatnonzero(self.near[(grams & np.uint64(len(self.near) - 1)).astype(np.int64)])
        own = np.minimum(np.searchsorted(self.grams, grams[at]), max(0, len(self.grams) - 1))
        return at[self.grams[own] == grams[at]] if len(self.grams) else at[:0]


def fragments(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int, hot: HotGrams | None = None) -> tuple[np.ndarray, ...]:
    """Of documents ``data[begin:end]``: document, first window, number of windows, the first window's anchor, its hash, and
    whether windows have anchors at different places, of each fragment."""
    none = np.empty(0, dtype=np.int64)
    count = np.maximum(ends - begins - length + 1, 0)
    if not count.sum():
        return none, none, none, none, none.view(np.uint64), none.astype(bool)
    words = _words(data)
    grams = _grams(words, slice(0, -4), slice(4, None))
    low = np.uint64(SLICE * 2 - 1)
    key = grams >> np.uint64(1)
    if hot is not None:
        key[hot.places(grams)] |= np.uint64(1 << 63)
    key &= ~low
    key |= np.arange(len(grams), dtype=np.uint64)
    size = 1
    window = length - GRAM + 1
    while size * 2 <= window:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < window:
        key = np.minimum(key[: len(key) - (window - size)], key[window - size :])
    anchor = (key & low).astype(np.int32)
    valid = np.zeros(len(anchor) + 1, dtype=np.int8)
    some = count > 0
    valid[begins[some]] = 1
    np.add.at(valid, begins[some] + count[some], -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).view(bool)
    moved = np.flatnonzero((anchor[1:] != anchor[:-1]) & valid[1:] & valid[:-1]) + 1
    other = grams[anchor[moved]] != grams[anchor[moved - 1]]
    first = np.zeros(len(valid), dtype=bool)
    first[moved[other]] = True
    # Windows of two documents never touch, so a run also ends where validity ends.
    first[begins[some]] = True
    at = np.flatnonzero(first)
    doc = np.searchsorted(begins, at, side="right") - 1
    windows = np.minimum(np.r_[at[1:], len(data)], begins[doc] + count[doc]) - at
    tied = np.zeros(len(at), dtype=bool)
    tied[np.searchsorted(at, moved[~other], side="right") - 1] = True
    pieces = -(-windows // RUN)
    if len(at) and pieces.max() > 1:
        of = np.repeat(np.arange(len(at)), pieces)
        step = ranges(np.zeros(len(at), np.int64), pieces) * RUN
        doc, tied, at, windows = doc[of], tied[of], at[of] + step, np.minimum(windows[of] - step, RUN)
    return doc, at, windows, anchor[at].astype(np.int64), grams[anchor[at]], tied


def slice_fragments(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int, hot: HotGrams | None = None) -> list[np.ndarray]:
    """:func:`fragments` of many documents, some documents at a time so that its arrays stay small."""
    out, lo = [], 0
    while lo < len(begins):
        hi = max(lo + 1, int(np.searchsorted(ends, begins[lo] + CHUNK)))
        base = begins[lo]
        doc, at, windows, spot, anchor, tied = fragments(data[base : ends[hi - 1] + 16], begins[lo:hi] - base, ends[lo:hi] - base, length, hot)
        out.append((doc + lo, at + base, windows, spot + base, anchor, tied))
        lo = hi
    return [np.concatenate([x[i] for x in out]) for i in range(6)]


def range_digests(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit polynomial digests of ranges of ``data`` (starts ascending), a stretch of ranges at a time."""
    out = np.empty(len(starts), dtype=np.uint64)
    reach = int(lengths.max(initial=0))
    power = np.full(CHUNK + reach + 1, _ODD, dtype=np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    inverse = np.full(CHUNK, pow(_ODD, -1, 1 << 64), dtype=np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = int(np.searchsorted(starts, base + CHUNK))
        part = data[base : base + CHUNK + reach].astype(np.uint64)
        part += np.uint64(1)
        part *= power[: len(part)]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part, out=sums[1:])
        at = starts[lo:hi] - base
        out[lo:hi] = (sums[at + lengths[lo:hi]] - sums[at]) * inverse[at]
        lo = hi
    return _mix(out, lengths.astype(np.uint64))


def equal_groups(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each range the index of the first range (in a sorted order) with the same bytes.

    Ranges are grouped by digest and ``key`` and then compared byte by byte with the first of
    the group; one that differs stays alone.
    """
    n = len(starts)
    digest = range_digests(data, starts, lengths) ^ key
    order = np.argsort(digest)
    same = np.r_[False, digest[order][1:] == digest[order][:-1]]
    head = np.flatnonzero(~same)
    leader = np.empty(n, dtype=np.int64)
    leader[order] = order[np.repeat(head, np.diff(np.r_[head, n]))]
    member = np.flatnonzero(leader != np.arange(n))
    wrong = np.zeros(len(member), dtype=bool)
    for lo in range(0, len(member), 1 << 14):
        m = member[lo : lo + (1 << 14)]
        lead = leader[m]
        unlike = lengths[m] != lengths[lead]
        ok = np.flatnonzero(~unlike)
        a, b = ranges(starts[m[ok]], lengths[m[ok]]), ranges(starts[lead[ok]], lengths[m[ok]])
        differ = data[a] != data[b]
        if differ.any():
            unlike[ok] |= np.logical_or.reduceat(differ, np.r_[0, np.cumsum(lengths[m[ok]])[:-1]])
        wrong[lo : lo + len(m)] = unlike
    leader[member[wrong]] = member[wrong]
    return leader


def _names(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Dense ranks (from 1) of triples, their sorted order and the number of different ones."""
    k = np.uint64(int(max(a.max(), b.max(), c.max())) + 1)
    key = a * k + b
    if k >= 1 << 21:  # three would not fit in 64 bits
        _, key = np.unique(key, return_inverse=True)
        key = key.astype(np.uint64)
    key = key * k + c
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), dtype=np.uint64)
    new[1:] = key[1:] != key[:-1]
    names = np.empty(len(key), dtype=np.uint64)
    names[order] = new = np.cumsum(new)
    return names, order, int(new[-1])


def _suffix_order(t: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``t`` (uint64, ends in three zeros) sorted by at least ``need`` symbols, and the sample's ranks.

    Sort and name the triples at positions 1 and 2 modulo 3, recurse on the names, sort the
    suffixes at positions 0 modulo 3 by symbol and the next rank, merge.
    """
    n = len(t) - 3
    at = np.concatenate((np.arange(1, n + 1, 3), np.arange(2, n + 1, 3)))
    sample, order, many = _names(t[at], t[at + 1], t[at + 2])
    if need > 3 and many < len(at):
        merged, deeper = _suffix_order(np.r_[sample, np.zeros(3, np.uint64)], -(-need // 3))
        new = np.ones(len(merged), dtype=np.uint64)
        new[1:] = ~_alike(sample, deeper, merged[:-1], merged[1:])
        sample[merged] = np.cumsum(new)
        order = merged
    rank = np.zeros(n + 4, dtype=np.uint64)
    rank[at] = sample
    big = np.uint64(int(sample.max()) + 1)
    rest = np.arange(0, n, 3)
    key = t[rest] * big + rank[rest + 1]
    by = np.argsort(key)
    rest, key = rest[by], key[by]
    inner = at[order]
    inner = inner[inner < n]
    # How many of the rest come before each sampled suffix: by (symbol, rank) or (symbol, symbol, rank).
    before = np.empty(len(inner), dtype=np.int64)
    one = inner % 3 == 1
    first = inner[one]
    before[one] = np.searchsorted(key, t[first] * big + rank[first + 1])
    two, k = inner[~one], int(t.max()) + 1
    left, right = (t[p] * np.uint64(k) + t[p + 1] for p in (rest, two))
    if k * k * int(big) >= 1 << 63:
        _, both = np.unique(np.concatenate((left, right)), return_inverse=True)
        left, right = both[: len(left)].astype(np.uint64), both[len(left) :].astype(np.uint64)
    before[~one] = np.searchsorted(left * big + rank[rest + 2], right * big + rank[two + 2])
    place = np.arange(len(inner)) + np.maximum.accumulate(before)
    merged = np.empty(n, dtype=np.int64)
    free = np.ones(n, dtype=bool)
    free[place] = False
    merged[place], merged[free] = inner, rest
    return merged, rank


def _alike(symbol: np.ndarray, rank: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether suffixes p and q agree: compared behind the first offset at which both are sampled."""
    a, b = p % 3, q % 3
    shift = np.where((a > 0) & (b > 0), 0, np.where((a != 2) & (b != 2), 1, 2))
    last = len(symbol) - 1
    same = rank[p + shift] == rank[q + shift]
    same &= (shift < 1) | (symbol[p] == symbol[q])
    same &= (shift < 2) | (symbol[np.minimum(p + 1, last)] == symbol[np.minimum(q + 1, last)])
    return same


def window_classes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, length: int) -> np.ndarray:
    """Class of every window of the ranges ``data[start:start + size]``: equal windows share a number.

    The windows come range by range. Suffix-sorts the ranges, each closed by a zero.
    """
    n = lengths + 1
    t = np.zeros(int(n.sum()) + 3, dtype=np.uint64)
    begin = np.cumsum(n) - n
    t[ranges(begin, lengths)] = data[ranges(starts, lengths)].astype(np.uint64) + np.uint64(1)
    order, _ = _suffix_order(t, length)
    windows = np.zeros(len(t), dtype=bool)
    here = ranges(begin, lengths - length + 1)
    windows[here] = True
    order = order[windows[order]]
    # Adjacent prefixes, eight bytes at a time.
    flat = np.zeros(len(t) + 8, dtype=np.uint8)
    flat[ranges(begin, lengths)] = data[ranges(starts, lengths)]
    word = _words(flat)
    same = np.ones(len(order), dtype=bool)
    same[:1] = False
    for j in [*range(0, length - 7, 8), length - 8]:
        at = word[order + j]
        same[1:] &= at[1:] == at[:-1]
    number = np.empty(len(t), dtype=np.int64)
    number[order] = np.cumsum(~same) - 1
    return number[here]


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in texts], dtype=np.int64)
    ends = np.cumsum(size)
    return np.frombuffer(b"".join(texts) + b"\0" * 80, dtype=np.uint8), ends - size, ends


#: Arrays of a block; ``who`` and ``where`` are sent as differences, ``spot`` is where the anchor lies, numbers of
#: windows from 255 on are in ``many``.
_PARTS = (("windows", "u1"), ("many", "<u4"), ("tied", "u1"), ("spot", "u1"), ("seen", "<u4"), ("who", "<u4"), ("where", "<u4"), ("id", "<i8"), ("check", "<u4"), ("bytes", "u1"))


def _packed(arrays: dict[str, np.ndarray], kinds) -> bytes:
    sizes = np.array([len(arrays[k]) for k, _ in kinds], dtype="<i8").tobytes()
    return zstandard.ZstdCompressor(level=5).compress(sizes + b"".join(np.ascontiguousarray(arrays[k], dtype=t).tobytes() for k, t in kinds))


def _unpacked(blob: bytes, kinds) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes, at, out = np.frombuffer(raw, "<i8", len(kinds)), 8 * len(kinds), {}
    for (k, t), n in zip(kinds, sizes.tolist()):
        out[k] = np.frombuffer(raw, t, n, at)
        at += n * np.dtype(t).itemsize
    return out


_RANGES = (("id", "<i8"), ("check", "<u4"), ("begin", "<u4"), ("size", "<u4"))
_TEXTS = (("id", "<i8"), ("null", "u1"), ("check", "<u4"), ("size", "<i8"), ("bytes", "u1"))


def _part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    """Document part of each id; the same in every task."""
    return (_mix(ids.view(np.uint64), np.uint64(17)) % np.uint64(parts)).astype(np.int64)


def joined_ranges(found: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Ranges (id, check, begin, size) with those of a document joined that touch."""
    id_, check, begin = found["id"], found["check"], found["begin"].astype(np.int64)
    order = np.lexsort((begin, check, id_))
    id_, check, begin, end = id_[order], check[order], begin[order], (begin + found["size"])[order]
    own = np.cumsum(np.r_[True, (id_[1:] != id_[:-1]) | (check[1:] != check[:-1])]) << 33  # one document's places lie apart from another's
    reach = np.maximum.accumulate(own + end)
    head = np.flatnonzero(np.r_[True, (own + begin)[1:] > reach[:-1]])
    last = np.r_[head[1:], len(order)] - 1
    return {"id": id_[head], "check": check[head], "begin": begin[head], "size": reach[last] - own[last] - begin[head]}


def _send_ranges(found: dict[str, np.ndarray], parts: int) -> Iterator[tuple[int, int, bytes]]:
    if len(found["id"]):
        found = joined_ranges(found)
        part = _part_of(found["id"], parts)
        order = np.argsort(part, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            yield 1, int(part[own[0]]), _packed({k: v[own] for k, v in found.items()}, _RANGES)


def pack_slice(ids: np.ndarray, checks: np.ndarray, offsets: np.ndarray, texts: list[bytes], length: int, buckets: int, parts: int, hot: HotGrams | None = None) -> Iterator[tuple[int, int, bytes]]:
    """(kind, target, block) of a slice of texts: kind 0 fragments to buckets, kind 1 known ranges to document parts."""
    data, begins, ends = _joined(texts)
    doc, at, windows, spot, anchor, tied = slice_fragments(data, begins, ends, length, hot)
    if not len(doc):
        return
    size = windows + length - 1
    lead = equal_groups(data, at, size, anchor)
    smallest = np.full(len(doc), LAST, dtype=np.int64)
    np.minimum.at(smallest, lead, ids[doc])
    known = ids[doc] > smallest[lead]
    where = offsets[doc] + at - begins[doc]
    yield from _send_ranges(
        {"id": ids[doc[known]], "check": checks[doc[known]], "begin": where[known], "size": size[known]}, parts
    )
    # What is left of a group are the occurrences in its smallest document, together.
    left = np.flatnonzero(~known)
    bucket = (anchor % np.uint64(buckets)).astype(np.int64)
    left = left[np.lexsort((lead[left], bucket[left]))]
    head = np.r_[True, lead[left][1:] != lead[left][:-1]]
    first = left[head]
    seen = np.diff(np.r_[np.flatnonzero(head), len(left)])
    cuts = np.flatnonzero(np.diff(bucket[first])) + 1
    lows, highs = np.r_[0, cuts], np.r_[cuts, len(first)]
    reach = np.r_[0, np.cumsum(seen)]
    for lo, hi in zip(lows.tolist(), highs.tolist()):
        f, occ = first[lo:hi], left[reach[lo] : reach[hi]]
        docs, who = np.unique(doc[occ], return_inverse=True)
        block = {
            "windows": np.minimum(windows[f], 255), "many": windows[f][windows[f] >= 255], "tied": tied[f], "spot": spot[f] - at[f], "seen": seen[lo:hi],
            "who": np.diff(who.astype(np.uint32), prepend=np.uint32(0)), "where": np.diff(where[occ].astype(np.uint32), prepend=np.uint32(0)),
            "id": ids[docs], "check": checks[docs], "bytes": data[ranges(at[f], size[f])],
        }
        yield 0, int(bucket[f[0]]), _packed(block, _PARTS)


def _shared(key: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether a key belongs to several ids, for each entry."""
    order = np.argsort(key)
    k, o = key[order], own[order]
    head = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
    out = np.zeros(len(key), dtype=bool)
    if len(head):
        mixed = np.minimum.reduceat(o, head) < np.maximum.reduceat(o, head)
        out[order] = np.repeat(mixed, np.diff(np.r_[head, len(k)]))
    return out


def solve_bucket(blocks: list[dict[str, np.ndarray]], length: int) -> dict[str, np.ndarray]:
    """Byte ranges (id, check, begin, size) that repeat a smaller document, of all fragments of a bucket.

    Empties ``blocks``, so that their memory is free while the fragments are sorted.
    """
    cat = lambda k: np.concatenate([b[k] for b in blocks])
    windows, seen, spot, tied, ids, checks, data = (cat(k) for k in ("windows", "seen", "spot", "tied", "id", "check", "bytes"))
    windows, seen = windows.astype(np.int64), seen.astype(np.int64)
    windows[windows == 255] = cat("many")
    shift = np.cumsum([0, *[len(b["id"]) for b in blocks[:-1]]])
    whole = lambda x: np.cumsum(x, dtype=np.uint32).astype(np.int64)
    who = np.concatenate([whole(b["who"]) + s for b, s in zip(blocks, shift)])
    where = np.concatenate([whole(b["where"]) for b in blocks])
    blocks.clear()
    size = windows + length - 1
    at, reach = np.cumsum(size) - size, np.cumsum(seen) - seen
    data = np.r_[data, np.zeros(80, np.uint8)]
    spot = at + spot
    anchor = _grams(_words(data), spot, spot + 4)
    own = ids[who[reach]]  # all occurrences of a fragment are in documents with one id
    # Anchors that only one id has cannot tell a repeat. Nor can fragments that share an anchor
    # but neither the SIDE bytes before it nor those behind it: a window is longer than both. (Where
    # the anchor of one fragment is tied, its place says nothing, so all fragments of it stay.)
    left = np.flatnonzero(_shared(anchor, own))
    words = _words(data)
    keep = np.zeros(len(left), dtype=bool)
    before, behind = spot[left] - at[left], at[left] + size[left] - spot[left] - GRAM
    if length - GRAM >= 2 * SIDE - 1:
        for extent, step in ((before, -SIDE), (behind, GRAM)):
            some = np.flatnonzero(extent >= SIDE)
            x = spot[left[some]] + step
            keep[some] |= _shared(_mix(_mix(words[x], words[x + 8]), anchor[left[some]]), own[left[some]])
        keep |= np.isin(anchor[left], np.unique(anchor[tied != 0]))
    else:
        keep[:] = True
    shared = left[keep]
    empty = np.empty(0, dtype=np.int64)
    if not len(shared):
        return {k: empty for k, _ in _RANGES}
    del words, spot, keep
    data, at = np.r_[data[ranges(at[shared], size[shared])], np.zeros(80, np.uint8)], np.cumsum(size[shared]) - size[shared]
    size, windows, own = size[shared], windows[shared], own[shared]
    occ = ranges(reach[shared], seen[shared])
    seen, who, where = seen[shared], who[occ], where[occ]
    # Distinct fragments are sorted once, whatever number of documents has them.
    lead = equal_groups(data, at, size, anchor[shared])
    distinct = np.unique(lead)
    smallest = np.full(len(lead), LAST)
    np.minimum.at(smallest, lead, own)
    # Anchors by number, some at a time: equal windows have one anchor, so none are parted.
    distinct = distinct[np.argsort(anchor[shared][distinct])]
    tag, reached = anchor[shared][distinct], np.cumsum(size[distinct])
    classes, lo, many = [], 0, 0
    while lo < len(distinct):
        hi = max(lo + 1, int(np.searchsorted(reached, (reached[lo - 1] if lo else 0) + CHUNK)))
        while hi < len(distinct) and tag[hi] == tag[hi - 1]:
            hi += 1
        classes.append(window_classes(data, at[distinct[lo:hi]], size[distinct[lo:hi]], length) + many)
        many, lo = int(classes[-1].max()) + 1, hi
    classes = np.concatenate(classes)
    of = np.repeat(smallest[distinct], windows[distinct])
    least = np.full(classes.max() + 1, LAST)
    np.minimum.at(least, classes, of)
    least = least[classes]  # smallest id with this window, window by window
    begin = np.cumsum(windows[distinct]) - windows[distinct]
    place = np.empty(len(lead), dtype=np.int64)
    place[distinct] = np.arange(len(distinct))
    place = place[lead]
    fragment = np.repeat(np.arange(len(lead)), seen)
    mine = ids[who]
    low, high = np.minimum.reduceat(least, begin)[place][fragment], np.maximum.reduceat(least, begin)[place][fragment]
    whole, some = high < mine, (low < mine) & (high >= mine)
    out = [(who[whole], where[whole], where[whole] + size[fragment[whole]])]
    mixed = np.flatnonzero(some)
    upto, lo = np.cumsum(windows[fragment[mixed]]), 0
    while lo < len(mixed):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + (1 << 21))))
        m, lo = mixed[lo:hi], hi
        n = windows[fragment[m]]
        repeats = least[ranges(begin[place[fragment[m]]], n)] < np.repeat(mine[m], n)
        row = np.repeat(np.arange(len(m)), n)
        step = ranges(np.zeros(len(m), np.int64), n)
        starts = repeats & ~(np.r_[False, repeats[:-1]] & (step > 0))
        stops = repeats & ~(np.r_[repeats[1:], False] & np.r_[step[1:] > 0, False])
        a, b = np.flatnonzero(starts), np.flatnonzero(stops)
        out.append((who[m[row[a]]], where[m[row[a]]] + step[a], where[m[row[b]]] + step[b] + length))
    who, a, b = (np.concatenate([x[i] for x in out]) for i in range(3))
    return {"id": ids[who], "check": checks[who], "begin": a, "size": b - a}


def cut(text: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple[int, int, str, list[tuple[int, int]]]:
    """Bytes removed, maximal removed runs, digest of what is left, the runs."""
    order = np.argsort(begins, kind="stable")
    spans: list[list[int]] = []
    for a, b in zip(begins[order].tolist(), ends[order].tolist()):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    kept, at = hashlib.sha256(), 0
    for a, b in spans:
        kept.update(text[at:a])
        at = b
    kept.update(text[at:])
    return sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [(a, b) for a, b in spans]


_SENT = pa.schema([("kind", pa.int32()), ("target", pa.int64()), ("block", pa.binary())])


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _SENT.types[i]) for i in range(3)], schema=_SENT)


def hot_grams(rows: DataFrame, total: int, length: int) -> np.ndarray:
    """Hashes of the grams whose fragments would be over ``HOT_BYTES``, from a sample of the rows (id, text) by hash of the id."""
    least = HOT_BYTES * (length - GRAM + 1) // (4 * length)  # occurrences: about two of each window's grams are anchors
    if total <= least:
        return np.empty(0, dtype=np.uint64)
    one_in = max(1, int(total / max(SAMPLE_BYTES, total * SEEN / least)))
    sample = rows.filter(F.pmod(F.xxhash64(F.lit("grams"), "id"), F.lit(one_in)) == 0).select("text")
    seen = max(2, least // one_in)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [np.empty(0, np.uint64)], 0

        def met() -> pa.RecordBatch:
            gram, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64), pa.int64()), pa.array(n, pa.int64())], names=["gram", "n"])

        for b in batches:
            for x in b.column(0):
                for at in range(0, len(text := x.as_py()) - GRAM + 1, SLICE):
                    words = _words(np.frombuffer(text[at : at + SLICE + GRAM - 1], dtype=np.uint8))
                    held.append(_grams(words, slice(0, -4), slice(4, None)))
                    size += len(held[-1])
                    if size > SLICE:
                        yield met()
                        held, size = held[:1], 0
        yield met()

    counted = sample.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= seen)
    most = counted.orderBy(F.desc("n"), "gram").limit(MOST_HOT).toPandas()["gram"]
    return most.to_numpy(dtype=np.int64).view(np.uint64)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, spans: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256 (and ``spans`` where asked for)."""
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} at least")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    sizes = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    most, total = sizes.agg(F.max("n"), F.sum("bytes")).first()
    n = max(partitions(docs.sparkSession), -(-(total or 0) // PART_BYTES))
    buckets, parts = 2 * n, n  # a partition takes two buckets, one after the other
    # Tells rows apart that share an id but not a text; where no id is repeated it says nothing and takes no room.
    repeated = (most or 0) > 1
    rows = rows.withColumn("check", F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)) if repeated else F.lit(0).cast("long"))

    common = hot_grams(rows, total or 0, length)
    shared = docs.sparkSession.sparkContext.broadcast(common) if len(common) else None

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = HotGrams(shared.value) if shared else None
        held: list[tuple[int, int, int, bytes]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids, checks, offsets = (np.array([h[i] for h in held], dtype=k) for i, k in enumerate((np.int64, np.uint32, np.int64)))
            out = list(pack_slice(ids, checks, offsets, [h[3] for h in held], length, buckets, parts, hot))
            if out:
                yield _batch(out)

        for b in batches:
            for id_, text, check in zip(*(b.column(i) for i in range(3))):
                id_, text = LAST if not id_.is_valid else id_.as_py(), text.as_py()
                for at in range(0, max(1, len(text) - length + 1), SLICE):
                    piece = text[at : at + SLICE + length - 1]
                    if size + len(piece) > SLICE and held:
                        yield from flush()
                        held, size = [], 0
                    held.append((id_, check.as_py(), at, piece))
                    size += len(piece)
        if held:
            yield from flush()

    sent = rows.mapInArrow(pack, "kind int, target long, block binary")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, []
        for b in batches:
            for kind, target, block in zip(*(b.column(i) for i in range(3))):
                if kind.as_py():
                    yield _batch([(1, target.as_py(), block.as_py())])
                    continue
                if now != target.as_py():
                    yield from answer(blocks)
                    now, blocks = target.as_py(), []
                blocks.append(_unpacked(block.as_py(), _PARTS))
        yield from answer(blocks)

    def answer(blocks: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if blocks and (out := list(_send_ranges(solve_bucket(blocks, length), parts))):
            yield _batch(out)

    dealt = sent.repartitionById(n, F.col("target").cast("int")).sortWithinPartitions("kind", "target")
    known = dealt.mapInArrow(solve, "kind int, target long, block binary")

    def deal_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts by part, several to a block."""
        held: list[list[tuple]] = [[] for _ in range(parts)]
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for target, rows in enumerate(held):
                if rows:
                    ids, null, check, text = zip(*rows)
                    block = {"id": np.array(ids), "null": np.array(null), "check": np.array(check), "size": np.array([len(t) for t in text]), "bytes": np.frombuffer(b"".join(text), np.uint8)}
                    yield _batch([(2, target, _packed(block, _TEXTS))])
                    rows.clear()

        for b in batches:
            target = _part_of(b.column(0).fill_null(LAST).to_numpy().astype(np.int64), parts)
            for i, (id_, text, check) in enumerate(zip(*(b.column(k) for k in range(3)))):
                null = not id_.is_valid
                held[target[i]].append((LAST if null else id_.as_py(), null, check.as_py(), text.as_py()))
                size += len(held[target[i]][-1][3])
                if size > 2 * SLICE:
                    yield from flush()
                    size = 0
        yield from flush()

    texts = rows.mapInArrow(deal_texts, "kind int, target long, block binary")
    # Ranges come before texts; each part is a partition.
    met = known.unionByName(texts).repartitionById(n, F.col("target").cast("int")).sortWithinPartitions("kind")
    schema = f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<begin:long,end:long>>" * spans

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, table = [], None
        none = np.empty(0, np.int64)
        for b in batches:
            for kind, block in zip(b.column(0), b.column(2)):
                if kind.as_py() < 2:
                    blocks.append(_unpacked(block.as_py(), _RANGES))
                    continue
                if table is None:  # ranges of this part, by id
                    table = {k: np.concatenate([x[k] for x in blocks]).astype(np.int64) if blocks else none for k, _ in _RANGES}
                    order = np.argsort(table["id"], kind="stable")
                    table, blocks = {k: v[order] for k, v in table.items()}, []
                t = _unpacked(block.as_py(), _TEXTS)
                lows, highs = (np.searchsorted(table["id"], t["id"], side) for side in ("left", "right"))
                ends, out = np.cumsum(t["size"]), []
                for i in range(len(t["id"])):
                    own = np.flatnonzero(table["check"][lows[i] : highs[i]] == t["check"][i]) + lows[i]
                    text = t["bytes"][ends[i] - t["size"][i] : ends[i]].tobytes()
                    begin = table["begin"][own]
                    removed, n_spans, digest, runs = cut(text, begin, begin + table["size"][own])
                    id_ = None if t["null"][i] else int(t["id"][i])
                    out.append((id_, len(text), removed, n_spans, digest, *[[{"begin": x, "end": y} for x, y in runs]] * spans))
                kinds = [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))] * spans
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(len(kinds))], names=names)

    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["spans"] * spans]
    return met.mapInArrow(finish, schema)

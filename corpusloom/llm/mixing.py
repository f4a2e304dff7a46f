"""Mixing sources to target weights by a min-cost flow over membership patterns.

A document may belong to several sources (``sources`` array; one source is an array of
one). Documents are aggregated by their membership pattern, the sorted set of their
sources, so the network has one node per pattern and one per source, never one per
document. A pattern's tokens can be taken up to ``max_repeats`` times; the r-th repeat of
a token costs ``r``, which is convex, so fresh tokens are used before any is repeated.
Successive shortest paths route each source's quota at least cost. A source that stays
short of its quota takes what its patterns can give.

What a (pattern, source) edge got is then drawn from the pattern's documents in the order
of a seeded hash: whole repeats first, then whole documents up to the rest. The hash space
is cut into bins, as many as the square root of the number of documents, whose sizes are
summed per pattern; only the documents of the one bin where the rest ends are ranked one by
one, so a window holds about that root of rows and never a source. The
few words still missing are filled with the largest further documents that fit.

Quotas: source weights by position repeat (3, 1, 2 in the contract), sources by code point
and null last; all quotas sum to ``share`` of the total size, none above ``max_repeats``
times its source; the excess is shared again by weight, which comes to
``min(max_repeats * size, level * weight)`` at one common level.

Edge cases: null and empty texts have size 0 and are taken 0 words; a null source is a
source of its own; repeated rows (same id) are taken or left alike. Patterns and
sources are gathered on the driver, so ``max_patterns`` bounds them (an error above it).
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import stored, word_count

# Sources by name inside this module: a mark before the name, so that null (last by code point) is no name.
NAME, NONE = "0", "1"
FILL_ROUNDS = 12


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """``min(most * size, level * weight)`` with the level at which they sum to ``total`` (or all caps)."""
    caps = [most * x for x in sizes]
    order = sorted(range(len(sizes)), key=lambda i: caps[i] / weights[i])
    left, weight, out = float(total), float(sum(weights)), [0.0] * len(sizes)
    for i in order:
        out[i] = float(min(caps[i], left * weights[i] / weight))
        left, weight = left - out[i], weight - weights[i]
    return out


def route(patterns: dict[tuple[str, ...], int], quotas: dict[str, int], max_repeats: int) -> dict[tuple[tuple[str, ...], str], int]:
    """Min-cost flow from patterns (capacity ``size`` at cost r for each repeat r) to source quotas.

    Successive shortest paths with potentials; nodes are patterns, sources and two ends.
    """
    names = ["S", "T", *[("p", p) for p in patterns], *[("s", s) for s in quotas]]
    at = {n: i for i, n in enumerate(names)}
    graph: list[list[list]] = [[] for _ in names]  # edge: [to, capacity, cost, index of its reverse]

    def edge(a, b, capacity: int, cost: int) -> None:
        graph[at[a]].append([at[b], capacity, cost, len(graph[at[b]])])
        graph[at[b]].append([at[a], 0, -cost, len(graph[at[a]]) - 1])

    for p, size in patterns.items():
        for r in range(max_repeats):
            edge("S", ("p", p), size, r)
        for s in p:
            if s in quotas:
                edge(("p", p), ("s", s), size * max_repeats, 0)
    for s, quota in quotas.items():
        edge(("s", s), "T", quota, 0)
    potential = [0] * len(names)
    while True:
        distance, before, tie = {0: 0}, {}, count()
        heap = [(0, next(tie), 0)]
        done = set()
        while heap:
            d, _, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            for k, (v, capacity, cost, _) in enumerate(graph[u]):
                step = d + cost + potential[u] - potential[v]
                if capacity > 0 and step < distance.get(v, 1 << 62):
                    distance[v], before[v] = step, (u, k)
                    heapq.heappush(heap, (step, next(tie), v))
        if 1 not in distance:
            break
        for u, d in distance.items():
            potential[u] += d
        flow, v = 1 << 62, 1
        while v != 0:
            u, k = before[v]
            flow, v = min(flow, graph[u][k][1]), u
        v = 1
        while v != 0:
            u, k = before[v]
            graph[u][k][1] -= flow
            graph[v][graph[u][k][3]][1] += flow
            v = u
    return {
        (p, s): graph[at[("s", s)]][e[3]][1]
        for p in patterns
        for e in graph[at[("p", p)]]
        if names[e[0]] not in ("S", "T") and (s := names[e[0]][1]) in p
    }


def _choose(sized: DataFrame, want: DataFrame, rounds: int) -> DataFrame:
    """Per pattern: whole repeats, last full bin, cut inside the next bin, and the documents that fill the rest.

    Every aggregate here combines on the map side; its result has one row for each pattern
    (and bin), however many documents a pattern has.
    """
    want = want.withColumn("repeats", F.expr("case when total > 0 then least(amount div total, most) else 0 end").cast("long"))
    want = want.withColumn("rest", F.when(F.col("repeats") >= F.col("most"), F.lit(0)).otherwise(F.col("amount") - F.col("repeats") * F.col("total")))
    bins = sized.groupBy("pattern", "bin").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = bins.withColumn("full", F.coalesce(F.sum("words").over(upto), F.lit(0))).join(F.broadcast(want), "pattern")
    ends = ends.filter("rest > 0 and full <= rest and rest < full + words").select("pattern", F.col("bin").alias("last"), "full", "rest")
    run = Window.partitionBy("pattern").orderBy("place", "id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = sized.join(F.broadcast(ends), "pattern").filter("bin = last").withColumn("upto", F.col("full") + F.sum("size").over(run))
    inside = inside.filter("upto <= rest").groupBy("pattern").agg(F.max(F.struct("place", "id")).alias("cut"), F.max("upto").alias("taken"))
    plan = want.join(ends.drop("rest"), "pattern", "left").join(inside, "pattern", "left")
    plan = plan.withColumn("short", F.col("rest") - F.coalesce("taken", "full", F.lit(0)))
    # Largest documents outside the cut of at most short, short / 2, short / 4 ... words.
    beyond = sized.join(F.broadcast(plan.select("pattern", "last", "cut", "short")), "pattern").filter(~_within() & (F.col("size") > 0))
    best = [
        F.max(F.when(F.col("size") <= F.floor(F.col("short") / (1 << j)), F.struct("size", "place", "id"))).alias(f"fill_{j}") for j in range(rounds)
    ]
    return plan.join(beyond.groupBy("pattern").agg(*best), "pattern", "left")


def _within() -> Column:
    """Whether a row (place, bin, id) lies before its pattern's cut (last, cut)."""
    before = (F.col("bin") < F.col("last")) | ((F.col("bin") == F.col("last")) & (F.struct("place", "id") <= F.col("cut")))
    return F.coalesce(before, F.lit(False))


def _fill(row, rounds: int) -> list[tuple[int, int]]:
    """(place, id) of the documents that fill what the cut left short, largest first."""
    short, out = row["short"] or 0, []
    for j in range(rounds):
        best = row[f"fill_{j}"]
        if best and best["size"] <= short and (best["place"], best["id"]) not in out:
            out.append((best["place"], best["id"]))
            short -= best["size"]
    return out


def mix(
    docs: DataFrame,
    sources: Column,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_repeats: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 42,
    size_col: str | None = None,
    max_patterns: int = 100_000,
) -> DataFrame:
    """One row per input row: row (struct of its columns), pattern, size, source_size, target, taken.

    ``source_size`` and ``target`` are those of the document's first source. ``size_col`` names a
    column with the sizes where they are known; else the words of the text are counted.
    """
    spark = docs.sparkSession
    names = F.array_sort(F.array_distinct(F.transform(sources, lambda x: F.coalesce(F.concat(F.lit(NAME), x), F.lit(NONE)))))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 1)
    size = F.coalesce(F.col(size_col).cast("long"), F.lit(0)) if size_col else word_count(text_col)
    whole = docs.withColumns({"__pattern": names, "__size": size, "__place": place, "__id": key})
    own = ["pattern", "size", "place", "id"]
    sized = stored(whole.select(*[F.col(f"__{c}").alias(c) for c in own]), "mix-sizes")
    bits = max(12, -(-sized.count().bit_length() // 2))
    at = F.shiftrightunsigned("place", 63 - bits).alias("bin")
    sized = sized.select("*", at)
    totals = sized.groupBy("pattern").agg(F.sum("size").alias("total")).limit(max_patterns + 1).collect()
    if len(totals) > max_patterns:
        raise ValueError(f"over {max_patterns} membership patterns")
    patterns = {tuple(r["pattern"]): int(r["total"]) for r in sorted(totals, key=lambda r: r["pattern"])}
    members = sorted({s for p in patterns for s in p})
    sizes = dict.fromkeys(members, 0)
    for p, n in patterns.items():
        for s in p:
            sizes[s] += n
    weight = [float(weights[i % len(weights)]) for i in range(len(members))]
    target = dict(zip(members, water_fill([sizes[s] for s in members], weight, share * sum(patterns.values()), max_repeats)))
    got: dict[tuple[str, ...], int] = {}
    for (p, _), flow in route(patterns, {s: int(q) for s, q in target.items()}, max_repeats).items():
        got[p] = got.get(p, 0) + flow
    want = spark.createDataFrame([(list(p), n, got.get(p, 0), max_repeats) for p, n in patterns.items()], "pattern array<string>, total long, amount long, most int")
    plan = _choose(sized, want, FILL_ROUNDS).collect()  # one row for each pattern
    rows = [
        (
            r["pattern"],
            sizes[r["pattern"][0]] if r["pattern"] else 0,
            target[r["pattern"][0]] if r["pattern"] else 0.0,
            r["repeats"],
            r["last"],
            tuple(r["cut"]) if r["cut"] else None,
            _fill(r, FILL_ROUNDS),
        )
        for r in plan
    ]
    pair = "struct<place:long,id:long>"
    chosen = spark.createDataFrame(
        rows, f"pattern array<string>, source_size long, target double, repeats long, last long, cut {pair}, fill array<{pair}>"
    )
    # The row is carried along as one struct, so that a clashing column name changes nothing.
    carried = whole.select(*[F.col(f"__{c}").alias(c) for c in own], F.struct(*docs.columns).alias("row")).withColumn("bin", at)
    joined = carried.join(F.broadcast(chosen), "pattern", "left")
    extra = _within() | F.coalesce(F.array_contains("fill", F.struct("place", "id")), F.lit(False))
    taken = F.col("size") * (F.coalesce("repeats", F.lit(0)) + F.when(extra, 1).otherwise(0))
    pattern = F.transform("pattern", lambda x: F.when(x != NONE, F.substr(x, F.lit(2)))).alias("pattern")
    return joined.select("row", pattern, "size", "source_size", "target", taken.cast("long").alias("taken"))

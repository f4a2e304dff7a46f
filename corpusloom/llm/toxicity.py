"""Toxicity by a factorization machine over hashed terms.

Terms are the lower-cased runs of letters, digits and ``_`` and their prefixes of a few
lengths, each hashed to one of ``2 ** hash_bits`` slots and counted once for a document. A bounded sample of the labelled rows
(``max_sample``; half of it for each label, taken in hash order) is reduced to its hashed
slots on the executors, one row for each id, where their counts are summed too; the driver gets the
counts of common slots and, of each row, only those, and fits on them. Its terms are chosen in two passes: marks, the
``n_terms`` slots that tell most by chi-square, of those that are several times as frequent in
toxic documents; then partners, at most as many other slots that, among the sample rows with one
of the marks, move the label either way beyond what the marks predict. A mark gets a linear weight and every chosen slot a
factor of ``rank`` numbers, so a pair of terms can weigh more, or less, than its terms do alone.
A partner counts only beside a mark: documents without any mark keep the base rate's score. A
pair of which neither term is a mark is not learned. The intercept is corrected for the sampling
of the labels. The fitted model has a fixed size and is sent to every task; scoring reads every
whole text once and shuffles nothing.

Edge cases: null and empty texts have no terms and get the score of the fitted intercept; labelled rows
without a document, null labels and null ids take no part in the fit, and of repeated labels
of an id the largest counts, as of repeated rows of an id the text whose slots sort first; without two kinds of labels every score is the share of toxic
ones (0 if there are none). ``held_out`` is false for a null id. Repeated rows repeat their
result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import stored

_TERM = re.compile(r"\w+")
MEMO = 500_000  # terms whose slot a task remembers
LIFT = 3
CHANCE = 0.001  # of any partner that is none, over all pairs that are tested
STRATA = 4  # lengths within which partners are tested

PREFIXES = (4, 5, 6)


def words(text: str | None) -> set[str]:
    return set(_TERM.findall(text.lower())) if text else set()


def slots_of(word: str, mask: int) -> list[int]:
    """Hashed slots of a word: itself and, marked as such, its longer prefixes (for inflected forms)."""
    parts = [word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]
    return [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) & mask for x in parts]


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class FactorizationMachine:
    """score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j) for x of zeros and ones.

    ``partner`` slots weigh nothing alone (w_i is 0) nor beside each other, only in pairs with other slots.
    """

    def __init__(self, n: int, rank: int, seed: int = 7, partner: np.ndarray | None = None):
        self.w0, self.w = 0.0, np.zeros(n)
        self.partner = np.zeros(n, dtype=bool) if partner is None else partner
        self.v = np.random.default_rng(seed).normal(0, 0.01, (n, rank))

    def margins(self, rows: np.ndarray, slots: np.ndarray, n: int) -> np.ndarray:
        """Log odds of n documents; ``rows`` (sorted) and ``slots`` name the terms that are there."""
        linear = np.bincount(rows, self.w[slots], n)
        pairs = np.zeros(n)
        of = self.partner[slots]
        for f in range(self.v.shape[1]):
            x = self.v[slots, f]
            pairs += np.bincount(rows, x, n) ** 2 - np.bincount(rows, np.where(of, 0, x * x), n) - np.bincount(rows, np.where(of, x, 0), n) ** 2
        return self.w0 + linear + pairs / 2

    def fit(self, rows: np.ndarray, slots: np.ndarray, y: np.ndarray, epochs: int = 25, batch: int = 512, step: float = 0.05, decay: float = 1e-4) -> None:
        """Adam on the log loss over shuffled batches; the same sample gives the same model."""
        rng, n = np.random.default_rng(11), len(y)
        first = np.searchsorted(rows, np.arange(n + 1))
        p = np.concatenate(([np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))], self.w, self.v.ravel()))
        m1, m2, t = np.zeros_like(p), np.zeros_like(p), 0
        k, rank = len(self.w), self.v.shape[1]
        for epoch in range(epochs):
            for part in np.array_split(rng.permutation(n), max(1, n // batch)):
                size = first[part + 1] - first[part]
                at = np.repeat(first[part] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                r, s = np.repeat(np.arange(len(part)), size), slots[at]
                self.w0, self.w, self.v = p[0], p[1 : k + 1], p[k + 1 :].reshape(k, rank)
                z = np.clip(self.margins(r, s, len(part)), -30, 30)
                g = (1 / (1 + np.exp(-z)) - y[part]) / len(part)
                grad = np.zeros_like(p)
                grad[0], grad[1 : k + 1] = g.sum(), np.where(self.partner, 0, np.bincount(s, g[r], k))
                of = self.partner[s]
                for f in range(rank):
                    x = self.v[s, f]
                    total, beside = np.bincount(r, x, len(part)), np.bincount(r, np.where(of, x, 0), len(part))
                    grad[k + 1 + f :: rank] = np.bincount(s, g[r] * (total[r] - np.where(of, beside[r], x)), k)
                grad[1:] += decay * p[1:]
                t += 1
                m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
                p = p - step * (0.97**epoch) * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        self.w0, self.w, self.v = p[0], p[1 : k + 1].copy(), p[k + 1 :].reshape(k, rank).copy()


def _chi_square(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Chi-square of presence and label, from the toxic and the other documents with a slot."""
    a, b = a.astype(float), b.astype(float)
    c, d = n1 - a, n0 - b
    below = (a + b) * (c + d) * (a + c) * (b + d)
    return np.where(below > 0, (a * d - b * c) ** 2 * (n1 + n0) / np.maximum(below, 1), 0)


def _partners(rows: np.ndarray, flat: np.ndarray, y: np.ndarray, length: np.ndarray, p: np.ndarray, marks: np.ndarray, others: np.ndarray, most: int) -> np.ndarray:
    """The slots of ``others`` that, among the rows with one of the ``marks``, move the label either way; ``most`` at most.

    ``p`` is what the marks alone predict: only what a slot tells beyond that counts. Each mark's rows are tested by
    themselves (score test over classes of equal length; with one ``p`` for all rows it is Cochran-Mantel-Haenszel), so
    that neither the rows of other marks nor terms that only tell long texts from short ones decide. ``CHANCE`` is
    shared by all pairs of a mark and a slot (Bonferroni). ``length`` has the slots of each row, rare ones too.
    ``rows`` is sorted; ``marks`` and ``others`` are too.
    """
    if not len(marks) or not len(others):
        return others[:0]
    at = np.searchsorted(marks, flat)
    ok = marks[np.minimum(at, len(marks) - 1)] == flat
    order = np.argsort(at[ok], kind="stable")
    holders = np.split(rows[ok][order], np.searchsorted(at[ok][order], np.arange(1, len(marks))))
    at = np.searchsorted(others, flat)
    ok = others[np.minimum(at, len(others) - 1)] == flat
    own, at = rows[ok], at[ok]
    first = np.searchsorted(own, np.arange(len(y) + 1))
    need = NormalDist().inv_cdf(CHANCE / (2 * len(marks) * len(others))) ** 2
    best, rest, var = np.zeros(len(others)), y - p, p * (1 - p)
    for held in holders:
        if len(held) <= need or y[held].min() == y[held].max():
            continue  # too few rows for any slot to stand out, or nothing to move
        level = np.empty(len(held), dtype=np.int64)
        level[np.argsort(length[held], kind="stable")] = np.arange(len(held)) * STRATA // len(held)
        size = first[held + 1] - first[held]
        slots = at[np.repeat(first[held] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())]
        moved, spread = np.zeros(len(others)), np.zeros(len(others))
        for k in range(STRATA):
            here, inside = level == k, np.repeat(level == k, size)
            n = var[held][here].sum()
            m = np.bincount(slots[inside], np.repeat(var[held], size)[inside], len(others))
            moved += np.bincount(slots[inside], np.repeat(rest[held], size)[inside], len(others)) - m * rest[held][here].sum() / n
            spread += m - m * m / n
        best = np.maximum(best, np.maximum(np.abs(moved) - 0.5, 0) ** 2 / np.maximum(spread, 0.25))
    chosen = np.argsort(-best, kind="stable")[:most]
    return np.sort(others[chosen[best[chosen] > need]])


class Model:
    """Fitted slots (sorted), their machine and the score of documents without an informative term."""

    def __init__(self, slots: np.ndarray, machine: FactorizationMachine | None, base: float, hash_bits: int):
        self.slots, self.machine, self.base, self.hash_bits = slots, machine, base, hash_bits

    def scorer(self):
        """A function from texts to scores that remembers where terms go."""
        place = {int(s): i for i, s in enumerate(self.slots)}
        mask = (1 << self.hash_bits) - 1
        memo: dict[str, tuple[int, ...]] = {}

        def score(texts: list[str | None]) -> np.ndarray:
            if self.machine is None:
                return np.full(len(texts), self.base)
            if len(memo) > MEMO:
                memo.clear()
            rows, slots = [], []
            for i, text in enumerate(texts):
                found = set()
                for word in words(text):
                    at = memo.get(word)
                    if at is None:
                        memo[word] = at = tuple(place[x] for x in slots_of(word, mask) if x in place)
                    if at:
                        found.update(at)
                rows += [i] * len(found)
                slots += sorted(found)
            z = self.machine.margins(np.array(rows, dtype=np.int64), np.array(slots, dtype=np.int64), len(texts))
            return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

        return score


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_sample: int = 8_000,
    hash_bits: int = 22,
    n_terms: int = 2048,
    rank: int = 4,
    max_common: int = 1 << 17,
) -> Model:
    """Fit on at most ``max_sample`` labelled rows, half of them of each label, in hash order.

    Slots that fewer than 3 of the sample rows, or one in 2,000, hold take no part, and of the others the
    ``max_common`` that most rows hold do.
    """
    spark = docs.sparkSession
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    own = own.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    base = n1 / (n0 + n1) if n0 + n1 else 0.0
    if not n0 or not n1:
        return Model(np.empty(0, np.int64), None, base, hash_bits)
    order = F.xxhash64("id")
    parts = [own.filter(F.col("y") == y).orderBy(order, "id").limit(max_sample // 2) for y in (0, 1)]
    sample = F.broadcast(parts[0].unionByName(parts[1]))  # at most max_sample pairs of numbers
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(sample, "id")
    mask = (1 << hash_bits) - 1

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [
                np.unique(np.array([y for t in words(x.as_py()) for y in slots_of(t, mask)], dtype=np.int32)).tobytes()
                for x in b.column(1)
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.binary())], names=["id", "y", "slots"])

    rows_of = texts.mapInArrow(slots, "id long, y int, slots binary")
    # An id whose rows are many is one row for each task before it moves.
    kept = stored(rows_of.groupBy("id", "y").agg(F.min("slots").alias("slots")), "toxicity-sample")
    sizes = {r["y"]: r["n"] for r in kept.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model(np.empty(0, np.int64), None, base, hash_bits)
    ones, total = sizes[1], sizes[0] + sizes[1]
    least = max(3, total // 2000)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The slots of some rows counted together: slot, toxic rows, all rows."""
        for b in batches:
            ys = b.column(0).to_numpy()
            found = [np.frombuffer(x.as_py(), dtype=np.int32) for x in b.column(1)]
            flat = np.concatenate([*found, np.empty(0, np.int32)])
            slot, at = np.unique(flat, return_inverse=True)
            n = np.bincount(at, minlength=len(slot))
            toxic = np.bincount(at, np.repeat(ys, [len(x) for x in found]), len(slot)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(toxic, pa.int64()), pa.array(n, pa.int64())], names=["slot", "toxic", "n"])

    counted = kept.select("y", "slots").mapInArrow(each, "slot int, toxic long, n long").groupBy("slot").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    common_slots = counted.filter(F.col("n") >= least).orderBy(F.desc("n"), "slot").limit(max_common).toPandas().sort_values("slot")
    seen, in_toxic, count = (common_slots[c].to_numpy() for c in ("slot", "toxic", "n"))
    seen = seen.astype(np.int32)
    wanted = spark.sparkContext.broadcast(seen)

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.frombuffer(x.as_py(), dtype=np.int32) for x in b.column(2)]
            some = [np.intersect1d(x, wanted.value, assume_unique=True).tobytes() for x in found]
            length = pa.array([len(x) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), length, pa.array(some, pa.binary())], names=["id", "y", "length", "slots"])

    got = sorted(kept.mapInArrow(common, "id long, y int, length long, slots binary").collect(), key=lambda r: r["id"])
    y, length = np.array([r["y"] for r in got], dtype=float), np.array([r["length"] for r in got])
    flat = np.frombuffer(b"".join(r["slots"] for r in got), dtype=np.int32)
    rows = np.repeat(np.arange(len(got), dtype=np.int32), [len(r["slots"]) // 4 for r in got])
    del got
    chi = _chi_square(in_toxic, count - in_toxic, ones, total - ones)
    # Marks of toxicity only: met by chance once in a thousand at most (10.83), and at least LIFT times as
    # often in toxic documents. Terms that only tell long texts from short ones stay out.
    lift = (in_toxic / y.sum()) >= LIFT * (count - in_toxic) / (1 - y).sum()
    chi[(chi <= 10.83) | ~lift] = 0
    marks = np.argsort(-chi, kind="stable")[:n_terms]
    marks = np.sort(seen[marks[chi[marks] > 0]])

    def fitted(chosen: np.ndarray, partners: np.ndarray) -> tuple[FactorizationMachine, np.ndarray]:
        """The machine over the chosen slots, and what it predicts for the sample."""
        at = np.searchsorted(chosen, flat)
        ok = at < len(chosen)
        ok[ok] = chosen[at[ok]] == flat[ok]
        machine = FactorizationMachine(len(chosen), rank, partner=np.isin(chosen, partners))
        machine.fit(rows[ok], at[ok], y)
        return machine, 1 / (1 + np.exp(-np.clip(machine.margins(rows[ok], at[ok], len(y)), -30, 30)))

    chosen, (machine, p) = marks, fitted(marks, marks[:0])
    partners = _partners(rows, flat, y, length, p, marks, np.setdiff1d(seen, marks), n_terms)
    if len(partners):
        chosen = np.union1d(marks, partners)
        machine, _ = fitted(chosen, partners)
    machine.w0 += np.log(n1 / n0) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(chosen, machine, base, hash_bits)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.7) -> DataFrame:
    """One row per input row: id, held_out, score (0 to 1), predicted (1 from ``cut`` on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(scorer([x.as_py() for x in part.column(1)]), pa.float64())], names=[id_col, "score"]
                )

    scored = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, f"{id_col} long, score double")
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", cut: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score is below ``cut``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                yield part.filter(pa.array(scorer([x.as_py() for x in part.column(at)]) < cut))

    at = docs.columns.index(text_col)
    return docs.mapInArrow(run, docs.schema)

"""The training-data operators against brute-force versions, with edge cases."""

import base64
import hashlib
import io
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import bpe, common, exact_dedup, mixing, queries, simhash, suffix_dedup, token_rollup, topk, toxicity, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Documents with nulls, empty and very long texts, copies, near copies, ties and repeated rows."""
    rng = random.Random(5)
    passage = prose(rng, 40)
    out = []
    for i in range(60):
        text = prose(rng, rng.randrange(1, 80))
        if i % 7 == 0:
            text = prose(rng, 10) + " " + passage + " " + prose(rng, 10)
        out.append((i, text, "en", f"s{i % 4}" if i % 9 else "s0", 0))
    out += [(60 + k, out[3][1], "en", "s1", 0) for k in range(8)]
    out += [(70 + k, out[7][1] + f" tail{k}", "de", None, 0) for k in range(5)]
    out += [(80, None, None, "s2", None), (81, "", "en", "s2", 0), (82, " \t\n", "en", "s2", 3), (83, "ab" * 40_000, "en", "s3", 0)]
    out += [(84, "Straße 日本 🙂 " * 20, "de", "s3", 0), (3, out[3][1], "en", "s3", 0), (None, "no id here at all " * 6, "en", "s1", 0), (None, None, "en", "s1", 0)]
    return [r[:4] + (len(r[1]) if r[1] is not None else None,) for r in out]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    if extra:  # extra columns with names that the operators use inside
        for name in ("id", "digest", "fp", "kept", "size", "target", "block", "check", "keep_id", "pattern"):
            df = df.withColumn(name, F.lit("x"))
    return df


# op1


def removed(rows, length=50):
    rows = [(1 << 62 if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in rows:
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            first[s] = min(first.get(s, 1 << 63), i)
    out = []
    for i, t in rows:
        m = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                m[p : p + length] = True
        spans = int((np.diff(np.r_[0, m.astype(int), 0]) == 1).sum())
        out.append((len(t), int(m.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~m])).hexdigest()))
    return out


def test_suffix_dedup(spark, rows):
    got = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    want = Counter((r[0], *x) for r, x in zip(rows, removed([r[:2] for r in rows])))
    assert Counter(tuple(r) for r in got) == want
    assert sum(r["n_removed"] for r in got) > 1000


def test_suffix_dedup_partitions_grow(spark, rows, monkeypatch):
    want = sorted(map(str, suffix_dedup.remove_repeats(frame(spark, rows)).collect()))
    size = sum(len((r[1] or "").encode()) for r in rows)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", size // 8)
    more = suffix_dedup.remove_repeats(frame(spark, rows))
    assert more.rdd.getNumPartitions() >= 8 and sorted(map(str, more.collect())) == want


def periodic(rng):
    """Runs of one byte, of short periods and of nearly periodic text, in several documents."""
    out = [(i, "a" * rng.randrange(40, 400) + prose(rng, 3) + "a" * rng.randrange(40, 300)) for i in range(12)]
    out += [(20 + i, "abc" * rng.randrange(10, 90) + rng.choice("xyz") + "abc" * rng.randrange(10, 90)) for i in range(12)]
    out += [(40 + i, " " * 60 + "".join(rng.choice("ab") for _ in range(70)) + "0123456789abcdefghijklmnopqrstuvwxyz!?" * rng.randrange(2, 5)) for i in range(12)]
    return out


def common_gram(rng):
    """A gram of 12 bytes, in other surroundings each time, in a third of the documents; a few of them copy each other."""
    out = [(i, prose(rng, 9) + (" <<TWELVE12>> " if i % 3 == 0 else " ") + prose(rng, 9)) for i in range(120)]
    return out + [(200 + i, prose(rng, 3) + out[3 * i][1][20:150] + prose(rng, 3)) for i in range(30)]


@pytest.mark.parametrize("make", [periodic, common_gram])
@pytest.mark.parametrize("small", [False, True])
def test_suffix_dedup_hot(spark, make, small, monkeypatch):
    if small:  # every common gram counts as hot, runs are cut often
        for name, value in (("HOT_BYTES", 100), ("SAMPLE_BYTES", 1 << 30), ("RUN", 16)):
            monkeypatch.setattr(suffix_dedup, name, value)
    some = make(random.Random(9))
    docs = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
    if small:
        grams = suffix_dedup.hot_grams(docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text")), 1 << 20, 50)
        assert len(grams) > 0
    want = Counter((r[0], *x) for r, x in zip(some, removed(some)))
    assert Counter(tuple(r) for r in suffix_dedup.remove_repeats(docs).collect()) == want


def test_suffix_dedup_runs_stay_small():
    """A long run of one byte is sent as few ranges and less than its text."""
    texts = [b"a" * 400_000, b"b" + b"a" * 400_000]
    sent = list(suffix_dedup.pack_slice(np.array([1, 2]), np.zeros(2, np.uint32), np.zeros(2, np.int64), texts, 50, 4, 3))
    assert sum(len(b) for *_, b in sent) < 40_000
    known = [suffix_dedup._unpacked(b, suffix_dedup._RANGES) for kind, _, b in sent if kind]
    assert sum(len(k["id"]) for k in known) < 20
    blocks = [suffix_dedup._unpacked(b, suffix_dedup._PARTS) for kind, _, b in sent if not kind]
    assert sum(len(b["bytes"]) for b in blocks) < 30_000 and sum(len(b["where"]) for b in blocks) < 500


def test_suffix_dedup_empty(spark):
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_suffix_dedup_long_slices(rows):
    some = [r[:2] for r in rows if r[0] is not None][:70]
    ids = np.array([i for i, _ in some])
    blocks, ranges = defaultdict(list), []
    for i, t in some:
        t = (t or "").encode()
        for at in range(0, max(1, len(t) - 49), 700):
            for kind, target, b in suffix_dedup.pack_slice(np.array([i]), np.array([i], dtype=np.uint32), np.array([at]), [t[at : at + 749]], 50, 5, 3):
                (ranges if kind else blocks[target]).append(suffix_dedup._unpacked(b, suffix_dedup._RANGES if kind else suffix_dedup._PARTS))
    ranges += [suffix_dedup.solve_bucket(b, 50) for b in blocks.values()]
    all_ = {k: np.concatenate([r[k] for r in ranges]) for k in ("id", "begin", "size")}
    want = removed(some)
    for (i, t), w in zip(some, want):
        if (ids == i).sum() == 1:
            own = all_["id"] == i
            assert suffix_dedup.cut((t or "").encode(), all_["begin"][own].astype(int), (all_["begin"] + all_["size"])[own].astype(int))[:3] == w[1:]


@pytest.mark.parametrize("seed", range(6))
def test_window_classes(seed):
    rng = np.random.default_rng(seed)
    length = int(rng.integers(16, 60))
    data = np.r_[rng.integers(0, 2, 300).astype(np.uint8), np.zeros(99, np.uint8)]
    starts, sizes = rng.integers(0, 150, 6), rng.integers(length, length + 90, 6)
    classes = suffix_dedup.window_classes(data, starts, sizes, length)
    windows = [bytes(data[s + i : s + i + length]) for s, n in zip(starts, sizes) for i in range(n - length + 1)]
    named = {}
    assert all(named.setdefault(w, c) == c for w, c in zip(windows, classes))
    assert len(set(named.values())) == len(named)


# op2


def test_toxicity(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        text = prose(rng, 30) + (" you wretched " + rng.choice(["goblinish", "goblinous", "trollish"]) if toxic else "")
        rows.append((i, text, "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (None, "wretched trollish", "en", "s", 0), (0, rows[0][1], "en", "s", 0)]
    labels += [(None, 1, 1), (5, 1, None), (7777, 0, 1)]
    docs, labels_df = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    got = toxicity.score(docs, toxicity.fit(docs, labels_df)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i in range(900):
        assert by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert by[i]["predicted"] == int(i % 5 == 0) == int(by[i]["score"] >= 0.7)
    assert by[900]["score"] == by[901]["score"] < 0.7 and by[None]["held_out"] is False and by[None]["predicted"] == 1
    clean = toxicity.keep_clean(docs, toxicity.fit(docs, labels_df))
    assert clean.columns == docs.columns and clean.count() == sum(r["predicted"] == 0 for r in got)


def test_toxicity_learns_pairs():
    """Two terms that are harmless alone and toxic together."""
    rng = np.random.default_rng(0)
    x = rng.random((4000, 12)) < 0.4
    y = (x[:, 0] & x[:, 1]).astype(float)
    rows, slots = np.nonzero(x)
    machine = toxicity.FactorizationMachine(12, 4)
    machine.fit(rows, slots, y, epochs=40)
    assert (((machine.margins(rows, slots, len(y)) > 0) == (y > 0)).mean()) > 0.99


@pytest.mark.parametrize("kind", ["together", "excused"])
def test_toxicity_fits_pairs(spark, kind):
    """A mark with a common partner: toxic only beside it, or only without it; long clean texts hold all common words."""
    rng = random.Random(17)
    rows, labels = [], []
    for i in range(6000):
        insult, group = rng.random() < 0.2, rng.random() < 0.5
        text = prose(rng, 12) + " wretchedly" * insult + " neighbours" * group
        rows.append((i, text, "en", "s", 0))
        labels.append((i, int(insult and group == (kind == "together"))))
    long = [(6000 + i, prose(rng, 3000) + " neighbours", "en", "s", 0) for i in range(60)]
    docs = frame(spark, rows + long)
    model = toxicity.fit(docs, spark.createDataFrame(labels + [(r[0], 0) for r in long], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(6000) if got[i]["held_out"]]
    assert len(held) > 1500
    assert sum(got[i]["predicted"] != labels[i][1] for i in held) <= len(held) // 100
    assert not any(got[r[0]]["predicted"] for r in long)


def test_toxicity_partners_weigh_only_beside_marks():
    """Margins by brute force, and a fit that leaves partners without a weight of their own."""
    rng = np.random.default_rng(4)
    machine = toxicity.FactorizationMachine(6, 3, partner=np.array([False, True, False, True, True, False]))
    machine.w, machine.v = np.where(machine.partner, 0, rng.normal(size=6)), rng.normal(size=(6, 3))
    x = rng.random((50, 6)) < 0.5
    rows, slots = np.nonzero(x)
    want = [
        sum(machine.w[i] for i in range(6) if r[i])
        + sum(machine.v[i] @ machine.v[j] for i in range(6) for j in range(i) if r[i] and r[j] and not (machine.partner[i] and machine.partner[j]))
        for r in x
    ]
    assert np.allclose(machine.margins(rows, slots, 50), want)
    x = rng.random((4000, 6)) < 0.4
    rows, slots = np.nonzero(x)
    y = (x[:, 0] & x[:, 1]).astype(float)
    machine = toxicity.FactorizationMachine(6, 3, partner=machine.partner)
    machine.fit(rows, slots, y, epochs=40)
    assert not machine.w[machine.partner].any() and ((machine.margins(rows, slots, 4000) > 0) == (y > 0)).mean() > 0.99


def test_toxicity_hot_id(spark):
    """An id with thousands of rows is one sample row, and none of its rows go missing from the scores."""
    rng = random.Random(8)
    rows = [(i, prose(rng, 20) + " wretchedly" * (i % 2), "en", "s", 0) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    more = frame(spark, rows + [rows[6]] * 3000)
    a, b = toxicity.fit(frame(spark, rows), labels), toxicity.fit(more, labels)
    assert np.array_equal(a.slots, b.slots) and a.machine.w0 == b.machine.w0
    assert toxicity.score(more, b).count() == 3400


def test_toxicity_empty(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    none = frame(spark, [])
    model = toxicity.fit(none, labels)
    assert toxicity.score(none, model).count() == 0 and toxicity.keep_clean(none, model).count() == 0


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "a", "en", "s", 1)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [tuple(r) for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [(1, False, 0.0, 0)]


# op3


def test_token_rollup(spark):
    kinds = "doc_id long, version string, op string, source string, lang string, n_tokens long, seq int, docs int"
    batch = lambda rows: spark.createDataFrame([r + (7,) for r in rows], kinds)
    t = token_rollup.TokenRollup(spark)
    one = batch([(1, "v1", "insert", "a", "en", 10, 0), (2, "v1", "insert", "a", None, 5, 0), (2, "v1", "insert", "a", None, 6, 1), (None, "v1", "insert", None, "en", None, 0)])
    assert t.apply("one", one) and not t.apply("one", one)
    assert t.apply("two", batch([(1, "v1", "revise", "b", "en", 12, 0), (9, "v1", "delete", "a", "en", None, 0), (2, "v2", "revise", "a", None, 50, 0)]))
    assert t.apply("empty", batch([]))
    want = {("b", "en", "v1", 1, 12), ("a", None, "v1", 1, 6), (None, "en", "v1", 1, 0), ("a", None, "v2", 1, 50)}
    assert {tuple(r) for r in t.totals().collect()} == want
    assert t.apply("three", batch([(2, "v1", "delete", "a", None, None, 0), (None, "v1", "delete", None, "en", None, 0)]))
    assert {tuple(r) for r in t.totals().collect()} == {("b", "en", "v1", 1, 12), ("a", None, "v2", 1, 50)}
    assert t.apply("back", batch([(2, "v1", "insert", "c", "fr", 3, 0)]))
    assert ("c", "fr", "v1", 1, 3) in {tuple(r) for r in t.totals().collect()}


def test_token_rollup_race(spark):
    """Two drivers with one batch id, and two with two ids, of which the loser must see the winner's ledger."""
    batch = lambda n: spark.createDataFrame([(1, "v", "insert", "a", "en", n)], "doc_id long, version string, op string, source string, lang string, n_tokens long")
    path = common.fresh_path(spark, "rollup")
    first, second = token_rollup.TokenRollup(spark, path, fanout=2), token_rollup.TokenRollup(spark, path, fanout=2)
    prepare, inner = second._prepare, []

    def late(changes, number):  # the other driver commits while this one prepares
        folder = prepare(changes, number)
        if not inner:
            inner.append(first.apply(*pending))
        return folder

    second._prepare = late
    pending = ("same", batch(5))
    assert second.apply("same", batch(7)) is False and inner == [True]
    assert [tuple(r) for r in first.totals().collect()] == [("a", "en", "v", 1, 5)]
    inner.clear()
    pending = ("third", batch(20))
    assert second.apply("fourth", batch(1)) and inner == [True]
    assert [tuple(r) for r in first.totals().collect()] == [("a", "en", "v", 1, 1)]
    assert first.batches() == ["same", "third", "fourth"] and len(first._state().folders) <= 3
    assert first.compact() and len(first._state().folders) == 1
    first.vacuum()
    assert not first.apply("third", batch(9)) and [tuple(r) for r in second.totals().collect()] == [("a", "en", "v", 1, 1)]


def test_token_rollup_missed_batches(spark):
    """A driver that sought its batch id before two others came must not commit it over the later one."""
    batch = lambda n: spark.createDataFrame([(1, "v", "insert", "a", "en", n)], "doc_id long, version string, op string, source string, lang string, n_tokens long")
    path = common.fresh_path(spark, "rollup")
    one, two = token_rollup.TokenRollup(spark, path), token_rollup.TokenRollup(spark, path)
    state, inner = one._state, []

    def late():  # between the membership test and the commit, b1 and b2 come
        found = state()
        if not inner:
            inner.append(True)
            assert two.apply("b1", batch(10)) and two.apply("b2", batch(99))
        return found

    one._state = late
    assert one.apply("b1", batch(10)) is False and one.batches() == ["b1", "b2"]
    assert [r["tokens"] for r in two.totals().collect()] == [99]


def test_log(spark):
    """An entry is there whole or not at all, a number is given once, and a number below a cut is given never."""
    log, other = common.Log(spark, path := common.fresh_path(spark, "log")), None
    other = common.Log(spark, path)
    fs = log.fs
    fs.create(log.path(f"{path}/_unfinished"), False).close()  # of a driver lost while it wrote
    assert log.last() == 0 and log.add(1, "a") and not other.add(1, "b") and other.add(2, "b") and not log.add(2, "c")
    assert log.entries() == other.entries() == [(1, "a"), (2, "b")]
    assert log.add(3, "c")
    other.cut(3)
    assert not log.add(2, "late") and log.entries() == other.entries() == [(3, "c")] and log.add(4, "d") and log.last() == 4
    assert sorted(x.getPath().getName() for x in fs.listStatus(log.path(path)) if not x.getPath().getName().startswith("_")) == ["0000000003", "0000000004", "floor-0000000003"]


def test_op3(spark, rows, tmp_path):
    """The query against tiktoken: one document of each text, repeated and null ids too."""
    more = rows + [(None, rows[1][1], "en", "s1", 0), (5, "another text", "de", "s1", 0), (99, rows[3][1], None, None, 0)]
    spark.createDataFrame(more, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    by_id, first = {}, {}
    for i, t, lang, source, _ in more:
        own = (hashlib.sha256((t or "").encode()).hexdigest(), source or "", lang or "", t or "", source, lang)
        by_id[i] = max(by_id.get(i, own), own)
    for i, (*_, t, source, lang) in sorted(by_id.items(), key=lambda x: (x[0] is None, x[0] or 0)):
        first.setdefault(t, (i, source, lang))
    want = defaultdict(lambda: [0, 0])
    for t, (_, source, lang) in first.items():
        for version, n in (("words@1", len(re.findall(r"[^\x20\x09-\x0D]+", t))), ("byte_bpe_50k", len(reference.encode_ordinary(t)))):
            want[source, lang, version][0] += 1
            want[source, lang, version][1] += n
    got = {tuple(r)[:3]: list(r)[3:] for r in queries.op3_token_counts(spark, str(tmp_path)).collect()}
    assert got == dict(want)


# op4


def slow_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_components(fps, ids, budget=4):
    fps, ids = np.array(fps, dtype=np.uint64), np.array(ids)
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= budget
    label = ids.copy()
    while True:
        new = np.where(near, label[None], 1 << 62).min(1)
        if (new == label).all():
            return label.tolist()
        label = new


def test_simhash(spark, rows):
    own = [r for r in rows if r[0] is not None]
    got = simhash.near_duplicates(frame(spark, own)).collect()
    fps = [slow_fingerprint(r[1]) for r in own]
    want = Counter(zip([r[0] for r in own], (f"{x:016x}" for x in fps), slow_components(fps, [r[0] for r in own])))
    assert Counter(tuple(r) for r in got) == want
    left = simhash.keep_one(frame(spark, rows))
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == sorted({c for _, _, c in want})
    assert sum(r["doc_id"] is None for r in left.collect()) == 1


def test_simhash_null_ids_and_empty(spark, rows):
    """Null ids sort last: a component is named by its smallest id, or by null."""
    more = rows + [(None, rows[3][1], "en", "s1", 0), (None, "never seen before " * 9, "en", "s1", 0)]
    got = simhash.near_duplicates(frame(spark, more)).collect()
    fps, last = [slow_fingerprint(r[1]) for r in more], 1 << 61
    labels = slow_components(fps, [last if r[0] is None else r[0] for r in more])
    want = Counter((r[0], f"{x:016x}", None if c == last else c) for r, x, c in zip(more, fps, labels))
    assert Counter(tuple(r) for r in got) == want and any(c is None for _, _, c in want)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0 and simhash.keep_one(frame(spark, [])).count() == 0


def test_simhash_large_components(spark, rows, monkeypatch):
    want = Counter(tuple(r) for r in simhash.near_duplicates(frame(spark, rows)).collect())
    monkeypatch.setattr(simhash, "HOT", 20)  # some components count as large
    assert Counter(tuple(r) for r in simhash.near_duplicates(frame(spark, rows)).collect()) == want


@pytest.mark.parametrize("text", ["", " \x0b", "A b", "A b c d", "A\x1cb\x85c d e", "x y z w v", "É é ß"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_links_lose_none(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = lambda n: np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (200, n), dtype=np.uint64), axis=1)
    fps = np.unique(np.concatenate([base, *[base[rng.integers(0, 60, 200)] ^ flips(n) for n in (1, 3, 4, 6)], base[0] ^ flips(2)]))
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes, 4, 7)).collect()}
    label = slow_components(fps, np.arange(len(fps)))
    groups, found = defaultdict(set), defaultdict(set)
    for x, c in zip(fps.view(np.int64).tolist(), label):
        groups[c].add(x)
        found[roots.get(x, x)].add(x)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in found.values()}


# op5


@pytest.mark.parametrize("keep", ["high", "low"])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, rows, keep, weak):
    digest = (lambda t: (F.crc32(t.cast("binary")) % 5).cast("string").cast("binary")) if weak else exact_dedup.sha256  # collisions
    got = exact_dedup.exact_groups(frame(spark, rows), keep=keep, digest=digest).collect()
    by = defaultdict(list)
    for i, t, *_ in rows:
        by[t or ""].append(i)
    best = max if keep == "high" else min
    want = Counter()
    for text, ids in by.items():
        k = best((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        want.update((i, k, len(ids), i == k, None if weak and len(ids) == 0 else sha) for i in ids)
    got = Counter(tuple(r) for r in got)
    if weak:  # a digest met once carries no SHA-256
        got, want = Counter(x[:4] for x in got.elements()), Counter(x[:4] for x in want.elements())
    assert got == want


def test_drop_copies(spark, rows):
    left = exact_dedup.drop_copies(frame(spark, rows)).collect()
    texts = Counter(r["text"] or "" for r in left)
    assert set(texts.values()) == {1} and set(texts) == {r[1] or "" for r in rows}


def test_digest_index_levels(spark):
    index = exact_dedup.DigestIndex(spark, fanout=2)
    for k in range(5):
        index.insert(spark.createDataFrame([(b"a", k), (bytes([k]), k)], "digest binary, id long"))
    assert max(i for i, level in enumerate(index.levels) if level) >= 2
    merged = {bytes(r["digest"]): tuple(r)[1:] for r in index.compact_all().collect()}
    assert merged[b"a"] == (0, 4, 5) and len(merged) == 6


@pytest.mark.parametrize("keep, weak", [("high", False), ("low", True)])
def test_exact_groups_over_batches(spark, rows, keep, weak):
    """Batches into one index (opened anew each time, compacting on the way) against brute force over what came so far."""
    digest = (lambda t: (F.crc32(t.cast("binary")) % 5).cast("string").cast("binary")) if weak else exact_dedup.sha256
    path, seen, best = common.fresh_path(spark, "index"), defaultdict(list), max if keep == "high" else min
    batches = [rows[:20], rows[20:62], [], rows[62:] + rows[:3]]
    for batch in batches:
        index = exact_dedup.DigestIndex(spark, path, fanout=2)
        got = exact_dedup.exact_groups(frame(spark, batch), keep=keep, digest=digest, index=index)
        for i, t, *_ in batch:
            seen[t or ""].append(i)
        want = Counter()
        for i, t, *_ in batch:
            ids = seen[t or ""]
            k = best((j for j in ids if j is not None), default=None)
            want[(i, k, len(ids), i == k)] += 1
        assert Counter(tuple(r)[:4] for r in got.collect()) == want
    merged = exact_dedup.DigestIndex(spark, path, fanout=2).compact_all()
    assert merged.agg(F.sum("n")).first()[0] == sum(map(len, batches))
    stale = exact_dedup.DigestIndex(spark, path)
    exact_dedup.DigestIndex(spark, path).insert(spark.createDataFrame([(b"b", 1)], "digest binary, id long"))
    with pytest.raises(RuntimeError):
        stale.insert(spark.createDataFrame([(b"c", 1)], "digest binary, id long"))


def test_exact_groups_hang_on_the_index(spark, rows, monkeypatch):
    """A query's digests pass through its index: no result is right where lookups, run filters or merges lose rows."""
    groups = lambda: Counter(tuple(r) for r in exact_dedup.exact_groups(frame(spark, rows)).collect())
    index, merged, compact = exact_dedup.DigestIndex, [], exact_dedup.DigestIndex.compact
    monkeypatch.setattr(index, "compact", lambda self, level: (merged.append(len(self.levels[level])), compact(self, level)))
    want = groups()
    assert sum(want.values()) == len(rows) and merged and min(merged) > 1
    nothing = exact_dedup.Filter(spark.createDataFrame([([0] * 64,)], "bits array<long>"), 64)
    for name, broken in [
        ("lookup", lambda self, *_: spark.createDataFrame([], "digest binary")),
        ("_filter", lambda self, run: nothing),
        ("_merged", lambda self, runs: self._rows(runs[:0])),
    ]:
        with monkeypatch.context() as m:
            m.setattr(index, name, broken)
            assert groups() != want, name


def test_exact_groups_empty(spark):
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0 and exact_dedup.drop_copies(frame(spark, [])).count() == 0


def test_bloom_filter(spark):
    """No digest of the filter is refused, and few strangers pass."""
    own, other = (spark.range(a, a + 3000).select(F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("digest")) for a in (0, 9000))
    words = exact_dedup.words_for(3000)
    made = exact_dedup.Filter(common.stored(exact_dedup.bloom(own, words), "filter"), words)
    assert own.filter(made.passes(F.col("digest"))).count() == 3000
    assert other.filter(made.passes(F.col("digest"))).count() < 60


# op6


def test_mixing(spark, rows):
    got = mixing.mix(frame(spark, rows), F.array("source")).select("row.doc_id", "row.source", "size", "source_size", "target", "taken").collect()
    size = Counter()
    for r in got:
        size[r["source"]] += r["size"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    names = sorted((s for s in size if s is not None)) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, target = 1.5 * sum(size.values()), {}
    while True:  # as the contract says it: share by weight, stop at the cap, share the excess again
        free = [s for s in names if s not in target]
        rest = total - sum(target.values())
        want = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if want[s] > 2 * size[s]]
        if not over:
            target |= want
            break
        target |= {s: 2.0 * size[s] for s in over}
    for s in names:
        own = [r for r in got if r["source"] == s]
        assert all(r["target"] == pytest.approx(target[s]) and r["source_size"] == size[s] for r in own)
        taken = sum(r["taken"] for r in own)
        assert target[s] - max(r["size"] for r in own) <= taken <= target[s] + 1e-6
    again = mixing.mix(frame(spark, rows).repartition(7), F.array("source")).select("row.doc_id", "row.source", "size", "source_size", "target", "taken")
    assert Counter(tuple(r) for r in again.collect()) == Counter(tuple(r) for r in got)


def test_flow_is_cheapest():
    flows = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 4}, {"a": 12, "b": 11}, 2)
    assert sum(f for (_, s), f in flows.items() if s == "a") == 12 and sum(f for (_, s), f in flows.items() if s == "b") == 11
    used = Counter()
    for (p, _), f in flows.items():
        used[p] += f
    assert all(used[p] <= n for p, n in {("a",): 10, ("a", "b"): 10, ("b",): 4}.items())  # 23 of 24 fresh: no repeat
    short = mixing.route({("a",): 5}, {"a": 50}, 2)
    assert short == {(("a",), "a"): 10}


def test_mixing_sizes_and_names(spark, rows):
    """Known sizes give what counted ones give; a source named like the null mark is no null."""
    docs = frame(spark, rows + [(300, "one two three", "en", "1", 0), (301, "one two", "en", "\U0010ffff<null>", 0)])
    pick = ["row.doc_id", "pattern", "size", "source_size", "target", "taken"]
    counted = mixing.mix(docs, F.array("source")).select(*pick)
    known = docs.withColumn("n", common.word_count("text")).drop("text")
    assert Counter(map(str, mixing.mix(known, F.array("source"), size_col="n").select(*pick).collect())) == Counter(map(str, counted.collect()))
    by = {(r["pattern"][0]): r["source_size"] for r in counted.collect()}
    assert by["1"] == 3 and by["\U0010ffff<null>"] == 2 and by[None] > 3


def test_mixing_empty(spark):
    assert mixing.mix(frame(spark, []), F.array("source")).count() == 0


# op7


PAGES = [(i, f"http://h/{i}", f"<p>{i % 5}</p>" * 40) for i in range(30)] + [(30, None, None), (31, "u", ""), (32, "u\r\nX: y", "short"), (33, "u", "short"), (None, "u", "<p>1</p>" * 40)]


@pytest.mark.parametrize("gzip", [True, False])
def test_warc(spark, gzip):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    records = warc.read(warc.write(pages, gzip=gzip, roll_bytes=2000))
    assert records.filter("reason is not null").count() == 0
    got = Counter(tuple(r) for r in warc.page_records(records).collect())
    want = Counter()
    for i, _, html in PAGES:
        data = (html or "").encode()
        first = min((j for j, _, h in PAGES if h == html and j is not None), default=None)
        again = len(data) >= 100 and i != first
        want[(i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None)] += 1
    assert got == want


@pytest.mark.parametrize("gzip", [True, False])
def test_warc_damaged(spark, gzip):
    """Bytes of written archives are changed: gaps are rows, and the records beside them come back."""
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string").repartition(2)
    manifest = warc.write(pages, gzip=gzip, roll_bytes=6000 if gzip else 20_000)
    paths = [r["path"].removeprefix("file://") for r in manifest.collect()]
    assert len(paths) > 1
    whole = 0
    for path in paths:
        data = bytearray(open(path, "rb").read())
        for at in range(len(data) // 2, len(data) // 2 + 30):  # in one record or two
            data[at] ^= 0x41
        whole += len(data)
        open(path, "wb").write(data)
    read = warc.read(manifest)
    assert read.rdd.getNumPartitions() == len(paths) and read.agg(F.sum("length")).first()[0] == whole
    got = warc.page_records(read).collect()
    gaps = [r for r in got if r["record_type"] == "gap"]
    assert len(gaps) >= len(paths) and all(r["payload_bytes"] > 0 and r["page_id"] is None for r in gaps)
    left = [r["page_id"] for r in got if r["record_type"] == "response"]
    assert len(left) == len(set(left)) and 40 - 2 * len(paths) <= len(left) <= 40 - len(paths)


@pytest.mark.parametrize("gzip", [True, False])
def test_warc_large_records(spark, gzip, monkeypatch):
    """A page and a url larger than what the reader holds by itself: the manifest tells how large records are."""
    monkeypatch.setattr(warc, "MOST", 1 << 16)
    monkeypatch.setattr(warc.salvage, "__defaults__", (1 << 14, 1 << 16))
    noise = "".join(chr(33 + x) for x in random.Random(4).choices(range(90), k=3 << 20))
    pages = spark.createDataFrame([(1, "u", noise), (2, "http://x/" + noise[: 2 << 20], "small" * 50), (3, "u", "small" * 50)], "page_id long, url string, html string")
    got = warc.page_records(warc.read(warc.write(pages, gzip=gzip))).collect()
    assert {(r["page_id"], r["payload_bytes"], r["record_type"]) for r in got} == {(1, 3 << 20, "response"), (2, 250, "response"), (3, 250, "revisit")}


def test_warc_empty(spark):
    assert warc.page_records(warc.read(warc.write(spark.createDataFrame([], "page_id long, url string, html string")))).count() == 0


def test_salvage_bounds():
    """A member that inflates beyond the bound, and false magic in noise, are passed over; the next record comes back."""
    good = warc.compress(warc.encode_record(1, "u", b"x" * 200, hashlib.sha256(b"x" * 200).hexdigest(), 200, None, False))
    bomb = warc.compress(bytes(4 << 20))
    noise = bytes(random.Random(2).randrange(256) for _ in range(5000)).replace(b"\x1f\x8b", b"..") + warc.MEMBER * 50
    out = list(warc.salvage(io.BytesIO(bomb + noise + good), chunk=1000, most=1 << 16))
    assert [type(x) for x in out] == [warc.Gap, warc.Record] and out[0].length == len(bomb + noise)


@pytest.mark.parametrize("gzip", [True, False])
def test_salvage(gzip):
    payloads = [(f"page {i} " * 60).encode() + b"WARC/1.1\r\n" for i in range(25)]
    plain = [warc.encode_record(i, "u", p, hashlib.sha256(p).hexdigest(), len(p), None, False) for i, p in enumerate(payloads)]
    members = [warc.compress(r) if gzip else r for r in plain]
    whole, rng = b"".join(members), random.Random(1)
    assert [x.payload for x in warc.salvage(io.BytesIO(whole), chunk=333)] == payloads
    for _ in range(40):
        at = rng.randrange(len(whole))
        bad = bytearray(whole)
        bad[at] ^= 0x41
        out = list(warc.salvage(io.BytesIO(bytes(bad)), chunk=500))
        assert sum(x.length for x in out) == len(whole)
        assert sum(isinstance(x, warc.Record) and x.payload in payloads for x in out) >= 24
    cut = members[0] + b"\x1f\x8b\x08junk" + members[1] + b"junk" + members[2][:-3]
    out = list(warc.salvage(io.BytesIO(cut)))
    assert [type(x) for x in out] == [warc.Record, warc.Gap, warc.Record, warc.Gap]
    assert out[1].length == 7


# op8


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)] + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, []), (405, [0.5]), (50, rows[3][1]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("v", F.lit(2)).repartition(3)
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, block_bytes=64 * (8 * 9 + 96), least_rows=16).collect()]
    sound = [(i, np.floor(256 * np.array((v + [0.0] * 8)[:8]))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = Counter()
    for q, x in sound:
        if q % 50 == 0:
            best = sorted(((-int(x @ c), i) for i, c in sound if i != q))[:5]
            if q != 50:
                want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(best))
    assert Counter(x for x in got if x[0] != 50) == want
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_top_k_blocks():
    """Blocks stay within their bytes, and what moves grows with the rows times the blocks of the other side."""
    assert topk._blocks(50_000, 1000, 64, 24, 6, 32 << 20, 1024) == (12, 1)
    n, q = topk._blocks(100_000_000, 2_000_000, 64, 24, 1000, 32 << 20, 1024)
    assert 1800 < n < 1900 and q == 37
    assert topk._blocks(1, 1, 0, 1, 8, 1, 1) == (1, 1)


def test_top_k_large_components(spark):
    """Components beyond 32 bits, and beyond those of a long; a block mixes both."""
    rows = [(i, [float(2.0**k), float(i)]) for i, k in enumerate((1, 40, 20, 40, 3, 41, 2, 0))]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=3).collect()]
    x = {i: np.floor(256 * np.array(v)) for i, v in rows}
    want = sorted(((-int(x[0] @ x[c]), c) for c in x if c))[:3]
    assert sorted(got) == [(0, k + 1, c, -s) for k, (s, c) in enumerate(want)]
    df = spark.createDataFrame([(1e30,), (-1e30,), (2.5,), (-2.5,)], "x double").select(topk.whole_number(F.col("x")).alias("y"))
    assert [r["y"] for r in df.collect()] == [1e30, -1e30, 2.0, -3.0]


# op9


def test_bpe(spark, rows):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    more = rows + [(200, "a" * 5000, "en", "s", 0), (201, "it's 'll  \n\n x<|endoftext|> \x00é" * 9, "en", "s", 0), (202, "zqxjk" * 700, "en", "s", 0)]
    got = Counter(tuple(r) for r in bpe.encode_table(frame(spark, more), path, public_tokenizers.PATTERN).collect())
    want = Counter()
    for i, t, *_ in more:
        ids = reference.encode_ordinary(t or "")
        digest = hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        want[(i, len(ids), digest, hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert got == want


def test_bpe_empty_and_counts(spark, rows):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert bpe.encode_table(frame(spark, []), path, public_tokenizers.PATTERN).count() == 0
    whole = {(r["doc_id"], r["n_tokens"]) for r in bpe.encode_table(frame(spark, rows), path, public_tokenizers.PATTERN).collect()}
    counted = bpe.token_counts(frame(spark, rows), path, public_tokenizers.PATTERN)
    assert "text" not in counted.columns and {(r["doc_id"], r["n_tokens"]) for r in counted.collect()} == whole


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(3000)]
    table = bpe.PerfectHash(keys)
    assert sorted(table.owner.tolist()) == list(range(3000))  # minimal: every slot is used
    assert table.find_all([*keys, b"stranger"]).tolist() == [*range(3000), -1]
    assert [table.find(k) for k in keys] == list(range(3000))


# op10


def test_url_filter(spark):
    urls = [
        "http://a.b.net/x", "https://EXAMPLE.net/en/1?x=/de/", "http://example.net/en", "http://net/", "http://xnet/", "http://example.com/de/#a",
        "http://sub.example.com/de/q?z", "http://example.com/den/", "ftp://w.org/fr/", "http://org/fr/?", "http://org?/fr/", "nothing", None, "", "://", "http://net", "x://A.NET/\n/y",
    ]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("z"))
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.filter_urls(df, url_filter.build_index(spark, url_filter.RULES)).collect()}
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, _, rule, verdict = max(fits, default=(0, 0, None, "allow"))
        assert got[i] == (host, path, rule, verdict), url


def test_url_filter_collisions(spark, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda x, seed=0: len(x) % 2)
    rules = [(f"h{i}.net", "/", "block") for i in range(40)]
    index = url_filter.DigestArray(url_filter.build_index(spark, rules))
    assert index.judge(["h7.net", "x.h8.net", "h99.net"], ["/a", "/", "/"], "allow") == (["h7.net/", "h8.net/", None], ["block", "block", "allow"])
    assert url_filter.DigestArray(url_filter.build_index(spark, [])).judge(["a.net"], ["/"], "allow") == ([None], ["allow"])
    with pytest.raises(ValueError):
        url_filter.build_index(spark, [("a", "/", "allow"), ("a", "/", "block")])


def test_cleanup(spark, rows):
    path = common.fresh_path(spark, "cleanup").removeprefix("file://")
    spark.range(3).write.parquet(path)
    common.cleanup(spark)
    assert not os.path.exists(path)

"""Alignment, Jaccard joins and hard negatives against brute force, with edge cases."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import alignment, jaccard, negatives, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
POOL = " " * 8 + "ab cD's é日本語\n\t\r" + "".join(map(chr, [0xA0, 0x180E, 0x200B, 0x301, 0x85, 0x1F642, 0x2581, 0, 0x1C, 0x3000, 0xFEFF, 0xFB01])) + ",.!?0123 <s></s><|endoftext|> "
CLASHES = ("id", "digest", "name", "key", "keys", "n", "task", "given", "root", "check", "block", "chunk", "a", "b", "q", "v", "windows", "text2", "least")


def clashing(df):
    for name in CLASHES:
        df = df.withColumn(name, F.lit("x"))
    return df


# op12


@pytest.fixture(scope="module")
def files():
    with open(A, "rb") as a, open(B, "rb") as b:
        return a.read(), b.read()


def aligned(texts, tk):
    whole, pieces = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    whole.encode_special_tokens = True
    out, count = [], Counter()
    for text in texts:
        row = {"n_a": 0, "n_b": 0, "n_groups": 0, "links": [], "groups": ""}
        a, b = (whole.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)) if text else ([], [])
        want = (" " + (text or "")).encode()
        if text and b"".join(tk.a_bytes[i] for i in a) == want == b"".join(tk.b_bytes[i] for i in b):
            ends = [np.cumsum([len(t[i]) for i in ids]).tolist() for ids, t in ((a, tk.a_bytes), (b, tk.b_bytes))]
            at, groups = [0, 0], []
            for cut in sorted(set(ends[0]) & set(ends[1])):
                to = [e.index(cut) + 1 for e in ends]
                groups.append("|".join(",".join(map(str, ids[at[k] : to[k]])) for k, ids in enumerate((a, b))))
                at = to
            starts = [[0, *e[:-1]] for e in ends]
            links = [(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]]
            row = {"n_a": len(a), "n_b": len(b), "n_groups": len(groups), "links": links, "groups": ";".join(groups)}
            count.update(links)
        out.append(row)
    top = defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return [
        (r["n_a"], r["n_b"], r["n_groups"], len(r["links"]), sum(count[p] == top[p[1]] for p in r["links"]), sum(count[p] for p in r["links"]), r["groups"]) for r in out
    ]


def strange(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(POOL) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_segments_are_encoded_alone(files):
    """Cutting a text changes no token of either tokenizer."""
    tk = alignment.Tokenizers(*files)
    whole, pieces = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    whole.encode_special_tokens = True
    cut = 0
    for text in strange(3000, 1):
        parts = tk.segments(text)
        cut += len(parts) > 1
        assert [i for s in parts for i in tk.encode_a(" " + s)] == whole.encode(" " + text, add_special_tokens=False).ids
        assert [i for s in parts for i in pieces.encode(s)] == pieces.encode(text)
    assert cut > 200


@pytest.mark.parametrize("bounds", [{}, {"slice_pairs": 100, "chunk_bytes": 500}])
def test_alignment(spark, files, bounds):
    texts = [None, "", "  a b", "a▁b", " \n ", "it's <s> fun <|endoftext|>", "word " * 3000, "x" * 5000, *strange(150, 2)]
    texts += texts[:8]
    df = clashing(spark.createDataFrame([(i if i % 50 else None, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)).repartition(3)
    got = Counter(tuple(r) for r in alignment.align(df, A, B, **bounds).collect())
    assert got == Counter((i if i % 50 else None, *row) for i, row in enumerate(aligned(texts, alignment.Tokenizers(*files))))
    assert sum(r[2] > 0 for r in got) > 50


def test_op12(spark, files, tmp_path):
    texts = [*strange(60, 3), None, ""]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.queries()["op12_alignment"](spark, str(tmp_path)).collect()}
    for i, row in enumerate(aligned(texts, alignment.Tokenizers(*files))):
        assert tuple(got[i])[1:7] == row[:6] and got[i]["groups_sha256"] == (hashlib.sha256(row[6].encode()).hexdigest() if row[6] else "")


def test_alignment_empty(spark):
    assert alignment.align(spark.createDataFrame([], DOCS), A, B).count() == 0


# op11


def joined(rows, percent=85, width=4):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    sets = []
    for _, text in rows:
        w = (text or "").encode().translate(lower).split()
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 62)
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least[find(k)], 1 << 62 if i is None else i)
    return Counter((i, len(sets[k]), None if least[find(k)] == 1 << 62 else least[find(k)]) for k, (i, _) in enumerate(rows))


@pytest.fixture(scope="module")
def families():
    """Families of near copies at many distances, with shared passages, copies, nulls, short, empty and long texts."""
    rng = random.Random(7)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(40))
    passage, out = [word() for _ in range(60)], []
    for _ in range(14):
        base = [word() for _ in range(rng.randrange(5, 150))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.randrange(1, 14)):
            own = list(base)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = word()
            out.append(" ".join(own[: rng.choice([len(own), len(own) - 2])]))
    out += [out[0].upper(), out[1], out[2], None, None, "", " \t\n", "one", "One", "one two", "one two three", "one two three", "a b c d", "é è", " ", " ".join(word() for _ in range(20_000))]
    rows = [(i, t) for i, t in enumerate(out)]
    return [*rows, (None, out[3]), (None, "only without id here"), (5, out[40]), (5, out[5]), (None, None)]


@pytest.mark.parametrize("bounds", [{}, {"region_bytes": 4000}, {"region_bytes": 900, "percent": 60}, {"sample": 0, "percent": 95}])
def test_jaccard(spark, families, bounds, monkeypatch):
    if "percent" in bounds:  # crowded keys too
        monkeypatch.setattr(jaccard, "CROWD", 3)
        monkeypatch.setattr(jaccard, "LARGE", 5)
        monkeypatch.setattr(jaccard, "COMBINED", 2000)
    df = clashing(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in families], DOCS)).repartition(5)
    got = Counter(tuple(r) for r in jaccard.join(df, **bounds).collect())
    want = joined(families, bounds.get("percent", 85))
    assert got == want and sum(i != c for i, _, c in want) > 20


def test_forest_finds_every_link():
    """The tree against all pairs, on sets that are spread from equal to far, in several regions."""
    rng = np.random.default_rng(3)
    sets, region = [], []
    for r in range(3):
        base = np.unique(rng.integers(0, 1 << 63, 80, dtype=np.uint64))
        for _ in range(150):
            own = base.copy()
            own[rng.choice(len(own), rng.integers(0, 14), replace=False)] = rng.integers(0, 1 << 63, dtype=np.uint64)
            sets.append(np.unique(own))
            region.append(r)
    edges, middle = jaccard.forest(np.array(region), np.arange(len(sets)), jaccard.narrow(jaccard.counted(sets)), np.array([len(x) for x in sets]), 85, sets)
    rows = [(i, s) for i, s in enumerate(sets)]
    parent = list(range(len(sets)))

    def find(p, x):
        while p[x] != x:
            x = p[x]
        return x

    want = list(range(len(sets)))
    for i, a in rows:
        for j, b in rows[:i]:
            both = len(np.intersect1d(a, b))
            if region[i] == region[j] and 100 * both >= 85 * (len(a) + len(b) - both):
                want[max(find(want, i), find(want, j))] = min(find(want, i), find(want, j))
    for i, j in edges:
        parent[max(find(parent, i), find(parent, j))] = min(find(parent, i), find(parent, j))
    assert [find(parent, i) for i in range(len(sets))] == [find(want, i) for i in range(len(sets))]
    assert middle.sum() == 3 and len(edges) == len(sets) - len({find(want, i) for i in range(len(sets))})


def test_jaccard_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert jaccard.join(none).count() == 0
    assert [tuple(r) for r in jaccard.join(spark.createDataFrame([(3, None, "", "", 0)], DOCS)).collect()] == [(3, 0, 3)]


# op13


def vectors(rng, n, dims, labels):
    out = []
    for i in range(n):
        v = [round(rng.gauss(0, 1), 2) for _ in range(dims)]
        out.append((i, [x + (i % labels) * 0.7 for x in v], i % labels if rng.random() < 0.8 else rng.randrange(labels)))
    return out


def mined(rows, positives=5, negatives=10):
    rows = [(i, np.floor(256 * np.array(v)), label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for a, q, label in (r for r in rows if r[0] % 10 == 0):
        scored = [(-int(q[: len(x)] @ x[: len(q)]), i, other) for i, x, other in rows if i != a]
        for p, positive, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            fit = sorted((s, i) for s, i, other in scored if other != label and 30 * -p <= 100 * -s <= 90 * -p)[:negatives]
            out.update((a, positive, k + 1, i, -p, -s) for k, (s, i) in enumerate(fit))
    return out


@pytest.mark.parametrize("bounds", [{}, {"least_rows": 16, "block_bytes": 4000, "most_lists": 7, "sample": 40, "list_rows": 3}])
def test_hard_negatives(spark, bounds):
    """Ties, copies, nulls, infinities, vectors of other lengths, negative scores, and a label that has one row."""
    rng = random.Random(9)
    rows = vectors(rng, 300, 6, 4)
    rows += [(300 + i, rows[7][1], i % 3) for i in range(40)]  # one vector many times, of several labels
    rows += [(350, None, 1), (360, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (370, [float("nan")] * 6, 2), (380, [float("inf")] * 6, 2), (390, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    rows += [(400, [5.0, -2.0], 1), (410, [], 2), (420, [2.0] * 6, 77), (430, [-9.0] * 6, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for name in ("id", "q", "v", "block", "shard", "windows", "score"):
        df = df.withColumn(name, F.lit("x"))
    got = negatives.mine(df.repartition(3), F.col("vec_id") % 10 == 0, F.col("label"), **bounds)
    assert Counter(tuple(r) for r in got.collect()) == mined(rows)


def test_hard_negatives_repeated_ids(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [0.0, 1.0], 0), (1, [1.0, 0.0], 0), (2, [0.5, 0.5], 1), (2, [0.5, 0.5], 1)]
    got = negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") == 0, F.col("label"), high=100).collect()
    assert [tuple(r) for r in got] == []  # row 0 counts with label 0 and [0, 1]: its one positive scores 0, and so does no other row


def test_hard_negatives_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert negatives.mine(none, F.col("vec_id") % 100 == 0, F.col("label")).count() == 0


def test_op13_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{folder}/embeddings.parquet'")
    found = queries.queries()["op13_hard_negatives"](spark, folder)
    assert Counter(map(tuple, found.collect())) == Counter(con.execute(queries.OP13_SQL).fetchall())


def test_centroids():
    """Lloyd's rounds keep centroids without rows and shorten the distances."""
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.normal(k * 10, 1, (50, 3)) for k in range(4)])
    found = negatives.centroids(rows, 4, 5)
    away = lambda c: ((rows - c[negatives.nearest(rows, c)]) ** 2).sum()
    assert away(found) <= away(negatives.centroids(rows, 4, 0))
    assert len(negatives.centroids(rows[:2], 10, 3)) == 2

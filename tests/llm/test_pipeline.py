"""The pipeline's stages against what they should keep, on a small fixture."""

import random
from collections import Counter

import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, labels = [], []
    for i in range(300):
        toxic = i % 6 == 0
        text = " ".join(word() for _ in range(60)) + (" wretched trollish" if toxic else "")
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(300 + k, rows[1][1], "en", "s1", len(rows[1][1])) for k in range(20)]  # exact copies
    long = " ".join(word() for _ in range(900))
    rows += [(400 + k, long + f" end{k}", "en", "s2", len(long)) for k in range(6)]  # near copies
    rows += [(500, None, None, None, None), (501, "", "en", "s0", 0), (2, rows[2][1], "en", "s2", 1)]
    out = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    step = dict(corpus_pipeline.STAGES)
    clean = step["toxicity"](spark, docs, folder)
    ids = Counter(r["doc_id"] for r in clean.collect())
    assert not any(i % 6 == 0 for i in ids if i is not None and i < 300) and all(i in ids for i in range(300) if i % 6)
    unique = step["exact dedup"](spark, clean, folder)
    ids = Counter(r["doc_id"] for r in unique.collect())
    assert ids[319] == 1 and ids[1] == 0 and sum(ids.values()) == len(ids) and ids[501] == 1 and ids[500] == 0
    one = step["simhash near-dedup"](spark, unique, folder)
    ids = Counter(r["doc_id"] for r in one.collect())
    assert [i for i in ids if 400 <= i < 406] == [400] and ids[2] == 1
    mixed = step["mixing"](spark, one, folder)
    assert clean.columns == unique.columns == one.columns == mixed.columns == columns
    taken = Counter(r["doc_id"] for r in mixed.collect())
    assert set(taken.values()) <= {1, 2} and 501 not in taken
    last = step["byte-level bpe"](spark, mixed, folder)
    assert Counter(r["doc_id"] for r in last.collect()) == taken


def test_run(spark, folder):
    a = Counter(tuple(r) for r in corpus_pipeline.run(spark, folder).collect())
    b = Counter(tuple(r) for r in corpus_pipeline.run(spark, folder).collect())
    assert a == b and sum(a.values()) > 200


def test_run_on_nothing(spark, tmp_path):
    """No documents, and documents without labels or text."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows, n in (("none", [], 0), ("blank", [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c d e", "en", "s", 9)], 1)):
        folder = tmp_path / name
        spark.createDataFrame(rows, kinds).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        assert corpus_pipeline.run(spark, str(folder)).count() == n

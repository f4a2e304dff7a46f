"""Models behind protocols, settings and questions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import models, vectors
from corpusloom.settings import Settings, load_questions


def test_embed_pending(spark):
    class Lengths:  # local classes travel with the task
        def embed(self, texts):
            assert len(texts) <= 128
            return [[len(t), 1.0] for t in texts]

    chunks = spark.range(300).select((F.col("id") % 200).cast("string").alias("chunk_hash"), F.concat(F.lit("text "), (F.col("id") % 200).cast("string")).alias("text"))
    have = spark.createDataFrame([("5",)], "chunk_hash string")
    got = models.embed_pending(chunks, have, Lengths, 2).collect()
    assert len(got) == 199 and all(abs(np.linalg.norm(r["embedding"]) - 1) < 1e-6 for r in got)
    with pytest.raises(ValueError):
        models.unit([[1.0]], 2)
    assert models.unit([[0.0, 0.0]], 1).tolist() == [[0.0, 0.0]]
    assert models.identity("p", "m") != models.identity("p", "m", dimensions=8)


def test_reranked(spark):
    class Marks:
        def rerank(self, query, texts):
            return [t.count(query) for t in texts]

    rows = spark.createDataFrame([("a", "aab"), ("a", "b"), ("b", "bbb")], "q string, t string")
    assert [r["s"] for r in rows.select(models.reranked(Marks)(F.col("q"), F.col("t")).alias("s")).collect()] == [2.0, 0.0, 3.0]

    class Broken:
        def rerank(self, query, texts):
            raise RuntimeError

    assert [r["s"] for r in rows.select(models.reranked(Broken)(F.col("q"), F.col("t")).alias("s")).collect()] == [None] * 3


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    Settings(chunk_chars=500).save(path)
    assert Settings.load(path, {"CORPUSLOOM_CHUNK_OVERLAP": "20", "CORPUSLOOM_EXCLUDED": "a,b"}) == Settings(chunk_chars=500, chunk_overlap=20, excluded=("a", "b"))
    assert Settings.load(tmp_path / "none", {}) == Settings()
    for bad in ({"chunk_chars": 50}, {"chunk_overlap": 1200}, {"rerank_top_n": 201}, {"chunk_strategy": "x"}, {"structure_max_chars": 10}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_questions(tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text('# first\n{"id": 1, "question": "x", "gold": ["a"]}\n\n')
    assert [q["id"] for q in load_questions(path)] == [1]
    for bad in ("", '{"id": 1, "question": "x", "gold": []}', '{"id": 1, "question": "x", "gold": ["a"]}\n' * 2):
        path.write_text(bad)
        with pytest.raises(ValueError):
            list(load_questions(path))


def test_vector_store(spark, tmp_path):
    """Full calls only, nothing twice, a failing model leaves what others got, a stopped run goes on."""
    calls = tmp_path / "calls"
    calls.mkdir()

    def factory(broken=None):
        class Counting:
            def embed(self, texts):
                import uuid

                if broken and any(broken in t for t in texts):
                    raise RuntimeError("the service said no")
                (calls / f"{len(texts)}-{uuid.uuid4().hex}").touch()
                return [[len(t), 1.0] for t in texts]

        return Counting

    made = lambda: sorted(int(p.name.split("-")[0]) for p in calls.iterdir())
    texts = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("chunk_hash"), F.concat(F.lit("text "), "id").alias("text"))
    model = vectors.Model(models.identity("p", "m"), factory(), 2)
    store = vectors.VectorStore(spark, str(tmp_path / "s"), model)
    assert store.fill(texts.unionByName(texts)) == vectors.Filled(1000, 0, None)
    assert made() == [104, 128, 128, 128, 128, 128, 128, 128] and store.table().count() == 1000
    assert store.fill(texts) == vectors.Filled(0, 0, None) and len(made()) == 8
    # Rounds; a failure in one of them.
    broken = vectors.VectorStore(spark, str(tmp_path / "t"), vectors.Model("m#1", factory("text 777"), 2))
    first = broken.fill(texts, round_rows=300)
    assert "said no" in first.warning and first.embedded + first.left == 1000 and 0 < first.left
    fixed = vectors.VectorStore(spark, str(tmp_path / "t"), vectors.Model("m#1", factory(), 2))
    assert fixed.fill(texts, round_rows=300) == vectors.Filled(first.left, 0, None) and fixed.table().select("chunk_hash").distinct().count() == 1000
    # Questions: a repeated one makes no call, whatever its spaces.
    asked = lambda *q: spark.createDataFrame(list(enumerate(q)), "query_id int, text string")
    questions, before = vectors.VectorStore(spark, str(tmp_path / "s"), model, "questions"), len(made())
    assert questions.of_questions(asked("one two", "one  two ", "three")).count() == 3 and len(made()) == before + 1
    assert questions.of_questions(asked("three", "one two")).count() == 2 and len(made()) == before + 1


def test_remote_embedder():
    """Replies are put in the order of their index; missing, doubled and surplus ones are errors."""
    reply = {"data": [{"index": 1, "embedding": [0.0, 2.0]}, {"index": 0, "embedding": [3.0, 4.0]}]}
    remote = vectors.Remote(lambda request: reply, "m", 2)
    assert remote.embed(["a", "b"]) == [[3.0, 4.0], [0.0, 2.0]]
    for bad in ([], reply["data"][:1], [reply["data"][0]] * 2, [*reply["data"], {"index": 2, "embedding": [1.0]}]):
        with pytest.raises(ValueError):
            vectors.Remote(lambda request, bad=bad: {"data": bad}, "m").embed(["a", "b"])
    made = lambda f: vectors.readiness(vectors.Model("m", f, 2))
    assert vectors.readiness(None)[:2] == (False, "disabled") and made(lambda: vectors.Unavailable("no key")) == (False, "unavailable", "no key")
    assert made(lambda: vectors.Remote(lambda request: {"data": [{"index": 0, "embedding": [1.0, 0.0]}]}, "m")) == (True, "ready", None)
    assert made(lambda: vectors.Remote(lambda request: {"data": [{"index": 0, "embedding": [1.0]}]}, "m"))[1] == "failing"

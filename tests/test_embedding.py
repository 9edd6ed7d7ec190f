"""Embeddings by a model that the caller brings."""

import numpy as np

from seamark.operators import chunking, embedding


def lengths(texts):
    if any("poison" in t for t in texts):
        raise RuntimeError("no")
    return np.array([[len(t), 1.0, 0.0] if "nan" not in t else [np.nan, 1.0, 0.0] for t in texts])


def test_batches_by_length():
    texts = ["x" * n for n in (5, 1, 900, 3, 2, 1000)]
    found = list(embedding.by_length(texts, count=3, characters=1000))
    assert [[len(texts[i]) for i in some] for some in found] == [[1, 2, 3], [5], [900], [1000]]


def test_failures_are_zeros_and_spoil_nothing():
    out, failed = embedding.embed(["abc", "", "poison", "nan", "abcdef"], lengths, 3)
    assert failed.tolist() == [False, False, True, True, False]
    assert np.allclose(np.linalg.norm(out, axis=1), [1, 0, 0, 0, 1])


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    marks = str(tmp_path)

    def load():
        import os
        import uuid

        open(f"{marks}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda texts: np.array([[float(len(t)), 2.0] for t in texts])

    rows = spark.createDataFrame([(i, "t" * (i % 7) if i % 11 else None) for i in range(300)], "chunk_id long, text string").repartition(6)
    got = {r["chunk_id"]: r for r in embedding.embeddings(rows, "chunk_id", "fake", load, 2, prefix="q: ").collect()}
    assert len(got) == 300 and not any(r["failed"] for r in got.values())
    assert got[11]["embedding"] == [0.0, 0.0] and np.allclose(got[1]["embedding"], np.array([4, 2]) / 20**0.5)
    owners = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert owners and len(owners) == len(set(owners))


def test_hashed_default(spark):
    rows = spark.createDataFrame([(1, "alpha beta alpha"), (2, "the of"), (3, None)], "chunk_id long, text string")
    got = {r["chunk_id"]: r["embedding"] for r in chunking.hashed_embeddings(rows, 8).collect()}
    assert set(got) == {1, 2, 3} and abs(sum(x * x for x in got[1]) - 1) < 1e-6 and got[2] == got[3] == [0.0] * 8


def test_memo_computes_what_is_new(spark, tmp_path):
    memo, seen = embedding.Memo(str(tmp_path / "m"), "n long"), []

    def compute(new):
        seen.append(sorted(r["text"] for r in new.collect()))
        return new.selectExpr("key", "cast(length(text) AS long) AS n")

    texts = lambda *xs: spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id long, text string")
    assert [r["n"] for r in memo.take(texts("a", "bb", "a"), "one", compute).orderBy("id").collect()] == [1, 2, 1]
    assert [r["n"] for r in memo.take(texts("bb", "ccc"), "one", compute).orderBy("id").collect()] == [2, 3]
    memo.take(texts("a"), "two", compute)
    memo.take(texts("a", "bb", "ccc"), "one", compute)
    assert seen == [["a", "bb"], ["ccc"], ["a"]]
    # A run that wrote and failed before its end computes the same again and replaces what it wrote.
    new = memo.keyed(texts("bb", "a")).selectExpr("key", "cast(length(text) AS long) AS n")
    stored = memo.stored(texts("a"))
    assert stored.count() == 4 and stored.where("model = 'one'").select("key").distinct().count() == 3 and new.count() == 2

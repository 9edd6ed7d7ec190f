"""Approximate search finds nine tenths of the true neighbours without reading all lists."""

import numpy as np

from seamark.operators import vectors


def test_recall_with_fewer_probes_than_lists(spark):
    v = np.random.default_rng(3).normal(size=(2000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    queries = table.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    index, centers = vectors.coarse_index(table)
    assert vectors.lists_needed(index, centers, queries) < centers.count() == 44
    pairs = lambda d: {(r["query_id"], r["vec_id"]) for r in d.collect()}
    true, found = pairs(vectors.nearest(table, queries)), pairs(vectors.probe(index, centers, queries))
    assert len(found) == len(true) == 1000
    assert len(true & found) / len(true) >= 0.9


def test_queries_in_parts_find_the_same(spark, monkeypatch):
    v = np.random.default_rng(4).normal(size=(300, 16))
    v[7] = v[8] = v[9]  # ties go to the smaller id
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(300, [1.0] * 3), (301, None)], "vec_id long, embedding array<float>")
    queries = table.where("vec_id < 40").selectExpr("vec_id AS query_id", "embedding AS query")
    rows = lambda: sorted(tuple(r) for r in vectors.nearest(table, queries, 5).collect())
    once = rows()
    monkeypatch.setattr(vectors, "SENT_QUERIES", 10)
    assert len(vectors._parts(queries)) == 8 and rows() == once and len(once) == 200
    index, centers = vectors.coarse_index(table.where("vec_id < 300"))
    probed = lambda: sorted(tuple(r) for r in vectors.probe(index, centers, queries, 5, lists=9).collect())
    parts = probed()
    monkeypatch.setattr(vectors, "SENT_QUERIES", 4096)
    assert probed() == parts

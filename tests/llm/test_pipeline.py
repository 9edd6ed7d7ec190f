import zlib

import corpus_pipeline
import numpy as np
import pytest

from seamark.llm import packing

from .test_langid import DE, EN
from .test_minhash import brute as near
from .test_packing import PATH


@pytest.fixture
def folder(spark, docs, tmp_path):
    bench = " ".join(f"q{i}" for i in range(30))
    tail = lambda i: " ".join(f"t{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}" for j in range(20))
    rows = [(i, EN + tail(i)) for i in range(60)] + [(100 + i, EN + tail(i)) for i in range(5)] + [(200, "12 34"), (201, None), (202, bench), (203, EN + "password = hunter2hunter2 " + tail(300))]
    docs(rows).union(docs([(300 + i, DE + tail(400 + i)) for i in range(40)], lang="de")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == columns, name
        out.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    everything = {r["doc_id"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert everything - set(seen[0]) == {200, 201}
    want = {d for d, _, _, kept in near(list(seen[0].items()), corpus_pipeline.SHINGLE) if kept}
    assert set(seen[1]) == want and not {100, 101, 102, 103, 104} & want
    assert set(seen[1]) - set(seen[2]) == {202}
    assert set(seen[3]) == set(seen[2]) and "hunter2" not in seen[3][203]
    assert all(seen[3][d] == t for d, t in seen[2].items() if d != 203)
    rows = corpus_pipeline.run(spark, folder).collect()
    words = packing.WordIds(PATH)
    for r in rows:
        ids = words.ids(seen[3][r["doc_id"]]) + np.array([2], "<u4").tobytes()
        assert r["ids_crc32"] == zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])])
    assert {r["doc_id"] for r in rows} == set(seen[3])


OTHER = "quite different words about rivers and mountains on a summer evening by the sea"


def test_odd_tables(spark, docs, tmp_path):
    """No rows at all; null texts, ids and labels; repeated rows; one very long text; more columns with the operators' own names."""
    bench = " ".join(f"q{i}" for i in range(30))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = " ".join(f"{EN}{i}" for i in range(3000))
    rows = docs([(1, EN), (1, EN), (2, None), (None, None), (None, DE), (None, DE), (3, ""), (4, long), (5, bench), (5, OTHER)], lang=None)
    odd = rows.selectExpr("*", "1 AS row", "'x' AS fit", "2 AS kept", "3 AS component", "'t' AS spans", "4 AS sequence_id", "'w' AS window")
    kept = odd
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0, name
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/s{k}")
        kept = spark.read.parquet(f"{tmp_path}/s{k}")
        assert kept.columns == odd.columns, name
    left = sorted(((r["doc_id"], len(r["text"])) for r in kept.collect()), key=str)
    # Id 5 is of two rows, one of them contaminated; rows without an id have no near-duplicates.
    assert left == sorted([(1, len(EN)), (1, len(EN)), (None, len(DE)), (None, len(DE)), (4, len(long)), (5, len(OTHER))], key=str)
    packed = corpus_pipeline.pack(spark, kept, str(tmp_path)).collect()
    assert sum(r["start"] == 0 for r in packed) == 6
    assert corpus_pipeline.pack(spark, odd.limit(0), str(tmp_path)).count() == 0

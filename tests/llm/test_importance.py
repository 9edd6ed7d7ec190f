import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa

from seamark.llm import importance
from seamark.llm.queries import ORACLES, QUERIES

from .conftest import ODD

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def runs(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute(docs, target, percent=25):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = [0] * 10_000, [0] * 10_000
    for held, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for f in runs(x)[1]:
                held[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10_000) / ((s[b] + 1) * (sum(t) + 10_000)))) for b in range(10_000)]
    out, may = {}, []
    for d, x in docs:
        w, fs = runs(x)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[d] = [len(fs), weight, score, None]
        if len(w) >= 20:
            may.append((-score, d))
    for rank, (_, d) in enumerate(sorted(may)[: percent * len(may) // 100]):
        out[d][3] = rank + 1
    return out


def found(df):
    return {r["doc_id"]: [r["n_features"], r["weight"], r["score"], r["rank"]] for r in df.collect()}


def test_checksums_by_table():
    words = [b"", b"a", b"long" * 60, "é漢".encode(), b"x" * 65, b"y" * 64, b"z" * 200]
    data = np.frombuffer(b"".join(words) + bytes(8), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    crc = importance.crc32s(data, start, end)
    assert crc.tolist() == [zlib.crc32(w) for w in words]
    both = importance.followed(crc[:-1], crc[1:], (end - start)[1:])
    assert both.tolist() == [zlib.crc32(a + b) for a, b in zip(words, words[1:])]


def test_features_of_odd_texts():
    texts = [*ODD, "A-b_c 9é", "one two Three"]
    for first, words, text, buckets in importance.features(pa.array(texts)):
        assert first == 0
        for i, x in enumerate(texts):
            w, fs = runs(x)
            assert words[i] == len(w)
            assert sorted(buckets[text == i]) == sorted(zlib.crc32(f.encode()) % 10_000 for f in fs)


def test_same_as_brute_force(spark, docs):
    texts = [*ODD, *(f"word{i % 7} goes with word{i % 5} and then some more words follow so that there are twenty of them here {i} in all" for i in range(300))]
    texts += ["the same words again and again " * 5] * 150  # a third of all rows
    target = ["word3 goes with word1", "", None, "word3 and then"]
    want = brute(list(enumerate(texts)), target)
    table = docs(texts).repartition(7)
    got = found(importance.resampled(table, spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")))
    assert got == want
    assert sum(r[3] is not None for r in got.values()) == 25 * sum(len(runs(x)[0]) >= 20 for x in texts) // 100


def test_empty_and_clashing_tables(spark, docs):
    target = spark.createDataFrame([], "text string")
    assert importance.resampled(docs([]), target).count() == 0
    odd = docs(["a b c " * 10] * 8).selectExpr("doc_id", "text", "1 AS rank", "2 AS score", "3 AS range", "4 AS place", "5 AS before")
    got = importance.resampled(odd, target)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and sorted(r["rank"] or 0 for r in got.collect()) == [0] * 6 + [1, 2]
    twice = spark.createDataFrame([(None, "a b c " * 10), (1, "a b c " * 10), (1, "a b c " * 10), (None, None)], "doc_id long, text string")
    rows = importance.resampled(twice, target, percent=100).collect()
    assert sorted(r["rank"] or 0 for r in rows) == [0, 1, 2, 3]


def test_same_as_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    rows = con.execute(ORACLES["op11_importance"])
    names = [d[0] for d in rows.description]
    want = {r[names.index("doc_id")]: [r[names.index(n)] for n in ("n_features", "weight", "score", "rank")] for r in rows.fetchall()}
    assert found(QUERIES["op11_importance"](spark, folder)) == want

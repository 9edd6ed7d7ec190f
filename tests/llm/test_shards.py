import zlib

from seamark.llm import shards

from .conftest import ODD


def check(rows, texts, n=16):
    assert len(rows) == len(texts)
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots))) and 0 <= s < n
    crcs = sorted(zlib.crc32((t or "").encode()) for t in texts)
    assert sorted(r["text_crc32"] for r in rows) == crcs


def test_even_bytes_with_a_hot_value(spark, docs):
    texts = [("hot " * 40 if i % 3 else f"text {i} " * (i % 50)) for i in range(1200)]
    rows = shards.kd_shards(docs(texts)).collect()
    check(rows, texts)
    size = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(16)]
    assert max(size) - min(size) <= 2 * max(r["size"] for r in rows)
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 for r in rows)


def test_odd_rows(spark, docs):
    rows = docs([*ODD, (None, "no id"), (3, "again"), (3, "again")]).withColumn("shard", shards.F.lit(1))
    check(shards.kd_shards(rows).collect(), [*ODD, "no id", "again", "again"])
    assert shards.kd_shards(docs([])).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 3, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["size"] for r in shards.kd_shards(nulls).collect()} == {1}


def test_median_is_the_weighted_one(spark):
    rows = spark.createDataFrame([(i, 10 if i == 0 else 1) for i in range(10)], "x_doc_id long, bytes long").selectExpr("*", "0L AS tie", "0 AS node")
    cut = shards.medians(rows, {0: "doc_id"}, {0: 0.5})[0]
    assert rows.where(shards.coordinate("doc_id") <= cut).agg({"bytes": "sum"}).first()[0] == 10


def test_plan_has_no_python(spark, docs):
    plan = shards.kd_shards(docs(["a", "b"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def tree(rows, leaves, node=0, fresh=None):
    """Shards by plain recursion over all rows, level by level: {row's number: leaf}."""
    nodes, out, fresh = {0: leaves}, dict.fromkeys(range(len(rows)), 0), 1
    key = lambda r, d: (r[f"x_{d}"] << shards.HASH_BITS) | r["tie"]
    while any(n > 1 for n in nodes.values()):
        for k, n in [x for x in nodes.items() if x[1] > 1]:
            mine = [i for i in out if out[i] == k]
            nodes[k], nodes[fresh] = (n + 1) // 2, n // 2
            if mine:
                d = max(shards.DIMENSIONS, key=lambda d: max(rows[i][f"x_{d}"] for i in mine) - min(rows[i][f"x_{d}"] for i in mine))
                mine.sort(key=lambda i: key(rows[i], d))
                want = sum(rows[i]["bytes"] for i in mine) * ((n + 1) // 2) / n
                at, best = 0, None
                for j in range(len(mine) + 1):
                    if best is None or abs(at - want) <= best[0]:
                        best = (abs(at - want), j)
                    at += rows[mine[j]]["bytes"] if j < len(mine) else 0
                for i in mine[best[1] :]:
                    out[i] = fresh
            fresh += 1
    return out


def test_same_leaves_as_a_plain_tree(spark, docs, monkeypatch):
    rows = [(i * 7 % 301, f"text {i} " * (i * i % 37)) for i in range(400)]
    table = docs(rows[:200]).unionByName(docs(rows[200:300], lang="de", source="src10")).unionByName(docs(rows[300:], lang=None, source="src1"))
    made = {}
    monkeypatch.setattr(shards, "scaled", lambda t, f=shards.scaled: made.setdefault("t", shards.written(f(t))))
    got = shards.kd_shards(table, 7).collect()
    points = made["t"].collect()
    want = tree(points, 7)
    count = lambda pairs: sorted((d, c, s) for d, c, s in pairs)
    assert count((r["doc_id"], r["text_crc32"], r["shard"]) for r in got) == count((points[i]["doc_id"], points[i]["crc"], s) for i, s in want.items())


def test_equal_rows_are_spread_within_one_row(spark, docs):
    rows = shards.kd_shards(docs([(5, "one and the same")] * 1000)).collect()
    check(rows, ["one and the same"] * 1000)
    size = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(16)]
    assert max(size) - min(size) <= 2 * 17


def test_strings_differ_beyond_a_common_start(spark, docs):
    long = "the same long start of all sources/"
    table = docs([(1, "a")], source=long + "b").unionByName(docs([(2, "a")], source=long + "a")).unionByName(docs([(3, "a")], source=None))
    got = {r["doc_id"]: r["source"] for r in shards.points(table).collect()}
    assert got == {1: 2, 2: 1, 3: 0}


def test_target_bytes_give_the_number_of_leaves(spark, docs):
    rows = shards.kd_shards(docs(["x" * 99] * 80), target_bytes=1000).collect()
    assert {r["shard"] for r in rows} == set(range(8))

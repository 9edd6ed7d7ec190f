"""Hand-made cases with results worked out on paper."""

import math

import pytest
from pyspark.sql import functions as F

from seamark.functions import intent, text
from seamark.operators import bm25, chunking, context, evaluate, extract, fusion, graph, metrics, serving, vectors
from seamark.plans.components import connected_components
from seamark.sources import files as S


def test_keyword_scores(spark):
    docs = spark.createDataFrame([(0, "p/a", "alpha beta"), (1, "p/b", "alpha alpha gamma"), (2, "q/c", "delta"), (3, "q/d", "epsilon zeta")], "doc_id long, file_path string, text string")
    index = bm25.build(docs)
    q = spark.createDataFrame([(0, "beta"), (1, "beta beta"), (2, "alpha"), (3, "the of nothing")], "query_id long, query string")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in bm25.scored(index, q).collect()}
    assert got[0, 0] == pytest.approx(math.log(3.5 / 1.5)) and got[1, 0] == pytest.approx(2 * math.log(3.5 / 1.5))
    assert got[2, 0] == pytest.approx(0)
    top = bm25.search(index, q).collect()
    assert [(r["query_id"], r["doc_id"]) for r in top] == [(0, 0), (1, 0)]
    assert bm25.search(index, q, projects=["q"]).count() == 0


def test_index_is_saved_and_read(spark, tmp_path):
    docs = spark.createDataFrame([(0, "p/a", "alpha beta")], "doc_id long, file_path string, text string")
    bm25.build(docs).save(str(tmp_path))
    assert bm25.Index.load(spark, str(tmp_path)).corpus.first()["n"] == 1


def test_terms_and_snippets(spark):
    row = spark.createDataFrame([("The Foo.bar_1 is a x9 of I baz-qux",)], "t string").select(text.terms(F.col("t")).alias("x")).first()
    assert row["x"] == ["foo.bar_1", "x9", "baz", "qux"]
    d = spark.createDataFrame([("a" * 300 + " needle " + "b" * 300, ["needle"]), ("short", []), ("c" * 250, [])], "t string, m array<string>")
    out = [r["s"] for r in d.select(text.snippet(F.col("t"), F.col("m")).alias("s")).collect()]
    assert out[0].startswith("...") and "needle" in out[0] and out[0].endswith("...") and len(out[0]) == 206
    assert out[1:] == ["short", "c" * 200 + "..."]


def test_fusion_and_cut(spark):
    v = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.5)], "query_id long, doc_id long, vector_score double")
    k = spark.createDataFrame([(1, 11, 4.0, ["a"]), (1, 12, 2.0, ["b"])], "query_id long, doc_id long, bm25_score double, matched_terms array<string>")
    w = spark.createDataFrame([(1, 0.6, 0.4)], "query_id long, vector_weight double, bm25_weight double")
    both = fusion.fused(v, k, w)
    got = {r["doc_id"]: (round(r["score"], 6), r["search_type"]) for r in both.collect()}
    assert got == {11: (0.7, "hybrid"), 10: (0.54, "vector"), 12: (0.2, "bm25")}
    assert [r["doc_id"] for r in fusion.cut(both, 0.25).orderBy("rank").collect()] == [11, 10, 12]
    assert [r["doc_id"] for r in fusion.cut(both, 0.25, enough=2).orderBy("rank").collect()] == [11, 10]


def test_relevance(spark):
    d = spark.createDataFrame([(0.6, "proj/a.py", "proj login"), (3.0, "p/x.bin", "zzz"), (0.3, "z/README.md", "what is it")], "d double, p string, q string")
    got = [r[0] for r in d.select(vectors.relevance(F.col("d"), F.col("p"), F.col("q"))).collect()]
    assert got == pytest.approx([1.0, 0.1, 1.0])


def test_nearest_in_parts(spark):
    v = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(50)], "vec_id long, embedding array<float>").repartition(5)
    q = spark.createDataFrame([(0, [10.2, 0.0])], "query_id long, query array<float>")
    assert [r["vec_id"] for r in vectors.nearest(v, q, 3).orderBy("rank").collect()] == [10, 11, 9]
    assert [r["vec_id"] for r in vectors.nearest(v, q, 2, "ip").orderBy("rank").collect()] == [49, 48]
    index, centers = vectors.coarse_index(v, 4)
    assert [r["vec_id"] for r in vectors.probe(index, centers, q, 3, 4).orderBy("rank").collect()] == [10, 11, 9]
    odd = spark.createDataFrame([(1, None), (2, [1.0]), (3, [float("nan"), 0.0]), (4, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert {r["vec_id"]: r["fault"] for r in vectors.faults(odd, 2).collect()} == {1: "missing", 2: "width", 3: "not finite"}


EDGE = "source_id string, target_id string, type string"


def edges(spark, text_, kind="calls"):
    return spark.createDataFrame([(*e.split(">"), kind) for e in text_.split()], EDGE)


def start(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node_id string")


def test_callers_in_cycles_and_diamonds(spark):
    cycle = edges(spark, "a>b b>c c>a")
    got = lambda e, n, d: sorted((r["node_id"], r["depth"]) for r in graph.callers(e, start(spark, n), d).collect())
    assert got(cycle, "c", 3) == [("a", 2), ("b", 1), ("c", 3)] and got(cycle, "c", 1) == [("b", 1)]
    diamond = edges(spark, "a>b a>c b>d c>d")
    assert got(diamond, "d", 2) == [("a", 2), ("b", 1), ("c", 1)]
    assert got(diamond.union(edges(spark, "a>d")), "d", 2) == [("a", 1), ("a", 2), ("b", 1), ("c", 1)]


def test_paths_cycles_and_chains(spark):
    e = edges(spark, "a>b b>c c>a b>d d>d")
    assert sorted(r["cycle"] for r in graph.cycles(e).collect()) == ["a > b > c > a", "d > d"]
    got = [" ".join(r["path"]) for r in graph.call_paths(e, start(spark, "a"), start(spark, "d")).collect()]
    assert sorted(got) == ["a b d", "a b d d"] or sorted(got) == ["a b d"]
    up = edges(spark, "x>y y>z w>z", "inherits")
    assert sorted(" ".join(r["path"]) for r in graph.chains(up).collect()) == ["w z", "x y z"]


def test_coupling(spark):
    n = spark.createDataFrame([("f1", "function", "f1", "F", 1, 5), ("f2", "function", "f2", "F", 6, 9), ("g1", "function", "g1", "G", 1, 2), ("h1", "class", "h1", "H", 1, 2)], "node_id string, type string, name string, file_path string, line_start int, line_end int")
    e = edges(spark, "f1>f2 f1>g1 f2>g1").union(edges(spark, "f2>h1", "imports"))
    r = graph.coupling(n, e).where("file_path = 'F'").first()
    assert (r["external_files"], r["internal_edges"], r["coupling"], r["cohesion"], r["advice"]) == (2, 1, 1.0, 0.5, "high external coupling")
    assert graph.symbol_at(n, spark.createDataFrame([("F", 7), ("F", 99)], "file_path string, line int")).collect() == [("F", 7, "f2")]
    assert {x["node_id"] for x in graph.find_nodes(n, ["f_"], limit=None).collect()} == set()
    assert graph.by_name(n, "F_", exact=False, sqlite_like=True).count() == 2
    assert graph.orphans(e, n.where("node_id <> 'h1'")).count() == 1
    near = graph.neighbourhood(n, e, start(spark, "f1"))
    assert {(r["arm"], r["node_id"]) for r in near.collect()} >= {("call target", "g1"), ("sibling", "f2"), ("dependency", "h1")}


def test_interval_link(spark):
    c = spark.createDataFrame([("k", "f", 10, 20, "calls C here")], "chunk_id string, file_path string, start_line int, end_line int, text string")
    s = spark.createDataFrame([("f", "AA", "a", 1, 12), ("f", "BB", "b", 15, 40), ("f", "C", "c", 50, 60)], "file_path string, name string, node_id string, line_start int, line_end int")
    assert chunking.match_symbols(c, s).collect() == [("k", "c", 10)]
    assert chunking.match_symbols(c.withColumn("text", F.lit("")), s).collect() == [("k", "b", 6)]


def test_metrics_of_retrieval(spark):
    res = spark.createDataFrame([(1, i + 1, d) for i, d in enumerate("abcde")], "query_id long, rank int, doc_id string")
    gold = spark.createDataFrame([(1, "x", "b"), (1, "x", "e"), (1, "x", "z"), (1, "x", "e"), (2, "y", "q")], "query_id long, category string, doc_id string")
    out = evaluate.per_query(res, gold)
    r = out.where("query_id = 1").first()
    assert [r[m] for m in evaluate.METRICS] == pytest.approx([1 / 3, 2 / 5, 0, 2 / 3, 1 / 2])
    total = {r["category"]: r for r in evaluate.summary(out).collect()}
    assert total["overall"]["queries"] == 2 and total["y"]["mrr"] == 0
    assert {r["metric"]: r["change"] for r in evaluate.compared(evaluate.summary(out), evaluate.summary(out)).where("category = 'x'").collect()}["mrr"] == 0


def test_paths(spark):
    d = spark.createDataFrame([("src/app.js",), ("/workspace/project/src/app.js",), ("project/src/app.js",), ("",), ("/abs/x.py",)], "p string")
    got = [r[0] for r in d.select(S.normalised(F.col("p"), F.lit("q"))).collect()]
    assert got == ["q/src/app.js", "project/src/app.js", "q/project/src/app.js", "q/", "q/x.py"]
    found = {r["file_path"]: (r["corrected"], r["severity"]) for r in S.inconsistencies(d.select(F.col("p").alias("file_path"))).collect()}
    assert found["src/app.js"] == ("project/src/app.js", "critical") and found["/workspace/project/src/app.js"][1] == "warning"
    n = spark.createDataFrame([(p,) for p in ("shop/a", "shop/b", "shop/c", "frontend/x", "backend/y", "/workspace/test/z", "k/m", "m/n")], "file_path string")
    r = S.project_check(n, "shop").first()
    assert tuple(r) == (3, 0, 2, 5, "issues")


def test_workspace_scan(spark, tmp_path):
    for name, body in (("p/a.py", b"def f(): pass\n"), ("p/README", b"hello"), ("p/node_modules/x.js", b"1"), ("p/data.bin", b"\0"), ("p/blob", b"a\0b"), ("p/.git/config", b"x")):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(body)
    got = S.scan(spark, str(tmp_path))
    marked = {r["file_path"]: r["ok"] for r in got.select("file_path", S.indexable(F.col("file_path"), F.col("size"), F.col("content")).alias("ok")).collect()}
    assert marked == {"p/a.py": True, "p/README": True, "p/data.bin": False, "p/blob": False}


PY = '''import os
from util.text import clean

class UserManager(Base):
    """Keeps users."""
    def create_user(self, name):
        return clean(name)

def main():
    m = UserManager()
    m.create_user("x")
'''
JS = "import x from './x';\nexport function run(a) { const s = '}'; return a; }\nclass Foo extends Bar {\n go() { run(1); }\n}\nconst f = (a) => { return a; };\n"


def test_source_chunks(spark):
    f = spark.createDataFrame([("p/a.py", PY), ("p/b.js", JS), ("p/c.py", "def (:"), ("p/d.go", "type T struct {\n a int\n}\nfunc Go(x int) {\n}\n"), ("p/e.txt", "tiny")], "file_path string, content string")
    rows = chunking.code_chunks(f).collect()
    got = [(r["file_path"], r["chunk_type"], r["function_name"] or r["class_name"]) for r in rows]
    assert got == [("p/a.py", "class", "UserManager"), ("p/a.py", "function", "main"), ("p/b.js", "function", "run"), ("p/b.js", "class", "Foo"), ("p/b.js", "function", "f"), ("p/c.py", "fallback", None), ("p/d.go", "class", "T"), ("p/d.go", "function", "Go"), ("p/e.txt", "small_file", None)]
    assert rows[0]["docstring"] == "Keeps users." and rows[0]["dependencies"] == ["Base"] and rows[3]["dependencies"] == ["Bar"]
    nodes, edges_ = extract.graph_of(chunking.code_chunks(f))
    assert edges_.where("type = 'calls'").count() == 1 and edges_.where("type = 'imports'").count() == 3
    tree = chunking.hierarchy(chunking.code_chunks(f))
    assert chunking.hierarchy_faults(tree).count() == 0


def test_symbols_imports_calls_relations(spark):
    f = spark.createDataFrame([("app/service/a.py", PY), ("p/B.java", "import a.b.Util;\nclass B extends C {\n public void run(int x) { util.go(); }\n}")], "file_path string, content string")
    assert {(r["name"], r["type"]) for r in extract.symbols(f).where("file_path like '%.py'").collect()} == {("UserManager", "class"), ("create_user", "function"), ("main", "function")}
    assert {r["name"] for r in extract.symbols(f).where("type = 'method'").collect()} == {"run"}
    assert {(r["target"], round(r["confidence"], 2)) for r in extract.imports(f).collect()} == {("os", 0.9), ("util.text", 0.9), ("clean", 0.9), ("a.b.Util", 1.0)}
    assert extract.calls(f, spark.createDataFrame([("create_user",)], "name string")).where("kind = 'object_method'").first()["target"] == "m.create_user"
    rel = {(r["source"], r["target"], r["family"]) for r in extract.relations(f).collect()}
    assert ("A", "Base", "inheritance") in rel and ("B", "C", "interface_implementation") in rel
    known = spark.createDataFrame([("n1", "UserManager", "app/service/a.py"), ("n2", "main", "app/service/a.py"), ("n3", "clean", "x.py")], "node_id string, name string, file_path string")
    assert {(r["source_id"], r["target_id"]) for r in extract.references(f, known).where("type = 'calls'").collect()} == {("n1", "n2"), ("n2", "n1"), ("n1", "n3"), ("n2", "n3")}


def test_synthesis(spark):
    s = "source string, target string, family string, confidence double, evidence array<string>"
    a = spark.createDataFrame([("A", "B", "import", 0.8, ["x"]), ("A", "C", "event", 0.5, ["x"])], s)
    b = spark.createDataFrame([("A", "B", "import", 0.7, ["y"])], s)
    got = {r["target"]: round(r["confidence"], 3) for r in extract.synthesised(a, b, b.limit(0)).collect()}
    assert got == {"B": 0.99, "C": 0.55}


def test_context_merging(spark):
    c = spark.createDataFrame([("f", 1, 5, "a", 0.2), ("f", 8, 9, "b", 0.9), ("f", 30, 31, "c", 0.1), ("g", 1, 1, "d", 0.5)], "file_path string, start_line int, end_line int, text string, score double")
    got = sorted((r["file_path"], r["start_line"], r["end_line"], r["text"], r["score"]) for r in context.merged_neighbours(c).collect())
    assert got == [("f", 1, 9, "a\nb", 0.9), ("f", 30, 31, "c", 0.1), ("g", 1, 1, "d", 0.5)]


def test_moving_average_is_the_fold(spark):
    values = [3.0, 10.0, -2.0, 7.5, 7.5]
    d = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, i int, v double")
    ema = values[0]
    for v in values[1:]:
        ema = 0.9 * ema + 0.1 * v
    assert metrics.moving_average(d, "k", "v", ("i",)).first()["ema"] == pytest.approx(ema)


def test_intents(spark):
    q = spark.createDataFrame([("UserService.getUser() method",), ("how does the workflow process work and what is the design",), ("fix error exception crash bug",)], "query string")
    assert [r["intent"] for r in intent.classified(q).collect()] == ["specific_symbol", "conceptual", "debugging"]
    assert all(0.1 <= r["vector_weight"] <= 0.9 for r in intent.classified(q).collect())


def test_components_of_chains_and_stars(spark, tmp_path):
    n = [0]

    def cut(df):
        n[0] += 1
        df.write.parquet(f"{tmp_path}/{n[0]}")
        return df.sparkSession.read.parquet(f"{tmp_path}/{n[0]}")

    pairs = [(i, i + 1) for i in range(100, 130)] + [(7, i) for i in range(8, 20)] + [(50, 50), (60, 61), (61, 60)]
    e = spark.createDataFrame(pairs, "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(e, cut).collect()}
    assert all(got[i] == 100 for i in range(100, 131)) and all(got[i] == 7 for i in range(7, 20)) and got[61] == got[60] == 60 and 50 not in got
    assert connected_components(e.limit(0), cut).count() == 0


def test_tables_that_repeat_are_removed(spark):
    text = "intro\n\n| a | b | c |\n| 1 | 2 | 3 |\n| 4 | 5 | 6 |\n\n\nmiddle\n| x | y |\n| 1 | 2 |\nend\n\n"
    t = spark.createDataFrame([(1, text), (2, text), (3, None)], "text_id long, text string")
    found = serving.pipe_tables(t)
    assert {(r["text_id"], r["first_line"], r["rows"], r["columns"]) for r in found.collect()} == {(k, a, n, c) for k in (1, 2) for a, n, c in ((3, 3, 3), (9, 2, 2))}
    shown = spark.createDataFrame([(1, 3, 2), (2, 2, 9)], "text_id long, columns int, rows int")
    matches = serving.repeated_tables(found, shown)
    assert {(r["text_id"], r["first_line"], r["likeness"]) for r in matches.collect()} == {(1, 3, 1.0), (2, 9, 0.7)}
    out = {r["text_id"]: r["text"] for r in serving.without_tables(t, matches).collect()}
    assert out[1] == "intro\n\nmiddle\n| x | y |\n| 1 | 2 |\nend"
    assert out[2] == "intro\n\n| a | b | c |\n| 1 | 2 | 3 |\n| 4 | 5 | 6 |\n\nmiddle\nend" and out[3] is None


def test_readme_references_by_question(spark):
    t = spark.createDataFrame([(1, "use `lib/x.py`, /api/users and src/app, UserDialog, package.json")], "k long, text string")
    kinds = lambda q: [r["kind"] for r in serving.readme_references(t, "k", q).orderBy("rank").collect()]
    assert kinds("general")[0] == "file_paths" and kinds("authentication")[0] == "api_endpoints" and len(kinds("")) == 3

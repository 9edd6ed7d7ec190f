"""Imports to files, and the arms of related files."""

from seamark.operators import related, smart

FILES = [
    ("app/core/store.py", "import os\n"),
    ("app/api/views.py", "from app.core.store import Store\nimport helpers\n"),
    ("app/api/helpers.py", "from core.store import x\n"),
    ("lib/helpers.py", "import nothing\n"),
    ("app/core/store_test.py", "import store\n"),
    ("tests/test_store.py", "from store import y\n"),
    ("app/core/settings.ini", "[a]\nstore = 1\n"),
    ("app/package.json", '{"views": 1}'),
    ("web/a.js", "import z from '../app/core/store';\n"),
    ("app/core/store_cache.py", ""),
    ("README", None),
]


def test_imports_mean_the_longest_end_that_one_file_has(spark):
    files = spark.createDataFrame(FILES, "file_path string, content string")
    got = {(r["file_path"], r["target"]) for r in related.import_edges(files).collect()}
    store = "app/core/store.py"
    # helpers.py is there twice, so that its bare name means neither.
    assert got == {("app/api/views.py", store), ("app/api/helpers.py", store), ("app/core/store_test.py", store), ("tests/test_store.py", store), ("web/a.js", store)}


def test_arms(spark):
    files = spark.createDataFrame(FILES, "file_path string, content string")
    rows = related.related(files, files.where("file_path in ('app/core/store.py', 'README')"), most=2).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["target"], r["arm"], r["rank"])):
        got.setdefault((r["target"], r["arm"]), []).append(r["file_path"])
    assert got == {
        ("app/core/store.py", "imported by"): ["app/api/helpers.py", "app/api/views.py"],
        ("app/core/store.py", "test"): ["app/core/store_test.py", "tests/test_store.py"],
        ("app/core/store.py", "configuration"): ["app/core/settings.ini", "app/package.json"],
        ("app/core/store.py", "name"): ["app/core/store_cache.py", "app/core/store_test.py"],
    }


def test_intents(spark):
    asked = ["what does it do", "the database schema of the user entity", "open main.py in src", "explain the architecture of the system", 'find "exact words"', "edit web.xml"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = [(r["intent"], r["strategies"], r["file_hints"]) for r in smart.analysed(q).orderBy("query_id").collect()]
    assert got == [
        ("conceptual", ["vector", "keyword"], []),
        ("entity", ["hybrid", "entities", "vector", "keyword"], []),
        ("conceptual", ["vector", "keyword"], ["main.py"]),
        ("architecture", ["hybrid", "vector", "structure", "keyword"], []),
        ("conceptual", ["hybrid", "vector", "keyword"], []),
        ("conceptual", ["hybrid", "vector", "keyword"], ["web.xml"]),
    ]

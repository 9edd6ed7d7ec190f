"""Queries over source text: a small code base is written out of the driver's keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import intent
from ..functions import text as T
from ..operators import bm25, chunking, context, evaluate, extract, graph, metrics, serving
from ..sources import files as S
from ..sources.sinks import scratch, written
from .queries_search import _ASKED, _INDEX, _INTENT, _L2, _PLAIN, _SCORES, _SIGNALS, MASKED, _numbered, asked
from .registry import register
from .tables import chunks, edges, files, nodes, read, sql, transitions

#: table, path and text; {k} and {p} are the row's key and its parent's.
_CODE = (
    ("nation", "n_nationkey", "n_regionkey", "app/service/nation_{k}.py", "import os\nfrom region_{p} import Region{p}\n\nclass Nation{k}(Region{p}):\n    def load_{k}(self, x):\n        return util.find_{p}(x)\n"),
    ("region", "r_regionkey", "r_regionkey", "core/model/region_{k}.py", "class Region{k}(Base):\n    def find_{k}(self, x):\n        return os.environ.get('REGION_{k}')\n"),
    ("supplier", "s_suppkey", "s_nationkey", "web/controller/Supplier{k}.java", "import core.model.Nation{p};\nclass Supplier{k} extends Base {\n    public void run{k}(int x) {\n        util.go{k}(x);\n    }\n}\n"),
    ("customer", "c_custkey", "c_nationkey", "web/view/customer_{k}.js", "import x from './nation_{p}';\nfunction show_{k}(a) {\n  return load_{p}(a);\n}\nconst row_{k} = show_{k}(1);\n"),
    ("part", "p_partkey", "p_size", "conf/part_{k}/package.json", '{{"dependencies": {{"lib{p}": "1.{k}"}}}}\n'),
)


def code(spark, sf) -> DataFrame:
    """file_path, content."""

    def one(table, key, parent, path, text):
        fill = lambda s: F.concat(*[F.col(key) if p == "\0k" else F.col(parent) if p == "\0p" else F.lit(p) for p in _parts(s)])
        return read(spark, sf, table).select(fill(path).alias("file_path"), fill(text).alias("content"))

    return reduce(DataFrame.unionByName, [one(*c) for c in _CODE])


def _parts(template: str) -> list[str]:
    """A template in literal parts and marks of its two fields."""
    out = template.replace("{k}", "\1\0k\1").replace("{p}", "\1\0p\1").replace("{{", "{").replace("}}", "}").split("\1")
    return [p for p in out if p]


def _literal(p: str) -> str:
    return "'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _fill(s, key, parent):
    return " || ".join(key if p == "\0k" else parent if p == "\0p" else _literal(p) for p in _parts(s))


CODE = "code AS (" + " UNION ALL ".join(f"SELECT {_fill(path, k, p)} AS file_path, {_fill(text, k, p)} AS content FROM {t}" for t, k, p, path, text in _CODE) + ")"
_SUFFIX = "lower(regexp_extract(file_path, '\\.([^./]+)$', 1))"
_LANG = "CASE " + " ".join(f"WHEN {_SUFFIX} = '{s}' THEN '{v}'" for s, v in S.LANGUAGES.items()) + " ELSE 'unknown' END"


def _q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


_KNOWN = "('java', 'js', 'py', 'ts')"
_SYMBOLS = " UNION ALL ".join(f"SELECT file_path, unnest(regexp_extract_all(content, {_q(p)}, {g})) AS name, '{kind}' AS type FROM code WHERE {_SUFFIX} IN ({', '.join(_q(x) for x in suffixes)}) OR {_SUFFIX} NOT IN {_KNOWN}" for _, kind, suffixes, p, g in extract.SYMBOLS)


@register("g2_symbols", f"WITH {CODE}, s AS ({_SYMBOLS}) SELECT file_path, name, type, count(*) AS n FROM s WHERE name <> '' GROUP BY ALL")
def g2(spark, sf):
    return extract.symbols(code(spark, sf))


def _known(spark, sf):
    return _known_of(code(spark, sf))


def _known_of(files):
    s = extract.symbols(files).where("type <> 'variable'")
    return s.select(F.concat_ws("::", "file_path", "name").alias("node_id"), "name", "file_path").distinct()


_KNOWN_SQL = f"s AS ({_SYMBOLS}), known AS (SELECT DISTINCT file_path || '::' || name AS node_id, name, file_path FROM s WHERE name <> '' AND type <> 'variable')"
_REFS = " UNION ".join(f"SELECT DISTINCT file_path, unnest(regexp_extract_all(content, {_q(p)}, {g})) AS name, '{kind}' AS type FROM code" for p, g, kind in extract.REFERENCES)


@register("g8_references", f"WITH {CODE}, {_KNOWN_SQL}, r AS ({_REFS}) SELECT DISTINCT o.node_id AS source_id, t.node_id AS target_id, r.type FROM r JOIN known t USING (name) JOIN known o ON o.file_path = r.file_path WHERE o.node_id <> t.node_id")
def g8(spark, sf):
    return extract.references(code(spark, sf), _known(spark, sf))


@register(
    "g7_resolved_names",
    f"WITH {CODE}, {_KNOWN_SQL}, r AS (SELECT DISTINCT file_path, name FROM ({_REFS})), a AS (SELECT file_path, name, CASE WHEN name = 'Base' THEN 'Region1' ELSE NULL END AS real FROM r), g AS (SELECT name, min(node_id) AS id FROM known GROUP BY name), l AS (SELECT file_path, name, min(node_id) AS id FROM known GROUP BY ALL) SELECT r.file_path, r.name, coalesce(ga.id, l.id, g.id) AS node_id FROM r LEFT JOIN a ON a.file_path = r.file_path AND a.name = r.name LEFT JOIN g ga ON ga.name = a.real LEFT JOIN l ON l.file_path = r.file_path AND l.name = r.name LEFT JOIN g ON g.name = r.name",
)
def g7(spark, sf):
    parts = [code(spark, sf).select("file_path", F.explode(F.regexp_extract_all("content", F.lit(p), F.lit(g))).alias("name")) for p, g, _ in extract.REFERENCES]
    refs = reduce(DataFrame.unionByName, parts).distinct()
    aliases = refs.where("name = 'Base'").select("file_path", F.col("name").alias("alias"), F.lit("Region1").alias("target"))
    return extract.resolved(refs, _known(spark, sf), aliases)


@register("g9_module_nodes", sql("SELECT regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\\.[^.]*$', '') || '::module::0' AS node_id, file_path FROM (SELECT DISTINCT file_path FROM nodes EXCEPT SELECT file_path FROM nodes WHERE type = 'module')", "nodes"))
def g9(spark, sf):
    return extract.module_nodes(nodes(spark, sf)).select("node_id", "file_path")


_IMPORTS = " UNION ".join(f"SELECT file_path, language, unnest(regexp_extract_all(content, {_q(p)}, {g})) AS target FROM l WHERE language = '{lang}'" for lang, p, g in extract.IMPORTS)
_ANY = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


@register(
    "g10_imports",
    f"WITH {CODE}, l AS (SELECT *, {_LANG} AS language FROM code), i AS ({_IMPORTS}) SELECT DISTINCT file_path, language, target, CASE WHEN regexp_matches(target, '^[./]') THEN 'internal_relative' WHEN {_ANY('target', ('http', 'api', 'client'))} THEN 'external' WHEN {_ANY('target', ('service', 'repository', 'model'))} THEN 'cross_layer' ELSE 'internal' END AS class, round(least(1.0, 0.8 + CASE WHEN starts_with(target, '.') THEN 0 ELSE 0.1 END + CASE WHEN language IN ('java', 'csharp') AND contains(target, '.') THEN 0.1 ELSE 0 END)::DOUBLE, 6) AS confidence FROM i WHERE target <> ''",
)
def g10(spark, sf):
    return extract.imports(code(spark, sf)).withColumn("confidence", F.round("confidence", 6))


def _call(kind, p, sep):
    if not sep:
        return f"SELECT file_path, language, '{kind}' AS kind, unnest(regexp_extract_all(content, {_q(p)}, 1)) AS target FROM l"
    return f"SELECT file_path, language, '{kind}', unnest(list_transform(list_zip(regexp_extract_all(content, {_q(p)}, 1), regexp_extract_all(content, {_q(p)}, 2)), lambda z: z[1] || '{sep}' || z[2])) FROM l"


_CALLS = " UNION ".join(f"({_call(*c)})" for c in extract.CALLS)
_CALL_SCORE = "round(least(1.0, 0.6 + CASE WHEN kind IN ('object_method', 'static_call') THEN 0.2 ELSE 0 END + CASE WHEN language IN ('java', 'csharp', 'swift') AND contains(target, '.') THEN 0.1 ELSE 0 END)::DOUBLE, 6)"


@register("g11_calls", f"WITH {CODE}, l AS (SELECT *, {_LANG} AS language FROM code), c(file_path, language, kind, target) AS ({_CALLS}) SELECT file_path, language, kind, target, {_CALL_SCORE} AS confidence FROM c")
def g11(spark, sf):
    return extract.calls(code(spark, sf)).withColumn("confidence", F.round("confidence", 6))


@register("j14_cross_module_calls", f"WITH {CODE}, l AS (SELECT *, {_LANG} AS language FROM code), c(file_path, language, kind, target) AS ({_CALLS}) SELECT file_path, kind, target FROM c WHERE EXISTS (SELECT 1 FROM region WHERE contains(target, 'find_' || r_regionkey))")
def j14(spark, sf):
    names = read(spark, sf, "region").select(F.concat(F.lit("find_"), "r_regionkey").alias("name"))
    return extract.calls(code(spark, sf), names).select("file_path", "kind", "target")


@register("g13_manifests", "SELECT 'conf/part_' || p_partkey || '/package.json' AS file_path, 'lib' || p_size AS name, '1.' || p_partkey AS version FROM part")
def g13(spark, sf):
    return extract.manifest_dependencies(code(spark, sf)).select("file_path", "name", "version")


#: For each kind of manifest its file, a text with {k} for a number, and (name, version) of what it asks for.
_MANIFESTS = (
    ("requirements-dev.txt", "# tools\nlib_{k}==1.{k}\nplain{k}\n  other>=2.0 ; python_version < '3'\n", (("lib_{k}", "1.{k}"), ("plain{k}", ""), ("other", "2.0"))),
    ("go.mod", "module a.b/c\n\ngo 1.21\n\nrequire x.org/m{k} v1.{k}.0\nrequire (\n\tgithub.com/a/b{k} v0.1.0-rc1 // indirect\n)\n", (("x.org/m{k}", "v1.{k}.0"), ("github.com/a/b{k}", "v0.1.0-rc1"))),
    ("Cargo.toml", '[package]\nname = "p{k}"\nversion = "9"\n\n[dependencies]\nserde = "1.{k}"\ntokio-{k} = { version = "0.2", features = ["full"] }\n\n[dev-dependencies]\nrand = { git = "u" }\n', (("serde", "1.{k}"), ("tokio-{k}", "0.2"), ("rand", ""))),
    ("pom.xml", "<project><groupId>own</groupId><dependencies><dependency>\n<groupId>g{k}</groupId>\n<artifactId>a</artifactId><version>3.{k}</version></dependency><dependency><groupId>h</groupId><artifactId>b</artifactId></dependency></dependencies></project>", (("g{k}.a", "3.{k}"), ("h.b", ""))),
    ("packages.config", '<packages>\n<package id="P{k}" version="4.{k}" />\n<package version="1" id="Q" />\n</packages>', (("P{k}", "4.{k}"), ("Q", "1"))),
    ("composer.json", '{"require": {"v/p{k}": "^5"}, "require-dev": {"t/u": "6.{k}"}}', (("v/p{k}", "^5"), ("t/u", "6.{k}"))),
    ("Gemfile", "source 'https://r.org'\ngem 'rails{k}', '~> 7.{k}'\ngem \"puma\"\n", (("rails{k}", "~> 7.{k}"), ("puma", ""))),
    ("Package.swift", 'let p = Package(dependencies: [.package(url: "https://a.b/c{k}.git", from: "8.{k}"), .package(path: "x")])', (("https://a.b/c{k}.git", "8.{k}"),)),
)
_WANTED = " UNION ALL ".join(f"SELECT replace('m/{{k}}/{file}', '{{k}}', n_nationkey::VARCHAR) AS file_path, replace({_q(name)}, '{{k}}', n_nationkey::VARCHAR) AS name, replace({_q(version)}, '{{k}}', n_nationkey::VARCHAR) AS version FROM nation" for file, _, pairs in _MANIFESTS for name, version in pairs)


@register("g13_manifest_kinds", _WANTED)
def g13_kinds(spark, sf):
    from functools import reduce

    n = read(spark, sf, "nation")
    k = F.col("n_nationkey").cast("string")
    parts = [n.select(F.concat(F.lit("m/"), k, F.lit(f"/{file}")).alias("file_path"), F.replace(F.lit(text), F.lit("{k}"), k).alias("content")) for file, text, _ in _MANIFESTS]
    return extract.manifest_dependencies(reduce(lambda a, b: a.unionByName(b), parts)).select("file_path", "name", "version")


_STEM = "regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\\.[^.]*$', '')"
_COMPONENT = f"array_to_string(list_transform(string_split({_STEM}, '_'), lambda w: upper(left(w, 1)) || substring(w, 2)), '')"
_RELATIONS = " UNION ALL ".join(f"SELECT source, unnest(regexp_extract_all(content, {_q('(?im)' + p)}, {g})) AS target, '{family}' AS family, {c}::DOUBLE AS confidence, language, file_path FROM l WHERE language = '{lang}'" for family, lang, p, g, c in extract.RELATIONS)
_FOUND = f"WITH {CODE}, l AS (SELECT *, {_LANG} AS language, {_COMPONENT} AS source FROM code), r AS (SELECT source, target, family, language, file_path, max(confidence) AS confidence FROM ({_RELATIONS}) GROUP BY ALL)"


@register("g17_relations", _FOUND + " SELECT * FROM r")
def g17(spark, sf):
    return extract.relations(code(spark, sf))


@register("g19_component_names", f"WITH {CODE} SELECT file_path, {_COMPONENT} AS component FROM code")
def g19(spark, sf):
    return code(spark, sf).select("file_path", extract.component_name(F.col("file_path")).alias("component"))


@register(
    "g20_synthesis",
    _FOUND + ", u AS (SELECT source, target, family, confidence, 'pattern' AS e FROM r UNION ALL SELECT source, target, family, 0.8, 'graph' FROM r WHERE family = 'import' UNION ALL SELECT source, target, 'event', 0.4, 'vector' FROM r), m AS (SELECT source, target, family, max(confidence) AS c, count(*) AS n FROM u GROUP BY ALL), a AS (SELECT *, CASE WHEN n > 1 THEN least(c + 0.1 * (n - 1), 0.95) ELSE c END AS c1 FROM m), b AS (SELECT *, CASE WHEN family IN ('import', 'inheritance') THEN least(c1 + 0.1, 0.98) ELSE c1 END AS c2 FROM a), d AS (SELECT source, target, family, round(CASE WHEN source <> target THEN least(c2 + 0.05, 0.99) ELSE c2 * 0.9 END, 6) AS confidence FROM b) SELECT * FROM d WHERE confidence >= 0.5",
)
def g20(spark, sf):
    r = extract.relations(code(spark, sf))
    row = lambda d, family, c, e: d.select("source", "target", F.lit(family).alias("family") if family else F.col("family"), (F.lit(c) if c else F.col("confidence")).alias("confidence"), F.array(F.lit(e)).alias("evidence"))
    out = extract.synthesised(row(r, None, None, "pattern"), row(r.where("family = 'import'"), None, 0.8, "graph"), row(r, "event", 0.4, "vector"))
    return out.select("source", "target", "family", F.round("confidence", 6).alias("confidence"))


@register("g22_graph_form", _FOUND + " SELECT DISTINCT name FROM (SELECT source AS name FROM r UNION ALL SELECT target FROM r)")
def g22(spark, sf):
    return extract.graph_form(extract.relations(code(spark, sf)))[0].select("name")


@register("g24_ranked_components", sql("WITH c AS (SELECT DISTINCT name, 'component' AS role, 0.1 AS importance FROM nodes) SELECT role, name, CAST(importance AS DOUBLE) AS importance, CAST(row_number() OVER (ORDER BY name) AS INT) AS place FROM c QUALIFY place <= 5", "nodes"))
def g24(spark, sf):
    return extract.ranked_components(nodes(spark, sf)).select("role", "name", "importance", "place")


@register("g16_graph_of_chunks", "SELECT 'app/service/nation_' || n_nationkey || '.py::Nation' || n_nationkey || '::4' AS source_id, 'core/model/region_' || n_regionkey || '.py::Region' || n_regionkey || '::1' AS target_id, 'inherits' AS type FROM nation")
def g16(spark, sf):
    return extract.graph_of(chunking.code_chunks(code(spark, sf)))[1].where("type = 'inherits'")


@register("c4_python_chunks", "SELECT 'app/service/nation_' || n_nationkey || '.py' AS file_path, 'class' AS chunk_type, 4 AS start_line, 6 AS end_line, 'Nation' || n_nationkey AS class_name, 'os,region_' || n_regionkey || '.Region' || n_regionkey AS imports FROM nation UNION ALL SELECT 'core/model/region_' || r_regionkey || '.py', 'class', 1, 3, 'Region' || r_regionkey, '' FROM region")
def c4(spark, sf):
    c = chunking.code_chunks(code(spark, sf).where("file_path like '%.py'"))
    return c.select("file_path", "chunk_type", "start_line", "end_line", "class_name", F.array_join("imports", ",").alias("imports"))


@register("c5_script_chunks", "SELECT 'web/view/customer_' || c_custkey || '.js' AS file_path, 'function' AS chunk_type, 2 AS start_line, 4 AS end_line, 'show_' || c_custkey AS function_name, './nation_' || c_nationkey AS imports, 'load_' || c_nationkey AS dependencies FROM customer")
def c5(spark, sf):
    c = chunking.code_chunks(code(spark, sf).where("file_path like '%.js'"))
    return c.select("file_path", "chunk_type", "start_line", "end_line", "function_name", F.array_join("imports", ",").alias("imports"), F.array_join("dependencies", ",").alias("dependencies"))


@register("c9_block_chunks", "SELECT 'web/controller/Supplier' || s_suppkey || '.java' AS file_path, 'class' AS chunk_type, 2 AS start_line, 6 AS end_line, 'Supplier' || s_suppkey AS name FROM supplier UNION ALL SELECT 'web/controller/Supplier' || s_suppkey || '.java', 'function', 3, 5, 'run' || s_suppkey FROM supplier")
def c9(spark, sf):
    c = chunking.code_chunks(code(spark, sf).where("file_path like '%.java'"))
    return c.select("file_path", "chunk_type", "start_line", "end_line", F.coalesce("class_name", "function_name").alias("name"))


@register("c10_chunk_dispatch", "SELECT 'class' AS chunk_type, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + (SELECT count(*) FROM supplier) AS n UNION ALL SELECT 'function', (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) UNION ALL SELECT 'small_file', (SELECT count(*) FROM part)")
def c10(spark, sf):
    return chunking.code_chunks(code(spark, sf)).groupBy("chunk_type").agg(F.count("*").alias("n"))


@register("c12_hierarchy", "SELECT 'web/controller/Supplier' || s_suppkey || '.java' AS file_path, unnest(['summary', 'class', 'function']) AS chunk_type, unnest([0, 1, 2]) AS depth, unnest([2, 2, 3]) AS start_line FROM supplier")
def c12(spark, sf):
    return chunking.hierarchy(chunking.code_chunks(code(spark, sf).where("file_path like '%.java'"))).select("file_path", "chunk_type", "depth", "start_line")


@register("c7_config_chunks", "SELECT 'conf/part_' || p_partkey || '/package.json' AS file_path, 'config' AS chunk_type, 1 AS start_line, 2 AS end_line FROM part")
def c7(spark, sf):
    return chunking.config_chunks(code(spark, sf)).select("file_path", "chunk_type", "start_line", "end_line")


_MD = "md AS (SELECT source || '/' || doc_id || '.md' AS file_path, '# Title ' || doc_id || chr(10) || text || chr(10) || '## End' || chr(10) || 'tail' AS content FROM documents)"


@register(
    "c6_markdown_chunks",
    f"WITH {_MD}, l AS (SELECT file_path, i, string_split(content, chr(10))[i] AS line FROM md, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS r(i)), s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{{1,6}}\\s') THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY i) AS section FROM l), p AS (SELECT file_path, CAST(section AS BIGINT) AS section, CAST(min(i) AS INT) AS start_line, CAST(max(i) AS INT) AS end_line, string_agg(line, chr(10) ORDER BY i) AS body FROM s GROUP BY file_path, section) SELECT file_path, section, start_line, end_line, body || coalesce(chr(10) || left(lead(body) OVER (PARTITION BY file_path ORDER BY section), 50), '') AS text FROM p",
)
def c6(spark, sf):
    d = read(spark, sf, "documents")
    md = d.select(F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("file_path"), F.concat(F.lit("# Title "), "doc_id", F.lit("\n"), "text", F.lit("\n## End\ntail")).alias("content"))
    return chunking.markdown_chunks(md).select("file_path", "section", "start_line", "end_line", "text")


@register("s10_legacy_listing", f"WITH {CODE} SELECT file_path FROM code WHERE {_SUFFIX} IN ('py', 'js', 'java')")
def s10(spark, sf):
    return code(spark, sf).where(F.substring(T.extension(F.col("file_path")), 2, 9).isin("py", "js", "java")).select("file_path")


@register("s34_related_files", f"WITH {CODE}, t AS (SELECT * FROM code WHERE file_path LIKE '%model/%') SELECT t.file_path AS target, c.file_path, 'folder' AS why, 0.8::DOUBLE AS score FROM t JOIN code c ON regexp_replace(c.file_path, '/[^/]*$', '') = regexp_replace(t.file_path, '/[^/]*$', '') AND c.file_path <> t.file_path")
def s34(spark, sf):
    c = code(spark, sf)
    return serving.related_files(c, c.where("file_path like '%model/%'"))


@register("s35_structure_report", f"WITH {CODE}, k AS (SELECT split_part(file_path, '/', 1) AS project, CASE WHEN file_path LIKE '%package.json' THEN 'configuration' ELSE 'source' END AS kind, file_path FROM code) SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY project, kind ORDER BY file_path) <= CASE WHEN kind = 'source' THEN 25 ELSE 40 END")
def s35(spark, sf):
    return serving.structure_report(code(spark, sf))


@register("n3_frameworks", f"WITH {CODE} SELECT split_part(file_path, '/', 1) AS project, CASE WHEN file_path LIKE 'conf%' THEN 'node' ELSE 'spring' END AS framework, CASE WHEN file_path LIKE 'conf%' THEN 0.4 ELSE 0.35 END::DOUBLE AS score FROM code WHERE file_path LIKE 'conf%' OR file_path LIKE 'web/controller%' GROUP BY ALL")
def n3(spark, sf):
    signs = spark.createDataFrame([("node", r"package\.json$", 0.4), ("spring", r"/controller/.*\.java$", 0.35), ("django", r"manage\.py$", 0.4), ("small", r"\.js$", 0.1)], "framework string, pattern string, weight double")
    return serving.framework_scores(code(spark, sf), signs)


@register("k15_members", f"WITH {CODE} SELECT file_path, array_to_string(regexp_extract_all(content, CASE WHEN file_path LIKE '%.py' THEN 'def\\s+(\\w+)\\s*\\(' ELSE '(?:public|private|protected)\\s+(?:static\\s+)?[\\w<>\\[\\]]+\\s+(\\w+)\\s*\\(' END, 1), ',') AS methods FROM code WHERE file_path LIKE '%.py' OR file_path LIKE '%.java'")
def k15(spark, sf):
    c = code(spark, sf).where("file_path like '%.py' or file_path like '%.java'")
    return serving.members(c).select("file_path", F.array_join("methods", ",").alias("methods"))


@register("f16_code_snippets", sql("SELECT chunk_id, " + " OR ".join(f"contains(text, '{m}')" for m in serving.SNIPPET_MARKS) + " AS is_code FROM chunks", "chunks"))
def f16(spark, sf):
    return chunks(spark, sf).select("chunk_id", serving.is_snippet(F.col("text")).alias("is_code"))


# Every question of the benchmark, and one of each form about every nation.
_ASKS = ("what calls {}", "dependencies of {}", "subclasses of {}", "find the class {}")
_ROUTES = "CASE " + " ".join(f"WHEN regexp_matches(query, {_q('(?i)' + p)}) THEN '{name}'" for name, p in serving.FORMS) + " ELSE 'search' END"
_ROUTED = "CASE " + " ".join(f"WHEN regexp_matches(query, {_q('(?i)' + p)}) THEN coalesce(" + ", ".join(f"nullif(regexp_extract(query, {_q('(?i)' + p)}, {g + 1}), '')" for g in range(p.count("(\\w+)"))) + ", '')" for _, p in serving.FORMS) + " ELSE '' END"


@register(
    "r13_routed_questions",
    "WITH a AS (SELECT item_id AS query_id, text AS query FROM benchmark UNION ALL " + " UNION ALL ".join(f"SELECT 1000000 + {i} * 1000 + n_nationkey, replace('{ask}', '{{}}', n_name) FROM nation" for i, ask in enumerate(_ASKS)) + f") SELECT query_id, {_ROUTES} AS form, {_ROUTED} AS symbol FROM a",
)
def r13(spark, sf):
    b, n = read(spark, sf, "benchmark"), read(spark, sf, "nation")
    parts = [b.select(F.col("item_id").cast("long").alias("query_id"), F.col("text").alias("query"))]
    for i, ask in enumerate(_ASKS):
        before, after = ask.split("{}")
        parts.append(n.select((F.col("n_nationkey") + 1_000_000 + i * 1000).cast("long").alias("query_id"), F.concat(F.lit(before), "n_name", F.lit(after)).alias("query")))
    return serving.routed(reduce(DataFrame.unionByName, parts))


@register("r12_answered_routes", sql("SELECT CAST(n_nationkey AS BIGINT) AS query_id, 'dependencies' AS form, 'region:' || n_regionkey AS node_id FROM nation UNION ALL SELECT 100 + n_nationkey, 'symbol', 'nation:' || n_nationkey FROM nation", "nodes"))
def r12(spark, sf):
    n = read(spark, sf, "nation")
    routes = n.select(F.col("n_nationkey").cast("long").alias("query_id"), F.lit("dependencies").alias("form"), F.col("n_name").alias("symbol")).unionByName(n.select((F.col("n_nationkey") + 100).cast("long").alias("query_id"), F.lit("symbol").alias("form"), F.lower("n_name").alias("symbol")))
    return serving.answered(routes, nodes(spark, sf), edges(spark, sf), 1)


@register("r8_structural_search", sql("WITH h AS (SELECT * FROM nodes WHERE contains(lower(name), 'nation') OR contains(lower(file_path), 'core/nation') OR contains(lower(type), 'nation')), o AS (SELECT source_id AS node_id, count(*) AS o FROM edges GROUP BY 1), i AS (SELECT target_id AS node_id, count(*) AS i FROM edges GROUP BY 1) SELECT node_id, coalesce(o, 0) AS outgoing, coalesce(i, 0) AS incoming FROM (SELECT * FROM h ORDER BY type, name, node_id LIMIT 50) LEFT JOIN o USING (node_id) LEFT JOIN i USING (node_id)", "nodes", "edges"))
def r8(spark, sf):
    out = serving.structural(nodes(spark, sf), edges(spark, sf), ["nation", "core/nation"])
    return out.select("node_id", F.col("n_outgoing").alias("outgoing"), F.col("n_incoming").alias("incoming"))


@register("r10_symbol_search", sql("(SELECT 'name' AS arm, node_id FROM nodes WHERE contains(lower(name), '0000001') ORDER BY name, node_id LIMIT 5) UNION ALL (SELECT 'path', node_id FROM nodes WHERE contains(lower(file_path), '0000001') ORDER BY name, node_id LIMIT 10)", "nodes"))
def r10(spark, sf):
    return serving.symbol_search(nodes(spark, sf), "0000001")


@register("r11_basic_hybrid", sql(f"WITH v0 AS (SELECT vec_id, embedding FROM embeddings), q AS (SELECT item_id AS query_id, embedding FROM benchmark JOIN v0 ON vec_id = item_id % (SELECT count(*) FROM v0)), n AS (SELECT query_id, v.vec_id, round({_L2}, 9) AS d FROM v0 v, q), t AS (SELECT query_id, vec_id FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) <= 5), s AS (SELECT node_id FROM nodes WHERE contains(lower(name), 'customer') ORDER BY name, node_id LIMIT 5) SELECT query_id, 'vector' AS arm, 'doc:' || vec_id AS id FROM t UNION ALL SELECT query_id, 'symbol', node_id FROM (SELECT DISTINCT query_id FROM t), s", "nodes"))
def r11(spark, sf):
    """Five by vector, then five by name, for each question."""
    from ..operators import vectors

    near = vectors.nearest(read(spark, sf, "embeddings"), _numbered(spark, sf).select("query_id", F.col("query_vector").alias("query")), 5)
    a = near.select("query_id", F.lit("vector").alias("arm"), F.concat(F.lit("doc:"), "vec_id").alias("id"))
    b = serving.symbol_search(nodes(spark, sf), "customer", names=5, paths=0).select("node_id")
    ids = near.select("query_id").distinct()
    return a.unionByName(ids.join(F.broadcast(b)).select("query_id", F.lit("symbol").alias("arm"), F.col("node_id").alias("id")))


_TEXT_SYMBOLS = "WITH t AS (SELECT doc_id AS text_id, unnest(regexp_extract_all(regexp_replace(text, '[A-Za-z0-9_]*[^\\x00-\\x7F][A-Za-z0-9_\\x{80}-\\x{10FFFF}]*', '§', 'g'), '\\b([A-Za-z_][A-Za-z0-9_]{2,})\\b', 1)) AS symbol FROM documents), n AS (SELECT text_id, symbol, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT text_id, symbol, round((CASE WHEN contains('the thing and that', lower(symbol)) THEN 1.0 WHEN len(list_filter(string_split(lower(symbol), '_'), lambda p: length(p) > 2 AND contains('the thing and that', p))) > 0 THEN 0.5 ELSE 0 END + least(n / 10, 1) + CASE WHEN regexp_matches(symbol, '^[A-Z]') THEN 0.2 ELSE 0 END + CASE WHEN contains(symbol, '_') THEN 0.1 ELSE 0 END)::DOUBLE, 6) AS score FROM n) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY score DESC, symbol) <= 10"


@register("r15_context_symbols", _TEXT_SYMBOLS)
def r15(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text", F.lit("the thing and that").alias("query"))
    return serving.scored_symbols(d)


_KINDS = ", ".join("(" + " + ".join(f"CAST(contains(l, '{w}') AS INT)" for w in words) + f") AS {k}" for k, words in intent.KINDS.items())
_GATE = f"WITH {_ASKED}, n AS (SELECT query_id, l, {_KINDS}, len(regexp_extract_all(l, '\\S+')) AS w FROM (SELECT query_id, lower(query) AS l FROM a)), b AS (SELECT query_id, CASE WHEN entity > 0 AND entity >= greatest(architecture, file) THEN 0.6 WHEN architecture > 0 AND architecture >= file THEN 0.8 WHEN file > 0 THEN 0.1 ELSE 0.3 END + 0.2 * (CAST(contains(l, 'call') AS INT) + CAST(contains(l, 'depend') AS INT) + CAST(contains(l, 'inherit') AS INT) + CAST(contains(l, 'import') AS INT) + CAST(contains(l, 'relationship') AS INT) + CAST(contains(l, 'use') AS INT)) + 0.3 * (CAST(regexp_matches(l, 'what\\s+calls') AS INT) + CAST(regexp_matches(l, 'depends?\\s+on') AS INT) + CAST(regexp_matches(l, 'how\\s+does\\s+.*\\s+work') AS INT)) + 0.1 + CASE WHEN w > 5 THEN least((w - 5) * 0.05, 0.2) ELSE 0 END AS s FROM n) SELECT query_id, round(least(1.0, s)::DOUBLE, 6) AS benefit, least(1.0, s) >= 0.5 AS expand FROM b"


@register("r16_graph_gate", _GATE)
def r16(spark, sf):
    return asked(spark, sf).select("query_id", F.round(intent.graph_benefit(F.col("query"), F.lit(1)), 6).alias("benefit"), (intent.graph_benefit(F.col("query"), F.lit(1)) >= 0.5).alias("expand"))


_KEY_TERMS = (
    "regexp_extract_all(query, '\"([^\"]+)\"', 1) || regexp_extract_all(" + _PLAIN + ", '\\b([A-Za-z]+(?:_[A-Za-z0-9]+)+|[A-Z][a-z0-9]+[A-Z][A-Za-z0-9]*|[a-z]+[A-Z][A-Za-z0-9]*)\\b', 1) || regexp_extract_all(" + MASKED.format("query") + ", '\\b([a-z]{4,})\\b', 1)"
)


@register("r22_key_terms", f"WITH {_ASKED}, k AS (SELECT query_id, {_KEY_TERMS} AS l FROM a) SELECT query_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS terms FROM k")
def r22(spark, sf):
    return asked(spark, sf).select("query_id", F.array_join(serving.key_terms(F.col("query")), " ").alias("terms"))


@register("r19_entities", "SELECT 'db/' || r_regionkey || '.sql' AS file_path, 'sql' AS framework, 1.0::DOUBLE AS confidence FROM region UNION ALL SELECT 'db/' || n_nationkey || '.py', 'sqlalchemy', 0.9 FROM nation")
def r19(spark, sf):
    tables = read(spark, sf, "region").select(F.concat(F.lit("db/"), "r_regionkey", F.lit(".sql")).alias("file_path"), F.concat(F.lit("CREATE TABLE r"), "r_regionkey", F.lit(" (id int PRIMARY KEY)")).alias("content"))
    models = read(spark, sf, "nation").select(F.concat(F.lit("db/"), "n_nationkey", F.lit(".py")).alias("file_path"), F.lit("class N(Base):\n    __tablename__ = 'n'\n").alias("content"))
    return serving.entities(tables.unionByName(models).unionByName(code(spark, sf))).withColumn("confidence", F.round("confidence", 6))


@register("r27_change_impact", f"WITH {CODE}, c AS (SELECT file_path, len(regexp_extract_all(content, '(?m)^\\s*(?:public|def|class|function|export)\\b')) AS n FROM code) SELECT file_path, CAST(n AS INT) AS n, CASE WHEN n > 10 THEN 'high' WHEN n > 3 THEN 'medium' ELSE 'low' END AS impact FROM c")
def r27(spark, sf):
    n = F.regexp_count("content", F.lit(r"(?m)^\s*(?:public|def|class|function|export)\b"))
    return code(spark, sf).select("file_path", n.alias("n"), F.when(n > 10, "high").when(n > 3, "medium").otherwise("low").alias("impact"))


@register("n2_resolved_paths", sql("SELECT file_path AS input, file_path FROM files WHERE doc_id % 2 = 0 UNION ALL SELECT '@' || file_path, file_path FROM files WHERE doc_id % 2 = 1 UNION ALL SELECT lang || '/' || doc_id || '.txt', source || '/' || lang || '/' || doc_id || '.txt' FROM documents", "files"))
def n2(spark, sf):
    f = files(spark, sf)
    d = read(spark, sf, "documents").select(F.concat_ws("/", "lang", F.concat(F.col("doc_id"), F.lit(".txt"))).alias("input"))
    inputs = f.where("doc_id % 2 = 0").select(F.col("file_path").alias("input")).unionByName(f.where("doc_id % 2 = 1").select(F.concat(F.lit("@"), "file_path").alias("input"))).unionByName(d)
    return serving.resolved_paths(inputs, f, "src3")


@register("a5_distinct_projects", sql("SELECT DISTINCT split_part(file_path, '/', 1) AS project FROM nodes ORDER BY project LIMIT 10", "nodes"))
def a5(spark, sf):
    return nodes(spark, sf).select(T.project_of(F.col("file_path")).alias("project")).distinct().orderBy("project").limit(10)


@register("a4_path_styles", sql("SELECT count(*) FILTER (WHERE file_path LIKE 'core/%') AS core, count(*) FILTER (WHERE file_path LIKE '%.py') AS python, count(*) FILTER (WHERE NOT contains(file_path, '/')) AS bare FROM nodes", "nodes"))
def a4(spark, sf):
    return nodes(spark, sf).agg(F.count_if(F.startswith("file_path", F.lit("core/"))).alias("core"), F.count_if(F.endswith("file_path", F.lit(".py"))).alias("python"), F.count_if(~F.contains("file_path", F.lit("/"))).alias("bare"))


@register("a7_method_counts", sql("SELECT file_path, count(*) AS methods FROM nodes WHERE type = 'method' GROUP BY file_path", "nodes"))
def a7(spark, sf):
    return nodes(spark, sf).where("type = 'method'").groupBy("file_path").agg(F.count("*").alias("methods"))


@register("a8_nodes_per_project", sql("SELECT split_part(file_path, '/', 1) AS project, count(*) AS n FROM nodes GROUP BY ALL", "nodes"))
def a8(spark, sf):
    return nodes(spark, sf).groupBy(T.project_of(F.col("file_path")).alias("project")).agg(F.count("*").alias("n"))


@register("a14_chunk_distribution", sql("SELECT project, count(*) AS chunks, count(DISTINCT file_path) AS files FROM chunks GROUP BY project", "chunks"))
def a14(spark, sf):
    return chunks(spark, sf).groupBy("project").agg(F.count("*").alias("chunks"), F.countDistinct("file_path").alias("files"))


@register("a15_complexity_stats", sql("WITH c AS (SELECT project, least((length(content) - length(replace(content, chr(10), '')) + 1) / 100.0, 1.0) AS c FROM files) SELECT project, round(avg(c)::DOUBLE, 6) AS mean, max(c)::DOUBLE AS most, count(*) FILTER (WHERE c > 0.7) AS complex FROM c GROUP BY project", "files"))
def a15(spark, sf):
    f = files(spark, sf).select("project", chunking.complexity(F.size(F.split("content", "\n"))).alias("c"))
    return f.groupBy("project").agg(F.round(F.avg("c"), 6).alias("mean"), F.max("c").alias("most"), F.count_if(F.col("c") > 0.7).alias("complex"))


@register("a17_model_comparison", "SELECT c.category, m AS metric, 0.0::DOUBLE AS change FROM (SELECT '0' AS category UNION ALL SELECT '1' UNION ALL SELECT '2' UNION ALL SELECT 'overall') c, (SELECT unnest(['p3', 'p5', 'p10', 'r10', 'mrr']) AS m)")
def a17(spark, sf):
    from .queries_search import _evaluated

    s = evaluate.summary(_evaluated(spark, sf))
    return evaluate.compared(s, s).select("category", "metric", "change")


@register("a23_intent_distribution", f"WITH {_ASKED}, {_SIGNALS}, {_INTENT} SELECT ['specific_symbol', 'conceptual', 'structural', 'debugging', 'exploratory'][k] AS intent, count(*) AS n, round(avg(conf)::DOUBLE, 6) AS mean FROM h GROUP BY k")
def a23(spark, sf):
    return intent.classified(asked(spark, sf)).groupBy("intent").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"))


@register("a25_merged_relations", "SELECT l_orderkey AS source, l_partkey AS target, max(l_discount) AS confidence, count(*) AS n FROM lineitem GROUP BY ALL")
def a25(spark, sf):
    return read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target")).agg(F.max("l_discount").alias("confidence"), F.count("*").alias("n"))


@register("a26_index_coverage", sql("WITH f AS (SELECT project, count(DISTINCT file_path) AS files FROM files GROUP BY project), c AS (SELECT project, count(*) AS chunks FROM chunks GROUP BY project) SELECT project, files, coalesce(chunks, 0) AS chunks, CASE WHEN files < 3 THEN 'skip' WHEN coalesce(chunks, 0) < greatest(5, files // 10) THEN 'index' ELSE 'ready' END AS verdict FROM f LEFT JOIN c USING (project)", "files", "chunks"))
def a26(spark, sf):
    return serving.coverage(files(spark, sf), chunks(spark, sf))


@register("a27_role_groups", f"WITH {CODE}, r AS (SELECT file_path, CASE {' '.join('WHEN ' + _ANY('lower(file_path)', words) + f' THEN {_q(role)}' for role, words in extract.ROLES)} ELSE 'component' END AS role FROM code) SELECT role, file_path, count(*) OVER (PARTITION BY role) AS members FROM r")
def a27(spark, sf):
    r = code(spark, sf).select(extract.role(F.col("file_path")).alias("role"), "file_path")
    return r.join(r.groupBy("role").agg(F.count("*").alias("members")), "role").select("role", "file_path", "members")


@register("a28_session_stats", "SELECT user_id, count(*) AS n, round(100.0 * count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS failed FROM events GROUP BY user_id")
def a28(spark, sf):
    return read(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(F.col("event_type") == "error") / F.count("*"), 6).alias("failed"))


@register("w2_first_per_key", "SELECT event_type, user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def w2(spark, sf):
    return serving.kept_first(read(spark, sf, "events"), ["event_type", "user_id"], [F.col("ts"), F.col("event_id")]).select("event_type", "user_id", "event_id")


@register("w6_merged_chunks")
def w6(spark, sf):
    f = files(spark, sf).select("doc_id", "file_path", F.col("content").alias("text"))
    return context.merged_neighbours(chunking.lined_chunks(f).withColumn("score", F.lit(1.0)))


@register("w8_hit_groups", sql("WITH l AS (SELECT file_path, i, regexp_matches(string_split(content, chr(10))[i], '[0-9]{3}') AS hit FROM files, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS r(i)), h AS (SELECT file_path, i, i - row_number() OVER (PARTITION BY file_path ORDER BY i) AS g FROM l WHERE hit) SELECT file_path, CAST(min(i) AS INT) AS first_line, CAST(max(i) AS INT) AS last_line FROM h GROUP BY file_path, g", "files"))
def w8(spark, sf):
    from pyspark.sql import Window as W

    hits = chunking.lines(files(spark, sf).select("file_path", "content")).where(F.col("line").rlike("[0-9]{3}"))
    g = F.col("line_no") - F.row_number().over(W.partitionBy("file_path").orderBy("line_no"))
    return hits.withColumn("g", g).groupBy("file_path", "g").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line")).drop("g")


@register("j3_call_flow", sql("SELECT DISTINCT a.source_id AS start_id, b.target_id AS node_id, 2 AS depth FROM transitions a JOIN transitions b ON b.source_id = a.target_id UNION SELECT source_id, target_id, 1 FROM transitions", "transitions"))
def j3(spark, sf):
    t = transitions(spark, sf)
    return graph.walk(t, t.select(F.col("source_id").alias("node_id")), 2).select("start_id", "node_id", "depth").distinct()


@register("j19_level_edges", sql("WITH w AS (SELECT DISTINCT source_id AS s, target_id AS n, 1 AS d FROM transitions UNION SELECT DISTINCT a.source_id, b.target_id, 2 FROM transitions a JOIN transitions b ON b.source_id = a.target_id) SELECT x.s AS start_id, x.n AS source_id, y.n AS target_id FROM w x JOIN w y ON x.s = y.s AND y.d = x.d + 1 JOIN transitions t ON t.source_id = x.n AND t.target_id = y.n", "transitions"))
def j19(spark, sf):
    """Edges between one level and the next: those that exist, not every pair."""
    t = transitions(spark, sf)
    w = graph.walk(t, t.select(F.col("source_id").alias("node_id")), 2).select("start_id", "node_id", "depth").distinct()
    a, b = w.select("start_id", F.col("node_id").alias("source_id"), F.col("depth").alias("d")), w.select("start_id", F.col("node_id").alias("target_id"), (F.col("depth") - 1).alias("d"))
    return a.join(t.select("source_id", "target_id"), "source_id").join(b, ["start_id", "target_id", "d"]).select("start_id", "source_id", "target_id")


@register("k1_find_symbol", sql("SELECT node_id FROM nodes WHERE name = 'order_77'", "nodes"))
def k1(spark, sf):
    return graph.by_name(nodes(spark, sf), "order_77").select("node_id")


@register("k2_callers_by_name", sql("SELECT 'orders:' || o_orderkey AS node_id FROM orders WHERE o_custkey = 12", "nodes"))
def k2(spark, sf):
    n = nodes(spark, sf)
    target = n.where("node_id = 'customer:12'").select("name")
    return graph.callers(edges(spark, sf), n.join(target, "name", "left_semi"), 3).select("node_id")


@register("k12_file_relations", sql("SELECT a.file_path, e.type, count(*) AS n, count(DISTINCT b.file_path) AS files FROM edges e JOIN nodes a ON a.node_id = source_id JOIN nodes b ON b.node_id = target_id GROUP BY ALL", "nodes", "edges"))
def k12(spark, sf):
    n = nodes(spark, sf)
    e = edges(spark, sf).join(n.select(F.col("node_id").alias("source_id"), "file_path"), "source_id").join(n.select(F.col("node_id").alias("target_id"), F.col("file_path").alias("other")), "target_id")
    return e.groupBy("file_path", "type").agg(F.count("*").alias("n"), F.countDistinct("other").alias("files"))


@register("k17_code_lens", sql("WITH c AS (SELECT target_id AS node_id, count(*) AS n FROM edges WHERE type = 'calls' GROUP BY 1) SELECT line_start AS line, name, 'called ' || coalesce(n, 0) || ' times' AS note FROM nodes LEFT JOIN c USING (node_id) WHERE file_path = 'app/customer/3.py'", "nodes", "edges"))
def k17(spark, sf):
    return serving.code_lens(nodes(spark, sf), edges(spark, sf), "app/customer/3.py")


@register("k18_callers_by_file", sql("SELECT a.file_path, count(DISTINCT a.node_id) AS callers FROM edges e JOIN nodes a ON a.node_id = source_id WHERE e.type = 'calls' GROUP BY a.file_path", "nodes", "edges"))
def k18(spark, sf):
    e = edges(spark, sf).where("type = 'calls'").select(F.col("source_id").alias("node_id")).distinct()
    return nodes(spark, sf).join(e, "node_id").groupBy("file_path").agg(F.count("*").alias("callers"))


@register("n7_file_examination", sql("SELECT file_path, count(*) AS symbols, string_agg(DISTINCT type, ',' ORDER BY type) AS types, max(line_end) AS last_line FROM nodes GROUP BY file_path", "nodes"))
def n7(spark, sf):
    return nodes(spark, sf).groupBy("file_path").agg(F.count("*").alias("symbols"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"), F.max("line_end").alias("last_line"))


@register("x5_contradictions", "WITH r AS (SELECT event_type AS tool, event_id AS seq, value < 20 AS no FROM events) SELECT tool, seq FROM r QUALIFY no <> lag(no) OVER (PARTITION BY tool ORDER BY seq)")
def x5(spark, sf):
    r = read(spark, sf, "events").select(F.col("event_type").alias("tool"), F.col("event_id").alias("seq"), F.when(F.col("value") < 20, "not found").otherwise("found it").alias("result"))
    return serving.contradictions(r)


@register("x6_risk_bands", sql("SELECT target_id, CASE WHEN count(*) > 10 THEN 'high' WHEN count(*) > 5 THEN 'medium' ELSE 'low' END AS risk FROM edges GROUP BY target_id", "edges"))
def x6(spark, sf):
    n = edges(spark, sf).groupBy("target_id").count()
    return n.select("target_id", F.when(F.col("count") > 10, "high").when(F.col("count") > 5, "medium").otherwise("low").alias("risk"))


@register("x8_pipe_tables", "WITH l AS (SELECT doc_id AS text_id, i, length(regexp_replace(string_split(text, chr(10))[i], '[^|]', '', 'g')) >= 2 AS t FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS r(i)), g AS (SELECT text_id, i, i - row_number() OVER (PARTITION BY text_id ORDER BY i) AS g FROM l WHERE t) SELECT text_id, CAST(min(i) AS INT) AS first_line, count(*) AS rows FROM g GROUP BY text_id, g HAVING count(*) >= 2")
def x8(spark, sf):
    return serving.pipe_tables(_texts(spark, sf)).select("text_id", "first_line", "rows")


def _texts(spark, sf):
    return read(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text")


_TABLES = "l AS (SELECT doc_id AS text_id, i, string_split(text, chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS r(i)), t AS (SELECT text_id, i, line, i - row_number() OVER (PARTITION BY text_id ORDER BY i) AS g FROM l WHERE length(regexp_replace(line, '[^|]', '', 'g')) >= 2), f AS (SELECT text_id, min(i) AS first_line, count(*) AS rows, arg_min(len(list_filter(string_split(line, '|'), lambda c: trim(c) <> '')), i) AS columns FROM t GROUP BY text_id, g HAVING count(*) >= 2), h AS (SELECT text_id, arg_min(columns, first_line) AS c, arg_min(rows, first_line) - 1 + text_id % 3 AS r FROM f GROUP BY text_id), s AS (SELECT text_id, first_line, rows, (3 + CASE WHEN columns = c THEN 4 ELSE 0 END + CASE WHEN rows - 1 = r THEN 3 ELSE 0 END) / 10 AS likeness FROM f JOIN h USING (text_id))"


def _repeated(spark, sf):
    t = _texts(spark, sf)
    found = serving.pipe_tables(t)
    # A text's structured table is its first one, with none to two rows more.
    shown = found.groupBy("text_id").agg(F.min_by("columns", "first_line").alias("columns"), (F.min_by("rows", "first_line") - 1 + F.col("text_id") % 3).alias("rows"))
    return t, serving.repeated_tables(found, shown)


@register("x8_repeated_tables", f"WITH {_TABLES} SELECT text_id, CAST(first_line AS INT) AS first_line, rows, likeness FROM s WHERE likeness >= 0.7")
def x8_repeated(spark, sf):
    return _repeated(spark, sf)[1]


@register("x8_tables_removed", f"WITH {_TABLES}, m AS (SELECT * FROM s WHERE likeness >= 0.7), k AS (SELECT l.* FROM l WHERE text_id IN (SELECT text_id FROM m) AND NOT EXISTS (SELECT 1 FROM m WHERE m.text_id = l.text_id AND l.i >= first_line AND l.i < first_line + rows)), j AS (SELECT text_id, string_agg(line, chr(10) ORDER BY i) AS t FROM k GROUP BY text_id) SELECT doc_id AS text_id, md5(CASE WHEN doc_id IN (SELECT text_id FROM m) THEN regexp_replace(regexp_replace(coalesce(t, ''), '(?m)^([ \\t]*)\\n(?:[ \\t]*(?:\\n|\\z))+', '\\1' || chr(10), 'g'), '\\s*\\z', '') ELSE text END) AS digest FROM documents LEFT JOIN j ON j.text_id = doc_id")
def x8_removed(spark, sf):
    return serving.without_tables(*_repeated(spark, sf)).select("text_id", F.md5("text").alias("digest"))


@register("x9_source_priority", "SELECT conv_id, arg_min(role, (CASE role WHEN 'assistant' THEN 1 WHEN 'user' THEN 2 ELSE 3 END, turn)) AS role FROM conversations GROUP BY conv_id")
def x9(spark, sf):
    rank = F.when(F.col("role") == "assistant", 1).when(F.col("role") == "user", 2).otherwise(3)
    return serving.kept_first(read(spark, sf, "conversations"), ["conv_id"], [rank, F.col("turn")]).select("conv_id", "role")


@register("t9_once_per_query", "SELECT DISTINCT user_id, event_type FROM events")
def t9(spark, sf):
    return read(spark, sf, "events").dropDuplicates(["user_id", "event_type"]).select("user_id", "event_type")


@register("t3_oldest_evicted", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) > ceil(count(*) OVER (PARTITION BY event_type) * 0.1)")
def t3(spark, sf):
    return metrics.after_eviction(read(spark, sf, "events"), "event_type", ("ts", "event_id")).select("event_id")


_BONUS = "CASE relation " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in context.BONUS.items()) + " ELSE 0.05 END"
_SYMBOL_SCORE = "(CASE WHEN contains(q, lower(symbol)) THEN 1.0 WHEN len(list_filter(string_split(lower(symbol), '_'), lambda p: length(p) > 2 AND contains(q, p))) > 0 THEN 0.5 ELSE 0 END + least(n / 10, 1) + CASE WHEN regexp_matches(symbol, '^[A-Z]') THEN 0.2 ELSE 0 END + CASE WHEN contains(symbol, '_') THEN 0.1 ELSE 0 END)::DOUBLE"
_FILES = "docs AS (SELECT ('0x' || left(md5(file_path), 12))::BIGINT AS doc_id, file_path, content AS text FROM code)"
_WHERE = "qs AS (SELECT CAST(n_nationkey AS BIGINT) AS query_id, 'where is Nation' || n_nationkey || ' loaded by load_' || n_nationkey AS query FROM nation)"


@register(
    "r14_graph_expansion",
    f"WITH {CODE}, {_FILES}, {_INDEX}, {_WHERE}, {_SCORES}, {_KNOWN_SQL.replace('s AS (', 'sm AS (', 1).replace('FROM s WHERE', 'FROM sm WHERE')}, rf AS ({_REFS}), "
    "eg AS (SELECT DISTINCT o.node_id AS source_id, t.node_id AS target_id, rf.type FROM rf JOIN known t USING (name) JOIN known o ON o.file_path = rf.file_path WHERE o.node_id <> t.node_id), "
    "tp AS (SELECT query_id, doc_id FROM sc WHERE round(score, 9) >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 3), "
    "tx AS (SELECT query_id, doc_id, lower(query) AS q, unnest(regexp_extract_all(text, '\\b([A-Za-z_][A-Za-z0-9_]{2,})\\b', 1)) AS symbol FROM tp JOIN docs USING (doc_id) JOIN qs USING (query_id)), "
    f"ts AS (SELECT query_id, doc_id, symbol FROM (SELECT query_id, doc_id, q, symbol, count(*) AS n FROM tx GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY {_SYMBOL_SCORE} DESC, symbol) <= 10), "
    "st AS (SELECT DISTINCT query_id, node_id FROM ts JOIN known ON name = symbol), "
    f"re AS (SELECT node_id AS start_id, node_id, 'self' AS relation, 0 AS depth FROM (SELECT DISTINCT node_id FROM st) UNION ALL SELECT DISTINCT source_id, target_id, type, 1 FROM eg WHERE source_id IN (SELECT node_id FROM st) AND type IN {graph.DEPENDENCIES} UNION ALL SELECT DISTINCT target_id, source_id, type, 1 FROM eg WHERE target_id IN (SELECT node_id FROM st) AND type = 'calls'), "
    "rw AS (SELECT st.query_id, re.node_id, relation, depth, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS w, list_distinct(regexp_extract_all(lower(k.name || ' ' || k.file_path), '[a-z0-9]+')) AS h FROM st JOIN re ON st.node_id = re.start_id JOIN known k ON k.node_id = re.node_id JOIN qs USING (query_id)), "
    f"sr AS (SELECT query_id, node_id, relation, depth, round(greatest(0, least(1, 0.5 + len(list_intersect(w, h)) / greatest(len(w), 1) + {_BONUS} - 0.1 * depth))::DOUBLE * CASE WHEN relation = 'self' THEN 1.0 ELSE 1.05 END, 9) AS score FROM rw), "
    "be AS (SELECT * FROM sr QUALIFY row_number() OVER (PARTITION BY query_id, node_id ORDER BY score DESC, depth, relation) = 1), "
    "ra AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM be) "
    "SELECT query_id, CAST(rank AS INT) AS rank, ra.node_id, relation, depth, round(score, 6) AS score, md5(content) AS digest FROM ra JOIN known k ON k.node_id = ra.node_id JOIN code ON code.file_path = k.file_path WHERE rank <= 10",
)
def r14(spark, sf):
    """Questions about every nation's class, over the files of the small code base and the graph of their symbols."""
    files = written(code(spark, sf))
    nodes_ = written(_known_of(files))
    edges_ = written(extract.references(files, nodes_))
    docs = files.select(F.conv(F.left(F.md5("file_path"), F.lit(12)), 16, 10).cast("long").alias("doc_id"), "file_path", F.col("content").alias("text"))
    path = scratch(spark)
    bm25.build(docs).save(path)
    questions = read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat(F.lit("where is Nation"), "n_nationkey", F.lit(" loaded by load_"), "n_nationkey").alias("query"))
    out = context.retrieved_and_expanded(bm25.Index.load(spark, path), files, nodes_, edges_, questions)
    return out.select("query_id", "rank", "node_id", "relation", "depth", F.round("score", 6).alias("score"), F.md5("text").alias("digest"))

"""Queries over source of languages with braces, nested, commented and quoted, written out of the driver's keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import related, scopes
from ..sources.sinks import written
from .queries_code import _IMPORTS, _LANG, CODE, _fill, _parts, code
from .registry import register
from .tables import read, spread

_JAVA = """package web.shop;
import java.util.List;
import core.model.Nation{p};
// class Fake{k} {{ void no() {{ }} }}
/* interface Wrong {{
 */
public class Supplier{k}<T> extends Base implements Runnable {{
    private static final String TEXT = "class Quoted {{";
    Map<String, List<Integer>> byName = new HashMap<>();
    public Supplier{k}(int x) {{ this.n = x; }}
    @Override
    public void run{k}() throws IOException, Error {{
        for (int i = 0; i < {k}; i++) {{ go(i); }}
        Runnable r = new Runnable() {{ public void run() {{ x('}}'); }} }};
    }}
    static class Inner{k} {{
        int deep{p}(List<String> a, int b) {{ return 1; }}
        enum Color {{ RED, GREEN }}
    }}
}}
"""
_SCRIPT = """import x, {{ y }} from './nation_{p}';
export const LIMIT = {k};
export async function load_{k}(a: number): Promise<void> {{
  const s = `text ${{a > 1 ? `in {{ ${{a}}` : "}}"}} class No {{`;
  return call(() => {{ go(); }});
}}
const add_{k} = (a, b) => {{ return a + b; }};
const old = function (a) {{ return /[{{}}/]/.test(a); }};
class View{k} extends Base {{
  title = 'class Z {{';
  async draw_{p}(a) {{ if (a) {{ b(); }} }}
}}
interface Shape{k} {{ area(): number; }}
"""
_GO = """package main
import "fmt"
import (
    "os"
    x "net/part_{p}"
)
const Limit = {k}
var total int
type Server{k} struct {{
    Addr string
}}
func (s *Server{k}) Run{k}(a int, f func(int) error) (int, error) {{
    // func fake() {{
    go func() {{ fmt.Println("}}") }}()
    raw := `func no() {{`
    return {k}, nil
}}
func main() {{ Run{k}() }}
"""
_CSHARP = """using System;
using Core.Region{p};
namespace A.B {{
  public class Nation{k} : Region{p} {{
    private readonly string path = @"c:\\{{x";
    public Nation{k}(int k) : base(k) {{ }}
    public async Task<int> Load{k}(int x) {{
      using (var f = Open(x)) {{ foreach (var y in f) {{ go(y); }} }}
      return $"{{x}} class".Length;
    }}
    struct Point{k} {{ int x; }}
  }}
}}
"""

#: table, key, parent's key, path, text, and what is in it: name, kind of node, first and last line, what is round it.
_SOURCES = (
    ("supplier", "s_suppkey", "s_nationkey", "web/shop/Supplier{k}.java", _JAVA, (
        ("java.util.List", "import_statement", 2, 2, None), ("core.model.Nation{p}", "import_statement", 3, 3, None), ("Supplier{k}", "class_declaration", 7, 20, None),
        ("TEXT", "field_declaration", 8, 8, "Supplier{k}"), ("byName", "field_declaration", 9, 9, "Supplier{k}"), ("Supplier{k}", "constructor_declaration", 10, 10, "Supplier{k}"),
        ("run{k}", "method_declaration", 11, 15, "Supplier{k}"), ("Inner{k}", "class_declaration", 16, 19, "Supplier{k}"),
        ("deep{p}", "method_declaration", 17, 17, "Supplier{k}.Inner{k}"), ("Color", "enum_declaration", 18, 18, "Supplier{k}.Inner{k}"),
    )),
    ("customer", "c_custkey", "c_nationkey", "web/view/customer_{k}.ts", _SCRIPT, (
        ("./nation_{p}", "import_statement", 1, 1, None), ("LIMIT", "variable_declaration", 2, 2, None), ("LIMIT", "export_statement", 2, 2, None),
        ("load_{k}", "function_declaration", 3, 6, None), ("load_{k}", "export_statement", 3, 3, None), ("add_{k}", "arrow_function", 7, 7, None), ("old", "function_expression", 8, 8, None),
        ("View{k}", "class_declaration", 9, 12, None), ("draw_{p}", "method_definition", 11, 11, "View{k}"), ("Shape{k}", "interface_declaration", 13, 13, None),
    )),
    ("part", "p_partkey", "p_size", "jobs/part_{k}.go", _GO, (
        ("fmt", "import_statement", 2, 2, None), ("os", "import_statement", 3, 6, None), ("net/part_{p}", "import_statement", 3, 6, None), ("Limit", "const_declaration", 7, 7, None),
        ("total", "var_declaration", 8, 8, None), ("Server{k}", "type_declaration", 9, 11, None), ("Run{k}", "method_declaration", 12, 17, None), ("main", "function_declaration", 18, 18, None),
    )),
    ("nation", "n_nationkey", "n_regionkey", "core/Nation{k}.cs", _CSHARP, (
        ("System", "import_statement", 1, 1, None), ("Core.Region{p}", "import_statement", 2, 2, None), ("Nation{k}", "class_declaration", 4, 12, None), ("path", "field_declaration", 5, 5, "Nation{k}"),
        ("Nation{k}", "constructor_declaration", 6, 6, "Nation{k}"), ("Load{k}", "method_declaration", 7, 10, "Nation{k}"), ("Point{k}", "struct_specifier", 11, 11, "Nation{k}"),
    )),
)


def sources(spark, sf) -> DataFrame:
    """file_path, content."""

    def one(table, key, parent, path, text, _):
        fill = lambda s: F.concat(*[F.col(key) if p == "\0k" else F.col(parent) if p == "\0p" else F.lit(p) for p in _parts(s)])
        return spread(read(spark, sf, table).select(key, parent)).select(fill(path).alias("file_path"), fill(text).alias("content"))

    return reduce(DataFrame.unionByName, [one(*s) for s in _SOURCES])


def _expected() -> str:
    rows = []
    for table, key, parent, path, _, found in _SOURCES:
        fill = lambda s: "NULL" if s is None else _fill(s, key, parent)  # noqa: B023, E731
        rows += [f"SELECT {fill(path)} AS file_path, {fill(name)} AS name, '{kind}' AS node_type, {first} AS line_start, {last} AS line_end, {fill(scope)} AS parent FROM {table}" for name, kind, first, last, scope in found]
    return "found AS (" + " UNION ALL ".join(rows) + ")"


_TYPE = "CASE node_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in scopes.SYMBOL_TYPES.items()) + " ELSE 'unknown' END"


@register("g1_scoped_symbols", f"WITH {_expected()} SELECT file_path, name, {_TYPE} AS type, node_type, CAST(line_start AS INT) AS line_start, CAST(line_end AS INT) AS line_end, parent FROM found")
def g1_scoped(spark, sf):
    return scopes.scoped_symbols(sources(spark, sf)).select("file_path", "name", "type", "node_type", "line_start", "line_end", "parent")


_KIND = f"CASE WHEN {_TYPE} IN ('function', 'method') THEN 'function' WHEN {_TYPE} IN ('class', 'interface', 'struct', 'enum', 'type') THEN 'class' WHEN {_TYPE} = 'import' THEN 'import' END"


@register("c9_scope_chunks", f"WITH {_expected()} SELECT file_path, {_KIND} AS chunk_type, name, parent, CAST(line_start AS INT) AS start_line, CAST(line_end AS INT) AS end_line FROM found WHERE {_KIND} IS NOT NULL")
def c9_scoped(spark, sf):
    return scopes.scope_chunks(sources(spark, sf)).select("file_path", "chunk_type", "name", "parent", "start_line", "end_line")


@register("g1_symbol_types", f"WITH {_expected()} SELECT {_TYPE} AS type, count(*) AS n, count(DISTINCT file_path) AS files, count(*) FILTER (WHERE parent IS NOT NULL) AS nested FROM found GROUP BY ALL")
def g1_types(spark, sf):
    return scopes.scoped_symbols(sources(spark, sf)).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("files"), F.count_if(F.col("parent").isNotNull()).alias("nested"))


#: Tests and configuration beside the code base: table, path and text; {k} and {p} as there.
_BESIDE = (
    ("nation", "n_nationkey", "n_regionkey", "tests/test_nation_{k}.py", "from nation_{k} import Nation{k}\nimport region_{p}\n"),
    ("region", "r_regionkey", "r_regionkey", "core/model/region_{k}_test.py", "import app.service.nation_{k}\n"),
    ("region", "r_regionkey", "r_regionkey", "core/settings_{k}.ini", "[models]\nfirst = region_{k}\nview = customer_{k}, nation_{k}\n"),
    ("customer", "c_custkey", "c_nationkey", "web/view/customer_{k}.spec.js", "import x from './customer_{k}';\n"),
    ("nation", "n_nationkey", "n_regionkey", "app/service/config_{k}.py", "import os\n"),
)


def with_tests(spark, sf) -> DataFrame:
    """The small code base with tests and configuration."""

    def one(table, key, parent, path, text):
        fill = lambda s: F.concat(*[F.col(key) if p == "\0k" else F.col(parent) if p == "\0p" else F.lit(p) for p in _parts(s)])
        return read(spark, sf, table).select(fill(path).alias("file_path"), fill(text).alias("content"))

    # One table instead of ten, as every pattern reads it.
    return written(reduce(DataFrame.unionByName, [code(spark, sf), *[one(*b) for b in _BESIDE]]))


_ALL = "al AS (SELECT * FROM code UNION ALL " + " UNION ALL ".join(f"SELECT {_fill(path, k, p)} AS file_path, {_fill(text, k, p)} AS content FROM {t}" for t, k, p, path, text in _BESIDE) + ")"
_STEM = "regexp_replace(regexp_extract({0}, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1')"
_FOLDER = "regexp_replace({0}, '/?[^/]*$', '')"
_MARK = related.TEST_MARK
_IMPORTED = f"""WITH {CODE}, {_ALL}, l AS (SELECT *, {_LANG} AS language FROM al), i AS ({_IMPORTS}),
sx AS (SELECT file_path, array_to_string(p[k:], '/') AS suffix FROM (SELECT file_path, string_split(regexp_replace(file_path, '\\.[^./]*$', ''), '/') AS p FROM al), unnest(range(1, len(p) + 1)) AS r(k)),
ix AS (SELECT suffix, min(file_path) AS target FROM sx GROUP BY suffix HAVING count(*) = 1),
im AS (SELECT DISTINCT file_path, target AS name, CASE WHEN language IN ('javascript', 'typescript', 'go', 'php') THEN regexp_replace(regexp_replace(target, '^(\\.{{1,2}}/)+', ''), '\\.(js|ts|jsx|tsx|json)$', '') ELSE regexp_replace(regexp_replace(target, '^\\.+', ''), '\\.|::|\\\\', '/', 'g') END AS path FROM i WHERE target <> ''),
tx AS (SELECT file_path, name, array_to_string(p[k:], '/') AS suffix FROM (SELECT *, string_split(path, '/') AS p FROM im), unnest(range(1, len(p) + 1)) AS r(k)),
ed AS (SELECT DISTINCT file_path, target FROM (SELECT tx.file_path, arg_max(ix.target, length(suffix)) AS target FROM tx JOIN ix USING (suffix) GROUP BY tx.file_path, name) WHERE file_path <> target)"""


@register("s34_import_edges", _IMPORTED + " SELECT file_path, target FROM ed")
def s34_edges(spark, sf):
    return related.import_edges(with_tests(spark, sf))


@register(
    "s34_related_arms",
    _IMPORTED
    + f""", f AS (SELECT file_path, content, {_STEM.format('file_path')} AS s, {_FOLDER.format('file_path')} AS d FROM al), o AS (SELECT file_path AS target, s, d FROM f),
cf AS (SELECT * FROM f WHERE regexp_matches(lower(regexp_extract(file_path, '([^/]*)$', 1)), '{related.CONFIGURATION}')),
arms AS (SELECT target, 'imported by' AS arm, file_path FROM ed UNION SELECT file_path, 'imports', target FROM ed
UNION SELECT target, 'test', f.file_path FROM o JOIN f ON regexp_replace(o.s, '{_MARK}', '', 'g') = regexp_replace(f.s, '{_MARK}', '', 'g') WHERE regexp_matches(f.s, '{_MARK}')
UNION SELECT target, 'configuration', cf.file_path FROM o JOIN cf ON cf.d = o.d OR cf.d = {_FOLDER.format('o.d')}
UNION SELECT target, 'configuration', w.file_path FROM o JOIN (SELECT file_path, unnest(regexp_extract_all(content, '[A-Za-z0-9_-]+')) AS s FROM cf) w USING (s)
UNION SELECT target, 'name', f.file_path FROM o JOIN f USING (d) WHERE starts_with(f.s, o.s || '_') OR ends_with(f.s, '_' || o.s) OR starts_with(f.s, CASE WHEN length(o.s) > 3 THEN left(o.s, length(o.s) - 1) ELSE o.s END))
SELECT target, arm, file_path, CAST(row_number() OVER (PARTITION BY target, arm ORDER BY file_path) AS INT) AS rank FROM arms WHERE target <> file_path QUALIFY row_number() OVER (PARTITION BY target, arm ORDER BY file_path) <= 5""",
)
def s34_arms(spark, sf):
    files = with_tests(spark, sf)
    return related.related(files, files)

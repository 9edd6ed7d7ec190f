"""Symbols and relations from source text by tables of patterns.

A pattern table is data: every operator here is one pass of
``regexp_extract_all`` per pattern of a file's language and one explode, so
nothing leaves the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import basename
from ..sources.files import language

_ID = "[a-zA-Z_][a-zA-Z0-9_]*"

# Patterns with the group that names the target.
#: kind, type, suffixes, pattern, group
SYMBOLS = (
    ("python_function", "function", ("py",), r"(?m)^\s*def\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", 1),
    ("python_class", "class", ("py",), r"(?m)^\s*class\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*[\(:]", 1),
    ("js_function", "function", ("js", "ts"), r"(?m)function\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", 1),
    ("js_const", "variable", ("js", "ts"), r"(?m)const\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*=", 1),
    ("java_class", "class", ("java",), r"(?m)class\s+([a-zA-Z_][a-zA-Z0-9_]*)", 1),
    ("java_method", "method", ("java",), r"(?m)(public|private|protected)?\s*(static)?\s*\w+\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", 3),
)
#: language, pattern, group
IMPORTS = (
    ("python", r"from\s+([\w.]+)\s+import\s+([\w,\s*]+)", 1),
    ("python", r"import\s+([\w.]+)(?:\s+as\s+\w+)?", 1),
    ("javascript", r"import\s+.*\s+from\s+['\"]([^'\"]+)['\"]", 1),
    ("javascript", r"const\s+[\w{},\s]+\s*=\s*require\(['\"]([^'\"]+)['\"]\)", 1),
    ("javascript", r"import\(['\"]([^'\"]+)['\"]\)", 1),
    ("javascript", r"export\s+.*\s+from\s+['\"]([^'\"]+)['\"]", 1),
    ("typescript", r"import\s+.*\s+from\s+['\"]([^'\"]+)['\"]", 1),
    ("typescript", r"import\s+['\"]([^'\"]+)['\"]", 1),
    ("typescript", r"export\s+.*\s+from\s+['\"]([^'\"]+)['\"]", 1),
    ("java", r"import\s+([\w.]+);", 1),
    ("java", r"import\s+static\s+([\w.]+);", 1),
    ("go", r"import\s+\"([^\"]+)\"", 1),
    ("go", r"import\s+(\w+)\s+\"([^\"]+)\"", 2),
    ("csharp", r"using\s+([\w.]+);", 1),
    ("csharp", r"using\s+static\s+([\w.]+);", 1),
    ("csharp", r"using\s+(\w+)\s*=\s*([\w.]+);", 1),
    ("swift", r"import\s+(\w+)", 1),
    ("swift", r"import\s+([\w.]+)", 1),
    ("swift", r"import\s+(class|struct|enum|protocol)\s+(\w+\.\w+)", 2),
    ("rust", r"use\s+([\w:]+);", 1),
    ("rust", r"extern\s+crate\s+(\w+);", 1),
    ("rust", r"mod\s+(\w+);", 1),
    ("php", r"use\s+([\\\w]+);", 1),
    ("php", r"require_once\s+['\"]([^'\"]+)['\"]", 1),
    ("php", r"include_once\s+['\"]([^'\"]+)['\"]", 1),
    ("ruby", r"require\s+['\"]([^'\"]+)['\"]", 1),
    ("ruby", r"require_relative\s+['\"]([^'\"]+)['\"]", 1),
    ("ruby", r"load\s+['\"]([^'\"]+)['\"]", 1),
    ("kotlin", r"import\s+([\w.]+)", 1),
    ("kotlin", r"import\s+([\w.]+)\.\*", 1),
)
#: kind, pattern, separator of its two groups or nothing
CALLS = (
    ("object_method", r"(\w+)\.(\w+)\s*\(", "."),
    ("function_call", r"(\w+)\s*\(", ""),
    ("static_call", r"(\w+)::(\w+)\s*\(", "::"),
    ("async_call", r"await\s+(\w+)", ""),
    ("chained_call", r"(\w+(?:\.\w+)+)\s*\(", ""),
)
#: family, language, pattern, group of the target, confidence
RELATIONS = (
    ("dependency_injection", "python", r"def __init__\(self[^)]*,\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*:\s*([a-zA-Z_][a-zA-Z0-9_]*)", 2, 0.8),
    ("dependency_injection", "python", r"@inject\s*\n\s*def\s+([a-zA-Z_][a-zA-Z0-9_]*)", 1, 0.9),
    ("interface_implementation", "python", r"class\s+([a-zA-Z_][a-zA-Z0-9_]*)\([^)]*([a-zA-Z_][a-zA-Z0-9_]*)\)", 2, 0.9),
    ("interface_implementation", "python", r"class\s+([a-zA-Z_][a-zA-Z0-9_]*)\([^)]*ABC[^)]*\)", 1, 0.95),
    ("event", "python", r"\.subscribe\s*\(\s*['\"]([^'\"]+)['\"]", 1, 0.8),
    ("event", "python", r"\.emit\s*\(\s*['\"]([^'\"]+)['\"]", 1, 0.8),
    ("configuration", "python", r"settings\.([A-Z_][A-Z0-9_]*)", 1, 0.85),
    ("configuration", "python", r"os\.environ\.get\s*\(\s*['\"]([^'\"]+)['\"]", 1, 0.9),
    ("import", "python", r"from\s+([a-zA-Z_][a-zA-Z0-9_.]*)\s+import", 1, 0.95),
    ("import", "python", r"import\s+([a-zA-Z_][a-zA-Z0-9_.]*)", 1, 0.95),
    ("inheritance", "python", r"class\s+([a-zA-Z_][a-zA-Z0-9_]*)\(([a-zA-Z_][a-zA-Z0-9_]*)\)", 2, 0.95),
    ("dependency_injection", "java", r"@Autowired\s+private\s+([a-zA-Z_][a-zA-Z0-9_]*)\s+([a-zA-Z_][a-zA-Z0-9_]*)", 2, 0.95),
    ("dependency_injection", "java", r"@Inject\s+private\s+([a-zA-Z_][a-zA-Z0-9_]*)\s+([a-zA-Z_][a-zA-Z0-9_]*)", 2, 0.9),
    ("interface_implementation", "java", r"class\s+([a-zA-Z_][a-zA-Z0-9_]*)\s+implements\s+([a-zA-Z_][a-zA-Z0-9_]*)", 2, 0.95),
    ("interface_implementation", "java", r"class\s+([a-zA-Z_][a-zA-Z0-9_]*)\s+extends\s+([a-zA-Z_][a-zA-Z0-9_]*)", 2, 0.95),
    ("import", "java", r"import\s+([a-zA-Z_][a-zA-Z0-9_.]*);", 1, 0.95),
    ("dependency_injection", "javascript", r"constructor\s*\([^)]*([a-zA-Z_][a-zA-Z0-9_]*)\s*\)", 1, 0.7),
    ("import", "javascript", r"import.*from\s+['\"]([^'\"]+)['\"]", 1, 0.95),
    ("import", "javascript", r"require\s*\(\s*['\"]([^'\"]+)['\"]", 1, 0.9),
    ("event", "javascript", r"\.addEventListener\s*\(\s*['\"]([^'\"]+)['\"]", 1, 0.85),
    ("dependency_injection", "go", r"func\s+New[a-zA-Z_][a-zA-Z0-9_]*\([^)]*([a-zA-Z_][a-zA-Z0-9_]*)\s+([a-zA-Z_][a-zA-Z0-9_]*)", 2, 0.8),
    ("interface_implementation", "go", r"type\s+([a-zA-Z_][a-zA-Z0-9_]*)\s+interface", 1, 0.9),
    ("import", "go", r"import\s+['\"]([^'\"]+)['\"]", 1, 0.95),
    ("dependency_injection", "csharp", r"\[Inject\]\s+private\s+([a-zA-Z_][a-zA-Z0-9_]*)\s+([a-zA-Z_][a-zA-Z0-9_]*)", 2, 0.9),
    ("interface_implementation", "csharp", r"class\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*:\s*([a-zA-Z_][a-zA-Z0-9_]*)", 2, 0.9),
    ("import", "csharp", r"using\s+([a-zA-Z_][a-zA-Z0-9_.]*);", 1, 0.95),
    ("dependency_injection", "swift", r"init\([^)]*([a-zA-Z_][a-zA-Z0-9_]*)\s*:\s*([a-zA-Z_][a-zA-Z0-9_]*)", 2, 0.8),
    ("interface_implementation", "swift", r"class\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*:\s*([a-zA-Z_][a-zA-Z0-9_]*)", 2, 0.9),
    ("interface_implementation", "swift", r"struct\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*:\s*([a-zA-Z_][a-zA-Z0-9_]*)", 2, 0.9),
    ("import", "swift", r"import\s+([a-zA-Z_][a-zA-Z0-9_]*)", 1, 0.95),
)
#: role: words in the lower-cased path, in order of precedence
ROLES = (
    ("controller", ("controller", "handler", "route", "view")),
    ("service", ("service", "business", "logic", "manager")),
    ("model", ("repository", "model", "data", "entity")),
    ("configuration", ("config", "setting", "env")),
    ("utility", ("util", "helper", "tool", "common")),
)
#: pattern of a reference to a symbol, group, edge type
REFERENCES = (
    (r"([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", 1, "calls"),
    (r"from\s+([a-zA-Z_][a-zA-Z0-9_.]*)\s+import", 1, "imports"),
    (r"import\s+([a-zA-Z_][a-zA-Z0-9_.]*)", 1, "imports"),
    (r"class\s+\w+\s*\(\s*([a-zA-Z_][a-zA-Z0-9_]*)", 1, "inherits"),
    (r"\.([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", 1, "calls"),
)
# End of fixed values.


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, w: a | F.contains(text, F.lit(w)), words, F.lit(False))


def symbols(files: DataFrame) -> DataFrame:
    """file_path, name, type, n: names that a file (file_path, content) defines, and how often; other suffixes try all patterns."""
    known = sorted({s for _, _, suffixes, _, _ in SYMBOLS for s in suffixes})
    suffix = F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1))
    parts = []
    for _, kind, suffixes, pattern, group in SYMBOLS:
        fits = suffix.isin(*suffixes) | ~suffix.isin(*known)
        parts.append(files.where(fits).select("file_path", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(group))).alias("name"), F.lit(kind).alias("type")))
    return reduce(DataFrame.unionByName, parts).where("name <> ''").groupBy("file_path", "name", "type").agg(F.count("*").alias("n"))


def import_confidence(target: Column, lang: Column) -> Column:
    score = 0.8 + F.when(~F.startswith(target, F.lit(".")), 0.1).otherwise(0.0) + F.when(lang.isin("java", "csharp") & F.contains(target, F.lit(".")), 0.1).otherwise(0.0)
    return F.least(score, F.lit(1.0))


def import_class(target: Column) -> Column:
    return F.when(target.rlike("^[./]"), "internal_relative").when(_any(target, ("http", "api", "client")), "external").when(_any(target, ("service", "repository", "model")), "cross_layer").otherwise("internal")


def imports(files: DataFrame) -> DataFrame:
    """file_path, language, target, class, confidence of every import of (file_path, content)."""
    rows = files.select("file_path", "content", language(F.col("file_path")).alias("language"))
    parts = [rows.where(F.col("language") == lang).select("file_path", "language", F.explode(F.regexp_extract_all("content", F.lit(p), F.lit(g))).alias("target")) for lang, p, g in IMPORTS]
    out = reduce(DataFrame.unionByName, parts).where("target <> ''").distinct()
    return out.withColumns({"class": import_class(F.col("target")), "confidence": import_confidence(F.col("target"), F.col("language"))})


def _parts_of(text: str, size: int) -> Column:
    """All parts of a length, as an array."""
    parts = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, parts).otherwise(F.array().cast("array<string>"))


def calls(files: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """file_path, kind, target, confidence; with ``components`` (name) only targets that hold a component's name.

    A name lies within a target exactly if it is one of the target's parts of
    the name's length; distinct targets are cut into parts of the lengths that
    names have, and both meet by an equi-join.
    """
    rows = files.select("file_path", "content", language(F.col("file_path")).alias("language"))
    parts = []
    for kind, pattern, sep in CALLS:
        if sep:
            both = F.arrays_zip(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all("content", F.lit(pattern), F.lit(2)).alias("b"))
            target = F.transform(both, lambda x: F.concat(x["a"], F.lit(sep), x["b"]))  # noqa: B023
        else:
            target = F.regexp_extract_all("content", F.lit(pattern), F.lit(1))
        parts.append(rows.select("file_path", "language", F.lit(kind).alias("kind"), F.explode(target).alias("target")))
    out = reduce(DataFrame.unionByName, parts).distinct()
    score = 0.6 + F.when(F.col("kind").isin("object_method", "static_call"), 0.2).otherwise(0.0) + F.when(F.col("language").isin("java", "csharp", "swift") & F.contains("target", F.lit(".")), 0.1).otherwise(0.0)
    out = out.withColumn("confidence", F.least(score, F.lit(1.0)))
    if components is not None:
        names = components.select(F.col("name").alias("_part")).where("_part <> ''").distinct()
        sizes = [r[0] for r in names.select(F.length("_part").alias("n")).distinct().collect()]  # as many as there are lengths of a name
        targets = out.select("target").distinct()
        cut = [_parts_of("target", n) for n in sizes]
        parts = targets.select("target", F.explode(F.array_distinct(F.concat(*cut)) if cut else F.array().cast("array<string>")).alias("_part"))
        found = parts.join(names, "_part", "left_semi").select("target").distinct()
        out = out.join(found, "target", "left_semi")
    return out


def component_name(path: Column) -> Column:
    """The file's stem with each word's first letter large."""
    stem = F.regexp_replace(basename(path), r"\.[^.]*$", "")
    return F.array_join(F.transform(F.split(stem, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")


def relations(files: DataFrame) -> DataFrame:
    """source, target, family, confidence, language, file_path of every relation that a pattern finds."""
    rows = files.select("file_path", "content", language(F.col("file_path")).alias("language"), component_name(F.col("file_path")).alias("source"))
    parts = [
        rows.where(F.col("language") == lang).select("source", F.explode(F.regexp_extract_all("content", F.lit("(?im)" + p), F.lit(g))).alias("target"), F.lit(family).alias("family"), F.lit(c).alias("confidence"), "language", "file_path")
        for family, lang, p, g, c in RELATIONS
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("source", "target", "family", "language", "file_path").agg(F.max("confidence").alias("confidence"))


def architectural_score(source: Column, target: Column, path: Column) -> Column:
    """1, less where layers or the direction of dependency are broken, 0.3 at least."""
    s, t, p = F.lower(source), F.lower(target), F.lower(path)
    layers = (_any(p, ("controller", "handler", "route")) & _any(t, ("controller", "handler"))) | (_any(p, ("repository", "dao", "data")) & _any(t, ("service", "business")))
    inversion = _any(s, ("service", "business", "application")) & _any(t, ("util", "helper", "database", "file"))
    return F.greatest(F.when(layers, 0.7).otherwise(1.0) * F.when(inversion, 0.8).otherwise(1.0), F.lit(0.3))


def validated(found: DataFrame, least: float = 0.5) -> DataFrame:
    score = F.col("confidence") * architectural_score(F.col("source"), F.col("target"), F.col("file_path"))
    return found.withColumn("confidence", score).where(F.col("confidence") >= least)


def synthesised(code: DataFrame, graph: DataFrame, vector: DataFrame, least: float = 0.5) -> DataFrame:
    """source, target, family, confidence, evidence over three kinds of findings (source, target, family, confidence, evidence).

    Equal relations merge with their highest confidence; more evidence raises it.
    """
    both = reduce(DataFrame.unionByName, [code, graph, vector])
    out = both.groupBy("source", "target", "family").agg(F.max("confidence").alias("c"), F.array_sort(F.flatten(F.collect_list("evidence"))).alias("evidence"))
    n = F.size("evidence")
    c = F.when(n > 1, F.least(F.col("c") + 0.1 * (n - 1), F.lit(0.95))).otherwise(F.col("c"))
    c = F.when(F.col("family").isin("import", "inheritance"), F.least(c + 0.1, F.lit(0.98))).otherwise(c)
    consistent = F.col("source") != F.col("target")
    return out.select("source", "target", "family", F.when(consistent, F.least(c + 0.05, F.lit(0.99))).otherwise(c * 0.9).alias("confidence"), "evidence").where(F.col("confidence") >= least)


def role(path: Column, imported: Column | None = None) -> Column:
    """By words of the path, then by what is imported."""
    low = F.lower(path)
    out = reduce(lambda acc, r: acc.when(_any(low, r[1]), r[0]), ROLES[1:], F.when(_any(low, ROLES[0][1]), ROLES[0][0]))
    if imported is None:
        return out.otherwise("component")
    lower = F.transform(imported, F.lower)
    services = F.size(F.filter(lower, lambda i: _any(i, ("service", "manager", "provider"))))
    data = F.exists(lower, lambda i: _any(i, ("repository", "model", "entity", "dao")))
    outside = (F.size(lower) > 0) & ~F.exists(lower, lambda i: F.startswith(i, F.lit(".")) | F.contains(i, F.lit("/")))
    return out.when(services >= 2, "controller").when(data, "service").when(outside, "model").otherwise("component")


def primary_language(files: DataFrame) -> DataFrame:
    """project, language: the most frequent known one; ties go to the earlier name."""
    rows = files.select("project", language(F.col("file_path")).alias("language")).where("language <> 'unknown'").groupBy("project", "language").count()
    return rows.groupBy("project").agg(F.max_by("language", F.struct("count", F.translate("language", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba"))).alias("language"))


def references(files: DataFrame, known: DataFrame) -> DataFrame:
    """source_id, target_id, type: every symbol of a file to every symbol that the file refers to by name.

    ``known`` has node_id, name, file_path.  Names are joined before a file's
    own symbols are, and both joins are on keys.
    """
    parts = [files.select("file_path", F.explode(F.regexp_extract_all("content", F.lit(p), F.lit(g))).alias("name"), F.lit(kind).alias("type")) for p, g, kind in REFERENCES]
    named = reduce(DataFrame.unionByName, parts).distinct()
    targets = named.join(known.select("name", F.col("node_id").alias("target_id")), "name")
    own = known.select("file_path", F.col("node_id").alias("source_id"))
    return targets.join(own, "file_path").where("source_id <> target_id").select("source_id", "target_id", "type").distinct()


def resolved(refs: DataFrame, known: DataFrame, aliases: DataFrame) -> DataFrame:
    """file_path, name, node_id: by import alias, else by a symbol of the file, else by the first symbol anywhere."""
    alias = aliases.select("file_path", F.col("alias").alias("name"), F.col("target").alias("real"))
    anywhere = known.groupBy("name").agg(F.min("node_id").alias("global_id"))
    local = known.groupBy("file_path", "name").agg(F.min("node_id").alias("local_id"))
    by_alias = alias.join(anywhere.withColumnRenamed("name", "real"), "real").select("file_path", "name", F.col("global_id").alias("alias_id"))
    out = refs.join(by_alias, ["file_path", "name"], "left").join(local, ["file_path", "name"], "left").join(anywhere, "name", "left")
    return out.select("file_path", "name", F.coalesce("alias_id", "local_id", "global_id").alias("node_id"))


def module_nodes(nodes: DataFrame) -> DataFrame:
    """A module node for every file that has none."""
    have = nodes.where("type = 'module'").select("file_path").distinct()
    stem = F.regexp_replace(basename(F.col("file_path")), r"\.[^.]*$", "")
    return nodes.select("file_path").distinct().join(have, "file_path", "left_anti").select(F.concat(stem, F.lit("::module::0")).alias("node_id"), F.lit("module").alias("type"), stem.alias("name"), "file_path", F.lit(1).alias("line_start"), F.lit(1).alias("line_end"))


def graph_of(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from chunk rows (file_path, function_name, class_name, start_line, end_line, imports, dependencies).

    Functions and classes are nodes, imports are module nodes; dependencies of
    functions are calls, those of classes are inheritance, to every node of that
    name in the chunks.
    """
    name = F.coalesce("function_name", "class_name")
    own = chunks.where(name.isNotNull()).select(F.concat_ws("::", "file_path", name, "start_line").alias("node_id"), F.when(F.col("function_name").isNotNull(), "function").otherwise("class").alias("type"), name.alias("name"), "file_path", F.col("start_line").alias("line_start"), F.col("end_line").alias("line_end"), "dependencies")
    modules = chunks.select("file_path", F.explode("imports").alias("m")).distinct()
    import_nodes = modules.select(F.concat("m", F.lit("::module::0")).alias("node_id"), F.lit("module").alias("type"), F.col("m").alias("name"), F.lit(None).cast("string").alias("file_path"), F.lit(0).alias("line_start"), F.lit(0).alias("line_end")).distinct()
    file_nodes = chunks.select("file_path").distinct().select(F.concat("file_path", F.lit("::file::0")).alias("node_id"), F.lit("file").alias("type"), basename(F.col("file_path")).alias("name"), "file_path", F.lit(1).alias("line_start"), F.lit(1).alias("line_end"))
    nodes = own.drop("dependencies").unionByName(import_nodes).unionByName(file_nodes).dropDuplicates(["node_id"])
    import_edges = modules.select(F.concat("file_path", F.lit("::file::0")).alias("source_id"), F.concat("m", F.lit("::module::0")).alias("target_id"), F.lit("imports").alias("type"))
    wanted = own.select(F.col("node_id").alias("source_id"), F.when(F.col("type") == "function", "calls").otherwise("inherits").alias("type"), F.explode("dependencies").alias("dep")).withColumn("name", F.element_at(F.split("dep", r"\."), -1))
    dep_edges = wanted.join(own.select("name", F.col("node_id").alias("target_id")), "name").where("source_id <> target_id").select("source_id", "target_id", "type")
    return nodes, import_edges.unionByName(dep_edges).distinct()


def graph_form(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of relations: distinct ends with their role, and labelled edges."""
    ends = found.select(F.col("source").alias("name")).unionByName(found.select(F.col("target").alias("name"))).distinct()
    return ends.select("name", role(F.col("name")).alias("role")), found.select("source", "target", F.initcap(F.replace("family", F.lit("_"), F.lit(" "))).alias("label"))


# Weights of a component's role, for rankings.
IMPORTANCE = {"controller": 1.0, "service": 0.9, "model": 0.8, "repository": 0.7, "view": 0.6, "middleware": 0.5, "utility": 0.3, "configuration": 0.2, "component": 0.1}
# End of fixed values.


def ranked_components(nodes: DataFrame, most: int = 5) -> DataFrame:
    """The first ``most`` components of each role by importance and name: role, name, importance, place."""
    weights = F.create_map(*[F.lit(x) for kv in IMPORTANCE.items() for x in kv])
    rows = nodes.select("name", role(F.col("file_path")).alias("role")).distinct()
    rows = rows.withColumn("importance", F.coalesce(F.try_element_at(weights, "role"), F.lit(0.1)))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("role").orderBy("name"))).where(F.col("place") <= most)


def _entries(files: DataFrame, within: Column, entry: str, name: str, version: str) -> DataFrame:
    """file_path, name, version from every match of ``entry`` in the texts of ``within``; ``name`` and ``version`` pick from a match."""
    found = files.select("file_path", F.explode(within).alias("_b")).select("file_path", F.explode(F.regexp_extract_all("_b", F.lit(entry), F.lit(0))).alias("_e"))
    return found.select("file_path", F.regexp_extract("_e", name, 1).alias("name"), F.regexp_extract("_e", version, 1).alias("version"))


def manifest_dependencies(files: DataFrame) -> DataFrame:
    """file_path, name, version, language of what a manifest (file_path, content) asks for; nine kinds, told by the file's name.

    A version that a manifest doesn't state is empty; a Maven artifact is named
    by its group and itself.
    """
    base, whole = basename(F.col("file_path")), F.array("content")
    sections = lambda p: F.regexp_extract_all("content", F.lit(p), F.lit(1))
    pair, first, second = r'"[^"]+"\s*:\s*"[^"]*"', r'^"([^"]+)"', r':\s*"([^"]*)"'
    kinds = (
        ("javascript", base == "package.json", sections(r'"(?:dependencies|devDependencies|peerDependencies)"\s*:\s*\{([^}]*)\}'), pair, first, second),
        ("php", base == "composer.json", sections(r'"require(?:-dev)?"\s*:\s*\{([^}]*)\}'), pair, first, second),
        ("python", base.rlike(r"^requirements.*\.txt$"), whole, r"(?m)^[ \t]*[A-Za-z0-9][^\n]*", r"^\s*([A-Za-z0-9._-]+)", r"(?:==|>=|<=|~=|>|<)\s*([^\s;#,]+)"),
        ("go", base == "go.mod", whole, r"(?m)^\s*(?:require\s+)?[\w.-]+\.[\w-]+/[\w./-]+\s+v[\w.+-]+", r"([\w.-]+\.[\w-]+/[\w./-]+)\s+v", r"\s(v[\w.+-]+)$"),
        ("rust", base == "Cargo.toml", sections(r"(?ms)^\[(?:dev-|build-)?dependencies\]\s*$([^\[]*)"), r"(?m)^[\w-]+\s*=[^\n]*", r"^([\w-]+)", r'(?:^[\w-]+\s*=\s*|version\s*=\s*)"([^"]*)"'),
        ("java", base == "pom.xml", whole, r"(?s)<dependency>.*?</dependency>", None, r"<version>\s*(.*?)\s*</version>"),
        ("csharp", base == "packages.config", whole, r"<package\s[^>]*>", r'\bid="([^"]+)"', r'\bversion="([^"]*)"'),
        ("ruby", base == "Gemfile", whole, r"""(?m)^\s*gem\s+['"][^\n]*""", r"""gem\s+['"]([^'"]+)""", r"""gem\s+['"][^'"]+['"]\s*,\s*['"]([^'"]+)"""),
        ("swift", base == "Package.swift", whole, r"\.package\([^)]*\)", r'url:\s*"([^"]+)"', r'(?:from|exact):\s*"([^"]+)"'),
    )
    parts = []
    for language, fits, within, entry, name, version in kinds:
        rows = files.where(fits)
        if name is None:
            found = rows.select("file_path", F.explode(F.regexp_extract_all("content", F.lit(entry), F.lit(0))).alias("_e"))
            joint = F.concat(F.regexp_extract("_e", r"<groupId>\s*(.*?)\s*</groupId>", 1), F.lit("."), F.regexp_extract("_e", r"<artifactId>\s*(.*?)\s*</artifactId>", 1))
            found = found.select("file_path", joint.alias("name"), F.regexp_extract("_e", version, 1).alias("version"))
        else:
            found = _entries(rows, within, entry, name, version)
        parts.append(found.where("name <> ''").withColumn("language", F.lit(language)))
    return reduce(DataFrame.unionByName, parts)


def python_symbols(files: DataFrame) -> DataFrame:
    """node_id, name, type, file_path, line_start, line_end, docstring, properties of Python sources, by parsing.

    Functions in classes are methods; decorators, parameters and whether a
    function is asynchronous are properties.  What doesn't parse has no symbols.
    """
    import ast
    import json
    from collections.abc import Iterator

    import pandas as pd

    schema = "node_id string, name string, type string, file_path string, line_start int, line_end int, docstring string, properties string"
    names = [c.split()[0] for c in schema.split(", ")]

    def walk(path: str, body: list, inside: bool) -> Iterator[tuple]:
        stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        for n in body:
            if isinstance(n, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                is_class = isinstance(n, ast.ClassDef)
                props = {"decorators": [ast.unparse(d) for d in n.decorator_list]} | ({"bases": [ast.unparse(b) for b in n.bases]} if is_class else {"parameters": [a.arg for a in n.args.args], "async": isinstance(n, ast.AsyncFunctionDef)})
                doc = ast.get_docstring(n)
                yield f"{stem}::{n.name}::{n.lineno}", n.name, "class" if is_class else "method" if inside else "function", path, n.lineno, n.end_lineno, doc and doc[:200], json.dumps(props, sort_keys=True)
                yield from walk(path, n.body, is_class)

    def run(batches):
        for batch in batches:
            rows = []
            for path, text in zip(batch["file_path"], batch["content"]):
                try:
                    rows += walk(path, ast.parse(text or "").body, False)
                except (SyntaxError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=names)

    return files.where(F.endswith("file_path", F.lit(".py"))).select("file_path", "content").mapInPandas(run, schema)


def contained(symbols_: DataFrame) -> DataFrame:
    """source_id, target_id: the smallest symbol of the file round each symbol, and the symbol."""
    outer = symbols_.select("file_path", F.col("node_id").alias("source_id"), F.col("line_start").alias("a"), F.col("line_end").alias("b"))
    both = symbols_.join(outer, "file_path").where("node_id <> source_id and a <= line_start and b >= line_end")
    return both.groupBy(F.col("node_id").alias("target_id")).agg(F.min_by("source_id", F.struct(F.col("b") - F.col("a"), "source_id")).alias("source_id")).select("source_id", "target_id", F.lit("contains").alias("type"))


def import_edges(found: DataFrame) -> DataFrame:
    """Imports (file_path, target) as edges from file nodes to module nodes."""
    return found.select(F.concat("file_path", F.lit("::file::0")).alias("source_id"), F.concat("target", F.lit("::module::0")).alias("target_id"), F.lit("imports").alias("type")).distinct()


def resolved_imports(found: DataFrame, files: DataFrame) -> DataFrame:
    """file_path, target, component: the file whose stem is the target's last part, the first by path."""
    last = F.element_at(F.split(F.regexp_replace("target", r"\.(js|ts|py|java)$", ""), r"[./]"), -1)
    stems = files.select(F.regexp_replace(basename(F.col("file_path")), r"\.[^.]*$", "").alias("_s"), F.col("file_path").alias("component")).groupBy("_s").agg(F.min("component").alias("component"))
    return found.select("file_path", "target", last.alias("_s")).join(stems, "_s").select("file_path", "target", "component")


def interfaces(files: DataFrame, most: int = 10) -> DataFrame:
    """file_path, exports, imports: public names a file defines and modules it reads."""
    exports = F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?m)^(?:export\s+)?(?:async\s+)?(?:def|class|function)\s+([A-Za-z]\w*)"), F.lit(1)))
    used = F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?m)^(?:from|import)\s+([\w.]+)"), F.lit(1)))
    return files.select("file_path", F.slice(exports, 1, most).alias("exports"), F.slice(used, 1, most).alias("imports"))

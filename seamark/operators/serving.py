"""What answers are made of: routed questions, reports, navigation, entities, presentation rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import basename, extension, project_of
from . import graph

# Question forms of the router (first that fits), words that are no key terms, frameworks, entity marks.
FORMS = (
    ("callers", r"(?:who|what)\s+calls\s+(\w+)|callers\s+of\s+(\w+)"),
    ("dependencies", r"dependenc(?:y|ies)\s+of\s+(\w+)|what\s+does\s+(\w+)\s+(?:use|depend\s+on)"),
    ("inheritance", r"(?:inherits\s+from|subclasses\s+of|extends)\s+(\w+)"),
    ("symbol", r"(?:find|where\s+is|show)\s+(?:the\s+)?(?:class\s+|function\s+|method\s+)?(\w+)"),
)
FRAMEWORKS = (
    ("jpa", r"@Entity\b", 0.2),
    ("django", r"models\.Model\b", 0.2),
    ("sqlalchemy", r"declarative_base|__tablename__", 0.2),
    ("sequelize", r"sequelize\.define", 0.1),
    ("mongoose", r"new\s+(?:mongoose\.)?Schema", 0.1),
    ("sql", r"(?i)create\s+table", 0.3),
)
SNIPPET_MARKS = ("{", "}", "(", ")", "def ", "class ", "function ", "import ", "return ")
# End of fixed values.

#: Relations of each kind that a report shows of a node.
SHOWN = 100


def routed(questions: DataFrame) -> DataFrame:
    """query_id, form, symbol of each question; symbols keep their case."""
    form, symbol = F.lit("search"), F.lit("")
    for name, pattern in reversed(FORMS):
        groups = pattern.count("(\\w+)")
        hit = F.regexp_like(F.col("query"), F.lit("(?i)" + pattern))
        found = F.coalesce(*[F.nullif(F.regexp_extract("query", "(?i)" + pattern, g + 1), F.lit("")) for g in range(groups)], F.lit(""))
        form, symbol = F.when(hit, name).otherwise(form), F.when(hit, found).otherwise(symbol)
    return questions.select("query_id", form.alias("form"), symbol.alias("symbol"))


def answered(routes: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """query_id, form, node_id: each route by its operator; a name stands for every node of that name."""
    named = routes.join(nodes.select("node_id", F.lower("name").alias("_n")), F.lower("symbol") == F.col("_n")).select("query_id", "form", "node_id")
    walks: dict[str, Callable[[DataFrame], DataFrame]] = {
        "callers": lambda s: graph.callers(edges, s, depth),
        "dependencies": lambda s: graph.dependencies(edges, s, depth),
        "inheritance": lambda s: graph.walk(edges, s, depth, forward=False, types=("inherits",)),
    }
    out = [named.where("form = 'symbol'")]
    for form, walk in walks.items():
        own = named.where(F.col("form") == form).withColumnRenamed("node_id", "start_id")
        out.append(own.join(walk(own.select(F.col("start_id").alias("node_id"))), "start_id").select("query_id", "form", "node_id").distinct())
    return reduce(DataFrame.unionByName, out)


def structural(nodes: DataFrame, edges: DataFrame, terms: list[str], limit: int = 50) -> DataFrame:
    """Nodes that fit the terms with their relations among edges that touch them."""
    hits = graph.find_nodes(nodes, terms)
    return graph.with_relations(hits, graph.touching(edges, hits), SHOWN).orderBy("type", "name", "node_id").limit(limit)


def symbol_search(nodes: DataFrame, name: str, project: str | None = None, names: int = 5, paths: int = 10) -> DataFrame:
    """arm, node_id: the first nodes by name, then by path."""
    order = ("name", "node_id")
    rows = nodes.where(graph.in_project(F.col("file_path"), project)) if project else nodes
    a = rows.where(F.contains(F.lower("name"), F.lit(name.lower()))).orderBy(*order).limit(names).select(F.lit("name").alias("arm"), "node_id")
    b = rows.where(F.contains(F.lower("file_path"), F.lit(name.lower()))).orderBy(*order).limit(paths).select(F.lit("path").alias("arm"), "node_id")
    return a.unionByName(b)


def key_terms(query: Column) -> Column:
    """Quoted words, names with capitals or underscores inside, and words of four letters or more; each once, in that order."""
    quoted = F.regexp_extract_all(query, F.lit('"([^"]+)"'), F.lit(1))
    names = F.regexp_extract_all(query, F.lit(r"\b([A-Za-z]+(?:_[A-Za-z0-9]+)+|[A-Z][a-z0-9]+[A-Z][A-Za-z0-9]*|[a-z]+[A-Z][A-Za-z0-9]*)\b"), F.lit(1))
    words = F.regexp_extract_all(F.lower(query), F.lit(r"\b([a-z]{4,})\b"), F.lit(1))
    return F.array_distinct(F.concat(quoted, names, words))


def scored_symbols(texts: DataFrame, most: int = 10) -> DataFrame:
    """text_id, symbol, score: the best names of each (text_id, text, query).

    1 where the question holds the name, else .5 where it holds a part of it;
    more by frequency, capitals and underscores.  Scores are rounded to six
    places before they are ranked, so that sums which differ in their last bit tie.
    """
    names = F.regexp_extract_all("text", F.lit(r"\b([A-Za-z_][A-Za-z0-9_]{2,})\b"), F.lit(1))
    rows = texts.select("text_id", F.lower("query").alias("q"), F.explode(names).alias("symbol")).groupBy("text_id", "q", "symbol").agg(F.count("*").alias("n"))
    low = F.lower("symbol")
    parts = F.exists(F.split(low, "_"), lambda p: (F.length(p) > 2) & F.contains(F.col("q"), p))
    score = F.when(F.contains("q", low), 1.0).when(parts, 0.5).otherwise(0.0) + F.least(F.col("n") / 10.0, F.lit(1.0)) + F.when(F.col("symbol").rlike("^[A-Z]"), 0.2).otherwise(0.0) + F.when(F.contains("symbol", F.lit("_")), 0.1).otherwise(0.0)
    rows = rows.select("text_id", "symbol", F.round(score, 6).alias("score"))
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("text_id").orderBy(F.desc("score"), "symbol"))).where(F.col("_n") <= most).drop("_n")


def kept_first(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def is_snippet(text: Column) -> Column:
    return reduce(lambda a, m: a | F.contains(text, F.lit(m)), SNIPPET_MARKS, F.lit(False))


def entities(files: DataFrame, head: int = 4096) -> DataFrame:
    """file_path, framework, confidence for every framework whose mark is in the head of (file_path, content)."""
    rows = files.select("file_path", F.substring("content", 1, head).alias("t"))
    parts = []
    for name, pattern, weight in FRAMEWORKS:
        score = 0.6 + weight + F.when(F.col("t").rlike(r"(?i)@Table|__tablename__|tableName|create\s+table"), 0.1).otherwise(0.0) + F.when(F.col("t").rlike(r"(?i)@Id\b|primary_?\s?key"), 0.1).otherwise(0.0)
        parts.append(rows.where(F.col("t").rlike(pattern)).select("file_path", F.lit(name).alias("framework"), F.least(score, F.lit(1.0)).alias("confidence")))
    return reduce(DataFrame.unionByName, parts)


def related_files(files: DataFrame, targets: DataFrame, most: int = 8) -> DataFrame:
    """target, file_path, why, score: same stem elsewhere, then the same folder."""
    stem = lambda c: F.regexp_replace(F.regexp_replace(basename(c), r"\.[^.]*$", ""), r"(?i)^test_|_test$|\.test$|\.spec$", "")
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    rows = files.select("file_path", stem(F.col("file_path")).alias("s"), folder(F.col("file_path")).alias("f"))
    own = targets.select(F.col("file_path").alias("target"), stem(F.col("file_path")).alias("s"), folder(F.col("file_path")).alias("f"))
    a = own.drop("f").join(rows, "s").select("target", "file_path", F.lit("name").alias("why"), F.lit(1.0).alias("score"))
    b = own.drop("s").join(rows, "f").select("target", "file_path", F.lit("folder").alias("why"), F.lit(0.8).alias("score"))
    both = kept_first(a.unionByName(b).where("target <> file_path"), ["target", "file_path"], [F.desc("score")])
    return both.withColumn("_n", F.row_number().over(W.partitionBy("target").orderBy(F.desc("score"), "file_path"))).where(F.col("_n") <= most).drop("_n")


def structure_report(files: DataFrame, important: int = 40, sources: int = 25) -> DataFrame:
    """project, kind, file_path: entry points, configuration and source files of each project, the first by path."""
    name = F.lower(basename(F.col("file_path")))
    kind = (
        F.when(name.rlike(r"^(main|app|index|server|__main__)\."), "entry point")
        .when(name.rlike(r"^(package\.json|pyproject\.toml|requirements.*\.txt|dockerfile|makefile|.*\.(ya?ml|toml|ini|cfg))$"), "configuration")
        .when(name.rlike(r"\.(py|js|ts|tsx|jsx|java|go|rs|kt|swift|c|cpp|cs|rb|php)$"), "source")
    )
    rows = files.select(project_of(F.col("file_path")).alias("project"), kind.alias("kind"), "file_path").where("kind is not null")
    place = F.row_number().over(W.partitionBy("project", "kind").orderBy("file_path"))
    return rows.withColumn("_n", place).where(F.when(F.col("kind") == "source", F.col("_n") <= sources).otherwise(F.col("_n") <= important)).drop("_n")


def resolved_paths(inputs: DataFrame, files: DataFrame, context: str) -> DataFrame:
    """input, file_path: ``@project/rest``, then the stored path, then below the context's project, then the first path that ends so."""
    paths = files.select("file_path").distinct()
    wanted = inputs.select("input", F.regexp_replace("input", "^@", "").alias("plain"))
    tries = [
        (1, wanted.withColumn("file_path", F.col("plain")).join(paths, "file_path", "left_semi").select("input", "file_path")),
        (2, wanted.withColumn("file_path", F.concat(F.lit(context + "/"), "plain")).join(paths, "file_path", "left_semi").select("input", "file_path")),
        (3, wanted.withColumn("b", basename(F.col("plain"))).join(paths.withColumn("b", basename(F.col("file_path"))), "b").where(F.endswith("file_path", F.concat(F.lit("/"), "plain"))).select("input", "file_path")),
    ]
    both = reduce(DataFrame.unionByName, [t.select("input", "file_path", F.lit(i).alias("_i")) for i, t in tries])
    return kept_first(both, ["input"], [F.col("_i"), F.col("file_path")]).select("input", "file_path")


def framework_scores(files: DataFrame, signatures: DataFrame) -> DataFrame:
    """project, framework, score: the best framework of each project above 0.3.

    ``signatures`` has framework, pattern (of a path) and weight.
    """
    rows = files.select(project_of(F.col("file_path")).alias("project"), "file_path")
    hits = rows.join(F.broadcast(signatures), F.expr("file_path rlike pattern"))  # a fixed list of patterns
    score = hits.select("project", "framework", "pattern", "weight").distinct().groupBy("project", "framework").agg(F.sum("weight").alias("score"))
    return kept_first(score.where("score > 0.3"), ["project"], [F.desc("score"), F.col("framework")])


def members(files: DataFrame, methods: int = 10, attributes: int = 5) -> DataFrame:
    """file_path, methods, attributes of Python and Java sources, each once and the first of them."""
    py = extension(F.col("file_path")) == ".py"
    m = F.when(py, F.regexp_extract_all("content", F.lit(r"def\s+(\w+)\s*\("), F.lit(1))).otherwise(F.regexp_extract_all("content", F.lit(r"(?:public|private|protected)\s+(?:static\s+)?[\w<>\[\]]+\s+(\w+)\s*\("), F.lit(1)))
    a = F.when(py, F.regexp_extract_all("content", F.lit(r"self\.(\w+)\s*="), F.lit(1))).otherwise(F.regexp_extract_all("content", F.lit(r"(?:public|private|protected)\s+(?:static\s+)?(?:final\s+)?[\w<>\[\]]+\s+(\w+)\s*[;=]"), F.lit(1)))
    return files.select("file_path", F.slice(F.array_distinct(m), 1, methods).alias("methods"), F.slice(F.array_distinct(a), 1, attributes).alias("attributes"))


def pipe_tables(texts: DataFrame) -> DataFrame:
    """text_id, first_line, rows, columns (filled cells of the first line): runs of two or more lines with pipes."""
    from .chunking import lines

    w = W.partitionBy("text_id").orderBy("line_no")
    rows = lines(texts.select("text_id", "text"), "text").withColumn("is_row", F.length(F.regexp_replace("line", r"[^|]", "")) >= 2)
    starts = F.when(F.col("is_row") & ~F.coalesce(F.lag("is_row").over(w), F.lit(False)), 1).otherwise(0)
    rows = rows.withColumn("_g", F.sum(starts).over(w)).where("is_row")
    cells = F.size(F.filter(F.split("line", r"\|"), lambda c: F.trim(c) != ""))
    return rows.groupBy("text_id", "_g").agg(F.min("line_no").alias("first_line"), F.count("*").alias("rows"), F.min_by(cells, "line_no").alias("columns")).where("rows >= 2").drop("_g")


def repeated_tables(found: DataFrame, structured: DataFrame, least: float = 0.7) -> DataFrame:
    """text_id, first_line, rows, likeness of ``pipe_tables`` that one of the text's structured tables (text_id, columns, rows) repeats.

    Both are tables: 0.3; as many columns: 0.4; as many rows below the first: 0.3.
    """
    both = found.alias("f").join(structured.select("text_id", F.col("columns").alias("_c"), F.col("rows").alias("_r")), "text_id")
    tenths = 3 + F.when(F.col("columns") == F.col("_c"), 4).otherwise(0) + F.when(F.col("rows") - 1 == F.col("_r"), 3).otherwise(0)
    best = both.groupBy("text_id", "first_line", "rows").agg((F.max(tenths) / 10).alias("likeness"))
    return best.where(F.col("likeness") >= least)


def without_tables(texts: DataFrame, matches: DataFrame) -> DataFrame:
    """text_id, text without the lines of ``repeated_tables``, at most one blank line in a row, none at the end."""
    gone = matches.groupBy("text_id").agg(F.collect_list(F.struct("first_line", "rows")).alias("_gone"))  # at most the tables of one text
    rows = texts.select("text_id", "text").join(gone, "text_id", "left")
    ranges = F.coalesce("_gone", F.array().cast("array<struct<first_line:int,rows:bigint>>"))
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.struct(line.alias("line"), (i + 1).alias("n")))
    kept = F.filter(lines, lambda x: ~F.exists(ranges, lambda g: (x["n"] >= g["first_line"]) & (x["n"] < g["first_line"] + g["rows"])))
    text = F.array_join(F.transform(kept, lambda x: x["line"]), "\n")
    text = F.regexp_replace(F.regexp_replace(text, r"(?m)^([ \t]*)\n(?:[ \t]*(?:\n|\z))+", "$1\n"), r"\s*\z", "")
    return rows.select("text_id", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(text).alias("text"))


def contradictions(results: DataFrame) -> DataFrame:
    """tool, seq of results that say the opposite of the tool's one before (found / not found, success / failure)."""
    before = F.lag("result").over(W.partitionBy("tool").orderBy("seq"))
    no = lambda c: c.rlike(r"(?i)not found|no results|fail")
    return results.withColumn("_b", before).where(F.col("_b").isNotNull() & (no(F.col("result")) != no(F.col("_b")))).select("tool", "seq")


def code_lens(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """line, name, note for every symbol of a file: how often it is called, and its parents."""
    own = nodes.where(F.col("file_path") == path).select("node_id", "name", F.col("line_start").alias("line"))
    calls = edges.where("type = 'calls'").groupBy(F.col("target_id").alias("node_id")).agg(F.count("*").alias("calls"))
    up = edges.where("type = 'inherits'").join(nodes.select(F.col("node_id").alias("target_id"), F.col("name").alias("parent")), "target_id").groupBy(F.col("source_id").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_set("parent")), ", ").alias("parents"))
    out = own.join(calls, "node_id", "left").join(up, "node_id", "left")
    note = F.concat_ws("; ", F.concat(F.lit("called "), F.coalesce("calls", F.lit(0)), F.lit(" times")), F.concat(F.lit("extends "), "parents"))
    return out.select("line", "name", note.alias("note"))


def coverage(files: DataFrame, chunks: DataFrame, least_files: int = 3) -> DataFrame:
    """project, files, chunks, verdict: too few chunks for the files mean indexing anew; a few files mean none."""
    f = files.groupBy("project").agg(F.countDistinct("file_path").alias("files"))
    c = chunks.groupBy("project").agg(F.count("*").alias("chunks"))
    out = f.join(c, "project", "left").na.fill(0, ["chunks"])
    need = F.greatest(F.lit(5), F.floor(F.col("files") / 10))
    return out.withColumn("verdict", F.when(F.col("files") < least_files, "skip").when(F.col("chunks") < need, "index").otherwise("ready"))


def graph_bonus(score: Column, relations: Column, depth: Column) -> Column:
    """A score raised for being in the graph and for each relation, lowered by distance, 1 at most."""
    return F.least(F.lit(1.0), score + 0.1 + 0.05 * relations - 0.02 * depth)


def merged_arms(rows: DataFrame, boost: float = 1.2, least: float = 0.3, by: tuple[str, ...] = ("k",)) -> DataFrame:
    """One row per key (``by``) over several searches (by, doc_id, score): the best score, raised where more than one found it."""
    out = rows.groupBy(*by).agg(F.min("doc_id").alias("doc_id"), F.max("score").alias("s"), F.count("*").alias("n"))
    return out.select(*by, "doc_id", (F.col("s") * F.when(F.col("n") > 1, boost).otherwise(1.0)).alias("score")).where(F.col("score") >= least)


def references(texts: DataFrame, key: str, pattern: str, most: int = 3) -> DataFrame:
    """key, reference: the first references of each text; absolute ones, then rooted ones, then the rest."""
    rows = texts.select(key, F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("reference")).distinct()
    rank = F.when(F.col("reference").rlike("^https?:"), 1).when(F.startswith("reference", F.lit("/")), 2).otherwise(3)
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(rank, "reference"))).where(F.col("_n") <= most).drop("_n")


# What a readme may name: kind, pattern, its group, confidence, priority (small is first); changes of priority by kind of question.
REFERENCES = (
    ("api_endpoints", r"/api/[a-zA-Z0-9/_-]+", 0, 0.9, 1),
    ("file_paths", r"`([^`]*\.(?:ts|tsx|js|jsx|py|md|json|config\.(?:ts|js|mjs)))`", 1, 0.95, 1),
    ("components", r"\b([A-Z][a-zA-Z0-9]*(?:Component|Hook|Provider|Context|Dialog|Modal))\b", 1, 0.7, 2),
    ("directories", r"\b(src/[a-zA-Z0-9/_-]+)", 1, 0.8, 2),
    ("config_files", r"\b([a-zA-Z0-9._-]+\.config\.(?:ts|js|mjs|json))\b", 1, 0.9, 1),
    ("package_files", r"\b(package\.json|tsconfig\.json|next\.config\.(?:js|mjs)|tailwind\.config\.(?:ts|js))\b", 1, 0.95, 1),
    ("trpc_routers", r"\b(?:router|tRPC|trpc).*?([a-zA-Z][a-zA-Z0-9]*(?:Router|Api))\b", 1, 0.8, 1),
)
PRIORITIES = {
    "architecture": {"api_endpoints": -2, "config_files": -2, "directories": -1, "components": -1, "file_paths": -1},
    "database_entities": {"file_paths": -2, "directories": -1, "api_endpoints": 0},
    "authentication": {"api_endpoints": -2, "file_paths": -1, "components": -1},
    "general": {"file_paths": -1, "api_endpoints": 0},
}
# End of fixed values.


def readme_references(texts: DataFrame, key: str, question: str = "general", most: int = 3, priorities: dict[str, dict[str, int]] = PRIORITIES) -> DataFrame:
    """key, kind, reference, confidence, priority, rank: the first references of each text by priority, confidence, kind and name."""
    parts = []
    for kind, pattern, group, confidence, priority in REFERENCES:
        found = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)))).alias("reference")
        rank = priority + priorities.get(question, {}).get(kind, 0)
        parts.append(texts.select(key, F.lit(kind).alias("kind"), found, F.lit(confidence).alias("confidence"), F.lit(rank).alias("priority")))
    rows = reduce(DataFrame.unionByName, parts).where("reference <> ''")
    order = W.partitionBy(key).orderBy("priority", F.desc("confidence"), "kind", "reference")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def diagram(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """child, parent, label of one type of edge, by name."""
    names = lambda side, name: nodes.select(F.col("node_id").alias(side), F.col("name").alias(name))
    return edges.where(F.col("type") == kind).join(names("source_id", "child"), "source_id").join(names("target_id", "parent"), "target_id").select("child", "parent", F.lit(kind).alias("label"))


def near_hits(rows: DataFrame, group: str, position: str, at: int, term: str, radius: int) -> DataFrame:
    """Rows of each group round a position that hold a term; score by distance."""
    away = F.abs(F.col(position) - at)
    return rows.where((away <= radius) & F.contains(F.lower("text"), F.lit(term.lower()))).select(group, position, F.round(1 - 0.1 * away, 6).alias("score"))


def fenced_blocks(texts: DataFrame) -> DataFrame:
    """text_id, language, block of every fenced block."""
    pattern = r"(?s)```(\w*)\n(.*?)```"
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("language"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("block"))
    return texts.select("text_id", F.explode(both).alias("b")).select("text_id", "b.language", "b.block")


def response_confidence(text: Column) -> Column:
    """0.5, more for long and structured answers, less for refusals."""
    score = 0.5 + F.when(F.length(text) > 500, 0.2).otherwise(0.0) + F.when(F.contains(text, F.lit("\n")), 0.1).otherwise(0.0) - F.when(F.contains(F.lower(text), F.lit("not")), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), score)


def _if(condition: Column, value: float) -> Column:
    return F.when(condition, value).otherwise(0.0)


#: Signs of structured output (fixed values).
STRUCTURED = ("📄", "🔗", "🧠")


def tool_confidence(result: Column) -> Column:
    """0 to 1 for what one tool gave: without errors, long and structured is better, very short is worse."""
    low = F.lower(result)
    marked = reduce(lambda a, m: a | F.contains(result, F.lit(m)), STRUCTURED, F.lit(False))
    score = 0.5 + _if(~F.contains(low, F.lit("error")) & ~F.contains(low, F.lit("failed")), 0.2) + _if(F.length(result) > 500, 0.1) + _if(marked, 0.1) - _if(F.length(result) < 100, 0.2)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def assessed(response: Column, results: Column, good: Column, needs_code: Column) -> Column:
    """0 to 1 for a whole answer: its length, the share of good results among ``results`` and their number, and code where the question needs it."""
    code = F.lower(response).rlike("class|function|import")
    score = 0.5 + _if(F.length(response) > 500, 0.1) + _if(F.length(response) > 1000, 0.1) + F.when(results > 0, 0.2 * good / results).otherwise(0.0) + _if(results > 5, 0.1) + _if(results > 10, 0.1) + _if(needs_code & code, 0.1)
    return F.least(F.lit(1.0), score)


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")

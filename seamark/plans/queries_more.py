"""Queries of sinks, stores, reports and presentation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import intent
from ..functions import text as T
from ..operators import bm25, chunking, context, extract, fusion, graph, serving, vectors
from ..sources import files as S
from ..sources import sinks
from ..sources.sinks import scratch
from ..streaming import watch
from .queries_code import _IMPORTS, _LANG, CODE, code
from .queries_search import _ASKED, _BASE, _DOCS, _FUSED, _INDEX, _INTENT, _IP, _L2, _NEAR, _SIGNALS, _TERMS, _arms, asked, documents, questions, vector_queries
from .registry import register
from .tables import chunks, edges, files, nodes, read, search_index, sql


@register("s5_followed_links", sql("SELECT file_path FROM files WHERE doc_id % 4 <> 0 UNION SELECT b.file_path FROM files a JOIN files b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 4 = 0", "files"))
def s5(spark, sf):
    f = files(spark, sf).select("doc_id", "file_path")
    nxt = f.select((F.col("doc_id") - 1).alias("doc_id"), F.col("file_path").alias("target"))
    # A link whose document is missing stays a link, and leads nowhere.
    links = f.where("doc_id % 4 = 0").join(nxt, "doc_id", "left").select(F.col("file_path").alias("link"), "target")
    return sinks.followed(f.select("file_path"), links)


@register("s7_pattern_discovery", sql("SELECT file_path FROM files WHERE file_path LIKE 'src1/%.txt' OR file_path LIKE '%7.txt'", "files"))
def s7(spark, sf):
    f = files(spark, sf)
    return S.found(f, "src1/*.txt").unionByName(S.found(f, "*7.txt")).distinct()


@register("s14_open_tables", sql("SELECT 'nodes' AS name, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'chunks', count(*) FROM chunks", "nodes", "edges", "chunks"))
def s14(spark, sf):
    count = lambda d, name: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return count(nodes(spark, sf), "nodes").unionByName(count(edges(spark, sf), "edges")).unionByName(count(chunks(spark, sf), "chunks"))


@register("s17_chunk_upsert", sql("SELECT chunk_id, CASE WHEN position = 0 THEN 'new' ELSE text END AS text FROM chunks", "chunks"))
def s17(spark, sf):
    c = chunks(spark, sf).select("chunk_id", "text", "position", F.lit(1).alias("updated_at"))
    new = c.where("position = 0").withColumns({"text": F.lit("new"), "updated_at": F.lit(2)})
    return graph.upserted(c, new, "chunk_id").select("chunk_id", "text")


@register("s21_index_sink", f"WITH {CODE} SELECT split_part(file_path, '/', 1) AS project, count(*) AS files FROM code GROUP BY ALL")
def s21(spark, sf):
    places = sinks.write_index(code(spark, sf), scratch(spark))
    return spark.read.parquet(places["projects"]).select("project", "files")


@register("s20_project_replaced", sql("SELECT project, CASE WHEN project = 'src1' THEN 1 ELSE count(*) END AS n FROM files GROUP BY project", "files"))
def s20_replaced(spark, sf):
    path = scratch(spark)
    f = files(spark, sf).select("doc_id", "file_path")
    sinks.write_by_project(f, path)
    sinks.write_by_project(f.where("file_path like 'src1/%'").orderBy("doc_id").limit(1), path)
    return sinks.read_fresh(spark, path).groupBy("project").agg(F.count("*").alias("n"))


@register("s23_index_saved", f"WITH {_DOCS}, {_INDEX} SELECT term, count(*) AS df FROM ps GROUP BY term")
def s23(spark, sf):
    path = scratch(spark)
    bm25.build(documents(spark, sf)).save(path)
    return bm25.document_frequency(bm25.Index.load(spark, path))


@register("s24_index_of_chunks", sql(_BASE.replace(_DOCS, "docs AS (SELECT chunk_id AS doc_id, file_path, text FROM chunks)") + ", r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INT) AS rank, doc_id FROM sc WHERE score >= 0.1) SELECT query_id, rank, doc_id, file_path FROM r JOIN docs USING (doc_id) WHERE rank <= 5", "chunks"))
def s24(spark, sf):
    path = scratch(spark)
    bm25.build(chunks(spark, sf).select(F.col("chunk_id").alias("doc_id"), "file_path", "text")).save(path)
    return bm25.search(bm25.Index.load(spark, path), questions(spark, sf), 5).select("query_id", "rank", "doc_id", "file_path")


@register("c19_hashed_embeddings", sql(f"WITH t AS (SELECT chunk_id, unnest({_TERMS.format('text')}) AS term FROM chunks), c AS (SELECT chunk_id, CAST(('0x' || left(md5(term), 8))::BIGINT % 64 AS INT) AS cell, count(*) AS n FROM t GROUP BY ALL) SELECT chunk_id, cell, round(CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY chunk_id)) AS FLOAT) AS DOUBLE), 6) AS value FROM c", "chunks"))
def c19(spark, sf):
    rows = chunking.hashed_embeddings(chunks(spark, sf), 64).select("chunk_id", F.posexplode("embedding").alias("cell", "value")).where("value > 0")
    return rows.withColumn("value", F.round(F.col("value").cast("double"), 6))


@register("s25_chunk_store", sql("SELECT file_path, count(*) AS chunks, min(chunk_id) AS first_chunk, max(chunk_id) AS last_chunk FROM chunks GROUP BY file_path", "chunks"))
def s25(spark, sf):
    path = scratch(spark)
    sinks.write_by_project(chunks(spark, sf).drop("project"), path)
    return sinks.read_fresh(spark, path).groupBy("file_path").agg(F.count("*").alias("chunks"), F.min("chunk_id").alias("first_chunk"), F.max("chunk_id").alias("last_chunk"))


@register("t1_incremental_index", f"WITH {_DOCS}, {_INDEX} SELECT term, CAST(sum(tf) AS BIGINT) AS n FROM ps GROUP BY term")
def t1(spark, sf):
    """A stream over the documents' files, drained once, into an index."""
    path = scratch(spark)
    documents(spark, sf).selectExpr("doc_id", "file_path", "text", "1L AS version", "false AS deleted").write.parquet(f"{path}/in")
    index = watch.WatchedIndex(spark, f"{path}/index")
    index.follow(spark.readStream.schema(watch.CHANGES).parquet(f"{path}/in"), f"{path}/offsets").awaitTermination()
    return index.index().postings.groupBy("term").agg(F.sum("tf").alias("n"))


_WATCHED = "docs AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat(source, ' changed ', left(text, 200)) ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 10 = 0)"


@register("s26_watched_index", f"WITH {_WATCHED}, {_INDEX} SELECT term, df FROM df")
def s26(spark, sf):
    """Documents arrive; some change, some go, and some of these come back: the index is what a rebuild would be."""
    path = scratch(spark)
    d = documents(spark, sf).withColumn("source", F.split_part("file_path", F.lit("/"), F.lit(1)))
    changed = F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit(" changed "), F.left("text", F.lit(200)))).otherwise(F.col("text"))
    steps = (
        d.select("doc_id", "file_path", "text", F.lit(1).cast("long").alias("version"), F.lit(False).alias("deleted")),
        d.where("doc_id % 3 = 0").select("doc_id", "file_path", changed.alias("text"), F.lit(2).cast("long").alias("version"), F.lit(False).alias("deleted")),
        d.where("doc_id % 5 = 0").select("doc_id", "file_path", F.lit(None).cast("string").alias("text"), F.lit(3).cast("long").alias("version"), F.lit(True).alias("deleted")),
        d.where("doc_id % 10 = 0").select("doc_id", "file_path", changed.alias("text"), F.lit(4).cast("long").alias("version"), F.lit(False).alias("deleted")),
    )
    index = watch.WatchedIndex(spark, f"{path}/index")
    for step in steps:
        # Each time the stream starts again where it ended.
        step.write.mode("append").parquet(f"{path}/in")
        index.follow(spark.readStream.schema(watch.CHANGES).parquet(f"{path}/in"), f"{path}/offsets").awaitTermination()
    return bm25.document_frequency(index.index())


@register("s27_refreshed_table", sql("SELECT file_path FROM files", "files"))
def s27(spark, sf):
    path = scratch(spark)
    f = files(spark, sf).select("file_path")
    f.limit(1).write.parquet(path)
    spark.read.parquet(path).count()
    f.write.mode("overwrite").parquet(path)
    return sinks.read_fresh(spark, path)


@register("s31_golden_set", f"WITH {_DOCS} SELECT CAST(doc_id % 40 AS BIGINT) AS query_id, CAST(doc_id % 3 AS VARCHAR) AS category, count(*) AS expected FROM docs GROUP BY ALL")
def s31(spark, sf):
    path = scratch(spark)
    sinks.write_golden(documents(spark, sf).select((F.col("doc_id") % 40).alias("query_id"), (F.col("doc_id") % 3).cast("string").alias("category"), "doc_id"), path)
    return sinks.read_golden(spark, path).groupBy("query_id", "category").agg(F.count("*").alias("expected"))


@register(
    "s29_file_tools",
    sql(
        "WITH g AS (SELECT file_path, i, string_split(content, chr(10))[i] AS line FROM files, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS r(i) WHERE contains(content, 'the')), m AS (SELECT file_path, i, line FROM g WHERE regexp_matches(line, '\\bthe [a-z]+ing\\b')), "
        "t AS (SELECT DISTINCT split_part(file_path, '/', 1) AS project FROM files) "
        "SELECT 'list' AS tool, project AS argument, file_path AS value FROM (SELECT project, file_path FROM files QUALIFY row_number() OVER (PARTITION BY project ORDER BY file_path) <= 50) UNION ALL SELECT 'find', '*7.txt', file_path FROM files WHERE file_path LIKE '%7.txt' UNION ALL SELECT 'read', file_path, md5(content) FROM files UNION ALL SELECT 'grep', file_path || ':' || i, line FROM m",
        "files",
    ),
)
def s29(spark, sf):
    """Folders listed, paths found by pattern, files read and searched, as rows of one relation."""
    f = files(spark, sf)
    rows = lambda tool, d, argument, value: d.select(F.lit(tool).alias("tool"), argument.alias("argument"), value.alias("value"))
    place = F.row_number().over(W.partitionBy("project").orderBy("file_path"))
    listed = f.select("project", "file_path").withColumn("n", place).where("n <= 50")
    lines = S.grep(f.where(F.contains("content", F.lit("the"))), r"\bthe [a-z]+ing\b", context=0, most=None).where("is_match")
    parts = [
        rows("list", listed, F.col("project"), F.col("file_path")),
        rows("find", S.found(f, "*7.txt"), F.lit("*7.txt"), F.col("file_path")),
        rows("read", f, F.col("file_path"), F.md5("content")),
        rows("grep", lines, F.concat_ws(":", "file_path", "line_no"), F.col("line")),
    ]
    return reduce(DataFrame.unionByName, parts)


@register("s37_graph_rebuild", "SELECT 'app/service/nation_' || n_nationkey || '.py::Nation' || n_nationkey || '::4' AS node_id FROM nation")
def s37(spark, sf):
    path = scratch(spark)
    sinks.write_by_project(chunking.code_chunks(code(spark, sf)), path)
    stored = spark.read.parquet(path).where("project = 'app'")
    return extract.graph_of(stored)[0].where("type = 'class'").select("node_id")


@register("c14_file_interfaces", f"WITH {CODE} SELECT file_path, array_to_string(regexp_extract_all(content, '(?m)^(?:export\\s+)?(?:async\\s+)?(?:def|class|function)\\s+([A-Za-z]\\w*)', 1), ',') AS exports, array_to_string(regexp_extract_all(content, '(?m)^(?:from|import)\\s+([\\w.]+)', 1), ',') AS imports FROM code")
def c14(spark, sf):
    return extract.interfaces(code(spark, sf)).select("file_path", F.array_join("exports", ",").alias("exports"), F.array_join("imports", ",").alias("imports"))


_PYTHON = """SELECT 'nation_' || n_nationkey || '::Nation' || n_nationkey || '::4' AS node_id, 'class' AS type, '{"bases": ["Region' || n_regionkey || '"], "decorators": []}' AS properties FROM nation
UNION ALL SELECT 'nation_' || n_nationkey || '::load_' || n_nationkey || '::5', 'method', '{"async": false, "decorators": [], "parameters": ["self", "x"]}' FROM nation
UNION ALL SELECT 'region_' || r_regionkey || '::Region' || r_regionkey || '::1', 'class', '{"bases": ["Base"], "decorators": []}' FROM region
UNION ALL SELECT 'region_' || r_regionkey || '::find_' || r_regionkey || '::2', 'method', '{"async": false, "decorators": [], "parameters": ["self", "x"]}' FROM region"""


@register("g1_parsed_symbols", _PYTHON)
def g1(spark, sf):
    return extract.python_symbols(code(spark, sf)).select("node_id", "type", "properties")


@register("g4_docstrings", "SELECT 'f' || n_nationkey || '::load::1' AS node_id, left('About ' || n_name || repeat(' more', 60), 200) AS docstring FROM nation")
def g4(spark, sf):
    src = read(spark, sf, "nation").select(F.concat(F.lit("p/f"), "n_nationkey", F.lit(".py")).alias("file_path"), F.concat(F.lit('def load():\n    """About '), "n_name", F.repeat(F.lit(" more"), 60), F.lit('"""\n')).alias("content"))
    return extract.python_symbols(src).select("node_id", "docstring")


@register("g5_symbol_properties", "SELECT 'f' || n_nationkey || '::run' || n_nationkey || '::2' AS node_id, '{\"async\": true, \"decorators\": [\"task(' || n_regionkey || ')\"], \"parameters\": [\"a\", \"b\"]}' AS properties FROM nation")
def g5(spark, sf):
    src = read(spark, sf, "nation").select(F.concat(F.lit("p/f"), "n_nationkey", F.lit(".py")).alias("file_path"), F.concat(F.lit("@task("), "n_regionkey", F.lit(")\nasync def run"), "n_nationkey", F.lit("(a, b=1): pass\n")).alias("content"))
    return extract.python_symbols(src).select("node_id", "properties")


@register("g6_contains_edges", "SELECT 'nation_' || n_nationkey || '::Nation' || n_nationkey || '::4' AS source_id, 'nation_' || n_nationkey || '::load_' || n_nationkey || '::5' AS target_id, 'contains' AS type FROM nation UNION ALL SELECT 'region_' || r_regionkey || '::Region' || r_regionkey || '::1', 'region_' || r_regionkey || '::find_' || r_regionkey || '::2', 'contains' FROM region")
def g6(spark, sf):
    return extract.contained(extract.python_symbols(code(spark, sf)))


@register("g12_import_edges", f"WITH {CODE}, l AS (SELECT *, {_LANG} AS language FROM code), i AS ({_IMPORTS}) SELECT DISTINCT file_path || '::file::0' AS source_id, target || '::module::0' AS target_id, 'imports' AS type FROM i WHERE target <> ''")
def g12(spark, sf):
    return extract.import_edges(extract.imports(code(spark, sf)))


@register("g14_resolved_imports", "SELECT 'web/view/customer_' || c_custkey || '.js' AS file_path, './nation_' || c_nationkey AS target, 'app/service/nation_' || c_nationkey || '.py' AS component FROM customer UNION ALL SELECT 'app/service/nation_' || n_nationkey || '.py', 'region_' || n_regionkey, 'core/model/region_' || n_regionkey || '.py' FROM nation")
def g14(spark, sf):
    c = code(spark, sf)
    return extract.resolved_imports(extract.imports(c), c)


@register("g21_vector_relations", f"SELECT source, target, round(d, 6) AS similarity FROM (SELECT q.vec_id AS source, v.vec_id AS target, {_IP} AS d FROM embeddings q JOIN embeddings v ON q.vec_id < v.vec_id) WHERE round(d, 9) >= 0.3")
def g21(spark, sf):
    """Every two components that are alike enough."""
    return vectors.alike(read(spark, sf, "embeddings"), 0.3).withColumn("similarity", F.round("similarity", 6))


@register("f7_chunks_of_file", sql("SELECT chunk_id, position FROM chunks WHERE file_path LIKE 'src1/en/%'", "chunks"))
def f7(spark, sf):
    return chunks(spark, sf).where(F.startswith("file_path", F.lit("src1/en/"))).orderBy("position").select("chunk_id", "position")


@register("f10_result_filters", sql("SELECT node_id FROM nodes WHERE file_path LIKE '%.py' AND contains(file_path, 'core/') AND type = 'class'", "nodes"))
def f10(spark, sf):
    return graph.find_nodes(nodes(spark, sf), types=["class"], file_type=".py", directory="core/", limit=None).select("node_id")


@register("f13_context_filter", sql("SELECT doc_id FROM files WHERE project IN ('src2', 'src7')", "files"))
def f13(spark, sf):
    return files(spark, sf).where(T.project_of(F.col("file_path")).isin("src2", "src7")).select("doc_id")


@register("j11_full_outer", "SELECT coalesce(c.k, s.k) AS k, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON c.k = s.k")
def j11(spark, sf):
    c = read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    s = read(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "k", "full_outer").na.fill(0, ["customers", "suppliers"])


@register("j12_interval_overlap", "SELECT a.l_orderkey AS k, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber WHERE a.l_shipdate <= b.l_shipdate + INTERVAL 10 DAY AND b.l_shipdate <= a.l_shipdate + INTERVAL 10 DAY GROUP BY 1")
def j12(spark, sf):
    x = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    y = x.select("l_orderkey", F.col("l_linenumber").alias("m"), F.col("l_shipdate").alias("d"))
    near = F.expr("l_shipdate <= d + interval '10' day and d <= l_shipdate + interval '10' day")
    return x.join(y, "l_orderkey").where("l_linenumber < m").where(near).groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))


@register("j13_line_to_symbol", sql("WITH p AS (SELECT DISTINCT file_path, line_end AS line FROM nodes WHERE node_id LIKE 'supplier:%') SELECT file_path, line, arg_min(node_id, (line_start, node_id)) AS node_id FROM p JOIN nodes USING (file_path) WHERE line BETWEEN line_start AND line_end GROUP BY ALL", "nodes"))
def j13(spark, sf):
    n = nodes(spark, sf)
    return graph.symbol_at(n, n.where(F.startswith("node_id", F.lit("supplier:"))).select("file_path", F.col("line_end").alias("line")).distinct())


@register("j16_many_to_many", "SELECT o_custkey AS k, count(*) AS n FROM orders a JOIN (SELECT o_custkey AS c, o_orderpriority AS p FROM orders) b ON a.o_custkey = b.c AND a.o_orderpriority = b.p GROUP BY 1")
def j16(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", "o_orderpriority")
    return o.join(o.select(F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p")), F.expr("o_custkey = c and o_orderpriority = p")).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))


@register("j18_map_lookup", f"WITH {CODE} SELECT file_path, {_LANG} AS language FROM code")
def j18(spark, sf):
    return code(spark, sf).select("file_path", S.language(F.col("file_path")).alias("language"))


@register("a2_distinct_files", sql("SELECT count(DISTINCT file_path) FILTER (WHERE file_path LIKE 'app/%') AS relative, 0::BIGINT AS absolute, count(DISTINCT file_path) FILTER (WHERE file_path LIKE 'lib/%') AS no_prefix, relative + absolute + no_prefix AS total, CASE WHEN no_prefix = 0 THEN 'good' ELSE 'issues' END AS consistency FROM nodes", "nodes"))
def a2(spark, sf):
    return S.project_check(nodes(spark, sf), "app")


@register("a13_neighbourhood_metrics", sql("SELECT n.node_id AS start_id, count(DISTINCT e.source_id) AS n FROM nodes n JOIN edges e ON e.target_id = n.node_id AND e.type = 'imports' WHERE n.node_id LIKE 'nation:%' GROUP BY 1", "nodes", "edges"))
def a13(spark, sf):
    start = nodes(spark, sf).where(F.startswith("node_id", F.lit("nation:")))
    return graph.walk(edges(spark, sf), start, 1, forward=False, types=("imports",)).groupBy("start_id").agg(F.countDistinct("node_id").alias("n"))


@register("a22_composition", f"WITH {CODE}, s AS (SELECT '.' || lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) AS suffix FROM code) SELECT suffix, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM s GROUP BY suffix")
def a22(spark, sf):
    return S.by_suffix(code(spark, sf)).withColumn("percent", F.round("percent", 6))


@register("w1_first_relevant", f"WITH {_NEAR.format(_L2, '')} SELECT query_id, CAST(min(rank) AS INT) AS first FROM nr JOIN embeddings v USING (vec_id) JOIN embeddings q ON q.vec_id = query_id WHERE rank BETWEEN 2 AND 50 AND v.label = q.label GROUP BY query_id")
def w1(spark, sf):
    e = read(spark, sf, "embeddings")
    near = vectors.nearest(e, vector_queries(spark, sf), 50).where("rank >= 2")
    labels = e.select("vec_id", "label")
    own = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    return near.join(labels, "vec_id").join(own, "query_id").where("label = wanted").groupBy("query_id").agg(F.min("rank").alias("first"))


@register("w5_prefix_budget", "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(greatest(1, length(coalesce(text, '')) // 4)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 100")
def w5(spark, sf):
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    return read(spark, sf, "conversations").select("conv_id", "turn", F.sum(T.token_estimate(F.coalesce("text", F.lit("")))).over(w).alias("used")).where("used <= 100").drop("used")


@register("v3_filtered_similarity", f"WITH {_NEAR.format(_L2, '')}, f AS (SELECT query_id, vec_id, d FROM nn JOIN documents ON doc_id = vec_id WHERE source = 'src1') SELECT query_id, vec_id FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) <= 5")
def v3(spark, sf):
    """Filters go first: what is filtered after a cut at k would lose hits."""
    wanted = read(spark, sf, "documents").where("source = 'src1'").select(F.col("doc_id").alias("vec_id"))
    return vectors.nearest(read(spark, sf, "embeddings").join(wanted, "vec_id", "left_semi"), vector_queries(spark, sf), 5).select("query_id", "vec_id")


@register("r1_question_features", f"WITH {_ASKED} SELECT query_id, len(regexp_extract_all(query, '\\S+')) AS words, contains(query, '(') OR contains(query, '.') AS has_code, regexp_matches(lower(query), '^(how|what|why|where|when|which)\\b') AS is_question FROM a")
def r1(spark, sf):
    q = F.col("query")
    return asked(spark, sf).select("query_id", F.size(F.regexp_extract_all(q, F.lit(r"\S+"), F.lit(0))).cast("long").alias("words"), (F.contains(q, F.lit("(")) | F.contains(q, F.lit("."))).alias("has_code"), F.lower(q).rlike(r"^(how|what|why|where|when|which)\b").alias("is_question"))


@register("r3_intents", f"WITH {_ASKED}, {_SIGNALS}, {_INTENT} SELECT query_id, ['specific_symbol', 'conceptual', 'structural', 'debugging', 'exploratory'][k] AS intent FROM h")
def r3(spark, sf):
    return intent.classified(asked(spark, sf)).select("query_id", "intent")


@register("r9_semantic_search", f"WITH {_NEAR.format(_L2, '')} SELECT query_id, CAST(rank AS INT) AS rank, vec_id, round(greatest(0.1, 1 - rank * 0.2 + 0.2), 6)::DOUBLE AS score FROM nr WHERE rank <= 10")
def r9(spark, sf):
    return vectors.nearest(read(spark, sf, "embeddings"), vector_queries(spark, sf), 10).select("query_id", "rank", "vec_id", F.round(fusion.positional(F.col("rank")), 6).alias("score"))


@register("r17_graph_rank", sql("WITH d AS (SELECT target_id AS node_id, count(*) AS n FROM edges GROUP BY 1) SELECT node_id, round(least(1.0, 0.3 + 0.1 + 0.05 * n - 0.02 * (n % 4)), 6)::DOUBLE AS score FROM d", "edges"))
def r17(spark, sf):
    d = edges(spark, sf).groupBy(F.col("target_id").alias("node_id")).agg(F.count("*").alias("n"))
    return d.select("node_id", F.round(serving.graph_bonus(F.lit(0.3), F.col("n"), F.col("n") % 4), 6).alias("score"))


@register(
    "r18_merged_arms",
    _FUSED + ", t AS (SELECT query_id, doc_id, vs AS s FROM va UNION ALL SELECT query_id, doc_id, bs FROM ka), a AS (SELECT query_id, source || left(text, 100) AS k, doc_id, s FROM t JOIN documents USING (doc_id)), g AS (SELECT query_id, k, min(doc_id) AS doc_id, max(s) * CASE WHEN count(*) > 1 THEN 1.2 ELSE 1 END AS s FROM a GROUP BY query_id, k) SELECT query_id, doc_id, round(s, 6)::DOUBLE AS score FROM g WHERE s >= 0.3",
)
def r18(spark, sf):
    """Keyword and vector search of every question, merged by source and opening."""
    vector, keyword = _arms(spark, sf)
    keyword = fusion.normalised(keyword, "bm25_score").select("query_id", "doc_id", F.col("bm25_score").alias("score"))
    arms = vector.select("query_id", "doc_id", F.col("vector_score").alias("score")).unionByName(keyword)
    d = read(spark, sf, "documents").select("doc_id", F.concat("source", F.substring("text", 1, 100)).alias("k"))
    return serving.merged_arms(arms.join(d, "doc_id"), by=("query_id", "k")).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@register("r20_file_search", sql("SELECT file_path FROM files WHERE regexp_matches(lower(file_path), 'src1.*/de/') QUALIFY row_number() OVER (PARTITION BY project ORDER BY file_path) <= 3", "files"))
def r20(spark, sf):
    f = files(spark, sf).where(F.lower("file_path").rlike("src1.*/de/")).select("project", "file_path")
    return f.withColumn("n", F.row_number().over(W.partitionBy("project").orderBy("file_path"))).where("n <= 3").select("file_path")


@register("r21_auto_context", _BASE + ", r AS (SELECT query_id, doc_id, score FROM sc WHERE round(score, 9) >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 8), u AS (SELECT *, sum(greatest(1, length(text) // 4)) OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM r JOIN docs USING (doc_id)) SELECT query_id, count(*) AS passages FROM u WHERE used <= 3800 OR (used - greatest(1, length(text) // 4) <= 3800 AND 3800 - used + greatest(1, length(text) // 4) > 100) GROUP BY query_id")
def r21(spark, sf):
    index = search_index(spark, sf)
    top = bm25.search(index, questions(spark, sf), 8).join(index.documents.select("doc_id", "text"), "doc_id")
    return context.within_budget(top.select("query_id", "doc_id", "score", "text")).groupBy("query_id").agg(F.count("*").alias("passages"))


@register("r25_references", "WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS r FROM pages), d AS (SELECT DISTINCT page_id, r, CASE WHEN regexp_matches(r, '^https?:') THEN 1 WHEN starts_with(r, '/') THEN 2 ELSE 3 END AS p FROM l) SELECT page_id, r AS reference FROM d QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY p, r) <= 3")
def r25(spark, sf):
    return serving.references(read(spark, sf, "pages").select("page_id", F.col("html").alias("text")), "page_id", r'href="([^"]+)"')


_README = "'See `lib/page_' || page_id || '.py` and /api/v' || (page_id % 3) || '/users, src/app/part_' || page_id || ' with UserDialog; next.config.js sets router to pageRouter'"
_NAMED = " UNION ALL ".join(f"SELECT page_id, '{kind}' AS kind, unnest(list_distinct(regexp_extract_all(t, '{pattern}', {group}))) AS reference, {confidence}::DOUBLE AS confidence, {priority + serving.PRIORITIES['general'].get(kind, 0)} AS priority FROM t" for kind, pattern, group, confidence, priority in serving.REFERENCES)


@register("r25_readme_references", f"WITH t AS (SELECT page_id, {_README} AS t FROM pages), n AS ({_NAMED}) SELECT page_id, kind, reference, confidence, priority FROM n WHERE reference <> '' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY priority, confidence DESC, kind, reference) <= 3")
def r25_readme(spark, sf):
    k = F.col("page_id")
    text = F.concat(F.lit("See `lib/page_"), k, F.lit(".py` and /api/v"), k % 3, F.lit("/users, src/app/part_"), k, F.lit(" with UserDialog; next.config.js sets router to pageRouter"))
    return serving.readme_references(read(spark, sf, "pages").select("page_id", text.alias("text")), "page_id").drop("rank")


@register("r29_hits_in_context", _BASE + ", r AS (SELECT query_id, doc_id FROM sc WHERE round(score, 9) >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 3) SELECT query_id, doc_id, file_path, (SELECT count(*) FROM docs e WHERE regexp_replace(e.file_path, '/[^/]*$', '') = regexp_replace(d.file_path, '/[^/]*$', '')) AS siblings FROM r JOIN docs d USING (doc_id)")
def r29(spark, sf):
    index = search_index(spark, sf)
    folder = F.regexp_replace("file_path", "/[^/]*$", "")
    near = index.documents.groupBy(folder.alias("folder")).agg(F.count("*").alias("siblings"))
    top = bm25.search(index, questions(spark, sf), 3).select("query_id", "doc_id", "file_path", folder.alias("folder"))
    return top.join(near, "folder").select("query_id", "doc_id", "file_path", "siblings")


@register("k9_module_coupling", sql("SELECT a.file_path, count(DISTINCT b.file_path) FILTER (WHERE b.file_path <> a.file_path) AS external_files FROM edges e JOIN nodes a ON a.node_id = source_id JOIN nodes b ON b.node_id = target_id WHERE a.file_path LIKE 'core/%' GROUP BY 1 UNION ALL SELECT DISTINCT file_path, 0 FROM nodes WHERE file_path LIKE 'core/region/%'", "nodes", "edges"))
def k9(spark, sf):
    return graph.coupling(nodes(spark, sf), edges(spark, sf)).where("file_path like 'core/%'").select("file_path", "external_files")


@register("k11_siblings", sql("SELECT a.node_id AS start_id, b.node_id FROM nodes a JOIN nodes b ON a.file_path = b.file_path AND a.node_id <> b.node_id WHERE a.node_id LIKE 'nation:%' QUALIFY row_number() OVER (PARTITION BY a.node_id ORDER BY b.line_start, b.node_id) <= 10", "nodes"))
def k11(spark, sf):
    n = nodes(spark, sf)
    return graph.same_file(n, n.where(F.startswith("node_id", F.lit("nation:"))), 10)


@register("k13_symbol_report", sql("WITH m AS (SELECT node_id, name FROM nodes WHERE type = 'class' AND contains(lower(name), 'a') ORDER BY type, name, node_id LIMIT 20), i AS (SELECT target_id AS node_id, count(*) AS n FROM edges WHERE type IN ('calls', 'imports', 'inherits') GROUP BY 1) SELECT node_id, name, coalesce(n, 0) AS dependents FROM m LEFT JOIN i USING (node_id)", "nodes", "edges"))
def k13(spark, sf):
    hits = graph.find_nodes(nodes(spark, sf).withColumn("file_path", F.lit("")), ["a"], ["class"], limit=None).where(F.contains(F.lower("name"), F.lit("a"))).orderBy("type", "name", "node_id").limit(20)
    n = edges(spark, sf).where(F.col("type").isin(*graph.DEPENDENCIES)).groupBy(F.col("target_id").alias("node_id")).agg(F.count("*").alias("dependents"))
    return hits.select("node_id", "name").join(n, "node_id", "left").na.fill(0, ["dependents"])


@register("k16_diagram_rows", sql("SELECT a.name AS child, b.name AS parent, 'inherits' AS label FROM edges e JOIN nodes a ON a.node_id = source_id JOIN nodes b ON b.node_id = target_id WHERE e.type = 'inherits'", "nodes", "edges"))
def k16(spark, sf):
    return serving.diagram(nodes(spark, sf), edges(spark, sf), "inherits")


_TREE = "t AS (SELECT 'c' || c_custkey AS chunk_id, 'n' || c_nationkey AS parent_id FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL FROM region)"


def _tree(spark, sf):
    c, n, r = (read(spark, sf, t) for t in ("customer", "nation", "region"))
    return c.selectExpr("concat('c', c_custkey) AS chunk_id", "concat('n', c_nationkey) AS parent_id").unionByName(n.selectExpr("concat('n', n_nationkey) AS chunk_id", "concat('r', n_regionkey) AS parent_id")).unionByName(r.selectExpr("concat('r', r_regionkey) AS chunk_id", "cast(NULL AS string) AS parent_id"))


@register("n5_search_by_distance", "SELECT conv_id, turn, round(1 - 0.1 * abs(turn - 2), 6)::DOUBLE AS score FROM conversations WHERE abs(turn - 2) <= 3 AND contains(lower(text), 'the')")
def n5(spark, sf):
    return serving.near_hits(read(spark, sf, "conversations"), "conv_id", "turn", 2, "the", 3)


@register("n6_chunk_context", f"WITH {_TREE} SELECT chunk_id, parent_id AS ancestor_id, 1 AS distance FROM t WHERE parent_id IS NOT NULL UNION ALL SELECT a.chunk_id, b.parent_id, 2 FROM t a JOIN t b ON a.parent_id = b.chunk_id WHERE b.parent_id IS NOT NULL")
def n6(spark, sf):
    return graph.ancestors(_tree(spark, sf), 2)


@register("u1_union_all", "SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer")
def u1(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_custkey").alias("k")).unionAll(read(spark, sf, "customer").select("c_custkey"))


@register("u5_subset_test", "SELECT user_id FROM events GROUP BY user_id HAVING list_has_all(list(DISTINCT event_type), ['view', 'click', 'purchase'])")
def u5(spark, sf):
    need = F.array(F.lit("view"), F.lit("click"), F.lit("purchase"))
    return read(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("s")).where(F.size(F.array_except(need, "s")) == 0).select("user_id")


@register("u6_ordered_distinct", "SELECT source, string_agg(lang, ',' ORDER BY f) AS langs FROM (SELECT source, lang, min(doc_id) AS f FROM documents GROUP BY ALL) GROUP BY source")
def u6(spark, sf):
    first = read(spark, sf, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("f"))
    return first.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "lang"))), lambda s: s["lang"]), ",").alias("langs"))


@register("x2_code_blocks", f"WITH {CODE}, r AS (SELECT file_path AS text_id, 'Look:' || chr(10) || '```py' || chr(10) || content || '```' || chr(10) || 'done' AS t FROM code) SELECT text_id, 'py' AS language, length(substring(t, strpos(t, '```py') + 6)) - 8 AS size FROM r")
def x2(spark, sf):
    t = code(spark, sf).select(F.col("file_path").alias("text_id"), F.concat(F.lit("Look:\n```py\n"), "content", F.lit("```\ndone")).alias("text"))
    return serving.fenced_blocks(t).select("text_id", "language", F.length("block").cast("long").alias("size"))


@register("x3_best_references", "SELECT file_path, score FROM (SELECT source AS file_path, max(n_chars) AS score FROM documents GROUP BY source) ORDER BY score DESC, file_path LIMIT 8")
def x3(spark, sf):
    return read(spark, sf, "documents").groupBy(F.col("source").alias("file_path")).agg(F.max("n_chars").alias("score")).orderBy(F.desc("score"), "file_path").limit(8)


@register("x4_confidence", "SELECT doc_id, round(least(1.0, 0.5 + CASE WHEN length(text) > 500 THEN 0.2 ELSE 0 END + CASE WHEN contains(text, chr(10)) THEN 0.1 ELSE 0 END - CASE WHEN contains(lower(text), 'not') THEN 0.1 ELSE 0 END), 6)::DOUBLE AS confidence FROM documents")
def x4(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.round(serving.response_confidence(F.col("text")), 6).alias("confidence"))


_LEVEL = "CASE WHEN {0} >= 0.8 THEN 'high' WHEN {0} >= 0.5 THEN 'medium' ELSE 'low' END"
_TOOL = "greatest(0, least(1, 0.5 + CASE WHEN NOT contains(lower(t), 'error') AND NOT contains(lower(t), 'failed') THEN 0.2 ELSE 0 END + CASE WHEN length(t) > 500 THEN 0.1 ELSE 0 END + CASE WHEN contains(t, '📄') OR contains(t, '🔗') OR contains(t, '🧠') THEN 0.1 ELSE 0 END - CASE WHEN length(t) < 100 THEN 0.2 ELSE 0 END))"


@register("x4_tool_confidence", f"SELECT role AS tool, conv_id, turn, round({_TOOL}::DOUBLE, 6) AS confidence FROM (SELECT *, coalesce(text, '') AS t FROM conversations)")
def x4_tool(spark, sf):
    """Every turn as what a tool said."""
    return read(spark, sf, "conversations").select(F.col("role").alias("tool"), "conv_id", "turn", F.round(serving.tool_confidence(F.coalesce("text", F.lit(""))), 6).alias("confidence"))


_ANSWERS = (
    "c AS (SELECT *, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS p, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM conversations), "
    "r AS (SELECT conv_id, max(t) FILTER (WHERE p = 1) AS response, max(t) FILTER (WHERE q = 1) AS question, count(*) FILTER (WHERE p > 1) AS results, count(*) FILTER (WHERE p > 1 AND NOT contains(lower(t), 'error')) AS good FROM c GROUP BY conv_id), "
    "s AS (SELECT conv_id, least(1, 0.5 + CASE WHEN length(response) > 500 THEN 0.1 ELSE 0 END + CASE WHEN length(response) > 1000 THEN 0.1 ELSE 0 END + CASE WHEN results > 0 THEN 0.2 * good / results ELSE 0 END + CASE WHEN results > 5 THEN 0.1 ELSE 0 END + CASE WHEN results > 10 THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(lower(question), 'login|auth|database|entit') AND regexp_matches(lower(response), 'class|function|import') THEN 0.1 ELSE 0 END)::DOUBLE AS s FROM r)"
)


@register("x4_response_confidence", f"WITH {_ANSWERS} SELECT conv_id, round(s, 6) AS confidence, {_LEVEL.format('round(s, 6)')} AS level FROM s")
def x4_response(spark, sf):
    """The last turn of a conversation as its response, those before as what tools gave."""
    w = W.partitionBy("conv_id")
    c = read(spark, sf, "conversations").withColumn("t", F.coalesce("text", F.lit("")))
    c = c.withColumns({"p": F.row_number().over(w.orderBy(F.desc("turn"))), "q": F.row_number().over(w.orderBy("turn"))})
    before = F.col("p") > 1
    r = c.groupBy("conv_id").agg(F.max(F.when(F.col("p") == 1, F.col("t"))).alias("response"), F.max(F.when(F.col("q") == 1, F.col("t"))).alias("question"), F.count_if(before).alias("results"), F.count_if(before & ~F.contains(F.lower("t"), F.lit("error"))).alias("good"))
    score = F.round(serving.assessed(F.col("response"), F.col("results"), F.col("good"), F.lower("question").rlike("login|auth|database|entit")), 6)
    return r.select("conv_id", score.alias("confidence"), serving.confidence_level(score).alias("level"))


@register("x7_result_table", "SELECT doc_id, printf('%s | %s | %d', source, lang, n_chars) AS line FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def x7(spark, sf):
    return read(spark, sf, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(10).select("doc_id", F.format_string("%s | %s | %d", "source", "lang", "n_chars").alias("line"))

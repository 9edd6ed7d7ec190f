"""Queries over files, chunks and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, extract
from ..sources import files as S
from .registry import register
from .tables import chunks, files, nodes, read, sql

_SPECIAL_SQL = " ".join(f"WHEN contains(name, '{s}') THEN '{s}'" for s in S.SPECIAL_NAMES)
_SUFFIX_SQL = ", ".join(f"'{s[1:]}'" for s in S.SUFFIXES)


@register("s1_scan_skip", sql(f"SELECT file_path, size FROM files WHERE NOT list_has_any(string_split(regexp_replace(file_path, '/[^/]*$', ''), '/'), [{', '.join(repr(x) for x in S.SKIP_FOLDERS)}])", "files"))
def s1(spark, sf):
    return files(spark, sf).where(~S.in_skipped_folder(F.col("file_path"))).select("file_path", "size")


@register("s2_indexable", sql("SELECT file_path, size <= 10485760 AS indexable FROM files", "files"))
def s2(spark, sf):
    return files(spark, sf).select("file_path", S.indexable(F.col("file_path"), F.col("size"), F.encode("content", "UTF-8")).alias("indexable"))


@register("s3_text_sniff", sql("SELECT file_path, size <= 102400 AND NOT contains(left(content, 1024), chr(0)) AS is_text FROM files", "files"))
def s3(spark, sf):
    return files(spark, sf).select("file_path", S.is_text(F.encode("content", "UTF-8"), F.col("size")).alias("is_text"))


_PAGE = "regexp_extract(url, '://([^?#]*)', 1)"
_NAME = f"lower(regexp_extract({_PAGE}, '([^/]*)$', 1))"


@register(
    "s4_file_type",
    f"WITH p AS (SELECT page_id, {_NAME} AS name, substring(regexp_extract({_NAME}, '^.+(\\.[^.]+)$', 1), 2, 64) AS suffix FROM pages) SELECT page_id, CASE WHEN suffix IN ({_SUFFIX_SQL}) THEN suffix {_SPECIAL_SQL} WHEN suffix = '' THEN 'text' ELSE 'unknown' END AS file_type FROM p",
)
def s4(spark, sf):
    path = F.regexp_extract("url", "://([^?#]*)", 1)
    return read(spark, sf, "pages").select("page_id", S.file_type(path).alias("file_type"))


@register("s6_discovery_stats", sql("SELECT 'indexed' AS kind, 'txt' AS label, count(*) AS n FROM files WHERE size <= 10485760 HAVING count(*) > 0", "files"))
def s6(spark, sf):
    return S.discovery_stats(files(spark, sf))


@register("s8_incremental_scan", sql("SELECT f.doc_id FROM files f LEFT JOIN (SELECT file_path, modified + CASE WHEN doc_id % 3 = 0 THEN INTERVAL 1 DAY ELSE -INTERVAL 1 DAY END AS u FROM files WHERE doc_id % 2 = 0) s USING (file_path) WHERE u IS NULL OR modified > u", "files"))
def s8(spark, sf):
    f = files(spark, sf)
    status = f.where("doc_id % 2 = 0").select("file_path", F.expr("modified + CASE WHEN doc_id % 3 = 0 THEN interval '1' day ELSE -interval '1' day END").alias("updated_at"))
    return S.modified_since(f, status).select("doc_id")


@register("s9_new_projects", sql("SELECT DISTINCT project FROM files WHERE project NOT IN (SELECT DISTINCT project FROM files WHERE project LIKE 'src1%')", "files"))
def s9(spark, sf):
    f = files(spark, sf)
    indexed = f.where("project like 'src1%'").select(F.concat(F.lit("/workspace/"), "file_path").alias("file_path"))
    return S.new_projects(f, indexed)


@register("s11_projects", sql("SELECT project, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, max(modified) AS modified FROM files GROUP BY project", "files"))
def s11(spark, sf):
    return S.projects(files(spark, sf))


@register(
    "s12_file_tree",
    sql("WITH p AS (SELECT string_split(file_path, '/') AS p FROM files WHERE NOT regexp_matches(file_path, '(^|/)\\.')) SELECT DISTINCT array_to_string(p[1:d], '/') AS path, array_to_string(p[1:d - 1], '/') AS parent, CAST(d AS INT) AS depth, d = len(p) AS is_file FROM p, unnest(range(1, len(p) + 1)) AS r(d)", "files"),
)
def s12(spark, sf):
    return S.tree(files(spark, sf))


@register("s13_file_content", sql("SELECT file_path, content FROM files WHERE file_path LIKE 'src3/en/%'", "files"))
def s13(spark, sf):
    return files(spark, sf).where(F.startswith("file_path", F.lit("src3/en/"))).select("file_path", "content")


_GREP = "WITH l AS (SELECT file_path, i AS line_no, string_split(content, chr(10))[i] AS line FROM files, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS r(i)), m AS (SELECT *, regexp_matches(line, 'token|license') AS is_match FROM l) SELECT file_path, CAST(line_no AS INT) AS line_no, line, is_match FROM m QUALIFY max(CAST(is_match AS INT)) OVER (PARTITION BY file_path ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1"


@register("s32_content_grep", sql(_GREP, "files"))
def s32(spark, sf):
    return S.grep(files(spark, sf), "token|license", most=None)


@register("s33_extension_share", "WITH p AS (SELECT regexp_extract(lower(regexp_extract(" + _PAGE + ", '([^/]*)$', 1)), '^.+(\\.[^.]+)$', 1) AS suffix FROM pages) SELECT suffix, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM p GROUP BY suffix")
def s33(spark, sf):
    p = read(spark, sf, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("file_path"))
    return S.by_suffix(p).withColumn("percent", F.round("percent", 6))


@register("s36_project_files", sql("SELECT file_path, size FROM files WHERE project = 'src5'", "files"))
def s36(spark, sf):
    return files(spark, sf).where("project = 'src5'").orderBy("file_path").select("file_path", "size")


@register("c1_fixed_chunks", sql("SELECT chunk_id, doc_id, position, text FROM chunks", "chunks"))
def c1(spark, sf):
    return chunks(spark, sf).select("chunk_id", "doc_id", "position", "text")


_LINES = "WITH c AS (SELECT c.*, substring(d.text, 1, CAST(c.position * 400 AS BIGINT)) AS before FROM chunks c JOIN documents d USING (doc_id)) SELECT chunk_id, CAST(length(before) - length(replace(before, chr(10), '')) + 1 AS INT) AS start_line, CAST(length(before) - length(replace(before, chr(10), '')) + 1 + length(text) - length(replace(text, chr(10), '')) AS INT) AS end_line FROM c"


@register("c2_lined_chunks", sql(_LINES, "chunks"))
def c2(spark, sf):
    f = files(spark, sf).select("doc_id", F.col("content").alias("text"))
    return chunking.lined_chunks(f).select((F.col("doc_id") * 100_000_000 + F.col("position")).alias("chunk_id"), "start_line", "end_line")


_WORDS = "regexp_extract_all(lower(text), '[A-Za-z0-9_]+')"


@register("c3_dynamic_size", f"WITH w AS (SELECT doc_id, length(text) AS n, {_WORDS} AS w FROM documents), d AS (SELECT doc_id, n, coalesce(len(list_distinct(w)) * 1.0 / nullif(len(w), 0), 0) AS d FROM w), s AS (SELECT doc_id, n, CASE WHEN d < 0.05 THEN 2000 WHEN d < 0.15 THEN 1200 ELSE 800 END AS s FROM d) SELECT doc_id, CAST(s AS INT) AS chunk_size, CAST(ceil(n * 1.0 / s) AS BIGINT) AS chunks FROM s WHERE n > 0")
def c3(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "text")
    return chunking.dynamic_chunks(d).groupBy("doc_id", "chunk_size").agg(F.count("*").alias("chunks"))


@register("c8_small_files", sql("SELECT file_path, 'small_file' AS chunk_type, 1 AS start_line, CAST(length(content) - length(replace(content, chr(10), '')) + 1 AS INT) AS end_line, content AS text FROM files WHERE length(content) <= 300", "files"))
def c8(spark, sf):
    return chunking.small_file_chunks(files(spark, sf))


@register("c11_summaries", sql("SELECT file_path, 'file_summary' AS chunk_type, left(content, 500) AS text FROM files WHERE length(content) > 1000", "files"))
def c11(spark, sf):
    return chunking.summary_chunks(files(spark, sf))


@register("c13_complexity", sql("SELECT file_path, least((length(content) - length(replace(content, chr(10), '')) + 1) / 100.0, 1.0) AS complexity FROM files", "files"))
def c13(spark, sf):
    n = F.size(F.split("content", "\n"))
    return files(spark, sf).select("file_path", chunking.complexity(n).alias("complexity"))


_MATCH = """WITH o AS (SELECT o_orderkey AS chunk_id, o_custkey AS f, CAST(o_orderkey % 97 AS INT) AS a, CAST(o_orderkey % 97 + o_orderkey % 11 AS INT) AS b FROM orders),
s AS (SELECT o_custkey AS f, 'n' || (o_orderkey % 7) AS name, o_orderkey AS node_id, CAST(o_orderkey % 89 AS INT) AS x, CAST(o_orderkey % 89 + o_orderkey % 13 AS INT) AS y FROM orders),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY f, name ORDER BY x DESC, node_id DESC) = 1),
j AS (SELECT chunk_id, node_id, x, greatest(0, least(b, y) - greatest(a, x) + 1) AS score FROM o JOIN t USING (f))
SELECT chunk_id, node_id, CAST(score AS INT) AS score FROM j WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, x, node_id) = 1"""


@register("c15_chunk_symbol_overlap", _MATCH)
def c15(spark, sf):
    o = read(spark, sf, "orders")
    c = o.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("file_path"), F.expr("cast(o_orderkey % 97 AS int)").alias("start_line"), F.expr("cast(o_orderkey % 97 + o_orderkey % 11 AS int)").alias("end_line"), F.lit("").alias("text"))
    s = o.select(F.col("o_custkey").alias("file_path"), F.expr("concat('n', o_orderkey % 7)").alias("name"), F.col("o_orderkey").alias("node_id"), F.expr("cast(o_orderkey % 89 AS int)").alias("line_start"), F.expr("cast(o_orderkey % 89 + o_orderkey % 13 AS int)").alias("line_end"))
    return chunking.match_symbols(c, s)


@register("c16_chunk_ids", sql("SELECT chunk_id, doc_id || '_' || position || '_' || (position + 1) || '_' || left(md5(text), 8) AS id FROM chunks", "chunks"))
def c16(spark, sf):
    c = chunks(spark, sf)
    return c.select("chunk_id", chunking.chunk_id(F.col("file_path"), F.col("position"), F.col("position") + 1, F.col("text")).alias("id"))


@register(
    "c17_hierarchy_faults",
    "WITH h AS (SELECT c_custkey AS chunk_id, CASE WHEN c_custkey % 5 = 0 THEN c_custkey ELSE c_custkey * 3 END AS parent_id, c_custkey AS start_line, c_custkey + 5 - c_custkey % 7 AS end_line FROM customer) SELECT 'missing parent' AS fault, chunk_id FROM h WHERE parent_id NOT IN (SELECT chunk_id FROM h) UNION ALL SELECT 'own parent', chunk_id FROM h WHERE parent_id = chunk_id UNION ALL SELECT 'lines in wrong order', chunk_id FROM h WHERE end_line < start_line",
)
def c17(spark, sf):
    h = read(spark, sf, "customer").selectExpr("c_custkey AS chunk_id", "CASE WHEN c_custkey % 5 = 0 THEN c_custkey ELSE c_custkey * 3 END AS parent_id", "c_custkey AS start_line", "c_custkey + 5 - c_custkey % 7 AS end_line")
    return chunking.hierarchy_faults(h)


@register("c18_identifiers", "SELECT page_id, lower(trim(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g'), '_')) AS id FROM pages")
def c18(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.identifier(F.col("url")).alias("id"))


@register("g3_language", sql("SELECT node_id, CASE WHEN file_path LIKE '%.py' THEN 'python' ELSE 'unknown' END AS language FROM nodes", "nodes"))
def g3(spark, sf):
    return nodes(spark, sf).select("node_id", S.language(F.col("file_path")).alias("language"))


_LINK = r"""regexp_extract_all(html, '<a href="([^"]+)"', 1)"""


@register("g10_page_links", f"SELECT page_id, t AS target, CASE WHEN regexp_matches(t, '^[./]') THEN 'internal_relative' WHEN contains(t, 'http') OR contains(t, 'api') OR contains(t, 'client') THEN 'external' WHEN contains(t, 'service') OR contains(t, 'repository') OR contains(t, 'model') THEN 'cross_layer' ELSE 'internal' END AS class, CASE WHEN starts_with(t, '.') THEN 0.8 ELSE 0.9 END::DOUBLE AS confidence FROM (SELECT DISTINCT page_id, unnest({_LINK}) AS t FROM pages)")
def g10(spark, sf):
    rows = read(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]+)"'), F.lit(1))).alias("target")).distinct()
    return rows.select("page_id", "target", extract.import_class(F.col("target")).alias("class"), F.round(extract.import_confidence(F.col("target"), F.lit("html")), 6).alias("confidence"))


_ROLE_SQL = " ".join("WHEN " + " OR ".join(f"contains(u, '{w}')" for w in words) + f" THEN '{r}'" for r, words in extract.ROLES)


@register("g15_roles", f"SELECT page_id, CASE {_ROLE_SQL} ELSE 'component' END AS role FROM (SELECT page_id, lower(url) AS u FROM pages)")
def g15(spark, sf):
    return read(spark, sf, "pages").select("page_id", extract.role(F.col("url")).alias("role"))


@register(
    "g18_architecture_score",
    "WITH r AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'OrderService' ELSE 'View' END AS s, CASE p_partkey % 3 WHEN 0 THEN 'FileHelper' WHEN 1 THEN 'MainHandler' ELSE 'PriceService' END AS t, CASE p_partkey % 5 WHEN 0 THEN 'a/controller/x.py' WHEN 1 THEN 'a/dao/x.py' ELSE 'a/b.py' END AS p FROM part), f AS (SELECT k, round(0.65 * CASE WHEN (contains(p, 'controller') AND t = 'MainHandler') OR (contains(p, 'dao') AND t = 'PriceService') THEN 0.7 ELSE 1.0 END * CASE WHEN s = 'OrderService' AND t = 'FileHelper' THEN 0.8 ELSE 1.0 END, 6) AS confidence FROM r) SELECT k, CAST(confidence AS DOUBLE) AS confidence FROM f WHERE confidence >= 0.5",
)
def g18(spark, sf):
    r = read(spark, sf, "part").selectExpr("p_partkey AS k", "CASE WHEN p_partkey % 2 = 0 THEN 'OrderService' ELSE 'View' END AS source", "CASE p_partkey % 3 WHEN 0 THEN 'FileHelper' WHEN 1 THEN 'MainHandler' ELSE 'PriceService' END AS target", "CASE p_partkey % 5 WHEN 0 THEN 'a/controller/x.py' WHEN 1 THEN 'a/dao/x.py' ELSE 'a/b.py' END AS file_path", "0.65D AS confidence")
    return extract.validated(r).select("k", F.round("confidence", 6).alias("confidence"))


@register("g23_primary_language", sql("SELECT project, 'python' AS language FROM (SELECT DISTINCT split_part(file_path, '/', 1) AS project FROM nodes)", "nodes"))
def g23(spark, sf):
    return extract.primary_language(nodes(spark, sf).withColumn("project", T.project_of(F.col("file_path"))))


_MIXED = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '/workspace/' || file_path WHEN 1 THEN file_path ELSE 'src/' || doc_id || '.js' END AS file_path, project FROM files"


def _mixed(spark, sf):
    return files(spark, sf).select("doc_id", F.expr("CASE doc_id % 3 WHEN 0 THEN concat('/workspace/', file_path) WHEN 1 THEN file_path ELSE concat('src/', doc_id, '.js') END").alias("file_path"), "project")


@register("g25_normalised_paths", sql(f"WITH m AS ({_MIXED}) SELECT doc_id, CASE WHEN file_path LIKE '/workspace/%' THEN substring(file_path, 12) ELSE project || '/' || file_path END AS path FROM m", "files"))
def g25(spark, sf):
    return _mixed(spark, sf).select("doc_id", S.normalised(F.col("file_path"), F.col("project")).alias("path"))


@register("g26_project_of_path", sql("SELECT node_id, split_part(file_path, '/', 1) AS project FROM nodes", "nodes"))
def g26(spark, sf):
    return nodes(spark, sf).select("node_id", T.project_of(F.col("file_path")).alias("project"))


@register("g27_path_severity", sql(f"WITH m AS ({_MIXED}) SELECT DISTINCT file_path, CASE WHEN file_path LIKE '/workspace/%' THEN substring(file_path, 12) ELSE file_path END AS corrected, CASE WHEN file_path LIKE '/workspace/%' THEN 'warning' ELSE 'critical' END AS severity FROM m WHERE file_path LIKE '/workspace/%' OR file_path LIKE 'src/%'", "files"))
def g27(spark, sf):
    return S.inconsistencies(_mixed(spark, sf))


@register("g28_migrated_paths", sql(f"WITH m AS ({_MIXED}) SELECT doc_id, CASE WHEN file_path LIKE '/workspace/%' THEN substring(file_path, 12) ELSE file_path END AS file_path FROM m", "files"))
def g28(spark, sf):
    m = _mixed(spark, sf)
    return S.migrated(m, S.inconsistencies(m)).select("doc_id", "file_path")


@register("f12_ignored_paths", "SELECT page_id, NOT (" + " OR ".join(f"contains(lower(url), '{x}')" for x in S.IGNORED) + ") AS included FROM pages")
def f12(spark, sf):
    return read(spark, sf, "pages").select("page_id", S.included(F.col("url")).alias("included"))


@register("f17_glob", sql("SELECT file_path FROM files WHERE regexp_matches(file_path, '^src.5/.*/.*[05]\\.txt$') OR contains(file_path, 'src?5/*/*[05].txt')", "files"))
def f17(spark, sf):
    return S.found(files(spark, sf), "src?5/*/*[05].txt")


@register("n1_listing", sql("SELECT file_path FROM files WHERE file_path LIKE 'src2/%' ORDER BY file_path LIMIT 50", "files"))
def n1(spark, sf):
    return S.listed(files(spark, sf), "src2")


@register(
    "n1_project_check",
    sql(f"WITH m AS ({_MIXED}) SELECT count(DISTINCT CASE WHEN file_path LIKE 'src3/%' THEN file_path END) AS relative, count(DISTINCT CASE WHEN file_path LIKE '/workspace/src3/%' THEN file_path END) AS absolute, count(DISTINCT CASE WHEN file_path LIKE 'src/%' THEN file_path END) AS no_prefix, relative + absolute + no_prefix AS total, CASE WHEN relative > 0 AND no_prefix = 0 THEN 'good' ELSE 'issues' END AS consistency FROM m", "files"),
)
def n1_check(spark, sf):
    return S.project_check(_mixed(spark, sf), "src3")

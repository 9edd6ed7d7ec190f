"""Queries over the property graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context, extract, graph
from .registry import register
from .tables import edges, nodes, read, sql, transitions


def _start(spark, sf, kind):
    return nodes(spark, sf).where(F.startswith("node_id", F.lit(kind + ":")))


@register("f1_node_by_id", sql("SELECT * FROM nodes WHERE node_id = 'nation:7'", "nodes"))
def f1(spark, sf):
    return nodes(spark, sf).where("node_id = 'nation:7'")


@register("f2_nodes_by_type", sql("SELECT * FROM nodes WHERE type = 'class'", "nodes"))
def f2(spark, sf):
    return nodes(spark, sf).where("type = 'class'")


@register("f3_nodes_by_name", sql("SELECT node_id, name FROM nodes WHERE contains(lower(name), 'er#00000001')", "nodes"))
def f3(spark, sf):
    return graph.by_name(nodes(spark, sf), "ER#00000001", exact=False).select("node_id", "name")


@register("f4_nodes_by_file", sql("SELECT node_id, line_start FROM nodes WHERE file_path = 'app/customer/3.py'", "nodes"))
def f4(spark, sf):
    return nodes(spark, sf).where("file_path = 'app/customer/3.py'").orderBy("line_start").select("node_id", "line_start")


@register("f5_first_nodes", sql("SELECT node_id, file_path, line_start FROM nodes ORDER BY file_path, line_start, node_id LIMIT 200", "nodes"))
def f5(spark, sf):
    return nodes(spark, sf).orderBy("file_path", "line_start", "node_id").limit(200).select("node_id", "file_path", "line_start")


@register("f6_edges_of_node", sql("SELECT 'out' AS side, target_id AS node_id, type FROM edges WHERE source_id = 'customer:10' UNION ALL SELECT 'in', source_id, type FROM edges WHERE target_id = 'customer:10'", "edges"))
def f6(spark, sf):
    e = edges(spark, sf)
    out = e.where("source_id = 'customer:10'").select(F.lit("out").alias("side"), F.col("target_id").alias("node_id"), "type")
    return out.unionByName(e.where("target_id = 'customer:10'").select(F.lit("in").alias("side"), F.col("source_id").alias("node_id"), "type"))


@register("f8_symbol_at_line", sql("WITH p AS (SELECT DISTINCT file_path, line_start + 4 AS line FROM nodes WHERE node_id LIKE 'customer:%') SELECT file_path, line, arg_min(node_id, (line_start, node_id)) AS node_id FROM p JOIN nodes USING (file_path) WHERE line BETWEEN line_start AND line_end GROUP BY ALL", "nodes"))
def f8(spark, sf):
    n = nodes(spark, sf)
    places = n.where(F.startswith("node_id", F.lit("customer:"))).select("file_path", (F.col("line_start") + 4).alias("line")).distinct()
    return graph.symbol_at(n, places)


@register("f9_node_discovery", sql("SELECT node_id FROM nodes WHERE type IN ('class', 'function') AND (contains(lower(name), 'an') OR contains(lower(file_path), 'supplier')) AND file_path LIKE '%.py' ORDER BY type, name, node_id LIMIT 100", "nodes"))
def f9(spark, sf):
    return graph.find_nodes(nodes(spark, sf), ["an", "supplier"], ["class", "function"], "py").select("node_id")


@register("f11_project_filter", sql("SELECT node_id FROM nodes WHERE file_path LIKE 'core/%'", "nodes"))
def f11(spark, sf):
    return nodes(spark, sf).where(graph.in_project(F.col("file_path"), "Core")).select("node_id")


_WALK = """WITH RECURSIVE {cte}, w(start_id, node_id, relation, depth) AS (
SELECT DISTINCT {near}, {far}, type, 1 FROM edges WHERE type IN ({types}) AND {start}
UNION SELECT w.start_id, e.{far}, e.type, w.depth + 1 FROM w JOIN edges e ON e.{near} = w.node_id WHERE e.type IN ({types}) AND w.depth < {depth})
SELECT DISTINCT start_id, node_id, relation, CAST(depth AS INT) AS depth FROM w"""


def _walk_sql(table, near, far, types, start, depth):
    from .tables import CTE

    return _WALK.format(cte=CTE[table].replace("transitions AS", "edges AS") if table == "transitions" else CTE["edges"], near=near, far=far, types=types, start=start, depth=depth)


@register("j1_callers", _walk_sql("transitions", "target_id", "source_id", "'calls'", "TRUE", 3))
def j1(spark, sf):
    t = transitions(spark, sf)
    return graph.callers(t, t.select(F.col("target_id").alias("node_id")), 3)


@register("j2_dependencies", _walk_sql("edges", "source_id", "target_id", "'calls', 'imports', 'inherits'", "source_id LIKE 'orders:%'", 3))
def j2(spark, sf):
    return graph.dependencies(edges(spark, sf), _start(spark, sf, "orders"), 3)


@register("j4_class_hierarchy", _walk_sql("edges", "target_id", "source_id", "'inherits'", "target_id LIKE 'region:%'", 5))
def j4(spark, sf):
    return graph.walk(edges(spark, sf), _start(spark, sf, "region"), 5, forward=False, types=("inherits",))


@register("j5_module_dependencies", sql("SELECT DISTINCT a.file_path AS source_file, b.file_path AS target_file, e.type FROM edges e JOIN nodes a ON a.node_id = source_id JOIN nodes b ON b.node_id = target_id WHERE a.file_path <> b.file_path AND e.type = 'imports'", "nodes", "edges"))
def j5(spark, sf):
    n = nodes(spark, sf)
    e = edges(spark, sf).where("type = 'imports'")
    a, b = n.select(F.col("node_id").alias("source_id"), F.col("file_path").alias("source_file")), n.select(F.col("node_id").alias("target_id"), F.col("file_path").alias("target_file"))
    return e.join(a, "source_id").join(b, "target_id").where("source_file <> target_file").select("source_file", "target_file", "type").distinct()


@register("j6_related_symbols", sql("WITH o AS (SELECT name, node_id AS own FROM nodes WHERE node_id IN ('nation:3', 'region:1', 'customer:7')) SELECT name, 'outgoing' AS direction, type AS relation, target_id AS node_id FROM o JOIN edges ON source_id = own WHERE type IN ('calls', 'imports', 'inherits') UNION ALL SELECT name, 'incoming', type, source_id FROM o JOIN edges ON target_id = own WHERE type IN ('calls', 'imports', 'inherits')", "nodes", "edges"))
def j6(spark, sf):
    n = nodes(spark, sf)
    return graph.related(n, edges(spark, sf), n.where("node_id in ('nation:3', 'region:1', 'customer:7')").select("name"), ("calls", "imports", "inherits"))


@register("j7_call_counts", sql("SELECT name, count(*) AS calls FROM edges JOIN nodes ON node_id = target_id WHERE edges.type = 'calls' GROUP BY name", "nodes", "edges"))
def j7(spark, sf):
    e = edges(spark, sf).where("type = 'calls'").groupBy("target_id").count()
    return e.join(nodes(spark, sf), F.col("target_id") == F.col("node_id")).groupBy("name").agg(F.sum("count").alias("calls"))


@register("j8_parent_classes", sql("SELECT a.name, b.name AS parent FROM edges e JOIN nodes a ON a.node_id = source_id JOIN nodes b ON b.node_id = target_id WHERE e.type = 'inherits'", "nodes", "edges"))
def j8(spark, sf):
    n = nodes(spark, sf)
    e = edges(spark, sf).where("type = 'inherits'")
    return e.join(n.select(F.col("node_id").alias("source_id"), "name"), "source_id").join(n.select(F.col("node_id").alias("target_id"), F.col("name").alias("parent")), "target_id").select("name", "parent")


@register("j9_orphan_edges", sql("WITH n AS (SELECT node_id FROM nodes WHERE node_id NOT LIKE 'part:%5') SELECT * FROM edges WHERE source_id NOT IN (SELECT node_id FROM n) OR target_id NOT IN (SELECT node_id FROM n)", "nodes", "edges"))
def j9(spark, sf):
    return graph.orphans(edges(spark, sf), nodes(spark, sf).where("node_id not like 'part:%5'"))


@register("j10_touching_edges", sql("SELECT DISTINCT * FROM edges WHERE source_id LIKE 'nation:%' OR target_id LIKE 'nation:%'", "edges"))
def j10(spark, sf):
    return graph.touching(edges(spark, sf), nodes(spark, sf).where("node_id like 'nation:%'"))


@register("j15_component_pairs", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def j15(spark, sf):
    n = read(spark, sf, "nation")
    return n.alias("x").join(n.alias("y"), F.expr("x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey")).select(F.col("x.n_name").alias("a"), F.col("y.n_name").alias("b"))


_NEST = "WITH r AS (SELECT source_id AS node_id, 'outgoing' AS direction, type AS relation, target_id AS other_id FROM edges UNION ALL SELECT target_id, 'incoming', type, source_id FROM edges) SELECT node_id, direction, relation, other_id FROM nodes LEFT JOIN r USING (node_id)"


@register("j17_nested_relations", sql(_NEST, "nodes", "edges"))
def j17(spark, sf):
    return graph.relations(nodes(spark, sf), edges(spark, sf))


@register("s15_node_upsert", sql("SELECT node_id, CASE WHEN node_id LIKE 'nation:%' THEN 'new ' || name ELSE name END AS name FROM nodes", "nodes"))
def s15(spark, sf):
    n = nodes(spark, sf).withColumn("updated_at", F.lit(1))
    fresh = n.where("node_id like 'nation:%'")
    new = fresh.withColumns({"name": F.concat(F.lit("old "), "name"), "updated_at": F.lit(2)}).unionByName(fresh.withColumns({"name": F.concat(F.lit("new "), "name"), "updated_at": F.lit(3)}))
    return graph.upserted(n, new).select("node_id", "name")


@register("s16_edge_insert", sql("SELECT source_id, target_id, type FROM edges UNION SELECT source_id, target_id, 'calls' FROM edges WHERE type = 'inherits'", "edges"))
def s16(spark, sf):
    e = edges(spark, sf)
    again = e.where("type = 'inherits'")
    missing = again.withColumn("target_id", F.lit("nowhere:1"))
    return graph.with_edges(e, again.withColumn("type", F.lit("calls")).unionByName(again).unionByName(missing), nodes(spark, sf))


@register("s18_file_status", "SELECT c_custkey AS file_path, CASE WHEN c_custkey % 2 = 0 THEN 'done' ELSE 'pending' END AS status, c_nationkey AS nodes_count FROM customer")
def s18(spark, sf):
    c = read(spark, sf, "customer").selectExpr("c_custkey AS file_path", "'pending' AS status", "c_nationkey AS nodes_count", "1 AS updated_at")
    new = c.where("file_path % 2 = 0").selectExpr("file_path", "'done' AS status", "cast(NULL AS int) AS nodes_count", "2 AS updated_at")
    return graph.upserted(c, new, "file_path", ("nodes_count",)).drop("updated_at")


@register("s19_delete_file", sql("SELECT node_id FROM nodes WHERE file_path <> 'app/customer/3.py'", "nodes"))
def s19(spark, sf):
    return graph.without_file(nodes(spark, sf), "app/customer/3.py").select("node_id")


@register("s20_delete_project", sql("SELECT node_id FROM nodes WHERE file_path NOT LIKE 'jobs/%'", "nodes"))
def s20(spark, sf):
    return graph.without_project(nodes(spark, sf), "jobs").select("node_id")


@register("s30_statistics", sql("SELECT 'node' AS kind, type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type", "nodes", "edges"))
def s30(spark, sf):
    count = lambda d, kind: d.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "type", "n")
    return count(nodes(spark, sf), "node").unionByName(count(edges(spark, sf), "edge"))


@register("a1_type_counts", sql("SELECT type, count(*) AS n FROM nodes GROUP BY type", "nodes"))
def a1(spark, sf):
    return nodes(spark, sf).groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


@register("a3_files_per_project", sql("SELECT split_part(file_path, '/', 1) AS project, count(DISTINCT file_path) AS files FROM nodes GROUP BY ALL", "nodes"))
def a3(spark, sf):
    return nodes(spark, sf).groupBy(F.split_part("file_path", F.lit("/"), F.lit(1)).alias("project")).agg(F.countDistinct("file_path").alias("files")).orderBy(F.desc("files"))


@register("a6_file_summary", sql("SELECT file_path, string_agg(type || ' ' || n, ', ' ORDER BY type) AS summary FROM (SELECT file_path, type, count(*) AS n FROM nodes GROUP BY ALL) GROUP BY file_path", "nodes"))
def a6(spark, sf):
    n = nodes(spark, sf).groupBy("file_path", "type").agg(F.count("*").alias("n"))
    return n.groupBy("file_path").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "type", "n"))), ", ").alias("summary"))


_COUPLING = "WITH j AS (SELECT a.file_path, b.file_path AS g FROM edges JOIN nodes a ON a.node_id = source_id JOIN nodes b ON b.node_id = target_id), r AS (SELECT file_path, count(DISTINCT g) FILTER (WHERE g <> file_path) AS x, count(*) FILTER (WHERE g = file_path) AS i FROM j GROUP BY file_path), s AS (SELECT file_path, count(*) AS symbols FROM nodes GROUP BY file_path), c AS (SELECT file_path, symbols, coalesce(x, 0) AS x, coalesce(i, 0) AS i FROM s LEFT JOIN r USING (file_path)) SELECT file_path, symbols, x AS external_files, i AS internal_edges, round(x / symbols, 6) AS coupling, round(i / symbols, 6) AS cohesion, coalesce(nullif(concat_ws('; ', CASE WHEN x / symbols > 0.8 THEN 'high external coupling' END, CASE WHEN i / symbols < 0.3 THEN 'low internal cohesion' END, CASE WHEN x > 10 THEN 'many external dependencies' END), ''), 'healthy') AS advice FROM c"


@register("a11_coupling", sql(_COUPLING, "nodes", "edges"))
def a11(spark, sf):
    return graph.coupling(nodes(spark, sf), edges(spark, sf)).withColumns({c: F.round(c, 6) for c in ("coupling", "cohesion")})


_DEGREE = "WITH d AS (SELECT node_id, CAST(sum(o) AS BIGINT) AS fan_out, CAST(sum(i) AS BIGINT) AS fan_in FROM (SELECT source_id AS node_id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target_id, 0, 1 FROM edges) GROUP BY node_id)"


@register("a12_instability", sql(_DEGREE + " SELECT node_id, fan_out, fan_in, round(fan_out / greatest(fan_out + fan_in, 1), 6) AS instability FROM d", "edges"))
def a12(spark, sf):
    return graph.degrees(edges(spark, sf)).withColumn("instability", F.round("instability", 6))


@register("k7_hotspots", sql(_DEGREE + " SELECT node_id, fan_in + fan_out AS connections FROM d WHERE fan_in + fan_out >= 30", "edges"))
def k7(spark, sf):
    return graph.hotspots(edges(spark, sf), 30).select("node_id", "connections")


@register("k3_call_targets", sql("SELECT source_id, target_id FROM edges WHERE type = 'calls' AND source_id LIKE 'orders:%'", "edges"))
def k3(spark, sf):
    return edges(spark, sf).where("type = 'calls' and source_id like 'orders:%'").select("source_id", "target_id")


_PATHS = """WITH RECURSIVE {t}, p(path) AS (SELECT [source_id, target_id] FROM transitions WHERE source_id = 'view'
UNION ALL SELECT list_append(path, target_id) FROM p JOIN transitions ON source_id = path[-1] WHERE path[-1] <> path[1] AND len(path) < 4 AND (NOT list_contains(path, target_id) OR target_id = path[1]))"""


def _paths_sql():
    from .tables import CTE

    return _PATHS.format(t=CTE["transitions"])


@register("k4_call_paths", _paths_sql() + " SELECT array_to_string(path, ' > ') AS path FROM p WHERE path[-1] = 'purchase'")
def k4(spark, sf):
    t = transitions(spark, sf)
    ends = lambda name: t.where(F.col("source_id") == name).select(F.col("source_id").alias("node_id")).distinct()
    return graph.call_paths(t, ends("view"), ends("purchase"), 3).select(F.array_join("path", " > ").alias("path"))


def _cycles_sql():
    from .tables import CTE

    return f"""WITH RECURSIVE {CTE["transitions"]}, p(path) AS (SELECT [source_id, target_id] FROM transitions WHERE target_id >= source_id
UNION ALL SELECT list_append(path, target_id) FROM p JOIN transitions ON source_id = path[-1] WHERE path[-1] <> path[1] AND len(path) < 6 AND target_id >= path[1] AND (NOT list_contains(path, target_id) OR target_id = path[1]))
SELECT array_to_string(path, ' > ') AS cycle, CAST(len(path) - 1 AS INT) AS length FROM p WHERE path[-1] = path[1]"""


@register("k6_cycles", _cycles_sql())
def k6(spark, sf):
    return graph.cycles(transitions(spark, sf), 5)


@register("k8_inheritance_chains", sql("SELECT source_id || ' > ' || target_id AS chain FROM edges WHERE type = 'inherits'", "edges"))
def k8(spark, sf):
    return graph.chains(edges(spark, sf)).select(F.array_join("path", " > ").alias("chain"))


_REPORT = """WITH RECURSIVE {cte}, e AS (SELECT DISTINCT source_id AS a, target_id AS b FROM edges WHERE type IN ('calls', 'imports', 'inherits')),
w(s, n, d) AS (SELECT a, b, 1 FROM e WHERE a LIKE 'customer:%' UNION SELECT s, b, d + 1 FROM w JOIN e ON a = n WHERE d < 3),
x AS (SELECT s, count(DISTINCT n) FILTER (WHERE d = 1) AS direct, count(DISTINCT n) AS transitive FROM w GROUP BY s),
u AS (SELECT b AS s, count(DISTINCT a) AS dependents FROM e GROUP BY b)
SELECT 'customer:' || c_custkey AS start_id, coalesce(direct, 0) AS direct, coalesce(transitive, 0) AS transitive, coalesce(dependents, 0) AS dependents, round(coalesce(direct, 0) / greatest(coalesce(direct, 0) + coalesce(dependents, 0), 1), 6) AS instability FROM customer LEFT JOIN x ON x.s = 'customer:' || c_custkey LEFT JOIN u ON u.s = 'customer:' || c_custkey"""


def _report_sql():
    from .tables import CTE

    return _REPORT.format(cte=CTE["edges"])


@register("k5_dependency_report", _report_sql())
def k5(spark, sf):
    out = graph.dependency_report(nodes(spark, sf), edges(spark, sf), _start(spark, sf, "customer"), 3)
    return out.withColumn("instability", F.round("instability", 6))


@register("k10_neighbourhood", sql("SELECT a.node_id AS start_id, 'sibling' AS arm, b.node_id FROM nodes a JOIN nodes b ON a.file_path = b.file_path AND a.node_id <> b.node_id WHERE a.node_id LIKE 'nation:%' QUALIFY row_number() OVER (PARTITION BY a.node_id ORDER BY b.line_start, b.node_id) <= 8 UNION ALL SELECT source_id, arm, target_id FROM edges, (VALUES ('dependency'), ('inheritance')) AS v(arm) WHERE source_id LIKE 'nation:%' AND type = 'inherits'", "nodes", "edges"))
def k10(spark, sf):
    return graph.neighbourhood(nodes(spark, sf), edges(spark, sf), _start(spark, sf, "nation"))


@register("k14_diagram_roles", sql("SELECT node_id, CASE WHEN contains(lower(file_path), 'config') OR contains(lower(file_path), 'setting') OR contains(lower(file_path), 'env') THEN 'configuration' ELSE 'component' END AS role FROM nodes", "nodes"))
def k14(spark, sf):
    return nodes(spark, sf).select("node_id", extract.role(F.col("file_path")).alias("role"))


@register("n4_common_ancestor", "SELECT 'c' || a.c_custkey AS a, 'c' || b.c_custkey AS b, CASE WHEN a.c_nationkey = b.c_nationkey THEN 'n' || a.c_nationkey ELSE 'r' || x.n_regionkey END AS ancestor_id FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 JOIN nation x ON x.n_nationkey = a.c_nationkey JOIN nation y ON y.n_nationkey = b.c_nationkey WHERE x.n_regionkey = y.n_regionkey")
def n4(spark, sf):
    c, n, r = (read(spark, sf, t) for t in ("customer", "nation", "region"))
    rows = c.selectExpr("concat('c', c_custkey) AS chunk_id", "concat('n', c_nationkey) AS parent_id").unionByName(n.selectExpr("concat('n', n_nationkey) AS chunk_id", "concat('r', n_regionkey) AS parent_id")).unionByName(r.selectExpr("concat('r', r_regionkey) AS chunk_id", "cast(NULL AS string) AS parent_id"))
    pairs = c.selectExpr("concat('c', c_custkey) AS a", "concat('c', c_custkey + 1) AS b")
    return graph.common_ancestor(rows, pairs)


@register("r26_impact", sql("WITH r AS (SELECT target_id AS target, count(*) AS n FROM edges GROUP BY target_id) SELECT target, n, round(least(n * 0.9 / 10, 1), 6) AS score, CASE WHEN n >= 8 OR least(n * 0.9 / 10, 1) > 0.7 THEN 'HIGH' WHEN n >= 4 OR least(n * 0.9 / 10, 1) > 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM r", "edges"))
def r26(spark, sf):
    return context.impact(edges(spark, sf).select(F.col("target_id").alias("target"), F.lit(0.9).alias("confidence"))).withColumn("score", F.round("score", 6))


@register("u2_set_union", "SELECT DISTINCT n_name AS name FROM nation UNION SELECT r_name FROM region")
def u2(spark, sf):
    return read(spark, sf, "nation").select(F.col("n_name").alias("name")).union(read(spark, sf, "region").select("r_name")).distinct()


@register("u3_set_intersection", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def u3(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(read(spark, sf, "supplier").select("s_nationkey"))


@register("u4_set_difference", "SELECT doc_id AS k FROM documents EXCEPT SELECT doc_id FROM labels")
def u4(spark, sf):
    return read(spark, sf, "documents").select(F.col("doc_id").alias("k")).distinct().join(read(spark, sf, "labels").select(F.col("doc_id").alias("k")), "k", "left_anti")

"""Property graph: lookups, traversal, paths, cycles, coupling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import like_text
from ..sources.sinks import written

#: Edge types that dependency traversal follows; "extends" means "inherits".
DEPENDENCIES = ("calls", "imports", "inherits")


def upserted(current: DataFrame, new: DataFrame, key: str = "node_id", keep_old: tuple[str, ...] = ()) -> DataFrame:
    """Last writer wins by key; ``keep_old`` columns fall back to the old value where the new one is null.

    Among new rows with one key the one with the greatest ``updated_at`` counts.
    """
    latest = new.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc("updated_at"), F.desc(F.xxhash64(*new.columns))))).where("_n = 1").drop("_n")
    old = current.select(key, *[F.col(c).alias(f"_old_{c}") for c in keep_old])
    merged = latest.join(old, key, "left").select(*[F.coalesce(c, f"_old_{c}").alias(c) if c in keep_old else F.col(c) for c in current.columns])
    return current.join(latest.select(key), key, "left_anti").select(*current.columns).unionByName(merged)


def with_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame, dedupe: bool = True) -> DataFrame:
    """Edges with the new ones whose ends exist; an edge of the same ends and type once unless ``dedupe`` is off."""
    ids = nodes.select("node_id")
    valid = new.join(ids, new["source_id"] == ids["node_id"], "left_semi").join(ids, F.col("target_id") == ids["node_id"], "left_semi")
    both = edges.unionByName(valid.select(*edges.columns))
    return both.dropDuplicates(["source_id", "target_id", "type"]) if dedupe else both


def without_file(table: DataFrame, path: str) -> DataFrame:
    return table.where(~F.col("file_path").eqNullSafe(F.lit(path)))


def without_project(table: DataFrame, project: str) -> DataFrame:
    return table.where(F.col("file_path").isNull() | ~F.startswith("file_path", F.lit(project + "/")))


def by_name(nodes: DataFrame, name: str, exact: bool = True, sqlite_like: bool = False) -> DataFrame:
    return nodes.where(F.col("name") == name if exact else like_text(F.col("name"), name, sqlite_like))


def in_project(column: Column, project: str) -> Column:
    """Paths of a project in either stored form."""
    low = F.lower(column)
    return F.startswith(low, F.lit(project.lower() + "/")) | F.startswith(low, F.lit(f"/workspace/{project.lower()}/"))


def symbol_at(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """For each (file_path, line) the first symbol, by line, that covers it.

    A symbol's lines are cut into runs of powers of two, at most two of each
    size, and a line lies in one run of each size: so files with many symbols
    are joined by equal runs, and a run keeps its first symbol only.
    """
    places = places.select("file_path", "line").where("file_path is not null and line is not null").distinct()
    spans = nodes.select("file_path", "node_id", "line_start", "line_end").where("line_end >= line_start")
    spans = spans.join(places.select("file_path").distinct(), "file_path", "left_semi")
    longest = nodes.agg(F.max(F.col("line_end").cast("long") - F.col("line_start") + 1)).first()[0] or 1
    sizes = F.array(*[F.lit(k) for k in range(max(1, longest).bit_length())])
    runs = F.filter(
        F.flatten(
            F.transform(
                sizes,
                # First whole run of this size, and the end of the last; an odd one isn't part of a run of twice the size.
                lambda k: F.transform(
                    F.array(F.struct(_shifted(F.col("line_start").cast("long") + _power(k) - 1, k).alias("a"), _shifted(F.col("line_end").cast("long") + 1, k).alias("b"))),
                    lambda x: F.array(F.when((x["a"] < x["b"]) & (x["a"] % 2 != 0), F.struct(k.alias("size"), x["a"].alias("run"))), F.when((x["a"] < x["b"]) & (x["b"] % 2 != 0), F.struct(k.alias("size"), (x["b"] - 1).alias("run")))),
                )[0],
            )
        ),
        lambda r: r.isNotNull(),
    )
    first = F.min(F.struct("line_start", "node_id")).alias("first")
    own = spans.select("file_path", "line_start", "node_id", F.explode(runs).alias("r")).groupBy("file_path", "r.size", "r.run").agg(first)
    asked = places.select("file_path", "line", F.explode(sizes).alias("size")).withColumn("run", _shifted(F.col("line").cast("long"), F.col("size")))
    return asked.join(own, ["file_path", "size", "run"]).groupBy("file_path", "line").agg(F.min("first")["node_id"].alias("node_id"))


def _power(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


def _shifted(line: Column, k: Column) -> Column:
    return F.call_function("shiftright", line, k)


def find_nodes(nodes: DataFrame, terms: list[str] = (), types: list[str] = (), file_type: str | None = None, directory: str | None = None, project: str | None = None, limit: int | None = 100) -> DataFrame:
    """Nodes by any of the terms in name, path or type, and by all other filters; the first ``limit`` by type and name."""
    out = nodes
    if types:
        out = out.where(F.col("type").isin(*types))
    if terms:
        hit = F.lit(False)
        for t in terms:
            for c in ("name", "file_path", "type"):
                hit = hit | like_text(F.col(c), t)
        out = out.where(hit)
    if file_type:
        out = out.where(F.endswith("file_path", F.lit("." + file_type.lstrip("."))))
    if directory:
        out = out.where(F.contains("file_path", F.lit(directory)))
    if project:
        out = out.where(in_project(F.col("file_path"), project))
    return out.orderBy("type", "name", "node_id").limit(limit) if limit else out


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end among ``ids`` (node_id), each once."""
    ids = ids.select("node_id").distinct()
    a = edges.join(ids, edges["source_id"] == ids["node_id"], "left_semi")
    b = edges.join(ids, edges["target_id"] == ids["node_id"], "left_semi")
    return a.unionByName(b).distinct()


def orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node.

    Edges move once for each end; those without a target, only, move once more,
    so that one without both ends counts once.
    """
    ids = nodes.select("node_id")
    start, end = edges["source_id"] == ids["node_id"], edges["target_id"] == ids["node_id"]
    return edges.join(ids, start, "left_anti").unionByName(edges.join(ids, end, "left_anti").join(ids, start, "left_semi"))


def walk(edges: DataFrame, start: DataFrame, depth: int, forward: bool = True, types: tuple[str, ...] | None = None) -> DataFrame:
    """start_id, node_id, relation, depth: one row for each depth (and type) at which a node is reached.

    Breadth first to a fixed depth: each level is one join with the edges and a
    distinct, so levels never hold more than the nodes reached, however many
    paths lead there.  Edges are pruned to the types before they move.  From the
    second on a level is written, as the next ones read it too.
    """
    if types:
        edges = edges.where(F.col("type").isin(*types))
    near, far = ("source_id", "target_id") if forward else ("target_id", "source_id")
    steps = edges.select(F.col(near).alias("at"), F.col(far).alias("next"), F.col("type").alias("relation")).distinct()
    level = start.select(F.col("node_id").alias("start_id"), F.col("node_id").alias("at")).distinct()
    out = None
    for d in range(1, depth + 1):
        found = level.join(steps, "at").select("start_id", F.col("next").alias("node_id"), "relation", F.lit(d).alias("depth")).distinct()
        if 1 < d < depth:
            found = written(found)
        out = found if out is None else out.unionByName(found)
        level = found.select("start_id", F.col("node_id").alias("at")).distinct()
    return out


def callers(edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    return walk(edges, start, depth, forward=False, types=("calls",))


def dependencies(edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    return walk(edges, start, depth, types=DEPENDENCIES)


def related(nodes: DataFrame, edges: DataFrame, names: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """name, direction, relation, node_id for both directions of every edge at the named nodes."""
    own = nodes.join(names, "name").select("name", F.col("node_id").alias("own"))
    edges = edges.where(F.col("type").isin(*types))
    out = own.join(edges, own["own"] == edges["source_id"]).select("name", F.lit("outgoing").alias("direction"), F.col("type").alias("relation"), F.col("target_id").alias("node_id"))
    into = own.join(edges, own["own"] == edges["target_id"]).select("name", F.lit("incoming").alias("direction"), F.col("type").alias("relation"), F.col("source_id").alias("node_id"))
    return out.unionByName(into)


def relations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, direction, relation, other_id: a row for each relation of each node, and one with nulls for a node without any.

    Rows, not arrays: a hub's relations have no bound.
    """
    out = edges.select(F.col("source_id").alias("node_id"), F.lit("outgoing").alias("direction"), F.col("type").alias("relation"), F.col("target_id").alias("other_id"))
    into = edges.select(F.col("target_id").alias("node_id"), F.lit("incoming").alias("direction"), F.col("type").alias("relation"), F.col("source_id").alias("other_id"))
    return nodes.select("node_id").join(out.unionByName(into), "node_id", "left")


def with_relations(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """Each node with its numbers of outgoing and incoming relations, ``n_outgoing`` and ``n_incoming``, and the first ``most`` of each, sorted, as arrays of type:node, for reports."""

    def side(own: str, other: str, name: str) -> DataFrame:
        rows = edges.select(F.col(own).alias("node_id"), F.concat_ws(":", "type", other).alias("r"))
        shown = rows.withColumn("_n", F.row_number().over(W.partitionBy("node_id").orderBy("r"))).where(F.col("_n") <= most)
        shown = shown.groupBy("node_id").agg(F.array_sort(F.collect_list("r")).alias(name))
        return rows.groupBy("node_id").agg(F.count("*").alias(f"n_{name}")).join(shown, "node_id")

    empty = F.array().cast("array<string>")
    out = nodes.join(side("source_id", "target_id", "outgoing"), "node_id", "left").join(side("target_id", "source_id", "incoming"), "node_id", "left")
    return out.withColumns({c: F.coalesce(c, empty) for c in ("outgoing", "incoming")} | {c: F.coalesce(c, F.lit(0)) for c in ("n_outgoing", "n_incoming")})


def degrees(edges: DataFrame) -> DataFrame:
    """node_id, fan_out, fan_in, instability."""
    both = edges.select(F.col("source_id").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("target_id").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    out = both.groupBy("node_id").agg(F.sum("o").alias("fan_out"), F.sum("i").alias("fan_in"))
    return out.withColumn("instability", F.col("fan_out") / F.greatest(F.col("fan_out") + F.col("fan_in"), F.lit(1)))


def hotspots(edges: DataFrame, least: int = 10) -> DataFrame:
    d = degrees(edges)
    return d.withColumn("connections", F.col("fan_in") + F.col("fan_out")).where(F.col("connections") >= least)


def coupling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per file: symbols, external files reached, internal edges, ratios and advice."""
    own = nodes.select(F.col("node_id").alias("source_id"), F.col("file_path"))
    other = nodes.select(F.col("node_id").alias("target_id"), F.col("file_path").alias("to_file"))
    ends = edges.join(own, "source_id").join(other, "target_id")
    inside = F.col("file_path") == F.col("to_file")
    reach = ends.groupBy("file_path").agg(F.countDistinct(F.when(~inside, F.col("to_file"))).alias("external_files"), F.count_if(inside).alias("internal_edges"))
    out = nodes.groupBy("file_path").agg(F.count("*").alias("symbols")).join(reach, "file_path", "left").na.fill(0, ["external_files", "internal_edges"])
    n = F.greatest("symbols", F.lit(1))
    out = out.withColumns({"coupling": F.col("external_files") / n, "cohesion": F.col("internal_edges") / n})
    advice = F.array_compact(
        F.array(
            F.when(F.col("coupling") > 0.8, "high external coupling"),
            F.when(F.col("cohesion") < 0.3, "low internal cohesion"),
            F.when(F.col("external_files") > 10, "many external dependencies"),
        )
    )
    return out.withColumn("advice", F.when(F.size(advice) == 0, "healthy").otherwise(F.array_join(advice, "; ")))


def paths(edges: DataFrame, start: DataFrame, depth: int, types: tuple[str, ...] | None = None) -> DataFrame:
    """path (array of nodes) of every simple path of up to ``depth`` edges; a last node that is the first closes a cycle.

    The number of paths grows with the degree to the power of ``depth``: meant
    for stated starts and small depths.
    """
    if types:
        edges = edges.where(F.col("type").isin(*types))
    steps = edges.select(F.col("source_id").alias("_at"), F.col("target_id").alias("_next")).distinct()
    level = start.select(F.array("node_id").alias("path"))
    out = None
    for _ in range(depth):
        last, first = F.element_at("path", -1), F.element_at("path", 1)
        open_ = level.where((F.size("path") == 1) | (last != first))
        level = open_.join(steps, last == F.col("_at")).where(~F.array_contains("path", F.col("_next")) | (F.col("_next") == first)).select(F.concat("path", F.array("_next")).alias("path"))
        out = level if out is None else out.unionByName(level)
    return out


def call_paths(edges: DataFrame, start: DataFrame, goal: DataFrame, depth: int = 5) -> DataFrame:
    """Simple paths from a start to a goal."""
    found = paths(edges, start, depth, ("calls",))
    goals = goal.select(F.col("node_id").alias("_goal")).distinct()
    return found.join(goals, F.element_at("path", -1) == F.col("_goal"), "left_semi")


def cycles(edges: DataFrame, depth: int = 5, types: tuple[str, ...] | None = None) -> DataFrame:
    """Each cycle of up to ``depth`` nodes once, from its smallest node, as a text with arrows.

    A path only goes to nodes that are not smaller than its start, which leaves
    one rotation of each cycle.
    """
    if types:
        edges = edges.where(F.col("type").isin(*types))
    steps = edges.select(F.col("source_id").alias("_at"), F.col("target_id").alias("_next")).distinct()
    level = steps.where("_next >= _at").select(F.array("_at", "_next").alias("path"))
    out = level.where(F.element_at("path", 1) == F.element_at("path", -1))
    for _ in range(depth - 1):
        last, first = F.element_at("path", -1), F.element_at("path", 1)
        level = level.where(last != first).join(steps, last == F.col("_at")).where((F.col("_next") >= first) & (~F.array_contains("path", F.col("_next")) | (F.col("_next") == first))).select(F.concat("path", F.array("_next")).alias("path"))
        out = out.unionByName(level.where(F.element_at("path", 1) == F.element_at("path", -1)))
    return out.select(F.array_join("path", " > ").alias("cycle"), (F.size("path") - 1).alias("length"))


def chains(edges: DataFrame, depth: int = 5, kind: str = "inherits") -> DataFrame:
    """Longest chains from each node that nothing points to, along one type."""
    e = edges.where(F.col("type") == kind)
    roots = e.select(F.col("source_id").alias("node_id")).distinct().join(e.select(F.col("target_id").alias("node_id")), "node_id", "left_anti")
    all_paths = paths(e, roots, depth)
    ended = all_paths.join(e.select("source_id").distinct(), F.element_at("path", -1) == F.col("source_id"), "left_anti")
    return ended.unionByName(all_paths.where(F.size("path") == depth + 1)).distinct()


def dependency_report(nodes: DataFrame, edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """Per start: direct and all dependencies, dependents, fan-in and fan-out and instability."""
    down, up = dependencies(edges, start, depth), walk(edges, start, depth, forward=False, types=DEPENDENCIES)
    d = down.groupBy("start_id").agg(F.countDistinct(F.when(F.col("depth") == 1, F.col("node_id"))).alias("direct"), F.countDistinct("node_id").alias("transitive"))
    u = up.where("depth = 1").groupBy("start_id").agg(F.countDistinct("node_id").alias("dependents"))
    ids = start.select(F.col("node_id").alias("start_id")).distinct()
    out = ids.join(d, "start_id", "left").join(u, "start_id", "left").na.fill(0)
    return out.withColumn("instability", F.col("direct") / F.greatest(F.col("direct") + F.col("dependents"), F.lit(1)))


def same_file(nodes: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """start_id, node_id: the first ``most`` other symbols of the file of each start."""
    own = nodes.join(start.select("node_id").distinct(), "node_id").select(F.col("node_id").alias("start_id"), "file_path")
    near = own.join(nodes.select("file_path", "node_id", "line_start"), "file_path").where("node_id <> start_id")
    return near.withColumn("_n", F.row_number().over(W.partitionBy("start_id").orderBy("line_start", "node_id"))).where(F.col("_n") <= most).select("start_id", "node_id")


def neighbourhood(nodes: DataFrame, edges: DataFrame, start: DataFrame, depth: int = 2, siblings: int = 8, deps: int = 10) -> DataFrame:
    """start_id, arm, node_id: callers, call targets, dependencies, inheritance, imports and symbols of the same file."""
    hop = lambda kind, forward: walk(edges, start, 1, forward, (kind,))
    arms = [
        ("caller", callers(edges, start, depth), None),
        ("call target", hop("calls", True), None),
        ("dependency", dependencies(edges, start, depth), deps),
        ("inheritance", hop("inherits", True), None),
        ("import", hop("imports", True), None),
    ]
    out = same_file(nodes, start, siblings).withColumn("arm", F.lit("sibling")).select("start_id", "arm", "node_id")
    for name, rows, most in arms:
        rows = rows.groupBy("start_id", "node_id").agg(F.min("depth").alias("depth"))
        if most:
            rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("start_id").orderBy("depth", "node_id"))).where(F.col("_n") <= most)
        out = out.unionByName(rows.select("start_id", F.lit(name).alias("arm"), "node_id"))
    return out


def ancestors(rows: DataFrame, depth: int = 10) -> DataFrame:
    """chunk_id, ancestor_id, distance over (chunk_id, parent_id)."""
    up = rows.select(F.col("chunk_id").alias("_at"), F.col("parent_id").alias("_up")).where("parent_id is not null")
    level = rows.where("parent_id is not null").select("chunk_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("distance"))
    out = level
    for d in range(2, depth + 1):
        level = level.join(up, F.col("ancestor_id") == F.col("_at")).select("chunk_id", F.col("_up").alias("ancestor_id"), F.lit(d).alias("distance"))
        out = out.unionByName(level)
    return out


def common_ancestor(rows: DataFrame, pairs: DataFrame, depth: int = 10) -> DataFrame:
    """For pairs (a, b) the nearest common ancestor, if there is one.

    Pairs that have the same parents have the same answer, so only different
    pairs of parents are looked at, and only these parents' ancestors; levels
    end where there are no more.
    """
    up = rows.select(F.col("chunk_id").alias("_at"), F.col("parent_id").alias("_up")).where("_at is not null and _up is not null")
    ends = pairs.join(up.select(F.col("_at").alias("a"), F.col("_up").alias("pa")), "a").join(up.select(F.col("_at").alias("b"), F.col("_up").alias("pb")), "b")
    ends = written(ends.select("a", "b", "pa", "pb"))
    few = written(ends.select("pa", "pb").distinct())
    level = few.select(F.explode(F.array("pa", "pb")).alias("parent")).distinct().select("parent", F.col("parent").alias("ancestor_id"), F.lit(0).alias("distance"))
    every = level
    for d in range(1, depth):
        level = written(level.join(up, F.col("ancestor_id") == F.col("_at")).select("parent", F.col("_up").alias("ancestor_id"), F.lit(d).alias("distance")).distinct())
        if level.isEmpty():
            break
        every = every.unionByName(level)
    a = every.select(F.col("parent").alias("pa"), "ancestor_id", F.col("distance").alias("da"))
    b = every.select(F.col("parent").alias("pb"), "ancestor_id", F.col("distance").alias("db"))
    order = F.struct((F.col("da") + F.col("db")).alias("steps"), "ancestor_id")
    near = few.join(a, "pa").join(b, ["pb", "ancestor_id"]).groupBy("pa", "pb").agg(F.min(order).alias("nearest"))
    return ends.join(written(near), ["pa", "pb"]).groupBy("a", "b").agg(F.min("nearest")["ancestor_id"].alias("ancestor_id"))

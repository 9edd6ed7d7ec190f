"""The engine's tables over a data folder, and the same tables as SQL.

The driver's folder has no source code, so files, chunks and a property graph
are derived from its tables; each function has its SQL beside it in ``CTE``.
"""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from ..operators import bm25

CHUNK = 400

#: Node kinds: table, key, type, name, file path, first line.
_KINDS = (
    ("region", "r_regionkey", "module", "r_name", "concat('core/region/', r_regionkey, '.py')", "1"),
    ("nation", "n_nationkey", "class", "n_name", "concat('core/nation/', n_regionkey, '.py')", "n_nationkey * 10 + 1"),
    ("customer", "c_custkey", "function", "c_name", "concat('app/customer/', c_nationkey, '.py')", "c_custkey * 10 + 1"),
    ("supplier", "s_suppkey", "function", "s_name", "concat('app/supplier/', s_nationkey, '.py')", "s_suppkey * 10 + 1"),
    ("part", "p_partkey", "variable", "p_name", "concat('lib/part/', p_size, '.py')", "p_partkey * 10 + 1"),
    ("orders", "o_orderkey", "method", "concat('order_', o_orderkey)", "concat('jobs/orders/', o_custkey, '.py')", "o_orderkey * 10 + 1"),
)
#: Edge kinds: table, source kind and key, target kind and key, type.
_LINKS = (
    ("orders", "orders", "o_orderkey", "customer", "o_custkey", "calls"),
    ("customer", "customer", "c_custkey", "nation", "c_nationkey", "imports"),
    ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "imports"),
    ("nation", "nation", "n_nationkey", "region", "n_regionkey", "inherits"),
    ("lineitem", "orders", "l_orderkey", "part", "l_partkey", "uses"),
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task that makes a file of each.
TASK_ROWS = 10_000


def spread(rows: DataFrame) -> DataFrame:
    """Short rows from which files are made, in tasks of about ``TASK_ROWS``: by their bytes, millions would lie in one task."""
    tasks = -(-rows.count() // TASK_ROWS)
    return rows.repartition(tasks) if tasks > 1 else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, file_path, text."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id"), F.lit(".txt"))).alias("file_path"), "text")


#: Saved indexes of this session, by the state of the files that they were built from.
_indexes: dict[tuple, str] = {}


def search_index(spark: SparkSession, sf_dir: str) -> bm25.Index:
    """The saved keyword index of a folder's documents, built where it is missing or older than they are."""
    from ..operators import bm25
    from ..sources.sinks import scratch

    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, listed = [], store.listFiles(place, True)
    while listed.hasNext():
        f = listed.next()
        found.append((str(f.getPath()), f.getModificationTime(), f.getLen()))
    state = tuple(sorted(found))
    key = (spark.sparkContext.applicationId, state)
    if key not in _indexes:
        path = scratch(spark)
        bm25.build(documents(spark, sf_dir)).save(path)
        _indexes[key] = path
    return bm25.Index.load(spark, _indexes[key])


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, project, file_path, size, content, modified of every document."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.col("source").alias("project"),
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id"), F.lit(".txt"))).alias("file_path"),
        F.octet_length("text").cast("long").alias("size"),
        F.col("text").alias("content"),
        F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int), 0)").alias("modified"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, doc_id, project, file_path, position, text: windows of ``CHUNK`` characters."""
    from ..operators.chunking import fixed_chunks

    f = files(spark, sf_dir).select("doc_id", "project", "file_path", F.col("content").alias("text"))
    return fixed_chunks(f, CHUNK).withColumn("chunk_id", F.col("doc_id") * 100_000_000 + F.col("position"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, type, name, file_path, line_start, line_end."""
    parts = [
        read(spark, sf_dir, table).selectExpr(f"concat('{table}:', {key}) AS node_id", f"'{kind}' AS type", f"{name} AS name", f"{path} AS file_path", f"cast({line} AS int) AS line_start", f"cast({line} + 9 AS int) AS line_end")
        for table, key, kind, name, path, line in _KINDS
    ]
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, target_id, type; an edge once."""
    parts = []
    for table, a, ak, b, bk, kind in _LINKS:
        keys = read(spark, sf_dir, table)
        # By their keys, which are shorter than what is made of them.
        keys = keys.select(ak, bk).distinct() if table == "lineitem" else keys
        parts.append(keys.selectExpr(f"concat('{a}:', {ak}) AS source_id", f"concat('{b}:', {bk}) AS target_id", f"'{kind}' AS type"))
    return reduce(DataFrame.unionByName, parts)


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small cyclic graph: which event type follows which for one user."""
    from pyspark.sql import Window as W

    e = read(spark, sf_dir, "events")
    after = F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("event_type").alias("source_id"), after.alias("target_id")).where("target_id is not null").distinct().select("source_id", "target_id", F.lit("calls").alias("type"))


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


#: Each table as one common table expression.
CTE = {
    "files": "files AS (SELECT doc_id, source AS project, source || '/' || lang || '/' || doc_id || '.txt' AS file_path, CAST(octet_length(encode(text)) AS BIGINT) AS size, text AS content, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS INT)) AS modified FROM documents)",
    "chunks": f"chunks AS (SELECT doc_id * 100000000 + i AS chunk_id, doc_id, source AS project, source || '/' || lang || '/' || doc_id || '.txt' AS file_path, CAST(i AS INT) AS position, substring(text, CAST(i * {CHUNK} + 1 AS BIGINT), {CHUNK}) AS text FROM documents, unnest(range(0, CAST(ceil(length(text) / {CHUNK}.0) AS BIGINT))) AS r(i))",
    "nodes": "nodes AS (" + _union([f"SELECT '{t}:' || {k} AS node_id, '{kind}' AS type, {name} AS name, {path} AS file_path, CAST({line} AS INT) AS line_start, CAST({line} + 9 AS INT) AS line_end FROM {t}" for t, k, kind, name, path, line in _KINDS]) + ")",
    "edges": "edges AS (" + _union([f"SELECT {'DISTINCT ' if t == 'lineitem' else ''}'{a}:' || {ak} AS source_id, '{b}:' || {bk} AS target_id, '{kind}' AS type FROM {t}" for t, a, ak, b, bk, kind in _LINKS]) + ")",
    "transitions": "transitions AS (SELECT DISTINCT source_id, target_id, 'calls' AS type FROM (SELECT event_type AS source_id, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target_id FROM events) WHERE target_id IS NOT NULL)",
}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """``body`` with the named tables before it; ``body`` may begin with further expressions and a comma-free WITH."""
    head = ", ".join(CTE[n] for n in names)
    if body.lstrip().upper().startswith("WITH "):
        body = ", " + body.lstrip()[5:]
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{body if body.startswith(',') else ' ' + body}"

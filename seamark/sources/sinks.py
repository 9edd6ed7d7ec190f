"""Index datasets: written by project, replaced project by project, read back."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import project_of


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, removed when the driver's Python ends.

    It lies in ``spark.checkpoint.dir``; where that is unset, in the warehouse, on a single machine only.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    path = f"{base}/{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended, and with it the way to the folder
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in ``scratch``: joins that read it can split its hot keys, and nothing below is computed again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of one Arrow batch that goes to Python.
BATCH_BYTES = 16 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """Keeps Arrow batches of long rows small, so that one fits a worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def sent(df: DataFrame, most: int) -> DataFrame:
    """``df`` as a broadcast side if it has at most ``most`` rows, which is measured, else as a written table."""
    rows = df.limit(most + 1).toArrow()
    if rows.num_rows > most:
        return written(df)
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def write_by_project(table: DataFrame, path: str) -> None:
    """Replaces the projects that ``table`` (with file_path) has, and no other."""
    out = table.withColumn("project", F.coalesce(project_of(F.col("file_path")), F.lit("none")))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(path)


def read_fresh(spark: SparkSession, path: str) -> DataFrame:
    """The table as it is now, whatever the session has listed before."""
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(path)


def write_index(files: DataFrame, path: str) -> dict[str, str]:
    """Chunks, nodes, edges, postings, documents and projects of (file_path, content) below ``path``; their places by name."""
    from ..operators import bm25, chunking, extract

    spark = files.sparkSession
    places = {k: f"{path}/{k}" for k in ("chunks", "nodes", "edges", "postings", "documents", "projects")}
    write_by_project(chunking.code_chunks(files), places["chunks"])
    chunks = spark.read.parquet(places["chunks"])
    nodes, edges = extract.graph_of(chunks)
    nodes.write.mode("overwrite").parquet(places["nodes"])
    edges.write.mode("overwrite").parquet(places["edges"])
    index = bm25.build(chunks.select(F.xxhash64("file_path", "start_line", "text").alias("doc_id"), "file_path", "text"))
    index.postings.write.mode("overwrite").parquet(places["postings"])
    index.documents.write.mode("overwrite").parquet(places["documents"])
    chunks.groupBy("project").agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("chunks")).write.mode("overwrite").parquet(places["projects"])
    return places


def write_golden(golden: DataFrame, path: str) -> None:
    """JSON lines of (query_id, category, doc_id), a line for each document that a question should find."""
    golden.select("query_id", "category", "doc_id").write.mode("overwrite").json(path)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """query_id, category, doc_id of a golden set in JSON lines; lists of documents under ``expected`` are read too."""
    rows = spark.read.schema("query_id long, category string, doc_id long, expected array<long>").json(path)
    return rows.select("query_id", "category", F.explode(F.coalesce("expected", F.array("doc_id"))).alias("doc_id"))


def followed(paths: DataFrame, links: DataFrame, depth: int = 5) -> DataFrame:
    """The files that paths lead to by links (link, target), each once; a circle leads nowhere, nor does a link whose target is null."""
    out = paths.select(F.col("file_path").alias("_at"))
    step = links.select(F.col("link").alias("_link"), F.col("target").alias("_target"))
    for _ in range(depth):
        out = out.join(step, F.col("_at") == F.col("_link"), "left").select(F.coalesce("_target", "_at").alias("_at"))
    return out.join(step, F.col("_at") == F.col("_link"), "left_anti").select(F.col("_at").alias("file_path")).distinct()

"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: bounds what a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Keeps Arrow batches small, so that a batch of long texts fits a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


#: What a worker process keeps from task to task of one kind.
_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """A worker's own object, made once and kept while tasks of the same kind follow each other (see ``map_batches``)."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def drop_kept(but: object = None) -> None:
    for key in [k for k in _kept if k != but]:
        del _kept[key]


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keeps: object = None) -> DataFrame:
    """``mapInArrow`` over bounded batches; a worker gives back its free memory when a task ends.

    Workers live on from task to task and from stage to stage, and the allocator
    and Arrow's pool keep what they once had.  ``keeps`` is the one key of
    ``kept`` that these tasks go on with; a worker drops all others first.
    """
    bounded_batches(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept(keeps)
        try:
            yield from run(batches)
        finally:
            release_memory()

    return df.mapInArrow(task, schema)


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """Maps whole Arrow batches to batches of ``schema``.

    ``make`` runs once in each task and returns a function from a batch to a
    dict of columns (lists or arrays) in any order.
    """
    arrow = to_arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if out := step(batch):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return map_batches(df, run, schema)


def to_arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema as convert
    from pyspark.sql.types import StructType

    return convert(StructType.fromDDL(schema))


def written(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table in the folder that the cluster shares, and reads it back.

    This cuts the lineage: losing executors afterwards costs no recomputation,
    and readers get single columns.  Shuffle files of the finished plan are let
    go.  ``freed`` removes the table after its last reader.
    """
    spark = df.sparkSession
    path, schema = shared_path(spark), df.schema
    df.write.parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    table = spark.read.schema(schema).parquet(path)
    table._written_to = path
    return table


def freed(*tables: DataFrame | None) -> None:
    """Removes tables of ``written`` that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_written_to", None):
            _remove(t.sparkSession, path)


def shared_path(spark: SparkSession, name: str = "") -> str:
    """A new path in the shared folder, which is removed when the driver's Python ends."""
    path = f"{shared_folder(spark)}/{name}{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended, and with it the way to the folder
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, a folder of the warehouse, on a single machine only."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def only(df: DataFrame, *names: str) -> DataFrame:
    """Exactly these columns, whatever others the table has."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def texts(column: pa.Array) -> list[str]:
    """A text column's values with null as empty."""
    return [x or "" for x in column.to_pylist()]

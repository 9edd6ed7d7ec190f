"""Embeddings by a model that the caller brings, and a memo of what models have computed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import bounded_batches

#: A model takes texts and gives a row of numbers for each.
Model = Callable[[list[str]], np.ndarray]
#: Texts and characters that a model gets at once.
TEXTS, CHARACTERS = 64, 1 << 18

#: The model that a worker has loaded, by its name.
_loaded: dict[str, Model] = {}


def _model(name: str, load: Callable[[], Model]) -> Model:
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = load()
    return _loaded[name]


def by_length(texts: list[str], count: int = TEXTS, characters: int = CHARACTERS) -> Iterator[list[int]]:
    """Places of texts of about one length, so that a model pads little; a longer text comes alone."""
    some: list[int] = []
    for i in sorted(range(len(texts)), key=lambda i: len(texts[i])):
        # The last is the longest, and as long as all are padded to.
        if some and (len(some) == count or (len(some) + 1) * len(texts[i]) > characters):
            yield some
            some = []
        some.append(i)
    if some:
        yield some


def embed(texts: list[str], model: Model, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and which texts failed: these, empty texts and vectors that aren't finite have zeros.

    A batch that fails is tried text by text, so that one text spoils no other.
    """
    out, failed = np.zeros((len(texts), width), np.float32), np.zeros(len(texts), bool)

    def run(some: list[int]) -> None:
        try:
            found = np.asarray(model([texts[i] for i in some]), np.float64)
            if found.shape != (len(some), width):
                raise ValueError(f"a model gave {found.shape}, not {(len(some), width)}")
        except Exception:  # whatever a model raises
            if len(some) == 1:
                failed[some] = True
            else:
                for i in some:
                    run([i])
            return
        norm = np.linalg.norm(found, axis=1, keepdims=True)
        fine = np.isfinite(norm[:, 0])
        failed[[i for i, ok in zip(some, fine) if not ok]] = True
        out[some] = np.where(fine[:, None] & (norm > 0), found / np.where(norm > 0, norm, 1), 0)

    some = [i for i, t in enumerate(texts) if t]
    for places in by_length([texts[i] for i in some]):
        run([some[i] for i in places])
    return out, failed


def embeddings(texts: DataFrame, key: str, name: str, load: Callable[[], Model], width: int, prefix: str = "") -> DataFrame:
    """``key``, embedding, failed of (``key``, text) by the model that ``load`` makes, once in each worker.

    ``name`` tells models apart; ``prefix`` goes before every text, as some
    models ask for it before questions.  A null or empty text has zeros.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = texts.select(key, F.array().cast("array<float>").alias("embedding"), F.lit(False).alias("failed")).schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(name, load)
        for batch in batches:
            found, failed = embed([prefix + t if t else "" for t in batch.column(1).to_pylist()], model, width)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * width), pa.array(found.ravel())).cast(arrow.field(1).type)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), rows, pa.array(failed)], schema=arrow)

    return bounded_batches(texts.select(key, "text")).mapInArrow(run, out)


class Memo:
    """What models have computed, by a text's digest and the model's name, as a table below ``path``.

    A run computes what isn't there and writes it in a folder named by what it
    computes, so that a run that is repeated replaces itself; should two runs
    compute the same at once, a key counts once.
    """

    def __init__(self, path: str, schema: str):
        """``schema`` is that of the values, as DDL."""
        self.path, self.values = path, schema

    def stored(self, like: DataFrame) -> DataFrame:
        """key, model and values of all that was computed."""
        spark = like.sparkSession
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        schema = f"key string, {self.values}, model string, run string"
        if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return spark.createDataFrame([], schema)
        spark.catalog.refreshByPath(self.path)
        return spark.read.schema(schema).parquet(self.path)

    def keyed(self, texts: DataFrame) -> DataFrame:
        return texts.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))

    def missing(self, texts: DataFrame, model: str) -> DataFrame:
        """key, text of the different texts that ``model`` hasn't seen."""
        new = self.keyed(texts.select("text")).join(self.stored(texts).where(F.col("model") == model).select("key"), "key", "left_anti")
        return new.groupBy("key").agg(F.any_value("text").alias("text"))

    def take(self, texts: DataFrame, model: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``texts`` (with a text) and what ``model`` makes of each; ``compute`` gets (key, text) of what is missing and returns (key, values)."""
        new = self.missing(texts, model)
        count, digest = new.agg(F.count("*"), F.sum(F.xxhash64("key").cast("decimal(38,0)"))).first()
        if count:
            compute(new).write.mode("overwrite").parquet(f"{self.path}/model={model}/run={count}x{int(digest) & (1 << 64) - 1:x}")
        known = self.stored(texts).where(F.col("model") == model).drop("model", "run").dropDuplicates(["key"])
        return self.keyed(texts).join(known, "key", "left")

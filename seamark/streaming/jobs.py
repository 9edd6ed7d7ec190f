"""Structured Streaming: incremental indexing, monitoring, de-duplication, session state."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The last values that a moving average of doubles can tell apart from none.
LAST_VALUES = 400
#: State that is kept on disk, with timers and changes of single values.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, path: str, schema, per_trigger: int | None = 1) -> DataFrame:
    """Files of events as they arrive, ``per_trigger`` at a time or all that are there."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def with_end(events: DataFrame, after: str) -> DataFrame:
    """The events and a row ``after`` the last, without other values: windows before it are complete."""
    end = events.agg((F.max("ts") + F.expr(f"interval {after}")).alias("ts"))
    return events.unionByName(end, allowMissingColumns=True)


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start in here keep their state in RocksDB."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def sampled(events: DataFrame, width: str = "30 seconds", late: str = "5 minutes") -> DataFrame:
    """Count, mean and greatest value of each type in tumbling windows; later events than ``late`` are dropped."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most")).select(F.col("window.start").alias("start"), "event_type", "n", "mean", "most")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events of each user's sessions."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w, "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def once(events: DataFrame, key: list[str], within: str = "300 seconds") -> DataFrame:
    """The first event of a key within a time."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(key)


def moving_averages(events: DataFrame, keep: float = 0.9) -> DataFrame:
    """event_type, n, ema after each batch, from state by type.

    A task holds the last ``LAST_VALUES`` of a type's values in a batch; what is
    older weighs less than a double can tell.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ema = state.get if state.exists else (0, 0.0)
        last, arrived = pd.DataFrame(columns=["event_type", "ts", "event_id", "value"]), 0
        for rows in batches:
            arrived += len(rows)
            last = (rows if last.empty else pd.concat([last, rows])).sort_values(["ts", "event_id"]).tail(LAST_VALUES)
        for v in last["value"]:
            ema = float(v) if n == 0 else keep * ema + (1 - keep) * float(v)
            n += 1
        n += arrived - len(last)
        state.update((n, ema))
        yield pd.DataFrame({"event_type": [key[0]], "n": [n], "ema": [ema]})

    return events.select("event_type", "ts", "event_id", "value").groupBy("event_type").applyInPandasWithState(step, "event_type string, n long, ema double", "n long, ema double", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream has emitted when all that is there has arrived; state and results, a folder for each batch, lie below ``folder``.

    Rows are appended once they are final, and their state is let go; a batch
    that is repeated after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/result").select(*stream.columns)

"""Monitoring: caches, tools, sessions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def moving_average(events: DataFrame, by: str, value: str, order: tuple[str, ...], keep: float = 0.9) -> DataFrame:
    """by, ema: the last exponential moving average of each key; the first value is taken as it is.

    An average of n ordered values is a weighted sum: weight (1 - keep) * keep
    ** (values after it).  Beyond as many values as it takes for that to fall
    below 2 ** -60, a double's last bit, nothing changes any more; so each task
    keeps a key's last ones, and only these are brought together.
    """
    most = max(1, math.ceil(60 * math.log(2) / -math.log(keep)))
    last = F.row_number().over(W.partitionBy(by).orderBy(*[F.desc(c) for c in order]))
    rows = events.select(by, value, last.alias("_place")).where(F.col("_place") <= most)
    counts = events.groupBy(by).agg(F.count("*").alias("_n"))
    weight = F.pow(F.lit(keep), F.col("_place") - 1) * F.when(F.col("_place") == F.col("_n"), 1.0).otherwise(1 - keep)
    return rows.join(counts, by).groupBy(by).agg(F.sum(weight * F.col(value)).alias("ema"))


def effectiveness(rows: DataFrame) -> DataFrame:
    """Rows with hits, misses, errors, saved_ms: hit_rate, error_rate and effectiveness of 0 to 100."""
    n = F.greatest(F.col("hits") + F.col("misses"), F.lit(1))
    out = rows.withColumns({"hit_rate": 100.0 * F.col("hits") / n, "error_rate": 100.0 * F.col("errors") / n})
    score = F.col("hit_rate") - F.col("error_rate") + F.least(F.col("saved_ms") / 1000.0, F.lit(10.0))
    return out.withColumn("effectiveness", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def trend(samples: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Each key's newest value against its fifth newest: improving or degrading beyond five points, else stable."""
    place = F.row_number().over(W.partitionBy(by).orderBy(F.desc(order)))
    rows = samples.withColumn("_p", place).where("_p in (1, 5)").groupBy(by).agg(F.max(F.when(F.col("_p") == 1, F.col(value))).alias("new"), F.max(F.when(F.col("_p") == 5, F.col(value))).alias("old"))
    gain = F.col("new") - F.coalesce("old", "new")
    return rows.select(by, F.when(gain > 5, "improving").when(gain < -5, "degrading").otherwise("stable").alias("trend"), F.col("new").alias("latest"))


def health(rows: DataFrame) -> DataFrame:
    """Rows with hit_rate, trend, mb: a score of 0 to 100."""
    score = F.least("hit_rate", F.lit(100.0)) + F.when(F.col("trend") == "improving", 20).when(F.col("trend") == "stable", 10).otherwise(-10) - F.greatest(F.lit(0.0), (F.col("mb") - 100) / 10)
    return rows.withColumn("health", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def tool_report(events: DataFrame, days: int) -> DataFrame:
    """tool, n, mean, least, most, success over the last ``days`` before the newest event (tool, ts, value, ok)."""
    newest = events.agg(F.max("ts").alias("_now"))
    rows = events.crossJoin(F.broadcast(newest)).where(F.col("ts") >= F.col("_now") - F.make_dt_interval(F.lit(days)))
    return rows.groupBy("tool").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), (F.count_if("ok") / F.count("*")).alias("success"))


def timing(events: DataFrame) -> DataFrame:
    """operation, mean, share of the whole time, and whether that is over a tenth."""
    rows = events.groupBy("operation").agg(F.avg("value").alias("mean"), F.sum("value").alias("total"))
    share = F.col("total") / F.sum("total").over(W.partitionBy())
    return rows.select("operation", "mean", share.alias("share"), (share > 0.1).alias("bottleneck"))


def rolling_memory(turns: DataFrame, recent: int = 10) -> DataFrame:
    """conv_id, recent turns, older turns, characters of the older: the last ``recent`` turns stay whole."""
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    rows = turns.withColumn("_p", place)
    return rows.groupBy("conv_id").agg(F.count_if(F.col("_p") <= recent).alias("recent"), F.count_if(F.col("_p") > recent).alias("older"), F.coalesce(F.sum(F.when(F.col("_p") > recent, F.length("text"))), F.lit(0)).cast("long").alias("older_chars"))


def context_health(turns: DataFrame, window: int = 65_536) -> DataFrame:
    """conv_id, tokens, use in percent, band."""
    from ..functions.text import token_estimate

    out = turns.groupBy("conv_id").agg(F.sum(token_estimate(F.coalesce("text", F.lit("")))).alias("tokens"))
    out = out.withColumn("used", 100.0 * F.col("tokens") / window)
    return out.withColumn("band", F.when(F.col("used") > 90, "critical").when(F.col("used") > 70, "warning").otherwise("healthy"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, session start and end, events."""
    w = F.session_window("ts", gap)
    return events.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once_per_ttl(events: DataFrame, key: tuple[str, ...], seconds: int = 300) -> DataFrame:
    """Events that a cache of this lifetime would compute: those with none of their key within the time before.

    An entry counts from the event before it, hit or not.
    """
    before = F.lag("ts").over(W.partitionBy(*key).orderBy("ts", "event_id"))
    return events.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("ts") >= F.col("_before") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds)))).drop("_before")


def after_eviction(entries: DataFrame, by: str, order: tuple[str, ...], share: float = 0.1) -> DataFrame:
    """What stays of each cache when the oldest ``share`` of its entries, rounded up, goes."""
    w = W.partitionBy(by)
    return entries.withColumns({"_n": F.count("*").over(w), "_p": F.row_number().over(w.orderBy(*order))}).where(F.col("_p") > F.ceil(F.col("_n") * share)).drop("_n", "_p")


def signatures(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, signature: changes when a value is added, removed or altered, whatever the order.

    Sums of two parts of each value's digest, and their count: a state of three
    numbers, so that any number of values aggregates map-side.
    """
    part = lambda a: F.conv(F.substring(F.md5(F.col(value)), a, 12), 16, 10).cast("decimal(20,0)")
    out = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(part(1)).alias("a"), F.sum(part(13)).alias("b"))
    return out.select(by, F.sha2(F.concat_ws(":", "n", "a", "b"), 256).alias("signature"))

"""Queries of monitoring and of what streams compute, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import embedding, metrics
from ..sources.sinks import scratch, written
from ..streaming import jobs, ttl
from .registry import register
from .tables import read


@register("a18_tool_report", "WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_type AS tool, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(count(*) FILTER (WHERE value < 50) / count(*), 6) AS success FROM events, m WHERE ts >= now - INTERVAL 7 DAY GROUP BY event_type")
def a18(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_type").alias("tool"), "ts", "value", (F.col("value") < 50).alias("ok"))
    return metrics.tool_report(e, 7).withColumns({"mean": F.round("mean", 6), "success": F.round("success", 6)})


_CACHE = "SELECT event_type AS layer, count(*) FILTER (WHERE value >= 20) AS hits, count(*) FILTER (WHERE value < 20) AS misses, count(*) FILTER (WHERE value < 2) AS errors, sum(value) AS saved_ms FROM events GROUP BY event_type"


def _cache(spark, sf):
    return read(spark, sf, "events").groupBy(F.col("event_type").alias("layer")).agg(F.count_if(F.col("value") >= 20).alias("hits"), F.count_if(F.col("value") < 20).alias("misses"), F.count_if(F.col("value") < 2).alias("errors"), F.sum("value").alias("saved_ms"))


@register("a19_cache_effectiveness", f"WITH c AS ({_CACHE}) SELECT layer, hits, misses, round(100.0 * hits / (hits + misses), 6) AS hit_rate, round(greatest(0, least(100, 100.0 * hits / (hits + misses) - 100.0 * errors / (hits + misses) + least(saved_ms / 1000, 10))), 6) AS effectiveness FROM c")
def a19(spark, sf):
    return metrics.effectiveness(_cache(spark, sf)).select("layer", "hits", "misses", F.round("hit_rate", 6).alias("hit_rate"), F.round("effectiveness", 6).alias("effectiveness"))


@register("a20_moving_average", "WITH RECURSIVE o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(sum(value * power(0.9::DOUBLE, n - i) * CASE WHEN i = 1 THEN 1 ELSE 0.1 END), 6) AS ema FROM o GROUP BY event_type")
def a20(spark, sf):
    return metrics.moving_average(read(spark, sf, "events"), "event_type", "value", ("ts", "event_id")).withColumn("ema", F.round("ema", 6))


_TREND = "WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS p FROM events), t AS (SELECT event_type, max(value) FILTER (WHERE p = 1) AS latest, coalesce(max(value) FILTER (WHERE p = 5), max(value) FILTER (WHERE p = 1)) AS old FROM o GROUP BY event_type)"


@register("w7_trend", _TREND + " SELECT event_type, latest, CASE WHEN latest - old > 5 THEN 'improving' WHEN latest - old < -5 THEN 'degrading' ELSE 'stable' END AS trend FROM t")
def w7(spark, sf):
    return metrics.trend(read(spark, sf, "events"), "event_type", "event_id", "value")


@register("a21_health", _TREND + " SELECT event_type, round(greatest(0, least(100, least(latest, 100) + CASE WHEN latest - old > 5 THEN 20 WHEN latest - old < -5 THEN -10 ELSE 10 END - 5)), 6) AS health FROM t")
def a21(spark, sf):
    t = metrics.trend(read(spark, sf, "events"), "event_type", "event_id", "value").withColumnRenamed("latest", "hit_rate").withColumn("mb", F.lit(150.0))
    return metrics.health(t).select("event_type", F.round("health", 6).alias("health"))


@register("a24_mode", "SELECT user_id, arg_max(event_type, (n, event_type)) AS event_type FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def a24(spark, sf):
    n = read(spark, sf, "events").groupBy("user_id", "event_type").count()
    return n.groupBy("user_id").agg(F.max_by("event_type", F.struct("count", "event_type")).alias("event_type"))


@register("a29_timing_share", "SELECT event_type AS operation, round(avg(value), 6) AS mean, round(sum(value) / sum(sum(value)) OVER (), 6) AS share, sum(value) / sum(sum(value)) OVER () > 0.1 AS bottleneck FROM events GROUP BY event_type")
def a29(spark, sf):
    out = metrics.timing(read(spark, sf, "events").select(F.col("event_type").alias("operation"), "value"))
    return out.withColumns({"mean": F.round("mean", 6), "share": F.round("share", 6)})


_TOKENS = "WITH c AS (SELECT conv_id, CAST(sum(greatest(1, length(coalesce(text, '')) // 4)) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id) SELECT conv_id, tokens, round(100.0 * tokens / 65536, 6) AS used, CASE WHEN 100.0 * tokens / 65536 > 90 THEN 'critical' WHEN 100.0 * tokens / 65536 > 70 THEN 'warning' ELSE 'healthy' END AS band FROM c"


@register("a30_context_health", _TOKENS)
def a30(spark, sf):
    return metrics.context_health(read(spark, sf, "conversations")).withColumn("used", F.round("used", 6))


def _events(spark, sf, end: str | None = None):
    """The events as a stream; ``end`` is how long after the last event it is known that no more come."""
    folder = scratch(spark)
    rows = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    (jobs.with_end(rows, end) if end else rows).write.parquet(folder)
    return jobs.event_stream(spark, folder, rows.schema, per_trigger=None)


@register("t6_tumbling_samples", "SELECT time_bucket(INTERVAL 30 SECOND, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY ALL")
def t6(spark, sf):
    """A stream over the events' files, drained once; windows leave the state when they are complete."""
    out = jobs.drained(jobs.sampled(_events(spark, sf, "1 hour")), scratch(spark))
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "mean": F.round("mean", 6)})


@register("t7_rolling_memory", "WITH o AS (SELECT conv_id, length(text) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS p FROM conversations) SELECT conv_id, count(*) FILTER (WHERE p <= 10) AS recent, count(*) FILTER (WHERE p > 10) AS older, CAST(coalesce(sum(c) FILTER (WHERE p > 10), 0) AS BIGINT) AS older_chars FROM o GROUP BY conv_id")
def t7(spark, sf):
    return metrics.rolling_memory(read(spark, sf, "conversations"))


_SESSION = "WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS f, event_id FROM events), s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS \"end\", count(*) AS n FROM s GROUP BY user_id, s"


@register("t8_sessions", _SESSION)
def t8(spark, sf):
    """A stream over the events' files, drained once; sessions leave the state when they are over."""
    out = jobs.drained(jobs.session_counts(_events(spark, sf, "2 days"), "12 hours"), scratch(spark))
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@register("t2_ttl_dedupe", "SELECT event_id FROM events QUALIFY lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) IS NULL OR ts >= lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) + INTERVAL 86400 SECOND")
def t2(spark, sf):
    return metrics.once_per_ttl(read(spark, sf, "events"), ("user_id", "event_type"), 86400).select("event_id")


_LIVES = ", ".join(f"('{name}', {seconds})" for name, seconds in ttl.LIFETIMES.items())


@register(
    "t2_ttl_state",
    f"WITH RECURSIVE u AS (SELECT user_id, ts, min(event_id) AS event_id FROM events GROUP BY ALL), l AS (SELECT * FROM (VALUES {_LIVES}) AS t(cache, seconds)), n AS (SELECT cache, user_id, ts, event_id, min(ts) OVER (PARTITION BY cache, user_id ORDER BY ts RANGE BETWEEN to_seconds(seconds) FOLLOWING AND UNBOUNDED FOLLOWING) AS next, row_number() OVER (PARTITION BY cache, user_id ORDER BY ts) AS place FROM u, l), "
    "w AS (SELECT cache, user_id, event_id, next FROM n WHERE place = 1 UNION ALL SELECT n.cache, n.user_id, n.event_id, n.next FROM w JOIN n ON n.cache = w.cache AND n.user_id = w.user_id AND n.ts = w.next) SELECT cache, event_id FROM w",
)
def t2_state(spark, sf):
    """Uses of a user's entry in five caches: those that find none alive."""
    events = _events(spark, sf).select("user_id", "ts", "event_id")
    with jobs.rocksdb(spark):
        return jobs.drained(ttl.computed(events, ["user_id"]), scratch(spark))


@register("t4_content_memo", "SELECT sha256(text) AS key, min(doc_id) AS first_doc, count(*) AS uses FROM documents GROUP BY sha256(text)")
def t4(spark, sf):
    return read(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("key")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("uses"))


@register(
    "t4_memo_runs",
    "WITH b AS (SELECT coalesce(text, '') AS text FROM benchmark), d AS (SELECT coalesce(text, '') AS text FROM documents UNION ALL SELECT text FROM b) SELECT 'small' AS model, 1 AS run, count(*) AS asked, count(DISTINCT text) AS computed, CAST(sum(length(text)) AS BIGINT) AS total FROM b UNION ALL SELECT 'small', 2, count(*), count(DISTINCT text) - (SELECT count(DISTINCT text) FROM b), CAST(sum(length(text)) AS BIGINT) FROM d UNION ALL SELECT 'small', 3, count(*), 0, CAST(sum(length(text)) AS BIGINT) FROM d UNION ALL SELECT 'large', 4, count(*), count(DISTINCT text), CAST(2 * sum(length(text)) AS BIGINT) FROM b",
)
def t4_runs(spark, sf):
    """A memo of two models in four runs: each computes only what its model hasn't seen."""
    memo, some = embedding.Memo(scratch(spark), "value long"), read(spark, sf, "benchmark").select("text")
    every = read(spark, sf, "documents").select("text").unionByName(some)
    out, before = None, 0
    for run, (model, texts, times) in enumerate((("small", some, 1), ("small", every, 1), ("small", every, 1), ("large", some, 2)), 1):
        found = memo.take(texts, model, lambda new, times=times: new.select("key", (F.length(F.coalesce("text", F.lit(""))) * times).cast("long").alias("value")))
        now = memo.stored(texts).count()
        # Written, as it shows the memo of now, not that of later runs.
        row = written(found.agg(F.count("*").alias("asked"), F.sum("value").alias("total")).select(F.lit(model).alias("model"), F.lit(run).alias("run"), "asked", F.lit(now - before).cast("long").alias("computed"), "total"))
        out, before = row if out is None else out.unionByName(row), now
    return out


@register("t5_signature", "WITH f AS (SELECT source, md5(doc_id || ':' || n_chars) AS m FROM documents), s AS (SELECT source, count(*) AS n, sum(('0x' || left(m, 12))::BIGINT) AS a, sum(('0x' || m[13:24])::BIGINT) AS b FROM f GROUP BY source) SELECT source, sha256(n || ':' || a || ':' || b) AS signature FROM s")
def t5(spark, sf):
    return metrics.signatures(read(spark, sf, "documents").select("source", F.concat_ws(":", "doc_id", "n_chars").alias("f")), "source", "f")


@register("w3_positional_scores", "SELECT doc_id, round(greatest(0.1, 1 - (row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1) * 0.2), 6)::DOUBLE AS score FROM documents")
def w3(spark, sf):
    from pyspark.sql import Window as W

    from ..operators.fusion import positional

    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return read(spark, sf, "documents").select("doc_id", F.round(positional(rank), 6).alias("score"))


@register("w4_normalised_scores", "SELECT doc_id, round(n_chars / max(n_chars) OVER (PARTITION BY source), 6) AS score FROM documents")
def w4(spark, sf):
    from ..operators.fusion import normalised

    d = read(spark, sf, "documents").select("doc_id", "source", F.col("n_chars").cast("double").alias("score"))
    return normalised(d, "score", "source").select("doc_id", F.round("score", 6).alias("score"))


@register("w9_top_per_group", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 5")
def w9(spark, sf):
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return read(spark, sf, "documents").select("source", "doc_id", place.alias("p")).where("p <= 5").drop("p")

"""Retrieval quality against a golden set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(results: DataFrame, golden: DataFrame) -> DataFrame:
    """query_id, category, p3, p5, p10, r10, mrr.

    ``results`` has query_id, rank, doc_id; ``golden`` has a row (query_id,
    category, doc_id) for each document that a question should find.  Precision
    at k is 0 where fewer than k were retrieved.
    """
    wanted = golden.groupBy("query_id", "category").agg(F.countDistinct("doc_id").alias("wanted"))
    top = results.where("rank <= 10").select("query_id", "rank", "doc_id")
    # Questions' results are few: they meet the golden rows before these are brought together.
    hits = golden.select("query_id", "doc_id").join(top, ["query_id", "doc_id"], "left_semi").distinct().withColumn("hit", F.lit(True))
    both = wanted.join(top.join(hits, ["query_id", "doc_id"], "left"), "query_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    out = both.groupBy("query_id", "category").agg(
        F.count("doc_id").alias("n"),
        *[F.count_if(F.col("hit") & (F.col("rank") <= k)).alias(f"h{k}") for k in (3, 5, 10)],
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"),
        F.max("wanted").alias("wanted"),
    )
    p = lambda k: F.when(F.col("n") >= k, F.col(f"h{k}") / k).otherwise(0.0)
    return out.select("query_id", "category", p(3).alias("p3"), p(5).alias("p5"), p(10).alias("p10"), (F.col("h10") / F.greatest("wanted", F.lit(1))).alias("r10"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


METRICS = ("p3", "p5", "p10", "r10", "mrr")


def summary(scores: DataFrame) -> DataFrame:
    """Means by category, and over all as category ``overall``."""
    out = scores.rollup("category").agg(F.count("*").alias("queries"), *[F.avg(m).alias(m) for m in METRICS])
    return out.withColumn("category", F.coalesce("category", F.lit("overall")))


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """category, metric, change in percent of two summaries."""
    long = lambda d, name: d.unpivot(["category"], list(METRICS), "metric", name)
    both = long(old, "before").join(long(new, "after"), ["category", "metric"])
    return both.withColumn("change", F.when(F.col("before") == 0, F.when(F.col("after") == 0, 0.0).otherwise(100.0)).otherwise((F.col("after") - F.col("before")) / F.col("before") * 100))

"""Hybrid ranking: vector and keyword results in one list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import intent
from ..functions.text import basename, extension
from . import bm25, vectors


def normalised(results: DataFrame, score: str, by: str = "query_id") -> DataFrame:
    """Scores over the query's highest one; unchanged where that is 0."""
    top = F.max(score).over(W.partitionBy(by))
    return results.withColumn(score, F.when(top == 0, F.col(score)).otherwise(F.col(score) / top))


def positional(rank: Column, step: float = 0.2) -> Column:
    """A score for results that come without one."""
    return F.greatest(F.lit(0.1), 1.0 - (rank - 1) * step)


def fused(vector: DataFrame, keyword: DataFrame, weights: DataFrame) -> DataFrame:
    """Full outer join of (query_id, doc_id, vector_score) and (query_id, doc_id, bm25_score, matched_terms).

    ``weights`` has query_id, vector_weight and bm25_weight; other columns of it
    stay.  Keyword scores are brought to 0 to 1 first.
    """
    keyword = normalised(keyword.select("query_id", "doc_id", "bm25_score", "matched_terms"), "bm25_score")
    both = vector.select("query_id", "doc_id", "vector_score").join(keyword, ["query_id", "doc_id"], "full_outer")
    kind = F.when(F.col("bm25_score").isNull(), "vector").when(F.col("vector_score").isNull(), "bm25").otherwise("hybrid")
    rest = [c for c in weights.columns if c not in ("query_id", "vector_weight", "bm25_weight")]
    both = both.join(weights.select("query_id", "vector_weight", "bm25_weight", *rest), "query_id")
    v, b = F.coalesce("vector_score", F.lit(0.0)), F.coalesce("bm25_score", F.lit(0.0))
    return both.select("query_id", "doc_id", v.alias("vector_score"), b.alias("bm25_score"), F.coalesce("matched_terms", F.array().cast("array<string>")).alias("matched_terms"), kind.alias("search_type"), (v * F.col("vector_weight") + b * F.col("bm25_weight")).alias("score"), *rest)


def boosted(results: DataFrame, technical: Column | None = None, exact: Column | None = None, hints: list[str] | None = None, filename: str | None = None) -> DataFrame:
    """Score times the boosts that apply, in order: exact, type hint, technical terms, file name.

    ``results`` has score, search_type, matched_terms and, for hints and file
    names, file_path.
    """
    score = F.col("score")
    keyword = F.col("search_type").isin("bm25", "hybrid")
    if exact is not None:
        score = score * F.when(exact & keyword & (F.size("matched_terms") > 0), 1.2).otherwise(1.0)
    if hints:
        hit = F.lit(False)
        for h in hints:
            hit = hit | F.contains(F.lower("file_path"), F.lit(h.lower()))
        score = score * F.when(hit, 1.15).otherwise(1.0)
    if technical is not None:
        n = F.size(F.array_intersect("matched_terms", technical))
        score = score * F.when(keyword & (n > 0), 1.0 + 0.1 * n).otherwise(1.0)
    if filename:
        name = filename.lower()
        suffix = "." + name.rsplit(".", 1)[-1]
        same = F.lower(basename(F.col("file_path"))) == name
        alike = extension(F.col("file_path")) == suffix
        some = F.max(same).over(W.partitionBy("query_id"))
        score = score * F.when(some, F.when(same, 1.35).when(alike, 0.5).otherwise(0.2)).otherwise(F.when(alike, 1.2).otherwise(0.6))
    return results.withColumn("score", score)


def cut(results: DataFrame, least: float, k: int = 10, enough: int = 8) -> DataFrame:
    """The ``k`` best at ``least`` or above; a query with fewer than ``enough`` of them is cut at seven tenths of it."""
    w = W.partitionBy("query_id")
    full = F.count_if(F.col("score") >= least).over(w)
    limit = F.when((full < enough) & F.lit(least > 0.05), least * 0.7).otherwise(least)
    kept = results.withColumn("_limit", limit).where(F.col("score") >= F.col("_limit")).drop("_limit")
    return kept.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)


def hybrid_search(index: bm25.Index, embeddings: DataFrame, queries: DataFrame, k: int = 10, arm: int = 20, least: float = 0.25) -> DataFrame:
    """query_id, rank, doc_id, score, vector_score, bm25_score, search_type for queries (query_id, query, embedding of the query as ``query_vector``).

    Classifies each question, takes ``arm`` results of either kind, fuses and cuts.
    """
    kinds = intent.classified(queries.select("query_id", "query")).select("query_id", "vector_weight", "bm25_weight", intent.technical_terms(F.col("query")).alias("technical"))
    near = vectors.nearest(embeddings, queries.select("query_id", F.col("query_vector").alias("query")), arm)
    paths = index.documents.select(F.col("doc_id"), "file_path")
    near = near.join(paths, near["vec_id"] == paths["doc_id"]).join(queries.select("query_id", "query"), "query_id")
    vector = near.select("query_id", "doc_id", vectors.relevance(F.col("distance"), F.col("file_path"), F.col("query")).alias("vector_score"))
    keyword = bm25.ranked(index, queries.select("query_id", "query"), arm).select("query_id", "doc_id", F.col("score").alias("bm25_score"), "matched_terms")
    both = fused(vector, keyword, kinds)
    out = cut(boosted(both, technical=F.col("technical")).withColumn("score", F.round("score", 9)), least, k)
    return out.select("query_id", "rank", "doc_id", "score", "vector_score", "bm25_score", "search_type")

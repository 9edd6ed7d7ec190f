"""Dense vectors: exact nearest neighbours, relevance, checks, and a coarse index."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from ..sources.sinks import written

# Suffixes that raise relevance, and question words that raise a readme's.
CODE_SUFFIXES = (".py", ".js", ".ts", ".tsx", ".jsx")
TEXT_SUFFIXES = (".md", ".txt", ".rst")
QUESTION_WORDS = ("what", "how", "explain")
# End of fixed values.


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Queries that are sent whole to every task; more are sent in as many parts.
SENT_QUERIES = 4096
#: Share of the true neighbours that approximate search aims at (0.9 is asked for), and queries of the set by which it is measured.
RECALL, RECALL_QUERIES = 0.95, 64


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2") -> DataFrame:
    """query_id, rank, vec_id, distance: the exact ``k`` nearest of (vec_id, embedding) for a stated query set (query_id, query).

    Up to ``SENT_QUERIES`` queries at once go to every task, which compares them
    with whole batches of vectors and keeps each query's ``k`` best of a batch.
    A row number cut at ``k`` is a group limit: each task keeps its best before
    anything is shuffled.  Vectors that are null or of another width than the
    query are passed over.
    """
    pairs = [_batch_nearest(vectors, part, k, metric) for part in _parts(queries)]
    order = W.partitionBy("query_id").orderBy("distance", "vec_id")
    top = reduce(DataFrame.unionByName, pairs).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("query_id", "rank", "vec_id", F.col("distance") if metric == "l2" else (-F.col("distance")).alias("similarity"))


def _parts(queries: DataFrame) -> list[pa.Table]:
    """The queries (query_id, query), dealt by hash into parts of about ``SENT_QUERIES`` at most; one part while they are no more, which is measured."""
    queries = queries.select("query_id", "query").where("query is not null")
    first = queries.limit(SENT_QUERIES + 1).toArrow()
    if first.num_rows <= SENT_QUERIES:
        return [first]
    queries = written(queries)
    parts = -(-queries.count() // (SENT_QUERIES // 2))
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).toArrow() for i in range(parts)]


def _batch_nearest(vectors: DataFrame, sent: pa.Table, k: int, metric: str, reach: np.ndarray | None = None) -> DataFrame:
    """query_id, vec_id, distance of the ``k`` best of each query in each batch.

    With ``reach``, by query and list, a query meets only vectors of the lists that it reaches.
    """
    arrow = pa.schema([sent.schema.field("query_id"), *to_arrow_schema(vectors.select("vec_id").schema), ("distance", pa.float64())])
    schema = from_arrow_schema(arrow)
    ids, rows = sent["query_id"].to_pylist(), [np.asarray(q, np.float64) for q in sent["query"].to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            width = pc.list_value_length(column).to_numpy(zero_copy_only=False)
            for w in {len(q) for q in rows}:
                at = np.flatnonzero(width == w)
                if not len(at):
                    continue
                v = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), w)
                keys = batch.column(0).take(pa.array(at))
                lists = batch.column(2).to_numpy()[at] if reach is not None else None
                for i, (query_id, q) in enumerate(zip(ids, rows)):
                    if len(q) != w:
                        continue
                    met = slice(None) if reach is None else np.flatnonzero(reach[i][lists])
                    d = np.round(((v[met] - q) ** 2).sum(1) if metric == "l2" else -(v[met] @ q), 9)
                    if not len(d):
                        continue
                    # All that tie with the k-th stay, so that the smaller id decides among them.
                    best = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
                    found = best if reach is None else met[best]
                    yield pa.RecordBatch.from_arrays([pa.array([query_id] * len(best), arrow.field(0).type), keys.take(pa.array(found)).cast(arrow.field(1).type), pa.array(d[best])], schema=arrow)

    return vectors.select("vec_id", "embedding", *([] if reach is None else ["list"])).mapInArrow(run, schema)


#: Vectors of a block at most (about), and blocks at least, so that small tables are dealt out too; vectors of a tile's sides.
BLOCK, LEAST_BLOCKS, TILE = 16384, 6, 512


def alike(vectors: DataFrame, least: float) -> DataFrame:
    """source, target, similarity: every pair of (vec_id, embedding), the smaller id first, whose inner product, to nine places, is at least ``least``.

    Vectors are dealt into blocks by id, and every two blocks meet in one group,
    which multiplies them by tiles and gives what it finds tile by tile.  So
    memory is bounded, but the work grows with the square of the table, and so
    may the pairs.  Nulls are passed over, and so are pairs of unlike width.
    """
    rows = vectors.select("vec_id", "embedding").where("vec_id is not null and embedding is not null")
    blocks = max(LEAST_BLOCKS, -(-rows.count() // BLOCK))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    meets = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_other")
    dealt = rows.withColumn("_own", own).select("vec_id", "embedding", "_own", meets).select("vec_id", "embedding", "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))
    out = from_arrow_schema(pa.schema([pa.field(n, to_arrow_schema(rows.select("vec_id").schema).field(0).type) for n in ("source", "target")] + [("similarity", pa.float64())]))
    arrow = to_arrow_schema(out)

    def sides(batches: Iterator[pa.RecordBatch]) -> dict[int, tuple[list, list]]:
        """By width, the ids and vectors of the first block and of the second (the same if a block meets itself)."""
        found: dict[int, tuple[list, list]] = {}
        for batch in batches:
            column, first = batch.column(1), pc.equal(batch.column(2), batch.column(3)).to_numpy(zero_copy_only=False)
            width = pc.list_value_length(column).to_numpy(zero_copy_only=False)
            for w in np.unique(width):
                for side in (0, 1):
                    at = np.flatnonzero((width == w) & (first if side == 0 else ~first))
                    if len(at):
                        v = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), w)
                        found.setdefault(int(w), ([], []))[side].append((batch.column(0).take(pa.array(at)).to_numpy(zero_copy_only=False), v))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = next(batches)
        alone = head.column(3)[0] == head.column(4)[0]
        for one, two in sides(itertools.chain([head], batches)).values():
            if not one or not (two or alone):
                continue
            a, x = (np.concatenate(c) for c in zip(*one))
            b, y = (a, x) if alone else (np.concatenate(c) for c in zip(*two))
            for i in range(0, len(a), TILE):
                for j in range(0, len(b), TILE):
                    d = x[i : i + TILE] @ y[j : j + TILE].T
                    p, q = np.nonzero(np.round(d, 9) >= least)
                    s, t = a[i + p], b[j + q]
                    keep = s < t if alone else slice(None)
                    d, s, t = d[p, q][keep], s[keep], t[keep]
                    if len(d):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(s, t), arrow.field(0).type), pa.array(np.maximum(s, t), arrow.field(1).type), pa.array(d)], schema=arrow)

    return dealt.groupBy("_i", "_j").applyInArrow(run, out)


def relevance(distance: Column, path: Column, query: Column) -> Column:
    """From a squared distance to 0.1 to 1, with bonuses for the project's name, the suffix and readmes."""
    low, file, project = F.lower(query), F.lower(path), F.lower(F.split_part(path, F.lit("/"), F.lit(1)))
    base = F.greatest(F.lit(0.1), 1.0 - distance / 3.0)
    ends = lambda suffixes: F.coalesce(*[F.when(F.endswith(path, F.lit(s)), True) for s in suffixes], F.lit(False))
    asks = F.coalesce(*[F.when(F.contains(low, F.lit(w)), True) for w in QUESTION_WORDS], F.lit(False))
    bonus = (
        F.when(F.contains(low, project) | F.contains(project, low), 0.15).otherwise(0.0)
        + F.when(ends(CODE_SUFFIXES), 0.08).when(ends(TEXT_SUFFIXES), 0.05).otherwise(0.0)
        + F.when(F.contains(file, F.lit("readme")) & asks, 0.1).otherwise(0.0)
    )
    return F.least(F.lit(1.0), base + bonus)


def adaptive(scored: DataFrame, score: str, least: float, k: int, by: str = "query_id") -> DataFrame:
    """Rows at ``least`` or above; where a query has none, at half of it; where it still has none, the first ``k``."""
    w = W.partitionBy(by)
    full = F.count_if(F.col(score) >= least).over(w)
    half = F.count_if(F.col(score) >= least / 2).over(w)
    place = F.row_number().over(w.orderBy(F.desc(score), "vec_id"))
    marked = scored.withColumns({"_full": full, "_half": half, "_place": place})
    keep = F.when(F.col("_full") > 0, F.col(score) >= least).when(F.col("_half") > 0, F.col(score) >= least / 2).otherwise(F.lit(True)) & (F.col("_place") <= k)
    return marked.where(keep).drop("_full", "_half", "_place")


def faults(vectors: DataFrame, width: int) -> DataFrame:
    """vec_id and fault of every vector that is missing, of another width, or not finite."""
    bad = F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
    fault = F.when(F.col("embedding").isNull(), "missing").when(F.size("embedding") != width, "width").when(bad, "not finite")
    return vectors.select("vec_id", fault.alias("fault")).where("fault is not null")


def coarse_index(vectors: DataFrame, lists: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(vectors with their list, centroids): k-means lists for approximate search; every vector is indexed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("vec_id", "embedding", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    lists = lists or max(1, min(4096, int(rows.count() ** 0.5)))
    model = KMeans(k=lists, seed=seed, maxIter=8).fit(rows)
    centers = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "list int, center array<double>")
    return model.transform(rows).select("vec_id", "embedding", F.col("prediction").alias("list")), centers


def _places(centers: pa.Table, queries: pa.Table) -> np.ndarray:
    """By query and list number: the list's place by the distance of its centre from the query; last of all where widths differ."""
    numbers, points = centers["list"].to_numpy(), np.asarray(centers["center"].to_pylist(), np.float64)
    out = np.full((queries.num_rows, int(numbers.max()) + 1), len(numbers), np.int32)
    for i, q in enumerate(queries["query"].to_pylist()):
        if len(q) == points.shape[1]:
            out[i, numbers[np.argsort(((points - np.asarray(q, np.float64)) ** 2).sum(1), kind="stable")]] = np.arange(len(numbers))
    return out


def lists_needed(index: DataFrame, centers: DataFrame, queries: DataFrame, k: int = 10, recall: float = RECALL) -> int:
    """How many lists a query must read to find ``recall`` of its ``k`` nearest: measured by exact search for ``RECALL_QUERIES`` of the queries."""
    sample = queries.select("query_id", "query").where("query is not null").orderBy(F.xxhash64("query_id"), "query_id").limit(RECALL_QUERIES)
    sample, places = sample.sparkSession.createDataFrame(rows := sample.toArrow(), sample.schema), _places(centers.toArrow(), rows)
    row = {q: i for i, q in enumerate(rows["query_id"].to_pylist())}
    true = nearest(index, sample, k).select("query_id", "vec_id").join(index.select("vec_id", "list"), "vec_id").collect()
    found = np.sort([places[row[r["query_id"]], r["list"]] for r in true])
    return int(found[int(np.ceil(recall * len(found))) - 1]) + 1 if len(found) else 1


def probe(index: DataFrame, centers: DataFrame, queries: DataFrame, k: int = 10, lists: int | None = None) -> DataFrame:
    """Approximate ``nearest``: only the ``lists`` lists nearest to a query are read, by default as many as ``lists_needed`` finds."""
    queries = queries.select("query_id", "query").where("query is not null")
    lists, points = lists or lists_needed(index, centers, queries, k), centers.toArrow()
    pairs = reduce(DataFrame.unionByName, [_batch_nearest(index, part, k, "l2", _places(points, part) < lists) for part in _parts(queries)])
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "vec_id"))).where(F.col("rank") <= k)

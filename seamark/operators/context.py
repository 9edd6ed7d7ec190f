"""From ranked results to a context: budgets, merging, expansion by the graph."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from ..sources.sinks import bounded_batches, written
from . import bm25, graph, serving

# Score bonus by relation.
BONUS = {"self": 0.3, "calls": 0.2, "inherits": 0.15, "imports": 0.1, "uses": 0.1}
# End of fixed values.

#: Characters of merged chunks that a task holds before they are sent.
HELD = 4 << 20


def within_budget(results: DataFrame, budget: int = 4000, reserve: int = 200, least: int = 100) -> DataFrame:
    """Per query the best results whose tokens fit, and the first that doesn't, cut, if over ``least`` tokens are left.

    ``results`` has query_id, doc_id (once a query), score, text.  Costs only add
    up, so the greedy choice that stops at the first overflow is a prefix sum.
    It runs over costs alone; the texts of what is left are joined to it.
    """
    cost = token_estimate(F.col("text"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = results.select("query_id", "doc_id", "score", cost.alias("tokens")).withColumn("used", F.sum("tokens").over(w))
    room = budget - reserve
    before = F.col("used") - F.col("tokens")
    first_over = (F.col("used") > room) & (before <= room)
    left = room - before
    rows = rows.withColumns({"is_cut": first_over & (left > least), "_left": left}).where((F.col("used") <= room) | F.col("is_cut"))
    rows = rows.select("query_id", "doc_id", "is_cut", "_left").join(results.select("query_id", "doc_id", "score", "text"), ["query_id", "doc_id"])
    return rows.select("query_id", "doc_id", F.when(F.col("is_cut"), F.col("score") * 0.8).otherwise(F.col("score")).alias("score"), F.when(F.col("is_cut"), F.substring("text", F.lit(1), (F.col("_left") * 4 * 0.8).cast("int"))).otherwise(F.col("text")).alias("text"), F.col("is_cut"))


def merged_neighbours(chunks: DataFrame, gap: int = 5, most: int = 1000) -> DataFrame:
    """Chunks of a file (file_path, start_line, end_line, text, score) that lie within ``gap`` lines as one, up to ``most`` tokens.

    The token limit depends on what was merged before, so one pass in order of
    lines decides.  A file's chunks come to one task, sorted, and go by one after
    the other: texts move once, and a task holds those of one group, which is no
    longer than the limit, unless one chunk is.
    """
    rows = chunks.select("file_path", "start_line", "end_line", "text", F.col("score").cast("double").alias("score"))
    rows = rows.where("file_path is not null and start_line is not null and end_line is not null").withColumn("h", F.xxhash64("text", "score"))
    dealt = bounded_batches(rows.repartition("file_path").sortWithinPartitions("file_path", "start_line", "end_line", "h").drop("h"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, first, last, length, texts, score = None, 0, 0, 0, [], None
        out, held = [], 0

        def close() -> None:
            nonlocal held
            out.append((file, first, last, "\n".join(t for t in texts if t is not None), score))
            held += len(out[-1][3])

        def sent() -> pa.RecordBatch:
            nonlocal held
            found = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64()))], names=["file_path", "start_line", "end_line", "text", "score"])
            out.clear()
            held = 0
            return found

        for batch in batches:
            for path, start, end, text, value in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(text or "")
                if path == file and start - last <= gap and max(1, length // 4) + max(1, n // 4) < most:
                    last, length = max(last, end), length + 1 + n
                    texts.append(text)
                    if value is not None and (score is None or value > score):
                        score = value
                    continue
                if texts:
                    close()
                    if held >= HELD:
                        yield sent()
                file, first, last, length, texts, score = path, start, end, n, [text], value
        if texts:
            close()
        if out:
            yield sent()

    return dealt.mapInArrow(merge, "file_path string, start_line int, end_line int, text string, score double")


def graph_expanded(hits: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """query_id, node_id, relation, depth, score: for hits (query_id, node_id, words) the nodes round them.

    Score by shared words of question and node, the relation's bonus and the
    distance; the best row of each node stays.
    """
    start = hits.select("node_id").distinct()
    near = graph.dependencies(edges, start, depth).unionByName(graph.callers(edges, start, depth))
    own = start.select(F.col("node_id").alias("start_id"), "node_id", F.lit("self").alias("relation"), F.lit(0).alias("depth"))
    reach = near.unionByName(own)
    rows = hits.select("query_id", F.col("node_id").alias("start_id"), "words").join(reach, "start_id").join(nodes.select("node_id", "name", "file_path"), "node_id")
    have = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "name", "file_path")), F.lit("[a-z0-9]+"), F.lit(0)))
    shared = F.size(F.array_intersect("words", have)) / F.greatest(F.size("words"), F.lit(1))
    bonus = F.lit(0.05)
    for k, v in BONUS.items():
        bonus = F.when(F.col("relation") == k, v).otherwise(bonus)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + shared + bonus - 0.1 * F.col("depth")))
    rows = rows.select("query_id", "node_id", "relation", "depth", F.round(score * F.when(F.col("relation") == "self", 1.0).otherwise(1.05), 9).alias("score"))
    best = F.row_number().over(W.partitionBy("query_id", "node_id").orderBy(F.desc("score"), "depth", "relation"))
    return rows.withColumn("_n", best).where("_n = 1").drop("_n")


def retrieved_and_expanded(index: bm25.Index, files: DataFrame, nodes: DataFrame, edges: DataFrame, questions: DataFrame, initial: int = 3, most: int = 10, depth: int = 1) -> DataFrame:
    """query_id, rank, node_id, relation, depth, score, file_path, text: what questions (query_id, query) find in the graph.

    The best files of a question by keywords name symbols; those are looked up
    among the nodes, their relations are followed, and each node that is reached
    brings its file's text (``files``: file_path, content).
    """
    hits = bm25.ranked(index, questions, initial).select("query_id", "doc_id").join(index.documents.select("doc_id", "text"), "doc_id").join(questions, "query_id")
    texts = hits.select(F.concat_ws(":", "query_id", "doc_id").alias("text_id"), "query_id", "text", "query")
    symbols = serving.scored_symbols(texts.select("text_id", "text", "query")).select("text_id", F.col("symbol").alias("name"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit("[a-z0-9]+"), F.lit(0)))
    named = symbols.join(texts.select("text_id", "query_id", words.alias("words")), "text_id").join(nodes.select("name", "node_id"), "name")
    # Read again for every direction and level.
    start = written(named.select("query_id", "node_id", "words").distinct())
    found = graph_expanded(start, nodes, edges, depth)
    top = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "node_id"))).where(F.col("rank") <= most)
    return top.join(nodes.select("node_id", "file_path"), "node_id").join(files.select("file_path", F.col("content").alias("text")), "file_path").select("query_id", "rank", "node_id", "relation", "depth", "score", "file_path", "text")


def impact(related: DataFrame) -> DataFrame:
    """target, n, score, risk from rows (target, confidence)."""
    out = related.groupBy("target").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"))
    out = out.withColumn("score", F.least(F.col("n") * F.col("mean") / 10, F.lit(1.0)))
    risk = F.when((F.col("n") >= 8) | (F.col("score") > 0.7), "HIGH").when((F.col("n") >= 4) | (F.col("score") > 0.4), "MEDIUM").otherwise("LOW")
    return out.select("target", "n", "score", risk.alias("risk"))

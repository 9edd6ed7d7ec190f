"""Keyword search: an index in document blocks, corpus statistics, BM25 scores.

A block holds the terms of about a thousand documents: for each term the numbers
of its documents in the block and how often each has it, and the most frequent
and the shortest of these, from which no document's weight can lie beyond a
bound.  A search sends the questions' terms to the blocks.  Each task keeps the
best documents of every question so far; a block whose bounds say that it can't
add one is passed over, and what is scored is scored where the block lies, so
that a question's best of each task are all that is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import project_of, snippet, terms
from ..sources.files import spread
from ..sources.sinks import bounded_batches, written

K1, B = 1.5, 0.75
#: Terms of queries that are sent to the blocks at once (about 60 bytes each); more queries take several passes.
SENT_TERMS = 100_000
#: Documents of a block, and occurrences of terms (a longer document is a block alone).
BLOCK_DOCUMENTS, BLOCK_TERMS = 1024, 1 << 19
#: Scores are whole numbers of billionths when they are ranked, so that sums in another order rank alike.
PLACES = 1e9

BLOCKS = "doc_ids array<long>, projects array<string>, lengths array<int>, terms array<string>, df array<int>, most array<int>, least_length array<int>, members binary, counts binary"


@dataclass
class Index:
    """documents (doc_id, file_path, text), blocks (see ``BLOCKS``), one row of corpus figures (n, avgdl, total) and terms (term, df)."""

    documents: DataFrame
    blocks: DataFrame
    corpus: DataFrame
    terms: DataFrame

    @property
    def postings(self) -> DataFrame:
        """term, doc_id, dl, tf."""
        return postings(self.blocks)

    def save(self, path: str) -> None:
        spark = self.blocks.sparkSession
        self.blocks.write.mode("overwrite").parquet(f"{path}/blocks")
        self.documents.write.mode("overwrite").parquet(f"{path}/documents")
        saved = spark.read.parquet(f"{path}/blocks")
        figures(saved).write.mode("overwrite").parquet(f"{path}/corpus")
        frequencies(saved).write.mode("overwrite").parquet(f"{path}/terms")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{t}") for t in ("documents", "blocks", "corpus", "terms")))


def figures(blocks: DataFrame) -> DataFrame:
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)
    sums = blocks.agg(F.coalesce(F.sum(F.size("doc_ids")), F.lit(0)).cast("long").alias("n"), F.sum(total).cast("long").alias("total"))
    return sums.select("n", (F.col("total") / F.col("n")).alias("avgdl"), "total")


def frequencies(blocks: DataFrame) -> DataFrame:
    """Each term's documents, from the blocks' own counts."""
    rows = blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("t"))
    return rows.groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.df").cast("long").alias("df"))


def build(docs: DataFrame) -> Index:
    """Index of (doc_id, file_path, text); a document is a row."""
    rows = docs.select("doc_id", "file_path", "text")
    made = blocks_of(rows)
    return Index(rows, made, figures(made), frequencies(made))


def blocks_of(docs: DataFrame) -> DataFrame:
    """Blocks of (doc_id, file_path, text), made where the documents lie."""
    arrow = _arrow(docs, BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        documents = occurrences = 0
        for batch in batches:
            sizes = pc.list_value_length(batch.column(2)).fill_null(0).to_numpy()
            first = 0
            for i, n in enumerate(sizes.tolist()):
                if documents and (documents >= BLOCK_DOCUMENTS or occurrences + n > BLOCK_TERMS):
                    yield _block([*held, batch.slice(first, i - first)], arrow)
                    held, first, documents, occurrences = [], i, 0, 0
                documents, occurrences = documents + 1, occurrences + n
            held.append(batch.slice(first))
        if documents:
            yield _block(held, arrow)

    taken = spread(docs).select("doc_id", F.coalesce(project_of(F.col("file_path")), F.lit("")).alias("project"), F.coalesce(terms(F.col("text")), F.array().cast("array<string>")).alias("terms"))
    return bounded_batches(taken).mapInArrow(run, BLOCKS)


def _arrow(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _block(parts: list[pa.RecordBatch], schema: pa.Schema) -> pa.RecordBatch:
    table = pa.Table.from_batches(parts).combine_chunks()
    column = table.column("terms").combine_chunks()
    length = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    found = column.flatten().dictionary_encode()
    # A term's documents in a row, each once: a key of both, counted.
    key = found.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(length) + np.repeat(np.arange(len(length)), length)
    key, count = np.unique(key, return_counts=True)
    term, member = np.divmod(key, max(1, len(length)))
    first = np.flatnonzero(np.diff(term, prepend=-1))
    row = {
        "doc_ids": table.column("doc_id").to_pylist(),
        "projects": table.column("project").to_pylist(),
        "lengths": length.tolist(),
        "terms": found.dictionary.to_pylist(),
        "df": np.diff(first, append=len(term)).tolist(),
        "most": np.maximum.reduceat(count, first).tolist() if len(first) else [],
        "least_length": np.minimum.reduceat(length[member], first).tolist() if len(first) else [],
        "members": member.astype("<u4").tobytes(),
        "counts": count.astype("<u4").tobytes(),
    }
    return pa.RecordBatch.from_pylist([row], schema=schema)


class Block:
    """A block's row, read column by column as it is asked for."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.batch, self.i = batch, i

    def array(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.get_field_index(name))[self.i].values

    def numbers(self, name: str) -> np.ndarray:
        return self.array(name).to_numpy(zero_copy_only=False)

    def packed(self, name: str) -> np.ndarray:
        return np.frombuffer(self.batch.column(self.batch.schema.get_field_index(name))[self.i].as_buffer(), "<u4")

    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.numbers("df"), dtype=np.int64)])


def postings(blocks: DataFrame) -> DataFrame:
    schema = "term string, doc_id long, dl long, tf long"
    arrow = _arrow(blocks, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch, i)
                term, member = np.repeat(np.arange(len(block.array("df"))), block.numbers("df")), block.packed("members")
                columns = block.array("terms").take(pa.array(term)), pa.array(block.numbers("doc_ids")[member]), pa.array(block.numbers("lengths")[member].astype(np.int64)), pa.array(block.packed("counts").astype(np.int64))
                yield from pa.Table.from_arrays(list(columns), schema=arrow).to_batches(1 << 16)

    return bounded_batches(blocks.select(*BLOCK_NAMES)).mapInArrow(run, schema)


def without(blocks: DataFrame) -> DataFrame:
    """Blocks without the documents whose places ``dead`` (array<int>, null for none) names; a block that loses all is gone."""
    arrow = _arrow(blocks, BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row, dead = batch.slice(i, 1), batch.column(len(BLOCK_NAMES))[i].as_py()
                if not dead:
                    yield pa.RecordBatch.from_arrays(row.columns[: len(BLOCK_NAMES)], schema=arrow)
                    continue
                block = Block(batch, i)
                keep = np.ones(len(block.array("doc_ids")), bool)
                keep[dead] = False
                if keep.any():
                    yield _thinned(block, keep, arrow)

    return bounded_batches(blocks.select(*BLOCK_NAMES, "dead")).mapInArrow(run, BLOCKS)


def _thinned(block: Block, keep: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    member, df = block.packed("members"), block.numbers("df")
    stays = keep[member]
    term, member, count = np.repeat(np.arange(len(df)), df)[stays], member[stays], block.packed("counts")[stays]
    first = np.flatnonzero(np.diff(term, prepend=-1))
    length = block.numbers("lengths")
    row = {
        "doc_ids": block.numbers("doc_ids")[keep].tolist(),
        "projects": block.array("projects").filter(pa.array(keep)).to_pylist(),
        "lengths": length[keep].tolist(),
        "terms": block.array("terms").take(pa.array(term[first])).to_pylist(),
        "df": np.diff(first, append=len(term)).tolist(),
        "most": np.maximum.reduceat(count, first).tolist() if len(first) else [],
        "least_length": np.minimum.reduceat(length[member], first).tolist() if len(first) else [],
        "members": (np.cumsum(keep) - 1)[member].astype("<u4").tobytes(),
        "counts": count.astype("<u4").tobytes(),
    }
    return pa.RecordBatch.from_pylist([row], schema=schema)


BLOCK_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]


def document_frequency(index: Index) -> DataFrame:
    return index.terms.select("term", "df")


def statistics(index: Index) -> DataFrame:
    """One row: documents, vocabulary, average length, all terms."""
    vocabulary = index.terms.agg(F.count("*").alias("vocabulary_size"))
    totals = index.corpus.select(F.col("n").alias("total_documents"), F.col("avgdl").alias("average_document_length"), F.col("total").alias("total_terms"))
    return totals.crossJoin(vocabulary)  # one row each


@dataclass
class Asked:
    """Questions' terms as they go to the tasks: of every one the question's number, the term, and how often it is asked times its rarity."""

    ids: list
    terms: pa.Array
    question: np.ndarray
    term: np.ndarray
    factor: np.ndarray
    avgdl: float
    first: np.ndarray = field(init=False)

    def __post_init__(self):
        self.first = np.searchsorted(self.question, np.arange(len(self.ids) + 1))

    def weight(self, count: np.ndarray, length: np.ndarray) -> np.ndarray:
        return count * (K1 + 1) / (count + K1 * (1 - B + B * length / self.avgdl))

    def in_block(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Each asked term's place in the block (-1 if it has none), and what it adds there at most."""
        place = pc.index_in(self.terms, value_set=block.array("terms")).fill_null(-1).to_numpy(zero_copy_only=False)
        top = np.append(self.weight(block.numbers("most"), block.numbers("least_length")), 0.0)
        place = place[self.term]
        return place, np.maximum(self.factor * top[place], 0.0)


def asked(index: Index, queries: DataFrame) -> list[Asked]:
    """The questions' terms that the index has, in as many parts as their number, which is measured, asks for.

    A term that a query repeats counts as often.
    """
    wanted = queries.select("query_id", F.explode(terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    known = wanted.join(index.terms, "term").select("query_id", "term", "times", "df")
    found = known.limit(SENT_TERMS + 1).toArrow()
    if found.num_rows <= SENT_TERMS:
        parts = [found]
    else:
        known = written(known)
        count = -(-known.count() // SENT_TERMS) + 1
        parts = (known.where(F.pmod(F.xxhash64("query_id"), F.lit(count)) == i).toArrow() for i in range(count))
    n, avgdl = index.corpus.select("n", "avgdl").first()
    out = []
    for part in parts:
        part = part.sort_by([("query_id", "ascending"), ("term", "ascending")])
        ids, names = part["query_id"].combine_chunks().dictionary_encode(), part["term"].combine_chunks().dictionary_encode()
        df = part["df"].to_numpy().astype(np.float64)
        factor = part["times"].to_numpy() * np.log((n - df + 0.5) / (df + 0.5))
        out.append(Asked(ids.dictionary.to_pylist(), names.dictionary, ids.indices.to_numpy(zero_copy_only=False), names.indices.to_numpy(zero_copy_only=False), factor, avgdl or 1.0))
    return out


def _over_blocks(index: Index, queries: DataFrame, columns: str, run: Callable[[Asked, Iterator[Block]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``run`` over the blocks of each task, once for each part of the questions."""
    kind = dict(queries.dtypes)["query_id"]
    schema = f"query_id {kind}, {columns}"
    arrow = _arrow(queries, schema)

    def task(part: Asked) -> Callable:
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = (Block(b, i) for b in batches for i in range(b.num_rows))
            for question, *rest in run(part, blocks):
                ids = pa.array(part.ids, arrow.field(0).type).take(pa.array(question))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, f.type) for c, f in zip(rest, list(arrow)[1:])]], schema=arrow)

        return step

    blocks = bounded_batches(index.blocks.select(*BLOCK_NAMES))
    out = None
    for part in asked(index, queries):
        found = blocks.mapInArrow(task(part), schema)
        out = found if out is None else out.unionByName(found)
    return out


def scored(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, score for every document that shares a term with a query (query_id, query)."""

    def run(part: Asked, blocks: Iterator[Block]):
        for block in blocks:
            place, _ = part.in_block(block)
            starts, member = block.starts(), block.packed("members")
            weight = part.weight(block.packed("counts"), block.numbers("lengths")[member])
            ids = block.numbers("doc_ids")
            for q in range(len(part.ids)):
                here = [i for i in range(part.first[q], part.first[q + 1]) if place[i] >= 0]
                if here:
                    score, met = np.zeros(len(ids)), np.zeros(len(ids), bool)
                    for i in here:
                        at = slice(starts[place[i]], starts[place[i] + 1])
                        score[member[at]] += part.factor[i] * weight[at]
                        met[member[at]] = True
                    found = np.flatnonzero(met)
                    yield np.full(len(found), q), ids[found], score[found]

    return _over_blocks(index, queries, "doc_id long, score double", run)


class Best:
    """The ``k`` best documents of every question so far: scores in billionths, ids, matched terms."""

    def __init__(self, questions: int, k: int, least: float):
        self.k, self.least = k, int(np.ceil(least * PLACES - 1e-3))
        self.score = [np.zeros(0, np.int64) for _ in range(questions)]
        self.doc: list[np.ndarray] = [np.zeros(0, np.int64) for _ in range(questions)]
        self.matched: list[list[list[str]]] = [[] for _ in range(questions)]
        #: What a document needs to be among the best.
        self.floor = np.full(questions, self.least, np.int64)

    def add(self, q: int, score: np.ndarray, doc: np.ndarray, matched: Callable[[np.ndarray], list[list[str]]]) -> None:
        """``matched`` gives the terms of documents by their places in ``doc``; it is asked only for those that are kept."""
        known = len(self.score[q])
        scores, docs = np.concatenate([self.score[q], score]), np.concatenate([self.doc[q], doc])
        order = np.lexsort((docs, -scores))[: self.k]
        terms = matched(order[order >= known] - known)
        new = iter(terms)
        self.matched[q] = [self.matched[q][i] if i < known else next(new) for i in order.tolist()]
        self.score[q], self.doc[q] = scores[order], docs[order]
        if len(order) == self.k:
            self.floor[q] = max(self.least, int(self.score[q][-1]))


def ranked(index: Index, queries: DataFrame, k: int = 10, min_score: float = 0.1, projects: list[str] | None = None) -> DataFrame:
    """query_id, rank, doc_id, score, matched_terms of the ``k`` best documents; ties go to the smaller id.

    ``min_score`` is above 0: a document without any of a query's terms has 0.
    """
    if min_score <= 0:
        raise ValueError("min_score must be above 0")

    def run(part: Asked, blocks: Iterator[Block]):
        best = Best(len(part.ids), k, min_score)
        names = part.terms.to_pylist()
        for block in blocks:
            _search_block(part, block, best, names, projects)
        size = np.array([len(s) for s in best.score])
        if size.sum():
            yield np.repeat(np.arange(len(size)), size), np.concatenate(best.doc), np.concatenate(best.score) / PLACES, [t for ms in best.matched for t in ms]

    found = _over_blocks(index, queries, "doc_id long, score double, matched_terms array<string>", run)
    top = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
    return top.select("query_id", "rank", "doc_id", "score", "matched_terms")


def _search_block(part: Asked, block: Block, best: Best, names: list[str], projects: list[str] | None) -> None:
    place, bound = part.in_block(block)
    total = np.bincount(part.question, bound, len(part.ids))
    # A score that rounds up to the floor may do; so may one that only the order of a sum keeps below it.
    live = np.flatnonzero(total * PLACES >= best.floor - 1)
    if not len(live):
        return
    starts, member = block.starts(), block.packed("members")
    weight = part.weight(block.packed("counts"), block.numbers("lengths")[member])
    ids = block.numbers("doc_ids")
    allowed = None
    if projects is not None:
        allowed = pc.is_in(block.array("projects"), value_set=pa.array(projects)).to_numpy(zero_copy_only=False)
    score = np.zeros(len(ids))
    for q in live.tolist():
        here = np.arange(part.first[q], part.first[q + 1])
        here = here[place[here] >= 0]
        # The weightiest first; when what is left can't lift a document from nothing to the floor, those that have enough are looked at.
        here = here[np.argsort(-bound[here], kind="stable")]
        left = np.append(np.cumsum(bound[here][::-1])[::-1][1:], 0.0)
        score[:] = 0
        tried = False
        for i, rest in zip(here.tolist(), left.tolist()):
            at = slice(starts[place[i]], starts[place[i] + 1])
            score[member[at]] += part.factor[i] * weight[at]
            if not tried and rest * PLACES < best.floor[q] - 1:
                tried = True
                if (score.max() + rest) * PLACES < best.floor[q] - 1:
                    break
        else:
            rounded = np.floor(score * PLACES + 0.5).astype(np.int64)
            keep = rounded >= best.floor[q]
            if allowed is not None:
                keep &= allowed
            found = np.flatnonzero(keep)
            if len(found) > best.k:
                # All that tie with the k-th stay, so that the smaller id decides among them.
                found = found[rounded[found] >= np.partition(rounded[found], len(found) - best.k)[len(found) - best.k]]
            if len(found):

                def matched(which: np.ndarray) -> list[list[str]]:
                    out: list[list[str]] = [[] for _ in which]
                    for i in here.tolist():
                        some = member[starts[place[i]] : starts[place[i] + 1]]
                        at = np.searchsorted(some, found[which])
                        for n in np.flatnonzero(some[np.minimum(at, len(some) - 1)] == found[which]).tolist():
                            out[n].append(names[part.term[i]])
                    return [sorted(x) for x in out]

                best.add(q, rounded[found], ids[found], matched)


def search(index: Index, queries: DataFrame, k: int = 10, min_score: float = 0.1, projects: list[str] | None = None) -> DataFrame:
    """``ranked`` with path and snippet: only the documents that are shown get their text."""
    top = ranked(index, queries, k, min_score, projects).join(index.documents.select("doc_id", "file_path", "text"), "doc_id")
    return top.select("query_id", "rank", "doc_id", "file_path", "score", "matched_terms", snippet(F.col("text"), F.col("matched_terms")).alias("snippet"))

"""Benchmark decontamination with one Aho-Corasick automaton.

Questions and answers are normalised to words with a blank around each, and
every window of words becomes one pattern.  A text is normalised in the same
way and read once; a match's place is mapped back to word numbers, and to
offsets of the original text where spans are asked for.  The automaton goes to
the executors whole while the benchmark's size, which is measured first, is
within ``MAX_BLOCK_BYTES``.  A larger one is dealt into blocks of about that
size; one job for each block finds its occurrences, which are written, and a last
one puts together what a document's words hit: driver and executors hold one
block at a time.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, map_rows, only, written

WINDOW = 13
#: Bytes of benchmark text in one automaton (about 60 bytes of memory for each byte and word of a window).
MAX_BLOCK_BYTES = 4 << 20
#: Bytes of an item that are dealt as one.
SEGMENT_BYTES = 1 << 18

#: Separators become blanks and A-Z small letters; bytes over 0x7F, parts of other characters, stay.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
SPANS = "doc_id long, item_id string, char_start long, char_end long"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


class Automaton:
    """Windows of a block of items; reads normalised texts."""

    def __init__(self, items: Iterable[tuple[str, str]], window: int = WINDOW):
        owners: dict[bytes, tuple[int, set[str]]] = {}
        for item, text in items:
            words = words_of(text)
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                owners.setdefault(b" " + b" ".join(words[i : i + size]) + b" ", (size, set()))[1].add(item)
        self.tree = ahocorasick.Automaton()
        for pattern, value in owners.items():
            self.tree.add_word(pattern.decode("latin-1"), value)
        if owners:
            self.tree.make_automaton()
        self.any = bool(owners)

    def matches(self, normal: str) -> list[tuple[int, tuple[int, set[str]]]]:
        """(offset of the last blank, (words, items)) of every occurrence."""
        return list(self.tree.iter(normal)) if self.any else []


def segments(text: str, size: int = SEGMENT_BYTES, window: int = WINDOW) -> Iterator[str]:
    """A text's normalised words in parts of about ``size`` bytes that share ``window - 1`` words, so that every window is in one."""
    words = words_of(text)
    first = 0
    while first < len(words):
        last, held = first, 0
        while last < len(words) and (held < size or last - first < window):
            held += len(words[last]) + 1
            last += 1
        yield b" ".join(words[first:last]).decode("utf-8", "replace")
        if last == len(words):
            return
        first = last - window + 1


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, int]:
    """(item_id, text, block) of the stated query set, and the number of blocks.

    Rows without an id or text are no items; an item_id that repeats is one
    item with the windows of all its rows.
    """
    items = only(benchmark, "item_id", "text").where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"item_id": [], "text": []}
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for part in segments(text, window=window):
                    out["item_id"].append(item)
                    out["text"].append(part)
            return out

        return step

    parts = written(map_rows(items, make, "item_id string, text string"))
    held = parts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-held // MAX_BLOCK_BYTES))
    return parts.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int")), blocks


class Scanner:
    """Finds what of a batch's texts is in the benchmark, or in a block of it."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.automaton = Automaton(items, window)

    def scan(self, batch: list[str | None]) -> list[tuple[int, list[tuple[int, int, set[str]]]]]:
        """Of each text its number of words, and (first word, words, items) of each occurrence."""
        out = []
        for text in batch:
            words = words_of(text)
            found = []
            if words:
                normal = (b" " + b" ".join(words) + b" ").decode("latin-1")
                if hits := self.automaton.matches(normal):
                    blanks = [i for i, c in enumerate(normal) if c == " "]
                    found = [(bisect_right(blanks, end) - 1 - size, size, items) for end, (size, items) in hits]
            out.append((len(words), found))
        return out


def judge(n_words: int, found: list[tuple[int, int, set[str]]]) -> tuple[int, list[str], bool]:
    """Words hit, items, and whether a twentieth of the words or more is hit."""
    hit: set[int] = set()
    items: set[str] = set()
    for first, size, owners in found:
        hit.update(range(first, first + size))
        items |= owners
    return len(hit), sorted(items), len(hit) > 0 and 20 * len(hit) >= n_words


def shared_block(parts: DataFrame, block: int):
    """A broadcast of one block's items, of about ``MAX_BLOCK_BYTES``."""
    rows = parts.where(F.col("block") == block).select("item_id", "text").toLocalIterator()
    return parts.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in rows])


def occurrences(docs: DataFrame, parts: DataFrame, blocks: int, window: int) -> DataFrame:
    """(row, firsts, sizes, items) of every row of (row, text) that a block hits, one job a block: what is collected of a row is bounded by its text and the items in it."""
    found = None
    for block in range(blocks):
        shared = shared_block(parts, block)

        def make(shared=shared):
            scanner = Scanner(shared.value, window)

            def step(batch: pa.RecordBatch) -> dict:
                out: dict[str, list] = {"row": [], "firsts": [], "sizes": [], "items": []}
                for row, (_, hits) in zip(batch.column(0).to_pylist(), scanner.scan(batch.column(1).to_pylist())):
                    if hits:
                        out["row"].append(row)
                        out["firsts"].append([a for a, _, _ in hits])
                        out["sizes"].append([n for _, n, _ in hits])
                        out["items"].append(sorted(set().union(*[i for _, _, i in hits])))
                return out

            return step

        part = written(map_rows(docs, make, "row long, firsts array<int>, sizes array<int>, items array<string>"))
        shared.unpersist()
        found = part if found is None else found.unionByName(part)
    joined = lambda c: F.flatten(F.collect_list(c)).alias(c)
    return found.groupBy("row").agg(joined("firsts"), joined("sizes"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def judged_rows(judgements: list[tuple[int, list[tuple[int, int, set[str]]]]]) -> dict:
    judged = [judge(n, found) for n, found in judgements]
    return {
        "n_words": [n for n, _ in judgements],
        "n_hit": [n for n, _, _ in judged],
        "n_items": [len(items) for _, items, _ in judged],
        "items_sha256": [hashlib.sha256(",".join(items).encode()).hexdigest() for _, items, _ in judged],
        "contaminated": [bad for _, _, bad in judged],
    }


def in_blocks(docs: DataFrame, parts: DataFrame, blocks: int, window: int) -> DataFrame:
    """The documents, all columns but the text, with what ``judged_rows`` gives; ``docs`` has a unique number ``row``."""
    found = occurrences(docs.select("row", "text"), parts, blocks, window)

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            texts, *rest = (batch.column(k).to_pylist() for k in range(1, 5))
            each = [[(a, n, set()) for a, n in zip(firsts or (), sizes or ())] for firsts, sizes in zip(rest[0], rest[1])]
            # Items go by document here, as a window of one may be in several blocks.
            hits = [[*x, (0, 0, set(items))] if items else x for x, items in zip(each, rest[2])]
            return {"row": batch.column(0)} | judged_rows([(len(words_of(t)), x) for t, x in zip(texts, hits)])

        return step

    rows = docs.select("row", "text").join(found, "row", "left").select("row", "text", "firsts", "sizes", "items")
    return map_rows(rows, make, "row long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def numbered(docs: DataFrame) -> DataFrame:
    """The table, written with a number ``row`` for each row."""
    return written(docs.withColumn("row", F.monotonically_increasing_id()))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document row: words, hit words, items, verdict.

    A null or empty text has no words and is clean; a null doc_id stays null;
    rows that repeat a doc_id are judged each.  An empty benchmark hits nothing.
    """
    docs, (parts, blocks) = only(docs, "doc_id", "text"), benchmark_blocks(benchmark, window)
    if blocks > 1:
        docs = numbered(docs)
        return in_blocks(docs, parts, blocks, window).join(docs.select("row", "doc_id"), "row").select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    shared = shared_block(parts, 0)

    def make():
        scanner = Scanner(shared.value, window)
        return lambda batch: {"doc_id": batch.column(0)} | judged_rows(scanner.scan(batch.column(1).to_pylist()))

    return map_rows(docs, make, SCHEMA)


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, all columns, that are not contaminated.

    Null and empty texts stay; rows that repeat an id, or have none, are judged
    each; an empty benchmark keeps everything.
    """
    parts, blocks = benchmark_blocks(benchmark, window)
    if blocks > 1:
        both = numbered(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text"))
        bad = in_blocks(both, parts, blocks, window).where("contaminated").select("row")
        return both.join(bad, "row", "left_anti").select("doc.*")
    shared, at = shared_block(parts, 0), docs.columns.index("text")

    def run(batches):
        scanner = Scanner(shared.value, window)
        for batch in batches:
            yield batch.filter(pa.array([not judge(n, found)[2] for n, found in scanner.scan(batch.column(at).to_pylist())], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Each occurrence with its place in the original text (code points, end exclusive)."""
    parts, blocks = benchmark_blocks(benchmark, window)
    each = [spans_of_block(docs, shared_block(parts, k), window) for k in range(blocks)] if blocks == 1 else [written(spans_of_block(docs, shared_block(parts, k), window)) for k in range(blocks)]
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    return out


def spans_of_block(docs: DataFrame, shared, window: int) -> DataFrame:
    def make():
        scanner, word = Scanner(shared.value, window), re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"doc_id": [], "item_id": [], "char_start": [], "char_end": []}
            values = batch.column(1).to_pylist()
            for doc_id, text, (_, found) in zip(batch.column(0).to_pylist(), values, scanner.scan(values)):
                places = [m.span() for m in word.finditer(text)] if found else []
                for first, size, items in found:
                    for item in sorted(items):
                        for k, v in (("doc_id", doc_id), ("item_id", item), ("char_start", places[first][0]), ("char_end", places[first + size - 1][1])):
                            out[k].append(v)
            return out

        return step

    return map_rows(only(docs, "doc_id", "text"), make, SPANS)


#: Windows as joined words; every window length that a short item has is looked up apart.
ORACLE_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
it AS (SELECT item_id, w, least(13, len(w)) AS k FROM iw WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM it, unnest(range(1, len(w) - k + 2)) AS r(i)),
ks AS (SELECT DISTINCT k FROM ig),
dg AS (SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM dw, ks, unnest(range(1, len(w) - k + 2)) AS r(i)),
h AS (SELECT doc_id, i, k, item_id FROM dg JOIN ig USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT p) AS n FROM h, unnest(range(i, i + k)) AS q(p) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS c, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit, coalesce(c, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
  coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
"""

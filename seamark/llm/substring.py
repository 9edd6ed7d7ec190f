"""Removal of repeated passages by difference-cover anchors.

Positions of a text are numbered modulo ``PERIOD``; for any shift of two texts
against each other the cover has two residues that far apart.  So of any match of
``WINDOW`` words the two texts share an anchor of ``ANCHOR`` words that stands
at a cover position in both (ANCHOR + PERIOD - 1 = WINDOW).  Only 3 of 7
positions are hashed and counted; anchors that one document alone has end
there.  Around each shared anchor the match is extended: every window that
holds it is hashed with 128 bits, the smallest document of each is found, and
what a later document repeats is removed.

The shared anchors reach the scan as a Bloom filter of at most ``BLOOM_BITS``
bits.  It only saves work: a false hit costs a window's lookup, never a wrong
result, so a filter that a huge corpus fills up costs time alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, only, written
from .words import U, hashed, inside, mix, signed, windows

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
BLOOM_BITS = 1 << 28

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def is_cover(cover: tuple[int, ...], period: int) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a 64-bit key of the text, which tells rows apart that repeat a doc_id."""
    return only(docs, "doc_id", "text").withColumn("tk", F.xxhash64("text"))


def half(key):
    """The lower 32 bits of a key, as a signed number."""
    return F.shiftright(F.shiftleft(key, 32), 32)


def whole_copies(docs: DataFrame) -> DataFrame:
    """doc_id and key of each document whose whole text a smaller doc_id has.

    Found by digest, so that large groups of copies don't reach the windows.
    """
    t = keyed(docs).where("doc_id is not null and text is not null").select("doc_id", "tk", F.md5("text").alias("digest"))
    t = written(t)
    # Written, so that the join that follows is free to split a large group.
    groups = written(t.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first"))
    return t.join(groups, "digest").where("doc_id > first").select("doc_id", "tk").distinct()


def at_cover(positions: np.ndarray, starts: np.ndarray, text: np.ndarray) -> np.ndarray:
    return np.isin((positions - starts[:-1][text]) % PERIOD, COVER)


def shared_anchors(docs: DataFrame) -> DataFrame:
    """Anchors at cover positions of two documents or more."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            found = []
            for _, words, starts in hashed(batch.column(1)):
                anchors = windows(words, ANCHOR, 1)
                positions, text = inside(starts, ANCHOR)
                hit = at_cover(positions, starts, text)
                h, text = anchors[positions[hit]], text[hit]
                order = np.lexsort((text, h))
                h, text = h[order], text[order]
                once = np.ones(len(h), bool)
                once[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                found.append(h[once])
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, int))
            return {"h": signed(h), "n": np.minimum(n, 2).astype(np.int64)}

        return step

    rows = map_rows(docs.where("doc_id is not null").select("doc_id", "text"), make, "h long, n long")
    return rows.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


class Bloom:
    """Two bits a key in a power of two of bits; made by Spark, read by numpy."""

    def __init__(self, keys: DataFrame, most: int = BLOOM_BITS):
        bits = 1 << 10
        count = keys.count()
        while bits < min(most, 12 * count):
            bits *= 2
        self.bits = bits
        spot = lambda shift: F.shiftrightunsigned("h", shift).bitwiseAND(F.lit(bits - 1))
        places = keys.select(F.explode(F.array(spot(0), spot(32))).alias("p"))
        words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
        table = np.zeros(bits // 64, np.int64)
        found = words.toArrow()  # at most bits / 64 rows
        table[found["w"].to_numpy()] = found["b"].to_numpy()
        self.table = keys.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def reader(self):
        table, low = self.table.value, U(self.bits - 1)

        def has(h: np.ndarray) -> np.ndarray:
            out = np.ones(len(h), bool)
            for shift in (U(0), U(32)):
                p = (h >> shift) & low
                out &= ((table[(p >> U(6)).astype(np.int64)] >> (p & U(63))) & U(1)).astype(bool)
            return out

        return has


def extended(column: pa.Array, has) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Windows that hold a shared anchor: two hashes, the text's number in the batch, the window's first word there."""
    for first, words, starts in hashed(column):
        anchors = windows(words, ANCHOR, 1)
        positions, text = inside(starts, ANCHOR)
        at = np.zeros(len(words) + 1, np.int32)
        hit = at_cover(positions, starts, text)
        positions = positions[hit]
        at[positions[has(anchors[positions])] + 1] = 1
        before = np.cumsum(at, dtype=np.int32)
        positions, text = inside(starts, WINDOW)
        near = before[positions + PERIOD] > before[positions]
        positions, text = positions[near], text[near]
        if len(positions):
            a, b = windows(words, WINDOW, 2)[positions], windows(words, WINDOW, 3)[positions]
            yield a, mix(b), text + first, positions - starts[:-1][text]


def repeated_windows(docs: DataFrame, bloom: Bloom) -> DataFrame:
    """Windows of two documents or more, with the smallest doc_id of each."""

    def make():
        has = bloom.reader()

        def step(batch: pa.RecordBatch) -> dict:
            ids = batch.column(0).to_numpy()
            parts = [(a, b, ids[text]) for a, b, text, _ in extended(batch.column(1), has)]
            if not parts:
                return {}
            a, b, doc = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((doc, b, a))
            a, b, doc = a[order], b[order], doc[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            end = np.append(np.flatnonzero(new)[1:], len(a)) - 1
            return {"a": signed(a[new]), "b": signed(b[new]), "least": doc[new], "most": doc[end]}

        return step

    rows = map_rows(docs.where("doc_id is not null").select("doc_id", "text"), make, "a long, b long, least long, most long")
    return rows.groupBy("a", "b").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least < most").select("a", "b", "least")


def window_places(docs: DataFrame, bloom: Bloom) -> DataFrame:
    """Each such window of each document; ``place`` is half the text's key and the first word."""

    def make():
        has = bloom.reader()

        def step(batch: pa.RecordBatch) -> dict:
            ids, keys = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            parts = [(a, b, ids[text], (keys[text] << 32) | place) for a, b, text, place in extended(batch.column(1), has)]
            if not parts:
                return {}
            a, b, doc, place = (np.concatenate(x) for x in zip(*parts))
            return {"a": signed(a), "b": signed(b), "doc_id": doc, "place": place}

        return step

    return map_rows(docs.where("doc_id is not null").select("doc_id", "text", "tk"), make, "a long, b long, doc_id long, place long")


def kept_words(text: str | None, starts: list[int] | None, copy: bool) -> tuple[int, list[bytes]]:
    """Number of words, and those that no window from ``starts`` covers."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if copy and len(words) >= WINDOW:
        return len(words), []
    if not starts:
        return len(words), words
    edge = np.zeros(len(words) + 1, np.int32)
    begin = np.array(starts)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + WINDOW, -1)
    return len(words), [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, tk, copy, starts (first words of the windows to remove) of every document that loses words, and of no other."""
    copies = written(whole_copies(docs))
    rows = keyed(docs)
    unique = rows.join(copies, ["doc_id", "tk"], "left_anti")
    bloom = Bloom(written(shared_anchors(unique)))
    repeated = written(repeated_windows(unique, bloom))
    places = window_places(unique, bloom).join(repeated, ["a", "b"]).where("least < doc_id")
    starts = places.groupBy("doc_id", F.shiftright("place", 32).alias("half")).agg(F.collect_list(F.col("place").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("starts"))
    lost = starts.select("doc_id", "half", F.lit(False).alias("copy"), "starts").unionByName(
        copies.select("doc_id", half(F.col("tk")).alias("half"), F.lit(True).alias("copy"), F.lit(None).cast("array<int>").alias("starts"))
    )
    return written(lost)


def without_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per document row: words, removed words, digest of what is left (and that text).

    Null and empty texts have no words.  A null doc_id neither removes nor
    loses words.  Rows that repeat a doc_id don't remove from each other; each
    is judged by its own text.
    """
    lost = removals(docs)
    rows = keyed(docs).withColumn("half", half(F.col("tk"))).join(lost, ["doc_id", "half"], "left")

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            done = [kept_words(*x) for x in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))]
            kept = [b" ".join(words) for _, words in done]
            out = {"doc_id": batch.column(0), "n_words": [n for n, _ in done], "n_removed": [n - len(words) for n, words in done], "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]}
            return out | ({"kept_text": [x.decode("utf-8", "replace") for x in kept]} if with_text else {})

        return step

    return map_rows(rows.select("doc_id", "text", "starts", F.coalesce("copy", F.lit(False)).alias("copy")), make, SCHEMA + (", kept_text string" if with_text else ""))


#: Word sequences as strings; the smallest document of each.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS s FROM d, unnest(range(1, len(w) - 11)) AS r(i)),
m AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s HAVING count(DISTINCT doc_id) > 1),
x AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, i FROM g JOIN m USING (s) WHERE least < doc_id), unnest(range(i, i + 13)) AS q(p)),
c AS (SELECT doc_id, list(p) AS ps FROM x GROUP BY doc_id),
k AS (SELECT doc_id, len(w) AS n, coalesce(len(ps), 0) AS r, CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(ps, z[2])), lambda z: z[1]) END AS kept FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""

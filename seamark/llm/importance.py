"""Resampling of documents towards a target distribution, by hashed word features.

The first pass counts features: every partition makes one vector of 10,000
counts with ``np.bincount``, and ``treeReduce`` merges the vectors, so that the
driver gets one.  The second pass sends the buckets' gains (80 KB, whatever the
data) to the tasks and sums them over each document, again with ``np.bincount``.
A document's score is its mean gain plus Gumbel noise of its own id, and the
highest scores are drawn: that is sampling without replacement in proportion to
the exponentials of the means.

Ranks need all scores in one order: they are written, dealt into ranges and
sorted there, and a row's rank is its place in its range after the rows of the
ranges before.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, map_batches, map_rows, only, written
from .words import spans

BUCKETS = 10_000
#: Longest run of words that is a feature.
RUN = 2
#: Words of a document that may be drawn, and the share of these that is drawn, in percent.
LEAST_WORDS, PERCENT = 20, 25
SEED = 7

#: Everything but digits, letters and bytes of other characters separates words.
GAPS = np.array([not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) for c in range(256)])
#: Words up to this length are continued by table; longer ones one by one.
TABLED = 64


def _byte_table() -> np.ndarray:
    """The register of CRC-32 after each byte, from the polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


STEP = _byte_table()


def _zeros_tables(most: int) -> np.ndarray:
    """[length, byte's place, byte]: what a register becomes when ``length`` zero bytes follow, as a sum over its bytes."""
    out = np.zeros((most + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(most):
        out[n + 1] = (out[n] >> np.uint32(8)) ^ STEP[out[n] & 255]
    return out


ZEROS = _zeros_tables(TABLED)


def crc32s(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each byte range."""
    crc, length = np.full(len(start), 0xFFFFFFFF, np.uint32), end - start
    live, at = np.flatnonzero(length), 0
    while len(live):
        crc[live] = STEP[(crc[live] ^ data[start[live] + at]) & 255] ^ (crc[live] >> np.uint32(8))
        at += 1
        live = live[length[live] > at]
    return ~crc


def followed(crc: np.ndarray, by: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings in a row from the first's, and the second's with its length."""
    left, n = crc.copy(), length.copy()
    while len(far := np.flatnonzero(n > TABLED)):
        left[far] = _zeros(left[far], np.full(len(far), TABLED))
        n[far] -= TABLED
    return _zeros(left, n) ^ by


def _zeros(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    u = np.uint32
    return ZEROS[n, 0, crc & u(255)] ^ ZEROS[n, 1, (crc >> u(8)) & u(255)] ^ ZEROS[n, 2, (crc >> u(16)) & u(255)] ^ ZEROS[n, 3, crc >> u(24)]


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a text column: number of its first text, each text's words, and of every feature the text's number in the slice and the bucket."""
    for first, data, start, end, starts in spans(column, GAPS, lower=True):
        words = np.diff(starts)
        text, length = np.repeat(np.arange(len(words)), words), end - start
        word = crc32s(data, start, end)
        texts, buckets, run = [text], [word % BUCKETS], word
        for k in range(1, RUN):
            # A run of k + 1 words: the run of k before, a blank, and one more word.
            before = ~run[:-1]
            run = ~(STEP[(before ^ np.uint32(32)) & 255] ^ (before >> np.uint32(8)))
            run = followed(run, word[k:], length[k:])
            inside = text[:-k] == text[k:]
            texts.append(text[k:][inside])
            buckets.append(run[inside] % BUCKETS)
        yield first, words, np.concatenate(texts), np.concatenate(buckets).astype(np.int64)


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How many features of the texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, _, buckets in features(batch.column(0)):
                counts += np.bincount(buckets, minlength=BUCKETS)
        yield pa.RecordBatch.from_pydict({"counts": [counts.tobytes()]})

    vectors = map_batches(only(docs, "text"), run, "counts binary").rdd
    if not vectors.getNumPartitions():
        return np.zeros(BUCKETS, np.int64)
    return vectors.map(lambda row: np.frombuffer(bytes(row[0]), np.int64)).treeReduce(np.add)


def gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds: a thousand times the logarithm of its share in the target over that in the corpus, with one more of each."""
    held, wanted = float(raw.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * held / ((float(s) + 1) * wanted))) for t, s in zip(target, raw)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from the id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def make():
        gain = sent.value.astype(np.float64)

        def step(batch: pa.RecordBatch) -> dict:
            n_words, n_features, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for first, words, texts, buckets in features(batch.column(1)):
                here = slice(first, first + len(words))
                n_words[here] = words
                n_features[here] = np.bincount(texts, minlength=len(words))
                # Whole numbers far below 2 ** 53, so that sums of doubles are exact.
                total[here] = np.bincount(texts, weights=gain[buckets], minlength=len(words)).astype(np.int64)
            weight = np.where(n_features > 0, total // np.maximum(n_features, 1), 0)
            added = np.array([noise(d, seed) for d in batch.column(0).to_pylist()], np.int64)
            return {"doc_id": batch.column(0), "n_words": n_words, "n_features": n_features, "weight": weight, "score": weight + added}

        return step

    return map_rows(only(docs, "doc_id", "text"), make, "doc_id long, n_words long, n_features long, weight long, score long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs`` (doc_id, text); ``rank`` is null for rows that aren't drawn.

    Of the N rows with at least ``least_words`` words the floor of ``percent``
    hundredths of N is drawn.  A null or empty text has no feature and weight 0;
    a null doc_id counts as an empty one in the noise and goes last among equal
    scores; rows that repeat a doc_id are drawn each for itself; an empty target
    makes every gain follow the corpus alone, and an empty table gives no rows.
    """
    gain = gains(bucket_counts(target), bucket_counts(docs))
    made = written(scores(docs, gain, seed).withColumn("drawable", F.col("n_words") >= least_words))
    # All that may be drawn comes first, best first.
    order = [F.desc("drawable"), F.desc("score"), F.asc_nulls_last("doc_id")]
    dealt = made.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    placed = written(dealt.withColumn("range", F.shiftright(place, 33)).withColumn("place", place.bitwiseAND((1 << 33) - 1)))
    freed(made)
    # One row for each range: as many as partitions.
    counted = sorted(placed.groupBy("range").agg(F.count("*").alias("n"), F.count_if("drawable").alias("drawable")).collect())
    drawn = percent * sum(r["drawable"] for r in counted) // 100
    before, at = [], 0
    for r in counted:
        before.append((r["range"], at))
        at += r["n"]
    starts = F.broadcast(docs.sparkSession.createDataFrame(before, "range long, before long"))
    rank = F.col("before") + F.col("place") + 1
    return placed.join(starts, "range").select("doc_id", "n_features", "weight", "score", F.when(F.col("drawable") & (rank <= drawn), rank).alias("rank"))




#: The register of CRC-32 after each half byte; SQL takes a feature's hexadecimal digits one by one.
_HALVES = STEP[np.arange(16) << 4].tolist()
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_RUNS = "SELECT {0}unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM {1}"

ORACLE_SQL = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents), bw AS (SELECT {_WORDS} AS w FROM benchmark),
df AS (SELECT doc_id, f, count(*) AS c FROM ({_RUNS.format("doc_id, ", "dw")}) GROUP BY ALL), bf AS (SELECT f, count(*) AS c FROM ({_RUNS.format("", "bw")}) GROUP BY ALL),
fs AS (SELECT DISTINCT f FROM (SELECT f FROM df UNION ALL SELECT f FROM bf)),
fb AS (SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(0, len(h)), lambda i: CAST(instr('0123456789ABCDEF', h[i + 2 - 2 * (i % 2)]) - 1 AS BIGINT))), lambda r, x: xor({_HALVES}[(xor(r, x) & 15) + 1], r >> 4)), 4294967295) % 10000 AS b FROM (SELECT f, hex(encode(f)) AS h FROM fs)),
s AS (SELECT b, CAST(sum(c) AS BIGINT) AS s FROM df JOIN fb USING (f) GROUP BY b), t AS (SELECT b, CAST(sum(c) AS BIGINT) AS t FROM bf JOIN fb USING (f) GROUP BY b),
n AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS big_s, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS big_t),
g AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (big_s + 10000) / ((s::DOUBLE + 1) * (big_t + 10000)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (b), n),
w AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS n_features, CAST(floor(CAST(sum(c * g) AS DOUBLE) / sum(c)) AS BIGINT) AS weight FROM df JOIN fb USING (f) JOIN g USING (b) GROUP BY doc_id),
a AS (SELECT doc_id, len(w) AS k, CAST('0x' || left(sha256('7:' || doc_id), 8) AS BIGINT) AS h FROM dw),
z AS (SELECT doc_id, k, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM a LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS p FROM z WHERE k >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN p <= 25 * (SELECT count(*) FROM r) // 100 THEN p END AS rank FROM z LEFT JOIN r USING (doc_id)
"""

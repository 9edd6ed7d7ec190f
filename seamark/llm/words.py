"""Words of a whole Arrow batch of texts as 64-bit hashes, without a Python loop over words.

Texts are read as UTF-8 bytes straight from Arrow's buffers.  All separators are
ASCII, so bytes over 0x7F always belong to words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are hashed at once (one longer text is taken alone).
SLICE_BYTES = 2 << 20
#: Longer words are hashed one by one.
LONG_WORD = 256

WHITE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)

U = np.uint64
M1, M2, GOLD = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on all."""
    h = (h ^ (h >> U(30))) * M1
    h = (h ^ (h >> U(27))) * M2
    return h ^ (h >> U(31))


def multipliers(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit numbers from a counter."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + U(seed * 1_000_003)) * GOLD) | U(1)


def _hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges; ``data`` has 8 bytes beyond the last range."""
    length = end - start
    every = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    h = mix(length.astype(np.uint64) * GOLD)
    live, at = np.flatnonzero(length <= LONG_WORD), 0
    while len(live):
        left = np.minimum(length[live] - at, 8)
        h[live] = mix((h[live] ^ (every[start[live] + at] & MASK[left])) * GOLD + U(at + 1))
        at += 8
        live = live[length[live] > at]
    for i in np.flatnonzero(length > LONG_WORD):
        h[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes())
    return h


def spans(column: pa.Array, gaps: np.ndarray, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a text column: number of its first text, bytes (8 more at the end), where words start and end, and where each text's words start (one more at the end).

    ``gaps`` says of each byte whether it separates words; null has none.
    """
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and len(column) else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        last = min(last, len(column))
        off = offsets[first : last + 1] - offsets[first]
        n = int(off[-1])
        data = np.zeros(n + 8, np.uint8)
        data[:n] = raw[offsets[first] : offsets[last]]
        if lower:
            data = LOWER[data]
        black = ~gaps[data[:n]]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        begins = black & edge[:-1]
        begins[1:] |= black[1:] & ~black[:-1]
        ends = black & edge[1:]
        ends[:-1] |= black[:-1] & ~black[1:]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        yield first, data, start, end, np.searchsorted(start, off)
        first = last


def hashed(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a text column: number of its first text, word hashes, and where each text's words start (one more at the end).

    Words are what white space (blank, 0x09 to 0x0D) separates; null has none.
    """
    for first, data, start, end, starts in spans(column, WHITE, lower):
        with np.errstate(over="ignore"):
            hashes = _hash(data, start, end)
        yield first, hashes, starts


def windows(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A hash of every ``size`` words in a row (the caller drops those that cross texts)."""
    n = max(0, len(words) - size + 1)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k, m in enumerate(multipliers(size, seed)):
            h += words[k : k + n] * m
        return mix(h)


def inside(starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of windows that lie in one text, and each one's text."""
    count = np.maximum(np.diff(starts) - size + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    before = np.cumsum(count) - count
    return np.arange(len(text)) - before[text] + starts[:-1][text], text


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)

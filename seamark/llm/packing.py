"""Hierarchical packing of tokenised documents into several context sizes.

A document's remainder after its whole longest windows goes to the shortest
tier that holds it.  Tiers are packed from the longest: the largest remainder
opens a window, and whole documents of the shorter tiers, best fit first, fill
its gap; where none fits, the head of one is cut to end the window exactly, and
its rest goes back to the tiers.  Tiers are powers of two, so a full window of
any tier has no padding; what a partition has left at its end is cut into
powers of two as well.  Each partition packs alone and in blocks of bounded
size: no shuffle, no state beyond one block and one open window.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import sys
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import kept as kept_by_worker
from .common import map_batches, only, to_arrow_schema

TIERS = (4096, 2048, 1024, 512)
END_ID = 2
#: Tokens of a step group at most: a step takes a few long or many short windows.
STEP_TOKENS = 16 * 4096
#: Tokens that are packed at once.
BLOCK_TOKENS = 1 << 20
#: Young pieces of text whose ids a worker remembers (as many old ones, and as many cores of both kinds: about 110 MB in all), and the longest such piece.
MEMO_WORDS, MEMO_LENGTH = 250_000, 32
#: ASCII punctuation that may follow a word (no apostrophe: 's and the like are tokens).
TAIL = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


#: Words of one pre-token whose normal form is plain: small Latin letters without marks of their own.
LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: The sign that a byte-level vocabulary has for each byte: printable ones stand for themselves, the others follow from 256 on.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHER = [b for b in range(256) if b not in _PLAIN]
BYTE_SIGNS = {b: chr(256 + k) for k, b in enumerate(_OTHER)}

#: Settings of the one kind of tokenizer whose texts can be taken apart at white space (fixed values of its file).
PLAIN_MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "byte_fallback": False, "ignore_merges": False}
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def small(core: bytes) -> bytes:
    """The core in small letters where that is the same before and after normalising: Latin letters up to U+00FF."""
    if core.isascii():
        return core.lower()
    text = core.decode("utf-8", "replace")
    return text.lower().encode() if text.isalpha() and max(text) <= "\u00ff" else core


class Memo(dict):
    """The last entries: when ``MEMO_WORDS`` are young they become the old ones, whose entries come back when they are asked for."""

    def __init__(self):
        self.old: dict[bytes, bytes] = {}

    def found(self, key: bytes) -> bytes | None:
        if (out := self.old.get(key)) is not None:
            self[key] = out
        return out

    def aged(self) -> None:
        """To be called now and then, as after each text."""
        if len(self) > MEMO_WORDS:
            self.old = dict(self)
            self.clear()


class WordIds(Memo):
    """Ids of text between ASCII white space, as little-endian uint32 bytes.

    Where the tokenizer's own settings say that it drops white space before it
    splits, that neither its normaliser nor its merges look across it, and that
    it splits a letter or digit from ASCII punctuation after it, a text's ids
    are those of its pieces in a row, and a piece's ids are those of its core
    and of that tail; cores are remembered apart, as most words stand with and
    without a tail.  With any other settings texts are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_words = splits_words(json.loads(self.tokenizer.to_str()))
        self.cores = Memo()

    def __missing__(self, piece: bytes) -> bytes:
        if (out := self.found(piece)) is not None:
            return out
        core = piece.rstrip(TAIL)
        if core and b"<|" not in piece and b"'" not in piece and (core[-1:].isalnum() or core[-2:].decode("utf-8", "ignore").lower().isalpha()):
            tail = piece[len(core) :]
            out = self.core(small(core)) + (self.core(tail) if tail else b"")
        else:
            out = self.core(piece)
        if len(piece) <= MEMO_LENGTH:
            self[piece] = out
        return out

    def core(self, piece: bytes) -> bytes:
        if (out := self.cores.get(piece)) is None and (out := self.cores.found(piece)) is None:
            text = piece.decode("utf-8", "replace")
            if LATIN.fullmatch(text):
                out = as_bytes([t.id for t in self.model.tokenize(piece.decode("latin-1").translate(BYTE_SIGNS))])
            else:
                out = self.encoded(text)
            if len(piece) <= MEMO_LENGTH:
                self.cores[piece] = out
        return out

    def encoded(self, text: str) -> bytes:
        return as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def ids(self, text: str | None) -> bytes:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not self.by_words:
            return self.encoded(raw.decode("utf-8", "replace"))
        out = []
        # A long text's pieces are taken in runs, so that the memo stays within its bound.
        for at in range(0, len(pieces := raw.split()), MEMO_WORDS):
            out += map(self.__getitem__, pieces[at : at + MEMO_WORDS])
            self.aged()
            self.cores.aged()
        return b"".join(out)


def as_bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


def splits_words(settings: dict) -> bool:
    """Whether a tokenizer's settings are those that ``WordIds`` takes a text apart by.

    Known is one kind, as its file states it: added tokens in ``<|`` and ``|>``
    alone, a byte-level merge model without prefix or suffix, and the
    normaliser and pre-tokenizer below.
    """
    model = settings["model"]
    plain = {k: model.get(k) for k in PLAIN_MODEL}
    added = all(t["content"].startswith("<|") and t["content"].endswith("|>") for t in settings["added_tokens"])
    return added and plain == PLAIN_MODEL and settings["normalizer"] == NORMALIZER and settings["pre_tokenizer"] == PRE_TOKENIZER and settings["truncation"] is None


def word_ids(path: str) -> WordIds:
    """One for each worker process, kept while packing tasks follow each other."""
    return kept_by_worker(("word ids", path), lambda: WordIds(path))


class Packer:
    """Packs one partition; ``add`` and ``flush`` give finished windows.

    A piece is (document's number, start, length); a window is (tier, pieces).
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        if any(t & (t - 1) for t in tiers):
            raise ValueError("tiers must be powers of two")
        self.tiers = sorted(tiers, reverse=True)
        #: For each tier sorted (length, document, start).
        self.pools: list[list[tuple[int, int, int]]] = [[] for _ in self.tiers]
        self.open: tuple[int, list[tuple[int, int, int]], int] | None = None
        self.waiting = 0

    def put(self, doc: int, start: int, length: int) -> None:
        level = max(i for i, t in enumerate(self.tiers) if length <= t)
        insort(self.pools[level], (length, doc, start))
        self.waiting += length

    def take(self, level: int, at: int) -> tuple[int, int, int]:
        length, doc, start = self.pools[level].pop(at)
        self.waiting -= length
        return doc, start, length

    def add(self, doc: int, length: int) -> Iterator[tuple[int, list]]:
        top, start = self.tiers[0], 0
        while length - start >= top:
            yield top, [(doc, start, top)]
            start += top
        if length > start:
            self.put(doc, start, length - start)

    def fill(self, level: int, gap: int) -> tuple[int, int, int] | None:
        """The best piece for a gap: whole from a shorter tier, else whole from the window's own, else the head of a cut one."""
        order = [*range(level + 1, len(self.tiers)), level]
        for i in order:
            if at := bisect_right(self.pools[i], (gap, 1 << 62, 0)):
                return self.take(i, at - 1)
        for i in [*order, *range(level)]:
            if self.pools[i]:
                doc, start, length = self.take(i, -1)
                if length > gap:
                    self.put(doc, start + gap, length - gap)
                return doc, start, min(gap, length)
        return None

    def pack(self) -> Iterator[tuple[int, list]]:
        while self.waiting:
            if self.open:
                (level, pieces, gap), self.open = self.open, None
            else:
                level = next(i for i, pool in enumerate(self.pools) if pool)
                pieces = [self.take(level, -1)]
                gap = self.tiers[level] - pieces[0][2]
            while gap and (piece := self.fill(level, gap)):
                pieces.append(piece)
                gap -= piece[2]
            if gap:
                self.open = (level, pieces, gap)
            else:
                yield self.tiers[level], pieces

    def flush(self) -> Iterator[tuple[int, list]]:
        """The rest, as windows of powers of two."""
        yield from self.pack()
        if self.open:
            level, pieces, gap = self.open
            self.open = None
            left = self.tiers[level] - gap
            while left:
                size = need = 1 << (left.bit_length() - 1)
                window = []
                while need:
                    doc, start, length = pieces.pop(0)
                    if length > need:
                        pieces.insert(0, (doc, start + need, length - need))
                        length = need
                    window.append((doc, start, length))
                    need -= length
                left -= size
                yield size, window


def step_groups(sizes: list[int], first: int, most: int = STEP_TOKENS) -> list[int]:
    """Group numbers from ``first``: the largest window goes to the emptiest group."""
    groups = max(1, -(-sum(sizes) // most))
    heap, out = [(0, g) for g in range(groups)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        filled, g = heapq.heappop(heap)
        out[i] = first + g
        heapq.heappush(heap, (filled + sizes[i], g))
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document in a sequence; see ``SCHEMA``.

    A null text has the end id alone.  A null doc_id is kept as null; rows that
    repeat a doc_id are packed as documents of their own.  Sequence and group
    numbers hold the partition in their upper bits.  ``with_ids`` adds each
    piece's ids as ``input_ids``.
    """
    schema = SCHEMA + (", input_ids array<long>" if with_ids else "")
    arrow = to_arrow_schema(docs.sparkSession, schema)
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = word_ids(tokenizer_path), Packer(tiers)
        base = TaskContext.get().partitionId() << 33
        kept: dict[int, list] = {}  # document's number: doc_id, ids, tokens not yet in a window
        windows: list[tuple[int, list]] = []
        sequences = groups = number = held = 0

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal sequences, groups, windows
            out: list[tuple] = []
            numbers = step_groups([t for t, _ in windows], groups)
            groups = max(numbers, default=groups - 1) + 1
            for (tier, pieces), group in zip(windows, numbers):
                offset = 0
                for doc, start, length in pieces:
                    entry = kept[doc]
                    part = entry[1][4 * start : 4 * (start + length)]
                    out.append((entry[0], start, length, zlib.crc32(part), len(entry[1]) // 4, base + sequences, offset, tier, base + group) + ((np.frombuffer(part, "<u4"),) if with_ids else ()))
                    offset += length
                    entry[2] -= length
                    if not entry[2]:
                        del kept[doc]
                sequences += 1
            windows = []
            for i in range(0, len(out), 10_000):
                columns = list(zip(*out[i : i + 10_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = words.ids(text) + last
                kept[number] = [doc_id, ids, len(ids) // 4]
                windows.extend(packer.add(number, len(ids) // 4))
                held += len(ids) // 4
                number += 1
                if held >= BLOCK_TOKENS:
                    windows.extend(packer.pack())
                    yield from rows()
                    held = packer.waiting
        windows.extend(packer.flush())
        yield from rows()

    return map_batches(only(docs, "doc_id", "text"), run, schema, keeps=("word ids", tokenizer_path))

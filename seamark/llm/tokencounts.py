"""Numbers of tokens without tokens: byte-pair merges are counted, no ids are made.

A word begins as one symbol a byte.  A heap holds the ranks of adjacent pairs,
and a linked list the symbols; the pair of the lowest rank, the leftmost of
equal ones, is merged until none is left.  Every merge takes one symbol away, so
a word's number of tokens is its bytes less its merges.  A word of any length
takes time in proportion to its bytes times the logarithm of them.

The table of merges is read from the tokenizer's file in each worker.  What is
counted once is remembered (see ``pieces.Memo``); the job is a map.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import kept, map_batches, only, to_arrow_schema
from .pieces import Memo, cut

LIMIT = 1024
#: Young counts that a worker remembers, of words and of pieces each (about 160 bytes one, and as many old ones).
MEMO_COUNTS = 300_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

#: How byte-level tokenizers take a text apart (a fixed value of their kind).
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Settings of the known kind of tokenizer (fixed values of its file).
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: Settings of an added token that stands for its string wherever that is in a text.
ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


def byte_signs() -> dict[int, str]:
    """The sign that a byte-level vocabulary has for each byte: printable ones stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Merges:
    """Counts what byte-pair merging leaves of a word; ``ranked`` are pairs of symbols, the first to merge first."""

    def __init__(self, ranked: list[tuple[str, str]]):
        signs = byte_signs()
        #: Symbols by number; a byte's is the byte.
        number = {signs[b]: b for b in range(256)}
        #: Of a pair (of a symbol in the upper bits) its order, a rank from 1 in the upper bits, and by rank the merged symbol.
        self.order: dict[int, int] = {}
        self.made = [-1]
        for a, b in ranked:
            left, right = (number.setdefault(x, len(number)) for x in (a, b))
            self.made.append(number.setdefault(a + b, len(number)))
            self.order[left << 32 | right] = len(self.made) - 1 << 32

    def left(self, word: bytes) -> int:
        size = len(word)
        symbol, order, made = list(word), self.order.get, self.made
        #: What stands in the heap for the pair that begins at each place; entries that differ from it are out of date.
        current = [(r | i if (r := order(a << 32 | b)) else 0) for i, (a, b) in enumerate(zip(symbol, symbol[1:]))]
        current.append(0)
        heap = list(filter(None, current))
        heapify(heap)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        merges = 0
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            if current[i] != top:
                continue
            merges += 1
            j = after[i]
            current[j] = current[i] = 0
            symbol[i] = whole = made[top >> 32]
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                if r := order(whole << 32 | symbol[k]):
                    current[i] = r = r | i
                    heappush(heap, r)
            if (h := before[i]) >= 0:
                if r := order(symbol[h] << 32 | whole):
                    r |= h
                    heappush(heap, r)
                    current[h] = r
                else:
                    current[h] = 0
        return size - merges


class Counter:
    """Numbers of tokens as a byte-level tokenizer's file gives them, special strings in texts counted as one."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        known(settings, path)
        self.merges = Merges([tuple(m.split(" ") if isinstance(m, str) else m) for m in settings["model"]["merges"]])
        #: The longest of those that begin at one place counts.
        added = sorted((t["content"] for t in settings["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.word = regex.compile(WORD)
        self.words = Memo(lambda word: self.merges.left(word.encode()), MEMO_COUNTS)
        self.pieces = Memo(lambda piece: self.counted(" " + piece), MEMO_COUNTS)

    def counted(self, text: str) -> int:
        return sum(map(self.words.__getitem__, self.word.findall(text)))

    def plain(self, text: str) -> int:
        """Tokens of a text without added tokens."""
        first, *rest = cut(" " + text)
        return self.counted(first) + sum(map(self.pieces.__getitem__, rest))

    def tokens(self, text: str | None) -> int:
        if not text:
            return 0
        if self.added is None or not self.added.search(text):
            return self.plain(text)
        parts = self.added.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


def known(settings: dict, path: str) -> None:
    """Raises where a tokenizer isn't of the kind whose tokens are counted here."""
    model, before = settings["model"], settings["pre_tokenizer"] or {}
    same = {k: model.get(k, v) for k, v in MODEL.items()} == MODEL and {k: before.get(k, v) for k, v in PRE_TOKENIZER.items()} == PRE_TOKENIZER
    added = all(t.get(k) == v for t in settings["added_tokens"] for k, v in ADDED.items())
    if not (same and added) or settings["normalizer"] or settings["truncation"] or settings["padding"]:
        raise ValueError(f"{path} is no byte-level merge tokenizer without normalising, truncation or padding")


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text).

    A null or empty text has no bytes and no tokens; rows that repeat are
    counted each, and a null doc_id stays null.  An empty table gives no rows.
    """
    arrow = to_arrow_schema(docs.sparkSession, SCHEMA)
    key = ("token counts", tokenizer_path)

    def run(batches):
        counter = kept(key, lambda: Counter(tokenizer_path))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = [len(t.encode()) if t else 0 for t in texts]
            tokens = list(map(counter.tokens, texts))
            columns = batch.column(0), sizes, tokens, [n > limit for n in tokens]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return map_batches(only(docs, "doc_id", "text"), run, SCHEMA, keeps=key)

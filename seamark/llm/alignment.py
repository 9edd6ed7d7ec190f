"""How the ids of two tokenizers go together, over a whole corpus.

Byte offsets where a token of either tokenizer ends cut a text into groups, and
all ids of one side are linked to all of the other within a group.  A pair's
count is the number of documents that hold it linked; the ids of side B whose
count is highest are an A id's best.

Work is dealt by stripes of A ids, in another order than the vocabulary's, in
which the frequent ones stand together.  One pass tokenises, a batch at a time (a
block): it writes each document's own figures, each block's links by stripe, and
the partition's sums of documents for each pair, so that what is counted is
added up before it is shuffled.  A second pass gathers a stripe's sums into a
dense matrix of its ids by all ids of side B with ``np.add.at`` and keeps what
isn't zero, with each row's maximum.  A third deals the links by stripe and a
salt, each stripe's counts along with them: a task spreads the counts in a dense
matrix again, reads the links that follow, and emits a block's sums.  Blocks meet
their sums and their documents' figures in a last shuffle.  All tasks read rows
in order, one at a time, and hold one matrix or one block; a frequent id's links
lie in as many tasks as there are salts.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, map_batches, only, shared_path, to_arrow_schema, written
from .pieces import MEMO_LENGTH, Memo, cut
from .tokencounts import byte_signs

#: A ids of a stripe: 32 MiB of counts with 32,000 ids of side B.
STRIPE = 128
#: Links of one salt of a stripe, about.
SALT_LINKS = 50_000_000
#: Pairs that a tokenising task sums up before it writes them.
HELD_PAIRS = 1_000_000
#: Pairs of a piece that are made at once.
MADE_AT_ONCE = 1 << 20
#: Young pieces that a worker remembers (about 500 bytes each, and as many old ones), and pieces that are taken apart at once (at most 2 ** 23).
MEMO_PIECES, AT_ONCE = 150_000, 20_000

TABLE = "kind string, stripe int, block long, links long, payload binary, doc_id array<long>, figures binary, digests array<string>"
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

BLANK = "▁"


class Side:
    """One tokenizer: bytes of its ids, and the ids of pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            entries = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            #: Ids of a blank and a text; the model puts the blank there itself.
            self.ids = lambda text: model.encode(text, num_threads=1)
            table = [bytes([int(e[3:5], 16)]) if model.is_byte(i) else e.replace(BLANK, " ").encode() for i, e in enumerate(entries)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.encode_special_tokens = True
            byte = {s: b for b, s in byte_signs().items()}
            entries = [model.id_to_token(i) or "" for i in range(model.get_vocab_size())]
            self.ids = lambda text: model.encode(" " + text, add_special_tokens=False).ids
            table = [bytes(byte[c] for c in e) if all(c in byte for c in e) else e.encode() for e in entries]
        self.size = len(table)
        self.length = np.array([len(t) for t in table], np.int64)
        self.joined = np.frombuffer(b"".join(table), np.uint8)
        self.start = np.cumsum(self.length) - self.length

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.joined[within(self.start[ids], self.length[ids])]


def within(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of all ranges in a row."""
    return np.arange(length.sum()) + np.repeat(start - (np.cumsum(length) - length), length)


#: A piece that was taken apart: tokens of A and of B, groups and links (four numbers of 8 bytes); its groups as text; pairs (A id in the upper bits); pairs that come more often, with how much more.
Piece = tuple[bytes, bytes, bytes, bytes]


class Aligner:
    """Takes pieces apart by both tokenizers; a piece for which either gives other bytes is ``None``."""

    def __init__(self, a: str, b: str):
        self.a, self.b = Side(a), Side(b)
        if self.b.size > 1 << 16 or self.a.size > 1 << 24:
            raise ValueError("vocabularies of at most 2 ** 24 and 2 ** 16 entries")
        #: A ids as they are dealt to stripes: neighbours, which in these vocabularies are alike frequent, go to different ones.
        stripes_, ids = -(-self.a.size // STRIPE), np.arange(self.a.size)
        self.place = ids % stripes_ * STRIPE + ids // stripes_
        #: It ages between blocks alone, so that nothing a block has learned is forgotten before it is used.
        self.memo = Memo(lambda piece: self.taken_apart([piece])[0], 1 << 62)

    def learn(self, pieces: set[str]) -> None:
        """Takes apart what of these isn't known, many at once."""
        if len(self.memo) > MEMO_PIECES:
            self.memo.aged()
        new = [p for p in pieces if p not in self.memo and p not in self.memo.old]
        for at in range(0, len(new), AT_ONCE):
            some = new[at : at + AT_ONCE]
            self.memo.update(zip(some, self.taken_apart(some)))

    def taken_apart(self, pieces: list[str]) -> list[Piece | None]:
        """Pieces in a row are one text as long as none has blanks at its ends; if its bytes don't come back, each half is taken alone."""
        if len(pieces) > 1:
            alone = [p for p in pieces if not p or p[0].isspace() or p[-1] == " "]
            if alone:
                found = {p: self.taken_apart([p])[0] for p in alone}
                rest = [p for p in pieces if p not in found]
                found.update(zip(rest, self.taken_apart(rest) if rest else ()))
                return [found[p] for p in pieces]
        raw = [p.encode() for p in pieces]
        whole = b" " + b" ".join(raw)
        text = " ".join(pieces)
        a, b = (np.array(side.ids(text), np.int64) for side in (self.a, self.b))
        if self.a.bytes_of(a).tobytes() != whole or self.b.bytes_of(b).tobytes() != whole:
            half = len(pieces) // 2
            return [None] if not half else self.taken_apart(pieces[:half]) + self.taken_apart(pieces[half:])
        # Places of ends in the text; every piece ends where tokens of both sides end.
        end_a, end_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        common = np.zeros((2, len(whole) + 1), bool)
        common[0, end_a] = common[1, end_b] = True
        common = common.all(0)
        before = np.cumsum(common) - common
        group_a, group_b, ends = before[end_a], before[end_b], np.flatnonzero(common)
        n_a, n_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
        # Groups up to each piece's end, and with them all else.
        last = before[np.cumsum([len(r) + 1 for r in raw])] + 1
        through = np.stack([np.concatenate([[0], np.cumsum(x)]) for x in (n_a, n_b, np.ones(len(ends), np.int64), n_a * n_b)])[:, last]
        figures = np.diff(through, axis=1, prepend=0).T.astype("<i8").tobytes()

        text, length_a, length_b = self._as_text(a, b, group_a, group_b, n_a, n_b)
        characters = np.cumsum(np.bincount(group_a, length_a, len(ends)) + np.bincount(group_b, length_b, len(ends))).astype(np.int64)
        piece = np.repeat(np.arange(len(pieces)), np.diff(last, prepend=0))
        of, pair, times = self._pairs(self.place[a], b, n_a, n_b, piece)
        often = np.flatnonzero(times > 1)
        pair_last, often_last = (np.searchsorted(x, np.arange(1, len(pieces) + 1)) for x in (of, of[often]))
        pairs, more = pair.astype("<i8").tobytes(), np.stack([pair[often], times[often] - 1]).T.astype("<i8").tobytes()
        out, t, p, m = [], 0, 0, 0
        for i, (t_next, p_next, m_next) in enumerate(zip(characters[last - 1].tolist(), (8 * pair_last).tolist(), (16 * often_last).tolist())):
            out.append((figures[32 * i : 32 * i + 32], text[t : t_next - 1], pairs[p:p_next], more[m:m_next]))
            t, p, m = t_next, p_next, m_next
        return out

    def _as_text(self, a, b, group_a, group_b, n_a, n_b) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All groups as text, each with ``;`` after it, and the characters of each token."""
        last_a, last_b = np.cumsum(n_a) - 1, np.cumsum(n_b) - 1
        sign_a, sign_b = np.full(len(a), ord(","), np.uint8), np.full(len(b), ord(","), np.uint8)
        sign_a[last_a], sign_b[last_b] = ord("|"), ord(";")
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        number = np.concatenate([a, b])[order]
        sign = np.concatenate([sign_a, sign_b])[order]
        digits = np.zeros((len(number), 9), np.uint8)
        digits[:, 8] = sign
        left = number.copy()
        for k in range(7, -1, -1):
            digits[:, k] = np.where((left > 0) | (k == 7), left % 10 + 48, 0)
            left //= 10
        length = np.empty(len(order), np.int64)
        length[order] = (digits > 0).sum(1)
        return digits[digits > 0].tobytes(), length[: len(a)], length[len(a) :]

    def _pairs(self, a, b, n_a, n_b, piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece, pair and how often, in order of piece and pair."""
        found = []
        start_a, start_b, product = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b, n_a * n_b
        bounds, at = np.cumsum(product), 0
        while at < len(product):
            # Groups that make so many pairs together, or one that makes more.
            last = max(at + 1, int(np.searchsorted(bounds, (bounds[at - 1] if at else 0) + MADE_AT_ONCE, "right")))
            if product[at] > MADE_AT_ONCE:
                ids_a, times_a = np.unique(a[start_a[at] : start_a[at] + n_a[at]], return_counts=True)
                ids_b, times_b = np.unique(b[start_b[at] : start_b[at] + n_b[at]], return_counts=True)
                code = (ids_a[:, None] << 16 | ids_b).ravel()
                found.append((np.full(len(code), piece[at]), code, np.outer(times_a, times_b).ravel()))
            else:
                of_a = np.repeat(np.arange(at, last), n_a[at:last])
                times = n_b[of_a]
                left = np.repeat(a[start_a[at] : start_a[at] + len(of_a)], times)
                right = b[within(start_b[of_a], times)]
                key = np.sort(np.repeat(piece[of_a], times) << 40 | left << 16 | right)
                first = np.flatnonzero(np.diff(key, prepend=-1))
                found.append((key[first] >> 40, key[first] & (1 << 40) - 1, np.diff(first, append=len(key))))
            at = last
        return found[0] if len(found) == 1 else _summed(*(np.concatenate(x) for x in zip(*found)))


def _sums(at: np.ndarray, values: np.ndarray, size: int | tuple[int, int]) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, at, values)
    return out


def _summed(first: np.ndarray, second: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal pairs of numbers once, in order, with the sum of their times."""
    order = np.lexsort((second, first))
    first, second, times = first[order], second[order], times[order]
    at = np.flatnonzero((np.diff(first, prepend=-1) != 0) | (np.diff(second, prepend=-1) != 0))
    return first[at], second[at], np.add.reduceat(times, at) if len(at) else times


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers in one compressed string, each in the narrowest type."""
    parts = []
    for x in arrays:
        kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(x) or int(x.max()) < 1 << (8 * int(k[2])))
        parts.append(int(kind[2]).to_bytes(1, "little") + len(x).to_bytes(8, "little") + x.astype(kind).tobytes())
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 0
    while at < len(raw):
        width, size = raw[at], int.from_bytes(raw[at + 1 : at + 9], "little")
        out.append(np.frombuffer(raw, f"<u{width}", size, at + 9).astype(np.int64))
        at += 9 + width * size
    return out


class Block:
    """The links of a batch of documents."""

    def __init__(self, aligner: Aligner, texts: list[str | None]):
        cuts = [cut(" " + t) if t else [] for t in texts]
        aligner.learn({p for c in cuts for p in c if len(p) <= MEMO_LENGTH})
        known = aligner.memo.__getitem__
        self.digests: list[str] = []
        joined: list[tuple[bytes, bytes, bytes]] = []
        for pieces in cuts:
            found = list(map(known, pieces))
            if not found or None in found:
                self.digests.append("")
                joined.append((b"", b"", b""))
                continue
            figures, text, pairs, more = zip(*found)
            self.digests.append(hashlib.sha256(b";".join(text)).hexdigest())
            joined.append((b"".join(figures), b"".join(pairs), b"".join(more)))
        figures, pair, more = (np.frombuffer(b"".join(x), "<i8").reshape(-1, n) for x, n in zip(zip(*joined), (4, 1, 2)))
        of_piece, of_pair, of_more = (np.repeat(np.arange(len(texts)), [len(x) // (8 * n) for x in parts]) for parts, n in zip(zip(*joined), (4, 1, 2)))
        #: Tokens of A, tokens of B, groups and links of each document.
        self.figures = _sums(of_piece, figures, (len(texts), 4)).T
        pair = pair[:, 0]
        # In order of pair and document: pair, document and how often.
        if len(more) or len(texts) > 1 << 20:
            pair, doc = np.concatenate([pair, more[:, 0]]), np.concatenate([of_pair, of_more])
            self.pair, self.doc, self.times = _summed(pair, doc, np.concatenate([np.ones(len(of_pair), np.int64), more[:, 1]]))
        else:
            key = np.sort(pair << 20 | of_pair)
            first = np.flatnonzero(np.diff(key, prepend=-1))
            self.doc, self.pair, self.times = key[first] & (1 << 20) - 1, key[first] >> 20, np.diff(first, append=len(key))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Each pair once, and where its documents begin."""
        first = np.flatnonzero(np.diff(self.pair, prepend=-1))
        return self.pair[first], first


class Sums:
    """Documents of each pair in one task."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, pair: np.ndarray, documents: np.ndarray) -> None:
        self.parts.append((pair, documents))
        self.held += len(pair)
        if self.held > 2 * HELD_PAIRS:
            self.parts = [self.merged()]
            self.held = len(self.parts[0][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        pair, documents = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(pair, kind="stable")
        pair, documents = pair[order], documents[order]
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        return pair[first], np.add.reduceat(documents, first) if len(first) else documents

    def taken(self) -> tuple[np.ndarray, np.ndarray] | None:
        if not self.parts:
            return None
        out, self.parts, self.held = self.merged(), [], 0
        return out


def stripes(pair: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Where each stripe's pairs are, of pairs in order."""
    stripe = (pair >> 16) // STRIPE
    first = np.flatnonzero(np.diff(stripe, prepend=-1))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(pair)]):
        yield int(stripe[a]), slice(a, b)


def tokenised(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of ``TABLE``: figures of each block's documents, links by block and stripe, sums by stripe."""
    arrow = to_arrow_schema(docs.sparkSession, TABLE)
    key = ("aligner", a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept(key, lambda: Aligner(a, b))
        sums, block = Sums(), TaskContext.get().partitionId() << 33

        def counted() -> list[tuple]:
            pair, documents = sums.taken() or (np.zeros(0, np.int64),) * 2
            return [("sums", s, None, None, packed(pair[at], documents[at]), None, None, None) for s, at in stripes(pair)]

        for batch in batches:
            found = Block(aligner, batch.column(1).to_pylist())
            pair, first = found.pairs()
            documents = np.diff(first, append=len(found.pair))
            rows = [("documents", None, block, None, None, batch.column(0).to_pylist(), packed(*found.figures), found.digests)]
            for s, at in stripes(pair):
                links = slice(first[at.start], first[at.stop] if at.stop < len(first) else len(found.pair))
                rows.append(("links", s, block, links.stop - links.start, packed(pair[at] - (s * STRIPE << 16), documents[at], found.doc[links], found.times[links]), None, None, None))
            sums.add(pair, documents)
            if sums.held > HELD_PAIRS:
                rows += counted()
            yield _rows(rows, arrow)
            block += 1
        yield _rows(counted(), arrow)

    return map_batches(only(docs, "doc_id", "text"), run, TABLE, keeps=key)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def in_order(df: DataFrame, keys: list[str], then: list[str], make: Callable, schema: str) -> DataFrame:
    """Deals rows by ``keys``, puts them in order and gives them one by one to a task's own step; see ``make``.

    ``make()`` returns a function from a row (a dict), or ``None`` at the end, to rows to emit.
    """
    arrow = to_arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for row in batch.to_pylist():
                if out := step(row):
                    yield _rows(out, arrow)
        if out := step(None):
            yield _rows(out, arrow)

    return map_batches(df.repartition(*keys).sortWithinPartitions(*keys, *then), run, schema)


def best_counts(sums: DataFrame, width: int) -> DataFrame:
    """stripe, payload (pair, documents, whether it is a best one of its A id) of every stripe, from partial sums."""

    def make():
        matrix, now = np.zeros((STRIPE, width), np.int64), None

        def out() -> list[tuple]:
            best = matrix.max(1)
            at, b = np.nonzero(matrix)
            count = matrix[at, b]
            return [(now, packed(at << 16 | b, count, count == best[at]))]

        def step(row):
            nonlocal now
            done = []
            if now is not None and (row is None or row["stripe"] != now):
                done = out()
                matrix[:] = 0
            if row is not None:
                now = row["stripe"]
                pair, documents = unpacked(row["payload"])
                np.add.at(matrix, ((pair >> 16) - now * STRIPE, pair & 0xFFFF), documents)
            return done

        return step

    return in_order(sums.select("stripe", "payload"), ["stripe"], [], make, "stripe int, payload binary")


def scored(links: DataFrame, counts: DataFrame, width: int, salts: int) -> DataFrame:
    """block, payload (document in the block, links that are best, sum of counts), from links and counts that meet by stripe and salt."""
    salted = links.select("stripe", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("after"), "block", "payload")
    beside = counts.select("stripe", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("after"), F.lit(None).cast("long").alias("block"), "payload")

    def make():
        count, best = np.zeros((STRIPE, width), np.int64), np.zeros((STRIPE, width), bool)

        def step(row):
            if row is None:
                return None
            if not row["after"]:
                count[:], best[:] = 0, False
                pair, documents, high = unpacked(row["payload"])
                count[pair >> 16, pair & 0xFFFF] = documents
                best[pair >> 16, pair & 0xFFFF] = high
                return None
            pair, documents, doc, times = unpacked(row["payload"])
            at = pair >> 16, pair & 0xFFFF
            n_best, total = np.repeat(best[at], documents) * times, np.repeat(count[at], documents) * times
            found, place = np.unique(doc, return_inverse=True)
            return [(row["block"], packed(found, _sums(place, n_best, len(found)), _sums(place, total, len(found))))]

        return step

    return in_order(salted.unionByName(beside), ["stripe", "salt"], ["after"], make, "block long, payload binary")


def finished(documents: DataFrame, parts: DataFrame) -> DataFrame:
    """One row a document, from its block's figures and the sums of all stripes."""
    none = {c: F.lit(None).cast(t) for c, t in (("payload", "binary"), ("doc_id", "array<long>"), ("figures", "binary"), ("digests", "array<string>"))}
    both = documents.select("block", F.lit(0).alias("after"), none["payload"].alias("payload"), "doc_id", "figures", "digests").unionByName(
        parts.select("block", F.lit(1).alias("after"), "payload", *[none[c].alias(c) for c in ("doc_id", "figures", "digests")])
    )

    def make():
        now: dict = {}

        def out() -> list[tuple]:
            if not now:
                return []
            columns = [x.tolist() for x in (*now["figures"], *now["sums"])]
            return list(zip(now["doc_id"], *columns, now["digests"]))

        def step(row):
            nonlocal now
            done = []
            if row is None or not row["after"]:
                done = out()
                now = {}
            if row is not None and not row["after"]:
                figures = unpacked(row["figures"])
                now = {"figures": figures, "sums": np.zeros((2, len(row["digests"])), np.int64), "doc_id": row["doc_id"], "digests": row["digests"]}
            elif row is not None:
                doc, *sums = unpacked(row["payload"])
                for total, some in zip(now["sums"], sums):
                    total[doc] += some
            return done

        return step

    return in_order(both, ["block"], ["after"], make, SCHEMA)


def aligned(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs`` (doc_id, text).

    ``a`` is the file of a byte-level tokenizer, ``b`` of a piece model with
    byte fallback.  A null or empty text, and one of which either tokenizer
    gives other bytes than a blank and the text, has no tokens: zeros and an
    empty digest.  Rows that repeat are documents of their own; a null doc_id
    stays null; an empty table gives no rows.  A group of very many different
    ids on both sides needs memory for its different pairs.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "alignment-")
    tokenised(docs, a, b).write.partitionBy("kind").option("compression", "none").parquet(path)
    table = spark.read.schema(TABLE).parquet(path)
    kind = lambda k: table.where(F.col("kind") == k)
    width = Side(b).size
    counts = written(best_counts(kind("sums"), width))
    most = kind("links").groupBy("stripe").agg(F.sum("links").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = scored(kind("links"), counts, width, max(1, -(-most // SALT_LINKS)))
    return finished(kind("documents"), parts)

"""Language identification of mixed texts.

Every word is scored for every language by byte trigrams (smoothed log
likelihood, counted over all training documents); the script of its first
letter, known by code ranges, leaves only the languages that were seen to use
that script.  Viterbi with a penalty for each switch then labels the words, so
spans of different languages in one text are found.  Scores of a whole Arrow
batch are computed at once; a text that provably has no switch (no run of words
gains more from other languages than one penalty) skips the dynamic program.

How well its languages explain a text is its ``fit``: the median, over the letters
of words that touch no digit, of the mean log likelihood of their word's letters;
a few odd words, as names and keys, don't move it.  Where it is below that of the
uniform distribution over all cells, knowing the language explains the text worse
than knowing nothing: it is in no learned language, and ``known_language`` rejects
it.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, map_rows, only, to_arrow_schema

#: Cells of the trigram table; nats for one switch; share of a language's words that a script needs.
CELLS, PENALTY, SCRIPT_SHARE = 1 << 16, 12.0, 0.01
SMOOTHING = 0.5
UNKNOWN = "und"
#: Fit of the uniform distribution; fewest letters (bytes) that tell whether a text is in a language.
LEAST_FIT, FIT_LETTERS = -math.log(CELLS), 60
#: Characters that are scored at once, over the number of languages.
PIECE = 1 << 21
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, fit double"

#: First and last code point of the ranges that tell scripts apart (fixed values of Unicode).
SCRIPTS = (
    ("Latin", 0x41, 0x24F),
    ("Greek", 0x370, 0x3FF),
    ("Cyrillic", 0x400, 0x52F),
    ("Armenian", 0x530, 0x58F),
    ("Hebrew", 0x590, 0x5FF),
    ("Arabic", 0x600, 0x77F),
    ("Devanagari", 0x900, 0x97F),
    ("Bengali", 0x980, 0x9FF),
    ("Tamil", 0xB80, 0xBFF),
    ("Telugu", 0xC00, 0xC7F),
    ("Thai", 0xE00, 0xE7F),
    ("Georgian", 0x10A0, 0x10FF),
    ("Hangul", 0x1100, 0x11FF),
    ("Ethiopic", 0x1200, 0x137F),
    ("Khmer", 0x1780, 0x17FF),
    ("Latin", 0x1E00, 0x1EFF),
    ("Greek", 0x1F00, 0x1FFF),
    ("Kana", 0x3040, 0x30FF),
    ("Han", 0x3400, 0x9FFF),
    ("Hangul", 0xAC00, 0xD7AF),
    ("Han", 0x20000, 0x3FFFF),
)
NAMES = sorted({name for name, _, _ in SCRIPTS}) + ["other"]
_FROM = np.array([a for _, a, _ in SCRIPTS])
_TO = np.array([b for _, _, b in SCRIPTS])
_ID = np.array([NAMES.index(name) for name, _, _ in SCRIPTS])

_B = np.arange(256)
#: Small ASCII letters; bytes of other characters count as letters, all else as a blank.
FOLD = np.where((_B >= 65) & (_B <= 90), _B + 32, np.where(((_B >= 97) & (_B <= 122)) | (_B >= 128), _B, 32)).astype(np.uint8)


def script_of(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number in ``NAMES`` of the script of the UTF-8 character at each place (4 bytes follow the last)."""
    b = data[at[:, None] + np.arange(4)].astype(np.int64)
    lead, tail = b[:, 0], b[:, 1:] & 0x3F
    code = np.select(
        [lead < 0x80, lead < 0xE0, lead < 0xF0],
        [lead, ((lead & 0x1F) << 6) | tail[:, 0], ((lead & 0x0F) << 12) | (tail[:, 0] << 6) | tail[:, 1]],
        ((lead & 0x07) << 18) | (tail[:, 0] << 12) | (tail[:, 1] << 6) | tail[:, 2],
    )
    i = np.maximum(np.searchsorted(_FROM, code, "right") - 1, 0)
    return np.where((code >= _FROM[i]) & (code <= _TO[i]), _ID[i], len(NAMES) - 1)


class Words:
    """Letter runs of a batch of texts: bytes, trigram cells, starts, ends, scripts, and where each text's words start."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        joined = b" " + b" ".join(raw) + b"     "
        source = np.frombuffer(joined, np.uint8)
        data = FOLD[source]
        letter = data != 32
        self.start = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
        self.end = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
        digit = (source >= 48) & (source <= 57)
        self.plain = ~(digit[self.start - 1] | digit[self.end])
        wide = data.astype(np.uint32)
        h = (wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(0x9E3779B1)
        self.cell = (h >> np.uint32(16)).astype(np.int32)  # of the trigram round place i + 1
        self.script = script_of(data, self.start) if len(self.start) else np.empty(0, np.int64)
        lengths = np.array([len(x) + 1 for x in raw], np.int64)
        self.first = np.searchsorted(self.start, np.concatenate([[1], 1 + np.cumsum(lengths)]))

    def grams(self, words: slice) -> np.ndarray:
        """Cells of all trigrams round letters of a run of words."""
        lo, hi = self.start[words], self.end[words]
        if not len(lo):
            return np.empty(0, np.int32)
        n = hi - lo
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return self.cell[at - 1]


def pieces(texts: list[str | None], most: int = PIECE // 4) -> Iterator[tuple[int, list[str | None]]]:
    """Parts of a batch of at most about ``most`` characters."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > most:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(t or "")
    if texts:
        yield begin, texts[begin:]


class Model:
    """Languages with their trigram scores and scripts."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        if langs:
            total = counts.sum(1, keepdims=True)
            self.table = np.ascontiguousarray(np.log((counts + SMOOTHING) / (total + SMOOTHING * CELLS)).T.astype(np.float32))
            self.uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)

    def scores(self, words: Words) -> np.ndarray:
        """A row of log likelihoods for each word; languages that its script rules out get the lowest value."""
        s = np.empty((len(words.start), len(self.langs)))
        # A long text's words are taken in runs, so that memory doesn't grow with the text.
        first, most = 0, max(1 << 14, PIECE // max(4, len(self.langs)))
        while first < len(s):
            last = max(first + 1, int(np.searchsorted(words.end, words.start[first] + most, "right")))
            base = words.start[first] - 1
            every = self.table[words.cell[base : words.end[last - 1]]]
            edges = np.column_stack([words.start[first:last] - 1 - base, words.end[first:last] - 1 - base]).ravel()
            s[first:last] = np.add.reduceat(every, edges, axis=0)[::2]
            first = last
        if not len(s):
            return s
        allowed = self.uses[:, words.script].T
        allowed = allowed | ~allowed.any(1, keepdims=True)
        return np.where(allowed, s, s.min(1, keepdims=True) - PENALTY)


def viterbi(s: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best language of each word when a change of language costs ``penalty``; ties go to the earlier one."""
    best = int(s.sum(0).argmax())
    gain = np.delete(s, best, 1).max(1) - s[:, best] if s.shape[1] > 1 else np.zeros(len(s))
    total = np.concatenate([[0.0], np.cumsum(gain)])
    if (total - np.minimum.accumulate(total)).max() <= penalty:
        return np.full(len(s), best)
    back = np.empty(s.shape, np.int32)
    stay, value = np.arange(s.shape[1]), np.zeros(s.shape[1])
    for t in range(len(s)):
        top = int(value.argmax())
        switch = value < value[top] - penalty
        back[t] = np.where(switch, top, stay)
        value = np.where(switch, value[top] - penalty, value) + s[t]
    path = np.empty(len(s), np.int32)
    at = int(value.argmax())
    for t in range(len(s) - 1, -1, -1):
        path[t] = at
        at = back[t, at]
    return path


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame) -> Model:
    """Counts over every document that is not held out and has an id, a text and a language.

    The table has ``CELLS`` cells a language, whatever the number of documents.
    """
    rows = only(docs, "doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    schema = "lang string, cell int, n long"
    arrow = to_arrow_schema(docs.sparkSession, schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for begin, part in pieces(batch.column(0).to_pylist()):
                words = Words(part)
                for i in range(len(part)):
                    here = slice(words.first[i], words.first[i + 1])
                    total = totals.setdefault(langs[begin + i], np.zeros(CELLS + len(NAMES), np.int64))
                    total[:CELLS] += np.bincount(words.grams(here), minlength=CELLS)
                    total[CELLS:] += np.bincount(words.script[here], minlength=len(NAMES))
        for lang, total in totals.items():
            cells = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells)), pa.array(cells.astype(np.int32)), pa.array(total[cells])], schema=arrow)

    counts = map_batches(rows.select("text", "lang"), count, schema).groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts["lang"].to_pylist()))
    table = np.zeros((len(langs), CELLS + len(NAMES)), np.int64)
    if langs:
        table[np.searchsorted(langs, counts["lang"].to_pylist()), counts["cell"].to_numpy()] = counts["n"].to_numpy()
    return Model(langs, table[:, :CELLS], table[:, CELLS:])


def labelled_words(model: Model, texts: list[str | None]) -> Iterator[tuple[int, Words, slice, np.ndarray, np.ndarray]]:
    """For each text its number, words, their slice, scores and languages."""
    for begin, part in pieces(texts):
        words = Words(part)
        scores = model.scores(words)
        for i in range(len(part)):
            here = slice(words.first[i], words.first[i + 1])
            s = scores[here]
            yield begin + i, words, here, s, viterbi(s) if len(s) else np.empty(0, np.int32)


class Prediction(NamedTuple):
    lang: str = UNKNOWN
    score: float = 0.0
    #: Median over letters of their word's mean log likelihood, under the text's labels; letters (bytes) of words that touch no digit.
    fit: float = 0.0
    letters: int = 0


def predicted(model: Model, texts: list[str | None]) -> list[Prediction]:
    """The language with the most letters of each text, its score and fit.

    The score is that language's share of the letters, times how sure the whole
    text's likelihoods are of the language over the next.
    """
    out = [Prediction()] * len(texts)
    if not model.langs:
        return out
    for i, words, here, s, path in labelled_words(model, texts):
        if not len(s) or not has_letter(texts[i]):
            continue
        size = words.end[here] - words.start[here]
        letters = np.bincount(path, weights=size, minlength=len(model.langs))
        best = int(letters.argmax())
        own = s[path == best].sum(0)
        margin = own[best] - np.delete(own, best).max() if len(own) > 1 else np.inf
        plain = np.flatnonzero(words.plain[here])
        each, weight = (s[np.arange(len(s)), path] / size)[plain], size[plain]
        fit, order = 0.0, np.argsort(each)
        if len(plain):
            fit = each[order[np.searchsorted(np.cumsum(weight[order]), weight.sum() / 2)]]
        out[i] = Prediction(model.langs[best], float(letters[best] / letters.sum() / (1 + np.exp(-max(0.0, margin)))), float(fit), int(weight.sum()))
    return out


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document row; ``und`` with score 0 where the text is null or has no letter, or nothing was learned.

    Ids may be null or repeat; every row is judged by its own text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            found = predicted(shared.value, batch.column(2).to_pylist())
            return {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": [x.lang for x in found], "score": [x.score for x in found], "fit": [x.fit for x in found]}

        return step

    rows = only(docs, "doc_id", "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_rows(rows, make, SCHEMA)


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """One row per run of words of one language: its first and last word's number and number of letters' bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("doc_id", "span", "lang", "first_word", "last_word", "letter_bytes")}
            ids = batch.column(0).to_pylist()
            for i, words, here, _, path in labelled_words(shared.value, batch.column(1).to_pylist()):
                cuts = [0, *(np.flatnonzero(np.diff(path)) + 1), len(path)] if len(path) else [0]
                size = words.end[here] - words.start[here]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    for name, x in zip(out, (ids[i], k, shared.value.langs[path[a]], a, b - 1, int(size[a:b].sum()))):
                        out[name].append(x)
            return out

        return step

    return map_rows(only(docs, "doc_id", "text"), make, "doc_id long, span int, lang string, first_word int, last_word int, letter_bytes long")


def known_language(docs: DataFrame, model: Model | None = None, languages: Collection[str] | None = None, least: float = 0.0) -> DataFrame:
    """The documents, all columns, that are in a language; ``lang`` becomes the language that was found.

    Rejected are texts that are null or have no letter, texts of ``FIT_LETTERS``
    letters or more whose fit is below ``LEAST_FIT`` (shorter ones can't be told), and, where a caller asks, those whose language is not among
    ``languages`` or whose score is below ``least``.  Where nothing could be
    learned, because no row has a language, every text with a letter stays as
    it is, with its ``lang``.  Rows that repeat an id are judged each.
    """
    shared, names = docs.sparkSession.sparkContext.broadcast(model or train(docs)), docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            if not m.langs:
                yield batch.filter(pa.array([has_letter(t) for t in texts], pa.bool_()))
                continue
            found = predicted(m, texts)
            keep = [x.lang != UNKNOWN and (x.letters < FIT_LETTERS or x.fit >= LEAST_FIT) and (languages is None or x.lang in languages) and x.score >= least for x in found]
            columns = list(batch.columns)
            if "lang" in names:
                i = names.index("lang")
                columns[i] = pa.array([x.lang for x in found], columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    return map_batches(docs, run, docs.schema)

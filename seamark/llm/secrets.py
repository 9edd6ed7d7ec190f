"""Secret scans: fixed patterns, and a character convolutional network over every candidate.

The patterns' findings stand.  They also label the training data: a finding is
a positive, and so is what is made of it: put in the place of another token of
its text, without the name before it, and spelt anew in several alphabets and
lengths; so the network can't lean on what the patterns ask for.  Of the other tokens, those that
don't resemble a finding are negatives, and so are words of a text joined to
long names: a key format that the patterns miss is not taught as harmless, nor
mere length as a secret.  A network in numpy reads the characters before, in and
after a token, a long token in several windows whose highest score counts; one
convolution, the maximum over places, one output.  It learns from all documents:
their examples are dealt into blocks, every block teaches a copy in some turns,
and after each turn the copies are averaged.  From the second turn on all other
tokens are scored, and what the network mistakes is learned the more.  Its scores are
calibrated on all held-back examples; for each form of token the threshold is the
most precise that still finds ``RECALL`` of the labelled ones there, but never
below even odds.  Plain words and numbers are forms of their own: no spelling
tells a secret word from an invented one, so their threshold lies beyond the
scores of all such tokens, and as far beyond as the tail of these scores asks for.  Tokens above their threshold that no
pattern found are added as ``model`` spans; findings are scored too, but never
taken away.
"""

from __future__ import annotations

import copy
import functools
import hashlib
import heapq
import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, map_batches, map_rows, only, to_arrow_schema, written

KINDS = ("assign", "access", "hex", "model")
#: Turns of training; steps of each block in a turn.
TURNS, STEPS = 4, 500
RECALL, BATCH, RATE = 0.98, 64, 0.005
#: Bytes of text of a block of examples; findings that a block should have, and those that are lent to blocks with fewer.
BLOCK, FINDINGS, LENT = 24 << 20, 256, 4_096
#: Parameters are summed in units of 1/``SCALE``; cells of a logit.
SCALE, CELLS = 1 << 32, 256
#: Examples and tokens that a worker holds or remembers.
SEEN, KNOWN = 200_000, 300_000
#: Characters that are read at once, a longer text alone; examples that a row of the shuffle has at most.
AT_ONCE, SENT = 1 << 20, 8_192
#: From this logit on another token is taken for a finding, or nearly: odds of one in twenty.
MISTAKEN = -3.0
#: Tokens below even odds are never added.
EVEN = 0.5
#: Characters before, in and after a token that the network reads; width and number of its filters.
BEFORE, TOKEN, AFTER, TAPS, FILTERS = 24, 36, 4, 5, 12
#: Places whose filter lies within the token.
INNER = slice(BEFORE, BEFORE + TOKEN - TAPS + 1)
CODES = 98
#: Fewest characters of a finding that is spelt anew, and the places of other tokens that one is put in.
SHORT, PLACES = 16, 8
#: Fewest findings and other tokens, learned from and held back, for a network.
LEAST_EXAMPLES = 4
#: Labels; those of findings, also in the place of another token, are odd.
DIGIT_TOKEN, FOUND, PLAIN_TOKEN, FREE, NAME = range(5)
#: In place of a label: a token that is no example.
PASSED_OVER = 255
#: An example as it is shuffled.
EXAMPLE = np.dtype([("rank", "<u4"), ("code", "u1", BEFORE + TOKEN + AFTER), ("label", "u1"), ("form", "u1"), ("held", "u1"), ("n", "<u4")])
MASK = "[SECRET]"

WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A maximal run of 32 or more, as the plain pattern's long matches are.
HEX = re.compile(r"[0-9a-f]{32,}")
# Bytes that such a run has as 1, and the least run: a text without it is not searched.
HEX_BYTES, HEX_RUN = bytes(b in b"0123456789abcdef" for b in range(256)), b"\1" * 32
# Any token of 8 or more, as assigned values are; letters of all alphabets, so that none is judged by a part.
INSIDE, LEAST = r"[\w+/.=@-]", 8
CANDIDATE = re.compile(f"{INSIDE}{{{LEAST},}}")
DIGIT, LATIN_WORD = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]+")
# Where a run changes between letters and digits, or from a small letter to a capital.
CHANGE = re.compile(r"(?<=[^\W\d_])\d|(?<=\d)[^\W\d_]|(?<=[a-zß-öø-ÿ])[A-ZÀ-ÖØ-Þ]")
LETTER = re.compile(r"[^\W\d_]")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long, least_base_score double"

#: Forms of a token, each with a threshold: no letter, hexadecimal, capitals and digits, letters without a change inside, all else.
FORMS = ("number", "hex", "capital", "word", "mixed")
#: Forms whose threshold follows the other tokens.
PLAIN = ("number", "word")
#: Scores of each form that show a tail, and false findings expected beyond it in the corpus.
TAIL, EXPECTED = 200, 0.1
WORD = FORMS.index("word")
HEX_FORM, CAPITAL_FORM = re.compile(r"[0-9a-fA-F-]+"), re.compile(r"[0-9A-Z_-]+")
#: Alphabets that findings are spelt with anew.
ALPHABETS = (
    "0123456789abcdefghijklmnopqrstuvwxyz",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ-_",
    "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/",
    "0123456789abcdef",
)


#: The alphabets as the network's codes, one a row, and their sizes.
_SIZES = np.array([len(x) for x in ALPHABETS])
_LETTERS = np.array([[ord(x[k % len(x)]) - 31 for k in range(_SIZES.max())] for x in ALPHABETS])


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    #: Where the secret itself starts.
    value: int

    def text(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


def base_spans(text: str) -> list[Span]:
    """Findings of the fixed patterns by start, then kind."""
    out = []
    small = text.lower()
    if any(w in small for w in WORDS):
        out += [Span("assign", *m.span(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [Span("access", *m.span(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if HEX_RUN in text.encode("utf-8", "surrogatepass").translate(HEX_BYTES):
        out += [Span("hex", *m.span(), m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Tokens that touch no finding."""
    out, k, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while k < len(base) and base[k].start < b:
            reach = max(reach, base[k].end)
            k += 1
        if reach <= a:
            out.append((a, b))
    return out


def is_small_word(token: str) -> bool:
    """Letters, small after the first: what most tokens are."""
    return token.isalpha() and token[1:].islower()


def resembles_finding(token: str) -> bool:
    """Letters, digits and cases change as often as in a key; mail addresses apart."""
    return not is_small_word(token) and "@" not in token and len(CHANGE.findall(token)) >= 3


def form_of(token: str) -> str:
    if is_small_word(token):
        return "word"
    if not LETTER.search(token):
        return "number"
    if DIGIT.search(token):
        if HEX_FORM.fullmatch(token):
            return "hex"
        if CAPITAL_FORM.fullmatch(token):
            return "capital"
    return "mixed" if CHANGE.search(token) else "word"


def respelt(c: np.ndarray, free: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Windows whose token, where it is free, is spelt anew by one of ``ALPHABETS``, of a length from ``SHORT`` on."""
    at = np.flatnonzero(free)
    if not len(at):
        return c
    c = c.copy()
    kind = rng.integers(0, len(_LETTERS), len(at))
    token = _LETTERS[kind[:, None], (rng.random((len(at), TOKEN)) * _SIZES[kind][:, None]).astype(np.int64)]
    # Some have signs between groups; some fill the window, as tokens that are longer do.
    group = rng.integers(4, 13, len(at))[:, None]
    token = np.where((rng.random(len(at)) < 0.25)[:, None] & (np.arange(TOKEN) % group == group - 1), ord("-") - 31, token)
    size = np.where(rng.random(len(at)) < 0.3, TOKEN, rng.integers(SHORT, TOKEN + 1, len(at)))
    c[at, BEFORE : BEFORE + TOKEN] = np.where(np.arange(TOKEN) < size[:, None], token, 0)
    return c


def beside_keys(c: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Windows, a quarter of them with a key before or after the token: a neighbour's looks tell nothing."""
    c = c.copy()
    for rows, a, b, blank in ((np.flatnonzero(rng.random(len(c)) < 0.15), 0, BEFORE - 1, BEFORE - 1), (np.flatnonzero(rng.random(len(c)) < 0.15), BEFORE + TOKEN + 1, c.shape[1], BEFORE + TOKEN)):
        kind = rng.integers(0, len(_LETTERS), len(rows))
        c[rows, a:b] = _LETTERS[kind[:, None], (rng.random((len(rows), b - a)) * _SIZES[kind][:, None]).astype(np.int64)]
        c[rows, blank] = 1
    return c


def joined_words(words: list[str], seed: str) -> str:
    """Two to six of these words as one name; the same for the same seed."""
    drawn = hashlib.blake2b(seed.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    n, at = 2 + drawn[0] % 5, int.from_bytes(drawn[1:9], "little") % len(words)
    few, sign = words[at : at + n], ("", "_", "-", "/", ".", "T")[drawn[9] % 6]
    few = few[:1] + [w.capitalize() for w in few[1:]] if sign == "T" else few
    return sign.strip("T").join(few) + (str(drawn[10] % 100) if drawn[11] % 4 == 0 else "")


def blanked(text: str, base: list[Span]) -> str:
    """The text with NUL for findings, so that a token beside one isn't judged by it."""
    out, at = [], 0
    for s in base:
        out += [text[at : s.start], "\0" * (s.end - max(at, s.start))]
        at = max(at, s.end)
    return "".join([*out, text[at:]]) if base else text


def window(text: str, start: int, end: int, at: int | None = None) -> str:
    """The characters that the network reads, padded to one length with NUL; of the token those from ``at``."""
    at = start if at is None else at
    return text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0") + text[at : min(end, at + TOKEN)].ljust(TOKEN, "\0") + text[end : end + AFTER].ljust(AFTER, "\0")


def parts(start: int, end: int) -> list[int]:
    """Where windows over the whole token begin, half overlapping; the last one ends with it."""
    return [start] if end - start <= TOKEN else [*range(start, end - TOKEN, TOKEN // 2), end - TOKEN]


def windows(text: str, start: int, end: int) -> list[str]:
    return [window(text, start, end, at) for at in parts(start, end)]


def codes(windows: list[str], width: int = BEFORE + TOKEN + AFTER) -> np.ndarray:
    """0: padding, 1 to 95: ASCII from blank to tilde, 96: other control characters, 97: beyond ASCII."""
    if not windows:
        return np.empty((0, width), np.int64)
    c = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(windows), -1).astype(np.int64)
    return np.where(c == 0, 0, np.where(c > 126, 97, np.where(c < 32, 96, c - 31)))


#: Between texts that are read at once, so that what stands before a token is of its text.
GAP = "\0" * BEFORE


@functools.cache
def _characters() -> np.ndarray:
    """Of every character the network's code, and 128 more if tokens have it."""
    every = "".join(map(chr, range(0x110000)))
    found = codes([every], len(every))[0].astype(np.uint8)
    for m in re.finditer(f"{INSIDE}+", every):
        found[m.start() : m.end()] += 128
    return found


class Texts:
    """Texts joined, with all their tokens (those of ``CANDIDATE``) in order."""

    def __init__(self, texts: list[str]):
        self.text = GAP + "".join(t + GAP for t in texts)
        known, found = _characters(), np.empty(len(self.text), np.uint8)
        for i in range(0, len(found), AT_ONCE):
            found[i : i + AT_ONCE] = known.take(np.frombuffer(self.text[i : i + AT_ONCE].encode("utf-32-le", "surrogatepass"), "<u4"))
        inside = found > 127
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        start, end = edge[::2], edge[1::2]
        long = end - start >= LEAST
        #: Codes; where each text begins; where each token begins and ends, and its text.
        self.code = found & 127
        self.first = np.cumsum([BEFORE] + [len(t) + BEFORE for t in texts])[:-1]
        self.start, self.end = start[long], end[long]
        self.owner = np.searchsorted(self.first, self.start, "right") - 1

    def tokens(self) -> list[str]:
        text = self.text
        return [text[a:b] for a, b in zip(self.start.tolist(), self.end.tolist())]

    def inner(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Codes from ``start`` to ``end``, ``TOKEN`` of them at most."""
        at = start[:, None] + np.arange(TOKEN)
        return np.where(at < end[:, None], self.code.take(at, mode="clip"), 0)

    def windows(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """``codes`` of the windows of whole tokens."""
        before, after = (self.code.take(at[:, None] + np.arange(n)) for at, n in ((start - BEFORE, BEFORE), (end, AFTER)))
        return np.concatenate([before, self.inner(start, end), after], 1)


def at_once(texts: list[str]) -> Iterator[list[int]]:
    """Places of texts that are read together."""
    some, size = [], 0
    for i, t in enumerate(texts):
        if some and size + len(t) > AT_ONCE:
            yield some
            some, size = [], 0
        some.append(i)
        size += len(t)
    if some:
        yield some


class Network:
    """One convolution over characters, rectified; its maximum and mean over the token's places and its maximum over those round it; one output."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.w = rng.normal(0, 0.1, (TAPS, CODES, FILTERS))
        self.b, self.v, self.v0 = np.zeros(FILTERS), rng.normal(0, 0.3, 3 * FILTERS), np.zeros(1)
        #: Slope and intercept of the calibration; thresholds of a calibrated score by form.
        self.slope, self.shift = 1.0, 0.0
        self.thresholds = dict.fromkeys(FORMS, np.inf)
        self.known: dict[str, float] = {}

    @property
    def learned(self) -> bool:
        return any(map(np.isfinite, self.thresholds.values()))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What two neighbours add at the first two taps and at the next two, and what one adds at the last, with the bias."""
        w = self.w.astype(np.float32)
        one, two = ((w[k][:, None] + w[k + 1][None]).reshape(-1, FILTERS) for k in (0, 2))
        return one, two, w[4] + self.b.astype(np.float32)

    @staticmethod
    def rectified(x: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """The filters at every place of ``x``."""
        one, two, last = tables
        x = x.astype(np.intp)
        two_of, places = x[:, :-1] * CODES + x[:, 1:], x.shape[1] - TAPS + 1
        z = one.take(two_of[:, :places], 0)
        z += two.take(two_of[:, 2 : 2 + places], 0)
        z += last.take(x[:, 4:], 0)
        return np.maximum(z, 0, out=z)

    def logits(self, c: np.ndarray) -> np.ndarray:
        return self.inner(c[:, BEFORE : BEFORE + TOKEN]) + self.beside(c)

    def beside(self, c: np.ndarray) -> np.ndarray:
        """What stands round the tokens adds to a logit."""
        tables, out = self.tables(), np.empty(len(c))
        for i in range(0, len(c), 512):
            left, right = (self.rectified(x, tables).max(1) for x in (c[i : i + 512, : INNER.start + TAPS - 1], c[i : i + 512, INNER.stop :]))
            out[i : i + 512] = np.maximum(left, right) @ self.v[2 * FILTERS :]
        return out

    def inner(self, c: np.ndarray) -> np.ndarray:
        """What tokens (codes, ``TOKEN`` of them) add to a logit, whatever stands round them."""
        tables, places = self.tables(), TOKEN - TAPS + 1
        blank = self.rectified(np.zeros((1, TAPS), np.uint8), tables)[0, 0]  # where there is nothing but padding
        size = TOKEN - (c[:, ::-1] != 0).argmax(1)
        out, order = np.empty(len(c)), np.argsort(size, kind="stable")
        for i in range(0, len(order), 1024):
            some = order[i : i + 1024]
            n = min(int(size[some[-1]]), places)
            z = self.rectified(c[some, : n + TAPS - 1], tables)
            top, mean = z.max(1), (z.sum(1) + (places - n) * blank) / places
            out[some] = np.concatenate([np.maximum(top, blank) if n < places else top, mean], 1) @ self.v[: 2 * FILTERS] + self.v0
        return out

    def known_inner(self, read: Texts, tokens: list[str]) -> tuple[list[str], np.ndarray]:
        """Each of these tokens, all that were read, once, and its ``inner``, of a long one that of its highest part; those met before are remembered."""
        if len(self.known) > KNOWN:
            self.known.clear()
        place = dict(zip(tokens, range(len(tokens))))
        new = [t for t in place if t not in self.known]
        at = np.array([place[t] for t in new], np.int64)
        start, end = read.start[at], read.end[at]
        best = np.full(len(new), -np.inf)
        short = end - start <= TOKEN
        best[short] = self.inner(read.inner(start[short], end[short]))
        cut = [(k, p) for k in np.flatnonzero(~short).tolist() for p in parts(int(start[k]), int(end[k]))]
        if cut:
            of, starts = np.array(cut).T
            np.maximum.at(best, of, self.inner(read.inner(starts, end[of])))
        self.known.update(zip(new, best.tolist()))
        return list(place), np.fromiter(map(self.known.__getitem__, place), float, len(place))

    def above(self, c: np.ndarray, least: float) -> np.ndarray:
        """Places of windows whose logit is above ``least``; most fall short whatever stands round the token, and are read no further."""
        inner = self.inner(c[:, BEFORE : BEFORE + TOKEN])
        some = np.flatnonzero(inner + self.outer > least)
        return some[inner[some] + self.beside(c[some]) > least]

    def highest(self, c: np.ndarray, most: int) -> np.ndarray:
        """The highest logits; windows are read from the likeliest on, until no other token can reach them."""
        inner = self.inner(c[:, BEFORE : BEFORE + TOKEN])
        order, found, step = np.argsort(-inner), np.empty(0), max(1024, 4 * most)
        for i in range(0, len(order), step):
            if len(found) == most and inner[order[i]] + self.outer < found[0]:
                break
            some = order[i : i + step]
            found = np.sort(np.concatenate([found, inner[some] + self.beside(c[some])]))[-most:]
        return found

    @property
    def outer(self) -> float:
        """What stands round a token adds at most to a logit, and a little more, as sums are rounded."""
        most = np.maximum(self.w.max(1).sum(0) + self.b, 0)
        return float((np.maximum(self.v[2 * FILTERS :], 0) * most).sum()) + 0.01

    def least_logit(self, form: str) -> float:
        """The logit of a form's threshold."""
        t = self.thresholds[form]
        if self.slope <= 0 or t <= 0:
            return -np.inf
        return float((np.log(t / (1 - t)) - self.shift) / self.slope) if t < 1 else np.inf

    def calibrated(self, logits: np.ndarray | float) -> np.ndarray | float:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.shift, -50, 50)))

    def score(self, c: np.ndarray) -> np.ndarray:
        """Calibrated probability."""
        return self.calibrated(self.logits(c))

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in (self.w, self.b, self.v, self.v0)])

    def with_flat(self, flat: np.ndarray) -> Network:
        """A network with these parameters, not calibrated."""
        net, at = Network(), 0
        for name in ("w", "b", "v", "v0"):
            old = getattr(net, name)
            setattr(net, name, flat[at : at + old.size].reshape(old.shape))
            at += old.size
        return net

    def fit(self, c: np.ndarray, label: np.ndarray, turn: int, seed: int) -> None:
        """Adam on the cross entropy, half of each batch findings; those that are ``FREE`` are spelt anew every time.

        Of the others, tokens with digits, plain ones and joined names have equal
        shares.  After the first turn all of them are scored, and those that are
        mistaken, or nearly, make up half.
        """
        rng = np.random.default_rng(seed)
        kinds = [k for k in (np.flatnonzero(label == x) for x in (DIGIT_TOKEN, PLAIN_TOKEN, NAME)) if len(k)]
        found = np.flatnonzero(label % 2 == 1)
        if not len(found) or not kinds:
            return
        others = np.flatnonzero(label % 2 == 0)
        wrong = others[self.above(c[others], MISTAKEN)] if turn else others[:0]
        half = BATCH // 2
        hard = half // 2 if len(wrong) else 0
        free = label == FREE
        sizes, joined = np.array([len(k) for k in kinds]), np.concatenate(kinds)
        begins = np.cumsum(sizes) - sizes
        # All parameters in one row, and a view of each.
        flat = self.flat().astype(np.float32)
        w, bias, v, v0 = np.split(flat, np.cumsum([TAPS * CODES * FILTERS, FILTERS, 3 * FILTERS]))
        w = w.reshape(TAPS, CODES, FILTERS)
        first, second = np.zeros_like(flat), np.zeros_like(flat)
        eye, places, rows = np.eye(CODES, dtype=np.float32), c.shape[1] - TAPS + 1, np.arange(BATCH)[:, None]
        inside = INNER.stop - INNER.start
        shifted = np.zeros((BATCH, TOKEN, TAPS, FILTERS), np.float32)
        taps, filters = np.arange(TAPS)[:, None, None], np.arange(FILTERS)
        target = np.repeat(np.float32([0, 1]), half)
        for step in range(1, STEPS + 1):
            kind = rng.integers(0, len(kinds), half - hard)
            easy = joined[begins[kind] + (rng.random(half - hard) * sizes[kind]).astype(np.int64)]
            batch = np.concatenate([wrong[rng.integers(0, len(wrong), hard)] if hard else wrong, easy, found[rng.integers(0, len(found), half)]]).astype(np.int64)
            x = np.concatenate([beside_keys(c[batch[:half]], rng), respelt(c[batch[half:]], free[batch[half:]], rng)]).astype(np.intp)
            z = w[0].take(x[:, :places], 0)
            for k in range(1, TAPS):
                z += w[k].take(x[:, k : k + places], 0)
            z += bias
            np.maximum(z, 0, out=z)
            inner = z[:, INNER]
            top, left, right = inner.argmax(1), z[:, : INNER.start].argmax(1), z[:, INNER.stop :].argmax(1) + INNER.stop
            high = inner[rows, top, filters]
            beside = np.where(z[rows, left, filters] >= z[rows, right, filters], left, right)
            round_it = z[rows, beside, filters]
            pooled = np.concatenate([high, inner.mean(1), round_it], 1)
            d = ((1 / (1 + np.exp(-np.clip(pooled @ v + v0, -50, 50))) - target) / BATCH)[:, None]
            # The mean has a part at every place of the token: all taps in one product.
            spread = (d * (v[FILTERS : 2 * FILTERS] / np.float32(inside)))[:, None] * (inner > 0)
            for k in range(TAPS):
                shifted[:, k : k + inside, k] = spread
            dw = (eye.take(x[:, BEFORE : BEFORE + TOKEN], 0).reshape(-1, CODES).T @ shifted.reshape(-1, TAPS * FILTERS)).reshape(CODES, TAPS, FILTERS).transpose(1, 0, 2)
            # Either maximum has one place for a filter.
            single = np.concatenate([d * v[:FILTERS] * (high > 0), d * v[2 * FILTERS :] * (round_it > 0)])
            at = np.concatenate([top + INNER.start, beside])
            cell = (taps * CODES + x[np.concatenate([rows, rows]), at + taps]) * FILTERS + filters
            dw = dw.ravel() + np.bincount(cell.ravel(), np.broadcast_to(single, cell.shape).ravel(), w.size).astype(np.float32)
            g = np.concatenate([dw, spread.sum((0, 1)) + single.sum(0), d[:, 0] @ pooled, d.sum(0)])
            first += (g - first) * np.float32(0.1)
            second += (g * g - second) * np.float32(0.001)
            flat -= np.float32(RATE / (1 - 0.9**step)) * first / (np.sqrt(second * np.float32(1 / (1 - 0.999**step))) + np.float32(1e-8))
        self.w, self.b, self.v, self.v0 = w, bias, v, v0

    def calibrate(self, x: np.ndarray, y: np.ndarray, form: np.ndarray, n: np.ndarray, recall: float = RECALL) -> None:
        """Platt's scaling by damped Newton steps, then by form a threshold with the recall asked for and no more false findings than the highest such one.

        Logits, labels, numbers of forms, and how many examples have these; both
        labels weigh the same, as in training.  A form that no held-back finding
        has takes the threshold of all.
        """
        scale = max(float(np.abs(x).max()), 1e-6)
        n1, n0 = n[y == 1].sum(), n[y == 0].sum()
        weight = np.where(y == 1, n, n * (n1 / max(1, n0)))
        t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n1 + 2))
        u, at = np.stack([x / scale, np.ones(len(x))]), np.zeros(2)
        loss = lambda k: (weight * (np.logaddexp(0, k @ u) - t * (k @ u))).sum() + 1e-3 * (k @ k)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(at @ u, -50, 50)))
            step = np.linalg.solve((u * (weight * p * (1 - p))) @ u.T + 2e-3 * np.eye(2), u @ (weight * (p - t)) + 2e-3 * at)
            size = 1.0
            while size > 1e-6 and loss(at - size * step) > loss(at):
                size /= 2
            at = at - size * step
        self.slope, self.shift = at[0] / scale, at[1]
        score = self.calibrated(x)

        def threshold(of: np.ndarray) -> float:
            found = np.flatnonzero(of & (y == 1))
            found = found[np.argsort(score[found], kind="stable")]
            reached = np.cumsum(n[found])
            top = score[found[np.searchsorted(reached, np.floor((1 - recall) * reached[-1]), "right")]]
            # Halfway to the next negative: as precise on these, and less bound to them.
            below = score[(y == 0) & (score < top)]
            # With few findings one that is missed would else let nearly every token pass.
            return max(EVEN, (top + below.max(initial=0.0)) / 2)

        if n1:
            every = threshold(np.ones(len(y), bool))
            self.thresholds = {f: threshold(form == k) if ((form == k) & (y == 1)).any() else every for k, f in enumerate(FORMS)}


def examples(docs: DataFrame) -> DataFrame:
    """What all documents teach, in blocks, a row each (part and flat arrays: code, label, form, held, n); written.

    Every finding, what is made of it, every other token that doesn't resemble
    one, and two joined names of each text.  Tokens (of a long one parts) that
    look the same to the network are one example, which stands where the text
    with the smallest checksum has it; n are its occurrences.  Examples are dealt
    by hash, as many blocks as texts have ``BLOCK`` bytes.  A finding and what is
    made of it are held back together.
    """
    rows = only(docs, "doc_id", "text").where("text is not null")
    n_parts = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Whole tokens by number: label, form, checksum of the text, occurrences and window.
        seen: dict[str, int] = {}
        whole = np.zeros(0, EXAMPLE)
        # All else: checksum, window, label, form, origin, occurrences.
        rest: list[tuple] = []

        def add(text: str, a: int, b: int, label: int, rank: int, origin: str) -> None:
            form = FORMS.index(form_of(text[a:b]))
            rest.extend((rank, window(text, a, b, at), label, form, origin, 1) for at in parts(a, b))

        def learn(texts: list[str]) -> None:
            nonlocal whole
            # By their checksums, so that a token's first place is the one that counts.
            ranked = sorted(((zlib.crc32(t.encode("utf-8", "surrogatepass")), t) for t in texts), key=lambda x: x[0])
            ranks, texts = [r for r, _ in ranked], [t for _, t in ranked]
            bases, read = [base_spans(t) for t in texts], Texts(texts)
            free = np.ones(len(read.start), bool)
            for i in (i for i, base in enumerate(bases) if base):
                own = slice(*np.searchsorted(read.owner, (i, i + 1)))
                begins = {a for a, _ in candidates(texts[i], bases[i])}
                free[own] = [a in begins for a in (read.start[own] - read.first[i]).tolist()]
                for s in bases[i]:
                    read.code[read.first[i] + s.start : read.first[i] + s.end] = 0
            tokens, known = list(itertools.compress(read.tokens(), free)), len(seen)
            start, end, owner = read.start[free], read.end[free], read.owner[free]
            number = np.fromiter((seen.setdefault(t, len(seen)) for t in tokens), np.int64, len(tokens))
            if len(seen) > len(whole):
                whole = np.concatenate([whole, np.zeros(max(len(seen) - len(whole), SEEN // 2), EXAMPLE)])
            new = list(itertools.islice(seen, known, None))
            small = [is_small_word(t) for t in new]
            whole["label"][known : len(seen)] = [PLAIN_TOKEN if x else PASSED_OVER if resembles_finding(t) else label_of(t) for t, x in zip(new, small)]
            whole["form"][known : len(seen)] = [WORD if x else FORMS.index(form_of(t)) for t, x in zip(new, small)]
            whole["rank"][known : len(seen)] = 0xFFFFFFFF
            met, first, n = np.unique(number, return_index=True, return_counts=True)
            rank = np.array(ranks, np.uint32)[owner[first]]
            better = (rank < whole["rank"][met]) | (whole["n"][met] == 0)
            whole["n"][met] += n.astype(np.uint32)
            whole["rank"][met[better]] = rank[better]
            whole["code"][met[better]] = read.windows(start[first[better]], end[first[better]])

            label = whole["label"][number]
            plain = np.flatnonzero(label == PLAIN_TOKEN)
            at = np.searchsorted(owner[plain], np.arange(len(texts) + 1)).tolist()
            for k in np.flatnonzero((end - start > TOKEN) & (label != PASSED_OVER)).tolist():
                i, a, b = int(owner[k]), int(start[k]), int(end[k])
                a, b = a - int(read.first[i]), b - int(read.first[i])
                add(blanked(texts[i], bases[i]), a, b, int(label[k]), ranks[i], tokens[k])
            for i, (text, base, rank) in enumerate(zip(texts, bases, ranks)):
                clean = blanked(text, base)
                many = at[i + 1] - at[i]
                for k in {rank % many, (rank >> 8) % many} if many else ():
                    k = plain[at[i] + k]
                    a, b = int(start[k] - read.first[i]), int(end[k] - read.first[i])
                    if words := LATIN_WORD.findall(clean[max(0, a - 200) : b + 200]):
                        name = joined_words(words, tokens[k])
                        if CANDIDATE.fullmatch(name) and not resembles_finding(name):
                            between(clean, a, b, name, NAME, rank)
                if not base:
                    continue
                own = slice(*np.searchsorted(owner, (i, i + 1)))
                fine = label[own] != PASSED_OVER
                others = list(zip((start[own][fine] - read.first[i]).tolist(), (end[own][fine] - read.first[i]).tolist()))
                for s in base:
                    token = text[s.value : s.end]
                    add(text, s.value, s.end, FOUND, rank, token[:TOKEN])
                    if resembles_finding(token):
                        # In the place of other tokens of the text.
                        for a, b in heapq.nsmallest(PLACES, others, lambda x: zlib.crc32(f"{token}{x}".encode())) or [(0, 0)]:
                            between(clean, a, b, token[:TOKEN], FREE, rank)

        def between(clean: str, a: int, b: int, token: str, label: int, rank: int) -> None:
            """The token in the place of another one."""
            before = clean[max(0, a - BEFORE) : a]
            add(before + token + clean[b : b + AFTER], len(before), len(before) + len(token), label, rank, token)

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal whole
            held = lambda of: [zlib.crc32(t.encode("utf-8", "surrogatepass")) % 10 < 3 for t in of]
            rows = whole[: len(seen)]
            fine = (rows["label"] != PASSED_OVER) & np.fromiter((len(t) <= TOKEN for t in seen), bool, len(seen))
            rows = rows[fine]
            rows["held"] = held(itertools.compress(seen, fine))
            more = np.zeros(len(rest), EXAMPLE)
            if rest:
                more["code"] = codes([x[1] for x in rest])
                more["held"] = held(x[4] for x in rest)
                for name, k in (("rank", 0), ("label", 2), ("form", 3), ("n", 5)):
                    more[name] = [x[k] for x in rest]
            seen.clear()
            rest.clear()
            whole = np.zeros(0, EXAMPLE)
            rows = np.concatenate([rows, more])
            part = np.fromiter((zlib.crc32(x) % n_parts for x in np.ascontiguousarray(rows["code"][:, BEFORE : BEFORE + TOKEN])), np.int32, len(rows))
            # Those of a block side by side, as one value.
            order = np.argsort(part, kind="stable")
            rows, part = rows[order], part[order]
            for i in range(0, len(rows), SENT):
                some = part[i : i + SENT]
                at = [0, *(np.flatnonzero(some[1:] != some[:-1]) + 1).tolist(), len(some)]
                yield pa.RecordBatch.from_pydict({"part": pa.array(some[at[:-1]]), "row": pa.array([rows[i + a : i + b].tobytes() for a, b in itertools.pairwise(at)], pa.binary())})

        for batch in batches:
            every = batch.column(1).to_pylist()
            for some in at_once(every):
                learn([every[i] for i in some])
                if len(seen) + len(rest) >= SEEN:
                    yield from out()
        yield from out()

    def pack(group: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(group.column("row").to_pylist()), EXAMPLE)
        # What tells examples apart: the window of findings and names, else the token.
        key = rows["code"].copy()
        other = np.isin(rows["label"], (DIGIT_TOKEN, PLAIN_TOKEN))
        key[other, :BEFORE] = key[other, BEFORE + TOKEN :] = 0
        key = np.concatenate([rows["label"][:, None], key], 1).view(f"S{key.shape[1] + 1}").ravel()
        whole = rows["code"].copy().view(f"S{rows['code'].shape[1]}").ravel()
        order = np.lexsort((rows["held"], rows["form"], whole, rows["rank"], key))
        first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        n = np.add.reduceat(rows["n"][order].astype(np.int64), first)
        kept = rows[order[first]]
        flat = {**{c: np.ascontiguousarray(kept[c]) for c in ("code", "label", "form", "held")}, "n": n}
        return pa.table({"part": group.column("part")[:1], **{c: pa.array([x.tobytes()], pa.binary()) for c, x in flat.items()}})

    found = map_batches(rows, run, "part int, row binary")
    return written(found.groupBy("part").applyInArrow(pack, "part int, code binary, label binary, form binary, held binary, n binary"))


def label_of(token: str) -> int:
    return DIGIT_TOKEN if DIGIT.search(token) else PLAIN_TOKEN


class Block(NamedTuple):
    part: int
    code: np.ndarray
    label: np.ndarray
    form: np.ndarray
    held: np.ndarray
    n: np.ndarray


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for r in range(batch.num_rows):
            part, *flat = [batch.column(k)[r].as_py() for k in range(6)]
            code, label, form, held, n = (np.frombuffer(x, t) for x, t in zip(flat, (np.uint8, np.uint8, np.uint8, np.uint8, np.int64)))
            yield Block(part, code.reshape(len(label), -1), label, form, held == 1, n)


def counted(parts: DataFrame) -> dict[tuple[int, int, bool], tuple[int, int]]:
    """By block, label and held: examples and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in each_block(batches):
            rows = [(x.part, k, h, int(of.sum()), int(x.n[of].sum())) for k in range(5) for h in (False, True) for of in [(x.label == k) & (x.held == h)]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["part", "label", "held", "rows", "n"])

    found = map_batches(parts, run, "part long, label long, held boolean, rows long, n long")
    return {(r[0], r[1], r[2]): (r[3], r[4]) for r in found.collect()}


def lent(parts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``LENT`` findings at most, with their labels, from which blocks with few learn beside their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in each_block(batches):
            at = np.flatnonzero((x.label % 2 == 1) & ~x.held)
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in x.code[at]], pa.binary()), pa.array(x.label[at].tolist(), pa.int32())], names=["code", "label"])

    rows = map_batches(parts, run, "code binary, label int").orderBy(F.xxhash64("code"), "label", "code").limit(LENT).collect()
    return np.frombuffer(b"".join(bytes(r["code"]) for r in rows), np.uint8).reshape(len(rows), -1), np.array([r["label"] for r in rows], np.uint8)


def taught(parts: DataFrame, net: Network, turn: int, more: tuple[np.ndarray, np.ndarray]) -> Network:
    """One turn: every block teaches a copy of the network, and their parameters are averaged.

    They are summed as integers, so that the order in which they come makes no
    difference.
    """
    shared = parts.sparkSession.sparkContext.broadcast((net, more))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = None, 0
        for x in each_block(batches):
            own, (code, label) = copy.deepcopy(shared.value[0]), (x.code[~x.held], x.label[~x.held])
            if (label % 2 == 1).sum() < FINDINGS:
                code, label = (np.concatenate([a, b]) for a, b in zip((code, label), shared.value[1]))
            own.fit(code, label, turn, 6 + turn + 31 * x.part)
            flat = np.round(own.flat().astype(np.float64) * SCALE).astype(np.int64)
            total, count = flat if total is None else total + flat, count + 1
        if count:
            yield pa.RecordBatch.from_pydict({"place": pa.array(range(len(total)), pa.int32()), "total": pa.array(total), "count": pa.array([count] * len(total), pa.int64())})

    rows = map_batches(parts, run, "place int, total long, count long").groupBy("place").agg(F.sum("total").alias("total"), F.sum("count").alias("count")).orderBy("place").collect()
    shared.unpersist()
    return net.with_flat(np.array([r["total"] / SCALE / r["count"] for r in rows]))


def judged(parts: DataFrame, net: Network) -> tuple[list[tuple], dict[str, list[float]]]:
    """How the examples that were held back score (form, label, logit in steps of 1/``CELLS``, their number), and by plain form the ``TAIL`` highest logits of all other tokens."""
    shared = parts.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: Counter[tuple[int, int, float]] = Counter()
        top: dict[int, np.ndarray] = {FORMS.index(f): np.empty(0) for f in PLAIN}
        for x in each_block(batches):
            code, form = x.code.copy(), x.form.copy()
            # As in training, those in other places are spelt anew, and by that have another form.
            free = x.held & (x.label == FREE)
            code[free] = respelt(code[free], np.ones(free.sum(), bool), np.random.default_rng(7 + x.part))
            form[free] = [FORMS.index(form_of("".join(chr(k + 31) for k in w if k))) for w in code[free, BEFORE : BEFORE + TOKEN].tolist()]
            net = shared.value
            cells.update(zip(form[x.held].tolist(), (x.label[x.held] % 2).tolist(), (np.floor(net.logits(code[x.held]) * CELLS) / CELLS).tolist()))
            for f, old in top.items():
                top[f] = np.sort(np.concatenate([old, net.highest(code[(x.label % 2 == 0) & (x.label != NAME) & (x.form == f)], TAIL)]))[-TAIL:]
        rows = [(*k, n) for k, n in cells.items()] + [(f, -1, v, 1) for f, found in top.items() for v in found.tolist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.float64(), pa.int64()))], names=["form", "label", "logit", "n"])

    found = written(map_batches(parts, run, "form int, label int, logit double, n long"))
    held = sorted(map(tuple, found.where("label >= 0").groupBy("form", "label", "logit").agg(F.sum("n")).collect()))
    tails = {f: [r["logit"] for r in found.where(f"label < 0 and form = {FORMS.index(f)}").orderBy(F.desc("logit")).limit(TAIL).collect()] for f in PLAIN}
    freed(found)
    shared.unpersist()
    return held, tails


def beyond(top: list[float], times: float) -> float:
    """A logit that ``EXPECTED`` tokens of the whole corpus exceed, if scores end in an exponential tail; ``times`` as many tokens as were seen.

    ``top`` are the highest scores seen, the highest first.
    """
    low = top[-1]
    mean = max(sum(top) / len(top) - low, 1e-3)
    return max(top[0], low + mean * np.log(len(top) * times / EXPECTED))


def train(docs: DataFrame) -> Network:
    """A network that has learned from all documents; with too few findings or other tokens, one that adds nothing."""
    net, parts = Network(), examples(docs)
    size = counted(parts)
    count = lambda labels, held=(False, True), what=0: sum(r[what] for (_, k, h), r in size.items() if k in labels and h in held)
    tokens = DIGIT_TOKEN, PLAIN_TOKEN
    if all(count(labels, (held,)) >= LEAST_EXAMPLES for labels in ((FOUND,), (*tokens, NAME)) for held in (False, True)):
        more = lent(parts) if any(size[p, FOUND, False][0] + size[p, FREE, False][0] < FINDINGS for p in {p for p, _, _ in size}) and len(size) > 10 else (np.empty((0, BEFORE + TOKEN + AFTER), np.uint8), np.empty(0, np.uint8))
        for turn in range(TURNS):
            net = taught(parts, net, turn, more)
        held, tails = judged(parts, net)
        form, label, logit, n = (np.array(x) for x in zip(*held))
        net.calibrate(logit, label, form, n)
        for f, found in tails.items():
            least = net.calibrated(beyond(found, count(tokens, what=1) / count(tokens))) if found else 1.0
            # A score that can't be told from 1 is no threshold.
            net.thresholds[f] = max(net.thresholds[f], least) if least < 1 - 1e-12 else np.inf
    freed(parts)
    return net


class Scanned(NamedTuple):
    #: The patterns' findings; all spans by start and kind; lowest score of a finding (null if there is none or nothing was learned).
    base: list[Span]
    spans: list[Span]
    least: float | None


def scan(net: Network, texts: list[str | None]) -> list[Scanned]:
    """Findings and spans of each text; every token is scored, those of findings too."""
    bases = [base_spans(t or "") for t in texts]
    spans = [list(b) for b in bases]
    # Windows and the (text, start, end, form) that each belongs to, scored by the thousand.
    held: list[str] = []
    owner: list[tuple[int, int, int, str]] = []
    best: dict[tuple[int, int, int], float] = {}  # of findings
    last: set[tuple[int, int, int, str]] = set()

    def settle() -> None:
        score = net.score(codes(held))
        least = np.array([net.thresholds.get(x[3], 0.0) for x in owner])
        for k in np.flatnonzero(score >= least):
            i, a, b, form = owner[k]
            if form == "base":
                best[i, a, b] = max(best.get((i, a, b), 0.0), float(score[k]))
            elif owner[k] not in last:
                spans[i].append(Span("model", a, b, a))
                last.add(owner[k])
        held.clear()
        owner.clear()

    least = {f: net.least_logit(f) - net.outer for f in FORMS}
    lowest = min(least.values())
    given = [t or "" for t in texts]
    likely: dict[int, list[tuple[int, int]]] = {}  # long tokens
    for some in at_once(given) if net.learned else ():
        read = Texts([given[i] for i in some])
        tokens = read.tokens()
        # Most tokens fall short whatever stands round them; only the others are read with it.
        different, inner = net.known_inner(read, tokens)
        may = {different[k] for k in np.flatnonzero(inner >= lowest) if inner[k] >= least[form_of(different[k])]}
        hits = []
        for k in (k for k, t in enumerate(tokens) if t in may) if may else ():
            i, first = some[read.owner[k]], read.first[read.owner[k]]
            a, b = int(read.start[k] - first), int(read.end[k] - first)
            if not any(s.start < b and s.end > a for s in bases[i]):
                if b - a <= TOKEN:
                    hits.append((k, i, a, b))
                else:
                    likely.setdefault(i, []).append((a, b))
        if hits:
            for n, i in enumerate(some):
                for s in bases[i]:
                    read.code[read.first[n] + s.start : read.first[n] + s.end] = 0
            at = np.array([k for k, *_ in hits])
            score = net.score(read.windows(read.start[at], read.end[at]))
            for (k, i, a, b), p in zip(hits, score.tolist()):
                if p >= net.thresholds[form_of(tokens[k])]:
                    spans[i].append(Span("model", a, b, a))
    for i, t in enumerate(given):
        every = []
        if i in likely:
            clean = blanked(t, bases[i])
            every = [(clean, a, b, at, form_of(t[a:b])) for a, b in likely[i] for at in parts(a, b)]
        for text, a, b, at, form in every + [(t, s.value, s.end, at, "base") for s in bases[i] for at in parts(s.value, s.end)]:
            held.append(window(text, a, b, at))
            owner.append((i, a, b, form))
            if len(held) >= 4096:
                settle()
    settle()
    order = lambda x: (x.start, KINDS.index(x.kind))
    return [Scanned(b, sorted(s, key=order), min((best[i, x.value, x.end] for x in b), default=None) if net.learned else None) for i, (b, s) in enumerate(zip(bases, spans))]


def find_secrets(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """One row per document row: findings by pattern, a digest of them, and all spans.

    A null text is empty.  Spans count code points, ends exclusive.  Rows that
    repeat an id are scanned each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net or train(docs))

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            found = scan(shared.value, batch.column(1).to_pylist())
            count = lambda spans, kind: sum(s.kind == kind for s in spans)
            return {
                "doc_id": batch.column(0),
                **{f"n_{k}": [count(x.spans, k) for x in found] for k in KINDS},
                "base_sha256": [hashlib.sha256(",".join(s.text() for s in x.base).encode()).hexdigest() for x in found],
                "spans": [",".join(s.text() for s in x.spans) for x in found],
                "least_base_score": [x.least for x in found],
            }

        return step

    return map_rows(only(docs, "doc_id", "text"), make, SCHEMA)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every secret's value replaced; the name before an assigned one stays."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.value, -s.end)):
        if s.end <= at:
            continue
        if s.value >= at:
            out += [text[at : s.value], MASK]
        at = s.end
    return "".join([*out, text[at:]])


def without_secrets(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """The documents, all columns, with secrets masked and ``n_chars``, where there is one, counted again.

    Null texts stay null; every row stays, also those that repeat an id or have none.
    """
    shared, names = docs.sparkSession.sparkContext.broadcast(net or train(docs)), docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            changed = [t if not x.spans else masked(t, x.spans) for t, x in zip(texts, scan(shared.value, texts))]
            columns = list(batch.columns)
            columns[at] = pa.array(changed, columns[at].type)
            if "n_chars" in names:
                i = names.index("n_chars")
                counts = [n if new is old else len(new) for n, new, old in zip(columns[i].to_pylist(), changed, texts)]
                columns[i] = pa.array(counts, columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_batches(docs, run, docs.schema)

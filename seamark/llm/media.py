"""Media columns: motion-JPEG in AVI.

Baseline frames, as cameras and converters write them (any sampling, restart
markers, with or without Huffman tables), are decoded to their luminance.

A payload's bytes become the grey samples of frames 64 wide, and each frame is a
JPEG of the lossless process (SOF3, predictor 1).  Its Huffman table gives
difference category c a code of 9 - c bits, so code and extra bits always take
nine bits together and whole payloads are coded and decoded by array operations.
Frames stand in an AVI file with an ``idx1`` index; the reader walks the RIFF
chunks, finds frames by the index, decodes them, and cuts clips where the
histogram difference of neighbouring frames exceeds a threshold that follows the
differences before it.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, only

WIDTH, MAX_HEIGHT, FPS = 64, 64, 25
#: Shots: bins, differences looked back on, deviations above their mean, and the least difference of a cut.
BINS, LOOK_BACK, DEVIATIONS, LEAST = 64, 8, 3.0, 0.25

SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

# Difference d of category c: 8 - c ones, a zero, then the c extra bits.
_D = np.arange(-255, 256)
_C = np.ceil(np.log2(np.abs(_D) + 1)).astype(np.int64)
_CODE = ((((1 << (8 - _C)) - 1) << (_C + 1)) | np.where(_D >= 0, _D, _D + (1 << _C) - 1)).astype(np.uint16)
_DIFF = np.zeros(512, np.int16)
_DIFF[_CODE] = _D
#: The table as DHT has it: one code of each length from 1 to 9, for categories 8 down to 0.
_LENGTHS, _SYMBOLS = bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1))


#: Place in a block of each coefficient in the order of the scan: along the diagonals, turn by turn.
ZIGZAG = np.array([8 * y + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])
COSINES = np.array([[(0.5 if u else 0.125**0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
RESTARTS = re.compile(rb"\xff[\xd0-\xd7]")


def _runs(first: str, rows: tuple[tuple[int, int], ...]) -> bytes:
    """Symbols in hexadecimal, and after them for each run length from a row on its sizes from a first one to ten."""
    return bytes.fromhex(first) + bytes(16 * run + size for run, least in rows for size in range(least, 11))


# Fixed values of the JPEG standard (its typical Huffman tables, which AVI files leave out): lengths and symbols by class and number.
STANDARD = {
    0x00: (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))),
    0x01: (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12))),
    0x10: (
        bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]),
        _runs("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a", ((1, 6), (2, 5), (3, 4), (4, 3), (5, 3), (6, 3), (7, 3), (8, 3), (9, 2), (10, 2), (11, 2), (12, 2), (13, 2), (14, 1), (15, 1))),
    ),
    0x11: (
        bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]),
        _runs("000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f1", ((1, 7), (2, 6), (3, 5), (4, 3), (5, 3), (6, 3), (7, 3), (8, 2), (9, 2), (10, 2), (11, 2), (12, 2), (13, 2), (14, 2), (15, 2))),
    ),
}
# End of fixed values.


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(height: int, width: int) -> bytes:
    return (
        b"\xff\xd8"
        + _segment(0xC4, b"\x00" + _LENGTHS + _SYMBOLS)
        + _segment(0xC3, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0))
        + _segment(0xDA, struct.pack(">BBBBBB", 1, 1, 0, 1, 0, 0))
    )


def encode_frames(frames: np.ndarray) -> list[bytes]:
    """(n, height, width) samples as JPEG files; height * width is a multiple of 8."""
    n, height, width = frames.shape
    x = frames.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    c = _CODE[d + 255].reshape(n, -1, 8)
    b = np.zeros((n, c.shape[1], 9), np.uint8)
    for k in range(9):
        if k:
            b[:, :, k] = (c[:, :, k - 1] & ((1 << k) - 1)) << (8 - k)
        if k < 8:
            b[:, :, k] |= (c[:, :, k] >> (k + 1)).astype(np.uint8)
    head = _head(height, width)
    return [head + b[i].tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for i in range(n)]


class Jpeg(NamedTuple):
    """A parsed frame: what its markers say, and its entropy-coded bytes with stuffing and restart markers still in."""

    process: int
    height: int
    width: int
    #: For each component its id, horizontal and vertical sampling, and quantisation table.
    parts: list[tuple[int, int, int, int]]
    #: For each component of the scan its id, DC and AC table.
    scan: list[tuple[int, int, int]]
    predictor: int
    tables: dict[int, tuple[bytes, bytes]]
    steps: dict[int, np.ndarray]
    restart: int
    data: bytes


def _parse(jpeg: bytes) -> Jpeg:
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at, tables, steps, restart, frame = 2, {}, {}, 0, None
    while True:
        marker, length = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        if jpeg[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        if marker == 0xFF:  # fill
            at += 1
            continue
        body = jpeg[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                steps[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else "u1").astype(np.int32)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1, 0xC3):
            precision, height, width, n = struct.unpack_from(">BHHB", body)
            if precision != 8 or (marker == 0xC3 and n != 1):
                raise ValueError("samples of 8 bits are read, lossless ones in grey")
            frame = (marker, height, width, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)])
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("neither the baseline nor the lossless process")
        elif marker == 0xDA:
            n = body[0]
            scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
            end = jpeg.rfind(b"\xff\xd9")
            return Jpeg(*frame, scan, body[1 + 2 * n], tables, steps, restart, jpeg[at : end if end >= at else len(jpeg)])


def _codes(table: tuple[bytes, bytes]) -> list[tuple[int, int]]:
    """(length, symbol) by the next 16 bits; length 0 where no code begins so."""
    lengths, symbols = table
    out, code, k = [(0, 0)] * 65536, 0, 0
    for size in range(1, 17):
        for _ in range(lengths[size - 1]):
            first = code << (16 - size)
            out[first : first + (1 << (16 - size))] = [(size, symbols[k])] * (1 << (16 - size))
            code, k = code + 1, k + 1
        code <<= 1
    return out


class _Bits:
    """Reads an interval between restart markers."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.count = data.replace(b"\xff\x00", b"\xff") + b"\xff" * 8, 0, 0, 0

    def fill(self) -> None:
        self.held = (self.held << 32 | int.from_bytes(self.data[self.at : self.at + 4].ljust(4, b"\xff"), "big")) & ((1 << 96) - 1)
        self.at, self.count = self.at + 4, self.count + 32

    def symbol(self, codes: list[tuple[int, int]]) -> int:
        if self.count < 16:
            self.fill()
        size, symbol = codes[self.held >> (self.count - 16) & 0xFFFF]
        if not size:
            raise ValueError("no code begins with these bits")
        self.count -= size
        return symbol

    def value(self, size: int) -> int:
        """A number of ``size`` bits, those that begin with 0 below zero."""
        if not size:
            return 0
        if self.count < size:
            self.fill()
        self.count -= size
        v = self.held >> self.count & ((1 << size) - 1)
        return v if v >> (size - 1) else v - (1 << size) + 1


def _luminance(j: Jpeg) -> np.ndarray:
    """(height, width) samples of the first component of a baseline frame."""
    tables = {k: _codes(j.tables.get(k) or STANDARD[k]) for k in {x for _, dc, ac in j.scan for x in (dc, 16 | ac)}}
    sizes = {part: (h, v) for part, h, v, _ in j.parts}
    if {c for c, _, _ in j.scan} != set(sizes):
        raise ValueError("frames of one interleaved scan are read")
    most_h, most_v = max(h for h, _ in sizes.values()), max(v for _, v in sizes.values())
    if len(sizes) == 1:
        most_h = most_v = 1
        sizes = {c: (1, 1) for c in sizes}
    across, down = -(-j.width // (8 * most_h)), -(-j.height // (8 * most_v))
    first = j.parts[0][0]
    h0, v0 = sizes[first]
    blocks = np.zeros((down * v0, across * h0, 64), np.int32)
    order = [(c, dc, ac, x, y) for c, dc, ac in j.scan for y in range(sizes[c][1]) for x in range(sizes[c][0])]
    pieces = RESTARTS.split(j.data)
    bits, before = _Bits(pieces[0]), dict.fromkeys(sizes, 0)
    for unit in range(across * down):
        if j.restart and unit and unit % j.restart == 0:
            bits, before = _Bits(pieces[unit // j.restart]), dict.fromkeys(sizes, 0)
        row, column = divmod(unit, across)
        for c, dc, ac, x, y in order:
            before[c] += bits.value(bits.symbol(tables[dc]))
            block = blocks[row * v0 + y, column * h0 + x] if c == first else None
            if block is not None:
                block[0] = before[c]
            k = 1
            while k < 64:
                run, size = divmod(bits.symbol(tables[16 | ac]), 16)
                if not size and run < 15:
                    break
                k += run
                v = bits.value(size)
                if block is not None and size and k < 64:
                    block[ZIGZAG[k]] = v
                k += 1
    steps = np.zeros(64, np.int32)
    steps[ZIGZAG] = j.steps[j.parts[0][3]]
    samples = COSINES.T @ (blocks * steps).reshape(*blocks.shape[:2], 8, 8) @ COSINES
    plane = np.clip(np.rint(samples + 128), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(down * v0 * 8, across * h0 * 8)
    if (h0, v0) != (most_h, most_v):
        plane = plane.repeat(most_v // v0, 0).repeat(most_h // h0, 1)
    return plane[: j.height, : j.width]


def _differences(table: tuple[bytes, bytes], data: bytes, n: int) -> np.ndarray:
    """``n`` differences by any Huffman table, bit by bit (frames of other writers)."""
    lengths, symbols = table
    codes, code, k = {}, 0, 0
    for size in range(1, 17):
        for _ in range(lengths[size - 1]):
            codes[size, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
    out, at = np.empty(n, np.int16), 0
    for i in range(n):
        code = size = 0
        while (size, code) not in codes:
            code, size, at = code * 2 + bits[at], size + 1, at + 1
        c = codes[size, code]
        extra = int("".join(map(str, bits[at : at + c])) or "0", 2)
        at += c
        out[i] = extra if not c or extra >> (c - 1) else extra - (1 << c) + 1
    return out


def _samples(d: np.ndarray) -> np.ndarray:
    """Samples of (n, height, width) differences of predictor 1."""
    d = d.astype(np.int32)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], 1)
    return (np.cumsum(d, 2) & 255).astype(np.uint8)


def decode_frames(jpegs: list[bytes]) -> np.ndarray:
    """(n, height, width) samples of frames of one size: of lossless grey ones, and the luminance of baseline ones."""
    parsed = [_parse(j) for j in jpegs]
    height, width = parsed[0].height, parsed[0].width
    if any((p.height, p.width, p.process == 0xC3) != (height, width, parsed[0].process == 0xC3) for p in parsed):
        raise ValueError("frames of one size and process are read")
    if parsed[0].process != 0xC3:
        return np.stack([_luminance(p) for p in parsed])
    if any(p.predictor != 1 for p in parsed):
        raise ValueError("lossless frames of predictor 1 are read")
    n = height * width
    tables, data = [p.tables[p.scan[0][1]] for p in parsed], [p.data.replace(b"\xff\x00", b"\xff") for p in parsed]
    if all(t == (_LENGTHS, _SYMBOLS) for t in tables) and n % 8 == 0:
        b = np.frombuffer(b"".join(x[: n * 9 // 8] for x in data), np.uint8).reshape(len(parsed), -1, 9).astype(np.uint16)
        c = np.empty((len(parsed), n // 8, 8), np.uint16)
        for k in range(8):
            c[:, :, k] = ((b[:, :, k] & ((1 << (8 - k)) - 1)) << (k + 1)) | (b[:, :, k + 1] >> (7 - k))
        d = _DIFF[c]
    else:
        d = np.stack([_differences(t, x, n) for t, x in zip(tables, data)])
    return _samples(d.reshape(len(parsed), height, width))


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], height: int, width: int, comment: bytes, fps: int = FPS) -> bytes:
    largest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 10_000, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", comment))
    movi, index = [b"movi"], []
    at = 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(_chunk(b"00dc", f))
        at += len(movi[-1])
    body = b"AVI " + hdrl + info + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_avi(avi: bytes) -> tuple[list[bytes], int, bytes]:
    """Frames in the index's order, microseconds a frame, and the comment.

    Offsets count from the ``movi`` word, or from the file's start where the
    first one says so; without an index the chunks of ``movi`` are walked.
    """
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    found: dict[bytes, list[tuple[int, int]]] = {}
    movi = (0, 0)

    def walk(at: int, end: int) -> None:
        nonlocal movi
        while at + 8 <= end:
            name, size = avi[at : at + 4], struct.unpack_from("<I", avi, at + 4)[0]
            if name == b"LIST":
                if avi[at + 8 : at + 12] == b"movi":
                    movi = (at + 8, at + 8 + size)
                else:
                    walk(at + 12, at + 8 + size)
            else:
                found.setdefault(name, []).append((at + 8, size))
            at += 8 + size + size % 2

    walk(12, min(len(avi), 8 + struct.unpack_from("<I", avi, 4)[0]))
    frames = []
    if b"idx1" in found:
        at, size = found[b"idx1"][0]
        entries = [struct.unpack_from("<4sIII", avi, at + 16 * i) for i in range(size // 16)]
        entries = [e for e in entries if e[0][2:] in (b"dc", b"db")]
        base = 0 if entries and avi[entries[0][2] : entries[0][2] + 4] == entries[0][0] else movi[0]
        frames = [avi[base + o + 8 : base + o + 8 + n] for _, _, o, n in entries]
    else:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            n = struct.unpack_from("<I", avi, at + 4)[0]
            if avi[at + 2 : at + 4] in (b"dc", b"db"):
                frames.append(avi[at + 8 : at + 8 + n])
            at += 8 + n + n % 2
    pace = struct.unpack_from("<I", avi, found[b"avih"][0][0])[0]
    note = found.get(b"ICMT")
    return frames, pace, avi[note[0][0] : note[0][0] + note[0][1]] if note else b""


def store(raw: bytes) -> bytes:
    """An AVI file that holds ``raw``, with zeros to a positive multiple of 64, as samples."""
    payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
    rows = len(payload) // WIDTH
    n = -(-rows // MAX_HEIGHT)
    height = -(-rows // n)
    samples = np.zeros(n * height * WIDTH, np.uint8)
    samples[: len(payload)] = np.frombuffer(payload, np.uint8)
    return write_avi(encode_frames(samples.reshape(n, height, WIDTH)), height, WIDTH, b"bytes=%d payload=%d" % (len(raw), len(payload)))


def cuts(frames: np.ndarray) -> list[int]:
    """First frames of the shots."""
    n = len(frames)
    flat = (frames.reshape(n, -1) // (256 // BINS)).astype(np.int64) + np.arange(n)[:, None] * BINS
    hist = np.bincount(flat.ravel(), minlength=n * BINS).reshape(n, BINS) / flat.shape[1]
    diff = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    out = [0]
    for t, d in enumerate(diff):
        before = diff[max(out[-1], t - LOOK_BACK) : t]  # of this shot alone: the cut before it is no measure
        if d >= max(LEAST, before.mean() + DEVIATIONS * before.std() if len(before) else LEAST):
            out.append(t + 1)
    return out


def clips_of(frames: np.ndarray, pace: int) -> list[tuple[int, int, int, int, int]]:
    """(clip, start in ms, end in ms, frames, mean sample in thousandths) of each shot."""
    begin = cuts(frames)
    ms = lambda k: k * pace // 1000
    return [(i, ms(a), ms(b), b - a, int(frames[a:b].sum(dtype=np.int64)) * 1000 // frames[a:b].size) for i, (a, b) in enumerate(zip(begin, [*begin[1:], len(frames)]))]


def stored_media(docs: DataFrame) -> DataFrame:
    """doc_id and the text as an AVI file; null as empty."""

    def make():
        return lambda batch: {"doc_id": batch.column(0), "media": [store((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]}

    return map_rows(only(docs, "doc_id", "text"), make, "doc_id long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """One row per stored file: sizes and digests of what is read back, and its clips as the feature.

    A null file has nulls.  Of a file that ``store`` didn't write the payload is
    all luminance samples; one without frames has an empty payload and feature.
    Ids may be null or repeat.
    """

    def one(avi: bytes | None) -> tuple:
        if avi is None:
            return (None,) * 7
        jpegs, pace, comment = read_avi(avi)
        frames = decode_frames(jpegs) if jpegs else np.zeros((0, 0, 0), np.uint8)
        note = dict(x.split(b"=", 1) for x in comment.split() if b"=" in x)
        payload = frames.tobytes()
        if own := {b"bytes", b"payload"} <= set(note):
            payload = payload[: int(note[b"payload"])]
        feature = ";".join(f"{a}-{b}ms:{n}f:{m}" for _, a, b, n, m in clips_of(frames, pace)) if len(frames) else ""
        return int(note[b"bytes"]) if own else len(payload), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(avi), hashlib.sha256(avi).hexdigest(), feature

    def make():
        names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")

        def step(batch: pa.RecordBatch) -> dict:
            rows = [one(x) for x in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0)} | {k: [r[i] for r in rows] for i, k in enumerate(names)}

        return step

    return map_rows(only(media, "doc_id", "media"), make, SCHEMA)


def clips(media: DataFrame) -> DataFrame:
    """One row per clip of every file, with its times; null files and those without frames have none."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            rows = []
            for doc_id, avi in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                jpegs, pace, _ = read_avi(avi) if avi is not None else ([], 0, b"")
                if jpegs:
                    rows += [(doc_id, *c) for c in clips_of(decode_frames(jpegs), pace)]
            return {k: [r[i] for r in rows] for i, k in enumerate(("doc_id", "clip", "start_ms", "end_ms", "frames", "mean_sample"))}

        return step

    return map_rows(only(media, "doc_id", "media"), make, "doc_id long, clip int, start_ms long, end_ms long, frames int, mean_sample int")


def round_trip(docs: DataFrame) -> DataFrame:
    """Stores every text and reads the stored bytes back.

    Null and empty texts have a payload of 64 zeros.  Ids may be null or repeat.
    """
    return media_features(stored_media(docs))

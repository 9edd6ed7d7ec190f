import hashlib
import struct
import zlib

import numpy as np
import pytest

from seamark.llm import media

from .conftest import ODD


def test_round_trip_of_texts(spark, docs):
    texts = [*ODD, "x" * 64, "y" * 4097]
    d = docs([*enumerate(texts), (None, "n"), (3, "again")]).selectExpr("*", "1 AS media")
    rows = media.round_trip(d).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r["doc_id"] is None or r["doc_id"] == 3:
            continue
        raw = (texts[r["doc_id"]] or "").encode()
        p = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r["media_bytes"] == len(media.store(raw)) and r["media_sha256"] == hashlib.sha256(media.store(raw)).hexdigest()
    assert len({r["feature"] for r in rows if r["doc_id"] in (7, 8)}) == 1
    assert media.round_trip(docs([])).count() == 0


def test_all_byte_pairs_survive():
    raw = bytes(x for a in range(256) for b in range(0, 256, 3) for x in (a, b))
    frames, _, note = media.read_avi(media.store(raw))
    assert media.decode_frames(frames).tobytes()[: len(raw)] == raw
    assert note.startswith(b"bytes=%d " % len(raw))


def test_other_huffman_tables_are_read_bit_by_bit():
    samples = np.random.default_rng(0).integers(0, 256, (1, 8, 8)).astype(np.uint8)
    d = np.diff(samples.astype(int).reshape(8, 8), axis=1, prepend=0)
    flat = samples[0].astype(int)
    d[:, 0] = np.concatenate([[flat[0, 0] - 128], np.diff(flat[:, 0])])
    bits = ""
    for x in d.ravel():  # categories as plain four-bit codes
        c = int(abs(x)).bit_length()
        bits += f"{c:04b}" + (f"{x if x > 0 else x + (1 << c) - 1:0{c}b}" if c else "")
    bits += "1" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    table = b"\x00" + bytes([0, 0, 0, 9] + [0] * 12) + bytes(range(9))
    jpeg = b"\xff\xd8" + media._segment(0xC4, table) + media._segment(0xC3, struct.pack(">BHHBBBB", 8, 8, 8, 1, 1, 0x11, 0)) + media._segment(0xDA, struct.pack(">BBBBBB", 1, 1, 0, 1, 0, 0)) + data + b"\xff\xd9"
    assert (media.decode_frames([jpeg]) == samples).all()


def test_index_and_walk_find_the_same_frames():
    avi = media.store(bytes(range(256)) * 40)
    frames = media.read_avi(avi)[0]
    assert len(frames) == 3 and media.read_avi(avi.replace(b"idx1", b"JUNK"))[0] == frames
    with pytest.raises(ValueError):
        media.read_avi(b"nothing")


def test_cut_where_the_picture_changes(spark):
    still = np.full((20, 64, 64), 65, np.uint8)
    still[12:] = 200
    frames = still + np.random.default_rng(1).integers(0, 3, still.shape).astype(np.uint8)
    assert media.cuts(frames) == [0, 12]
    avi = media.write_avi(media.encode_frames(frames), 64, 64, b"")
    rows = media.clips(spark.createDataFrame([(1, bytearray(avi)), (2, None)], "doc_id long, media binary")).orderBy("clip").collect()
    assert [(r["start_ms"], r["end_ms"], r["frames"]) for r in rows] == [(0, 480, 12), (480, 800, 8)]


def java_jpeg(spark, pixels):
    """(file, luminance as Java reads the file back) of grey (h, w) or colour (h, w, 3) pixels, by the encoder of the JVM."""
    jvm = spark.sparkContext._jvm
    h, w = pixels.shape[:2]
    image = jvm.java.awt.image.BufferedImage(w, h, 10 if pixels.ndim == 2 else 1)
    for y in range(h):
        for x in range(w):
            p = pixels[y, x]
            if pixels.ndim == 2:
                image.getRaster().setSample(x, y, 0, int(p))
            else:
                image.setRGB(x, y, int(p[0]) << 16 | int(p[1]) << 8 | int(p[2]))
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    jpeg = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(jpeg)))
    if pixels.ndim == 2:
        return jpeg, np.array([[back.getRaster().getSample(x, y, 0) for x in range(w)] for y in range(h)])
    rgb = np.array([[(c >> 16 & 255, c >> 8 & 255, c & 255) for x in range(w) for c in [back.getRGB(x, y)]] for y in range(h)])
    return jpeg, rgb @ np.array([0.299, 0.587, 0.114])


def without_tables(jpeg):
    at, out = 2, jpeg[:2]
    while jpeg[at + 1] != 0xDA:
        end = at + 2 + struct.unpack_from(">H", jpeg, at + 2)[0]
        if jpeg[at + 1] != 0xC4:
            out += jpeg[at:end]
        at = end
    return out + jpeg[at:]


def test_frames_of_another_encoder(spark):
    y, x = np.mgrid[0:21, 0:35]
    grey = (128 + 90 * np.sin(x / 5) * np.cos(y / 7)).astype(np.uint8)
    colour = np.stack([grey, np.full_like(grey, 90), 255 - grey], 2)
    for pixels, far in ((grey, 1.01), (colour, 4.0)):
        jpeg, want = java_jpeg(spark, pixels)
        got = media.decode_frames([jpeg, without_tables(jpeg)])
        assert got.shape == (2, 21, 35) and (got[0] == got[1]).all()
        assert np.abs(got[0] - want).max() <= far


def test_restart_markers_and_clips_of_baseline_frames(spark):
    """Blocks of one value each, coded by hand: a difference's category and bits, and an end of block; a restart after each."""

    def flat(values):
        data = b""
        for k, v in enumerate(values):
            d = v - 128  # one step of 8 is one sample value, and each restart begins at 0
            size = abs(d).bit_length()
            bits = {0: "00", 1: "010", 2: "011", 3: "100", 4: "101", 5: "110", 6: "1110", 7: "11110"}[size] + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else "") + "1010"
            bits += "1" * (-len(bits) % 8)
            data += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") + (bytes([0xFF, 0xD0 + k % 8]) if k < len(values) - 1 else b"")
        head = media._segment(0xDB, b"\x00" + bytes([8] * 64)) + media._segment(0xDD, b"\x00\x01")
        return b"\xff\xd8" + head + media._segment(0xC0, struct.pack(">BHHBBBB", 8, 8, 8 * len(values), 1, 1, 0x11, 0)) + media._segment(0xDA, struct.pack(">BBBBBB", 1, 1, 0, 0, 63, 0)) + data + b"\xff\xd9"

    frame = media.decode_frames([flat([100, 140, 200, 90, 128, 60, 255, 1, 77, 130])])[0]
    assert [int(v) for v in frame[3, ::8]] == [100, 140, 200, 90, 128, 60, 255, 1, 77, 130]
    films = [[90] * 4] * 6 + [[200] * 4] * 5 + [[30, 30, 220, 220]] * 7
    avi = media.write_avi([flat(f) for f in films], 8, 32, b"made elsewhere")
    table = spark.createDataFrame([(1, bytearray(avi)), (2, None), (1, None)], "doc_id long, media binary")
    rows = media.clips(table).orderBy("clip").collect()
    assert [r["frames"] for r in rows] == [6, 5, 7] and [r["start_ms"] for r in rows] == [0, 240, 440]
    got = {r["doc_id"]: r for r in media.media_features(table.where("doc_id = 2 or media is not null")).collect()}
    assert got[2]["media_bytes"] is None and got[2]["feature"] is None
    assert got[1]["payload_bytes"] == got[1]["n_bytes"] == 18 * 256 and got[1]["feature"].count(";") == 2


def test_slow_changes_are_no_cut():
    fade = np.stack([np.full((16, 16), 40 + 2 * k, np.uint8) for k in range(60)]) + np.random.default_rng(2).integers(0, 60, (60, 16, 16)).astype(np.uint8)
    assert media.cuts(fade) == [0]
    assert media.cuts(np.concatenate([fade, fade[:30] // 3])) == [0, 60]


def test_other_processes_are_named():
    with pytest.raises(ValueError, match="neither"):
        media.decode_frames([b"\xff\xd8" + media._segment(0xC2, struct.pack(">BHHBBBB", 8, 8, 8, 1, 1, 0x11, 0))])

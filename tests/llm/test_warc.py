import gzip
import hashlib
import random

import pytest

from seamark.llm import warc

SCHEMA = "page_id long, url string, html string"


def brute(rows):
    out = []
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    for i, _, h in rows:
        b = (h or "").encode()
        back = first.get(b)
        back = back if back is not None and i is not None and back < i else None
        out.append((i or 0, len(b), hashlib.sha256(b).hexdigest(), "response" if back is None else "revisit", back or -1))
    return sorted(out)


def result(df):
    return sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], -1 if r["refers_to"] is None else r["refers_to"] or -1) for r in df.collect())


def test_round_trip(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("aé漢\r\n🙂 x") for _ in range(60_000))
    hard = "x" * 90 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc" + "\x00"
    rows = [(1, "http://a/", None), (2, "http://a/", ""), (3, None, "short"), (4, "http://a/\n b", "short"), (5, "u", long), (6, "u", long), (7, "u", hard), (8, "u", hard), (9, "u", hard), (9, "u", hard), (None, "u", hard), (10, "u", "z" * 99), (11, "u", "z" * 99), (12, "u", "y" * 100), (13, "u", "y" * 100)]
    d = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS first", "2 AS digest", "3 AS size")
    assert result(warc.archive_round_trip(d)) == brute(rows)
    assert warc.archive_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_segments_in_any_order_and_checks(spark, tmp_path):
    html = "é" * 30_000
    records = warc.records_of(3, "http://x/", html, hashlib.sha256(html.encode()).hexdigest(), None, "0.0")
    assert len(records) > 3
    archive = lambda rs: gzip.compress("".join(r + warc.END for r in rs).encode())
    (tmp_path / "a").mkdir()
    (tmp_path / "a/1.warc.gz").write_bytes(archive(records[:1:-1]))
    (tmp_path / "a/2.warc.gz").write_bytes(archive(records[1::-1]))
    row = warc.read_archives(spark, str(tmp_path / "a")).first()
    assert row["page_id"] == 3 and row["payload_bytes"] == 60_000 and row["payload_digest"] == hashlib.sha256(html.encode()).hexdigest()
    (tmp_path / "b").mkdir()
    (tmp_path / "b/1.warc.gz").write_bytes(archive(records[:2] + records[3:]))
    with pytest.raises(Exception, match="are missing"):
        warc.read_archives(spark, str(tmp_path / "b")).collect()


def test_chunked_framing():
    data = ("a" * 5000 + "é" * 3000).encode()
    assert warc.dechunked(warc.chunked(data)) == data and warc.dechunked(warc.chunked(b"")) == b""
    assert warc.dechunked(b"3;name=x\r\nabc\r\n0\r\nTrailer: y\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"9\r\nabc\r\n0\r\n\r\n")
    assert all(p.decode() is not None for p in warc.cut(data, 7))
    assert warc.payload_of(b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nplain") == b"plain"


def test_archives_of_many_long_pages_are_bounded(spark, monkeypatch, tmp_path):
    import gzip
    import pathlib

    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 40)
    html = [("é" * 50_000 + str(i)) for i in range(30)] + ["x" * 300_000, None, ""]
    pages = spark.createDataFrame(list(enumerate(html)), "page_id long, html string").selectExpr("page_id", "'http://a.b/c' AS url", "html", "1 AS digest").coalesce(1)
    warc.write_archives(pages, f"{tmp_path}/out")
    sizes = [len(gzip.decompress(p.read_bytes())) for p in pathlib.Path(f"{tmp_path}/out").glob("*.gz")]
    assert len(sizes) > 5 and max(sizes) <= 40 * (warc.SEGMENT_BYTES + 1000)
    rows = {r["page_id"]: r["payload_bytes"] for r in warc.read_archives(spark, f"{tmp_path}/out").collect()}
    assert rows == {i: len((h or "").encode()) for i, h in enumerate(html)}


def test_archives_compressed_by_record_or_not_at_all():
    import gzip

    records = [warc.records_of(i, "u", f"page {i}", "d", None, "s")[0].encode() + b"\r\n\r\n" for i in range(5)]
    for archive in (b"".join(map(gzip.compress, records)), gzip.compress(b"".join(records)), b"".join(records)):
        assert [warc.payload_of(b) for _, b in warc.parsed(archive)] == [f"page {i}".encode() for i in range(5)]
    with pytest.raises(ValueError):
        list(warc.parsed(b"".join(records)[:-20]))

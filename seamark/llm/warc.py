"""WARC archives with segmented records and chunked transfer framing.

Writing: every page is one record, whose block is an HTTP response in chunked
framing; a block over ``SEGMENT_BYTES`` is cut into a first record and
``continuation`` records.  Pages that repeat the payload of a smaller page are
``revisit`` records.  Spark's text writer puts the records into gzip archives in
any store it can write, and commits them as it commits any table.

An archive is bounded by records and, as a record's block is a segment at most,
by bytes: about ``ARCHIVE_RECORDS * SEGMENT_BYTES`` and the headers, unpacked.

Reading: a task holds one packed archive and one record of it at a time; records
are parsed by their content lengths, and continuation records are grouped by their origin,
put in order by segment number, checked against the total length, and decoded.
Blocks of one record go to one task, and a record is no longer than its page.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, map_rows, only, shared_path, to_arrow_schema, written

#: Bytes of a chunk, of a segment's block, and of the shortest payload that is worth a revisit; records of an archive.
CHUNK_BYTES, SEGMENT_BYTES, REVISIT_BYTES, ARCHIVE_RECORDS = 4096, 16384, 100, 2000
END = "\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"

RECORDS = "page_id long, record_type string, refers_to long, header_digest string, payload_bytes long, payload_digest string, origin string, segment int, total long, block binary"


def cut(data: bytes, size: int) -> Iterator[bytes]:
    """Parts of at most ``size`` bytes that end between UTF-8 characters."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and end > at + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end]
        at = end


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in cut(payload, size)) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].partition(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + size])
        at = line + 2 + size + 2
        if len(out[-1]) != size or body[at - 2 : at] != b"\r\n":
            raise ValueError("a chunk is shorter than its size")


def payload_of(block: bytes) -> bytes:
    """What an HTTP response carries."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = dict(x.split(b":", 1) for x in head.lower().split(b"\r\n")[1:] if b":" in x)
    return dechunked(body) if fields.get(b"transfer-encoding", b"").strip() == b"chunked" else body


def record(fields: list[tuple[str, object]], block: bytes) -> str:
    """A record without the two line ends that follow it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return f"WARC/1.1\r\n{head}\r\n" + block.decode()


def one_line(url: str | None) -> str | None:
    """A URL as a header value."""
    return url and "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def records_of(page_id: int | None, url: str | None, html: str | None, digest: str, first: int | None, serial: str) -> list[str]:
    """The records of one page: one, or a first and its continuations."""
    name = f"<urn:page:{'' if page_id is None else page_id}:{serial}"
    fields = [("WARC-Date", DATE), ("WARC-Target-URI", one_line(url)), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if first is not None:
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", name + ">"), *fields, ("WARC-Refers-To", f"<urn:page:{first}>"), ("WARC-Profile", PROFILE), ("Content-Type", "application/http;msgtype=response")], HTTP)]
    block = HTTP + chunked((html or "").encode("utf-8", "replace"))
    parts = list(cut(block, SEGMENT_BYTES))
    kind = [("Content-Type", "application/http;msgtype=response")]
    if len(parts) == 1:
        return [record([("WARC-Type", "response"), ("WARC-Record-ID", name + ">"), *fields, *kind], block)]
    out = [record([("WARC-Type", "response"), ("WARC-Record-ID", name + ">"), *fields, ("WARC-Segment-Number", 1), *kind], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name}:{k}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name + ">"), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", len(block) if k == len(parts) else None)], part))
    return out


def first_pages(pages: DataFrame) -> DataFrame:
    """Digest and smallest page_id of every payload of ``REVISIT_BYTES`` or more that several pages have."""
    long = pages.where((F.col("size") >= REVISIT_BYTES) & F.col("page_id").isNotNull())
    return long.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes all pages as archives under ``path``.

    A null html is an empty payload.  Rows that repeat a page_id are records of
    their own; a null page_id never refers to another page.
    """
    html = F.coalesce("html", F.lit(""))
    rows = only(pages, "page_id", "url", "html").withColumns({"digest": F.sha2(F.encode(html, "UTF-8"), 256), "size": F.octet_length(html)})
    # Written first, so that its size is known: few repeated payloads reach the pages without moving them.
    firsts = written(first_pages(rows))
    rows = rows.join(firsts, "digest", "left").select("page_id", "url", "html", "digest", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("first"))

    def make():
        part, n = TaskContext.get().partitionId(), 0

        def step(batch: pa.RecordBatch) -> dict:
            nonlocal n
            out = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                out += records_of(*row, f"{part:x}.{n:x}")
                n += 1
            return {"value": out}

        return step

    map_rows(rows, make, "value string").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def parsed(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (small letters) and block of every record of an archive, compressed as a whole, by record, or not at all.

    Records are read one by one: of what is unpacked only one is held.
    """
    raw = io.BytesIO(archive)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) if archive[:2] == b"\x1f\x8b" else raw
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().partition(":")
            fields[k.strip().lower()] = v.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("an archive ends within a record")
        yield fields, block


def _page(uri: str | None) -> int | None:
    number = (uri or "").strip("<>").split(":")
    return int(number[2]) if len(number) > 2 and number[2] else None


def _row(fields: dict[str, str], block: bytes) -> tuple:
    kind, segment = fields["warc-type"], fields.get("warc-segment-number")
    origin = fields.get("warc-segment-origin-id") or (fields["warc-record-id"] if segment else None)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
    whole = kind == "response" and not segment
    payload = payload_of(block) if whole else b""
    return (
        _page(fields["warc-record-id"]) if kind != "continuation" else None,
        kind,
        _page(fields.get("warc-refers-to")),
        digest,
        len(payload) if whole else None,
        hashlib.sha256(payload).hexdigest() if whole else None,
        origin,
        int(segment) if segment else None,
        int(fields["warc-segment-total-length"]) if "warc-segment-total-length" in fields else None,
        block if origin else None,
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: whole ones decoded, segments with their blocks; see ``RECORDS``."""
    arrow = to_arrow_schema(spark, RECORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows, size = [], 0
                for fields, block in parsed(archive.as_py()):
                    rows.append(_row(fields, block))
                    size += len(block)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return map_batches(spark.read.format("binaryFile").load(path).select("content"), run, RECORDS)


def reassembled(segments: DataFrame) -> DataFrame:
    """Segmented responses, put together: page_id, header_digest, payload_bytes, payload_digest."""
    parts = F.array_sort(F.collect_list(F.struct("segment", "total", "block")))
    whole = segments.groupBy("origin").agg(parts.alias("parts"), F.max("page_id").alias("page_id"), F.max("header_digest").alias("header_digest"))
    numbers, total = F.col("parts.segment"), F.element_at("parts.total", -1)
    whole = whole.select("origin", "page_id", "header_digest", numbers.alias("numbers"), total.alias("total"), F.col("parts.block").alias("blocks"))

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"page_id": batch.column(1), "header_digest": batch.column(2), "payload_bytes": [], "payload_digest": []}
            for origin, numbers, total, blocks in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4, 5))):
                block = b"".join(blocks)
                if numbers != list(range(1, len(numbers) + 1)) or total != len(block):
                    raise ValueError(f"segments of {origin} are missing: numbers {numbers}, {len(block)} of {total} bytes")
                payload = payload_of(block)
                out["payload_bytes"].append(len(payload))
                out["payload_digest"].append(hashlib.sha256(payload).hexdigest())
            return out

        return step

    return map_rows(whole, make, "page_id long, header_digest string, payload_bytes long, payload_digest string")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page record: page_id, payload_bytes, payload_digest (of what was read), record_type, refers_to.

    A revisit's payload is that of the response it refers to, whose digest must
    be the one in its header.
    """
    records = written(read_records(spark, path))
    whole = records.where("record_type = 'response' and origin is null").select("page_id", "header_digest", "payload_bytes", "payload_digest")
    responses = written(whole.unionByName(reassembled(records.where("origin is not null"))))
    if wrong := responses.where(~F.col("header_digest").eqNullSafe(F.col("payload_digest"))).take(1):
        raise ValueError(f"payload and digest differ: {wrong[0]['page_id']}")
    revisits = records.where("record_type = 'revisit'").select("page_id", "refers_to", "header_digest")
    # Written, so that the join that follows is free to split the revisits of one page.
    known = written(responses.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("header_digest"), "payload_bytes", "payload_digest").dropDuplicates(["refers_to", "header_digest"]))
    revisits = revisits.join(known, ["refers_to", "header_digest"], "left")
    return responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisits.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    )


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages to the shared folder and reads the archives back."""
    path = shared_path(pages.sparkSession, "warc-")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT h, min(page_id) AS f FROM d WHERE n >= 100 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest, CASE WHEN f < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN f < page_id THEN f END AS refers_to FROM d LEFT JOIN f USING (h)
"""

"""WARC archives: a writer with identical-payload revisits, and a reader that salvages damaged files.

Writing and reading go through Spark's own file sources, so any store that Spark reaches will do. Each record
is a gzip member; Spark's text writer puts a zero byte after every row, which is member padding to gzip
readers. A file ends with the record that takes it to ``FILE`` bytes, which bounds what a reading task holds; rows leave
it in batches of about ``BATCH`` bytes of payload.

The reader takes members, of one record or several, or plain version lines as they come, checks lengths and block digests, and after a
failed check looks for the next gzip member or ``WARC/`` line, goes on there and reports the bytes between as a
quarantined gap. Records inside a gap whose start is damaged are found again by that search.

Defined cases: a null html is an empty payload and a null url is left out; a null page_id is written as
``null``, is always a response and is never referred to; rows that repeat a page_id are written one by one,
all of the smallest id's rows as responses; control characters and spaces in a url are percent-encoded;
other columns are ignored; an empty table writes files without records.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch

#: Payloads under so many bytes are never revisits; bytes of headers that are searched where no member bounds them.
LEAST, HEADERS = 100, 1 << 16
#: Compressed bytes of a file, and bytes of payload in a batch that is read.
FILE, BATCH = 32 << 20, 8 << 20
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_GZIP, _VERSION, _END = b"\x1f\x8b\x08", b"WARC/", b"\r\n\r\n"


def assign(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, digest, size and refers_to (null: a response of its own).

    Only ids and digests meet by digest, reduced before they are dealt; html rows are dealt by id and digest,
    so a page with thousands of copies is no hot key for them.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html").cast("long"))
    known = rows.where(F.col("size") >= least).select("page_id", "digest")
    first = materialize(known.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    later = known.join(first, "digest").where("page_id > refers_to").distinct()
    return rows.join(later, ["page_id", "digest"], "left")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(lines).encode() + _END + block + _END


def member(raw: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, wbits=31)
    return z.compress(raw) + z.flush()


def _members(batches: Iterator[pa.RecordBatch], file: int) -> Iterator[pa.RecordBatch]:
    """Members one after the other, a row for each file."""
    held, size = [], 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"\0".join(held)], pa.binary())], ["value"])

    for batch in batches:
        for i, u, h, d, r in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to"))):
            held.append(member(record(i.as_py(), u.as_py(), h.as_py(), d.as_py(), r.as_py())))
            size += len(held[-1])
            if size >= file:
                yield row()
                held, size = [], 0
    if held:
        yield row()


def write(assigned: DataFrame, path: str, file: int = FILE) -> None:
    """Archives in the new folder ``path``."""
    rows = assigned.select("page_id", "url", F.col("html").cast("binary"), "digest", "refers_to").mapInArrow(lambda it: _members(it, file), "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def _parse(data: bytes, at: int, member: bool) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``; ValueError says which check failed."""
    stop = data.find(_END, at, len(data) if member else at + HEADERS)  # a member bounds its headers
    if not data.startswith(_VERSION, at) or stop < 0:
        raise ValueError("no record header")
    lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not re.fullmatch("[0-9]{1,18}", headers.get("content-length", "")):
        raise ValueError("no content length")
    begin = stop + 4
    end = begin + int(headers["content-length"])
    if end > len(data):
        raise ValueError("cut short")
    block = data[begin:end]
    kind, _, want = headers.get("warc-block-digest", "").partition(":")
    if kind == "sha256" and hashlib.sha256(block).hexdigest() != want:
        raise ValueError("block digest differs")
    if data[end : end + 4] != _END:
        raise ValueError("no record end")
    return headers, block, end + 4


def _inside(raw: bytes) -> Iterator[tuple[dict[str, str] | None, bytes, str]]:
    """(headers, block, "") of the sound records of a member, (None, b"", reason) where one is not."""
    at, lost = 0, False
    while at < len(raw):
        try:
            headers, block, at = _parse(raw, at, True)
            yield headers, block, ""
            lost = False
        except ValueError as e:
            if not lost:
                yield None, b"", str(e)
            lost, at = True, raw.find(_VERSION, at + 1)
            if at < 0:
                return


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    z, out, k = zlib.decompressobj(31), [], at
    while not z.eof and k < len(data):
        out.append(z.decompress(data[k : k + 8192]))
        k += 8192
    if not z.eof:
        raise ValueError("member cut short")
    return b"".join(out), min(k, len(data)) - len(z.unused_data)


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str]]:
    """(start, end, headers, block, "") of each sound record, (start, end, None, b"", reason) of each gap, in order. Records
    and gaps of one member have its start and end."""
    at, gap, why = 0, None, ""
    ahead = dict.fromkeys((_GZIP, _VERSION), -1)  # where each begins next: a search is never made twice
    while at < len(data):
        if gap is None and data[at] in b"\0\r\n":  # padding
            at += 1
            continue
        try:
            if data.startswith(_GZIP, at):
                raw, end = _inflate(data, at)
                found = list(_inside(raw))
                if not any(h for h, _, _ in found):
                    raise ValueError(found[0][2] if found else "no record header")
            else:
                headers, block, end = _parse(data, at, False)
                found = [(headers, block, "")]
        except (ValueError, zlib.error) as e:
            if gap is None:
                gap, why = at, str(e)
            for x in ahead:
                if ahead[x] <= at:
                    ahead[x] = next_at if (next_at := data.find(x, at + 1)) >= 0 else len(data)
            at = min(ahead.values())
            continue
        if gap is not None:
            yield gap, at, None, b"", why
            gap = None
        yield from ((at, end, *x) for x in found)
        at = end
    if gap is not None:
        yield gap, len(data), None, b"", why


_ROW = "path string, start long, stop long, reason string, type string, record_id string, uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def _records(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    strip = lambda x: x and x.strip("<>").removeprefix("urn:page:")
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], [x.split()[0] for x in _ROW.split(", ")])

    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            rows, name, size_held = [], path.as_py(), 0
            for start, stop, h, block, why in salvage(content.as_py() or b""):
                if h is None:
                    rows.append((name, start, stop, why, *[None] * 7))
                    continue
                head, _, payload = block.partition(_END)
                size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                declared = h.get("warc-payload-digest", "").removeprefix("sha256:")
                if h.get("warc-type") == "revisit":
                    m = re.search(rb"(?im)^content-length:\s*([0-9]+)", head)
                    size, digest = int(m[1]) if m else 0, declared
                elif declared and declared != digest:
                    rows.append((name, start, stop, "payload digest differs", *[None] * 7))
                    continue
                rows.append((name, start, stop, None, h.get("warc-type"), strip(h.get("warc-record-id")), h.get("warc-target-uri"), strip(h.get("warc-refers-to")), size, digest, payload if payloads else None))
                size_held += 1000 + (len(payload) if payloads else 0)
                if size_held >= BATCH:
                    yield batch_of(rows)
                    rows, size_held = [], 0
            yield batch_of(rows)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per sound record (reason null) and per quarantined gap (reason says why, only place columns set)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(lambda it: _records(it, payloads), _ROW)


def op7_warc(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write(assign(pages), path)
    back = read(spark, path, payloads=False).where("reason is null")
    number = lambda c: F.expr(f"try_cast({c} as bigint)")
    return back.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("refers_to").alias("refers_to")
    )


ORACLE = """with p as (select page_id, coalesce(html, '') as html from pages),
q as (select page_id, cast(strlen(html) as bigint) as payload_bytes, sha256(html) as payload_digest,
  case when strlen(html) >= 100 then min(page_id) over (partition by html) else page_id end as first_id from p)
select cast(page_id as bigint) as page_id, payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id = first_id then null else cast(first_id as bigint) end as refers_to from q"""

"""Reassembly of segmented WARC records.

A long record may be split: the first segment has number 1, the others are ``continuation``
records with the origin's id, their number, and, on the last, the total length.  Records are
parsed once; segments meet by origin id, are put in order by their number, and are joined as
they stream by, so that a record of any number of segments needs no more memory than its
content.  The joined block must have the declared total length.  If it is an HTTP message
with chunked transfer coding, the chunks are decoded (extensions and trailers are skipped).

``status`` says what came out: ``ok``; ``missing`` (a number is absent, or the last segment's
total length is); ``conflict`` (two different segments share a number); ``length`` (the sizes
don't add up); ``framing`` (broken chunks); ``long`` (more than ``MOST_BYTES``, which no value of
a row can hold); ``malformed`` (not a WARC record, a row by itself without an id).  The payload
is null for all but ``ok``.

Records of files come from ``from_files``: plain or gzip members, one record after another.

A segment that is delivered again and again is dropped where it is read, so that a hot record
brings at most one copy of each segment from each task to its place.

Defined cases: null and empty records are malformed; a record delivered twice counts once;
an unsegmented record is a single segment; repeated headers count as first given; numbers
that aren't plain digits or don't fit (segment numbers 32 bits, lengths 64) are malformed; an HTTP
status of other than three digits is null.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CHUNK, SEGMENT = 1000, 2048
SIZE = re.compile(rb"0*([0-9a-fA-F]{1,16})[ \t]*(?:;[^\r\n]*)?\r?\n")
DIGITS = re.compile(r"0*([0-9]{1,19})")
#: Rows of a batch that writes or reads payloads.
BYTES_AT_ONCE = 8 << 20
#: A value of a row can't be longer.
MOST_BYTES = (1 << 31) - 1024


def headers(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in head.split(b"\n")[1:]:
        line = line.rstrip(b"\r")
        if line[:1] in (b" ", b"\t") and last:
            out[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if colon:
            last = name.strip().lower().decode("latin-1")
            if last in out:
                last = None
            else:
                out[last] = value.strip().decode("utf-8", "replace")
    return out


def split_head(data: bytes) -> tuple[bytes, bytes] | None:
    for mark in (b"\r\n\r\n", b"\n\n"):
        head, found, rest = data.partition(mark)
        if found:
            return head, rest
    return None


def whole(text: str, bits: int = 63) -> int:
    """A number of plain digits that fits; ValueError otherwise."""
    found = DIGITS.fullmatch(text)
    if found is None or int(found.group(1)) >> bits:
        raise ValueError(text[:40])
    return int(found.group(1))


def read_record(data: bytes | None) -> tuple[str, int, int | None, str | None, str, bytes] | None:
    """(origin id, segment number, total length, url, type, block); None if it isn't a WARC record."""
    if not data or not data.startswith(b"WARC/"):
        return None
    parts = split_head(data)
    if parts is None:
        return None
    h = headers(parts[0])
    kind = h.get("warc-type", "").lower()
    origin = h.get("warc-segment-origin-id") if kind == "continuation" else h.get("warc-record-id")
    try:
        length, number = whole(h["content-length"]), whole(h.get("warc-segment-number", "1"), 31)
        total = whole(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None
    except (KeyError, ValueError):
        return None
    if not origin or number < 1 or len(parts[1]) < length:
        return None
    if total is None and "warc-segment-number" not in h:
        total = length
    return origin, number, total, h.get("warc-target-uri"), kind, parts[1][:length]


def dechunk(data: bytes) -> bytes | None:
    """The body of a chunked message; None if the framing is broken."""
    out, at = [], 0
    while True:
        m = SIZE.match(data, at)
        if m is None:
            return None
        n = int(m.group(1), 16)
        at = m.end()
        if n == 0:
            return b"".join(out)
        if at + n > len(data):
            return None
        out.append(data[at : at + n])
        at += n
        if data[at : at + 2] == b"\r\n":
            at += 2
        elif data[at : at + 1] == b"\n":
            at += 1
        else:
            return None


def payload(block: bytes) -> tuple[str, int | None, bytes | None]:
    """(status, HTTP status, body)."""
    if not block.startswith(b"HTTP/"):
        return "ok", None, block
    parts = split_head(block)
    if parts is None:
        return "ok", None, block
    line = parts[0].split(b"\n", 1)[0].split()
    code = int(line[1]) if len(line) > 1 and line[1].isdigit() and len(line[1]) == 3 else None
    if "chunked" in headers(parts[0]).get("transfer-encoding", "").lower():
        body = dechunk(parts[1])
        return ("ok" if body is not None else "framing"), code, body
    return "ok", code, parts[1]


def parse(records: DataFrame, record: str = "record") -> DataFrame:
    """(origin, number, total, url, kind, block) of each record; malformed ones have a null origin and a checksum as their number."""
    schema = "origin string, number int, total bigint, url string, kind string, block binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()

        def new(row: tuple) -> bool:
            """False for a segment that this task has had before."""
            key = hashlib.blake2b(repr(row[:5]).encode() + row[5], digest_size=16).digest()
            return not (key in seen or seen.add(key))

        for b in batches:
            rows = [read_record(x) or (None, zlib.crc32(x or b"") >> 1, None, None, "malformed", None) for x in b.column(0).to_pylist()]
            rows = [r for r in rows if r[0] is None or new(r)]
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary())
            yield common.batch(**{n: pa.array(c, t) for n, c, t in zip(("origin", "number", "total", "url", "kind", "block"), cols, kinds)})

    return records.select(F.col(f"`{record}`").cast("binary").alias("record")).mapInArrow(common.lean(run), schema)


SCHEMA = "record_id string, url string, status string, n_segments int, total_length bigint, http_status int, payload binary"


def reassemble(records: DataFrame, record: str = "record") -> DataFrame:
    """One row for each record: (record_id, url, status, n_segments, total_length, http_status, payload)."""
    common.prepare(records.sparkSession)
    parsed = parse(records, record)
    # malformed rows are spread by content instead of meeting under one null
    key = F.coalesce(F.col("origin"), F.col("number").cast("string"))
    ordered = parsed.repartition(key).sortWithinPartitions("origin", "number")

    def close(origin: str | None, parts: list[tuple[int, bytes]], totals: set[int], url: str | None, clash: bool, held: int) -> tuple:
        total = max(totals) if totals else None
        if held > MOST_BYTES:
            return origin, url, "long", len(parts), total, None, None
        block = b"".join(p for _, p in parts)
        if clash or len(totals) > 1:
            status = "conflict"
        elif total is None or [n for n, _ in parts] != list(range(1, len(parts) + 1)):
            status = "missing"
        elif total != len(block):
            status = "length"
        else:
            status, code, body = payload(block)
            return origin, url, status, len(parts), total, code, body
        return origin, url, status, len(parts), total, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        now, parts, totals, url, clash, held = None, [], set(), None, False, 0
        for b in batches:
            for origin, number, total, uri, _, block in zip(*(c.to_pylist() for c in b.columns)):
                if origin is None:
                    out.append((None, None, "malformed", 0, None, None, None))
                    continue
                if origin != now:
                    if now is not None:
                        out.append(close(now, parts, totals, url, clash, held))
                        size += len(out[-1][6] or b"")
                    now, parts, totals, url, clash, held = origin, [], set(), None, False, 0
                if parts and parts[-1][0] == number:
                    clash |= parts[-1][1] != block
                else:
                    held += len(block)
                    parts.append((number, block if held <= MOST_BYTES else b""))
                if total is not None:
                    totals.add(total)
                url = url or uri
                if size > BYTES_AT_ONCE or len(out) >= 5000:
                    yield as_batch(out)
                    out, size = [], 0
        if now is not None:
            out.append(close(now, parts, totals, url, clash, held))
        if out:
            yield as_batch(out)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
        names = ("record_id", "url", "status", "n_segments", "total_length", "http_status", "payload")
        return common.batch(**{n: pa.array(c, t) for n, c, t in zip(names, zip(*rows), kinds)})

    return ordered.mapInArrow(common.lean(run), SCHEMA)


def members(data: bytes) -> Iterator[bytes]:
    """The content of a file: itself, or its gzip members one by one; a broken member ends them, of one that is cut what is there counts."""
    if not data.startswith(b"\x1f\x8b"):
        yield data
        return
    while data.startswith(b"\x1f\x8b"):
        unzip, out = zlib.decompressobj(31), b""
        try:
            out = unzip.decompress(data)
        except zlib.error:
            return
        if out:
            yield out
        data = unzip.unused_data.lstrip(b"\0")


def split_records(data: bytes) -> Iterator[bytes]:
    """The records of a file's content, each with its head and block; what isn't a record up to the next one is a row of its own."""
    at = 0
    while at < len(data):
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1
        if at == len(data):
            return
        ends = [(data.find(m, at), len(m)) for m in (b"\r\n\r\n", b"\n\n")]
        head = min(((p, n) for p, n in ends if p >= 0), default=None)
        end = None
        if head is not None and data.startswith(b"WARC/", at):
            try:
                end = head[0] + head[1] + whole(headers(data[at : head[0]])["content-length"])
            except (KeyError, ValueError):
                pass
        if end is None:  # it goes on at the next line that begins a record
            found = data.find(b"\nWARC/", at + 1)
            end = len(data) if found < 0 else found + 1
        yield data[at:end]
        at = end


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """(record): the records of WARC files, plain or gzip; a file is read by one task, as gzip demands."""
    common.prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for x in b.column(0):
                for part in members(x.as_py() or b""):
                    for record in split_records(part):
                        out.append(record)
                        size += len(record)
                        if size > BYTES_AT_ONCE:
                            yield common.batch(record=pa.array(out, pa.binary()))
                            out, size = [], 0
            if out:
                yield common.batch(record=pa.array(out, pa.binary()))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(common.lean(run), "record binary")


def write_record(record_id: str, url: str | None, body: bytes, chunk: int = CHUNK, segment: int = SEGMENT) -> list[bytes]:
    """A chunked HTTP response as WARC segments."""
    framed = b"".join(b"%x\r\n%s\r\n" % (len(body[i : i + chunk]), body[i : i + chunk]) for i in range(0, len(body), chunk)) + b"0\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\n\r\n" + framed
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = []
    for k, piece in enumerate(pieces, 1):
        lines = ["WARC/1.1", f"WARC-Type: {'response' if k == 1 else 'continuation'}", f"WARC-Record-ID: {record_id if k == 1 else record_id[:-1] + f':{k}>'}"]
        if k == 1 and url is not None:
            lines.append(f"WARC-Target-URI: {url}")
        if k > 1:
            lines.append(f"WARC-Segment-Origin-ID: {record_id}")
        lines.append(f"WARC-Segment-Number: {k}")
        if k == len(pieces):
            lines.append(f"WARC-Segment-Total-Length: {len(block)}")
        lines.append(f"Content-Length: {len(piece)}")
        out.append("\r\n".join(lines).encode() + b"\r\n\r\n" + piece + b"\r\n\r\n")
    return out


def from_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(record): the pages as segmented WARC records; pages without an id are left out."""
    common.prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for i, u, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                new = write_record(f"<urn:page:{i}>", u, (t.as_py() or "").encode())
                out += reversed(new)
                size += sum(map(len, new))
                if size > BYTES_AT_ONCE:
                    yield common.batch(record=pa.array(out, pa.binary()))
                    out, size = [], 0
            if out:
                yield common.batch(record=pa.array(out, pa.binary()))

    slim = common.reduced_scan(pages, page_id=page_id, url=url, html=html).where("page_id is not null")
    return slim.mapInArrow(common.lean(run), "record binary")


ORACLE_SQL = r"""
with size as (
  select page_id, url, html, octet_length(encode(html)) as n from pages
), block as (
  select *, 72 + n + (n // 1000) * 7 + case when n % 1000 > 0 then length(lower(printf('%x', n % 1000))) + 4 else 0 end + 5 as total from size
)
select page_id, url, 'ok' as status, cast((total + 2047) // 2048 as integer) as n_segments, cast(total as bigint) as total_length,
       cast(200 as integer) as http_status, html from block
"""

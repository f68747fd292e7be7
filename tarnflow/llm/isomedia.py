"""Media columns from ISO base media containers (MP4 and kin).

The walker reads box headers only: 32- and 64-bit sizes, boxes that run to the end, ``uuid``
boxes, any nesting.  From each track it takes the handler, the time scale, the duration and
the sample tables (``stts`` durations, ``stsz``/``stz2`` sizes, ``stsc`` samples to chunks,
``stco``/``co64`` chunk offsets, ``stss`` keyframes); joined, they give every keyframe's byte
range in the file.  Fragments (``moof`` with ``traf``, ``tfhd``, ``trun`` and the defaults of ``trex``)
add their samples to those of the tables, in file order.  Payloads (``mdat``) are never touched.

One row for each track: codec (with profile where ``avcC`` or ``hvcC`` has it), duration in
milliseconds, and parallel arrays of keyframe numbers, offsets and sizes.

Defined cases: a null or empty container, or one without a movie box, has one row with a null
track and status ``no movie``; a broken box or table gives ``broken`` for its track, or for
the container; a table that says more than its box can hold, and more samples of one common
size than the container has bytes, are broken (nothing is allocated for them); numbers that
don't fit 63 bits are broken; ``fragmented`` is a track of a fragmented movie without any
sample here (its fragments are in other files); no ``stss`` means that every sample of the
tables is a keyframe (sound, for example); an unknown duration is computed from the samples;
repeated rows give repeated results.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta"))
BYTES_AT_ONCE = 8 << 20


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, begin of content, end) of the boxes in a range; ValueError if one doesn't fit."""
    at = start
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise ValueError("box header")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if kind == b"uuid":
            head += 16
        if size < head or at + size > end:
            raise ValueError("box size")
        yield kind, at + head, at + size
        at += size


def walk(data: memoryview, start: int, end: int) -> dict[bytes, tuple[int, int]]:
    """The first box of each type below a range, parents before their children; any depth."""
    found: dict[bytes, tuple[int, int]] = {}
    stack = [boxes(data, start, end)]
    while stack:
        for kind, a, b in stack[-1]:
            found.setdefault(kind, (a, b))
            if kind in CONTAINERS:
                stack.append(boxes(data, a, b))
                break
        else:
            stack.pop()
    return found


def fits(n: int) -> int:
    if not 0 <= n < 1 << 63:
        raise ValueError("number")
    return n


def numbers(data: memoryview, at: int, end: int, count: int, width: int, kind: str) -> np.ndarray:
    if count * width > end - at:
        raise ValueError("table")
    return np.frombuffer(data, kind, count * width // np.dtype(kind).itemsize, at).astype(np.int64)


def sample_ranges(data: memoryview, box: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Offset and size of each sample."""
    if b"stsz" in box:
        a, b = box[b"stsz"]
        same, n = struct.unpack_from(">II", data, a + 4)
        if same and n * same > len(data):
            raise ValueError("sample count")
        sizes = np.full(n, same, np.int64) if same else numbers(data, a + 12, b, n, 4, ">u4")
    else:
        a, b = box[b"stz2"]
        bits, n = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
        if bits == 4:
            half = numbers(data, a + 12, b, (n + 1) // 2, 1, ">u1")
            sizes = np.stack([half >> 4, half & 15], axis=1).ravel()[:n]
        else:
            sizes = numbers(data, a + 12, b, n, bits // 8, f">u{bits // 8}")
    a, b = box.get(b"stco") or box[b"co64"]
    wide = 4 if b"stco" in box else 8
    chunks = numbers(data, a + 8, b, struct.unpack_from(">I", data, a + 4)[0], wide, f">u{wide}")
    a, b = box[b"stsc"]
    entries = numbers(data, a + 8, b, struct.unpack_from(">I", data, a + 4)[0], 12, ">u4").reshape(-1, 3)
    if not len(sizes):
        return sizes, sizes
    first = np.append(entries[:, 0], len(chunks) + 1)
    if not len(entries) or first[0] != 1 or (np.diff(first) < 0).any() or not len(chunks) or chunks.min() < 0 or chunks.max() > 1 << 62:
        raise ValueError("stsc")
    per_chunk = np.repeat(entries[:, 1], np.diff(first))
    if per_chunk.sum() != len(sizes):
        raise ValueError("samples and chunks differ")
    chunk = np.repeat(np.arange(len(chunks)), per_chunk)
    before = np.cumsum(sizes) - sizes
    lead = (np.cumsum(per_chunk) - per_chunk)[chunk]
    return chunks[chunk] + before - before[lead], sizes


def codec_of(data: memoryview, a: int, b: int) -> tuple[str, int, int]:
    """Codec string, width and height from ``stsd``."""
    kind, at, end = next(boxes(data, a + 8, b))
    name, width, height = bytes(kind).decode("latin-1"), 0, 0
    if kind in (b"avc1", b"avc3", b"hvc1", b"hev1", b"vp09", b"av01", b"mp4v") and end - at >= 78:
        width, height = struct.unpack_from(">HH", data, at + 24)
        for inner, x, y in boxes(data, at + 78, end):
            if inner == b"avcC" and y - x >= 4:
                name += f".{data[x + 1]:02x}{data[x + 2]:02x}{data[x + 3]:02x}"
            elif inner == b"hvcC" and y - x >= 13:
                name += f".{data[x + 1] & 31}.L{data[x + 12]}"
    return name, width, height


def track(data: memoryview, a: int, b: int) -> dict:
    """A track's row, with its samples' durations as ``ticks`` and its time ``scale`` beside."""
    out: dict = {"status": "broken"}
    try:
        box = walk(data, a, b)
        x, _ = box[b"tkhd"]
        out["track"] = struct.unpack_from(">I", data, x + (20 if data[x] else 12))[0]
        x, _ = box[b"hdlr"]
        out["kind"] = bytes(data[x + 8 : x + 12]).decode("latin-1")
        x, _ = box[b"mdhd"]
        scale, length = struct.unpack_from(">IQ", data, x + 20) if data[x] else struct.unpack_from(">II", data, x + 12)
        out["codec"], out["width"], out["height"] = codec_of(data, *box[b"stsd"])
        offset, size = sample_ranges(data, box)
        x, y = box[b"stts"]
        stts = numbers(data, x + 8, y, struct.unpack_from(">I", data, x + 4)[0], 8, ">u4").reshape(-1, 2)
        if stts[:, 0].sum() != len(size):
            raise ValueError("stts")
        ticks = sum(n * d for n, d in stts.tolist())
        known = length not in (0, 0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF)
        if not scale:
            raise ValueError("time scale")
        if b"stss" in box:
            x, y = box[b"stss"]
            key = numbers(data, x + 8, y, struct.unpack_from(">I", data, x + 4)[0], 4, ">u4")
            if len(key) and (key.min() < 1 or key.max() > len(size)):
                raise ValueError("stss")
        else:
            key = np.arange(1, len(size) + 1)
        out |= {"duration_ms": fits((length if known else ticks) * 1000 // scale), "n_samples": len(size), "keyframes": key, "offsets": offset[key - 1], "sizes": size[key - 1], "scale": scale, "ticks": None if known else ticks, "status": "ok"}
    except (KeyError, IndexError, ValueError, struct.error, StopIteration):
        pass
    return out


def run_of(data: memoryview, a: int, b: int, default: tuple[int, int, int]) -> tuple[int | None, np.ndarray, np.ndarray, np.ndarray]:
    """(data offset, durations, sizes, whether each is a keyframe) of a ``trun``."""
    flags, n = struct.unpack_from(">II", data, a)
    flags &= 0xFFFFFF
    at, offset, lead = a + 8, None, None
    if flags & 1:
        offset = struct.unpack_from(">i", data, at)[0]
        at += 4
    if flags & 4:
        lead = struct.unpack_from(">I", data, at)[0]
        at += 4
    fields = [f for f in (0x100, 0x200, 0x400, 0x800) if flags & f]
    if n > len(data):
        raise ValueError("sample count")
    rows = numbers(data, at, b, n * len(fields), 4, ">u4").reshape(n, len(fields))
    each = [rows[:, fields.index(f)] if f in fields else np.full(n, d, np.int64) for f, d in zip((0x100, 0x200, 0x400), default)]
    if lead is not None and n:
        each[2] = each[2].copy()
        each[2][0] = lead
    if int(each[1].sum()) > len(data):
        raise ValueError("sample sizes")
    return offset, each[0], each[1], each[2] & 0x10000 == 0


def fragment(data: memoryview, start: int, a: int, b: int, extends: dict[int, tuple[int, int, int]], found: dict[int, list]) -> None:
    """The samples of a ``moof`` at ``start``: (offsets, sizes, keyframe or not, durations) by track, added to ``found``."""
    end = start  # where the data of the run before ends
    for kind, x, y in boxes(data, a, b):
        if kind != b"traf":
            continue
        parts = list(boxes(data, x, y))
        p = next(p for k, p, _ in parts if k == b"tfhd")
        flags, number = struct.unpack_from(">II", data, p)
        flags, at, base = flags & 0xFFFFFF, p + 8, start if flags & 0x20000 else end
        if flags & 1:
            base, at = struct.unpack_from(">Q", data, at)[0], at + 8
        at += 4 if flags & 2 else 0
        default = list(extends.get(number, (0, 0, 0)))
        for k, f in enumerate((8, 0x10, 0x20)):
            if flags & f:
                default[k], at = struct.unpack_from(">I", data, at)[0], at + 4
        end = base
        for k, p, q in parts:
            if k == b"trun":
                offset, ticks, size, key = run_of(data, p, q, tuple(default))
                begin = fits(end if offset is None else base + offset)
                end = fits(begin + int(size.sum()))
                found.setdefault(number, []).append((begin + np.cumsum(size) - size, size, key, ticks))


def read(data: bytes | None) -> list[dict]:
    """The tracks of a container."""
    if not data:
        return [{"status": "no movie"}]
    view = memoryview(data)
    tracks, movie, broken, fragments = [], False, False, False
    extends: dict[int, tuple[int, int, int]] = {}
    found: dict[int, list] = {}
    try:
        at = 0
        for kind, a, b in boxes(view, 0, len(view)):
            if kind == b"moov":
                movie = True
                tracks += [track(view, x, y) for k, x, y in boxes(view, a, b) if k == b"trak"]
                for k, x, y in boxes(view, a, b):
                    if k == b"mvex":
                        fragments = True
                        for inner, p, _ in boxes(view, x, y):
                            if inner == b"trex":
                                number, _, *default = struct.unpack_from(">5I", view, p + 4)
                                extends[number] = tuple(default)
            elif kind == b"moof":
                fragments = True
                fragment(view, at, a, b, extends, found)
            at = b
    except (ValueError, struct.error, StopIteration):
        broken = True
    if fragments:
        tracks = [extended(t, found.get(t.get("track"), []), broken) if t["status"] == "ok" else t for t in tracks]
    return tracks or [{"status": "fragmented" if fragments and not broken else "broken" if broken else "ok" if movie else "no movie"}]


def extended(t: dict, runs: list, broken: bool) -> dict:
    """A track with the samples of its fragments."""
    if broken:
        return t | {"status": "broken"}
    if not runs:
        return t | {"status": "fragmented"}
    offset, size, key, ticks = (np.concatenate([r[k] for r in runs]) for k in range(4))
    at = np.flatnonzero(key)
    out = t | {"n_samples": t["n_samples"] + len(size)}
    for name, more in (("keyframes", at + 1 + t["n_samples"]), ("offsets", offset[at]), ("sizes", size[at])):
        out[name] = np.concatenate([t[name], more])
    if t["ticks"] is not None:
        out["duration_ms"] = (t["ticks"] + int(ticks.sum())) * 1000 // t["scale"]
    return out


SCHEMA = "media_id bigint, track bigint, kind string, codec string, width int, height int, duration_ms bigint, n_samples bigint, keyframes array<bigint>, key_offsets array<bigint>, key_sizes array<bigint>, status string"


def media_columns(media: DataFrame, media_id: str = "media_id", content: str = "content") -> DataFrame:
    """A row for each track of each container."""
    common.prepare(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = [], []
            for i, data in zip(b.column(0).to_pylist(), b.column(1)):
                found = read(None if not data.is_valid else data.as_buffer())
                ids += [i] * len(found)
                rows += found
            get = lambda k, t: pa.array([r.get(k) for r in rows], t)
            lists = pa.list_(pa.int64())
            yield common.batch(
                media_id=pa.array(ids, pa.int64()), track=get("track", pa.int64()), kind=get("kind", pa.string()), codec=get("codec", pa.string()), width=get("width", pa.int32()), height=get("height", pa.int32()),
                duration_ms=get("duration_ms", pa.int64()), n_samples=get("n_samples", pa.int64()), keyframes=get("keyframes", lists), key_offsets=get("offsets", lists), key_sizes=get("sizes", lists), status=get("status", pa.string()),
            )

    return media.select(F.col(f"`{media_id}`").cast("bigint").alias("media_id"), F.col(f"`{content}`").cast("binary").alias("content")).mapInArrow(common.lean(run), SCHEMA)


def box(kind: bytes, *parts: bytes, large: bool = False) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body if large else struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes) -> bytes:
    return box(kind, b"\0\0\0\0", *parts)


def table(kind: bytes, rows: list[int], width: int = 1, code: str = "I") -> bytes:
    return full(kind, struct.pack(">I", len(rows) // width), struct.pack(f">{len(rows)}{code}", *rows))


SAMPLE_BYTES, PER_CHUNK, KEY_EVERY, DELTA, SCALE = 256, 5, 6, 40, 1000


def write(number: int, payload: bytes) -> bytes:
    """A container with one video track whose samples are pieces of the payload; every fifth number's has them in a fragment."""
    if number % 5 == 4:
        return write_fragmented(number, payload)
    sizes = [len(payload[i : i + SAMPLE_BYTES]) for i in range(0, len(payload), SAMPLE_BYTES)]
    n = len(sizes)
    large = number % 2 == 1
    head = box(b"ftyp", b"isom\0\0\2\0isommp41")
    data = box(b"mdat", payload, large=large)
    start = len(head) + (16 if large else 8)
    chunks = [start + i * SAMPLE_BYTES for i in range(0, n, PER_CHUNK)]
    full_chunks, rest = divmod(n, PER_CHUNK)
    stsc = ([1, PER_CHUNK, 1] if full_chunks else []) + ([full_chunks + 1, rest, 1] if rest else [])
    stbl = box(
        b"stbl", description(number), table(b"stts", [n, DELTA] if n else [], 2), table(b"stsc", stsc, 3),
        full(b"stsz", struct.pack(">II", 0, n), struct.pack(f">{n}I", *sizes)), table(b"co64", chunks, 1, "Q") if large else table(b"stco", chunks), table(b"stss", list(range(1, n + 1, KEY_EVERY))),
    )
    return head + data + movie(stbl, n * DELTA)


def description(number: int) -> bytes:
    avc = number % 3 != 2
    config = box(b"avcC", bytes([1, 100, 0, 31, 255, 225, 0])) if avc else box(b"hvcC", bytes([1, 1, 96, 0, 0, 0, 0, 0, 0, 0, 0, 0, 93]) + bytes(10))
    return full(b"stsd", struct.pack(">I", 1), box(b"avc1" if avc else b"hvc1", bytes(24), struct.pack(">HH", 1280, 720), bytes(50), config))


def movie(stbl: bytes, length: int, *more: bytes) -> bytes:
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, SCALE, length, 0, 0)), full(b"hdlr", b"\0\0\0\0vide", bytes(13)), box(b"minf", full(b"vmhd", bytes(8)), stbl))
    tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, length), bytes(60))
    return box(b"moov", full(b"mvhd", struct.pack(">IIII", 0, 0, SCALE, length), bytes(80)), box(b"trak", tkhd, mdia), *more)


def write_fragmented(number: int, payload: bytes) -> bytes:
    """The same with the samples in one fragment: durations by default, sizes and flags for each sample."""
    sizes = [len(payload[i : i + SAMPLE_BYTES]) for i in range(0, len(payload), SAMPLE_BYTES)]
    none = box(b"stbl", description(number), table(b"stts", []), table(b"stsc", []), full(b"stsz", struct.pack(">II", 0, 0)), table(b"stco", []))
    head = box(b"ftyp", b"iso5\0\0\2\0iso5mp41") + movie(none, 0, box(b"mvex", full(b"trex", struct.pack(">5I", 1, 1, DELTA, 0, 0x10000))))
    rows = [x for k, s in enumerate(sizes) for x in (s, 0 if k % KEY_EVERY == 0 else 0x10000)]
    offset = 8 + 16 + 8 + 16 + 20 + 4 * len(rows) + 8
    run = box(b"trun", struct.pack(">IIi", 0x601, len(sizes), offset), struct.pack(f">{len(rows)}I", *rows))
    moof = box(b"moof", full(b"mfhd", struct.pack(">I", 1)), box(b"traf", box(b"tfhd", struct.pack(">II", 0x20000, 1)), run))
    return head + moof + box(b"mdat", payload)


def from_pages(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(media_id, content): a container for each page, whose payload is the page."""
    common.prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out, size = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(i)
                out.append(write(i or 0, (t.as_py() or "").encode()))
                size += len(out[-1])
                if size > BYTES_AT_ONCE:
                    yield common.batch(media_id=pa.array(ids, pa.int64()), content=pa.array(out, pa.binary()))
                    ids, out, size = [], [], 0
            if ids:
                yield common.batch(media_id=pa.array(ids, pa.int64()), content=pa.array(out, pa.binary()))

    return common.reduced_scan(pages, page_id=page_id, html=html).mapInArrow(common.lean(run), "media_id bigint, content binary")


ORACLE_SQL = r"""
with size as (
  select page_id, octet_length(encode(coalesce(html, ''))) as n, page_id % 2 = 1 as large, page_id % 3 <> 2 as avc, page_id % 5 = 4 as fragmented from pages
), t as (
  select *, (n + 255) // 256 as samples, case when fragmented then case when avc then 650 else 666 end + 8 * ((n + 255) // 256) when large then 40 else 32 end as start, range(0, (n + 255) // 256, 6) as keys from size
)
select page_id as media_id, cast(1 as bigint) as track, 'vide' as kind, case when avc then 'avc1.64001f' else 'hvc1.1.L93' end as codec,
       cast(1280 as integer) as width, cast(720 as integer) as height, cast(samples * 40 as bigint) as duration_ms, cast(samples as bigint) as n_samples,
       list_transform(keys, lambda k: cast(k + 1 as bigint)) as keyframes,
       list_transform(keys, lambda k: cast(start + k * 256 as bigint)) as key_offsets,
       list_transform(keys, lambda k: cast(least(256, n - k * 256) as bigint)) as key_sizes, 'ok' as status
from t
"""

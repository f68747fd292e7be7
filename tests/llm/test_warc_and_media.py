import gzip
import random
import struct

import pytest

from tarnflow.llm import isomedia, warc


def test_dechunk():
    assert warc.dechunk(b"4;ext=1\r\nWiki\r\n5\r\npedia\r\n0\r\nTrailer: x\r\n\r\n") == b"Wikipedia"
    assert warc.dechunk(b"0\r\n\r\n") == b""
    for bad in (b"", b"zz\r\n", b"5\r\nabc", b"3\r\nabcd\r\n0\r\n\r\n", b"4\r\nWiki\r\n"):
        assert warc.dechunk(bad) is None


def records(bodies, seed=0, **kw):
    out = [r for i, b in enumerate(bodies) for r in warc.write_record(f"<urn:page:{i}>", f"http://x/{i}", b, **kw)]
    random.Random(seed).shuffle(out)
    return out


def found(spark, rows):
    df = spark.createDataFrame([(bytearray(x) if x is not None else None,) for x in rows], "record binary").repartition(3)
    return warc.reassemble(df).collect()


def test_reassembly_round_trip(spark):
    r = random.Random(5)
    bodies = [r.randbytes(n) for n in (0, 1, 999, 1000, 1001, 2048, 20_000, 100_003)]
    rows = records(bodies, chunk=300, segment=700)
    rows += rows[:7]  # delivered twice
    got = {x["record_id"]: x for x in found(spark, rows)}
    assert len(got) == len(bodies)
    for i, b in enumerate(bodies):
        x = got[f"<urn:page:{i}>"]
        assert x["status"] == "ok" and bytes(x["payload"]) == b and x["url"] == f"http://x/{i}" and x["http_status"] == 200


def test_what_is_wrong_is_said(spark):
    whole = warc.write_record("<urn:page:1>", "u", b"x" * 3000, segment=500)
    missing = whole[:2] + whole[3:]
    cut = [whole[0]] + [w.replace(b"<urn:page:1>", b"<urn:page:2>") for w in ()]
    two = [w.replace(b"urn:page:1", b"urn:page:2") for w in whole]
    clash = [*two, two[1].replace(b"xxxx", b"yyyy", 1)]
    three = [w.replace(b"urn:page:1", b"urn:page:3") for w in whole]
    last = three[-1].split(b"Total-Length: ")
    length = [*three[:-1], last[0] + b"Total-Length: 9" + last[1]]
    frame = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz"
    broken = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:4>\r\nContent-Length: %d\r\n\r\n%s" % (len(frame), frame)
    plain = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:5>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [*missing, *clash, *length, broken, plain, None, b"", b"junk", *cut[1:]]
    got = {}
    for x in found(spark, rows):
        got.setdefault(x["record_id"], []).append((x["status"], x["payload"] and bytes(x["payload"])))
    assert got == {"<urn:page:1>": [("missing", None)], "<urn:page:2>": [("conflict", None)], "<urn:page:3>": [("length", None)], "<urn:page:4>": [("framing", None)], "<urn:page:5>": [("ok", b"abc")], None: [("malformed", None)] * 3}


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_media_round_trip(n):
    for number in range(6):
        payload = random.Random(n).randbytes(n)
        data = isomedia.write(number, payload)
        (t,) = isomedia.read(data)
        assert t["status"] == "ok" and t["n_samples"] == -(-n // 256) and t["duration_ms"] == 40 * t["n_samples"]
        for k, o, s in zip(t["keyframes"], t["offsets"], t["sizes"]):
            assert data[o : o + s] == payload[(k - 1) * 256 : (k - 1) * 256 + s]


def test_media_hazards():
    data = isomedia.write(1, b"z" * 3000)
    assert isomedia.read(None) == isomedia.read(b"") == [{"status": "no movie"}]
    assert isomedia.read(b"garbage")[0]["status"] in ("no movie", "broken")
    for at in range(0, len(data), 7):  # cut or changed anywhere: a status, never an exception
        assert all("status" in t for t in isomedia.read(data[:at]))
        flipped = bytearray(data)
        flipped[at] ^= 0xFF
        assert all("status" in t for t in isomedia.read(bytes(flipped)))


def test_compact_sizes_and_sound():
    b, f = isomedia.box, isomedia.full
    sizes = struct.pack(">I", 4) and bytes([0x12, 0x30])
    stbl = b(b"stbl", f(b"stsd", struct.pack(">I", 1), b(b"mp4a", bytes(28))), isomedia.table(b"stts", [3, 10], 2), isomedia.table(b"stsc", [1, 3, 1], 3), f(b"stz2", bytes([0, 0, 0, 4]), struct.pack(">I", 3), sizes), isomedia.table(b"stco", [100]))
    trak = b(b"trak", f(b"tkhd", struct.pack(">IIIII", 0, 0, 7, 0, 0), bytes(60)), b(b"mdia", f(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 0, 0, 0)), f(b"hdlr", b"\0\0\0\0soun", bytes(13)), b(b"minf", stbl)))
    (t,) = isomedia.read(b(b"moov", trak))
    assert (t["track"], t["kind"], t["codec"], t["duration_ms"], list(t["keyframes"]), list(t["offsets"]), list(t["sizes"])) == (7, "soun", "mp4a", 30, [1, 2, 3], [100, 101, 103], [1, 2, 3])


def test_odd_numbers_are_malformed(spark):
    head = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\n{}\r\n\r\nabc"
    odd = ["Content-Length: 3\r\nWARC-Segment-Number: 99999999999", "Content-Length: 3\r\nWARC-Segment-Number: 1\r\nWARC-Segment-Total-Length: 99999999999999999999", "Content-Length: -3", "Content-Length: 1_0", "Content-Length: " + "9" * 6000, "Content-Length: 3\r\nWARC-Segment-Number: 0"]
    got = found(spark, [head.format(x).encode() for x in odd])
    assert [(x["record_id"], x["status"]) for x in got] == [(None, "malformed")] * len(odd)
    http = "HTTP/1.1 99999999999 OK\r\n\r\nbody"
    (x,) = found(spark, [f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: {len(http)}\r\n\r\n{http}".encode()])
    assert (x["status"], x["http_status"], bytes(x["payload"])) == ("ok", None, b"body")


def test_files(spark, tmp_path):
    bodies = [random.Random(i).randbytes(5000 * i) for i in range(4)]
    rows = records(bodies)
    (tmp_path / "a.warc").write_bytes(b"".join(rows[:5]) + b"junk\r\nmore junk\n" + b"".join(rows[5:9]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in rows[9:]))
    (tmp_path / "c.warc").write_bytes(b"")
    (tmp_path / "d.warc.gz").write_bytes(gzip.compress(rows[0])[:40])
    got = warc.reassemble(warc.from_files(spark, str(tmp_path))).collect()
    assert {x["record_id"]: bytes(x["payload"]) for x in got if x["status"] == "ok"} == {f"<urn:page:{i}>": b for i, b in enumerate(bodies)}
    assert [x["status"] for x in got if x["status"] != "ok"] == ["malformed"] * 2  # junk, and what is left of a cut member


def columns(spark, rows):
    return isomedia.media_columns(spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(rows)], "media_id bigint, content binary")).collect()


def test_columns_of_hostile_media(spark):
    """Flipped, cut, nested and oversized input gives rows, never an exception, and allocates nothing for what isn't there."""
    b, f = isomedia.box, isomedia.full
    rows = []
    for number in (1, 4, 5):
        data = isomedia.write(number, b"z" * 3000)
        for at in range(0, len(data), 11):
            rows += [data[:at], data[:at] + bytes([data[at] ^ 0xFF]) + data[at + 1 :], data[:at] + b"\xff" * 4 + data[at + 4 :]]
    nested = b""
    for _ in range(20_000):
        nested = b(b"moov", nested)
    rows += [nested, b(b"moov", b(b"trak", nested))]

    def one(sizes, stsc, stts=(), number=7, wide=False, length=0, scale=1000):
        stbl = b(b"stbl", f(b"stsd", struct.pack(">I", 1), b(b"mp4a", bytes(28))), isomedia.table(b"stts", list(stts), 2), isomedia.table(b"stsc", stsc, 3), f(b"stsz", struct.pack(">II", *sizes)), isomedia.table(b"stco", [100]))
        mdhd = box_of(1, struct.pack(">QQIQ", 0, 0, scale, length)) if wide else f(b"mdhd", struct.pack(">IIIIHH", 0, 0, scale, length, 0, 0))
        return b(b"moov", b(b"trak", f(b"tkhd", struct.pack(">IIIII", 0, 0, number, 0, 0), bytes(60)), b(b"mdia", mdhd, f(b"hdlr", b"\0\0\0\0soun", bytes(13)), b(b"minf", stbl))))

    def box_of(version, body):
        return b(b"mdhd", bytes([version, 0, 0, 0]), body, bytes(4))

    huge = 2**31 - 1
    rows += [one((1, huge), [1, huge, 1], [huge, 1]), one((0, huge), [1, huge, 1], [huge, 1]), one((4, 3), [1, 3, 1], [3, 10], number=2**32 - 1), one((4, 3), [1, 3, 1], [3, 10], wide=True, length=2**64 - 2, scale=1)]
    got = {}
    for r in columns(spark, rows):
        got.setdefault(r["media_id"], []).append(r)
    assert set(got) == set(range(len(rows)))
    last = [got[len(rows) - k][0] for k in (4, 3, 2, 1)]
    assert [r["status"] for r in last] == ["broken", "broken", "ok", "broken"] and last[2]["track"] == 2**32 - 1


def test_fragments_are_read():
    b = isomedia.box
    payload = random.Random(3).randbytes(3000)
    data = isomedia.write(4, payload)  # one fragment; a second one follows, with a common size and the first sample a keyframe
    more = random.Random(4).randbytes(400)
    run = b(b"trun", struct.pack(">IIiI", 0x5, 4, 8 + 16 + 8 + 20 + 24 + 8, 0))
    moof = b(b"moof", isomedia.full(b"mfhd", struct.pack(">I", 2)), b(b"traf", b(b"tfhd", struct.pack(">III", 0x20010, 1, 100)), run))
    (t,) = isomedia.read(data + moof + b(b"mdat", more))
    assert (t["status"], t["n_samples"], t["duration_ms"]) == ("ok", 16, 640) and list(t["keyframes"]) == [1, 7, 13]
    at, n = t["offsets"][-1], t["sizes"][-1]
    assert (data + moof + b(b"mdat", more))[at : at + n] == more[:100]
    alone = isomedia.read(data[: data.index(b"moof") - 4])
    assert [x["status"] for x in alone] == ["fragmented"]


def test_fragmented_media_say_so():
    b = isomedia.box
    data = isomedia.write(1, b"z" * 3000)
    assert [t["status"] for t in isomedia.read(data)] == ["ok"]
    assert [t["status"] for t in isomedia.read(data + b(b"moof", b(b"mfhd", bytes(8))))] == ["fragmented"]
    assert isomedia.read(b(b"moov", b(b"mvex"))) == isomedia.read(b(b"moof")) == [{"status": "fragmented"}]

"""Vectorised text kernel shared by the operators of this subpackage.

Everything works on Arrow string buffers: one batch of texts becomes one byte buffer
with offsets, tokens become start/end positions in it, and token and n-gram hashes come
from prefix sums, so that no Python code runs per row or per token.

A *word* is a maximal run of ASCII letters and digits and of non-ASCII characters other
than Latin-1 symbols, general punctuation and CJK punctuation, in lower case.  A null
text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
#: Texts are worked on in slices of about so many bytes, so that temporary arrays stay small.
SLICE_BYTES = 1 << 20

_pow: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _pow.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _pow[base] = have
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    z = x.astype(U64, copy=True)
    z += U64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    z ^= z >> U64(30)
    z *= U64(0xBF58476D1CE4E5B9)
    z ^= z >> U64(27)
    z *= U64(0x94D049BB133111EB)
    z ^= z >> U64(31)
    return z


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES, most: int = 60_000) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, rows, texts) of consecutive slices of about ``limit`` bytes and at most ``most`` rows; a longer text stands alone."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    if not len(col):
        return
    off = offsets(col)
    first = 0
    while first < len(col):
        last = max(first + 1, int(np.searchsorted(off, off[first] + limit, side="right")) - 1)
        last = min(last, first + most, len(col))
        yield first, last - first, col.slice(first, last - first)
        first = last


def offsets(col: pa.Array) -> np.ndarray:
    return np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_string array; the offsets begin at 0."""
    off = offsets(col)
    data = col.buffers()[2]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(off), np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


_CLASS = np.zeros(256, np.uint8)
_CLASS[128:] = 1
_CLASS[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = 1
_CLASS[[*range(ord("0"), ord("9") + 1)]] = 2


def classes(buf: np.ndarray) -> np.ndarray:
    """0 separator, 1 letter, 2 digit, for each byte."""
    cls = _CLASS[buf]
    for lead, wide in ((0xC2, 2), (0xE2, 3), (0xE3, 3)):
        at = np.flatnonzero(buf == lead)
        at = at[at + wide <= len(buf)]
        if len(at):
            second = buf[at + 1]
            if lead == 0xC2:
                at = at[(second != 0xAA) & (second != 0xB5) & (second != 0xBA)]
            elif lead == 0xE2:
                at = at[(second == 0x80) | (second == 0x81)]
            else:
                at = at[second == 0x80]
            for k in range(wide):
                cls[at + k] = 0
    at = np.flatnonzero(buf == 0xC3)
    at = at[at + 2 <= len(buf)]
    if len(at):
        at = at[(buf[at + 1] == 0x97) | (buf[at + 1] == 0xB7)]
        cls[at] = cls[at + 1] = 0
    return cls


class Words:
    """Words of a slice of texts: byte positions ``start`` and ``end``, and where each text's words begin (``first``)."""

    def __init__(self, col: pa.Array, lower: bool = True, split_digits: bool = False):
        self.buf, self.off = raw(pc.utf8_lower(col) if lower else col)
        n = len(self.buf)
        cls = classes(self.buf)
        prev = np.empty(n + 1, np.uint8)
        prev[0] = 0
        prev[1:] = cls
        cut = self.off[:-1][self.off[:-1] < n]
        begins = (cls != 0) & ((cls != prev[:-1]) if split_digits else (prev[:-1] == 0))
        begins[cut] = cls[cut] != 0
        follow = np.empty(n, np.uint8)
        if n:
            follow[:-1] = cls[1:]
            follow[-1] = 0
        ends = (cls != 0) & ((cls != follow) if split_digits else (follow == 0))
        back = cut[cut > 0] - 1
        ends[back] = cls[back] != 0
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.cls = cls

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """Index of each word's text."""
        return np.repeat(np.arange(len(self.off) - 1), self.counts)

    def sums(self) -> np.ndarray:
        n = len(self.buf)
        sums = np.empty(n + 1, U64)
        sums[0] = 0
        np.cumsum((self.buf.astype(U64) + U64(1)) * powers(BASE, n), out=sums[1:])
        return sums

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.start):
            return np.zeros(0, U64)
        return self.spans(self.sums(), self.start, self.end)

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * powers(BASE_INV, len(self.buf) + 1)[start])


GRAM = 0xD6E8FEB86659FD93 | 1


def grams(tokens: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n tokens from each position on (len - n + 1 of them)."""
    m = len(tokens) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    if n <= 4:
        h = tokens[:m].copy()
        for k in range(1, n):
            h *= U64(GRAM)
            h += tokens[k : k + m]
        return mix(h)
    inverse = pow(GRAM, -1, 1 << 64)
    sums = np.empty(len(tokens) + 1, U64)
    sums[0] = 0
    np.cumsum(tokens * powers(GRAM, len(tokens)), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * powers(inverse, m))


def inside(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """True for each of total - n + 1 positions whose n tokens lie in one text; first: where each text begins, and the end."""
    m = max(0, total - n + 1)
    ok = np.ones(m, bool)
    if n > 1:
        marks = np.zeros(total + 1, np.int32)
        inner = np.unique(first[1:-1])
        inner = inner[(inner > 0) & (inner < total)]
        np.add.at(marks, np.maximum(inner - n + 1, 0), 1)
        np.add.at(marks, inner, -1)
        ok = np.cumsum(marks)[:m] == 0
    return ok


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one byte string."""
    head = np.array([len(arrays), *[x for a in arrays for x in (ord(a.dtype.char), len(a))]], np.int64)
    return head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 2 * n, 8).reshape(n, 2)
    at, out = 8 + 16 * n, []
    for char, size in head:
        a = np.frombuffer(data, np.dtype(chr(char)), int(size), at)
        at += a.nbytes
        out.append(a)
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """x (not negative) in the narrowest unsigned type that holds it."""
    most = int(x.max(initial=0))
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1])
    return start, np.diff(np.append(start, len(x)))


def split_buckets(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that groups rows by bucket, and where each bucket begins."""
    order = np.argsort(bucket.astype(np.uint16 if n <= 65536 else np.uint32), kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=n))])

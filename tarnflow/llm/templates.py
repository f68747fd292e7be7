"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders, so that a question that was given other
numbers or names keeps its template.  Windows of ``WINDOW`` template tokens of the benchmark
and of all documents meet in a hash join.  A document is contaminated by an item if windows
cover at least ``COVERAGE`` of the item's windows, or ``PASSAGE`` of its tokens along one
alignment.  Slots must be consistent: along one alignment each value of the item maps to one
value in the document and back.  Pairs of values that break this are in conflict, but for a
value that stays itself; windows that hold such a pair don't count, and a passage of an
alignment that has one must be two windows long.

A number is a run of digits (with inner points and commas).  A unit is a unit word after a
number.  A name is a capitalised word, not all in capitals, that isn't the first of a
sentence; consecutive names are one.  Everything else counts in lower case (ASCII and
Latin-1 letters are folded).  Windows with fewer than ``LITERALS`` words besides
placeholders are too general to match.  An item without any window is matched as a whole: by
its template if that has ``LITERALS`` words, else with its own numbers, names and units too.

Documents are screened with a Bloom filter of fixed size over the benchmark's windows, which
lets all true matches pass; Spark then joins what is left with the windows and broadcasts
them only if its own size estimate allows.

Defined cases: null ids take no part; null and empty texts have no windows; an item of one
template token matches nothing; repeated items and rows give one result per pair of ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, kernel
from .kernel import U64

WINDOW, LITERALS, COVERAGE, PASSAGE = 8, 4, 0.5, 13
BLOOM_BITS = 22
NUMBER, NAME, UNIT = U64(0x4E554D), U64(0x4E414D45), U64(0x554E4954)
UNITS = """percent pct kg g mg lb lbs oz ton tons tonne tonnes km m cm mm mi mile miles meter meters metre metres ft foot feet inch inches yard yards
l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
dollar dollars cent cents euro euros pound pounds usd eur mph kmh kph degrees degree watt watts volt volts joule joules newton newtons hz khz mhz kb mb gb tb
people apples items pieces""".split()


def fold(buf: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters in UTF-8, byte for byte."""
    out = buf.copy()
    upper = (buf >= 65) & (buf <= 90)
    out[upper] += 32
    at = np.flatnonzero(buf[:-1] == 0xC3) + 1 if len(buf) else np.zeros(0, np.int64)
    at = at[(buf[at] >= 0x80) & (buf[at] <= 0x9E) & (buf[at] != 0x97)]
    out[at] += 0x20
    return out


def is_upper(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    ok = (buf[at] >= 65) & (buf[at] <= 90)
    two = (buf[at] == 0xC3) & (at + 1 < len(buf))
    second = buf[np.minimum(at + 1, len(buf) - 1)]
    return ok | (two & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))


_units: list[np.ndarray] = []


def unit_hashes() -> np.ndarray:
    if not _units:
        _units.append(np.sort(kernel.Words(pa.array([" ".join(UNITS)], pa.large_string())).hashes()))
    return _units[0]


class Template:
    """Template tokens of a slice of texts: ``token``, ``value`` (0 for literals), and each text's ``first``."""

    def __init__(self, col: pa.Array):
        w = kernel.Words(col, lower=False, split_digits=True)
        n = len(w.start)
        if not n:
            self.token = self.value = np.zeros(0, U64)
            self.first = w.first
            return
        buf, start, end = w.buf, w.start, w.end
        w.buf = fold(buf)
        sums = w.sums()
        plain = w.spans(sums, start, end)
        leads = np.zeros(n, bool)
        leads[w.first[:-1][w.counts > 0]] = True
        stops = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(np.isin(buf, np.frombuffer(b".!?:;\n\"", np.uint8)), out=stops[1:])
        gap = np.zeros(n, np.int64)
        gap[1:] = start[1:] - end[:-1]
        opens = leads.copy()
        opens[1:] |= stops[start[1:]] > stops[end[:-1]]
        number = w.cls[start] == 2
        last = np.maximum(end - 1, 0)
        # in folded text a capital differs; one at the end too means that the word is in capitals
        capital = is_upper(buf, start)
        tail = np.where((buf[last] & 0xC0) == 0x80, np.maximum(last - 1, 0), last)
        name = capital & ~opens & ~number & ~(is_upper(buf, tail) & (end - start > 1))
        follows = np.zeros(n, bool)
        follows[1:] = ~leads[1:]
        after_number = np.zeros(n, bool)
        after_number[1:] = number[:-1] & follows[1:] & (gap[1:] <= 1)
        unit = after_number & ~number & np.isin(plain, unit_hashes())
        name &= ~unit
        between = buf[np.minimum(np.concatenate([[0], end[:-1]]), len(buf) - 1)]
        joined = np.zeros(n, bool)
        joined[1:] = number[1:] & number[:-1] & (gap[1:] == 1) & ((between[1:] == ord(".")) | (between[1:] == ord(",")))
        joined[1:] |= name[1:] & name[:-1] & (gap[1:] == 1) & (between[1:] == ord(" "))
        joined &= ~leads
        kept = np.flatnonzero(~joined)
        stop = end[np.append(kept[1:], n) - 1]
        whole = w.spans(sums, start[kept], stop)
        self.token = np.where(number[kept], NUMBER, np.where(unit[kept], UNIT, np.where(name[kept], NAME, plain[kept])))
        self.value = np.where(number[kept] | unit[kept] | name[kept], whole, U64(0))
        self.first = np.searchsorted(kept, w.first)

    def windows(self, w: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the windows with enough words."""
        h = kernel.grams(self.token, w)
        if not len(h):
            return np.zeros(0, np.int64), h
        words = np.concatenate([[0], np.cumsum(self.value == 0)])
        p = np.flatnonzero(kernel.inside(self.first, w, len(self.token)) & (words[w:] - words[:-w] >= literals))
        return p, h[p]

    def short(self, w: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
        """Texts of two tokens at least that have no window, and their shapes: twice the length, and 1 if values must be the same."""
        size = np.diff(self.first)
        words = np.concatenate([[0], np.cumsum(self.value == 0)])
        few = words[self.first[1:]] - words[self.first[:-1]] < literals
        none = np.ones(len(size), bool)
        none[np.searchsorted(self.first, self.windows(w, literals)[0], side="right") - 1] = False
        at = np.flatnonzero(none & (size >= 2))
        return at, (2 * size + few)[at]

    def runs(self, shape: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of all runs of tokens as long as a short text of that shape."""
        tokens = np.where(self.value != 0, self.value, self.token) if shape & 1 else self.token
        h = kernel.grams(tokens, shape >> 1)
        p = np.flatnonzero(kernel.inside(self.first, shape >> 1, len(tokens)))
        return p, kernel.mix(h[p], shape)

    def parts(self, w: int, literals: int, shapes: list[int] | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(shape, length, positions, hashes): the windows (shape 0), then runs of each of the shapes; without shapes, the short texts themselves."""
        yield 0, w, *self.windows(w, literals)
        at, own = self.short(w, literals) if shapes is None else (None, None)
        for shape in np.unique(own).tolist() if shapes is None else shapes:
            p, h = self.runs(shape)
            if shapes is None:
                whole = np.isin(p, self.first[at[own == shape]])
                p, h = p[whole], h[whole]
            yield shape, shape >> 1, p, h


SCHEMA = "id bigint, pos int, hash bigint, slots array<bigint>, shape int"


def windows(texts: DataFrame, w: int, literals: int, bloom=None, shapes: list[int] | None = None) -> DataFrame:
    """(id, pos, hash, slots, shape) of each window and short text; with bloom, only those that pass it; with shapes, all runs of these instead of short texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bloom is None else np.unpackbits(np.frombuffer(bloom.value, np.uint8)).astype(bool)
        for b in batches:
            for first, rows, col in kernel.text_slices(b, "text"):
                t = Template(col)
                for shape, size, p, h in t.parts(w, literals, shapes):
                    if bits is not None and len(p):
                        ok = bits[(h & U64((1 << BLOOM_BITS) - 1)).astype(np.int64)]
                        p, h = p[ok], h[ok]
                        ok = bits[(h >> U64(64 - BLOOM_BITS)).astype(np.int64)]
                        p, h = p[ok], h[ok]
                    if not len(p):
                        continue
                    doc = np.searchsorted(t.first, p, side="right") - 1
                    slots = t.value[p[:, None] + np.arange(size)].view(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * size, pa.int32()), pa.array(slots.ravel()))
                    ids = b.column(0).slice(first, rows).take(pa.array(doc))
                    yield common.batch(id=ids, pos=(p - t.first[doc]).astype(np.int32), hash=h.view(np.int64), slots=lists, shape=np.full(len(p), shape, np.int32))

    return texts.mapInArrow(common.lean(run), SCHEMA)


def bloom_of(bench: DataFrame, w: int, literals: int) -> bytes:
    def add(b: pa.RecordBatch, total: np.ndarray) -> None:
        for _, _, col in kernel.text_slices(b, "text"):
            for _, _, _, h in Template(col).parts(w, literals, None):
                total[(h & U64((1 << BLOOM_BITS) - 1)).astype(np.int64)] = 1
                total[(h >> U64(64 - BLOOM_BITS)).astype(np.int64)] = 1

    return np.packbits(common.corpus_counts(bench, ["text"], add, 1 << BLOOM_BITS, only_if=True)).tobytes()


def leaks(docs: DataFrame, bench: DataFrame, w: int = WINDOW, literals: int = LITERALS, coverage: float = COVERAGE, passage: int = PASSAGE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, coverage, n_slots, exact): contaminated documents.  exact: all slots hold the item's own values."""
    spark = common.prepare(docs.sparkSession)
    docs = common.reduced_scan(docs, id=doc_id, text=text).where("id is not null").withColumn("id", F.col("id").cast("bigint"))
    bench = common.reduced_scan(bench, id=item_id, text=item_text).where("id is not null").withColumn("id", F.col("id").cast("bigint"))
    bloom = spark.sparkContext.broadcast(bloom_of(bench, w, literals))
    ours = windows(bench, w, literals).toDF("item_id", "ipos", "hash", "item_slots", "shape").distinct().checkpoint()
    shapes = sorted(r["shape"] for r in ours.where("shape > 0").select("shape").distinct().collect())  # lengths of short items
    ours = ours.drop("shape")
    sizes = ours.groupBy("item_id").agg(F.count_distinct("hash").alias("size"))
    met = windows(docs, w, literals, bloom, shapes).drop("shape").toDF("doc_id", "pos", "hash", "slots").join(ours, "hash").withColumn("shift", F.col("pos") - F.col("ipos")).checkpoint()
    line = ["doc_id", "item_id", "shift"]
    zipped = F.arrays_zip(F.col("item_slots").alias("v"), F.col("slots").alias("d"))
    slots = met.select(*line, F.explode(zipped).alias("z")).select(*line, F.col("z.v").alias("v"), F.col("z.d").alias("d")).where("v <> 0 or d <> 0").distinct()
    forth, back = F.count("*").over(Window.partitionBy(*line, "v")), F.count("*").over(Window.partitionBy(*line, "d"))
    paired = slots.withColumn("forth", forth).withColumn("back", back).withColumn("bad", F.expr("v <> d and (forth > 1 or back > 1)"))
    same = paired.groupBy(*line).agg(F.count_distinct(F.when(~F.col("bad"), F.col("v"))).alias("n_slots"), F.min(F.col("v") == F.col("d")).alias("same"), F.collect_list(F.when(F.col("bad"), F.struct("v", "d"))).alias("bad"))
    clash = F.coalesce(F.size("bad") > 0, F.lit(False))
    judged = met.join(same, line, "left").withColumn("clash", clash).where(~F.col("clash") | ~F.arrays_overlap(zipped, "bad"))
    covered = F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence("ipos", F.col("ipos") + F.size("slots") - 1)))))
    long_ = judged.groupBy(*line).agg(covered.alias("n_tokens"), F.max("clash").alias("any")).where(F.col("n_tokens") >= F.when(F.col("any"), max(passage, 2 * w)).otherwise(passage)).select("doc_id", "item_id", F.lit(True).alias("passage")).distinct()
    pair = judged.groupBy("doc_id", "item_id").agg(F.count_distinct("hash").alias("n_windows"), F.max(F.coalesce("n_slots", F.lit(0))).alias("n_slots"), F.min(F.coalesce("same", F.lit(True))).alias("exact"))
    return pair.join(sizes, "item_id").join(long_, ["doc_id", "item_id"], "left").withColumn("coverage", F.col("n_windows") / F.col("size")).where((F.col("coverage") >= coverage) | F.col("passage")).select("doc_id", "item_id", "n_windows", "coverage", "n_slots", "exact")


def clean(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents without contaminated ones, with all their columns."""
    gone = leaks(docs, bench, doc_id=doc_id, **options).select("doc_id").distinct().checkpoint()
    return common.join_ids(docs, common.sized(gone), "left_anti", doc_id)

"""Sum-of-squares online packing of documents into training windows.

Documents come one after another (by doc_id).  A document of at least ``WINDOW`` tokens
fills whole windows first; its rest, like any shorter document, is one item.  An item of
size s goes to the fill level h, 0 for a new window, for which the sum of the squared
counts N(h)^2 of partially filled windows grows least: moving a window from h to h + s
changes it by 2 (N(h+s) - N(h) + 1), where full windows count nothing.  N is an array
indexed by level, so a placement is one vector operation over the levels in use; ties go
to the fullest level, and the oldest window of a level is taken.

The order is sequential by nature, so the corpus is cut, in the order of arrival, into stretches
(shards) of ``SHARD_TOKENS`` tokens that are packed independently: shard s begins with the first
document before which s times so many tokens have come.  Documents that arrive later never change
the windows of earlier ones, and a shard's state and its share of half-filled windows (at most
WINDOW levels) are the same at any size of the corpus.  The running sum needs no single task:
documents are range-partitioned, and a row for each partition goes over the driver.

A document's length is its number of words and one end mark.  Defined cases: null and empty
texts have length 1 (the mark); null ids are packed first; repeated rows are packed each, one after another;
a text longer than a window is cut, never dropped.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernel

WINDOW, SHARD_TOKENS = 2048, 4_000_000


class Packer:
    """The level array N and the open windows of each level."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[deque[int]] = [deque() for _ in range(window + 1)]
        self.next = 0

    def place(self, size: int) -> list[tuple[int, int, int, int]]:
        """(window, offset in it, offset in the document, tokens) of each piece."""
        pieces, at, w = [], 0, self.window
        while size - at >= w:
            pieces.append((self.next, 0, at, w))
            self.next += 1
            at += w
        s = size - at
        if s:
            # level h -> h + s; level 0 is a new window, and neither it nor a full window counts
            grow = 2 * (self.count[s : w + 1] - self.count[: w - s + 1]) + 2
            grow[[0, -1]] -= 1
            grow[1:][self.count[1 : w - s + 1] == 0] = np.iinfo(np.int64).max
            h = len(grow) - 1 - int(grow[::-1].argmin())
            if h:
                k = self.open[h].popleft()
                self.count[h] -= 1
            else:
                k = self.next
                self.next += 1
            if h + s < w:
                self.count[h + s] += 1
                self.open[h + s].append(k)
            pieces.append((k, h, at, s))
        return pieces


def lengths(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, rows, col in kernel.text_slices(b, "text"):
                yield common.batch(doc_id=b.column(0).slice(first, rows), tokens=kernel.Words(col).counts.astype(np.int64) + 1)

    return docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(common.lean(run), "doc_id bigint, tokens bigint")


def stretches(sized: DataFrame, shard_tokens: int) -> tuple[DataFrame, int]:
    """(doc_id, tokens, shard), and the number of shards: shard is the number of whole shard_tokens that come before the document, by doc_id, then tokens."""
    order = ["doc_id", "tokens", "again"]
    # again parts repeated rows, so that any number of them spreads over partitions
    n = max(1, common.partitions(sized))
    placed = sized.checkpoint().withColumn("again", F.monotonically_increasing_id()).repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()).checkpoint()
    base, rows = 0, []
    for r in sorted(placed.groupBy("part").agg(F.sum("tokens").alias("all")).collect()):
        rows.append((r["part"], base))
        base += r["all"]
    known = dict(rows)  # by partition of the checkpoint, which stays as it is when a task runs again

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for b in batches:
            tokens = b.column(1).to_numpy(zero_copy_only=False)
            if at is None and b.num_rows:
                at = known[b.column(2)[0].as_py()]
            before = np.cumsum(tokens) - tokens + (at or 0)
            at = (at or 0) + int(tokens.sum())
            yield common.batch(doc_id=b.column(0), tokens=b.column(1), shard=(before // shard_tokens).astype(np.int32))

    dealt = placed.sortWithinPartitions(*order).select("doc_id", "tokens", "part").mapInArrow(common.lean(run), "doc_id bigint, tokens bigint, shard int")
    return dealt, 1 + base // shard_tokens


SCHEMA = "doc_id bigint, shard int, window_id bigint, window_offset int, doc_offset bigint, n_tokens int"


def pack(docs: DataFrame, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece of a document: where it lies in which window of which shard."""
    if window < 1 or shard_tokens < 1:
        raise ValueError("window >= 1, shard_tokens >= 1")
    common.prepare(docs.sparkSession)
    dealt, shards = stretches(lengths(docs, doc_id, text), shard_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, packer = None, None
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for i, n, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if k != shard:
                    shard, packer = k, Packer(window)
                for piece in packer.place(n):
                    for column, value in zip(out, (i, k, *piece)):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
            names = ("doc_id", "shard", "window_id", "window_offset", "doc_offset", "n_tokens")
            yield common.batch(**{n: pa.array(c, t) for n, c, t in zip(names, out, kinds)})

    return dealt.repartition(min(shards, 100_000), "shard").sortWithinPartitions("shard", "doc_id", "tokens").mapInArrow(common.lean(run), SCHEMA)

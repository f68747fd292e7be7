"""Repeated passages by compaction of a De Bruijn graph of word k-mers.

The edges of the graph are the k-mers (k consecutive words) that occur more than once, the
nodes are their (k-1)-mers.  A node at which every occurrence is entered by the same edge
and left by the same edge doesn't branch; paths through such nodes compact into one unitig.
Every occurrence of a unitig's first edge goes on through the whole unitig, so its
occurrences have (document, word) coordinates: the first of them (by doc_id, then position)
is the source, the later ones are copies.  As k is the least length of interest, each edge
is itself a repeat of that length, and touching unitigs of a document join to spans.

Only k-mers that may repeat become edges.  Each k-mer has a minimiser, the least hash among
the s-mers in it; equal k-mers have equal minimisers.  So (1) a run of k-mers with the same
minimiser is one row, about one for 18 words, and rows whose minimiser is unique in the
corpus are dropped; (2) texts that still have rows are joined with them, and the nodes of
the remaining k-mers are brought together by hash, where branching is decided; (3) what
comes back are the few coordinates where unitigs begin and end.  All exchanges carry packed
arrays, all documents and all words take part, and nothing is capped.

Defined cases: null ids take no part; null, empty and short texts (fewer than k words) have
no k-mers; identical rows (same id, same text) count once; different texts under one id are
different texts, in the order of a hash; repeats within a text count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, kernel
from .kernel import U64

K, S = 50, 16
POS_BITS = 28
FLUSH = 1_500_000


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values."""
    have, step = x, 1
    while 2 * step <= w:
        have = np.minimum(have[:-step], have[step:])
        step *= 2
    return np.minimum(have[: len(x) - w + 1], have[w - step : w - step + len(x) - w + 1]) if w > step else have


def minimiser_runs(docs: DataFrame, k: int, s: int, n_buckets: int) -> DataFrame:
    """(uid, start, n): runs of k-mers whose minimiser occurs more than once in the corpus."""
    w = k - s + 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            anchor, uid, start, n = (np.concatenate([x[i] for x in waiting]) for i in range(4))
            waiting.clear()
            order, begin = kernel.split_buckets((anchor >> U64(20)).astype(np.int64) % n_buckets, n_buckets)
            return common.packed_batch([(b, kernel.pack(anchor[o], uid[o], start[o], n[o])) for b in range(n_buckets) if len(o := order[begin[b] : begin[b + 1]])])

        for b in batches:
            for first, rows, col in kernel.text_slices(b, "text"):
                words = kernel.Words(col)
                tokens = words.hashes()
                if len(tokens) < k:
                    continue
                small = kernel.grams(tokens, s)
                keys = (small >> U64(POS_BITS) << U64(POS_BITS)) | np.arange(len(small), dtype=U64)
                at = (sliding_min(keys, w) & U64((1 << POS_BITS) - 1)).astype(np.int64)
                ok = np.flatnonzero(kernel.inside(words.first, k, len(tokens)))
                if not len(ok):
                    continue
                begin, n = kernel.runs(at[ok])
                i = ok[begin]
                doc = np.searchsorted(words.first, i, side="right") - 1
                uid = b.column(0).slice(first, rows).to_numpy(zero_copy_only=False).astype(np.int64)
                waiting.append((small[at[i]], uid[doc], (i - words.first[doc]).astype(np.uint32), n.astype(np.uint32)))
                held += len(i)
                if held >= FLUSH:
                    yield flush()
                    held = 0
        if waiting:
            yield flush()

    def repeated(payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [kernel.unpack(p) for p in payloads]
        anchor, uid, start, n = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = np.lexsort((start, uid, anchor))
        anchor, uid, start, n = anchor[order], uid[order], start[order], n[order]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (uid[1:] != uid[:-1]) | (start[1:] != start[:-1])  # identical rows count once
        anchor, uid, start, n = anchor[new], uid[new], start[new], n[new]
        _, size = kernel.runs(anchor)
        many = np.repeat(size > 1, size)
        if many.any():
            # one row for each text: what it has in this bucket
            uid, start, n = uid[many], start[many], n[many]
            order = np.argsort(uid, kind="stable")
            uid, start, n = uid[order], start[order], n[order]
            at, size = kernel.runs(uid)
            both = (start.astype(np.int64) << 31) | n.astype(np.int64)
            yield common.batch(uid=uid[at], runs=pa.ListArray.from_arrays(pa.array(np.append(at, len(uid)).astype(np.int32)), pa.array(both)))

    packed = docs.select("uid", "text").mapInArrow(common.lean(find), common.PACKED)
    return common.exchange(packed, n_buckets, repeated, "uid bigint, runs array<bigint>")


def events(texts: DataFrame, k: int, n_buckets: int) -> DataFrame:
    """Where unitigs begin and end: (uid, doc_id, pos, first_edge, last_edge).

    texts: (uid, doc_id, text, runs).  first_edge: an edge of a unitig begins at word pos, last_edge: one ended before.
    """

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            node, before, after, ref, pos = (np.concatenate([x[i] for x in waiting]) for i in range(5))
            uid, ids = (np.concatenate([x[i] for x in waiting]) for i in (5, 6))
            base = np.cumsum([0] + [len(x[5]) for x in waiting[:-1]])
            ref = ref + np.repeat(base, [len(x[3]) for x in waiting])
            waiting.clear()
            order, begin = kernel.split_buckets((node >> U64(20)).astype(np.int64) % n_buckets, n_buckets)
            rows = []
            for b in range(n_buckets):
                o = order[begin[b] : begin[b + 1]]
                if len(o):
                    who, own = np.unique(ref[o], return_inverse=True)
                    rows.append((b, kernel.pack(node[o], before[o], after[o], own.astype(np.uint32 if len(who) > 65536 else np.uint16), pos[o], uid[who], ids[who])))
            return common.packed_batch(rows)

        for b in batches:
            at = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            lists = at["runs"]
            values, where = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(zero_copy_only=False)
            for first, rows, col in kernel.text_slices(b, "text"):
                words = kernel.Words(col)
                tokens = words.hashes()
                if len(tokens) < k:
                    continue
                lo, hi = where[first], where[first + rows]
                base = np.repeat(words.first[:-1], np.diff(where[first : first + rows + 1]))
                start, n = base + (values[lo:hi] >> 31), values[lo:hi] & 0x7FFFFFFF
                mark = np.zeros(len(tokens) + 1, np.int64)
                start_in = np.minimum(start, len(tokens))
                np.add.at(mark, start_in, 1)
                np.add.at(mark, np.minimum(start + n, len(tokens)), -1)
                edge = np.zeros(len(tokens) + 1, bool)
                edge[: len(tokens) - k + 1] = (np.cumsum(mark)[: len(tokens) - k + 1] > 0) & kernel.inside(words.first, k, len(tokens))
                entered = np.zeros(len(tokens) + 1, bool)
                entered[1:] = edge[:-1]
                p = np.flatnonzero(edge | entered)
                if not len(p):
                    continue
                before = np.where(entered[p], (tokens[p - 1] >> U64(32)).astype(np.uint32) | np.uint32(1), np.uint32(0))
                after = np.where(edge[p], (tokens[np.minimum(p + k - 1, len(tokens) - 1)] >> U64(32)).astype(np.uint32) | np.uint32(1), np.uint32(0))
                doc = np.searchsorted(words.first, p, side="right") - 1
                # a node reached by an edge lies in the edge's text, even where it begins at that text's last k-1 words
                uid = at["uid"].slice(first, rows).to_numpy(zero_copy_only=False).astype(np.int64)
                ids = at["doc_id"].slice(first, rows).to_numpy(zero_copy_only=False).astype(np.int64)
                waiting.append((kernel.grams(tokens, k - 1)[p], before, after, doc, (p - words.first[doc]).astype(np.uint32), uid, ids))
                held += len(p)
                if held >= FLUSH:
                    yield flush()
                    held = 0
        if waiting:
            yield flush()

    def branching(payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts, base = [], 0
        for data in payloads:
            node, before, after, ref, pos, uid, ids = kernel.unpack(data)
            parts.append((node, before, after, ref.astype(np.int64) + base, pos, uid, ids))
            base += len(uid)
        node, before, after, ref, pos, uid, ids = (np.concatenate([x[i] for x in parts]) for i in range(7))

        def share(x: np.ndarray, unique: np.ndarray) -> np.ndarray:
            """How many occurrences have the same node and x."""
            order = np.lexsort((x, group))
            g, y, u = group[order], x[order], unique[order]
            new = np.ones(len(y), bool)
            new[1:] = (g[1:] != g[:-1]) | (y[1:] != y[:-1])
            at = np.flatnonzero(new)
            out = np.empty(len(y), np.int64)
            out[order] = np.repeat(np.add.reduceat(u.astype(np.int64), at), np.diff(np.append(at, len(y))))
            return out

        order = np.argsort(node, kind="stable")
        node, before, after, ref, pos = node[order], before[order], after[order], ref[order], pos[order]
        at, size = kernel.runs(node)
        many = np.repeat(size > 1, size)
        node, before, after, ref, pos = node[many], before[many], after[many], ref[many], pos[many]
        if not len(node):
            return
        at, size = kernel.runs(node)
        group = np.repeat(np.arange(len(at)), size)
        # identical rows give the same coordinates twice: count them once
        once = np.ones(len(node), bool)
        owner = uid[ref]
        order = np.lexsort((pos, owner, group))
        once[order[1:]] = (group[order][1:] != group[order][:-1]) | (owner[order][1:] != owner[order][:-1]) | (pos[order][1:] != pos[order][:-1])
        total = np.repeat(np.add.reduceat(once.astype(np.int64), at), size)
        same_in, same_out = share(before, once), share(after, once)
        rep_in, rep_out = (before != 0) & (same_in > 1), (after != 0) & (same_out > 1)
        through = rep_in & rep_out & (same_in == total) & (same_out == total)
        e = np.flatnonzero(once & ~through & (rep_in | rep_out))
        if len(e):
            first = kernel.mix(node[e] * U64(kernel.GRAM) + after[e], 3).view(np.int64)
            last = kernel.mix(node[e] * U64(kernel.GRAM) + before[e], 5).view(np.int64)
            yield common.batch(uid=owner[e], doc_id=ids[ref[e]], pos=pos[e].astype(np.int64), first_edge=pa.array(first, mask=~rep_out[e]), last_edge=pa.array(last, mask=~rep_in[e]))

    packed = texts.select("uid", "doc_id", "text", "runs").mapInArrow(common.lean(nodes), common.PACKED)
    return common.exchange(packed, n_buckets, branching, "uid bigint, doc_id bigint, pos bigint, first_edge bigint, last_edge bigint")


def unitigs(docs: DataFrame, k: int = K, s: int = S, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Occurrences of unitigs: (uid, doc_id, start, n_edges, first_edge, last_edge)."""
    if not 1 <= s < k:
        raise ValueError("1 <= s < k")
    common.prepare(docs.sparkSession)
    docs = common.reduced_scan(docs, doc_id=doc_id, text=text).where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    docs = docs.withColumn("uid", F.xxhash64("doc_id", "text"))
    n_buckets = common.buckets(docs, 2)
    runs = minimiser_runs(docs, k, s, n_buckets).groupBy("uid").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    texts = docs.join(runs, "uid")
    order = Window.partitionBy("uid").orderBy("pos")
    found = events(texts, k, n_buckets).withColumn("end", F.lead("pos").over(order)).withColumn("end_edge", F.lead("last_edge").over(order))
    return found.where("first_edge is not null and end_edge is not null").select("uid", "doc_id", F.col("pos").alias("start"), (F.col("end") - F.col("pos")).alias("n_edges"), "first_edge", F.col("end_edge").alias("last_edge"))


def repeated_spans(docs: DataFrame, k: int = K, s: int = S, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Maximal repeated spans: (doc_id, start_word, n_words, is_copy, source_doc_ids).

    is_copy: all k-mers of the span occur earlier (smaller doc_id, or before in the same text); otherwise the span
    holds their first occurrences, which stay.  source_doc_ids: the documents of those first occurrences, sorted.
    """
    at = unitigs(docs, k, s, doc_id, text).checkpoint()
    which = ["first_edge", "n_edges", "last_edge"]
    source = at.groupBy(which).agg(F.min(F.struct("doc_id", "uid", "start")).alias("source"), F.count("*").alias("copies")).where("copies > 1")
    known = at.join(source, which).select("uid", "doc_id", "start", "n_edges", "source", (F.struct("doc_id", "uid", "start") != F.col("source")).alias("is_copy"))
    order = Window.partitionBy("uid").orderBy("start")
    touch = (F.lag(F.col("start") + F.col("n_edges")).over(order) == F.col("start")) & (F.lag("is_copy").over(order) == F.col("is_copy"))
    island = known.withColumn("new", F.when(touch, 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    spans = island.groupBy("uid", "doc_id", "island", "is_copy").agg(
        F.min("start").alias("start_word"), (F.sum("n_edges") + (k - 1)).alias("n_words"), F.array_sort(F.collect_set("source.doc_id")).alias("source_doc_ids")
    )
    return spans.select("doc_id", "start_word", "n_words", "is_copy", "source_doc_ids")


ORACLE_SQL = r"""
with words as (
  select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents
), mers as (
  select doc_id, i, array_to_string(w[i + 1 : i + 50], ' ') as mer
  from (select doc_id, w, unnest(range(0, greatest(len(w) - 49, 0))) as i from words)
), hit as (
  select doc_id, i, first_value(doc_id) over m as source, first_value(i) over m as source_i, count(*) over (partition by mer) as n
  from mers window m as (partition by mer order by doc_id, i)
), kind as (
  select doc_id, i, source, (doc_id <> source or i <> source_i) as is_copy from hit where n > 1
), edge as (
  select *, case when lag(i) over o = i - 1 and lag(is_copy) over o = is_copy then 0 else 1 end as new
  from kind window o as (partition by doc_id order by i)
), island as (
  select *, sum(new) over (partition by doc_id order by i) as island from edge
)
select doc_id, cast(min(i) as bigint) as start_word, cast(count(*) + 49 as bigint) as n_words, is_copy,
       list_sort(list(distinct source)) as source_doc_ids
from island group by doc_id, island, is_copy
"""

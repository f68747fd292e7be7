"""N-gram Jaccard join with several global token orders.

Two documents are linked when the Jaccard similarity of their sets of word n-grams is at
least ``threshold``; the result has each document's number of links and its connected
group (``links``), or the groups alone (``groups``).  Any two such sets share at least
c tokens among the first ``n - ceil(threshold * n) + c`` tokens of each, *whatever* the
global order of the tokens is.  So a pair is a candidate only if it shares c prefix tokens
under every one of several orders; only pairs in that intersection are verified against the
full sets.  c is 8, less for sets too small for it.
All orders begin with the tokens that few documents have: document frequencies of all
tokens are counted over the whole corpus in a table of fixed size, indexed by hash (any
function of the token is a valid order, so collisions cost nothing but sharpness), and the
orders differ in how they permute tokens of the same frequency class.

Groups of thousands of copies have millions of pairs, which nobody needs: documents with
equal sets collapse before the join, and documents that share a pair of min-hashes are compared
first, against one leader per pair.  A posting list then yields only pairs of documents that
these comparisons don't connect yet; a pair left out lies in one group already.
``groups`` verifies both kinds of pairs against the full sets.  ``links`` only drops pairs whose
parity bits prove that they are no link (``maybe``); what is left connects documents to clusters, and
every link lies in one of them.  Each set travels to its cluster once (in a large one: once per block), where all
pairs are compared with the full sets and copies count by their number; no link is left out.
There is no cap on partners, candidates or lengths.

Defined cases: null ids take no part; a null or empty text, or one without words, has no
n-grams and is in no group; a text of fewer than n words has one token, its words; rows
that repeat an id count as one document with several texts, linked if any of them is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernel
from .kernel import U64

N, THRESHOLD, ORDERS, OVERLAP = 3, 0.6, 2, 8
#: Tokens are 42-bit hashes: document index, frequency class and token fit one sortable word.
BITS = 42
MASK = (1 << BITS) - 1
SLOTS_BITS = 20
ODD = [0x2545F4914F6CDD1D & MASK | 1, 0x369DEA0F31A53F85 & MASK | 1, 0x1B873593CC9E2D51 & MASK | 1, 0x27D4EB2F165667C5 & MASK | 1]
SIGNATURES = 4
PAIRS_AT_ONCE = 1_000_000
#: Clusters are cut into blocks of about so many bytes of tokens and so many documents; each pair of blocks is compared in one place.
BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 1024
#: Tokens that at most so many sets hold are counted by pairs of sets, others by a product of matrices.
FEW_SETS = 32


def token_sets(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct tokens of each text, one after another, each with its text's index above the token's bits; and sizes."""
    w = kernel.Words(col)
    tokens, counts = w.hashes(), w.counts
    hashes, ok = kernel.grams(tokens, n), kernel.inside(w.first, n, len(tokens))
    doc = w.doc()
    parts = [(doc[: len(hashes)][ok].astype(U64) << U64(BITS)) | (hashes[ok] >> U64(64 - BITS))] if len(hashes) else []
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        h = np.zeros(len(short), U64)
        for k in range(n - 1):
            has = counts[short] > k
            h[has] = kernel.mix(h[has] * U64(kernel.GRAM) + tokens[w.first[short[has]] + k], 7)
        parts.append((short.astype(U64) << U64(BITS)) | (h >> U64(64 - BITS)))
    keys = np.unique(np.concatenate(parts)) if parts else np.zeros(0, U64)
    return keys, np.bincount((keys >> U64(BITS)).astype(np.int64), minlength=len(counts))


def needed(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """How many prefix tokens a set of this size must share: OVERLAP, less for small sets."""
    return np.minimum(OVERLAP, np.maximum(1, np.floor(threshold * sizes / 2).astype(np.int64)))


def prefix_size(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """A set's prefix leaves out so few tokens that similar sets share at least ``needed`` (of either) in their prefixes."""
    return np.where(sizes > 0, sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + needed(sizes, threshold), 0)


def frequency_classes(docs: DataFrame, n: int) -> bytes:
    """A byte per slot: the class (0 rarest) of the number of documents with tokens that hash there.  Its size is fixed."""
    size = 1 << SLOTS_BITS

    def count(b: pa.RecordBatch, total: np.ndarray) -> None:
        for _, _, col in kernel.text_slices(b, "text"):
            keys, _ = token_sets(col, n)
            total += np.bincount((keys & U64(size - 1)).astype(np.int64), minlength=size)

    total = common.corpus_counts(docs, ["text"], count, size)
    rank = np.minimum(63, np.floor(4 * np.log2(np.maximum(total, 1) / max(1.0, float(np.mean(total)))) + 24)).clip(0)
    return rank.astype(np.uint8).tobytes()


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, size, whole, keys): whole is a hash of the whole set, keys are pairs of min-hashes under independent permutations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, rows, col in kernel.text_slices(b, "text"):
                keys, sizes = token_sets(col, n)
                has = np.flatnonzero(sizes)
                if not len(has):
                    continue
                tokens = keys & U64(MASK)
                start = (np.cumsum(sizes) - sizes)[has]
                whole = np.add.reduceat(kernel.mix(tokens, 11), start)
                pair = [[np.minimum.reduceat(kernel.mix(tokens, 20 + 2 * k + j), start) for j in range(2)] for k in range(SIGNATURES)]
                least = np.stack([kernel.mix(x) + y for x, y in pair], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1) * SIGNATURES, pa.int32()), pa.array(least.ravel().view(np.int64)))
                yield common.batch(doc_id=b.column(0).slice(first, rows).take(pa.array(has)), size=sizes[has].astype(np.int64), whole=whole.view(np.int64), keys=lists)

    return docs.mapInArrow(common.lean(run), "doc_id bigint, size bigint, whole bigint, keys array<bigint>")


def set_bytes(keys: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Each text's tokens, six bytes a token."""
    tokens = keys & U64(MASK)
    low, high = tokens.astype(np.uint32), (tokens >> U64(32)).astype(np.uint16)
    ends = np.cumsum(sizes)
    return [low[e - s : e].tobytes() + high[e - s : e].tobytes() for s, e in zip(sizes, ends)]


def set_tokens(x: bytes, at: int = 0) -> np.ndarray:
    m = (len(x) - at) // 6
    return np.frombuffer(x, np.uint32, m, at).astype(np.int64) | (np.frombuffer(x, np.uint16, m, at + 4 * m).astype(np.int64) << 32)


def parity_bits(keys: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """For each text's set whether an odd number of tokens hash to each of 2**k bits, twice as many as tokens at least.

    Two sets differ in at least as many tokens as these differ in bits; half of the bits, each the sum of two, are those of a table half as large.
    """
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64))
    ends = np.cumsum(bits)
    place = (kernel.mix(keys & U64(MASK), 31) & np.repeat(bits - 1, sizes).astype(U64)).astype(np.int64) + np.repeat(ends - bits, sizes)
    packed = np.packbits((np.bincount(place, minlength=int(ends[-1])) & 1).astype(np.uint8), bitorder="little")
    return [packed[(e - b) // 8 : e // 8].tobytes() for b, e in zip(bits, ends)]


def may_link(p: int, x: bytes, q: int, y: bytes, threshold: float) -> bool:
    """False only if sets of sizes p and q with these parity bits are less similar than the threshold."""
    if min(p, q) < threshold * max(p, q) - 1e-6:
        return False
    if len(x) < len(y):
        x, y = y, x
    a, b, width = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * len(x)
    while width > 8 * len(y):
        width //= 2
        a = (a ^ (a >> width)) & ((1 << width) - 1)
    return (p + q - (a ^ b).bit_count()) / 2 >= threshold / (1 + threshold) * (p + q) - 1e-6


def maybe(docs: DataFrame, pairs: DataFrame, n: int, threshold: float) -> DataFrame:
    """The pairs (a, b) but for those that parity bits rule out.  No text or set travels if the ids in pairs fit a broadcast."""
    pairs = pairs.checkpoint()
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().checkpoint()

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, rows, col in kernel.text_slices(b, "text"):
                keys, sizes = token_sets(col, n)
                yield common.batch(doc_id=b.column(0).slice(first, rows), size=sizes.astype(np.int64), bits=pa.array(parity_bits(keys, sizes), pa.binary()))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [i for i, (p, x, q, y) in enumerate(zip(*(b.column(k).to_pylist() for k in range(2, 6)))) if may_link(p, x, q, y, threshold)]
            yield common.batch(a=b.column(0).take(pa.array(keep, pa.int64())), b=b.column(1).take(pa.array(keep, pa.int64())))

    schema = "doc_id bigint, size bigint, bits binary"
    if common.few(ids):
        some = common.join_ids(docs, F.broadcast(ids), "left_semi").mapInArrow(common.lean(bits), schema)
    else:
        some = common.join_ids(docs.mapInArrow(common.lean(bits), schema), ids, "left_semi")
    left = pairs.join(some.toDF("a", "p", "x"), "a")
    both = left.join(some.toDF("b", "q", "y"), "b")
    return both.select("a", "b", "p", "x", "q", "y").mapInArrow(common.lean(check), "a bigint, b bigint").distinct()


def similar(sets: list[np.ndarray], split: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of the sets that reach the threshold; split: 0, or how many first sets are compared with the others only."""
    m, sizes = len(sets), np.array([len(x) for x in sets])
    token, row = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    by = np.argsort(token, kind="stable")
    token, row = token[by], row[by]
    start, length = kernel.runs(token)
    shared = np.zeros(m * m, np.int32)
    for r in np.unique(length[(length > 1) & (length <= FEW_SETS)]):
        who = row[start[length == r][:, None] + np.arange(r)]
        for p in range(r - 1):
            np.add.at(shared, (who[:, p : p + 1] * m + who[:, p + 1 :]).ravel(), 1)
    shared = shared.reshape(m, m)
    many = np.flatnonzero(length > FEW_SETS)
    for k in range(0, len(many), 1024):
        own = many[k : k + 1024]
        has = np.zeros((m, len(own)), np.float32)
        at = np.repeat(start[own] - np.cumsum(length[own]) + length[own], length[own]) + np.arange(int(length[own].sum()))
        has[row[at], np.repeat(np.arange(len(own)), length[own])] = 1
        if split:
            shared[:split, split:] += (has[:split] @ has[split:].T).astype(np.int32)
        else:
            shared += (has @ has.T).astype(np.int32)
    part = shared[:split, split:] if split else shared
    ok = (part > 0) & (part >= threshold * (sizes[: split or m, None] + sizes[None, split:] - part) - 1e-9)
    i, j = np.nonzero(ok if split else np.triu(ok, 1))
    return i, j + split


def least_labels(i: np.ndarray, j: np.ndarray, m: int) -> np.ndarray:
    """The least place that each of m places is connected to by the pairs (i, j)."""
    label = np.arange(m)
    while True:
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            return label


def compared(docs: DataFrame, placed: DataFrame, n: int, threshold: float, n_buckets: int) -> DataFrame:
    """(a, b, others) from all pairs of documents of the same cluster: a's links in one pair of blocks, as the weight of its partners, and the least of the documents that links lead to there.

    placed: (node, weight, label, blocks, block), label naming the cluster, blocks how many it has.  A document may have several rows.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, rows, col in kernel.text_slices(b, "text"):
                keys, sizes = token_sets(col, n)
                head = np.stack([b.column(k).slice(first, rows).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 2, 3, 4, 5)], axis=1)
                out, held = [], 0
                for (node, weight, label, blocks, block), tokens in zip(head.tolist(), set_bytes(keys, sizes)):
                    if not tokens:
                        continue
                    for other in range(blocks):
                        cell = (label, min(block, other), max(block, other))
                        out.append((hash(cell) % n_buckets, np.array([*cell, block, node, weight], np.int64).tobytes() + tokens))
                        held += len(tokens)
                        if held >= BLOCK_BYTES:
                            yield common.packed_batch(out)
                            out, held = [], 0
                if out:
                    yield common.packed_batch(out)

    def cell_links(cell: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        cell.sort(key=lambda c: c[0][3])
        head = np.stack([c[0] for c in cell])
        tokens = [c[1] for c in cell]
        ids, first, of = np.unique(head[:, 4], return_index=True, return_inverse=True)
        weight = head[first, 5]
        across = head[0, 1] != head[0, 2]
        split = int((head[:, 3] == head[0, 1]).sum()) if across else len(cell)
        found = []
        # a block's share is by a hash and an id may have any number of texts, so rows are taken in tiles all the same
        for lo in range(0, split, BLOCK_DOCS):
            upto = min(lo + BLOCK_DOCS, split)
            for at in range(split if across else lo, len(cell), BLOCK_DOCS):
                end = min(at + BLOCK_DOCS, len(cell))
                rows = np.arange(lo, upto) if at == lo else np.concatenate([np.arange(lo, upto), np.arange(at, end)])
                i, j = similar([tokens[r] for r in rows], 0 if at == lo else upto - lo, threshold)
                x, y = of[rows[i]], of[rows[j]]
                found.append((np.minimum(x, y) * len(ids) + np.maximum(x, y))[x != y])
        x, y = np.divmod(np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64), len(ids))
        others = (np.bincount(x, weight[y], len(ids)) + np.bincount(y, weight[x], len(ids))).astype(np.int64)
        label = least_labels(x, y, len(ids))
        some = np.flatnonzero(others)
        return common.batch(a=ids[some], b=ids[label[some]], others=others[some])

    def reduce(payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple[int, ...], list[tuple[np.ndarray, np.ndarray]]] = {}
        for p in dict.fromkeys(payloads):
            head = np.frombuffer(p, np.int64, 6)
            cells.setdefault(tuple(head[:3].tolist()), []).append((head, p))
        payloads.clear()
        while cells:
            yield cell_links([(head, set_tokens(p, 48)) for head, p in cells.popitem()[1]])

    side = common.sized(placed.checkpoint())
    rows = docs.join(side, docs["doc_id"] == side["node"]).select("doc_id", "text", "weight", "label", "blocks", "block")
    return common.exchange(rows.mapInArrow(common.lean(sets), common.PACKED), n_buckets, reduce, "a bigint, b bigint, others bigint")


def verified(docs: DataFrame, pairs: DataFrame, n: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold.  Texts of only the documents in pairs travel."""
    pairs = pairs.checkpoint()
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, rows, col in kernel.text_slices(b, "text"):
                keys, sizes = token_sets(col, n)
                yield common.batch(doc_id=b.column(0).slice(first, rows), tokens=pa.array(set_bytes(keys, sizes), pa.binary()))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.int64))
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                if min(len(x), len(y)) < threshold * max(len(x), len(y)) - 1e-6:
                    continue
                if x == y:
                    keep.append(i)
                    continue
                if last[0] != y:
                    last = (y, set_tokens(y))
                p, q = set_tokens(x), last[1]
                common_ = int(np.isin(p, q, assume_unique=True, kind="sort").sum()) if len(p) > 8 else len(set(p.tolist()) & set(q.tolist()))
                if common_ >= threshold * (len(p) + len(q) - common_) - 1e-9:
                    keep.append(i)
            yield common.batch(a=b.column(0).take(pa.array(keep, pa.int64())), b=b.column(1).take(pa.array(keep, pa.int64())))

    some = common.join_ids(docs, common.sized(ids.checkpoint()), "left_semi").mapInArrow(common.lean(sets), "doc_id bigint, tokens binary")
    left = pairs.join(some.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), "a")
    both = left.join(some.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(common.lean(check), "a bigint, b bigint").distinct()


def candidates(spark: SparkSession, docs: DataFrame, labels: DataFrame, classes: bytes, n: int, threshold: float, orders: int, n_buckets: int) -> DataFrame:
    """Pairs (a, b) that share enough prefix tokens under each order, fit in size, and have different labels.

    docs: (doc_id, text); labels: (node, label) for ids that have one other than themselves.
    """
    shared = spark.sparkContext.broadcast(classes)
    at = common.sized(labels.checkpoint())
    labelled = docs.join(at, docs["doc_id"] == at["node"], "left").select("doc_id", F.coalesce("label", "doc_id").alias("label"), "text")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(shared.value, np.uint8)
        waiting: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            ids, label, size, owner, mask, token = (np.concatenate([w[k] for w in waiting]) for k in range(6))
            base = np.cumsum([0] + [len(w[0]) for w in waiting[:-1]])
            owner = owner + np.repeat(base, [len(w[3]) for w in waiting])
            waiting.clear()
            # documents by id, so that a bucket's ids are small steps
            sort = np.argsort(ids, kind="stable")
            place = np.empty(len(sort), np.int64)
            place[sort] = np.arange(len(sort))
            ids, label, size, owner = ids[sort], label[sort], size[sort], place[owner]
            by = np.argsort(owner, kind="stable")
            owner, mask, token = owner[by], mask[by], token[by]
            bucket = (token * U64(0x9E3779B97F4A7C15) >> U64(40)).astype(np.int64) % n_buckets
            by, begin = kernel.split_buckets(bucket, n_buckets)
            rows = []
            for k in range(n_buckets):
                own = by[begin[k] : begin[k + 1]]
                if len(own):
                    at, many = kernel.runs(owner[own])
                    who = owner[own][at]
                    own_ids = ids[who]
                    other = np.flatnonzero(label[who] != own_ids)
                    # within a bucket 32 bits tell tokens apart: were two to meet, that would only add a pair to verify
                    rows.append((k, kernel.pack(own_ids[:1], kernel.narrow(np.diff(own_ids.view(U64))), kernel.narrow(other), label[who][other], kernel.narrow(size[who]), kernel.narrow(many), mask[own], token[own].astype(np.uint32))))
            return common.packed_batch(rows)

        held = 0
        for b in batches:
            for first, rows, col in kernel.text_slices(b, "text"):
                keys, sizes = token_sets(col, n)
                if not len(keys):
                    continue
                doc, tokens = keys & ~U64(MASK), keys & U64(MASK)
                level = rank[(tokens & U64((1 << SLOTS_BITS) - 1)).astype(np.int64)].astype(U64)
                take = prefix_size(sizes, threshold)
                begin = np.cumsum(sizes) - sizes
                place = np.arange(len(keys)) - np.repeat(begin, sizes)
                chosen = place < np.repeat(take, sizes)
                ids = b.column(0).slice(first, rows).to_numpy(zero_copy_only=False).astype(np.int64)
                label = b.column(1).slice(first, rows).to_numpy(zero_copy_only=False).astype(np.int64)
                mask = np.zeros(len(keys), np.uint8)
                for o in range(orders):
                    mixed = (tokens * U64(ODD[o])) & U64(MASK)
                    # 16 bits of text index, 6 of class, 42 of token: rarest classes first, then this order's permutation
                    by = np.argsort(((doc >> U64(BITS)) << U64(48)) | (level << U64(BITS)) | mixed)
                    mask[by[chosen]] |= np.uint8(1 << o)
                own = np.flatnonzero(mask)
                waiting.append((ids, label, sizes, (doc[own] >> U64(BITS)).astype(np.int64), mask[own], tokens[own]))
                held += len(own)
                if held >= 2_000_000:
                    yield flush()
                    held = 0
        if waiting:
            yield flush()

    def pairs(payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts, base = [], 0
        for p in payloads:
            first, steps, other, labels_, size, many, mask, token = kernel.unpack(p)
            ids = np.concatenate([first, first + np.cumsum(steps.astype(np.int64))])
            label = ids.copy()
            label[other.astype(np.int64)] = labels_
            parts.append((ids, label, size.astype(np.int64), np.repeat(np.arange(len(ids)), many) + base, mask, token))
            base += len(ids)
        ids, label, size, ref, mask, key = (np.concatenate([p[k] for p in parts]) for k in range(6))
        by = np.lexsort((size[ref], key))
        key, ref, mask = key[by], ref[by], mask[by]
        start, length = kernel.runs(key)
        many = length > 1
        inner = np.repeat(many, length)
        key, ref, mask = key[inner], ref[inner], mask[inner]
        start, length = kernel.runs(key)
        if not len(key):
            return
        # how far each member's partners reach: to the end of its list, or to sets too large for it
        end = np.repeat(start + length, length)
        sizes = size[ref]
        place = np.repeat(np.arange(len(start)), length)
        scaled = place.astype(np.float64) * 2.0**33
        reach = np.minimum(end, np.searchsorted(scaled + sizes, scaled + np.floor(sizes / threshold + 1e-9), side="right"))
        n = reach - np.arange(len(ref)) - 1
        who, ids_of, least = label[ref], ids[ref], needed(sizes, threshold)
        # lists of one label have no pairs
        mixed = np.repeat(np.maximum.reduceat(who, start) != np.minimum.reduceat(who, start), length)
        n[~mixed] = 0
        todo = np.flatnonzero(n)
        step = 0
        bounds = np.cumsum(n[todo])
        while step < len(todo):
            upto = max(step + 1, int(np.searchsorted(bounds, (bounds[step - 1] if step else 0) + PAIRS_AT_ONCE, side="right")))
            i = todo[step:upto]
            step = upto
            left = np.repeat(i, n[i])
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n[i]) - n[i], n[i])
            ok = (who[left] != who[right]) & (ids_of[left] != ids_of[right]) & ((mask[left] & mask[right]) > 0)
            left, right = left[ok], right[ok]
            if len(left):
                x, y = ids_of[left], ids_of[right]
                yield as_batch(np.minimum(x, y), np.maximum(x, y), mask[left] & mask[right], np.minimum(least[left], least[right]))

    def as_batch(a: np.ndarray, b: np.ndarray, both: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
        by = np.lexsort((b, a))
        a, b, both, least = a[by], b[by], both[by], least[by]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(new)
        seen = {f"k{o}": np.add.reduceat((both >> o) & 1, at, dtype=np.int32) for o in range(orders)}
        return common.batch(a=a[at], b=b[at], least=np.minimum.reduceat(least, at).astype(np.int32), **seen)

    packed = labelled.mapInArrow(common.lean(prefixes), common.PACKED)
    counts = [f"k{o}" for o in range(orders)]
    found = common.exchange(packed, n_buckets, pairs, "a bigint, b bigint, least int, " + ", ".join(f"{k} int" for k in counts))
    both = found.groupBy("a", "b").agg(F.min("least").alias("least"), *[F.sum(k).alias(k) for k in counts])
    return both.where(" and ".join(f"{k} >= least" for k in counts)).select("a", "b")


def scanned(docs: DataFrame, n: int, threshold: float, orders: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text) of the rows that take part."""
    if not 0 < threshold <= 1 or not 1 <= orders <= len(ODD) or n < 1:
        raise ValueError("0 < threshold <= 1, 1 <= orders <= 4, n >= 1")
    return common.reduced_scan(docs, doc_id=doc_id, text=text).where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("bigint"))


def led(signed: DataFrame) -> DataFrame:
    """Pairs (a, b) of documents that share a pair of min-hashes, b the leader of all that share it.  signed: rows of ``signatures``."""
    keyed = signed.select("doc_id", F.posexplode("keys").alias("k", "key"))
    leader = keyed.groupBy("k", "key").agg(F.min("doc_id").alias("b"), F.count("*").alias("c")).where("c > 1").select("k", "key", "b")
    return keyed.join(leader, ["k", "key"]).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()


def links(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, orders: int = ORDERS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, group_id, n_links) of every document that is linked to another one: to how many others, and the least doc_id that links lead to."""
    spark = common.prepare(docs.sparkSession)
    docs = scanned(docs, n, threshold, orders, doc_id, text)
    n_buckets = common.byte_buckets(docs)
    signed = signatures(docs, n).checkpoint()
    # documents of the same sets (an id may have several texts) are a class; one of them, the node, is joined for all
    own = signed.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("whole", "size"))).alias("sets"), F.sum("size").alias("size")).checkpoint()
    classes = own.groupBy("sets").agg(F.min("doc_id").alias("node"), F.count("*").alias("weight"))
    members = own.join(classes, "sets").select("doc_id", "node", "weight", "size").checkpoint()
    copies = common.sized(members.where("doc_id <> node").select("doc_id").checkpoint())
    # what min-hashes connect first: sets that may be similar, compared in the end with all others of their cluster
    sure = maybe(docs, led(common.join_ids(signed, copies, "left_anti")), n, threshold).checkpoint()
    rest = common.join_ids(docs, copies, "left_anti")
    more = maybe(docs, candidates(spark, rest, components(spark, sure), frequency_classes(docs, n), n, threshold, orders, n_buckets), n, threshold)
    nodes = members.where("doc_id = node").select("node", "weight", "size")
    clusters = components(spark, sure.union(more)).join(nodes, "node").checkpoint()
    blocks = F.greatest(F.ceil(6 * F.sum("size") / BLOCK_BYTES), F.ceil(F.count("*") / BLOCK_DOCS)).alias("blocks")
    placed = clusters.join(clusters.groupBy("label").agg(blocks), "label").withColumn("block", F.expr("pmod(xxhash64(node), blocks)"))
    linked = compared(docs, placed.select("node", "weight", "label", "blocks", "block"), n, threshold, n_buckets).checkpoint()
    others = linked.groupBy(F.col("a").alias("node")).agg(F.sum("others").alias("others"))
    found = members.join(others, "node", "left").join(components(spark, linked.select("a", "b")), "node", "left")
    n_links = F.coalesce("others", F.lit(0)) + F.col("weight") - 1
    return found.select("doc_id", F.coalesce("label", "node").alias("group_id"), n_links.cast("bigint").alias("n_links")).where("n_links > 0")


def groups(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, orders: int = ORDERS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, group_id) of every document that is in a group of at least two; group_id is the least doc_id of the group."""
    spark = common.prepare(docs.sparkSession)
    docs = scanned(docs, n, threshold, orders, doc_id, text)
    n_buckets = common.byte_buckets(docs)
    signed = signatures(docs, n).checkpoint()
    # equal sets collapse: one id stands for all
    same = signed.groupBy("whole", "size").agg(F.min("doc_id").alias("one"), F.count_distinct("doc_id").alias("k"))
    equal = signed.join(same.where("k > 1"), ["whole", "size"]).where("doc_id <> one").select("doc_id", "one").distinct().checkpoint()
    ones = signed.join(same.select("whole", "size", "one"), ["whole", "size"]).where("doc_id = one")
    sure = verified(docs, led(ones), n, threshold).checkpoint()
    known = equal.select(F.col("doc_id").alias("a"), F.col("one").alias("b")).union(sure)
    labels = components(spark, known)
    # equal copies need no postings of their own: their one has the same set
    rest = common.join_ids(docs, common.sized(repeats_only(signed, equal)), "left_anti")
    rest_pairs = candidates(spark, rest, labels, frequency_classes(docs, n), n, threshold, orders, n_buckets)
    more = verified(docs, rest_pairs, n, threshold)
    return components(spark, known.union(more)).select(F.col("node").alias("doc_id"), F.col("label").alias("group_id"))


def repeats_only(signed: DataFrame, equal: DataFrame) -> DataFrame:
    """Ids all of whose texts have the set of another id (an id may have several texts)."""
    single = signed.groupBy("doc_id").agg(F.count_distinct("whole", "size").alias("k")).where("k = 1")
    return equal.join(single, "doc_id").select("doc_id").distinct().checkpoint()


components = common.components


def grouped(docs: DataFrame, **options) -> DataFrame:
    """One row per group: group_id, the sorted doc_ids, their number."""
    g = groups(docs, **options)
    return g.groupBy("group_id").agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids")).withColumn("n_docs", F.size("doc_ids").cast("bigint"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents without all but the first (least id) of each group; columns and row repeats as they are."""
    gone = groups(docs, doc_id=doc_id, **options).where("doc_id <> group_id").select("doc_id").checkpoint()
    return common.join_ids(docs, common.sized(gone), "left_anti", doc_id)


ORACLE_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents
), tokens as (
  select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as token
  from words
), sizes as (
  select doc_id, count(*) as n from tokens group by doc_id
), pairs as (
  select x.doc_id as a, y.doc_id as b, count(*) as k from tokens x join tokens y on x.token = y.token and x.doc_id < y.doc_id group by all
), alike as (
  select a, b from pairs join sizes s on a = s.doc_id join sizes t on b = t.doc_id where k >= 0.6 * (s.n + t.n - k) - 1e-9
), links as (
  select a, b from alike union all select b, a from alike
), reach as (
  select distinct a as doc_id, a as other from links
  union
  select r.doc_id, l.b from reach r join links l on l.a = r.other
), labelled as (
  select doc_id, min(other) as group_id from reach group by doc_id
), numbers as (
  select a as doc_id, count(*) as n_links from links group by a
)
select doc_id, group_id, n_links from labelled join numbers using (doc_id)
"""

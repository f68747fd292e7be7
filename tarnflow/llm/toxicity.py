"""Toxicity: a convolutional text classifier trained in numpy.

A word's vector is the sum of rows of one hashed table, for the word and for its first 4 to 7
bytes (so that inflected and compounded forms share weight).  Filters of widths 1, 2 and 3
run over the whole text, each is pooled by maximum, and a linear layer scores the pooled
values.  Only the positions that win the pooling have gradients, which keeps training in
numpy cheap.  The first embedding dimension starts from smoothed log-odds.

The model is fitted on every labelled document.  A fifth of them, by a hash of the id, is held out
and sets each language's threshold (best F1 over all its held-out scores, in the middle of the gap);
languages with too few held-out labels use the threshold over all.  The others are spread by id over
blocks of about ``BLOCK`` documents.  The log-odds come from counts over all blocks; in each round every
block trains on from the common weights, and a weight moves by the mean over the blocks that touched it
(one block: plain training).  Sums are in fixed point, so the order of tasks doesn't matter.  Scoring covers every document.

Defined cases: a null or empty text scores as one without words; a null language, or one
without labels, uses the common threshold; without labels of both kinds nothing is toxic;
labels of unknown, null or contradictory ids are left out; an id of several rows is fitted on once; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, kernel
from .kernel import U64

#: Labelled documents a block, and words at most that a task trains on at once (a block of more is several).
BLOCK, WORDS = 8192, 4_000_000
ROWS_BITS, DIM, FILTERS, WIDTHS = 17, 8, 8, (1, 2, 3)
PREFIXES = (4, 5, 6, 7)
PAD = 3
EPOCHS, BATCH, RATE, SEED = 8, 64, 0.08, 7
#: Rounds in which blocks train, each for its share of the epochs.
ROUNDS = 4
PIECES = 64
#: Sums of what blocks found are in steps of 2**-24.
STEPS = float(1 << 24)
LEAST_HELD_OUT = 15


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of each word (one column per feature), and each text's number of words."""
    w = kernel.Words(col)
    out = np.empty((len(w.start), 1 + len(PREFIXES)), np.int32)
    if len(w.start):
        sums = w.sums()
        out[:, 0] = w.spans(sums, w.start, w.end) >> U64(64 - ROWS_BITS)
        for k, p in enumerate(PREFIXES):
            h = w.spans(sums, w.start, np.minimum(w.end, w.start + p))
            out[:, k + 1] = kernel.mix(h, k + 1) >> U64(64 - ROWS_BITS)
    return out, w.counts


@dataclass
class Model:
    table: np.ndarray
    filters: np.ndarray  # (width, offset) pairs x FILTERS, DIM
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    common: float = 0.0

    def pooled(self, rows: np.ndarray, counts: np.ndarray, where: bool = False):
        """The largest value of each filter over each text; with where, also its position among the padded words."""
        begin = np.cumsum(counts + PAD) - (counts + PAD)
        x = np.zeros((int(counts.sum()) + PAD * (len(counts) + 1), DIM), np.float32)
        at = np.arange(len(rows)) + np.repeat(PAD * np.arange(len(counts)), counts)
        if len(rows):
            v = self.table[rows[:, 0]]
            for k in range(1, rows.shape[1]):
                v += self.table[rows[:, k]]
            x[at] = v
        z = self.filters @ x.T
        n = x.shape[0] - max(WIDTHS) + 1
        cuts = np.stack([begin, begin + np.maximum(counts, 1)], axis=1).ravel()
        best, place, k = [], [], 0
        for w in WIDTHS:
            value = z[k * FILTERS : (k + 1) * FILTERS, :n].copy()
            for j in range(1, w):
                value += z[(k + j) * FILTERS : (k + j + 1) * FILTERS, j : j + n]
            k += w
            best.append(np.maximum.reduceat(value, cuts, axis=1)[:, ::2])
            if where:
                place.append(np.stack([b + np.argmax(value[:, b : b + max(1, c)], axis=1) for b, c in zip(begin, counts)], axis=1))
        pooled = np.concatenate(best).T + self.bias
        return (pooled, np.concatenate(place).T, x, at) if where else pooled

    def score(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = np.maximum(self.pooled(rows, counts), 0) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-z.astype(np.float64)))

    def limit(self, langs: list) -> np.ndarray:
        return np.array([self.thresholds.get(x, self.common) for x in langs])


def begin(seen: np.ndarray, share: float) -> tuple[Model, list[np.ndarray]]:
    """The model before training, and the squared gradients so far; seen: documents with each row, of either kind."""
    rng = np.random.default_rng(SEED)
    width, prior = 1 << ROWS_BITS, 5.0
    odds = np.log((seen[1] + prior * share) / (seen[0] + prior * (1 - share)) * ((1 - share) / share))
    table = rng.normal(0, 0.05, (width, DIM)).astype(np.float32)
    table[:, 0] = odds / (1 + len(PREFIXES))
    filters = rng.normal(0, 0.1, (sum(WIDTHS) * FILTERS, DIM)).astype(np.float32)
    filters[:, 0] += 0.5
    m = Model(table, filters, np.zeros(len(WIDTHS) * FILTERS, np.float32), np.full(len(WIDTHS) * FILTERS, 0.2, np.float32), -1.0)
    return m, [np.full_like(a, 1e-3) for a in (m.table, m.filters, m.bias, m.out)] + [np.array([1e-3])]


def descend(m: Model, grads: list[np.ndarray], rows: np.ndarray, counts: np.ndarray, toxic: np.ndarray, share: float, epochs: int, rng: np.random.Generator) -> None:
    """Train on these documents, in place."""
    toxic = toxic.astype(np.float32)
    first = np.concatenate([[0], np.cumsum(counts)])

    def step(value: np.ndarray, square: np.ndarray, g: np.ndarray, at=slice(None)) -> None:
        square[at] += g * g
        value[at] -= RATE * g / np.sqrt(square[at])

    weight = np.where(toxic > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(counts))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            r = np.concatenate([rows[first[d] : first[d + 1]] for d in own])
            c = counts[own]
            pooled, place, x, at = m.pooled(r, c, where=True)
            active = np.maximum(pooled, 0)
            p = 1 / (1 + np.exp(-(active @ m.out + m.out_bias)))
            err = (p - toxic[own]) * weight[own] / len(own)
            d_pool = err[:, None] * m.out * (pooled > 0)
            d_filters, touched, d_x, k = np.zeros_like(m.filters), [], [], 0
            word = np.full(len(x) + 1, -1)
            word[at] = np.arange(len(r))
            for w, size in enumerate(WIDTHS):
                cols = slice(w * FILTERS, (w + 1) * FILTERS)
                g = d_pool[:, cols]
                for j in range(size):
                    pos = place[:, cols] + j
                    f = slice((k + j) * FILTERS, (k + j + 1) * FILTERS)
                    d_filters[f] += np.einsum("df,dfe->fe", g, x[pos])
                    touched.append(word[pos].ravel())
                    d_x.append((g[:, :, None] * m.filters[f]).reshape(-1, DIM))
                k += size
            touched, d_x = np.concatenate(touched), np.concatenate(d_x)
            ok = touched >= 0
            flat = r[touched[ok]].ravel()
            at_rows, back = np.unique(flat, return_inverse=True)
            g = np.zeros((len(at_rows), DIM), np.float32)
            np.add.at(g, back, np.repeat(d_x[ok], r.shape[1], axis=0))
            step(m.table, grads[0], g, at_rows)
            step(m.filters, grads[1], d_filters)
            step(m.bias, grads[2], d_pool.sum(axis=0))
            step(m.out, grads[3], active.T @ err)
            grads[4] += float(err.sum()) ** 2
            m.out_bias -= RATE * float(err.sum()) / float(np.sqrt(grads[4][0]))


def dense(m: Model, grads: list[np.ndarray]) -> np.ndarray:
    """All that has a gradient in every batch, and its squares."""
    return np.concatenate([np.ravel(x).astype(np.float64) for x in (m.filters, m.bias, m.out, m.out_bias, *grads[1:])])


def moved(m: Model, grads: list[np.ndarray], by: np.ndarray) -> None:
    """Add to what ``dense`` gives, in place."""
    at = 0
    for x in (m.filters, m.bias, m.out, None, *grads[1:]):
        size = 1 if x is None else x.size
        if x is None:
            m.out_bias += float(by[at])
        else:
            x += by[at : at + size].reshape(x.shape).astype(x.dtype)
        at += size


def one_round(rows: DataFrame, m: Model, grads: list[np.ndarray], share: float, every: bool, number: int) -> None:
    """Every block trains from m; m and grads move by the means.  Only compressed differences are shuffled; the driver gets as much as the model has."""
    shared = rows.sparkSession.sparkContext.broadcast((m, grads))
    each = (1 << ROWS_BITS) // PIECES

    def train_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []
        words = done = 0

        def differences() -> pa.RecordBatch:
            old, squares = shared.value
            new = Model(old.table.copy(), old.filters.copy(), old.bias.copy(), old.out.copy(), old.out_bias)
            own = [x.copy() for x in squares]
            r, c, t = (np.concatenate([w[k] for w in waiting]) for k in range(3))
            waiting.clear()
            descend(new, own, r, c, t, share, EPOCHS // ROUNDS, np.random.default_rng([SEED, number, TaskContext.get().partitionId(), done]))
            at = np.flatnonzero((own[0] != squares[0]).any(axis=1))
            both = np.concatenate([new.table[at] - old.table[at], own[0][at] - squares[0][at]], axis=1)
            cuts = np.searchsorted(at, np.arange(PIECES + 1) * each)
            out = [(k, kernel.pack((at[a:b] - k * each).astype(np.uint32), both[a:b].ravel())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            return common.packed_batch(out + [(PIECES, kernel.pack(np.zeros(0, np.uint32), dense(new, own) - dense(old, squares)))])

        for b in batches:
            for first, n, col in kernel.text_slices(b, "text"):
                use = np.full(n, True) if every else ~b.column(1).slice(first, n).to_numpy(zero_copy_only=False).astype(bool)
                r, c = features(col)
                waiting.append((r[np.repeat(use, c)], c[use], b.column(2).slice(first, n).to_numpy(zero_copy_only=False)[use]))
                words += len(waiting[-1][0])
                if words >= WORDS:
                    yield differences()
                    words, done = 0, done + 1
        if sum(len(w[1]) for w in waiting):
            yield differences()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for b in batches:
            for k, p in zip(b.column(0), b.column(1)):
                k, (at, change) = k.as_py(), kernel.unpack(p.as_py())
                fixed = np.rint(change.astype(np.float64) * STEPS).astype(np.int64)
                if k == PIECES:
                    at, fixed = np.zeros(1, np.int64), fixed.reshape(1, -1)
                else:
                    fixed = fixed.reshape(len(at), 2 * DIM)
                total, times = found.setdefault(k, [np.zeros((1 if k == PIECES else each, fixed.shape[1]), np.int64), np.zeros(1 if k == PIECES else each, np.int64)])
                total[at] += fixed
                times[at] += 1
        for k, (total, times) in found.items():
            at = np.flatnonzero(times)
            yield common.packed_batch([(k, kernel.pack(at.astype(np.uint32), (total[at] / times[at, None] / STEPS).ravel()))])

    parts = rows.select("text", "held", "toxic").mapInArrow(common.lean(train_block), common.PACKED)
    for row in parts.repartition(16, "bucket").mapInArrow(common.lean(merge), common.PACKED).collect():
        at, change = kernel.unpack(row.payload)
        if row.bucket == PIECES:
            moved(m, grads, change)
        else:
            change = change.reshape(len(at), 2 * DIM).astype(np.float32)
            m.table[at + row.bucket * each] += change[:, :DIM]
            grads[0][at + row.bucket * each] += change[:, DIM:]
    shared.destroy()


def fit(rows: DataFrame) -> Model | None:
    """Train and calibrate on all rows (doc_id, lang, text, toxic, held), a block in each partition; None without examples of both kinds."""
    width = 1 << ROWS_BITS

    def count(b: pa.RecordBatch, total: np.ndarray) -> None:
        for first, n, col in kernel.text_slices(b, "text"):
            own, counts = features(col)
            held, toxic = (b.column(k).slice(first, n).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
            kind = 2 * held + toxic
            seen = np.unique(np.repeat(np.arange(n), counts)[:, None] * width + own)
            total[: 4 * width] += np.bincount(kind[seen // width] * width + seen % width, minlength=4 * width)
            total[4 * width : 4 * width + 4] += np.bincount(kind, minlength=4)

    total = common.corpus_counts(rows, ["text", "held", "toxic"], count, 4 * width + common.CHUNKS)
    seen, of = total[: 4 * width].reshape(2, 2, width), total[4 * width : 4 * width + 4].reshape(2, 2)
    if not of.sum(axis=0).all():
        return None
    every = not of.all()
    if every:
        seen, of = seen.sum(axis=0), of.sum(axis=0)
    else:
        seen, of = seen[0], of[0]
    share = float(of[1] / of.sum())
    m, grads = begin(seen.astype(np.float32), share)
    for number in range(ROUNDS):
        one_round(rows, m, grads, share, every, number)
    calibrate(rows if every else rows.where("held"), m)
    return m


def calibrate(rows: DataFrame, m: Model) -> None:
    """Set the thresholds by all scores of rows: by sorting them, as ``best_threshold`` does for a list."""
    shared = rows.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n, col in kernel.text_slices(b, "text"):
                yield common.batch(lang=b.column(1).slice(first, n), toxic=b.column(2).slice(first, n), score=shared.value.score(*features(col)))

    scored = rows.select("text", "lang", "toxic").mapInArrow(common.lean(run), "lang string, toxic int, score double")
    # the key of all rows is empty; a language's has its name
    keys = F.when(F.col("lang").isNull(), F.array(F.array().cast("array<string>"))).otherwise(F.array(F.array().cast("array<string>"), F.array("lang")))
    levels = scored.groupBy("lang", "score").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).select(F.explode(keys).alias("key"), "score", "n", "bad").groupBy("key", "score").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).checkpoint()
    totals = levels.groupBy("key").agg(F.sum("n").alias("all"), F.sum("bad").alias("toxic")).where(f"size(key) = 0 or (all >= {LEAST_HELD_OUT} and 0 < toxic and toxic < all)").select("key", "toxic")
    down = Window.partitionBy("key").orderBy(F.desc("score"))
    above = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = levels.select("key", "score", F.sum("n").over(above).alias("said"), F.sum("bad").over(above).alias("hit"), F.coalesce(F.lead("score").over(down), F.lit(0.0)).alias("below"))
    f1 = 2 * F.col("hit") / (F.col("said") + F.col("toxic"))
    best = cuts.join(totals, "key").groupBy("key").agg(F.max(F.struct(f1.alias("f1"), (F.col("score") - F.col("below")).alias("gap"), (-F.col("score")).alias("low"), ((F.col("score") + F.col("below")) / 2).alias("cut"))).alias("best"))
    for row in best.select("key", "best.cut").collect():
        if row.key:
            m.thresholds[row.key[0]] = row.cut
        else:
            m.common = row.cut
    shared.destroy()


def best_threshold(score: np.ndarray, toxic: np.ndarray) -> float:
    """The threshold of the best F1; in the middle between the scores on either side of it."""
    s = np.unique(score)
    cuts = np.concatenate([[s[0] / 2], (s[1:] + s[:-1]) / 2, [(1 + s[-1]) / 2]])
    hit = np.array([((score > c) & (toxic > 0)).sum() for c in cuts])
    said = np.array([(score > c).sum() for c in cuts])
    f1 = 2 * hit / np.maximum(said + toxic.sum(), 1)
    best = np.flatnonzero(f1 == f1.max())
    gaps = [(s[i] if i < len(s) else 1.0) - (s[i - 1] if i else 0.0) for i in best]
    return float(cuts[best[int(np.argmax(gaps))]])


def labelled(docs: DataFrame, labels: DataFrame, block: int, doc_id: str, text: str, lang: str, toxic: str, label_id: str) -> DataFrame:
    """(doc_id, lang, text, toxic, held) of every labelled document, one row each, a block in each partition."""
    given = common.reduced_scan(labels, doc_id=label_id, toxic=toxic).where("doc_id is not null and toxic in (0, 1)")
    given = given.groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").select(F.col("doc_id").alias("__id"), "toxic").checkpoint()
    blocks = max(1, -(-given.count() // block))
    texts = common.reduced_scan(docs, doc_id=doc_id, lang=lang, text=text).where("doc_id is not null")
    # texts are shuffled once: labelled ones only, if the labels are few enough to be broadcast
    if common.few(given):
        rows = texts.join(F.broadcast(given), F.col("doc_id") == F.col("__id")).repartition(blocks, "doc_id")
    else:
        rows = texts.repartition(blocks, "doc_id").join(given.repartition(blocks, "__id"), F.col("doc_id") == F.col("__id"))
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("lang", "text", "toxic")).alias("row")).select("doc_id", "row.*")
    return rows.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).sortWithinPartitions("doc_id").checkpoint()


def train(docs: DataFrame, labels: DataFrame, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", toxic: str = "toxic", label_id: str = "doc_id") -> Model | None:
    """The model, fitted in tasks of the executors: the driver sees only models, whose size is fixed."""
    common.prepare(docs.sparkSession)
    return fit(labelled(docs, labels, block, doc_id, text, lang, toxic, label_id))


def slices(b: pa.RecordBatch, text: str, lang: str, model: Model) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    at = b.schema.get_field_index(lang)
    for first, n, col in kernel.text_slices(b, text):
        yield first, n, model.score(*features(col)), model.limit(b.column(at).slice(first, n).to_pylist())


def toxic_documents(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang, score, threshold, toxic) of the documents whose score is above their language's threshold."""
    spark = common.prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    schema = "doc_id bigint, lang string, score double, threshold double, toxic boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for first, n, score, limit in slices(b, "text", "lang", model) if model else ():
                hit = np.flatnonzero(score > limit)
                take = pa.array(hit + first)
                yield common.batch(doc_id=b.column(0).take(take), lang=b.column(1).take(take), score=score[hit], threshold=limit[hit], toxic=np.ones(len(hit), bool))

    return docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).mapInArrow(common.lean(run), schema)


def reject(docs: DataFrame, model: Model | None, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that aren't toxic, with all their columns; no join and no shuffle."""
    if model is None:
        return docs
    shared = common.prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for first, n, score, limit in slices(b, text, lang, shared.value):
                keep[first : first + n] = score <= limit
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(common.lean(run), docs.schema)

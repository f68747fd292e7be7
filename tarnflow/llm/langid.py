"""Language identification by nearest centroid.

A text is the normalised TF-IDF vector of its hashed 2- and 3-grams of bytes (letters only,
lower case, everything else a space).  Inverse document frequencies come from all documents.
Each language has several centroids, found by spherical k-means on a bounded sample of
labelled rows (``SAMPLE`` texts per language, those with the least hash of the id), since one
language may hold several kinds of text; a task fits a language, and the driver gets centroids only.  The nearest centroid by cosine gives the language;
a text farther from it than ``MARGIN`` times the distance of nearly all training texts of
that centroid, or without letters, is rejected: its language is 'und'.

Defined cases: null, empty and letterless texts are 'und' with score 0; a null label is no
label; every row has one result row, repeated rows included; without labels all is 'und';
of equally near centroids the first (languages in order) counts; an id of several rows
is in the sample once, with its least text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, kernel

DIMS_BITS = 12
DIMS = 1 << DIMS_BITS
SAMPLE, CENTROIDS, ROUNDS, QUANTILE, MARGIN = 400, 4, 12, 0.99, 1.3
#: Rows whose vectors are made at once; it bounds memory only.
ROWS = 500


def counts(col: pa.Array) -> np.ndarray:
    """n-gram counts of each text (rows x DIMS)."""
    buf, off = kernel.raw(pc.utf8_lower(col))
    rows = len(off) - 1
    if not len(buf):
        return np.zeros((rows, DIMS), np.float32)
    b = np.where(kernel.classes(buf) == 1, buf, np.uint8(32)).astype(np.uint32)
    doc = np.repeat(np.arange(rows, dtype=np.int64) << DIMS_BITS, np.diff(off))
    total = np.zeros(rows * DIMS, np.int64)
    for n in (2, 3):
        m = len(b) - n + 1
        if m <= 0:
            continue
        code = b[:m].copy()
        blank = b[:m] == 32
        for k in range(1, n):
            code = (code << np.uint32(8)) | b[k : k + m]
            blank &= b[k : k + m] == 32
        h = ((code + np.uint32(n)) * np.uint32(2654435761) >> np.uint32(32 - DIMS_BITS)).astype(np.int64)
        ok = ~blank & (doc[:m] == doc[n - 1 :])
        total += np.bincount((doc[:m] | h)[ok], minlength=rows * DIMS)
    return total.reshape(rows, DIMS).astype(np.float32)


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray

    def vectors(self, col: pa.Array) -> np.ndarray:
        x = counts(col)
        np.log1p(x, out=x)
        x *= self.idf
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        return x / np.maximum(norm, 1e-12)[:, None]

    def classify(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Language index (-1: rejected) and cosine of each text."""
        if not len(self.centroids):
            return np.full(len(col), -1), np.zeros(len(col))
        near = self.vectors(col) @ self.centroids.T
        best = near.argmax(axis=1)
        cosine = near[np.arange(len(best)), best].astype(np.float64)
        return np.where((cosine >= self.floor[best]) & (cosine > 0), self.owner[best], -1), cosine


def cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids of spherical k-means; it begins with texts far from each other."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    c = x[chosen].copy()
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].sum(axis=0)
        c /= np.maximum(np.sqrt((c * c).sum(axis=1)), 1e-12)[:, None]
    return c


def fit(x: np.ndarray, k: int = CENTROIDS) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of a language's vectors, and the least cosine that each accepts."""
    x = x[(x > 0).any(axis=1)]
    if not len(x):
        return np.zeros((0, DIMS), np.float32), np.zeros(0)
    c = cluster(x, k)
    near = x @ c.T
    at = near.argmax(axis=1)
    used = [j for j in range(len(c)) if (at == j).any()]
    reach = [float(np.quantile(1 - near[at == j, j], QUANTILE)) for j in used]
    return c[used].astype(np.float32), np.array([1 - min(0.95, max(MARGIN * r, 0.3)) for r in reach])


def train(docs: DataFrame, per_language: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    common.prepare(docs.sparkSession)
    docs = common.reduced_scan(docs, doc_id=doc_id, text=text, lang=lang)

    def add(b: pa.RecordBatch, total: np.ndarray) -> None:
        for _, rows, col in kernel.text_slices(b, "text", most=ROWS):
            total[:DIMS] += (counts(col) > 0).sum(axis=0)
            total[DIMS] += rows

    seen = common.corpus_counts(docs, ["text"], add, 2 * DIMS)
    idf = (np.log((seen[DIMS] + 1) / (seen[:DIMS] + 1)) + 0.05).astype(np.float32)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = docs.where("lang is not null and doc_id is not null").select("doc_id", "lang").distinct().withColumn("rank", rank).where(F.col("rank") <= per_language).select("doc_id", F.col("lang").alias("of"))
    chosen = common.sized(ids.toDF("__id", "of").checkpoint())
    rows = docs.join(chosen, (F.col("doc_id") == F.col("__id")) & (F.col("lang") == F.col("of"))).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = Model(idf, [], np.zeros((0, DIMS), np.float32), np.zeros(0, np.int64), np.zeros(0))
        now, held = None, []

        def done() -> pa.RecordBatch:
            c, floor = fit(np.concatenate(held))
            return common.batch(lang=pa.array([now], pa.string()), centroids=pa.array([c.tobytes()], pa.binary()), floor=pa.array([floor.tobytes()], pa.binary()))

        for b in batches:
            langs = b.column(0).to_pylist()
            for first, n, col in kernel.text_slices(b, "text", most=ROWS):
                x = blank.vectors(col)
                for i in range(n):
                    if langs[first + i] != now:
                        if held:
                            yield done()
                        now, held = langs[first + i], []
                    held.append(x[i : i + 1])
        if held:
            yield done()

    found = rows.repartition("lang").sortWithinPartitions("lang", "doc_id").mapInArrow(common.lean(run), "lang string, centroids binary, floor binary").collect()
    found.sort(key=lambda r: r["lang"])
    cents = [np.frombuffer(r["centroids"], np.float32).reshape(-1, DIMS) for r in found]
    model = Model(idf, [r["lang"] for r in found], np.zeros((0, DIMS), np.float32), np.zeros(0, np.int64), np.zeros(0))
    if found:
        model.centroids, model.owner = np.concatenate(cents), np.repeat(np.arange(len(found)), [len(c) for c in cents])
        model.floor = np.concatenate([np.frombuffer(r["floor"], np.float64) for r in found])
    return model


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, language, cosine), a row for each document."""
    shared = common.prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, "und"], dtype=object)
        for b in batches:
            for first, rows, col in kernel.text_slices(b, "text", most=ROWS):
                lang, cosine = model.classify(col)
                yield common.batch(doc_id=b.column(0).slice(first, rows), language=pa.array(names[lang], pa.string()), cosine=cosine)

    return docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(common.lean(run), "doc_id bigint, language string, cosine double")

"""A sample of a stream, kept up to date batch by batch.

Samples by priority merge: the k least of (old sample, new rows) are the k least of all rows
so far.  Each micro-batch reads the sample of the last finished batch below its own number from the
shared folder, merges its own rows, and writes the next one under its number.  Spark's marker of a
finished write is the commit.  So a batch that runs twice gives the same result, and a new object
on the same folder, as after a restart, goes on where the old one ended.  A folder belongs to
one checkpoint: what it has of later batches is from another run and is removed.  A batch's own k
least are found first, so that only k rows of it meet the old ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from .. import runtime
from ..functions.hashing import priority
from ..operators.sampling import PRIORITY, swor
from ..plans.spec import JoinSpec


def _before(spark: SparkSession, folder: str, epoch: int) -> list[int]:
    """Finished batches below epoch; later ones are removed."""
    done = runtime.finished(spark, folder)
    for e in done:
        if e > epoch:
            runtime.remove(spark, f"{folder}/{e}")
    return [e for e in done if e < epoch]


class StreamSample:
    """Sample state for foreachBatch(StreamSample(...)): ``current`` is the sample after the last finished batch."""

    def __init__(self, spark: SparkSession, ids: list[str], k: int, seed: int | str = 42, folder: str | None = None):
        runtime.prepare(spark)
        self.spark, self.ids, self.k, self.seed = spark, ids, k, seed
        self.folder = folder or f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        new = swor(batch, self.ids, self.k, self.seed)
        before = _before(self.spark, f"{self.folder}/sample", epoch)
        if before:
            new = swor(self.spark.read.parquet(f"{self.folder}/sample/{before[-1]}").unionByName(new), self.ids, self.k, self.seed)
        new.write.mode("overwrite").parquet(f"{self.folder}/sample/{epoch}")
        for e in before[: -int(self.spark.conf.get("spark.sql.streaming.minBatchesToRetain", "100"))]:  # as far back as Spark itself can go
            runtime.remove(self.spark, f"{self.folder}/sample/{e}")

    @property
    def current(self) -> DataFrame | None:
        done = runtime.finished(self.spark, f"{self.folder}/sample")
        return self.spark.read.parquet(f"{self.folder}/sample/{done[-1]}") if done else None


class StreamJoin:
    """A sample of a join while rows of all its relations arrive as one stream; for foreachBatch.

    A batch holds (sid, payload) rows.  Its new results are, for each relation, the batch's rows of it joined with what the
    relations before it hold after the batch and those after it held before: each new result once.  Only results whose
    priority is below the sample's last one can enter, so all others are dropped before they are sorted.  Relations and sample
    lie under the batch's number in the shared folder, and are those of finished batches below it, in this or an earlier run.

    streams: (name, schema) by sid.  make: relations by name -> JoinSpec.
    """

    def __init__(self, spark: SparkSession, streams: list[tuple[str, str]], make: Callable[[dict[str, DataFrame]], JoinSpec], k: int, seed: int | str = 42, folder: str | None = None):
        runtime.prepare(spark)
        self.spark, self.streams, self.make, self.k, self.seed = spark, streams, make, k, seed
        self.folder = folder or f"{spark.sparkContext.getCheckpointDir()}/join-{uuid.uuid4().hex}"

    def _held(self, name: str, schema: str, epochs: list[int]) -> DataFrame:
        if not epochs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{name}/{e}" for e in epochs])

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        batch.persist()
        for sid, (name, schema) in enumerate(self.streams):
            rows = batch.where(F.col("sid") == sid).select(F.from_csv("payload", schema).alias("row")).select("row.*")
            rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/{epoch}")
        batch.unpersist()
        old = _before(self.spark, f"{self.folder}/sample", epoch)
        before = {n: self._held(n, s, old) for n, s in self.streams}
        after = {n: self._held(n, s, [*old, epoch]) for n, s in self.streams}
        bound, ids, new = None, None, None
        if old:
            new = self.spark.read.parquet(f"{self.folder}/sample/{old[-1]}")
            if new.count() >= self.k:
                bound = new.agg(F.max(PRIORITY)).first()[0]
        for i, (name, schema) in enumerate(self.streams):
            now = {n: self._held(n, s, [epoch]) if n == name else after[n] if j < i else before[n] for j, (n, s) in enumerate(self.streams)}
            spec = self.make(now)
            ids = spec.ids()
            found = spec.results(name).withColumn(PRIORITY, priority(self.seed, *ids))
            if bound is not None:
                found = found.where(F.col(PRIORITY) <= bound)
            new = found if new is None else new.unionByName(found)
        new.orderBy(PRIORITY, *ids).limit(self.k).write.mode("overwrite").parquet(f"{self.folder}/sample/{epoch}")

    @property
    def current(self) -> DataFrame | None:
        done = runtime.finished(self.spark, f"{self.folder}/sample")
        return self.spark.read.parquet(f"{self.folder}/sample/{done[-1]}").drop(PRIORITY) if done else None


def meter(query) -> list[dict]:
    """What a streaming query has reported: batch, rows, rows per second, milliseconds."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "rows_per_second": p.get("processedRowsPerSecond"), "ms": p["durationMs"].get("triggerExecution")} for p in query.recentProgress]


def sample_stream(source: DataFrame, ids: list[str], k: int, seed: int | str = 42) -> DataFrame:
    """Runs all that a stream has now through StreamSample; min(k, rows) rows."""
    spark = source.sparkSession
    state = StreamSample(spark, ids, k, seed)
    query = source.writeStream.foreachBatch(state).option("checkpointLocation", f"{state.folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    found = state.current
    return spark.createDataFrame([], source.schema) if found is None else found


def sample_per_window(source: DataFrame, ts: str, size: str, late: str, ids: list[str], k: int, seed: int | str = 42) -> DataFrame:
    """A streaming DataFrame (window, sample): k rows of each tumbling window, given out when the watermark has passed it.

    ``late`` is how far rows may be out of order; the state holds at most k rows of each open window, and so does what
    each task of a batch sends there.  Repeated rows count as often as they occur.
    """
    ranked = source.withWatermark(ts, late).withColumn(PRIORITY, priority(seed, *ids))
    kept = ranked.groupBy(F.window(ts, size)).agg(InternalFunction.collect_top_k(F.struct(PRIORITY, *ids), k, True).alias("sample"))
    return kept.withColumn("sample", F.transform("sample", lambda x: F.struct(*[x[i].alias(i) for i in ids])))

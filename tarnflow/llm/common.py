"""What the operators share on the Spark side."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKED = "bucket int, payload binary"
#: A side is broadcast up to so many bytes; beyond it the same join shuffles.
BROADCAST_BYTES = 8 << 20


def root() -> str:
    return os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """A checkpoint folder from the session's settings; one of its own only in tests on one machine, where none is set.

    On one machine workers find this package by its path; a cluster gets it by --py-files or its images.
    """
    if spark.sparkContext.master.startswith("local"):
        env = spark.sparkContext.environment
        if root() not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(x for x in (root(), env.get("PYTHONPATH", "")) if x)
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and re.match(r"local(\[|$)", spark.sparkContext.master):
            folder = tempfile.mkdtemp(prefix="tarnflow-checkpoint-")
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    """Partitions of a scan: they follow the size of the input."""
    return max(1, df.rdd.getNumPartitions())


def buckets(df: DataFrame, per_partition: float = 2) -> int:
    return min(1 << 20, max(4, int(per_partition * partitions(df))))


def byte_buckets(df: DataFrame, each: int = 16 << 20) -> int:
    """Buckets for what a scan gives: one for so many bytes of its input, whatever its partitions are."""
    most = df.sparkSession.conf.get("spark.sql.files.maxPartitionBytes")
    size = int(re.match(r"\d+", most).group()) << {"k": 10, "m": 20, "g": 30}.get(most.lower().rstrip("b")[-1:], 0)
    return buckets(df, max(1.0, size / each))


def release() -> None:
    """Memory that numpy and Arrow are done with goes back to the system; Python workers live on between tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work for mapInArrow, with memory released at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def exchange(packed: DataFrame, n: int, reduce: Callable[[list[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Bring the packed rows of each bucket together and hand them to ``reduce``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[bytes]] = defaultdict(list)
        for b in batches:
            for k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found[k].append(p)
        while found:
            yield from reduce(found.popitem()[1])

    return packed.repartition(n, "bucket").mapInArrow(lean(run), schema)


def packed_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "payload"])


def batch(**columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


CHUNKS = 64
#: Partial sums that one task merges; with more of them there are two rounds.
FAN = 256


def _squeeze(x: np.ndarray) -> bytes:
    small = x.astype(np.uint8 if x.max(initial=0) < 256 else np.uint16 if x.max() < 65536 else np.int64)
    return small.dtype.char.encode() + pa.Codec("lz4").compress(small.tobytes(), asbytes=True)


def _spread(p: bytes, n: int) -> np.ndarray:
    kind = np.dtype(p[:1].decode())
    return np.frombuffer(pa.Codec("lz4").decompress(p[1:], n * kind.itemsize, asbytes=True), kind)


def corpus_counts(df: DataFrame, columns: list[str], add: Callable[[pa.RecordBatch, np.ndarray], None], size: int, only_if: bool = False) -> np.ndarray:
    """Sum of fixed-size vectors over all rows: ``add`` counts a batch into one.  size: a multiple of CHUNKS.

    Only compressed pieces of partial sums are shuffled; the driver gets one vector, however large the input is.
    only_if: the vector says, in a byte each, whether a count isn't 0.
    """
    step = size // CHUNKS
    spread = -(-partitions(df) // FAN)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            add(b, total)
        if total.any():
            own = CHUNKS * (TaskContext.get().partitionId() % spread)
            yield packed_batch([(own + k, _squeeze(total[k * step : (k + 1) * step])) for k in range(CHUNKS)])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found.setdefault(k % CHUNKS, np.zeros(step, np.int64))
                found[k % CHUNKS] += _spread(p, step)
        yield packed_batch([(k, _squeeze(np.minimum(x, 1) if only_if else x)) for k, x in found.items()])

    total = np.zeros(size, np.uint8 if only_if else np.int64)
    parts = df.select(*columns).mapInArrow(lean(count), PACKED)
    if spread > 1:
        parts = parts.repartition(16 * spread, "bucket").mapInArrow(lean(merge), PACKED)
    for row in parts.repartition(16, "bucket").mapInArrow(lean(merge), PACKED).collect():
        total[row.bucket * step : (row.bucket + 1) * step] = _spread(row.payload, step)
    return total


def reduced_scan(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names, whatever else the table holds."""
    return docs.select(*[F.col(f"`{c}`").alias(k) for k, c in columns.items()])


def join_ids(left: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """Semi or anti join on an id; ids: one column.  Other columns of left may have any names; null ids match none."""
    side = ids.toDF("__id")
    return left.join(side, left[f"`{key}`"] == side["__id"], how)


def width(column: str, kind: str):
    """Bytes of a value, about."""
    c = F.col(f"`{column}`")
    if kind in ("string", "binary"):
        return F.octet_length(c) + 16
    if kind.startswith("array"):
        return (2 if kind == "array<boolean>" else 9) * F.size(c) + 24
    return F.lit(8)


def few(df: DataFrame) -> bool:
    """Whether all of df takes few bytes.  df should be cheap to read (a checkpoint or table)."""
    each = F.lit(8)
    for name, kind in df.dtypes:
        each = each + F.coalesce(width(name, kind), F.lit(8))
    return (df.agg(F.sum(each)).first()[0] or 0) <= BROADCAST_BYTES


def sized(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it takes few bytes."""
    return F.broadcast(df) if few(df) else df


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, label) of the connected components of edges (a, b): label is the least node.

    Alternates large-star and small-star until nothing changes.  A component of any depth is
    done in logarithmically many rounds; each round is checkpointed.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    n = e.count()
    state = None
    while n:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        e = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        joined = e.join(least, "a")
        e = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct().checkpoint()
        now = e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def fresh(df: DataFrame, name: str) -> str:
    """name, or a longer one that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared checkpoint folder and read again."""
    spark = prepare(df.sparkSession)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    out = spark.read.parquet(folder)
    out.stored_in = folder
    return out


def discard(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote, once nothing reads it any more."""
    folder = df.__dict__.get("stored_in")
    if folder:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

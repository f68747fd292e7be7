"""Random access: the results of a join at given positions, without materialising it.

Positions follow the join tree: root rows in the order of their ids, then the first child's
matching rows as the most significant digit, and so on, recursively.  Each relation is kept
in one total order (key towards its parent, then ids) with the running sum of its weights.
The matching rows of a key are one interval of that sum, so a position splits by division
into one place for each child, and each place is found by an as-of lookup in its relation.

The running sum needs no single task: rows are range-partitioned by the total order and written
once, sorted, with the sum of the weights ahead of them in their partition; what earlier
partitions hold is a number for each partition.  A hot key may span any number of partitions, and
partitions hold a bounded number of rows however many there are.  Every ``BLOCK`` rows of a
partition are a block.  A lookup finds a place's partition by bisection over one number for each
partition.  For a few places it finds the block among the first rows of that partition's blocks and joins
the block's rows only; many places are sorted among the rows, each partition cut into stretches of positions.
``every`` gives all results with their positions by one equi-join for each edge.  Costs follow the
inputs once, then the number of positions, never the size of the join.  Sums are bigint where they provably
fit, DECIMAL(38,0) elsewhere.  Relations that don't hang on each other are prepared at the same time.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import runtime
from ..functions.hashing import draw
from ..plans.spec import WEIGHT, JoinSpec, Step
from . import counting


#: Rows that a lookup looks through for one place.
BLOCK = 512
#: Places up to this number are broadcast to a relation's blocks (rows of a few numbers each); more are sorted among the rows.
FEW = 50_000
#: Places of one stretch, where many are looked up.
STRETCH = 1_000_000
#: Rows of a partition: tables below LEAST have one partition, none has many more than MOST rows.
LEAST, MOST = 10_000, 1_000_000


def partitions(spark, rows: int) -> int:
    """Partitions for so many rows: the session's number, fewer for small tables, and as many as the rows need."""
    usual = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(1, min(usual, -(-rows // LEAST)), -(-rows // MOST))


def _summing():
    """A function that tasks get by value, since executors need not have this package: (weights, ahead) -> for each weight the sum of ahead and those before it, and the sum of ahead and all; bigint or decimal(38,0) like the weights."""

    def sums(weights: pa.Array, ahead: int) -> tuple[pa.Array, int]:
        n = len(weights)
        if pa.types.is_int64(weights.type):
            w = weights.to_numpy()
            upto = np.cumsum(w)
            return pa.array(upto - w + ahead), ahead + int(upto[-1])
        words = np.frombuffer(weights.buffers()[1], np.int64).reshape(-1, 2)[weights.offset : weights.offset + n]
        low = words[:, 0]
        if words[:, 1].any() or (low < 0).any() or float(low.max()) * n >= 2.0**62:
            before = []
            for x in weights.to_pylist():
                before.append(Decimal(ahead))
                ahead += int(x)
            return pa.array(before, pa.decimal128(38, 0)), ahead
        upto = np.cumsum(low)
        out = np.empty((n, 2), np.uint64)
        first = np.uint64(ahead & (2**64 - 1))
        out[:, 0] = (upto - low).astype(np.uint64) + first  # modulo 2^64
        out[:, 1] = np.uint64(ahead >> 64) + (out[:, 0] < first)
        return pa.Array.from_buffers(pa.decimal128(38, 0), n, [None, pa.py_buffer(out.tobytes())]), ahead + int(upto[-1])

    return sums


@dataclass
class Sorted:
    """A relation in its total order: rows have part, before (the weights ahead in that part), block, and head for a block's first row."""

    rows: DataFrame
    bases: list[tuple[int, int]]  # (part, the weights of earlier parts)
    size: int
    kind: str

    def placed(self) -> DataFrame:
        """rows with place: the sum of all weights ahead."""
        values = ", ".join(f"({p}, {b}{'BD' if b >= 1 << 63 else ''})" for p, b in self.bases) or "(0, 0)"
        parts = self.rows.sparkSession.sql(f"select part as __part, cast(base as {self.kind}) as __base from values {values} as t(part, base)")
        return self.rows.join(F.broadcast(parts), F.col("part") == F.col("__part")).withColumn("place", (F.col("before") + F.col("__base")).cast(self.kind)).drop("__part", "__base")


def _running(df: DataFrame, order: list[str], n: int, kind: str, ones: bool = False) -> Sorted:
    """df (weight as kind) in n partitions by order.  ones: all weights are 1, so that a row's number in its partition is the sum ahead of it and no row passes through Python."""
    ordered = df.repartitionByRange(n, *[F.col(f"`{c}`") for c in order]).sortWithinPartitions(*[F.col(f"`{c}`") for c in order]).withColumn("part", F.spark_partition_id())
    sums, length = _summing(), BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead, seen = 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            before, ahead = sums(b.column(b.schema.get_field_index("weight")), ahead)
            if ahead >= 10**38:
                raise OverflowError("weights add up to more than DECIMAL(38,0) holds")
            at = np.arange(seen, seen + b.num_rows)
            seen += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, before, pa.array((at // length).astype(np.int32)), pa.array(at % length == 0)], [*b.schema.names, "before", "block", "head"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema)
    if ones:
        number = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        counted = ordered.withColumn("before", number)
        summed = counted.select("*", F.expr(f"cast(before div {length} as int)").alias("block"), (F.col("before") % length == 0).alias("head"))
    else:
        summed = ordered.mapInArrow(run, f"{schema}, before {kind}, block int, head boolean")
    rows = runtime.stored(summed)
    # a row for each partition comes to the driver, and goes back as constants
    totals = sorted((r["part"], int(r["all"])) for r in rows.groupBy("part").agg(F.sum("weight").alias("all")).collect())
    size, bases = 0, []
    for part, all_ in totals:
        bases.append((part, size))
        size += all_
    return Sorted(rows, bases, size, kind)


def _part_of(places: DataFrame, r: Sorted) -> DataFrame:
    """places with the partition that holds at, the last one that begins at or before it, and local: at less what earlier partitions hold."""
    starts, names, small = [b for _, b in r.bases], [p for p, _ in r.bases], r.kind == "bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [int(x) for x in b.column(b.schema.get_field_index("at")).to_pylist()]
            part = [bisect_right(starts, x) - 1 for x in at]
            local = [x - starts[p] for x, p in zip(at, part)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([names[p] for p in part], pa.int32()), pa.array(local, pa.int64()) if small else pa.array([Decimal(x) for x in local], pa.decimal128(38, 0))], [*b.schema.names, "part", "local"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in places.schema)
    return places.mapInArrow(run, f"{schema}, part int, local {r.kind}")


def _lookup(r: Sorted, places: DataFrame, prefix: str, n: int) -> DataFrame:
    """n places (at, ...) with the row whose interval holds at, its columns under prefix, and ``rest``: at less the row's beginning."""
    asks = _part_of(places, r)
    ask = F.struct(*places.columns).alias("ask")
    keep = [c for c in r.rows.columns if c not in ("part", "block", "head")]
    if n > FEW:
        return _among(r, asks.select("part", "local", ask), keep, prefix, n)
    kind = asks.select(ask).schema["ask"].dataType
    heads = r.rows.where("head").select("part", F.col("before").alias("local"), F.lit(0).alias("kind"), "block", F.lit(None).cast(kind).alias("ask"))
    both = heads.unionByName(asks.select("part", "local", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("block"), ask))
    last = F.last("block", ignorenulls=True).over(Window.partitionBy("part").orderBy("local", "kind", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = both.withColumn("block", last).where("kind = 1").select(F.col("part").alias("__part"), F.col("block").alias("__block"), F.col("local").alias("__local"), "ask")
    inside = (F.col("__local") >= F.col("before")) & (F.col("__local") < F.col("before") + F.col("weight"))
    found = r.rows.join(F.broadcast(met), (F.col("part") == F.col("__part")) & (F.col("block") == F.col("__block")) & inside)
    return found.select("ask.*", *[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in keep], (F.col("__local") - F.col("before")).cast(WEIGHT).alias("rest"))


def _among(r: Sorted, asks: DataFrame, keep: list[str], prefix: str, n: int) -> DataFrame:
    """_lookup by a sort of places and rows together.  A row lies in each stretch of its partition that it reaches into, so a sort holds a partition's rows and one stretch's places at most."""
    step = f"cast('{max(1, r.size // n * STRETCH)}' as {r.kind})"
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    rows = r.rows.select("part", F.col("before").alias("local"), row, F.explode(F.expr(f"sequence(before div {step}, (before + weight - 1) div {step})")).alias("stretch"))
    rows = rows.select("part", "stretch", "local", F.lit(0).alias("kind"), "row", F.lit(None).cast(asks.schema["ask"].dataType).alias("ask"))
    both = rows.unionByName(asks.select("part", F.expr(f"local div {step}").alias("stretch"), "local", F.lit(1).alias("kind"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), "ask"))
    last = F.last("row", ignorenulls=True).over(Window.partitionBy("part", "stretch").orderBy("local", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumn("row", last).where("kind = 1")
    return found.select("ask.*", *[F.col(f"row.`{c}`").alias(f"{prefix}{c}") for c in keep], (F.col("local") - F.col("row.before")).cast(WEIGHT).alias("rest"))


class Access:
    """The prepared relations of one join tree; use it for as many sets of positions as needed."""

    def __init__(self, spec: JoinSpec, root: str | None = None):
        if any(e.band is not None for e in spec.edges):
            raise ValueError("random access needs equi edges; sample the materialised join instead")
        self.spec, self.root = spec, root or next(iter(spec.relations))
        runtime.prepare(spec.relations[self.root].df.sparkSession)
        self.steps = spec.tree(self.root)
        self.sorted: dict[str, Sorted] = {}
        self.keys: dict[str, DataFrame] = {}
        self.most: dict[str, int] = {}
        self.size = 0
        # the same table in several leaf places is prepared once
        first: dict[tuple, str] = {}
        like = {}
        for s in self.steps:
            r = spec.relations[s.node]
            like[s.node] = first.setdefault((s.node,) if spec.children(self.steps, s.node) else (id(r.df), s.mine, r.rid, tuple(spec.used(s.node))), s.node)
        todo, done = [s for s in self.steps if like[s.node] == s.node], set()
        tables: dict[int, list[str]] = {}
        for name, r in spec.relations.items():
            tables.setdefault(id(r.df), []).append(name)
        with ThreadPoolExecutor(4) as pool:
            self.tables = {n: t for names, t in zip(tables.values(), pool.map(self._table, tables.values())) for n in names}
            while todo:
                ready = [s for s in todo if all(like[c.node] in done for c in spec.children(self.steps, s.node))]
                list(pool.map(self._prepare, ready))
                done |= {s.node for s in ready}
                todo = [s for s in todo if s.node not in done]
                for node, one in like.items():
                    if one in self.keys:
                        self.sorted[node], self.keys[node], self.most[node] = self.sorted[one], self.keys[one], self.most[one]

    def _table(self, names: list[str]) -> tuple[DataFrame, int]:
        """The table of one or more relations, made once, with its number of rows."""
        df = self.spec.relations[names[0]].df.select(*[f"`{c}`" for c in dict.fromkeys(c for n in names for c in self.spec.used(n))])
        df = df if runtime.plain(df) else runtime.stored(df)
        return df, df.count()

    def _prepare(self, s: Step) -> None:
        df, n = self.tables[s.node]
        df = df.select(*[f"`{c}`" for c in self.spec.used(s.node)])
        for m in s.mine:
            df = df.where(F.col(f"`{m}`").isNotNull())
        totals, most = [], 1
        for i, c in enumerate(self.spec.children(self.steps, s.node)):
            names = [f"__k{j}" for j in range(len(c.mine))]
            side = self.keys[c.node].toDF(*names, f"__base{i}", f"__all{i}")
            df = df.join(side, [F.col(f"`{p}`") == F.col(k) for p, k in zip(c.parents, names)]).drop(*names)
            totals.append(F.col(f"__all{i}"))
            most *= self.most[c.node]
        kind = "bigint" if most * max(n, 1) < 1 << 62 else WEIGHT  # a row of the table is one row here at most
        df = df.withColumn("weight", counting.product(totals, kind))
        order = list(dict.fromkeys([*s.mine, *self.spec.relations[s.node].rid]))
        r = self.sorted[s.node] = _running(df, order, partitions(df.sparkSession, n), kind, most == 1)
        if not s.parent:
            self.size = r.size
        else:
            keys = r.placed().groupBy(*[f"`{m}`" for m in s.mine]).agg(F.min("place").alias("base"), F.sum("weight").cast(kind).alias("all"))
            self.keys[s.node] = runtime.stored(keys)
            self.most[s.node] = int(self.keys[s.node].agg(F.max("all")).first()[0] or 1)

    def at(self, positions: DataFrame, position: str = "position") -> DataFrame:
        """Results at positions (a DataFrame with distinct integers; those outside [0, size) give nothing): position and the ids."""
        now = positions.select(F.col(position).alias("position"), F.col(position).cast(WEIGHT).alias("at")).where((F.col("at") >= 0) & (F.col("at") < F.lit(str(self.size)).cast(WEIGHT)))
        if not self.size:
            return self._nothing(now)
        out = self._descend(self.steps[0], now, now.count())  # every place has one row in each relation
        return out.select("position", *self.spec.ids())

    def every(self) -> DataFrame:
        """All results: position (bigint where it fits) and the ids.  An equi-join for each edge; no position is looked up."""
        if not self.size:
            return self._nothing(self.sorted[self.root].rows.sparkSession.range(0).toDF("position"))
        return self._expand(self.steps[0]).select(F.col("__place").cast("bigint" if self.size < 1 << 63 else WEIGHT).alias("position"), *self.spec.ids())

    def _expand(self, s: Step) -> DataFrame:
        """Results of s and all below: __place among them, __m0... (s's columns towards its parent), ids."""
        r, children = self.sorted[s.node], self.spec.children(self.steps, s.node)
        own = [F.col(f"`{c}`").alias(f"{s.node}__{c}") for c in self.spec.relations[s.node].rid]
        mine = [F.col(f"`{m}`").alias(f"__m{i}") for i, m in enumerate(s.mine)]
        towards = [F.col(f"`{p}`").alias(f"__p{i}_{j}") for i, c in enumerate(children) for j, p in enumerate(c.parents)]
        df = r.placed().select(F.col("place").alias("__place"), *mine, *own, *towards, *[f"__{x}{i}" for i in range(len(children)) for x in ("base", "all")])
        for i, c in enumerate(children):
            side = self._expand(c)
            side = side.toDF(*[f"__c{i}_{x}" if x.startswith("__") else x for x in side.columns])
            df = df.join(side, [F.col(f"__p{i}_{j}") == F.col(f"__c{i}___m{j}") for j in range(len(c.mine))])
            step = counting.product([F.col(f"__all{j}") for j in range(i + 1, len(children))], r.kind)
            df = df.withColumn("__place", (F.col("__place") + (F.col(f"__c{i}___place") - F.col(f"__base{i}")).cast(r.kind) * step).cast(r.kind))
        ids = [c for c in df.columns if not c.startswith("__")]
        return df.select("__place", *[f"__m{i}" for i in range(len(s.mine))], *[f"`{c}`" for c in ids])

    def _nothing(self, now: DataFrame) -> DataFrame:
        kinds = {f"{n}__{c}": r.df.schema[c].dataType for n, r in self.spec.relations.items() for c in r.rid}
        return now.select("position", *[F.lit(None).cast(kinds[c]).alias(c) for c in self.spec.ids()])

    def _descend(self, s: Step, now: DataFrame, n: int) -> DataFrame:
        """now: (…, at), n places in s; returns it with the ids of s and of all below."""
        carried = [c for c in now.columns if c != "at"]
        found = _lookup(self.sorted[s.node], now, "__r_", n)
        children = self.spec.children(self.steps, s.node)
        ids = [F.col(f"__r_{c}").alias(f"{s.node}__{c}") for c in self.spec.relations[s.node].rid]
        places: list[Column] = []
        rest = F.col("rest")
        for i in reversed(range(len(children))):
            total = F.col(f"__r___all{i}").cast(WEIGHT)
            places.insert(0, (F.col(f"__r___base{i}").cast(WEIGHT) + rest % total).cast(WEIGHT).alias(f"__at_{children[i].node}"))
            rest = F.floor((rest - rest % total) / total).cast(WEIGHT) if i else rest
        out = found.select(*carried, *ids, *places)
        if children:
            out = runtime.stored(out) if n > FEW else runtime.cut(out)
        for c in children:
            out = self._descend(c, out.withColumnRenamed(f"__at_{c.node}", "at"), n)
        return out


def positions(spark, k: int, n: int, seed: int | str = 42, replace: bool = False) -> DataFrame:
    """k drawn positions below n: (slot, position), or with replace=False (position), min(k, n) distinct ones.

    The draw is a function of the seed, and made by executors.  Without replacement, the first k distinct of a
    sequence of draws are taken; the sequence is long enough but for a chance below e^-50.  A k beyond n / 2 takes
    the k positions of least priority instead.
    """
    if replace:
        return spark.range(1, k + 1).select(F.col("id").alias("slot"), draw(seed, max(n, 1), "id").alias("position")).where(F.lit(n > 0))
    if 2 * k >= n:
        from .sampling import swor

        return swor(spark.range(n).toDF("position"), ["position"], k, seed)
    tries = draws_for(k, n)
    drawn = spark.range(1, tries + 1).select("id", draw(seed, n, "id").alias("position"))
    return drawn.groupBy("position").agg(F.min("id").alias("id")).orderBy("id").limit(k).select("position")


def draws_for(k: int, n: int) -> int:
    """Draws that give k distinct of n >= 2 k positions."""
    need = -n * math.log1p(-k / n) if k < n else k
    return int(need + 10 * math.sqrt(need + 1)) + 60


def sample(spec: JoinSpec, k: int, seed: int | str = 42, root: str | None = None, prepared: Access | None = None) -> DataFrame:
    """min(k, size) results without replacement, by their ids; the join is never materialised."""
    a = prepared or Access(spec, root)
    spark = spec.relations[a.root].df.sparkSession
    return a.at(positions(spark, k, a.size, seed)).drop("position")


def sample_with_replacement(spec: JoinSpec, k: int, seed: int | str = 42, root: str | None = None, prepared: Access | None = None) -> DataFrame:
    """k independent draws: (slot, ids)."""
    a = prepared or Access(spec, root)
    spark = spec.relations[a.root].df.sparkSession
    drawn = positions(spark, k, a.size, seed, replace=True)
    return drawn.join(a.at(drawn.select("position").distinct()), "position").drop("position")

"""Which rows are live: arrival prefixes, tumbling and sliding windows, deletion from the front.

Each is a filter on the inputs; joins, counts and samples over the filtered relations are
those of the reservoir after the same arrivals.  Time is an integer column (an epoch in any unit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from .sampling import PRIORITY, priority

#: The first so many rows of an order are found by keeping as many in each task.
FEW = 10_000


def prefix(df: DataFrame, seq: str, upto) -> DataFrame:
    """Rows that had arrived by ``upto``."""
    return df.where(F.col(seq) <= upto)


def checkpoints(df: DataFrame, seq: str, n: int, parts: int = 10) -> DataFrame:
    """(part, upto): the arrival numbers at which each tenth of n arrivals is reached (seq counts from 1)."""
    return df.sparkSession.range(1, parts + 1).select(F.col("id").cast("int").alias("part"), F.ceil(F.col("id") * n / parts).cast("bigint").alias("upto"))


def tumbling_start(ts: str | Column, size: int) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return (ts - F.pmod(ts, F.lit(size))).cast("bigint")


def tumbling(df: DataFrame, ts: str, size: int, now) -> DataFrame:
    """Rows of the window that holds ``now``, up to now."""
    start = now - now % size
    return df.where((F.col(ts) >= start) & (F.col(ts) <= now))


def sliding(df: DataFrame, ts: str, size: int, now) -> DataFrame:
    """Rows with now - size + 1 <= ts <= now."""
    return df.where(F.col(ts).between(now - size + 1, now))


def result_time(*ts: str) -> Column:
    """A result is as old as its oldest row."""
    return F.least(*[F.col(t) for t in ts]) if len(ts) > 1 else F.col(ts[0])


def pop_front(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """df without its n first rows (by order; rows of equal order go together with their ties broken by nothing else, so order should be unique).

    The last of the n is found as a bounded top-n, or by its position where n is large; the rest stays where it is.
    """
    if n <= 0:
        return df
    if n <= FEW:
        edge = df.select(*order).orderBy(*order).limit(n).agg(F.max(F.struct(*order)).alias("__edge"))
    else:
        from ..plans.spec import JoinSpec, Relation
        from . import access

        rows = access.Access(JoinSpec({"row": Relation(df, tuple(order))}, []))
        last = rows.at(df.sparkSession.createDataFrame([(min(n, rows.size) - 1,)], "position bigint"))
        edge = last.agg(F.max(F.struct(*[F.col(f"row__{c}").alias(c) for c in order])).alias("__edge"))
    return df.crossJoin(F.broadcast(edge)).where(F.struct(*order) > F.col("__edge")).drop("__edge")


def per_window_sample(df: DataFrame, window: str, ids: list[str], k: int, seed: int | str = 42) -> DataFrame:
    """k rows without replacement of each window; tasks keep k of each window before anything is shuffled."""
    row = F.struct(priority(seed, *ids).alias(PRIORITY), *ids, *[F.col(f"`{c}`") for c in df.columns if c not in ids])
    kept = df.groupBy(F.col(window).alias("__window")).agg(InternalFunction.collect_top_k(row, k, True).alias("__rows"))
    return kept.select(F.explode("__rows").alias("__row")).select(*[F.col(f"__row.`{c}`") for c in df.columns])

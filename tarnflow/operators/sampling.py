"""Samples of any DataFrame by hash priority.

Without replacement: the k rows with the least priority.  It has the law of a reservoir that
has seen all rows, is a function of the data and the seed, and merges over partitions and
micro-batches.  With ``n`` (the number of rows, which counting.size gives without the join)
only a sliver of rows just above k / n of the priorities is sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fraction_bound, priority, unit_below

PRIORITY = "__priority"


def sliver(k: int, n: int) -> float:
    """A share of n rows that holds k of them (but for a chance below e^-50)."""
    return min(1.0, (k + 10 * math.sqrt(k) + 60) / n) if n else 1.0


def swor(df: DataFrame, ids: list[str], k: int, seed: int | str = 42, n: int | None = None) -> DataFrame:
    """min(k, n) rows without replacement; ids identify a row (ties go by them, in order)."""
    if k < 0:
        raise ValueError("k >= 0")
    bound = None if n is None else fraction_bound(sliver(k, n))
    ranked = df.withColumn(PRIORITY, priority(seed, *ids))
    if bound is not None:
        ranked = ranked.where(F.col(PRIORITY) < bound)
    return ranked.orderBy(PRIORITY, *ids).limit(k).drop(PRIORITY)


def bernoulli(df: DataFrame, ids: list[str], p: float, seed: int | str = 42) -> DataFrame:
    """Each row with probability p, by itself; no shuffle."""
    if not 0 < p < 1:
        raise ValueError("0 < p < 1")
    return df.where(unit_below(p, seed, *ids))


def swr(df: DataFrame, ids: list[str], k: int, seed: int | str = 42) -> DataFrame:
    """k independent draws: (slot, columns of df).  Rows get positions once (by ids, then the other columns), and k of them are looked up."""
    if k < 1:
        raise ValueError("k >= 1")
    from ..plans.spec import JoinSpec, Relation
    from . import access

    columns = [*ids, *[c for c in df.columns if c not in ids]]
    found = access.sample_with_replacement(JoinSpec({"row": Relation(df, tuple(columns))}, []), k, seed)
    return found.select("slot", *[F.col(f"row__{c}").alias(c) for c in columns])


def where_baseline(df: DataFrame, ids: list[str], predicate: Column, k: int, seed: int | str = 42) -> DataFrame:
    """k of the rows that qualify; the predicate is evaluated on every row."""
    return swor(df.where(predicate), ids, k, seed)


def where_late(df: DataFrame, ids: list[str], predicate: Column, k: int, seed: int | str = 42, start: float | None = None, grow: int = 8) -> DataFrame:
    """The same sample, with the (expensive) predicate evaluated on few rows.

    Rows are taken in the order of their priority, in slivers that grow by a factor, until k of them qualify or none
    are left.  The first sliver holds about 4 k rows.
    """
    share = start if start is not None else min(1.0, 4 * (k + 10) / max(1, df.count()))
    ranked = df.withColumn(PRIORITY, priority(seed, *ids))
    while True:
        bound = fraction_bound(share)
        some = (ranked if bound is None else ranked.where(F.col(PRIORITY) < bound)).where(predicate)
        if bound is None or some.limit(k).count() >= k:
            return some.orderBy(PRIORITY, *ids).limit(k).drop(PRIORITY)
        share *= grow


def uniformity(samples: DataFrame, ids: list[str]) -> DataFrame:
    """Of many samples put together: how many results occur (n_results), and the most and fewest times that one does."""
    counts = samples.groupBy(*ids).agg(F.count(F.lit(1)).alias("k"))
    return counts.agg(F.count(F.lit(1)).alias("n_results"), F.max("k").alias("most"), F.min("k").alias("fewest"))

"""Exact sizes of joins without materialising them.

Bottom-up over the join tree: a leaf row weighs 1, any other row the product, over its
children, of the summed weights of the child rows that match; the size of the join is the sum
of the root's weights.  Each relation is aggregated by its join key once (with partial
aggregation on the map side) and joined with its parent, so the cost follows the inputs and
not the result.  Weights are DECIMAL(38,0); an overflow raises an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spec import WEIGHT, JoinSpec, Step


def product(columns: list[Column], kind: str = WEIGHT) -> Column:
    out = F.lit(1).cast(kind)
    for c in columns:
        out = (out * c.cast(kind)).cast(kind)
    return out


def _totals(df: DataFrame, keys: tuple[str, ...], weight: Column | None, to: list[str], name: str) -> DataFrame:
    """Sum of weights by key, the key columns renamed; null keys match nothing."""
    for k in keys:
        df = df.where(F.col(f"`{k}`").isNotNull())
    total = F.count(F.lit(1)).cast(WEIGHT) if weight is None else F.sum(weight).cast(WEIGHT)
    return df.groupBy(*[F.col(f"`{k}`").alias(t) for k, t in zip(keys, to)]).agg(total.alias(name))


def _band_totals(parent: DataFrame, step: Step, totals: DataFrame, to: list[str], name: str) -> DataFrame:
    """By each distinct parent key, the sum of the totals of the child keys in its band."""
    from .band import band_join

    own = [f"__p{i}" for i in range(len(step.parents))]
    keys = parent.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(step.parents, own)]).distinct()
    met = band_join(keys, totals, (own[-1], to[-1]), step.band, list(zip(own[:-1], to[:-1])))
    return met.groupBy(*own).agg(F.sum(name).cast(WEIGHT).alias(name)).toDF(*to, name)


def weighted(spec: JoinSpec, root: str, keep_zero: bool = False) -> DataFrame:
    """The root's rows (its ids and key columns) with ``weight``: the number of results that hold each row."""
    steps = spec.tree(root)
    return _weighted(spec, steps, root, keep_zero)


def _weighted(spec: JoinSpec, steps: list[Step], node: str, keep_zero: bool = False) -> DataFrame:
    df = spec.relations[node].df.select(*[f"`{c}`" for c in spec.used(node)])
    names = []
    for i, s in enumerate(spec.children(steps, node)):
        name = f"__w{i}"
        keys = [f"__k{i}_{j}" for j in range(len(s.mine))]
        df = df.join(child_totals(spec, steps, df, s, keys, name), [F.col(f"`{p}`") == F.col(k) for p, k in zip(s.parents, keys)], "left" if keep_zero else "inner").drop(*keys)
        names.append(name)
    if not names:
        return df.withColumn("weight", F.lit(1).cast(WEIGHT))
    weight = product([F.coalesce(F.col(n), F.lit(0).cast(WEIGHT)) if keep_zero else F.col(n) for n in names])
    return df.withColumn("weight", weight).drop(*names)


def child_totals(spec: JoinSpec, steps: list[Step], parent: DataFrame, s: Step, keys: list[str], name: str) -> DataFrame:
    if spec.children(steps, s.node):
        totals = _totals(_weighted(spec, steps, s.node), s.mine, F.col("weight"), keys, name)
    else:
        totals = _totals(spec.relations[s.node].df, s.mine, None, keys, name)
    return totals if s.band is None else _band_totals(parent, s, totals, keys, name)


def size(spec: JoinSpec, root: str | None = None, name: str = "join_size") -> DataFrame:
    """One row: the number of results (DECIMAL(38,0); 0 for an empty join)."""
    root = root or next(iter(spec.relations))
    return weighted(spec, root).agg(F.coalesce(F.sum("weight"), F.lit(0)).cast(WEIGHT).alias(name))


def delta_sizes(spec: JoinSpec, relation: str, name: str = "delta_size") -> DataFrame:
    """For each row of a relation, the number of results that hold it (what its arrival adds); 0 where there are none."""
    return weighted(spec, relation, keep_zero=True).select(*spec.relations[relation].rid, F.col("weight").alias(name))


def key_counts(spec: JoinSpec, root: str, node: str) -> DataFrame:
    """(key columns, cnt, bound): results of the subtree below root that hang on each key of node; bound: cnt rounded up to a power of two."""
    steps = spec.tree(root)
    s = next((s for s in steps if s.node == node and s.parent), None)
    if s is None or s.band is not None:
        raise ValueError("node must hang below root by an equi edge")
    counts = child_totals(spec, steps, spec.relations[s.parent].df, s, list(s.mine), "cnt")
    return counts.withColumn("bound", upper_bound(F.col("cnt")))


def updated_keys(spec: JoinSpec, root: str) -> DataFrame:
    """(node, n_keys): how many key counts each relation below root keeps up to date."""
    out = None
    for s in spec.tree(root)[1:]:
        one = key_counts(spec, root, s.node).agg(F.count(F.lit(1)).alias("n_keys")).select(F.lit(s.node).alias("node"), "n_keys")
        out = one if out is None else out.unionByName(one)
    return out


def propagations(spec: JoinSpec, root: str) -> DataFrame:
    """(node, n_propagations): how often a key count of each relation below root, rounded up to a power of two, changes until all rows have come.

    A change is what the rows above have to learn; a count c that grows one by one takes 1 + log2 of its rounded value of them.
    """
    out = None
    for s in spec.tree(root)[1:]:
        changes = F.lit(1) + F.when(F.col("bound") > 1, F.length(F.bin(F.col("bound") - 1))).otherwise(0)
        one = key_counts(spec, root, s.node).agg(F.coalesce(F.sum(changes), F.lit(0)).alias("n_propagations")).select(F.lit(s.node).alias("node"), "n_propagations")
        out = one if out is None else out.unionByName(one)
    return out


def upper_bound(cnt: Column) -> Column:
    """The least power of two that isn't below cnt (cnt below 2^62)."""
    c = cnt.cast("bigint")
    return F.when(c <= 1, c).otherwise(F.pow(F.lit(2.0), F.length(F.bin(c - 1))).cast("bigint"))

"""Rewrites of a join tree that shrink it: foreign-key collapse and grouping.

A table whose join columns are a key there can be looked up while its fact rows are read, so
both become one relation.  Keys are declared on edges and verified before they are used: a
declared key that doesn't hold is an error, not a silent loss of rows.  Rows whose
dimension is missing drop out as in the plain join, whatever the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime
from ..plans.spec import Edge, JoinSpec, Relation
from .access import partitions


class KeyViolation(ValueError):
    pass


def check_key(df: DataFrame, columns: tuple[str, ...], name: str) -> None:
    """Fails if columns repeat.  Hashes are compared first, in partitions of a bounded number of rows; values only where a hash repeats."""
    present = df.where(" and ".join(f"`{c}` is not null" for c in columns)).select(*[f"`{c}`" for c in columns])
    hashed = present.withColumn("__hash", F.xxhash64(*[f"`{c}`" for c in columns]))
    n = partitions(df.sparkSession, df.count())
    twice = hashed.select("__hash").repartition(n, "__hash").groupBy("__hash").count().where("count > 1").select("__hash")
    if twice.isEmpty():
        return
    repeated = hashed.join(twice, "__hash").groupBy(*[f"`{c}`" for c in columns]).count().where("count > 1").limit(1).collect()
    if repeated:
        raise KeyViolation(f"{columns} is no key of {name}: {repeated[0].asDict()} repeats")


def _once(spec: JoinSpec, names: set[str]) -> JoinSpec:
    """The spec with tables of names that take more than a read written once: the check of keys and the join both read them."""
    roles: dict[int, list[str]] = {}
    for n, r in spec.relations.items():
        roles.setdefault(id(r.df), []).append(n)
    relations = dict(spec.relations)
    for same in roles.values():
        df = spec.relations[same[0]].df
        if names & set(same) and not runtime.plain(df):
            made = runtime.stored(df.select(*[f"`{c}`" for c in dict.fromkeys(c for n in same for c in spec.used(n))]))
            relations |= {n: Relation(made, spec.relations[n].rid) for n in same}
    return JoinSpec(relations, spec.edges)


def merge(spec: JoinSpec, groups: list[list[str]], verify: bool = True) -> JoinSpec:
    """The spec with each group of connected relations as one, named by its first member; columns become relation__column.

    Result ids keep their values and names (they are taken from the merged rows).  With verify, declared keys of the
    edges inside groups are checked first.
    """
    home = {n: g[0] for g in groups for n in g}
    home |= {n: n for n in spec.relations if n not in home}
    inner = [e for e in spec.edges if home[e.left] == home[e.right]]
    if verify:
        spec = _once(spec, {n for e in inner if e.key for n in (e.left, e.right)})
        for e in inner:
            if e.key:
                on = e.on if e.key == "right" else tuple((b, a) for a, b in e.on)
                side = e.right if e.key == "right" else e.left
                check_key(spec.relations[side].df, tuple(b for _, b in on), side)
    relations: dict[str, Relation] = {}
    for h in dict.fromkeys(home[n] for n in spec.relations):
        members = [n for n in spec.relations if home[n] == h]
        part = JoinSpec({n: spec.relations[n] for n in [h, *[m for m in members if m != h]]}, [e for e in inner if home[e.left] == h])
        columns = list(dict.fromkeys(f"{n}__{c}" for n in members for c in spec.used(n)))
        relations[h] = Relation(part.results(h, columns), tuple(f"{n}__{c}" for n in members for c in spec.relations[n].rid))
    edges = []
    for e in spec.edges:
        if home[e.left] != home[e.right]:
            edges.append(Edge(home[e.left], home[e.right], tuple((f"{e.left}__{a}", f"{e.right}__{b}") for a, b in e.on), e.band))
    return JoinSpec(relations, edges)


def foreign_keys(spec: JoinSpec) -> list[list[str]]:
    """Groups that declared keys allow: every keyed table goes to the (one) relation that refers to it."""
    owner: dict[str, str] = {}
    for e in spec.edges:
        if e.key:
            table, by = (e.right, e.left) if e.key == "right" else (e.left, e.right)
            owner.setdefault(table, by)  # a table joins its first referrer only
    groups: dict[str, list[str]] = {}
    for n in spec.relations:
        top, seen = n, {n}
        while top in owner and owner[top] not in seen:
            top = owner[top]
            seen.add(top)
        groups.setdefault(top, []).append(n)
    return [[top, *[m for m in g if m != top]] for top, g in groups.items() if len(g) > 1]


def collapse(spec: JoinSpec, verify: bool = True) -> JoinSpec:
    """All foreign-key joins collapsed."""
    return merge(spec, foreign_keys(spec), verify)


def group(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Eager aggregation: rows that a join can't tell apart as one row with their number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).cast("decimal(38,0)").alias(name))


def through_groups(spec: JoinSpec, relation: str, keys: list[str], name: str = "group") -> JoinSpec:
    """The spec with a relation of its own for the distinct keys of ``relation``, between it and the rest.

    Rows that the rest of the join can't tell apart hang on one row of the new relation: weights are multiplied once for each
    group and not for each row, and a sample goes through the groups to their rows.  keys must hold the columns of all edges of the
    relation; a row with a null key joins nothing.  The results are the same, with the keys of their group beside.
    """
    df = spec.relations[relation].df
    for e in spec.edges:
        if relation in (e.left, e.right):
            own = [a for a, _ in e.on] if e.left == relation else [b for _, b in e.on]
            if missing := [c for c in own if c not in keys]:
                raise ValueError(f"keys lack {missing}")
    groups = Relation(df.select(*[f"`{k}`" for k in keys]).where(" and ".join(f"`{k}` is not null" for k in keys)).distinct(), tuple(keys))
    edges = [Edge(name, relation, tuple((k, k) for k in keys))]
    for e in spec.edges:
        edges.append(Edge(name if e.left == relation else e.left, name if e.right == relation else e.right, e.on, e.band))
    return JoinSpec({name: groups, **spec.relations}, edges)


def rename_ids(df: DataFrame) -> DataFrame:
    """Ids of a merged spec (group__relation__column) under the plain spec's names."""
    return df.toDF(*[c.split("__", 1)[1] if c.count("__") > 1 else c for c in df.columns])

"""A multi-way join as relations and edges."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.band import band_join

WEIGHT = "decimal(38,0)"


@dataclass(frozen=True)
class Relation:
    """df: any columns; rid: the columns that identify a row in samples (bag semantics if they repeat)."""

    df: DataFrame
    rid: tuple[str, ...]


@dataclass(frozen=True)
class Edge:
    """left.a = right.b for each pair of on; with band, the last pair matches when they differ by at most band.

    key: "left" or "right" says that that side's columns are a key there (the other side holds the foreign key).
    """

    left: str
    right: str
    on: tuple[tuple[str, str], ...]
    band: float | None = None
    key: str | None = None

    def seen_from(self, node: str) -> tuple[str, tuple[str, ...], tuple[str, ...]]:
        """(other side, columns of node, columns of the other)."""
        a, b = tuple(x for x, _ in self.on), tuple(x for _, x in self.on)
        return (self.right, a, b) if node == self.left else (self.left, b, a)


@dataclass(frozen=True)
class Step:
    node: str
    parent: str | None
    mine: tuple[str, ...] = ()
    parents: tuple[str, ...] = ()
    band: float | None = None


class JoinSpec:
    """Relations by name, and the edges between them; it must be a tree (connected, no cycle)."""

    def __init__(self, relations: dict[str, Relation], edges: list[Edge]):
        self.relations, self.edges = dict(relations), list(edges)
        for e in self.edges:
            for side, cols in ((e.left, [x for x, _ in e.on]), (e.right, [x for _, x in e.on])):
                if side not in self.relations:
                    raise ValueError(f"unknown relation {side}")
                if missing := [c for c in cols if c not in self.relations[side].df.columns]:
                    raise ValueError(f"{side} has no columns {missing}")
            if not e.on or e.left == e.right:
                raise ValueError("an edge joins two relations by at least one pair of columns")
        for name, r in self.relations.items():
            if missing := [c for c in r.rid if c not in r.df.columns]:
                raise ValueError(f"{name} has no columns {missing}")
        self.tree(next(iter(self.relations)))

    def tree(self, root: str) -> list[Step]:
        """Breadth-first steps from root; ValueError if the join isn't connected or has a cycle."""
        if root not in self.relations:
            raise ValueError(f"unknown relation {root}")
        steps, seen, todo, used = [Step(root, None)], {root}, deque([root]), set()
        while todo:
            node = todo.popleft()
            for i, e in enumerate(self.edges):
                if i in used or node not in (e.left, e.right):
                    continue
                used.add(i)
                other, mine, theirs = e.seen_from(node)
                if other in seen:
                    raise ValueError("the join graph has a cycle: declare a decomposition (see operators.cyclic) and join its parts")
                seen.add(other)
                todo.append(other)
                steps.append(Step(other, node, theirs, mine, e.band))
        if len(seen) < len(self.relations):
            raise ValueError(f"the join graph isn't connected: {sorted(set(self.relations) - seen)}")
        return steps

    def children(self, steps: list[Step], node: str) -> list[Step]:
        return [s for s in steps if s.parent == node]

    def where(self, **conditions: Column) -> "JoinSpec":
        """The spec with filters on named relations; they reach the scans."""
        return JoinSpec({n: replace(r, df=r.df.where(conditions[n])) if n in conditions else r for n, r in self.relations.items()}, self.edges)

    def used(self, name: str) -> list[str]:
        """Columns that name's edges and ids need."""
        cols = [x for e in self.edges for x, _ in e.on if e.left == name] + [x for e in self.edges for _, x in e.on if e.right == name]
        return list(dict.fromkeys([*self.relations[name].rid, *cols]))

    def ids(self) -> list[str]:
        """Names of the id columns in results: relation__column."""
        return [f"{n}__{c}" for n, r in self.relations.items() for c in r.rid]

    def results(self, root: str | None = None, columns: list[str] | None = None) -> DataFrame:
        """The join itself, columns named relation__column; by default the ids.  Catalyst prunes the rest."""
        steps = self.tree(root or next(iter(self.relations)))
        df: DataFrame | None = None
        for s in steps:
            side = self.relations[s.node].df
            side = side.select([F.col(f"`{c}`").alias(f"{s.node}__{c}") for c in side.columns])
            if df is None:
                df = side
                continue
            pairs = [(f"{s.parent}__{p}", f"{s.node}__{m}") for p, m in zip(s.parents, s.mine)]
            if s.band is not None:
                df = band_join(df, side, pairs[-1], s.band, pairs[:-1])
                continue
            on = None
            for p, m in pairs:
                on = (df[p] == side[m]) if on is None else on & (df[p] == side[m])
            df = df.join(side, on)
        return df.select(columns or self.ids())

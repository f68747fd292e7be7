"""Triangles and the dumbbell join (two triangles and an edge between them)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime
from ..plans.spec import Edge, JoinSpec, Relation


def triangles(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(a, b, c): all directed triangles a->b->c->a, each in all of its rotations; edges without repeats.

    Paths of two edges are made only around the corner of least degree (then least id), which bounds them by the
    number of edges to the power 1.5, whatever hubs there are; then the closing edge is looked up by both ends.
    """
    e = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).where("s is not null and d is not null").distinct()
    degree = e.select(F.col("s").alias("v")).union(e.select(F.col("d").alias("v"))).groupBy("v").count()
    rank = lambda v, r: degree.select(F.col("v").alias(v), F.struct("count", "v").alias(r))
    ranked = runtime.cut(e.join(rank("s", "rs"), "s").join(rank("d", "rd"), "d"))
    out = ranked.where("rs <= rd").select(F.col("s").alias("a"), F.col("d").alias("b"))
    into = ranked.where("rd <= rs").select(F.col("d").alias("a"), F.col("s").alias("c"))
    # a corner of a loop occurs twice in its triangle: one of the two rotations counts
    paths = out.join(into, "a").where("c <> a or (a = b and b = c)")
    closed = paths.join(e.select(F.col("s").alias("b"), F.col("d").alias("c")), ["b", "c"])
    turns = F.when(F.expr("a = b and b = c"), F.array(F.struct("a", "b", "c"))).otherwise(
        F.array(F.struct("a", "b", "c"), F.struct(F.col("b").alias("a"), F.col("c").alias("b"), F.col("a").alias("c")), F.struct(F.col("c").alias("a"), F.col("a").alias("b"), F.col("b").alias("c")))
    )
    return closed.select(F.explode(turns).alias("t")).select("t.a", "t.b", "t.c")


def dumbbell(edges: DataFrame, src: str = "src", dst: str = "dst") -> JoinSpec:
    """triangle (a, b, c) - edge (a, x) - triangle (x, y, z) as a chain over the materialised triangles; a is left__a."""
    t = runtime.cut(triangles(edges, src, dst))
    bridge = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    right = t.toDF("x", "y", "z")
    return JoinSpec(
        {"bridge": Relation(bridge, ("src", "dst")), "left": Relation(t, ("a", "b", "c")), "right": Relation(right, ("x", "y", "z"))},
        [Edge("bridge", "left", (("src", "a"),)), Edge("bridge", "right", (("dst", "x"),))],
    )


def triangles_of(ab: DataFrame, bc: DataFrame, ca: DataFrame) -> DataFrame:
    """(a, b, c) with (a, b) in the first, (b, c) in the second and (c, a) in the third relation (src, dst each); rows without repeats.

    Each edge (a, b) is extended on the side that has fewer rows for it, which bounds the paths by the number of edges to the power 1.5.
    """
    pair = lambda df, x, y: df.select(F.col("src").alias(x), F.col("dst").alias(y)).where(f"{x} is not null and {y} is not null").distinct()
    first, second, third = pair(ab, "a", "b"), pair(bc, "b", "c"), pair(ca, "c", "a")
    ranked = first.join(second.groupBy("b").agg(F.count(F.lit(1)).alias("at_b")), "b").join(third.groupBy("a").agg(F.count(F.lit(1)).alias("at_a")), "a")
    ranked = runtime.cut(ranked)
    by_b = ranked.where("at_b <= at_a").join(second, "b").join(third, ["c", "a"])
    by_a = ranked.where("at_b > at_a").join(third, "a").join(second, ["b", "c"])
    return by_b.select("a", "b", "c").union(by_a.select("a", "b", "c"))


def dumbbell_of(streams: list[DataFrame]) -> JoinSpec:
    """The dumbbell over seven relations: the three of either triangle, then the bridge."""
    left, right = runtime.cut(triangles_of(*streams[:3])), runtime.cut(triangles_of(*streams[3:6])).toDF("x", "y", "z")
    return JoinSpec(
        {"bridge": Relation(streams[6].select("src", "dst"), ("src", "dst")), "left": Relation(left, ("a", "b", "c")), "right": Relation(right, ("x", "y", "z"))},
        [Edge("bridge", "left", (("src", "a"),)), Edge("bridge", "right", (("dst", "x"),))],
    )

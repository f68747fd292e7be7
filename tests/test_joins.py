import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnflow.operators import access, collapse, counting, cyclic, sampling
from tarnflow.operators.band import band_join
from tarnflow.plans import named
from tarnflow.plans.spec import Edge, JoinSpec, Relation

EDGES = [(1, 2), (2, 3), (2, 1), (1, 1), (3, 9), (0, 1), (1, 0), (None, 1), (2, None)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src int, dst int").cache()


def brute_line(rows, k):
    return [c for c in itertools.product(rows, repeat=k) if all(a[1] is not None and a[1] == b[0] for a, b in zip(c, c[1:]))]


def brute_star(rows, k):
    return [c for c in itertools.product(rows, repeat=k) if all(c[0][0] is not None and c[0][0] == x[0] for x in c[1:])]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def flat(results):
    return sorted((tuple(x for e in r for x in e) for r in results), key=repr)


@pytest.mark.parametrize("k", [2, 3])
def test_line_and_star_results_sizes_and_positions(spark, edges, k):
    for make, brute in ((named.line, brute_line), (named.star, brute_star)):
        spec, want = make(edges, k), brute(EDGES, k)
        assert rows_of(spec.results()) == flat(want)
        for root in (f"g{k}", "g1"):
            assert int(counting.size(spec, root).first()[0]) == len(want)
        a = access.Access(spec)
        assert a.size == len(want)
        got = sorted(a.at(spark.range(-2, len(want) + 3).toDF("position")).collect(), key=lambda r: r[0])
        assert [r[0] for r in got] == list(range(len(want)))
        assert sorted((tuple(r[1:]) for r in got), key=repr) == flat(want)


def test_duplicate_rows_count_as_often_as_they_occur(spark):
    e = spark.createDataFrame([(1, 2), (1, 2), (2, 3)], "src int, dst int")
    assert int(counting.size(named.line(e, 2)).first()[0]) == 2
    a = access.Access(named.line(e, 2))
    assert a.at(spark.range(2).toDF("position")).count() == 2


def test_delta_sizes_and_key_counts(spark, edges):
    spec, all_ = named.line(edges, 3), brute_line(EDGES, 3)
    per = Counter(r[1] for r in all_)
    assert {(r[0], r[1]): int(r[2]) for r in counting.delta_sizes(spec, "g2").collect()} == {e: per.get(e, 0) for e in EDGES}
    counts = Counter(a[0] for a, _ in brute_line(EDGES, 2) if a[0] is not None)
    got = {r["src"]: (int(r["cnt"]), r["bound"]) for r in counting.key_counts(spec, "g1", "g2").collect()}
    assert {k: v[0] for k, v in got.items()} == dict(counts)
    assert all(c <= b < 2 * c and b & (b - 1) == 0 for c, b in got.values())


def test_weights_beyond_64_bits(spark):
    star = named.star(spark.range(2000).select(F.lit(1).alias("src"), F.col("id").alias("dst")), 7)
    assert int(counting.size(star).first()[0]) == 2000**7


def test_empty_join(spark):
    e = spark.createDataFrame([], "src int, dst int")
    spec = named.line(e, 3)
    assert int(counting.size(spec).first()[0]) == 0
    assert access.sample(spec, 5).count() == 0
    assert access.sample_with_replacement(spec, 5).count() == 0
    assert cyclic.triangles(e).count() == 0


@pytest.mark.parametrize("k", [0, 1, 4, 1000])
def test_sample_sizes(spark, edges, k):
    spec, want = named.line(edges, 3), flat(brute_line(EDGES, 3))
    for got in (access.sample(spec, k, 7), sampling.swor(spec.results(), spec.ids(), k, 7), sampling.swor(spec.results(), spec.ids(), k, 7, len(want))):
        got = rows_of(got)
        assert len(got) == len(set(got)) == min(k, len(want))
        assert set(got) <= set(want)


def test_with_replacement_and_bernoulli(spark, edges):
    spec, want = named.line(edges, 2), set(flat(brute_line(EDGES, 2)))
    got = access.sample_with_replacement(spec, 60, 3).collect()
    assert sorted(r["slot"] for r in got) == list(range(1, 61)) and {tuple(r[1:]) for r in got} <= want
    assert {tuple(r[1:]) for r in sampling.swr(spec.results(), spec.ids(), 40).collect()} <= want
    ids = spark.range(20000)
    assert 1700 < sampling.bernoulli(ids, ["id"], 0.1).count() < 2300
    with pytest.raises(ValueError):
        sampling.bernoulli(ids, ["id"], 1.0)


def test_samples_are_uniform(spark):
    n, k, repeat = 12, 4, 600
    df = spark.range(n)
    runs = spark.range(repeat).toDF("seed").crossJoin(df)
    from pyspark.sql import Window

    from tarnflow.functions import priority

    w = Window.partitionBy("seed").orderBy(priority("x", "seed", "id"))
    seen = {r[0]: r[1] for r in runs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("id").count().collect()}
    mean = repeat * k / n
    assert sum((seen.get(i, 0) - mean) ** 2 / (mean * (1 - k / n)) for i in range(n)) < 35  # chi-square, 11 degrees
    drawn = access.positions(spark, 6000, 12, 5, replace=True).groupBy("position").count().collect()
    assert sum((r[1] - 500) ** 2 / 500 for r in drawn) < 35
    u = sampling.uniformity(spark.createDataFrame([(1,), (1,), (2,)], "id int"), ["id"]).first()
    assert tuple(u) == (2, 2, 1)


def test_late_predicate_gives_the_same_sample_and_judges_fewer_rows(spark):
    df = spark.range(5000)
    for k, p in ((20, "id % 3 = 0"), (20, "id % 500 = 0"), (5, "id < 0")):
        late = rows_of(sampling.where_late(df, ["id"], F.expr(p), k))
        assert late == rows_of(sampling.where_baseline(df, ["id"], F.expr(p), k))


def test_cycles_and_gaps_are_rejected(spark, edges):
    r = Relation(edges, ("src",))
    with pytest.raises(ValueError, match="cycle"):
        JoinSpec({"a": r, "b": r, "c": r}, [Edge("a", "b", (("dst", "src"),)), Edge("b", "c", (("dst", "src"),)), Edge("c", "a", (("dst", "src"),))])
    with pytest.raises(ValueError, match="connected"):
        JoinSpec({"a": r, "b": r}, [])
    with pytest.raises(ValueError, match="columns"):
        JoinSpec({"a": r, "b": r}, [Edge("a", "b", (("nope", "src"),))])


def test_triangles_and_dumbbell(spark):
    rows = [(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 4), (1, 4), (7, 7), (7, 8), (8, 7), (9, 1), (3, 3), (2, 1), (1, 2)]
    e = spark.createDataFrame(rows, "src int, dst int")
    have = set(rows)
    tri = {(a, b, c) for (a, b) in have for (x, c) in have if x == b and (c, a) in have}
    assert rows_of(cyclic.triangles(e)) == sorted(tri)
    want = sorted((*l, *r) for l in tri for r in tri if (l[0], r[0]) in have)
    spec = cyclic.dumbbell(e.distinct())
    assert rows_of(spec.results(columns=["left__a", "left__b", "left__c", "right__x", "right__y", "right__z"])) == want
    assert int(counting.size(spec).first()[0]) == len(want)


def test_triangles_over_three_relations(spark):
    import random

    r = random.Random(4)
    parts = [[(r.randrange(8), r.randrange(8)) for _ in range(25)] + [(None, 1), (2, 2)] for _ in range(3)]
    x, y, z = (spark.createDataFrame(p, "src int, dst int") for p in parts)
    want = sorted({(a, b, d) for a, b in parts[0] for c, d in parts[1] for e, f in parts[2] if None not in (a, c, e) and b == c and d == e and f == a})
    assert rows_of(cyclic.triangles_of(x, y, z)) == want


def test_groups_keep_results(spark):
    fact = spark.createDataFrame([(i, i % 3 if i else None, i % 2) for i in range(9)], "f int, a int, b int")
    left, right = spark.createDataFrame([(10 + i, i % 3) for i in range(5)], "l int, a int"), spark.createDataFrame([(20 + i, i % 2) for i in range(4)], "r int, b int")
    spec = JoinSpec({"f": Relation(fact, ("f",)), "l": Relation(left, ("l",)), "r": Relation(right, ("r",))}, [Edge("f", "l", (("a", "a"),)), Edge("f", "r", (("b", "b"),))])
    grouped = collapse.through_groups(spec, "f", ["a", "b"])
    assert rows_of(grouped.results(columns=["f__f", "l__l", "r__r"])) == rows_of(spec.results())
    a = access.Access(grouped)
    got = a.at(spark.range(a.size).toDF("position")).select("f__f", "l__l", "r__r")
    assert rows_of(got) == rows_of(spec.results())
    with pytest.raises(ValueError, match="lack"):
        collapse.through_groups(spec, "f", ["a"])


def test_positions_beyond_64_bits(spark):
    star = named.star(spark.range(3000).select(F.lit(1).alias("src"), F.col("id").alias("dst")), 7)
    got = access.sample(star, 50, 3).collect()
    assert len({tuple(r) for r in got}) == 50 and all(0 <= r["g7__dst"] < 3000 for r in got)
    a = access.Access(star)
    n = 3000**7
    places = spark.createDataFrame([(str(p),) for p in (0, n - 1, n, 1234567890123456789012)], "p string").select(F.col("p").cast("decimal(38,0)").alias("position"))
    got = {int(r[0]): [r[f"g{i}__dst"] for i in range(1, 8)] for r in a.at(places).collect()}
    digits = lambda p: [p // 3000 ** (6 - i) % 3000 for i in range(7)]
    assert got == {p: digits(p) for p in (0, n - 1, 1234567890123456789012)}


def test_band_join_and_count(spark):
    import random

    r = random.Random(1)
    a = [(i, r.randrange(3), round(r.uniform(-5, 5), 2)) for i in range(80)] + [(99, 1, None)]
    b = [(i, r.randrange(3), round(r.uniform(-5, 5), 2)) for i in range(60)] + [(98, None, 1.0)]
    x, y = spark.createDataFrame(a, "i int, g int, v double"), spark.createDataFrame(b, "j int, h int, w double")
    for width in (0.0, 0.5, 3.0):
        want = sorted(((p[0], q[0]) for p in a for q in b if p[2] is not None and p[1] == q[1] and abs(p[2] - q[2]) <= width), key=repr)
        assert rows_of(band_join(x, y, ("v", "w"), width, [("g", "h")]).select("i", "j")) == want
        spec = JoinSpec({"x": Relation(x, ("i",)), "y": Relation(y, ("j",))}, [Edge("x", "y", (("g", "h"), ("v", "w")), band=width)])
        assert int(counting.size(spec).first()[0]) == len(want) and rows_of(spec.results()) == want
    with pytest.raises(ValueError, match="equi"):
        access.Access(spec)


def test_collapse_keeps_results_and_verifies_keys(spark):
    fact = spark.createDataFrame([(1, 10, 5), (2, 11, 5), (3, 12, 6), (4, None, 6)], "f int, d int, g int")
    dim = spark.createDataFrame([(10, 0), (11, 1), (12, 1)], "d int, band int")
    other = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "o int, band int")
    spec = JoinSpec({"f": Relation(fact, ("f",)), "d": Relation(dim, ("d",)), "o": Relation(other, ("o",))}, [Edge("f", "d", (("d", "d"),), key="right"), Edge("d", "o", (("band", "band"),))])
    small = collapse.collapse(spec)
    assert len(small.relations) == 2
    assert rows_of(collapse.rename_ids(small.results()).select("f__f", "d__d", "o__o")) == rows_of(spec.results())
    assert int(counting.size(small).first()[0]) == int(counting.size(spec).first()[0])
    broken = JoinSpec({**spec.relations, "d": Relation(dim.union(dim), ("d",))}, spec.edges)
    with pytest.raises(collapse.KeyViolation):
        collapse.collapse(broken)


def test_filters_reach_the_relation(spark, edges):
    from tarnflow.operators import filters

    spec = named.line(edges, 2).where(g1=filters.equal("src", 1), g2=filters.not_equal("dst", 0))
    want = flat([r for r in brute_line(EDGES, 2) if r[0][0] == 1 and r[1][1] is not None and r[1][1] != 0])
    assert rows_of(spec.results()) == want
    assert [r[0] for r in spark.range(10).where(filters.band("id", 5, 1)).collect()] == [4, 5, 6]


def test_many_places_are_sorted_among_rows_over_any_number_of_partitions(spark, monkeypatch):
    rows = [(1, i) for i in range(40)] + [(i, i + 1) for i in range(60)]
    e = spark.createDataFrame(rows, "src int, dst int").repartition(3)
    spec = named.line(e, 3)
    want = brute_line(rows, 3)
    few = dict((int(r[0]), tuple(r[1:])) for r in access.Access(spec).at(spark.range(len(want)).toDF("position")).collect())
    monkeypatch.setattr(access, "LEAST", 1)
    monkeypatch.setattr(access, "MOST", 7)
    monkeypatch.setattr(access, "BLOCK", 3)
    a = access.Access(spec)
    assert a.size == len(want) and len(a.sorted["g1"].bases) > 2 and a.sorted["g1"].kind == "bigint"
    assert {int(r[0]): tuple(r[1:]) for r in a.at(spark.range(len(want)).toDF("position")).collect()} == few
    monkeypatch.setattr(access, "FEW", 5)
    monkeypatch.setattr(access, "STRETCH", 2)
    assert {int(r[0]): tuple(r[1:]) for r in a.at(spark.range(len(want)).toDF("position")).collect()} == few
    assert {r[0]: tuple(r[1:]) for r in a.every().collect()} == few
    assert sorted(few.values()) == sorted(flat(want))


def test_every_result_of_a_tree_and_beyond_64_bits(spark, edges):
    spec = JoinSpec({n: Relation(edges, ("src", "dst")) for n in "abcd"}, [Edge("a", "b", (("src", "src"),)), Edge("a", "c", (("dst", "src"),)), Edge("c", "d", (("dst", "src"),))])
    for root in "ac":
        a = access.Access(spec, root)
        found = a.every().collect()
        assert sorted(r[0] for r in found) == list(range(a.size)) and a.size == spec.results().count()
        assert sorted(map(tuple, found)) == sorted((int(r[0]), *r[1:]) for r in a.at(spark.range(a.size).toDF("position")).collect())
    assert access.Access(named.line(edges.where("false"), 2)).every().count() == 0


def test_sums_of_weights_in_either_kind():
    from decimal import Decimal

    import pyarrow as pa

    for ahead in (0, 2**63 - 5, 2**64 - 3, 2**70 + 9):
        for weights in ([3, 1, 4], [2**61, 2**61, 2**61], [2**64, 1, 2**100]):
            before, after = access._summing()(pa.array([Decimal(0), *map(Decimal, weights)], pa.decimal128(38, 0))[1:], ahead)
            assert [int(x) for x in before.to_pylist()] == [ahead + sum(weights[:i]) for i in range(3)] and after == ahead + sum(weights)
    before, after = access._summing()(pa.array([3, 1, 4]), 10)
    assert before.to_pylist() == [10, 13, 14] and after == 18


def test_rows_of_weight_one_are_numbered_without_python(spark, monkeypatch):
    monkeypatch.setattr(access, "LEAST", 1)
    monkeypatch.setattr(access, "MOST", 10)
    df = spark.range(95).select((F.col("id") * 37 % 95).alias("id"), F.lit(1).cast("bigint").alias("weight"))
    monkeypatch.setattr(access, "BLOCK", 4)
    plain, ones = (access._running(df, ["id"], access.partitions(spark, 95), "bigint", x) for x in (False, True))
    assert plain.size == ones.size == 95 and len(ones.bases) > 5
    assert rows_of(plain.placed().select("id", "place", "before", "block", "head")) == rows_of(ones.placed().select("id", "place", "before", "block", "head"))
    assert [(r[0], r[1]) for r in ones.placed().select("id", "place").orderBy("id").collect()] == [(i, i) for i in range(95)]


def test_key_checks_group_a_bounded_number_of_rows_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(access, "MOST", 50)
    seen = []
    real = collapse.partitions
    monkeypatch.setattr(collapse, "partitions", lambda s, n: seen.append((n, real(s, n))) or seen[-1][1])
    good = spark.range(1000).selectExpr("id as a", "id % 7 as b", "if(id % 2 = 0, null, id) as c")
    collapse.check_key(good, ("a", "b"), "good")
    collapse.check_key(good, ("c",), "nulls are no keys")
    assert seen == [(1000, 20)] * 2
    with pytest.raises(collapse.KeyViolation, match="repeats"):
        collapse.check_key(good.union(good.limit(1)), ("a", "b"), "bad")

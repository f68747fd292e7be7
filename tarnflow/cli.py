"""Command line: samples of the named queries over tuple logs.

  python -m tarnflow.cli line_join 3 edges.txt 1000
  python -m tarnflow.cli qz_fk qz.dat 1000000 --out sample.parquet
  python -m tarnflow.cli line_join 3 edges.txt 0.001 --sampling bernoulli --reports --report-file report.txt
  python -m tarnflow.cli line_join 2 timed.txt 1000 --window sliding --window-size 3600 --window-column dst
  python -m tarnflow.cli line_join_update_time 4 edges.txt
  python -m tarnflow.cli predicate strings.txt 1000 "the word" 16
  python -m tarnflow.cli line_join_check 3 edges.txt 10 200

A name with _check repeats the sample under other seeds and reports how often results occur.
Each relation is read from its own stream, so that deletes and prefixes of one role don't touch another.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fuzzy_match
from .operators import access, collapse, counting, cyclic, sampling, windows
from .plans import named
from .plans.spec import JoinSpec, Relation
from .sources import log as tuple_log

GRAPHS = ("line_join", "star_join")
PLAIN = ("qx", "qx_fk", "qy", "qy_fk", "qz", "qz_fk", "qz_fk_group", "dumbbell", "line3_tree", "q10", "q10_fk_plan1", "q10_fk_plan2")
STRINGS = ("predicate", "predicate_baseline")
QX_SALE = (("ss_item_sk_with_ticket_number", "sr_item_sk_with_ticket_number"),)
SALE_ID = ("ss_item_sk_with_ticket_number",)
QZ_GROUP = ["i1__i_category_id", "hd1__hd_income_band_sk"]


def spec_of(query: str, log: DataFrame, n: int | None = None) -> JoinSpec:
    """The join spec of a query over a log."""
    if query == "line_join":
        return named.line(tuple_log.graph(log, n), n)
    if query == "star_join":
        return named.star(tuple_log.graph(log, n), n)
    if query == "line3_tree":
        return named.line(tuple_log.graph(log, 3), 3)
    if query == "dumbbell":
        return cyclic.dumbbell_of(tuple_log.graph(log, 7))
    base = query.split("_")[0]
    r = tuple_log.relations(log, base)
    if base == "qx":
        spec = named.qx(r["ss"], r["sr"], r["cs"], r["d1"], QX_SALE, date_dim2=r["d2"])
    elif base == "qy":
        spec = named.qy(r["ss"], r["c1"], r["hd1"], SALE_ID, r["c2"], r["hd2"])
    elif base == "qz":
        spec = named.qz(r["ss"], r["c1"], r["hd1"], r["i1"], SALE_ID, r["c2"], r["hd2"], r["i2"])
    else:
        spec = named.q10(r["message"], r["has_tag1"], r["tag1"], r["tag_class"], r["person1"], r["city"], r["country"], r["knows"], r["has_tag2"], r["tag2"], r["person2"])
    if query == "q10_fk_plan1":
        return collapse.merge(spec, named.Q10_PLAN1)
    if query == "q10_fk_plan2":
        return collapse.merge(spec, named.Q10_PLAN2)
    if "_fk" in query:
        spec = collapse.collapse(spec)
    return collapse.through_groups(spec, "ss", QZ_GROUP) if query == "qz_fk_group" else spec


def windowed(spec: JoinSpec, a: argparse.Namespace) -> JoinSpec:
    """The spec over the rows that are live in the window; its end is the latest time of any relation that has the column."""
    if not a.window:
        return spec
    timed = {n: r for n, r in spec.relations.items() if a.window_column in r.df.columns}
    if not timed or not a.window_size:
        raise ValueError("a window needs --window-size and a --window-column of some relation")
    latest = [r.df.agg(F.max(F.col(a.window_column).cast("bigint"))).first()[0] for r in timed.values()]
    now = max((t for t in latest if t is not None), default=0)
    keep = windows.tumbling if a.window == "tumbling" else windows.sliding
    return JoinSpec({n: Relation(keep(r.df, a.window_column, a.window_size, now), r.rid) if n in timed else r for n, r in spec.relations.items()}, spec.edges)


def take(spec: JoinSpec, a: argparse.Namespace, seed: int, prepared: access.Access | None = None) -> DataFrame:
    if a.sampling == "bernoulli":
        return sampling.bernoulli(spec.results(), spec.ids(), a.k, seed)
    if a.sampling == "swr":
        return access.sample_with_replacement(spec, int(a.k), seed, prepared=prepared)
    return access.sample(spec, int(a.k), seed, prepared=prepared)


def update_time(spec: JoinSpec, tuples: int) -> str:
    """The time that keeping all key counts (rooted at each relation, as arrivals in any of them need) takes for each tuple, the counts kept, and their changes."""
    began = time.perf_counter_ns()
    keys = sum(r["n_keys"] for root in spec.relations for r in counting.updated_keys(spec, root).collect())
    size = counting.size(spec).first()[0]
    spent = time.perf_counter_ns() - began
    moves = sum(r["n_propagations"] for root in spec.relations for r in counting.propagations(spec, root).collect())
    return f"join size = {size}\ntuples = {tuples}\nkey counts = {keys}\npropagations = {moves}\nupdate time = {spent // max(1, tuples)} ns per tuple"


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    known = [x + y for x in (*GRAPHS, *PLAIN, *STRINGS) for y in ("", "_check")] + ["line_join_update_time"]
    if not argv or argv[0] not in known:
        print(__doc__, "\nCommands:", ", ".join(known), file=sys.stderr)
        return 2
    command, rest = argv[0], argv[1:]
    query, check = command.removesuffix("_check").removesuffix("_update_time"), command.endswith("_check")
    p = argparse.ArgumentParser(prog=command)
    if query in GRAPHS:
        p.add_argument("n", type=int)
    p.add_argument("file")
    if not command.endswith("_update_time"):
        p.add_argument("k", type=float, help="sample size; with --sampling bernoulli the rate")
    if query in STRINGS:
        p.add_argument("string")
        p.add_argument("threshold", type=int)
    if check:
        p.add_argument("repeat", type=int)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--out", help="Parquet folder for the sample")
    if query not in STRINGS:
        p.add_argument("--sampling", choices=("swor", "swr", "bernoulli"), default="swor")
        p.add_argument("--window", choices=("tumbling", "sliding"))
        p.add_argument("--window-size", type=int)
        p.add_argument("--window-column", default="ts", help="integer column that holds the time")
        p.add_argument("--reports", action="store_true", help="a report at every marker of the log, over what had arrived by then")
    p.add_argument("--report-file")
    a = p.parse_args(rest)
    spark = spark or SparkSession.builder.appName("tarnflow").getOrCreate()
    lines: list[str] = []

    def say(line: str) -> None:
        print(line)
        lines.append(line)

    if query in STRINGS:
        rows = spark.read.text(a.file).withColumnRenamed("value", "line").where("line <> ''").withColumn("id", F.xxhash64("line"))
        how = sampling.where_late if query == "predicate" else sampling.where_baseline
        one = lambda seed: how(rows, ["id", "line"], fuzzy_match("line", F.lit(a.string), a.threshold), int(a.k), seed).select("line")
        ids = ["line"]
    else:
        log = tuple_log.read(spark, a.file)
        spec = windowed(spec_of(query, log, getattr(a, "n", None)), a)
        if command.endswith("_update_time"):
            say(update_time(spec, log.where("kind = 'insert'").count()))
            return finish(a, lines)
        if a.reports:
            began = time.perf_counter()
            for i, marker in enumerate(r["seq"] for r in log.where("kind = 'report'").orderBy("seq").select("seq").collect()):  # a row for each marker
                part = log.where(F.col("seq") < marker)
                so_far = windowed(spec_of(query, part, getattr(a, "n", None)), a)
                at = access.Access(so_far)
                n = take(so_far, a, a.seed, at).count()
                say(f"report {i + 1}: tuples = {part.where(F.col('kind') == 'insert').count()}, n_seen = {at.size}, size = {n}, ms = {int(1000 * (time.perf_counter() - began))}")
        prepared = access.Access(spec)
        one = lambda seed: take(spec, a, seed, prepared)
        ids = spec.ids()
        say(f"join size = {prepared.size}")
    if check:
        every = one(a.seed)
        for i in range(1, a.repeat):
            every = every.union(one(a.seed + i))
        say(str(sampling.uniformity(every, ids).first().asDict()))
        return finish(a, lines)
    sample = one(a.seed)
    if a.out:
        sample.write.mode("overwrite").parquet(a.out)
        sample = spark.read.parquet(a.out)
    say(f"size = {sample.count()}")
    return finish(a, lines)


def finish(a: argparse.Namespace, lines: list[str]) -> int:
    if a.report_file:
        with open(a.report_file, "w") as f:
            f.write("\n".join(lines) + "\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())

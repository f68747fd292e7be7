"""Registered queries of the join engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import edit_distance, fuzzy_match
from .operators import access, collapse, counting, cyclic, filters, sampling, windows
from .operators.band import band_join
from .plans import named
from .plans.spec import Edge, JoinSpec, Relation
from .runtime import prepare, table
from .sources import standins as S
from .sources.standins import G_SQL, SS_SQL
from .streaming import samples

Query = Callable[[SparkSession, str], DataFrame]
K, SEED = 1000, 42
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries["line3_sample"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def add(name: str, query: Query, sql: str) -> None:
    _queries[name], _sql[name] = query, sql


def prio(*columns: str, seed: int | str = SEED) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(columns)}))"


def best(columns: list[str], k: int = K) -> str:
    return f"order by {prio(*columns)}, {', '.join(columns)} limit {k}"


def as_long(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("bigint"))


# ---- line and star joins

LETTERS = "ABCDEFGH"


def line_columns(k: int) -> tuple[list[str], list[str]]:
    return [f"g{i}__src" for i in range(1, k + 1)] + [f"g{k}__dst"], list(LETTERS[: k + 1])


def line_results(spark: SparkSession, d: str, k: int) -> DataFrame:
    columns, letters = line_columns(k)
    return named.line(S.edges(spark, d), k).results(columns=columns).toDF(*letters)


def line_sql(k: int) -> str:
    what = ", ".join([f"g{i}.src as {LETTERS[i - 1]}" for i in range(1, k + 1)] + [f"g{k}.dst as {LETTERS[k]}"])
    return f"j as (select {what} from {' , '.join(f'g as g{i}' for i in range(1, k + 1))} where {' and '.join(f'g{i}.dst = g{i + 1}.src' for i in range(1, k))})"


def star_results(spark: SparkSession, d: str, k: int) -> DataFrame:
    columns = ["g1__src"] + [f"g{i}__dst" for i in range(1, k + 1)]
    return named.star(S.edges(spark, d), k).results(columns=columns).toDF(*LETTERS[: k + 1])


def star_sql(k: int) -> str:
    what = ", ".join(["g1.src as A"] + [f"g{i}.dst as {LETTERS[i]}" for i in range(1, k + 1)])
    return f"j as (select {what} from {', '.join(f'g as g{i}' for i in range(1, k + 1))} where {' and '.join(f'g1.src = g{i}.src' for i in range(2, k + 1))})"


def sized(spec: JoinSpec, root: str | None = None) -> DataFrame:
    return as_long(counting.size(spec, root), "join_size")


for _k in (2, 3, 4, 5):
    add(f"line{_k}_count", lambda s, d, k=_k: sized(named.line(S.edges(s, d), k), f"g{(k + 1) // 2}"), f"with {G_SQL}, {line_sql(_k)} select count(*) as join_size from j")


def drawn_sql(total: str, k: int = K, seed: int = SEED) -> str:
    """CTE pick(position): the first k distinct draws below the total (which must be at least 2 k)."""
    return (
        f"drawn as (select i, cast('0x' || substr(md5(concat_ws('|', '{seed}', i)), 1, 15) as bigint) % ({total}) as position from range(1, {4 * k} + 1) t(i)), "
        f"pick as (select position from drawn group by position order by min(i) limit {k})"
    )


def ranked_sql(order: list[str], columns: list[str]) -> str:
    """The picked results of j in an order; it ranks the whole join, which the queries never make."""
    return f"{drawn_sql('select count(*) from j')}, r as (select *, row_number() over (order by {', '.join(order)}) - 1 as position from j) select {', '.join(columns)} from r join pick using (position)"


def line_sample(spark: SparkSession, d: str, k: int) -> DataFrame:
    columns, letters = line_columns(k)
    return access.sample(named.line(S.edges(spark, d), k), K, SEED).select(*columns).toDF(*letters)


for _k in (3, 4):
    add(f"line{_k}_sample", lambda s, d, k=_k: line_sample(s, d, k), f"with {G_SQL}, {line_sql(_k)}, {ranked_sql(line_columns(_k)[1], line_columns(_k)[1])}")
for _k in (4, 5, 6, 7):
    add(f"star{_k}_count", lambda s, d, k=_k: sized(named.star(S.edges(s, d), k)), f"with {G_SQL}, n as (select src, count(*) as k from g group by src) select cast(sum(k ** {_k}) as bigint) as join_size from n" if _k > 4 else f"with {G_SQL}, {star_sql(_k)} select count(*) as join_size from j")


def star_sample(spark: SparkSession, d: str, k: int) -> DataFrame:
    found = access.sample(named.star(S.edges(spark, d), k), K, SEED)
    return found.select("g1__src", *[f"g{i}__dst" for i in range(1, k + 1)]).toDF(*LETTERS[: k + 1])


def star_pick(k: int) -> str:
    """The results of a source are all rows of k digits to the base of its degree."""
    digits = ", ".join(f"(r // (deg ** {k - 1 - i})::bigint) % deg as d{i}" for i in range(k))
    joins = " ".join(f"join e e{i} on e{i}.src = met.src and e{i}.at = met.d{i}" for i in range(k))
    what = ", ".join(["met.src as A"] + [f"e{i}.dst as {LETTERS[i + 1]}" for i in range(k)])
    return (
        f"e as (select src, dst, row_number() over (partition by src order by dst) - 1 as at from g), n as (select src, count(*) as deg from g group by src), "
        f"placed as (select src, deg, cast(sum(deg ** {k}) over (order by src rows unbounded preceding) - deg ** {k} as bigint) as lo from n), {drawn_sql(f'select cast(sum(deg ** {k}) as bigint) from n')}, "
        f"met as (select src, deg, r, {digits} from (select placed.*, pick.position - lo as r from pick asof join placed on pick.position >= placed.lo)) select {what} from met {joins}"
    )


for _k in (4, 5, 6):
    add(f"star{_k}_sample", lambda s, d, k=_k: star_sample(s, d, k), f"with {G_SQL}, {star_pick(_k)}")


# ---- direct access, deltas, bounds


def every(spark: SparkSession, n: int, step: int) -> DataFrame:
    return spark.range(0, n, step).toDF("position")


def line2_access(spark: SparkSession, d: str) -> DataFrame:
    """Every result of Line-2 by its position."""
    a = access.Access(named.line(S.edges(spark, d), 2))
    return a.every().select("position", *line_columns(2)[0]).toDF("position", *line_columns(2)[1])


add("line2_access", line2_access, f"with {G_SQL}, {line_sql(2)} select row_number() over (order by A, B, C) - 1 as position, A, B, C from j")


def swr_line3(spark: SparkSession, d: str) -> DataFrame:
    found = access.sample_with_replacement(named.line(S.edges(spark, d), 3), K, SEED)
    return found.select("slot", *line_columns(3)[0]).toDF("slot", *line_columns(3)[1])


add(
    "swr_line3", swr_line3,
    f"with {G_SQL}, {line_sql(3)}, r as (select *, row_number() over (order by A, B, C, D) - 1 as position from j), "
    f"drawn as (select i as slot, cast('0x' || substr(md5(concat_ws('|', '{SEED}', i)), 1, 15) as bigint) % (select count(*) from j) as position from range(1, {K} + 1) t(i)) select slot, A, B, C, D from drawn join r using (position)",
)

add("bernoulli_line3", lambda s, d: sampling.bernoulli(line_results(s, d, 3), list("ABCD"), 0.01, SEED), f"with {G_SQL}, {line_sql(3)} select * from j where {prio(*'ABCD')} < '{int(0.01 * 2**60):015x}'")

add(
    "line3_delta_sizes", lambda s, d: as_long(counting.delta_sizes(named.line(S.edges(s, d), 3), "g2"), "delta_size"),
    f"with {G_SQL}, i as (select dst, count(*) as k from g group by dst), o as (select src, count(*) as k from g group by src) select g.src, g.dst, cast(coalesce(i.k, 0) * coalesce(o.k, 0) as bigint) as delta_size from g left join i on i.dst = g.src left join o on o.src = g.dst",
)

add(
    "line3_key_counts", lambda s, d: as_long(counting.key_counts(named.line(S.edges(s, d), 3), "g1", "g2"), "cnt"),
    f"with {G_SQL}, c as (select g2.src, count(*) as cnt from g as g2 join g as g3 on g2.dst = g3.src group by g2.src) select src, cnt, cast(case when cnt <= 1 then cnt else 2 ** length(bin(cnt - 1)) end as bigint) as bound from c",
)

add(
    "line3_updated_keys", lambda s, d: counting.updated_keys(named.line(S.edges(s, d), 3), "g1"),
    f"with {G_SQL} select 'g2' as node, count(distinct g2.src) as n_keys from g g2 join g g3 on g2.dst = g3.src union all select 'g3', count(distinct src) from g",
)


add(
    "line3_propagations", lambda s, d: counting.propagations(named.line(S.edges(s, d), 3), "g1"),
    f"with {G_SQL}, c as (select 'g2' as node, count(*) as cnt from g g2 join g g3 on g2.dst = g3.src group by g2.src union all select 'g3', count(*) from g group by src)"
    " select node, cast(sum(1 + case when cnt > 1 then length(bin(cnt - 1)) else 0 end) as bigint) as n_propagations from c group by node",
)


def line3_tree_counts(spark: SparkSession, d: str) -> DataFrame:
    spec, out = named.line(S.edges(spark, d), 3), None
    for root in spec.relations:
        one = sized(spec, root).select(F.lit(root).alias("root"), "join_size")
        out = one if out is None else out.union(one)
    return out


add("line3_tree_counts", line3_tree_counts, f"with {G_SQL}, {line_sql(3)} select root, (select count(*) from j) as join_size from (values ('g1'), ('g2'), ('g3')) t(root)")


def line3_uniformity(spark: SparkSession, d: str) -> DataFrame:
    """20 samples with replacement, put together."""
    a = access.Access(named.line(S.edges(spark, d), 3))
    drawn = access.positions(spark, 20 * K, a.size, SEED, replace=True)
    return sampling.uniformity(drawn.join(a.at(drawn.select("position").distinct()), "position"), line_columns(3)[0])


add(
    "line3_uniformity", line3_uniformity,
    f"with {G_SQL}, {line_sql(3)}, drawn as (select cast('0x' || substr(md5(concat_ws('|', '{SEED}', i)), 1, 15) as bigint) % (select count(*) from j) as position from range(1, {20 * K} + 1) t(i)), "
    "c as (select count(*) as k from drawn group by position) select count(*) as n_results, max(k) as most, min(k) as fewest from c",
)

# ---- cyclic joins

TRIANGLES_SQL = "t as (select g1.src as a, g2.src as b, g3.src as c from g as g1 join g as g2 on g1.dst = g2.src join g as g3 on g2.dst = g3.src and g3.dst = g1.src)"
add("triangles", lambda s, d: cyclic.triangles(S.edges(s, d)), f"with {G_SQL}, {TRIANGLES_SQL} select a, b, c from t")
DUMBBELL = ["left__a", "left__b", "left__c", "right__x", "right__y", "right__z"]
add(
    "dumbbell_sample", lambda s, d: sampling.swor(cyclic.dumbbell(S.edges(s, d)).results(columns=DUMBBELL).toDF(*"abcxyz"), list("abcxyz"), K, SEED),
    f"with {G_SQL}, {TRIANGLES_SQL}, j as (select l.a, l.b, l.c, r.a as x, r.b as y, r.c as z from t l join g on l.a = g.src join t r on g.dst = r.a) select * from j {best(list('abcxyz'))}",
)
add("dumbbell_count", lambda s, d: sized(cyclic.dumbbell(S.edges(s, d))), f"with {G_SQL}, {TRIANGLES_SQL} select count(*) as join_size from t l join g on l.a = g.src join t r on g.dst = r.a")

# ---- QX

SALE = [a for a, _ in S.SALE]
QX_COLUMNS = [f"ss__{c}" for c in SALE] + ["cs__cs_order_number", "d1__d_date_sk", "d2__d_date_sk"]
QX_NAMES = [*SALE, "cs_order_number", "sold", "cs_sold"]
QX_IDS = [*SALE, "cs_order_number"]
QX_SQL = (
    f"{SS_SQL}, j as (select ss.ss_order, ss.ss_line, ss.ss_item_sk, ss.ss_supplier, ss.ss_quantity, o_orderkey as cs_order_number, ss.ss_sold_date_sk as sold, cast(o_orderdate as date) as cs_sold"
    " from ss join ss as sr on " + " and ".join(f"ss.{c} = sr.{c}" for c in SALE) + " join orders on sr.ss_customer_sk = o_custkey where sr.l_returnflag = 'R')"
)
add("qx_count", lambda s, d: sized(S.qx(s, d), "sr"), f"with {QX_SQL} select count(*) as join_size from j")
QX_PICK = f"with {QX_SQL}, {ranked_sql(QX_IDS, QX_NAMES)}"
add("qx_sample", lambda s, d: access.sample(S.qx(s, d), K, SEED, "sr").select(*QX_COLUMNS).toDF(*QX_NAMES), QX_PICK)


add("qx_fk_sample", lambda s, d: collapse.rename_ids(access.sample(collapse.collapse(S.qx(s, d)), K, SEED)).select(*QX_COLUMNS).toDF(*QX_NAMES), QX_PICK)

# ---- QY and QZ: too large to materialise beyond small inputs, hence by position

QY_COLUMNS, QY_NAMES = ["ss__ss_order", "c1__c_customer_sk", "hd2__hd_demo_sk", "c2__c_customer_sk"], ["ss_order", "c1", "hd2", "c2"]
QY_SQL = (
    "j as (select o_orderkey as ss_order, c1.c_custkey as c1, h2.n_nationkey as hd2, c2.c_custkey as c2 from orders join customer c1 on o_custkey = c1.c_custkey"
    " join nation h1 on c1.c_nationkey = h1.n_nationkey join nation h2 on h1.n_regionkey = h2.n_regionkey join customer c2 on c2.c_nationkey = h2.n_nationkey)"
)
QY_PICK = f"with {QY_SQL}, {drawn_sql('select count(*) from j')}, r as (select *, row_number() over (order by ss_order, hd2, c2) - 1 as position from j) select ss_order, c1, hd2, c2 from r join pick using (position)"
add("qy_count", lambda s, d: sized(S.qy(s, d)), f"with {QY_SQL} select count(*) as join_size from j")
add("qy_sample", lambda s, d: access.sample(S.qy(s, d), K, SEED).select(*QY_COLUMNS).toDF(*QY_NAMES), QY_PICK)
add("qy_fk_sample", lambda s, d: collapse.rename_ids(access.sample(collapse.collapse(S.qy(s, d)), K, SEED)).select(*QY_COLUMNS).toDF(*QY_NAMES), QY_PICK)

QZ_COLUMNS = [f"ss__{c}" for c in SALE] + ["i2__i_item_sk", "hd2__hd_demo_sk", "c2__c_customer_sk"]
QZ_NAMES = [*SALE, "i2", "hd2", "c2"]
QZ_BASE = (
    f"{SS_SQL}, region_customers as (select n_regionkey as region, n_nationkey as hd2, c_custkey as c2, row_number() over (partition by n_regionkey order by n_nationkey, c_custkey) - 1 as at from customer join nation on c_nationkey = n_nationkey),"
    " brand_items as (select p_brand as brand, p_partkey as i2, row_number() over (partition by p_brand order by p_partkey) - 1 as at from part),"
    " rw as (select region, count(*) as rw from region_customers group by region), bw as (select brand, count(*) as bw from brand_items group by brand),"
    f" sale as (select {', '.join('ss.' + c for c in SALE)}, p_brand as brand, n_regionkey as region, bw * rw as w, rw from ss join part on ss_item_sk = p_partkey join customer on ss_customer_sk = c_custkey"
    " join nation on c_nationkey = n_nationkey join rw on rw.region = n_regionkey join bw on bw.brand = p_brand)"
)
QZ_AT = (
    f", placed as (select *, cast(sum(w) over (order by {', '.join(SALE)} rows unbounded preceding) - w as bigint) as lo from sale),"
    f" met as (select pick.position, placed.*, pick.position - lo as r from pick asof join placed on pick.position >= placed.lo)"
)
QZ_OUT = " join brand_items b on b.brand = met.brand and b.at = r // rw join region_customers c on c.region = met.region and c.at = r % rw"
QZ_TOTAL = "select cast(sum(w) as bigint) from sale"
QZ_ALL = f"{', '.join(SALE)}, i2, hd2, c2"
QZ_COUNT_SQL = f"with {QZ_BASE} select cast(sum(w) as bigint) as join_size from sale"
QZ_PICK = f"with {QZ_BASE}, {drawn_sql(QZ_TOTAL)}{QZ_AT} select {QZ_ALL} from met{QZ_OUT}"


def qz_group_count(spark: SparkSession, d: str) -> DataFrame:
    """Sales that agree in category and income band are one row with a number before any product is made."""
    sales = JoinSpec({n: r for n, r in S.qz(spark, d).relations.items() if n in ("ss", "i1", "c1", "hd1")}, [e for e in S.qz(spark, d).edges if {e.left, e.right} <= {"ss", "i1", "c1", "hd1"}])
    middle = collapse.group(sales.results("ss", ["i1__i_category_id", "hd1__hd_income_band_sk"]).toDF("category", "income"), ["category", "income"], "n")
    items = collapse.group(S.item(spark, d).select(F.col("i_category_id").alias("category")), ["category"], "bw")
    right = S.customer(spark, d).join(S.household_demographics(spark, d), F.col("c_current_hdemo_sk") == F.col("hd_demo_sk")).select(F.col("hd_income_band_sk").alias("income"))
    groups = middle.join(items, "category").join(collapse.group(right, ["income"], "rw"), "income")
    return as_long(groups.agg(F.coalesce(F.sum(counting.product([F.col("n"), F.col("bw"), F.col("rw")])), F.lit(0)).alias("join_size")), "join_size")


def qz_access(spark: SparkSession, d: str) -> DataFrame:
    """K evenly spaced results."""
    a = access.Access(S.qz(spark, d))
    at = spark.range(K).select((F.col("id") * F.lit(a.size // K)).alias("position"))
    return a.at(at).select("position", *QZ_COLUMNS).toDF("position", *QZ_NAMES)


add("qz_count", lambda s, d: sized(S.qz(s, d)), QZ_COUNT_SQL)
add("qz_fk_count", lambda s, d: sized(collapse.collapse(S.qz(s, d))), QZ_COUNT_SQL)
add("qz_group_count", qz_group_count, QZ_COUNT_SQL)
add("qz_access", qz_access, f"with {QZ_BASE}, pick as (select i * (({QZ_TOTAL}) // {K}) as position from range({K}) t(i)){QZ_AT} select position, {QZ_ALL} from met{QZ_OUT}")
QZ_GROUPED = (
    f"member as (select {', '.join(SALE)}, brand, region, row_number() over (partition by brand, region order by {', '.join(SALE)}) - 1 as at from sale),"
    f" grp as (select brand, region, any_value(rw) as rw, any_value(w // rw) as bw, count(*) * any_value(w) as gw from sale group by brand, region), {drawn_sql(QZ_TOTAL)},"
    " placed as (select *, cast(sum(gw) over (order by brand, region rows unbounded preceding) - gw as bigint) as lo from grp),"
    " met as (select brand, region, bw, rw, pick.position - lo as r from pick asof join placed on pick.position >= placed.lo)"
    f" select {', '.join('m.' + c for c in SALE)}, i2, hd2, c2 from met join member m on m.brand = met.brand and m.region = met.region and m.at = r // (bw * rw)"
    " join brand_items b on b.brand = met.brand and b.at = (r // rw) % bw join region_customers c on c.region = met.region and c.at = r % rw"
)


def qz_fk_group_sample(spark: SparkSession, d: str) -> DataFrame:
    """Sales that agree in category and income band hang on one group, through which the sample goes to them."""
    grouped = collapse.through_groups(collapse.collapse(S.qz(spark, d)), "ss", ["i1__i_category_id", "hd1__hd_income_band_sk"])
    return collapse.rename_ids(access.sample(grouped, K, SEED, "group")).select(*QZ_COLUMNS).toDF(*QZ_NAMES)


add("qz_fk_sample", lambda s, d: collapse.rename_ids(access.sample(collapse.collapse(S.qz(s, d)), K, SEED)).select(*QZ_COLUMNS).toDF(*QZ_NAMES), QZ_PICK)
add("qz_fk_group_sample", qz_fk_group_sample, f"with {QZ_BASE}, {QZ_GROUPED}")
add("qz_sample", lambda s, d: access.sample(S.qz(s, d), K, SEED).select(*QZ_COLUMNS).toDF(*QZ_NAMES), QZ_PICK)

# ---- Q10

Q10_COLUMNS, Q10_NAMES = ["message__id", "tag1__id", "tag2__id", "person1__id", "person2__id"], ["message", "tag1", "tag2", "person1", "person2"]
Q10_SQL = (
    f"{G_SQL}, ht as (select distinct l_orderkey as message_id, l_partkey as tag_id from lineitem), j as (select o_orderkey as message, h1.tag_id as tag1, h2.tag_id as tag2, c.c_custkey as person1, g.dst as person2"
    " from orders join ht h1 on o_orderkey = h1.message_id join part t1 on h1.tag_id = t1.p_partkey join ht h2 on o_orderkey = h2.message_id join part t2 on h2.tag_id = t2.p_partkey join customer c on o_custkey = c.c_custkey"
    " join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey join g on c.c_custkey = g.src join customer p2 on g.dst = p2.c_custkey)"
)
Q10_PICK = f"with {Q10_SQL}, {ranked_sql(['message', 'tag1', 'tag2', 'person2'], Q10_NAMES)}"


def q10_sample(spec: JoinSpec) -> DataFrame:
    return collapse.rename_ids(access.sample(spec, K, SEED, "message")).select(*Q10_COLUMNS).toDF(*Q10_NAMES)


add("q10_count", lambda s, d: sized(S.q10(s, d)), f"with {Q10_SQL} select count(*) as join_size from j")
add("q10_sample", lambda s, d: q10_sample(S.q10(s, d)), Q10_PICK)
add("q10_fk1_sample", lambda s, d: q10_sample(collapse.merge(S.q10(s, d), named.Q10_PLAN1)), Q10_PICK)
add("q10_fk2_sample", lambda s, d: q10_sample(collapse.merge(S.q10(s, d), named.Q10_PLAN2)), Q10_PICK)

# ---- predicates, filters, bands

WORD, NEAR = "cold widget", 4
add("edit_distance", lambda s, d: table(s, d, "part").select("p_partkey", edit_distance("p_name", F.lit(WORD)).cast("bigint").alias("distance")), f"select p_partkey, levenshtein(p_name, '{WORD}') as distance from part")
PREDICATE_SQL = f"select p_partkey, p_name from part where levenshtein(p_name, '{WORD}') <= {NEAR} order by {prio('p_partkey')}, p_partkey limit 100"
add("predicate_sample", lambda s, d: sampling.where_late(table(s, d, "part").select("p_partkey", "p_name"), ["p_partkey"], fuzzy_match("p_name", F.lit(WORD), NEAR), 100, SEED), PREDICATE_SQL)
add("predicate_baseline_sample", lambda s, d: sampling.where_baseline(table(s, d, "part").select("p_partkey", "p_name"), ["p_partkey"], fuzzy_match("p_name", F.lit(WORD), NEAR), 100, SEED), PREDICATE_SQL)
add("swr_parts", lambda s, d: sampling.swr(table(s, d, "part").select("p_partkey"), ["p_partkey"], 20, SEED).select(F.col("slot").cast("bigint").alias("slot"), "p_partkey"), f"with r as (select p_partkey, row_number() over (order by p_partkey) - 1 as position from part) select slot, p_partkey from (select i as slot, cast('0x' || substr(md5(concat_ws('|', '{SEED}', i)), 1, 15) as bigint) % (select count(*) from part) as position from range(1, 21) t(i)) join r using (position)")


def filtered_line3_count(spark: SparkSession, d: str) -> DataFrame:
    spec = named.line(S.edges(spark, d), 3)
    return sized(spec.where(g1=filters.band("src", 60, 40), g2=filters.not_equal("dst", 7), g3=filters.present("dst") & ~filters.equal("src", 3)))


add("filtered_line3_count", filtered_line3_count, f"with {G_SQL} select count(*) as join_size from g g1 join g g2 on g1.dst = g2.src join g g3 on g2.dst = g3.src where abs(g1.src - 60) <= 40 and g2.dst <> 7 and g3.dst is not null and g3.src <> 3")

BAND = 25.0
BAND_SQL = f"from customer join supplier on c_nationkey = s_nationkey and abs(c_acctbal - s_acctbal) <= {BAND}"


def band_pairs(spark: SparkSession, d: str) -> DataFrame:
    return band_join(table(spark, d, "customer"), table(spark, d, "supplier"), ("c_acctbal", "s_acctbal"), BAND, [("c_nationkey", "s_nationkey")]).select("c_custkey", "s_suppkey")


def band_spec(spark: SparkSession, d: str) -> JoinSpec:
    return JoinSpec(
        {"o": Relation(table(spark, d, "orders"), ("o_orderkey",)), "c": Relation(table(spark, d, "customer"), ("c_custkey",)), "s": Relation(table(spark, d, "supplier"), ("s_suppkey",))},
        [Edge("o", "c", (("o_custkey", "c_custkey"),)), Edge("c", "s", (("c_nationkey", "s_nationkey"), ("c_acctbal", "s_acctbal")), band=BAND)],
    )


add("band_join", band_pairs, f"select c_custkey, s_suppkey {BAND_SQL}")
add("band_count", lambda s, d: sized(band_spec(s, d)), f"select count(*) as join_size {BAND_SQL} join orders on o_custkey = c_custkey")

# ---- windows, deletion, prefixes

DAY = 86400
E_SQL = "e as (select event_id, user_id, event_type, cast(epoch_us(ts) // 1000000 as bigint) as t from events)"


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("bigint").alias("t"))


def pairs(clicks: DataFrame, purchases: DataFrame, *also: str) -> DataFrame:
    a = clicks.select(F.col("event_id").alias("click"), F.col("user_id"), F.col("t").alias("t1"), *also)
    b = purchases.select(F.col("event_id").alias("purchase"), F.col("user_id"), F.col("t").alias("t2"), *also)
    return a.join(b, ["user_id", *also]).withColumn("t", windows.result_time("t1", "t2"))


def tumbling_sample(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("win", windows.tumbling_start("t", DAY))
    found = pairs(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "win").select("win", "click", "purchase")
    return windows.per_window_sample(found, "win", ["click", "purchase"], 5, SEED)


PAIR_SQL = "join b on a.user_id = b.user_id"
add(
    "tumbling_sample", tumbling_sample,
    f"with {E_SQL}, a as (select *, t - t % {DAY} as win from e where event_type = 'click'), b as (select *, t - t % {DAY} as win from e where event_type = 'purchase'), j as (select a.win, a.event_id as click, b.event_id as purchase from a {PAIR_SQL} and a.win = b.win)"
    f" select * from j qualify row_number() over (partition by win order by {prio('click', 'purchase')}, click, purchase) <= 5",
)


def latest(e: DataFrame) -> int:
    return e.agg(F.max("t")).first()[0] or 0


def tumbling_now_sample(spark: SparkSession, d: str) -> DataFrame:
    """What the reservoir holds at the last event: the window that is open then."""
    e = events(spark, d)
    live = windows.tumbling(e, "t", 7 * DAY, latest(e))
    return sampling.swor(pairs(live.where("event_type = 'click'"), live.where("event_type = 'purchase'")).select("click", "purchase", "t"), ["click", "purchase"], 100, SEED)


def sliding_sample(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    live = windows.sliding(e, "t", 3 * DAY, latest(e))
    return sampling.swor(pairs(live.where("event_type = 'click'"), live.where("event_type = 'purchase'")).select("click", "purchase", "t"), ["click", "purchase"], 100, SEED)


def live_sql(condition: str) -> str:
    return (
        f"with {E_SQL}, m as (select max(t) as now from e), live as (select e.* from e, m where {condition}), a as (select * from live where event_type = 'click'), b as (select * from live where event_type = 'purchase'),"
        f" j as (select a.event_id as click, b.event_id as purchase, least(a.t, b.t) as t from a {PAIR_SQL}) select * from j {best(['click', 'purchase'], 100)}"
    )


add("tumbling_now_sample", tumbling_now_sample, live_sql(f"t >= now - now % {7 * DAY} and t <= now"))
add("sliding_sample", sliding_sample, live_sql(f"t >= now - {3 * DAY} + 1 and t <= now"))


def popfront_sample(spark: SparkSession, d: str) -> DataFrame:
    """After the 100 oldest clicks and the 50 oldest purchases are gone."""
    e = events(spark, d)
    a = windows.pop_front(e.where("event_type = 'click'"), ["t", "event_id"], 100)
    b = windows.pop_front(e.where("event_type = 'purchase'"), ["t", "event_id"], 50)
    return sampling.swor(pairs(a, b).select("click", "purchase", "t"), ["click", "purchase"], 100, SEED)


def popped_sql(kind: str, n: int) -> str:
    return f"(select * exclude k from (select *, row_number() over (order by t, event_id) as k from e where event_type = '{kind}') where k > {n})"


add("popfront_sample", popfront_sample, f"with {E_SQL}, a as {popped_sql('click', 100)}, b as {popped_sql('purchase', 50)}, j as (select a.event_id as click, b.event_id as purchase, least(a.t, b.t) as t from a {PAIR_SQL}) select * from j {best(['click', 'purchase'], 100)}")


def prefix_counts(spark: SparkSession, d: str) -> DataFrame:
    """The size of Line-3 after each tenth of the orders has arrived (by o_orderkey), in one plan: the tenth is part of every key."""
    n = table(spark, d, "customer").agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, d, "orders")
    g = o.crossJoin(F.broadcast(n)).select(F.col("o_custkey").alias("src"), ((F.col("o_orderkey") * 7919 + 13) % F.col("n")).alias("dst"), "o_orderkey").groupBy("src", "dst").agg(F.min("o_orderkey").alias("seq"))
    marks = windows.checkpoints(o, "o_orderkey", table(spark, d, "orders").count())
    edges = g.join(F.broadcast(marks), F.col("seq") < F.col("upto")).select("part", "src", "dst")
    r = Relation(edges, ("part", "src", "dst"))
    spec = JoinSpec({"g1": r, "g2": r, "g3": r}, [Edge("g1", "g2", (("part", "part"), ("dst", "src"))), Edge("g2", "g3", (("part", "part"), ("dst", "src")))])
    return as_long(counting.weighted(spec, "g2").groupBy("part").agg(F.sum("weight").alias("join_size")), "join_size")


add(
    "prefix_counts", prefix_counts,
    "with g as (select o_custkey as src, (o_orderkey * 7919 + 13) % (select count(*) from customer) as dst, min(o_orderkey) as seq from orders group by all),"
    " j as (select greatest(g1.seq, g2.seq, g3.seq) as seq from g g1 join g g2 on g1.dst = g2.src join g g3 on g2.dst = g3.src), m as (select cast(i as integer) as part, cast(ceil(i * (select count(*) from orders) / 10.0) as bigint) as upto from range(1, 11) t(i))"
    " select part, count(*) as join_size from j join m on seq < upto group by part",
)


# ---- streams


def stream_sample(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream, its sample merged batch by batch."""
    prepare(spark)
    source = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")
    return samples.sample_stream(source.select("event_id", "user_id", "event_type"), ["event_id"], K, SEED)


def stream_join_sample(spark: SparkSession, d: str) -> DataFrame:
    """The orders as a stream, joined with the static rest of QX's right side; the sample of all results so far."""
    prepare(spark)
    source = spark.readStream.schema(table(spark, d, "orders").schema).parquet(f"{d}/order[s].parquet").select("o_orderkey", "o_custkey")
    static = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("quantity"))
    joined = source.join(static, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")
    return samples.sample_stream(joined, ["o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "quantity"], K, SEED)


def stream_line3_sample(spark: SparkSession, d: str) -> DataFrame:
    """Three copies of the graph arrive as one shuffled stream of tuples, in several batches; the sample of Line-3 is kept up to date."""
    from .sources import log, prep

    streams = [("g1", log.GRAPH), ("g2", log.GRAPH), ("g3", log.GRAPH)]
    state = samples.StreamJoin(spark, streams, lambda r: named.line([r["g1"], r["g2"], r["g3"]], 3), K, SEED)
    tuples = prep.graph_streams(S.edges(spark, d), 3)
    lines = tuples.repartitionByRange(4, "shuffle").sortWithinPartitions("shuffle").select(F.concat(F.col("sid").cast("string"), F.lit("|1,"), F.col("src").cast("string"), F.lit(","), F.col("dst").cast("string")).alias("value"))
    lines.write.text(f"{state.folder}/log")
    source = spark.readStream.option("maxFilesPerTrigger", 1).text(f"{state.folder}/log").select(*log.fields("value")).where("kind = 'insert'")
    source.writeStream.foreachBatch(state).option("checkpointLocation", f"{state.folder}/progress").trigger(availableNow=True).start().awaitTermination()
    # priorities here come from all ids of the spec
    return state.current.select(*[F.col(c).cast("bigint") for c in line_columns(3)[0]]).toDF(*line_columns(3)[1])


def stream_window_sample(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream: five of each day, given out once the watermark has passed the day."""
    import uuid

    prepare(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/days-{uuid.uuid4().hex}"
    source = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    days = samples.sample_per_window(source, "ts", "1 day", "0 seconds", ["event_id"], 5, SEED)
    days.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(days.schema).parquet(f"{folder}/out")
    return found.select(F.unix_seconds("window.start").alias("win"), F.explode("sample").alias("row")).select("win", "row.event_id")


add(
    "stream_window_sample", stream_window_sample,
    f"with {E_SQL}, w as (select event_id, t - t % {DAY} as win from e), m as (select max(epoch_us(ts)) // 1000 as now from events)"
    f" select win, event_id from w, m where (win + {DAY}) * 1000 <= now qualify row_number() over (partition by win order by {prio('event_id')}, event_id) <= 5",
)
add("stream_line3_sample", stream_line3_sample, f"with {G_SQL}, {line_sql(3)} select * from j order by {prio('A', 'B', 'B', 'C', 'C', 'D')}, A, B, C, D limit {K}")
add("stream_sample", stream_sample, f"select event_id, user_id, event_type from events {best(['event_id'])}")
add(
    "stream_join_sample", stream_join_sample,
    f"with j as (select o_orderkey, o_custkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as integer) as quantity from orders join lineitem on o_orderkey = l_orderkey where l_returnflag = 'R') select * from j {best(['o_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey', 'quantity'])}",
)

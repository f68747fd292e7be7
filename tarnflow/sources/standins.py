"""The relations of the named queries, made from the star-schema test tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import named
from ..plans.spec import JoinSpec
from ..runtime import table

#: Five columns identify a lineitem row; order and line number alone repeat.
SALE = (("ss_order", "sr_order"), ("ss_line", "sr_line"), ("ss_item_sk", "sr_item_sk"), ("ss_supplier", "sr_supplier"), ("ss_quantity", "sr_quantity"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst): a graph between customers."""
    n = table(spark, d, "customer").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "orders").crossJoin(F.broadcast(n)).select(F.col("o_custkey").alias("src"), ((F.col("o_orderkey") * 7919 + 13) % F.col("n")).alias("dst")).distinct()


def store_sales(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return items.select(
        F.col("l_orderkey").alias("ss_order"), F.col("l_linenumber").alias("ss_line"), F.col("l_partkey").alias("ss_item_sk"), F.col("l_suppkey").alias("ss_supplier"),
        F.col("l_quantity").cast("int").alias("ss_quantity"), F.col("o_custkey").alias("ss_customer_sk"), F.to_date("o_orderdate").alias("ss_sold_date_sk"), "l_returnflag",
    )


def store_returns(spark: SparkSession, d: str) -> DataFrame:
    return store_sales(spark, d).where("l_returnflag = 'R'").select(*[F.col(a).alias(b) for a, b in SALE], F.col("ss_customer_sk").alias("sr_customer_sk"))


def catalog_sales(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("cs_order_number"), F.col("o_custkey").alias("cs_bill_customer_sk"), F.to_date("o_orderdate").alias("cs_sold_date_sk"))


def date_dim(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.to_date("o_orderdate").alias("d_date_sk")).distinct()


def customer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("c_customer_sk"), F.col("c_nationkey").alias("c_current_hdemo_sk"))


def household_demographics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("hd_demo_sk"), F.col("n_regionkey").alias("hd_income_band_sk"))


def item(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("i_item_sk"), F.col("p_brand").alias("i_category_id"))


def qx(spark: SparkSession, d: str) -> JoinSpec:
    return named.qx(store_sales(spark, d), store_returns(spark, d), catalog_sales(spark, d), date_dim(spark, d), SALE, cs_id=("cs_order_number",))


def qy(spark: SparkSession, d: str) -> JoinSpec:
    sales = table(spark, d, "orders").select(F.col("o_orderkey").alias("ss_order"), F.col("o_custkey").alias("ss_customer_sk"))
    return named.qy(sales, customer(spark, d), household_demographics(spark, d), ("ss_order",))


def qz(spark: SparkSession, d: str) -> JoinSpec:
    return named.qz(store_sales(spark, d), customer(spark, d), household_demographics(spark, d), item(spark, d), tuple(a for a, _ in SALE))


def q10(spark: SparkSession, d: str) -> JoinSpec:
    part = table(spark, d, "part")
    return named.q10(
        table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("creator_person_id")),
        table(spark, d, "lineitem").select(F.col("l_orderkey").alias("message_id"), F.col("l_partkey").alias("tag_id")).distinct(),
        part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("type_tag_class_id")),
        part.select(F.col("p_brand").alias("id")).distinct(),
        table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("location_city_id")),
        table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("part_of_place_id")),
        table(spark, d, "region").select(F.col("r_regionkey").alias("id")),
        edges(spark, d).toDF("person1_id", "person2_id"),
    )


G_SQL = "g as (select distinct o_custkey as src, (o_orderkey * 7919 + 13) % (select count(*) from customer) as dst from orders)"

SS_SQL = (
    "ss as (select l_orderkey as ss_order, l_linenumber as ss_line, l_partkey as ss_item_sk, l_suppkey as ss_supplier, cast(l_quantity as integer) as ss_quantity,"
    " o_custkey as ss_customer_sk, cast(o_orderdate as date) as ss_sold_date_sk, l_returnflag from lineitem join orders on l_orderkey = o_orderkey)"
)

"""The driver's tables as a call graph: regions call nations, nations customers, customers
orders, orders parts, parts suppliers, and suppliers nations, so the graph is cyclic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CUTOFF = "1999-01-01"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sym(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def _orders(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return orders.where(F.col("o_orderdate") < F.lit(CUTOFF).cast("timestamp_ntz")) if side == "before" else orders


def call_rows(spark: SparkSession, sf_dir: str, side: str = "after") -> DataFrame:
    """(caller, callee, pos): every call with what orders it in its caller; repeats stay."""
    t = lambda n: load(spark, sf_dir, n)
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    if side == "before":
        lines = lines.join(_orders(spark, sf_dir, side), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    parts = [
        t("nation").select(sym("region", "n_regionkey").alias("caller"), sym("nation", "n_nationkey").alias("callee"), F.col("n_nationkey").cast("long").alias("pos")),
        t("customer").select(sym("nation", "c_nationkey"), sym("customer", "c_custkey"), "c_custkey"),
        _orders(spark, sf_dir, side).select(sym("customer", "o_custkey"), sym("order", "o_orderkey"), "o_orderkey"),
        lines.select(sym("order", "l_orderkey"), sym("part", "l_partkey"), (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey"))),
        lines.select(sym("part", "l_partkey"), sym("supplier", "l_suppkey"), "l_suppkey").distinct(),
        t("supplier").select(sym("supplier", "s_suppkey"), sym("nation", "s_nationkey"), F.lit(0).cast("long")),
    ]
    return reduce(DataFrame.union, parts)


def edges(spark: SparkSession, sf_dir: str, side: str = "after") -> DataFrame:
    """(src, dst), distinct."""
    return call_rows(spark, sf_dir, side).select(F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct()


def functions(spark: SparkSession, sf_dir: str, side: str = "after") -> DataFrame:
    """(sym, kind, name, label, file, sl, public): one row per node that has a row of its own."""
    t = lambda n: load(spark, sf_dir, n)
    parts = [
        t("region").select(F.lit("region").alias("kind"), F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("name")),
        t("nation").select(F.lit("nation"), F.col("n_nationkey").cast("long"), "n_name"),
        t("customer").select(F.lit("customer"), F.col("c_custkey").cast("long"), "c_name"),
        t("supplier").select(F.lit("supplier"), F.col("s_suppkey").cast("long"), "s_name"),
        t("part").select(F.lit("part"), F.col("p_partkey").cast("long"), "p_name"),
        _orders(spark, sf_dir, side).select(F.lit("order"), F.col("o_orderkey").cast("long"), F.concat(F.lit("Order#"), F.col("o_orderkey"))),
    ]
    rows = reduce(DataFrame.union, parts)
    return rows.select(
        F.concat_ws(":", "kind", F.col("k").cast("string")).alias("sym"), "kind", "name", F.concat("name", F.lit("()")).alias("label"), F.concat("kind", F.lit("s.rs")).alias("file"), F.col("k").cast("int").alias("sl"), (F.col("kind") != "order").alias("public")
    )


def calls(spark: SparkSession, sf_dir: str, side: str = "after") -> DataFrame:
    """IR calls (caller, ord, target_tag, target, label) in source order; the row itself breaks ties."""
    rows = call_rows(spark, sf_dir, side)
    order = Window.partitionBy("caller").orderBy("pos", "callee")
    return rows.select(
        "caller", (F.row_number().over(order) - 1).alias("ord"), F.lit("direct").alias("target_tag"), F.col("callee").alias("target"), F.concat("callee", F.lit("()")).alias("label")
    )


EDGES_SQL = f"""
orders_of(side, o_orderkey, o_custkey) as (
  select 'after', o_orderkey, o_custkey from orders union all select 'before', o_orderkey, o_custkey from orders where o_orderdate < timestamp '{CUTOFF}'
), lines_of as (
  select 'after' as side, l_orderkey, l_partkey, l_suppkey, l_linenumber from lineitem
  union all select 'before', l_orderkey, l_partkey, l_suppkey, l_linenumber from lineitem where l_orderkey in (select o_orderkey from orders_of where side = 'before')
), sides(side) as (values ('before'), ('after')
), call_rows(side, caller, callee, pos) as (
  select side, 'region:' || n_regionkey, 'nation:' || n_nationkey, n_nationkey::bigint from nation, sides
  union all select side, 'nation:' || c_nationkey, 'customer:' || c_custkey, c_custkey from customer, sides
  union all select side, 'customer:' || o_custkey, 'order:' || o_orderkey, o_orderkey from orders_of
  union all select side, 'order:' || l_orderkey, 'part:' || l_partkey, l_linenumber::bigint * 1000000000 + l_partkey from lines_of
  union all select distinct side, 'part:' || l_partkey, 'supplier:' || l_suppkey, l_suppkey from lines_of
  union all select side, 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 0 from supplier, sides
), edges as (select distinct side, caller as src, callee as dst from call_rows
), functions(side, sym, kind, name) as (
  select side, 'region:' || r_regionkey, 'region', r_name from region, sides
  union all select side, 'nation:' || n_nationkey, 'nation', n_name from nation, sides
  union all select side, 'customer:' || c_custkey, 'customer', c_name from customer, sides
  union all select side, 'supplier:' || s_suppkey, 'supplier', s_name from supplier, sides
  union all select side, 'part:' || p_partkey, 'part', p_name from part, sides
  union all select side, 'order:' || o_orderkey, 'order', 'Order#' || o_orderkey from orders_of
), calls as (
  select side, caller, callee as target, row_number() over (partition by side, caller order by pos, callee) - 1 as ord from call_rows
)"""

"""Panels and cross-sections made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ROWS_A_TASK = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by year: even ones are treated from 1998 on; cohorts by the key's remainder by 4."""
    line = table(spark, sf_dir, "lineitem")
    key = F.col("l_suppkey")
    panel = line.groupBy(key.alias("entity_id"), F.year("l_shipdate").alias("year")).agg(
        F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("y"),
        F.avg("l_quantity").alias("quantity"),
        F.avg("l_discount").alias("discount"),
    )
    rest = F.col("entity_id") % 4
    return panel.select(
        "*",
        (F.col("entity_id") % 2 == 0).cast("double").alias("treated"),
        (F.col("year") >= 1998).cast("double").alias("post"),
        F.when(rest == 1, 1997).when(rest == 2, 1998).when(rest == 3, 1999).cast("double").alias("first_treated"),
    )


SUPPLIER_YEAR_SQL = """
    SELECT l_suppkey AS entity_id, year(l_shipdate) AS year, avg(l_extendedprice * (1 - l_discount)) AS y,
           avg(l_quantity) AS quantity, avg(l_discount) AS discount,
           (l_suppkey % 2 = 0)::INT::DOUBLE AS treated, (year(l_shipdate) >= 1998)::INT::DOUBLE AS post,
           CASE l_suppkey % 4 WHEN 1 THEN 1997 WHEN 2 THEN 1998 WHEN 3 THEN 1999 END::DOUBLE AS first_treated
    FROM lineitem GROUP BY l_suppkey, year(l_shipdate)
"""


def user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by day of the month; not every user has every day."""
    events = table(spark, sf_dir, "events")
    panel = events.groupBy(F.col("user_id").alias("entity_id"), F.dayofmonth("ts").alias("day")).agg(F.avg("value").alias("y"), F.count(F.lit(1)).alias("n"))
    return panel.select("*", (F.col("entity_id") % 2 == 0).cast("double").alias("treated"), (F.col("day") >= 15).cast("double").alias("post"))


USER_DAY_SQL = """
    SELECT user_id AS entity_id, day(ts) AS day, avg(value) AS y, count(*) AS n,
           (user_id % 2 = 0)::INT::DOUBLE AS treated, (day(ts) >= 15)::INT::DOUBLE AS post
    FROM events GROUP BY user_id, day(ts)
"""


def nation_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_nationkey").alias("entity_id"), F.year("o_orderdate").alias("year")).agg(F.avg("o_totalprice").alias("y"))


NATION_YEAR_SQL = """
    SELECT c_nationkey AS entity_id, year(o_orderdate) AS year, avg(o_totalprice) AS y
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, year(o_orderdate)
"""


def orders_by_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-section for discontinuities: x is the customer's balance, y the order's price."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("c_acctbal").alias("x"), F.col("o_totalprice").alias("y"), (F.col("o_custkey") % 3 == 0).cast("double").alias("taken"))


ORDERS_BY_BALANCE_SQL = "SELECT c_acctbal AS x, o_totalprice AS y, (o_custkey % 3 = 0)::INT::DOUBLE AS taken FROM orders JOIN customer ON o_custkey = c_custkey"


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-section of line items with their part."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    parts = -(-line.count() // ROWS_A_TASK)  # of the files' footers
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):  # a task's share must not grow with the table
        line, part = line.repartition(parts, "l_partkey"), part.repartition(parts, "p_partkey")
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"),
        F.col("l_extendedprice").alias("y"), (F.col("l_returnflag") == "R").cast("double").alias("d"),
        F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("retail"), F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
    )


LINE_ITEMS_SQL = """
    SELECT l_orderkey AS order_id, l_linenumber AS line, l_extendedprice AS y, (l_returnflag = 'R')::INT::DOUBLE AS d,
           p_size::DOUBLE AS size, p_retailprice AS retail, l_quantity AS quantity, l_discount AS discount, l_tax AS tax
    FROM lineitem JOIN part ON l_partkey = p_partkey
"""

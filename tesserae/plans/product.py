"""Canned product queries: summaries, pages, details with nested arrays, and one ad-hoc statement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.plans import adhoc
from tesserae.plans.catalog import registered, table

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


@registered(" UNION ALL ".join(f"SELECT '{t}' AS collection, count(*) AS n FROM {t}" for t in _TABLES))
def summary(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("collection"), "n") for t in _TABLES])


@registered("SELECT c_custkey, c_name, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 25")
def customer_page(spark: SparkSession, d: str) -> DataFrame:
    return adhoc.collection(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")


@registered("""
SELECT c_custkey, to_json(list({'key': o_orderkey, 'status': o_orderstatus} ORDER BY o_orderkey)) AS orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def customer_detail(spark: SparkSession, d: str) -> DataFrame:
    """Every customer with orders, as one document with an ordered nested array."""
    each = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")))).alias("orders"))
    return table(spark, d, "customer").select("c_custkey").join(each, "c_custkey").select("c_custkey", F.to_json("orders").alias("orders"))


@registered("WITH t AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) SELECT p_brand, n FROM t WHERE n > 10")
def adhoc_statement(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "part").createOrReplaceTempView("part")
    return adhoc.read_only(spark, "WITH t AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) SELECT p_brand, n FROM t WHERE n > 10;")

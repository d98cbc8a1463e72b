"""Ordinary relational operators over the star schema: joins of every kind, aggregation, windows, sets, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.operators import closure, latest
from tesserae.plans.catalog import registered, table

#: How many pairs of a join of groups a task makes.
PAIRS = 1_000_000


def cents(c: str):
    """Money as an exact number of cents, so that sums don't depend on their order."""
    return F.round(F.col(c) * 100).cast("bigint")


@registered("""
SELECT l_returnflag, l_linestatus, CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS BIGINT) AS quantity, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS price,
       count(*) AS n, count(DISTINCT l_orderkey) AS orders, min(l_linenumber) AS first_line, max(l_linenumber) AS last_line
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum(cents("l_quantity")).alias("quantity"), F.sum(cents("l_extendedprice")).alias("price"), F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("orders"), F.min("l_linenumber").alias("first_line"), F.max("l_linenumber").alias("last_line"))


@registered("""
SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS price
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1997-03-15' GROUP BY ALL""")
def segment_orders(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = table(spark, d, "orders").filter("o_orderdate < timestamp '1997-03-15'").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, d, "lineitem").select("l_orderkey", cents("l_extendedprice").alias("price"))
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.sum("price").alias("price"))


@registered("""
SELECT n_name, r_name, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS price
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def six_way_join(spark: SparkSession, d: str) -> DataFrame:
    lines, orders = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", cents("l_extendedprice").alias("price")), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    customers, suppliers = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("s_suppkey"), "s_nationkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    by_nation = joined.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.sum("price").alias("price"))
    named = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return by_nation.join(named, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "r_name", "n", "price")


@registered("SELECT c_custkey, c_nationkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def left_outer_counts(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("orders"))
    return table(spark, d, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_nationkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@registered("""
WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS custkey, coalesce(a.n, 0) AS open_orders, coalesce(b.n, 0) AS filled_orders, CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS side FROM a FULL JOIN b ON a.k = b.k""")
def full_outer_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    side = lambda s, k, n: orders.filter(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias(k)).agg(F.count("*").alias(n))
    joined = side("O", "a", "open_orders").join(side("F", "b", "filled_orders"), F.col("a") == F.col("b"), "full_outer")
    return joined.select(F.coalesce("a", "b").alias("custkey"), F.coalesce("open_orders", F.lit(0)).alias("open_orders"), F.coalesce("filled_orders", F.lit(0)).alias("filled_orders"), F.when(F.col("a").isNull(), "right").when(F.col("b").isNull(), "left").otherwise("both").alias("side"))


@registered("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders").select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@registered("SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY ALL")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    returned = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey")
    return table(spark, d, "orders").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@registered("""
SELECT p_partkey, s_suppkey FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size <=> 10""".replace("p_size <=> 10", "p_size IS NOT DISTINCT FROM 10"))
def null_safe_filter(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    parts = table(spark, d, "part").filter(F.col("p_size").eqNullSafe(10)).select("p_partkey")
    return pairs.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier").select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey")).select("p_partkey", "s_suppkey")


@registered("""
SELECT r_name, n_name, count(*) AS n, CAST(grouping(r_name) * 2 + grouping(n_name) AS BIGINT) AS level
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def rollup_suppliers(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.grouping_id("r_name", "n_name").alias("level"))


@registered("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@registered("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupingSets([[F.col("l_returnflag")], [F.col("l_linestatus")], []], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n")).select("l_returnflag", "l_linestatus", "n")


@registered("""
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'O') AS open_n, count(*) FILTER (o_orderstatus = 'F') AS filled_n, count(*) FILTER (o_orderstatus = 'P') AS partial_n FROM orders GROUP BY ALL""")
def pivot_status(spark: SparkSession, d: str) -> DataFrame:
    pivoted = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["O", "F", "P"]).count()
    return pivoted.select("o_orderpriority", *[F.coalesce(c, F.lit(0)).alias(n) for c, n in (("O", "open_n"), ("F", "filled_n"), ("P", "partial_n"))])


@registered("""
SELECT n_name, metric, v FROM (SELECT n_name, CAST(n_nationkey AS BIGINT) AS nation, CAST(n_regionkey AS BIGINT) AS region FROM nation) UNPIVOT (v FOR metric IN (nation, region))""")
def unpivot_nation(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").select("n_name", F.col("n_nationkey").cast("bigint").alias("nation"), F.col("n_regionkey").cast("bigint").alias("region"))
    return rows.unpivot("n_name", ["nation", "region"], "metric", "v")


@registered("""
SELECT l_suppkey, l_orderkey, l_linenumber, place, running FROM (
  SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER w AS place, CAST(sum(CAST(round(l_quantity) AS BIGINT)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running
  FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber)) WHERE place <= 3""")
def first_lines_per_supplier(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate", F.round("l_quantity").cast("bigint").alias("q"))
    first = rows.withColumn("place", F.row_number().over(order)).filter("place <= 3")
    running = F.sum("q").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("running", running).select("l_suppkey", "l_orderkey", "l_linenumber", F.col("place").cast("bigint").alias("place"), "running")


@registered("""
SELECT o_custkey, o_orderkey, coalesce(CAST(date_diff('day', CAST(lag(o_orderdate) OVER w AS DATE), CAST(o_orderdate AS DATE)) AS BIGINT), -1) AS days_since, coalesce(lead(o_orderkey) OVER w, -1) AS next_order, CAST(ntile(4) OVER w AS BIGINT) AS quarter,
       first_value(o_orderkey) OVER w AS first_order FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def order_neighbours(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    gap = F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).cast("bigint")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.coalesce(gap, F.lit(-1)).alias("days_since"), F.coalesce(F.lead("o_orderkey").over(w), F.lit(-1)).alias("next_order"), F.ntile(4).over(w).cast("bigint").alias("quarter"), F.first("o_orderkey").over(w).alias("first_order"))


@registered("""
SELECT p_brand, p_partkey, r AS place, dr AS dense_place FROM (SELECT p_brand, p_partkey, rank() OVER w AS r, dense_rank() OVER w AS dr FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size DESC)) WHERE r <= 2""")
def ranked_parts(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_size"))
    return table(spark, d, "part").select("p_brand", "p_partkey", F.rank().over(w).cast("bigint").alias("place"), F.dense_rank().over(w).cast("bigint").alias("dense_place")).filter("place <= 2")


@registered("SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", cents("o_totalprice").alias("price"))


@registered("SELECT s_nationkey AS nation FROM supplier UNION SELECT c_nationkey FROM customer")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")).union(table(spark, d, "customer").select("c_nationkey")).distinct()


@registered("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def intersect_customers(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return orders.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k")).intersect(orders.filter("o_orderstatus = 'F'").select("o_custkey"))


@registered("SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'N' EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def except_all_parts(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return lines.filter("l_returnflag = 'N'").select(F.col("l_partkey").alias("k")).exceptAll(lines.filter("l_returnflag = 'R'").select("l_partkey"))


@registered("""
SELECT c_custkey, o.o_orderkey AS latest_order FROM customer JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 1) o ON true""")
def lateral_latest(spark: SparkSession, d: str) -> DataFrame:
    newest = latest.latest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")])
    return table(spark, d, "customer").select("c_custkey").join(newest, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", F.col("o_orderkey").alias("latest_order"))


@registered("""
SELECT event_id, user_id, coalesce((SELECT arg_max(p.event_id, (p.ts, p.event_id)) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'click' AND p.ts <= e.ts), -1) AS last_click
FROM events e WHERE event_type = 'purchase'""")
def as_of_click(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    # of clicks at one moment only the one of the highest id counts, as no order within it is told
    clicks = events.filter("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_click"))
    bought = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return latest.as_of(bought, clicks, "user_id", "ts", "ts", "last_click").select("event_id", "user_id", F.coalesce("last_click", F.lit(-1)).alias("last_click"))


@registered("""
SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS p, avg(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey) AS a FROM orders) WHERE p > 2 * a""")
def above_own_average(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", cents("o_totalprice").alias("p"))
    per = orders.groupBy(F.col("o_custkey").alias("k")).agg(F.avg("p").alias("a"))
    return orders.join(per, F.col("o_custkey") == F.col("k")).filter("p > 2 * a").select("o_custkey", "o_orderkey")


@registered("SELECT p_partkey, upper(p_type) AS kind, length(p_name) AS name_length, substr(p_brand, 1, 5) AS brand, regexp_extract(p_type, '^[A-Z]+') AS first_word, replace(p_name, ' ', '_') AS slug, p_size % 7 AS size_mod FROM part")
def scalar_strings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.upper("p_type").alias("kind"), F.length("p_name").cast("bigint").alias("name_length"), F.substring("p_brand", 1, 5).alias("brand"), F.regexp_extract("p_type", "^[A-Z]+", 0).alias("first_word"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("slug"), (F.col("p_size") % 7).alias("size_mod"))


@registered("SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus, count(*) AS n, CAST(min(dayofweek(o_orderdate)) AS BIGINT) AS first_weekday FROM orders GROUP BY ALL")
def monthly_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderstatus").agg(F.count("*").alias("n"), F.min(F.dayofweek("o_orderdate") - 1).cast("bigint").alias("first_weekday"))


@registered("SELECT l_orderkey, list_sort(list(DISTINCT l_partkey))[1] AS least_part, count(DISTINCT l_suppkey) AS suppliers, bool_and(l_quantity > 1) AS all_many, bool_or(l_discount > 0.09) AS any_cheap, CAST(bit_or(1 << l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY ALL")
def aggregate_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("least_part"), F.countDistinct("l_suppkey").alias("suppliers"), F.every(F.col("l_quantity") > 1).alias("all_many"), F.some(F.col("l_discount") > 0.09).alias("any_cheap"), F.bit_or(F.expr("shiftleft(1, l_linenumber)").cast("bigint")).alias("lines"))


@registered("SELECT p.p_partkey, q.p_partkey AS other FROM part p JOIN part q ON p.p_brand = q.p_brand AND p.p_type = q.p_type AND q.p_size BETWEEN p.p_size + 1 AND p.p_size + 2")
def range_join(spark: SparkSession, d: str) -> DataFrame:
    """A range join made an equality join: the sizes that a row looks for are spelled out, two of them.

    Pairs grow with the square of a group, so tasks follow the number of pairs, which is counted first; the seeking rows
    of a group with more than ``PAIRS`` of them are dealt to several tasks, each of which gets all that they look for.
    """
    keys = ["p_brand", "p_type", "p_size"]
    parts = table(spark, d, "part").select("p_partkey", *keys)
    wanted = parts.select("p_partkey", "p_brand", "p_type", F.explode(F.array(F.col("p_size") + 1, F.col("p_size") + 2)).alias("p_size"))
    counts = wanted.groupBy(*keys).agg(F.count("*").alias("n")).join(parts.groupBy(*keys).agg(F.count("*").alias("m")), keys)
    load = closure.written(counts.select(*keys, (F.col("n") * F.col("m")).alias("pairs"), F.ceil(F.col("n") * F.col("m") / PAIRS).alias("cuts")))
    tasks = 1 + (load.agg(F.sum("pairs")).first()[0] or 0) // PAIRS
    left = wanted.join(load, keys).select("p_partkey", *keys, F.pmod(F.xxhash64("p_partkey"), "cuts").alias("cut")).repartition(tasks, *keys, "cut")
    right = parts.join(load, keys).select(F.col("p_partkey").alias("other"), *keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cuts") - 1)).alias("cut")).repartition(tasks, *keys, "cut")
    return left.join(right, [*keys, "cut"]).select("p_partkey", "other")

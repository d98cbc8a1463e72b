"""Queries for syntax roles, compiled targets, passes, revalidation and collation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import collate
from tesserae.operators import cognition, exceptions, resolve, syntax, targets
from tesserae.plans.catalog import registered, table


@registered("""
SELECT event_type AS kind, CASE event_type WHEN 'purchase' THEN 'value' WHEN 'click' THEN 'link' ELSE 'other' END AS role, count(*) AS spans FROM events GROUP BY ALL""")
def syntax_roles(spark: SparkSession, d: str) -> DataFrame:
    """Events as spans, each bound by rules to exactly one role."""
    spans = table(spark, d, "events").select(F.col("event_id").alias("span"), F.lit("p").alias("provider"), F.col("event_type").alias("kind"), F.lit(None).cast("string").alias("field"), F.lit(syntax.NAMED).alias("flags"))
    kinds = spans.select("provider", "kind").distinct()
    role = F.when(F.col("kind") == "purchase", "value").when(F.col("kind") == "click", "link").otherwise("other")
    rules = kinds.select("provider", "kind", F.lit(None).cast("string").alias("field"), F.lit(syntax.NAMED).alias("required"), F.lit(syntax.ERROR).alias("forbidden"), role.alias("role"), F.lit(syntax.PRESERVE).alias("disposition"))
    return spans.join(syntax.bindings(spans, rules), "span").groupBy("kind", "role").agg(F.count("*").alias("spans"))


@registered("""
WITH r AS (SELECT p_brand, bool_and(p_size > 1) AS every_large, count(*) AS n FROM part GROUP BY p_brand), i AS (SELECT DISTINCT p_brand FROM part UNION SELECT 'Brand#none')
SELECT i.p_brand AS brand, coalesce(n, 0) AS n, coalesce(every_large, true) AS every_large FROM i LEFT JOIN r ON i.p_brand = r.p_brand""")
def lateral_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Per input its matching rows, counted and tested: aggregated first, joined after, as an aggregate of outer references isn't planned."""
    parts = table(spark, d, "part").select("p_brand", "p_size")
    per = parts.groupBy(F.col("p_brand").alias("b")).agg(F.count("*").alias("n"), F.every(F.col("p_size") > 1).alias("every_large"))
    asked = parts.select(F.col("p_brand").alias("brand")).union(spark.range(1).select(F.lit("Brand#none"))).distinct()
    return asked.join(per, F.col("brand") == F.col("b"), "left").select("brand", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("every_large", F.lit(True)).alias("every_large"))


@registered("SELECT count(*) AS verified FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END FROM customer INTERSECT SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 21 = 0 THEN 'x' WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END FROM customer)")
def verified_rows(spark: SparkSession, d: str) -> DataFrame:
    """Incoming rows that are stored exactly, nulls compared as values."""
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    blank = rows.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")))
    stored = blank.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 21 == 0, "x").otherwise(F.col("c_mktsegment")))
    return spark.range(1).select(F.lit(resolve.verified_count(blank, stored)).cast("bigint").alias("verified"))


_JOBS = """
k AS (SELECT CAST(s_suppkey * 2 AS BIGINT) AS i, CAST(s_nationkey * 2 + 1 AS BIGINT) AS j, CAST(1 + s_suppkey % 3 AS DOUBLE) AS a, -1.0::DOUBLE AS b, CAST(1 + s_nationkey % 4 AS DOUBLE) AS w, 1 << (s_suppkey % 6) AS family, 1 << (s_nationkey % 5) AS source, s_suppkey AS evidence FROM supplier),
x AS (SELECT * FROM (VALUES ('even', 21, 31), ('odd', 42, 31), ('first', 63, 1)) AS s(slot, families, sources)), t AS (SELECT slot, k.* FROM k JOIN x ON k.family & x.families <> 0 AND k.source & x.sources <> 0)"""


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    rows = table(spark, d, "supplier").select((k * 2).cast("bigint").alias("i"), (n * 2 + 1).cast("bigint").alias("j"), (1 + k % 3).cast("double").alias("a"), F.lit(-1.0).alias("b"), (1 + n % 4).cast("double").alias("w"), F.pow(F.lit(2), k % 6).cast("int").alias("family"), F.pow(F.lit(2), n % 5).cast("int").alias("source"), k.alias("evidence"))
    return targets.scope_plan(spark.createDataFrame([("even", 21, 31), ("odd", 42, 31), ("first", 63, 1)], "slot string, families int, sources int"), rows)


@registered("WITH " + _JOBS + " SELECT slot, count(*) AS jobs, CAST(sum(w) AS BIGINT) AS weight FROM t GROUP BY slot")
def scope_plan(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d).groupBy("slot").agg(F.count("*").alias("jobs"), F.sum("w").cast("bigint").alias("weight"))


@registered("WITH " + _JOBS + """, e AS (SELECT slot, i AS row, i AS col, w * a * a AS v FROM t UNION ALL SELECT slot, i, j, w * a * b FROM t UNION ALL SELECT slot, j, i, w * a * b FROM t UNION ALL SELECT slot, j, j, w * b * b FROM t)
SELECT slot, row, col, sum(v) AS value FROM e GROUP BY ALL""")
def slot_operators(spark: SparkSession, d: str) -> DataFrame:
    found = targets.slot_operators(_jobs(spark, d))
    if not targets.identical_slots(found).isEmpty():
        raise ValueError("two slots have one operator")
    return found


@registered("""
SELECT l_orderkey, CAST(count(*) AS INTEGER) AS steps, round(1 - 1 / (sum(1 / (1 - round(l_discount * 100) / 100)) + 2e-6) / 1e6, 6) AS goal_value, true AS accepted FROM lineitem GROUP BY l_orderkey""")
def path_values(spark: SparkSession, d: str) -> DataFrame:
    """Orders as paths through their lines, each step uncertain by its discount."""
    step = F.struct(F.round(F.col("l_discount") * 100).cast("bigint").alias("n"), F.lit(100).cast("bigint").alias("d"))
    paths = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", step.alias("s")))), lambda x: x["s"]).alias("steps"))
    found = targets.path_values(paths)
    return found.select("l_orderkey", F.size("steps").alias("steps"), F.round("goal_value", 6).alias("goal_value"), "accepted")


@registered()
def collation_order(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct word with its key, in the order of the keys."""
    words = table(spark, d, "documents").select(F.explode(F.split("text", r"\s+")).alias("word")).filter("word != ''").distinct()
    keyed = words.select("word", collate.collation_key(shifted=True)("word").alias("key"))
    return keyed.orderBy("key", "word")


@registered("SELECT o_custkey AS goal, CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'blocked' ELSE 'complete' END AS state FROM orders GROUP BY ALL")
def forward_passes(spark: SparkSession, d: str) -> DataFrame:
    """One pass a customer: open orders resolve to satisfied, partial ones can't be resolved and block."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("goal"), F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", 2).otherwise(3).alias("disposition"), F.lit(True).alias("required"), F.lit(False).alias("unresolved_allowed"))
    offer = lambda open_: open_.select("item", F.lit(1).alias("operation"), F.lit(2).alias("kind"), F.lit(1).alias("reduction"), F.lit(0).alias("information"), F.lit(1).alias("cost"))
    return cognition.forward_passes(rows, offer, lambda chosen: chosen.select("item", F.lit(2).alias("disposition")), "goal", ["item"])[1]


_CONDITIONS = "(VALUES (1, 30, 'retry'), (2, 20, 'resume'), (3, 10, 'reject'), (4, 40, 'replay'), (5, 50, 'none')) AS r(condition, priority, recovery)"


@registered(f"""
WITH o AS (SELECT user_id AS execution, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS condition FROM events),
s AS (SELECT execution, arg_min(r.condition, priority) AS condition, arg_min(recovery, priority) AS recovery, CAST(bit_or(1 << r.condition) AS BIGINT) AS observed_mask FROM o JOIN {_CONDITIONS} ON o.condition = r.condition GROUP BY execution)
SELECT s.*, count(o_orderkey) FILTER (o_orderstatus = 'O') AS open_obligations, count(o_orderkey) FILTER (o_orderstatus = 'F') AS units FROM s LEFT JOIN orders ON o_custkey = execution GROUP BY ALL""")
def why_not_records(spark: SparkSession, d: str) -> DataFrame:
    condition = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 4).otherwise(5)
    observed = table(spark, d, "events").select(F.col("user_id").alias("execution"), condition.alias("condition"))
    registry = spark.createDataFrame([(1, 30, "retry"), (2, 20, "resume"), (3, 10, "reject"), (4, 40, "replay"), (5, 50, "none")], "condition int, priority int, recovery string")
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("execution"), F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", 2).otherwise(3).alias("disposition"))
    done = orders.filter("disposition = 2").groupBy("execution").agg(F.count("*").alias("units"))
    return exceptions.why_not(exceptions.classified(observed, registry), orders, done)


@registered("""
WITH l AS (SELECT substr(sha256(text), 1, 32) AS id, sha256(text) AS witness, min(doc_id) AS position FROM documents GROUP BY ALL), q AS (SELECT substr(sha256(text), 1, 32) AS id, CASE WHEN doc_id % 10 = 0 THEN 'stale' ELSE sha256(text) END AS witness FROM documents)
SELECT q.id AS id, l.position AS position, count(*) AS probes FROM q JOIN l ON q.id = l.id AND q.witness = l.witness GROUP BY ALL""")
def reverse_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Ids looked up in a table from identity to position; a hit counts only if the full witness agrees."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("witness"))
    prefix = F.substring("witness", 1, 32)
    lookup = docs.groupBy(prefix.alias("id"), "witness").agg(F.min("doc_id").alias("position"))
    asked = docs.select(prefix.alias("id"), F.when(F.col("doc_id") % 10 == 0, "stale").otherwise(F.col("witness")).alias("witness"))
    return asked.join(lookup, ["id", "witness"]).groupBy("id", "position").agg(F.count("*").alias("probes"))

"""Queries for evidence, references, mappings, admission and identity classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import dimensions, ident
from tesserae.operators import guidance, latest, relations, resolve, response
from tesserae.plans.catalog import registered, table

_EVENT_DISPOSITION = "CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 5 WHEN 'signup' THEN 7 ELSE 8 END"


@registered("""
WITH o AS (SELECT lang, sha256(text) AS root, CASE WHEN quality = 1 THEN 1 ELSE -1 END AS polarity FROM documents JOIN labels USING (doc_id)
 UNION ALL SELECT lang, sha256(text), CASE WHEN toxic = 1 THEN -1 ELSE 1 END FROM documents JOIN labels USING (doc_id)),
b AS (SELECT lang, root, count(*) AS raw, max(CAST(polarity > 0 AS INTEGER)) AS f, max(CAST(polarity < 0 AS INTEGER)) AS a FROM o GROUP BY ALL)
SELECT lang, CAST(sum(raw) AS BIGINT) AS raw_count, count(*) AS roots, CAST(sum(f) AS BIGINT) AS roots_for, CAST(sum(a) AS BIGINT) AS roots_against, CAST(sum(f * a) AS BIGINT) AS roots_contradictory FROM b GROUP BY lang""")
def evidence_fold(spark: SparkSession, d: str) -> DataFrame:
    """Support per language, where copies of a text share a root and count once."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("root"))
    labels = table(spark, d, "labels").select("doc_id", F.explode(F.array(F.when(F.col("quality") == 1, 1).otherwise(-1), F.when(F.col("toxic") == 1, -1).otherwise(1))).alias("polarity"))
    return response.evidence_fold(docs.join(labels, "doc_id"), ["lang"])


@registered(f"""
SELECT user_id % 10 AS profile, count(*) AS records, CAST(sum(user_id % 5 + 1) AS BIGINT) AS samples, CAST(sum(CASE WHEN event_id % 4 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS uncertain,
 CAST(sum(CASE WHEN ({_EVENT_DISPOSITION}) IN (5, 6, 7, 8, 10) THEN 1 ELSE 0 END) AS BIGINT) AS negative FROM events GROUP BY ALL""")
def testimony_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select((F.col("user_id") % 10).alias("profile"), (F.col("user_id") % 5 + 1).alias("sample_count"), (F.col("event_id") % 4).alias("uncertainty_numerator"), F.expr(_EVENT_DISPOSITION).alias("disposition"))
    return response.testimony_summary(rows, dimensions.NEGATIVE_TESTIMONY, ["profile"])


@registered("""
SELECT * FROM (SELECT event_id AS testimony_id, CASE WHEN event_id % 11 = 0 THEN 'outcome_type' WHEN user_id % 12 = 0 OR user_id % 12 > 10 THEN 'disposition' WHEN n > d OR (n = 0 AND d <> 1) OR gcd(n, d) <> 1 THEN 'uncertainty' END AS fault
 FROM (SELECT *, event_id % 4 AS n, event_id % 3 + 1 AS d FROM events)) WHERE fault IS NOT NULL""")
def testimony_faults(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("testimony_id"), F.col("event_id").alias("position"), F.lit(1).alias("source_type"), (F.col("event_id") % 11).alias("outcome_type"), (F.col("user_id") % 12).alias("disposition"),
        (F.col("event_id") % 4).alias("uncertainty_numerator"), (F.col("event_id") % 3 + 1).alias("uncertainty_denominator"), F.col("user_id").alias("boundary"),
    )
    bounded = rows.withColumn("outcome_type", F.when(F.col("outcome_type") > 9, 9).otherwise(F.col("outcome_type")))
    return resolve.testimony_faults(bounded, "boundary").select("testimony_id", "fault")


_REFERENCES = """
c AS (SELECT 'nation' AS namespace, CAST(n_nationkey AS VARCHAR) AS local_id, CASE WHEN n_nationkey % 5 = 4 THEN 4 ELSE 2 END AS rule_flags FROM nation
 UNION ALL SELECT 'nation', CAST(c_nationkey AS VARCHAR), 1 FROM customer UNION ALL SELECT 'nation', CAST(s_nationkey + 3 AS VARCHAR), 1 FROM supplier),
t AS (SELECT *, max(CASE WHEN rule_flags & 2 <> 0 THEN 1 ELSE 0 END) OVER w AS p, max(CASE WHEN rule_flags & 4 <> 0 THEN 1 ELSE 0 END) OVER w AS q FROM c WINDOW w AS (PARTITION BY namespace, local_id)),
v AS (SELECT namespace, local_id, rule_flags, CASE WHEN p = 1 THEN 1 WHEN q = 1 THEN 2 ELSE 6 END AS disposition FROM t)"""


def _references(spark: SparkSession, d: str) -> DataFrame:
    nation, customer, supplier = (table(spark, d, n) for n in ("nation", "customer", "supplier"))
    part = lambda rows, key, flags: rows.select(F.lit("nation").alias("namespace"), key.cast("string").alias("local_id"), flags.alias("rule_flags"))
    declared = part(nation, F.col("n_nationkey"), F.when(F.col("n_nationkey") % 5 == 4, 4).otherwise(2))
    return declared.unionByName(part(customer, F.col("c_nationkey"), F.lit(1))).unionByName(part(supplier, F.col("s_nationkey") + 3, F.lit(1)))


@registered("WITH " + _REFERENCES + " SELECT namespace, local_id, disposition, count(*) AS candidates FROM v GROUP BY ALL")
def reference_topology(spark: SparkSession, d: str) -> DataFrame:
    resolved = resolve.topology(_references(spark, d), ["namespace", "local_id"])
    return resolved.groupBy("namespace", "local_id", "disposition").agg(F.count("*").alias("candidates"))


@registered("WITH " + _REFERENCES + """, k AS (SELECT DISTINCT namespace, local_id, disposition FROM v)
SELECT count(*) AS coordinates, CAST(sum(CAST(disposition = 1 AS INTEGER)) AS BIGINT) AS present, CAST(sum(CAST(disposition = 2 AS INTEGER)) AS BIGINT) AS retired, CAST(sum(CAST(disposition = 6 AS INTEGER)) AS BIGINT) AS unresolved FROM k""")
def topology_counts(spark: SparkSession, d: str) -> DataFrame:
    return resolve.topology_counts(resolve.topology(_references(spark, d), ["namespace", "local_id"]), ["namespace", "local_id"])


_MAPPINGS = """
p AS (SELECT l_partkey AS a, l_suppkey AS b, l_linenumber % 2 = 0 AS both_ways, CASE WHEN l_partkey % 7 = 0 THEN 2 WHEN l_partkey % 5 = 0 THEN 6 ELSE 1 END AS da, CASE WHEN l_suppkey % 9 = 0 THEN 2 WHEN l_suppkey % 4 = 0 THEN 6 ELSE 1 END AS db FROM lineitem)"""


@registered("WITH " + _MAPPINGS + """
SELECT CASE WHEN both_ways THEN least(a, b) ELSE a END AS low, CASE WHEN both_ways THEN greatest(a, b) ELSE b END AS high, both_ways,
 CASE WHEN da = 2 OR db = 2 THEN 5 WHEN da = 6 AND db = 6 THEN 4 WHEN da = 6 THEN 2 WHEN db = 6 THEN 3 ELSE 1 END AS disposition, count(*) AS witnesses FROM p GROUP BY ALL""")
def reference_mapping(spark: SparkSession, d: str) -> DataFrame:
    key = lambda c, retired, open_: F.when(F.col(c) % retired == 0, 2).when(F.col(c) % open_ == 0, 6).otherwise(1)
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), (F.col("l_linenumber") % 2 == 0).alias("both_ways"), key("l_partkey", 7, 5).alias("da"), key("l_suppkey", 9, 4).alias("db"))
    low, high = resolve.proposition_ends(F.col("a"), F.col("b"), F.col("both_ways"))
    return rows.groupBy(low.alias("low"), high.alias("high"), "both_ways", resolve.mapping_disposition(F.col("da"), F.col("db")).alias("disposition")).agg(F.count("*").alias("witnesses"))


@registered("""
WITH s AS (SELECT substr(sha256(text), 1, 32) AS id, min(CAST(length(text) AS BIGINT)) AS witness FROM documents WHERE doc_id % 3 = 0 GROUP BY ALL),
i AS (SELECT substr(sha256(text), 1, 32) AS id, min(CASE WHEN doc_id % 5 = 0 THEN -1 ELSE CAST(length(text) AS BIGINT) END) AS witness FROM documents GROUP BY ALL)
SELECT CASE WHEN s.id IS NULL THEN 0 WHEN s.witness IS NOT DISTINCT FROM i.witness THEN 1 ELSE 2 END AS class, count(*) AS n FROM i LEFT JOIN s ON i.id = s.id GROUP BY ALL""")
def presence_classes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("id", ident.content_id(F.col("text"))).withColumn("chars", F.length("text").cast("bigint"))
    stored = docs.filter("doc_id % 3 = 0").groupBy("id").agg(F.min("chars").alias("witness"))
    incoming = docs.groupBy("id").agg(F.min(F.when(F.col("doc_id") % 5 == 0, -1).otherwise(F.col("chars"))).alias("witness"))
    return resolve.classify_presence(incoming, stored, "id", "witness").groupBy("class").agg(F.count("*").alias("n"))


@registered("SELECT DISTINCT o_custkey AS custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 3 = 0)")
def append_missing(spark: SparkSession, d: str) -> DataFrame:
    incoming = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"))
    stored = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("custkey"))
    return resolve.missing(incoming, stored, ["custkey"])


@registered("""
SELECT c_custkey, o.n AS occurrences, coalesce(c.n, 0) AS claims, coalesce(t.n, 0) AS testimony, CASE WHEN coalesce(c.n, 0) = 0 AND coalesce(t.n, 0) > 0 THEN 'evidence_without_claim' WHEN coalesce(c.n, 0) <> coalesce(t.n, 0) THEN 'testimony' ELSE 'occurrences' END AS fault
FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) c ON c.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) t ON t.o_custkey = c_custkey WHERE coalesce(c.n, 0) <> coalesce(t.n, 0)""")
def world_admission(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderstatus")
    requests = orders.select(F.col("o_custkey").alias("c_custkey")).distinct()
    known = requests.join(table(spark, d, "customer").select("c_custkey"), "c_custkey", "left_semi")
    sides = [rows.withColumnRenamed("o_custkey", "c_custkey") for rows in (orders, orders.filter("o_orderstatus <> 'F'"), orders.filter("o_orderstatus = 'O'"))]
    return resolve.admission_faults(known, *sides, "c_custkey").select("c_custkey", "occurrences", "claims", "testimony", "fault")


@registered("""
WITH r AS (SELECT p_partkey AS recipe, CAST(p_size % 3 AS BIGINT) AS profile, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_partkey - 1 END AS parent, p_partkey % 6 + 1 AS scope, p_partkey % 4 AS ordinal FROM part),
j AS (SELECT r.*, q.recipe AS q, q.profile AS qp, q.scope AS qs, count(*) OVER (PARTITION BY r.profile, r.parent, r.ordinal) AS siblings FROM r LEFT JOIN r q ON r.parent = q.recipe)
SELECT * FROM (SELECT recipe, CASE WHEN scope = 1 AND parent IS NOT NULL THEN 'source_with_parent' WHEN scope > 1 AND q IS NULL THEN 'orphan' WHEN qp <> profile THEN 'foreign_parent' WHEN qs >= scope THEN 'scope_order' WHEN siblings > 1 THEN 'sibling_ordinal' END AS fault FROM j) WHERE fault IS NOT NULL""")
def stock_catalog(spark: SparkSession, d: str) -> DataFrame:
    recipes = table(spark, d, "part").select(F.col("p_partkey").alias("recipe"), (F.col("p_size") % 3).cast("bigint").alias("profile"), F.when(F.col("p_partkey") % 6 != 0, F.col("p_partkey") - 1).alias("parent"), (F.col("p_partkey") % 6 + 1).alias("scope"), (F.col("p_partkey") % 4).alias("ordinal"))
    return resolve.catalog_faults(recipes).select("recipe", "fault")


_PROFILE = """
p AS (SELECT l_suppkey AS profile, count(*) AS n, CAST(sum(CAST(l_returnflag = 'R' AS INTEGER)) AS BIGINT) AS rejected, CAST(sum(CAST(l_returnflag = 'A' AS INTEGER)) AS BIGINT) AS lossy, CAST(sum(CAST(l_returnflag = 'N' AS INTEGER)) AS BIGINT) AS persisted, l_suppkey % 3 = 0 AS is_exact FROM lineitem GROUP BY ALL)"""


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    count = lambda flag: F.sum((F.col("l_returnflag") == flag).cast("int"))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("profile")).agg(F.count("*").alias("n"), count("R").alias("rejected"), count("A").alias("lossy"), count("N").alias("persisted"))
    zero = [F.lit(0).cast("bigint").alias(c) for c in resolve.DISPOSITIONS if c not in ("rejected", "lossy", "persisted")]
    full = [F.col("n").alias(c) for c in resolve.PROFILE_COUNTS]
    exact = F.col("profile") % 3 == 0
    return rows.select("profile", "rejected", "lossy", "persisted", *zero, *full, F.when(F.col("profile") % 10 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("closure_subjects"), exact.alias("is_exact"), F.lit(False).alias("is_raw"))


@registered("WITH " + _PROFILE + " SELECT profile, CASE WHEN profile % 10 = 0 THEN 'closure' ELSE 'lossy_exact' END AS fault FROM p WHERE profile % 10 = 0 OR (is_exact AND lossy <> 0)")
def profile_faults(spark: SparkSession, d: str) -> DataFrame:
    return resolve.profile_faults(_profiles(spark, d)).select("profile", "fault")


@registered("WITH " + _PROFILE + " SELECT count(*) AS profiles, CAST(sum(CASE WHEN profile % 10 = 0 THEN n + 1 ELSE n END) AS BIGINT) AS subjects, CAST(sum(persisted) AS BIGINT) AS persisted, CAST(sum(rejected + lossy) AS BIGINT) AS negative, CAST(sum(CAST(is_exact AS INTEGER)) AS BIGINT) AS exact FROM p")
def profile_summary(spark: SparkSession, d: str) -> DataFrame:
    return resolve.profile_summary(_profiles(spark, d))


@registered("SELECT n_regionkey AS source, n_nationkey AS target, 1 AS direction FROM nation WHERE n_regionkey < 2 UNION ALL SELECT n_nationkey, n_regionkey, 2 FROM nation WHERE n_nationkey < 2")
def undirected_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "nation").select(F.col("n_regionkey").alias("left_id"), F.col("n_nationkey").alias("right_id"))
    return relations.undirected_edges(edges, spark.range(2).select(F.col("id").cast("int").alias("id"))).select("source", "target", "direction")


@registered("""
WITH o AS (SELECT o_custkey AS goal, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS disposition, o_orderpriority <> '5-LOW' AS required, o_orderkey % 2 = 0 AS allowed FROM orders),
f AS (SELECT goal, count(*) FILTER (required AND disposition NOT IN (1, 2) AND NOT allowed) AS blocked, count(*) FILTER (required AND disposition = 1) AS open FROM o GROUP BY goal)
SELECT goal, blocked, open, CASE WHEN blocked > 0 THEN 3 WHEN open > 0 THEN 1 ELSE 2 END AS completion FROM f""")
def obligation_completion(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("goal"), F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", 2).otherwise(3).alias("disposition"), (F.col("o_orderpriority") != "5-LOW").alias("required"), (F.col("o_orderkey") % 2 == 0).alias("unresolved_allowed"))
    return guidance.completion(rows, "goal")


@registered("""
SELECT goal, operation, kind, reduction, information, cost FROM (SELECT l_orderkey AS goal, l_partkey * 8 + l_linenumber AS operation, l_linenumber % 9 + 1 AS kind, CAST(l_quantity AS BIGINT) % 4 AS reduction, CAST(l_quantity AS BIGINT) % 3 AS information, CAST(l_quantity AS BIGINT) AS cost,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_quantity AS BIGINT) % 4 DESC, CAST(l_quantity AS BIGINT) % 3 DESC, CAST(l_quantity AS BIGINT), l_linenumber % 9 + 1, l_partkey * 8 + l_linenumber) AS place FROM lineitem) WHERE place = 1""")
def best_operation(spark: SparkSession, d: str) -> DataFrame:
    q = F.round("l_quantity").cast("bigint")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("goal"), (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("operation"), (F.col("l_linenumber") % 9 + 1).alias("kind"), (q % 4).alias("reduction"), (q % 3).alias("information"), q.alias("cost"))
    return guidance.best_operation(rows, "goal")


@registered("""
SELECT c_nationkey AS nation, min(c_mktsegment) AS c_mktsegment, count(DISTINCT c_mktsegment) > 1 AS ambiguous FROM (SELECT *, rank() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 5) AS place FROM customer) WHERE place = 1 GROUP BY ALL""")
def best_realization(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_mktsegment", (F.col("c_custkey") % 5).alias("rank"))
    return latest.best_with_ties(rows, ["nation"], [F.col("rank")], "c_mktsegment")

"""Queries for recursion, search, interval bindings and joint interpretation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import ident
from tesserae.operators import closure, interpret, latest, occurrence, search
from tesserae.plans.catalog import registered, table


@registered("""
WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 's' || s_suppkey, 'r' || s_suppkey % 5 FROM supplier),
nodes AS (SELECT child AS node FROM e UNION SELECT parent FROM e), c AS (SELECT node, node AS root, 0 AS depth FROM nodes WHERE node NOT IN (SELECT child FROM e) UNION SELECT e.child, c.root, c.depth + 1 FROM c JOIN e ON e.parent = c.node)
SELECT node, root, min(depth) AS depth FROM c GROUP BY ALL""")
def lineage_roots(spark: SparkSession, d: str) -> DataFrame:
    """Every terminal root of suppliers, nations and regions, at its least depth."""
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    nation, supplier = table(spark, d, "nation"), table(spark, d, "supplier")
    edges = nation.select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent"))
    edges = edges.unionByName(supplier.select(name("s", "s_suppkey").alias("child"), name("n", "s_nationkey").alias("parent")))
    edges = edges.unionByName(supplier.select(name("s", "s_suppkey").alias("child"), F.concat(F.lit("r"), (F.col("s_suppkey") % 5).cast("string")).alias("parent")))
    nodes = edges.select(F.col("child").alias("node")).unionByName(edges.select(F.col("parent").alias("node"))).distinct()
    return closure.root_projection(nodes, edges)


@registered("""
WITH RECURSIVE e AS (SELECT p_partkey AS container, p_partkey // 2 AS entity FROM part WHERE p_partkey >= 2), n AS (SELECT container AS node FROM e UNION SELECT entity FROM e),
c AS (SELECT node, 0 AS level FROM n WHERE node NOT IN (SELECT container FROM e) UNION ALL SELECT e.container, c.level + 1 FROM c JOIN e ON e.entity = c.node) SELECT node, max(level) AS level FROM c GROUP BY node""")
def composition_levels(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").filter("p_partkey >= 2")
    return closure.levels(parts.select(F.col("p_partkey").alias("container"), F.expr("p_partkey div 2").alias("entity")))


def _bipartite(spark: SparkSession, d: str) -> DataFrame:
    """Supplier to part and back, costing the least line number at which the pair was sold; written, as searches read it every round."""
    pairs = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).agg(F.min("l_linenumber").cast("bigint").alias("c"))
    there = pairs.select((F.col("s") * 2).alias("source"), (F.col("p") * 2 + 1).alias("target"), "c", F.lit(1).alias("one"))
    both = there.unionByName(there.select(F.col("target").alias("source"), F.col("source").alias("target"), "c", "one"))
    return closure.written(both.select("source", "target", search.edge_cost([3, 1], ["c", "one"]).alias("cost")))


_GRAPH = """
q AS (SELECT l_suppkey AS s, l_partkey AS p, min(l_linenumber) AS c FROM lineitem GROUP BY ALL),
e AS (SELECT s * 2 AS source, p * 2 + 1 AS target, CAST(3 * c + 1 AS BIGINT) AS cost FROM q UNION ALL SELECT p * 2 + 1, s * 2, CAST(3 * c + 1 AS BIGINT) FROM q)"""


@registered("WITH RECURSIVE " + _GRAPH + """, l AS (SELECT CAST(0 AS BIGINT) AS state, CAST(0 AS BIGINT) AS cost, 0 AS depth UNION SELECT e.target, l.cost + e.cost, l.depth + 1 FROM l JOIN e ON e.source = l.state WHERE l.depth < 4)
SELECT state, min(cost) AS cost FROM l WHERE state % 2 = 0 GROUP BY state ORDER BY cost, state LIMIT 10""")
def cheapest_states(spark: SparkSession, d: str) -> DataFrame:
    """The ten suppliers that are cheapest to reach from supplier 0 within four edges."""
    edges = _bipartite(spark, d)
    states = spark.range(1).select(F.col("id").alias("state"))
    goals = edges.select(F.col("source").alias("state")).filter("state % 2 = 0").distinct()
    found = search.cheapest_paths(edges, states, goals, max_depth=4, paths=None, max_labels=1 << 62)
    best = found.paths.groupBy("state").agg(F.min("cost").cast("bigint").alias("cost"))
    return best.orderBy("cost", "state").limit(10)


@registered("WITH RECURSIVE " + _GRAPH + """, g AS (SELECT s_suppkey * 2 AS goal FROM supplier WHERE s_suppkey BETWEEN 2 AND 5),
l AS (SELECT CAST(2 AS BIGINT) AS state, CAST(0 AS BIGINT) AS cost, 0 AS depth UNION SELECT e.target, l.cost + e.cost, l.depth + 1 FROM l JOIN e ON e.source = l.state WHERE l.depth < 2),
r AS (SELECT * FROM l JOIN g ON state = goal), f AS (SELECT * FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.state = a.state AND b.cost <= a.cost AND b.depth <= a.depth AND (b.cost < a.cost OR b.depth < a.depth)))
SELECT state, cost, depth, CASE WHEN count(*) OVER () >= 3 THEN 'complete' WHEN count(*) OVER () = 0 THEN 'no_admissible_path' ELSE 'partial' END AS disposition FROM f ORDER BY cost, depth, state LIMIT 3""")
def typed_paths(spark: SparkSession, d: str) -> DataFrame:
    """The three cheapest paths of two edges from supplier 1 to suppliers 2 to 5, each edge estimated at its least cost."""
    edges = _bipartite(spark, d)
    goals = table(spark, d, "supplier").filter("s_suppkey between 2 and 5").select((F.col("s_suppkey") * 2).alias("state"))
    states = edges.select(F.col("source").alias("state")).distinct()
    estimate = states.join(goals.distinct().withColumn("at", F.lit(True)), "state", "left").select("state", F.when(F.col("at"), 0).when(F.col("state") % 2 == 1, 4).otherwise(8).alias("estimate"))
    anchors = spark.range(2, 3).select(F.col("id").alias("state"))
    found = search.best_first(edges, anchors, goals, search.Budget(depth=2), paths=3, heuristic=estimate)
    return found.paths.select("state", F.col("cost").cast("bigint").alias("cost"), "depth", F.lit(found.disposition).alias("disposition"))


@registered("WITH RECURSIVE " + _GRAPH + ", l AS (SELECT CAST(0 AS BIGINT) AS state, 0 AS depth UNION SELECT e.target, l.depth + 1 FROM l JOIN e ON e.source = l.state WHERE l.depth < 4) SELECT state, min(depth) AS depth FROM l GROUP BY state")
def response_scan(spark: SparkSession, d: str) -> DataFrame:
    return search.reach(_bipartite(spark, d), spark.range(1).select(F.col("id").alias("state")), 4)


@registered("""
SELECT o_orderkey AS orderkey, c_nationkey AS nation, s_suppkey AS supplier FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey""")
def joint_interpretations(spark: SparkSession, d: str) -> DataFrame:
    """Four relations joined on shared slots, in the order that binds most and reads least."""
    F_ = interpret.Factor
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("row_id"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("row_id"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_suppkey").cast("int").alias("supplier"), F.col("l_linenumber").alias("row_id"))
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("row_id"))
    factors = [F_("orders", orders, ("orderkey", "customer"), 1), F_("customers", customers, ("customer", "nation"), 2), F_("lines", lines, ("orderkey", "supplier"), 4), F_("suppliers", suppliers, ("supplier", "nation"), 3)]
    return interpret.interpretations(factors).select("orderkey", "nation", "supplier")


@registered("""
SELECT l_orderkey AS parent FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS place, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WHERE l_quantity > 3)
GROUP BY l_orderkey HAVING max(CAST(l_linenumber <> place AS INTEGER)) = 1 OR max(l_linenumber) <> max(n) OR max(n) <> max(l_linenumber)""")
def tiling_faults(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose lines of some quantity don't number 1..n without gap or overlap."""
    lines = table(spark, d, "lineitem").filter("l_quantity > 3")
    counted = lines.join(lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("logical_count")), F.col("l_orderkey") == F.col("k"))
    bindings = counted.select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("first"), F.col("l_linenumber").alias("last"), "logical_count")
    return occurrence.tiling_faults(bindings).select("parent")


@registered("SELECT o_orderkey, o_custkey FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_orderkey = a.o_orderkey + 1 AND b.o_custkey % 3 = a.o_custkey % 3)")
def current_states(spark: SparkSession, d: str) -> DataFrame:
    """States that no other state of their lane names as its predecessor."""
    states = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") * 3 + F.col("o_custkey") % 3).alias("state"), ((F.col("o_orderkey") - 1) * 3 + F.col("o_custkey") % 3).alias("prior"))
    return latest.without_successor(states, "state", "prior").select("o_orderkey", "o_custkey")


@registered("""
SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS place FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 2""")
def two_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", "ts")
    return latest.choose(rows, ["user_id"], [F.col("ts"), F.col("event_id")], 2).select("user_id", "event_id", F.col("place").cast("bigint").alias("place"))


@registered("SELECT arg_max(text, turn) AS text, conv_id, max(turn) AS turn FROM (SELECT conv_id, turn, max(text) AS text FROM conversations GROUP BY ALL) GROUP BY conv_id")
def latest_turn(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return latest.latest(turns, ["conv_id"], [F.desc("turn"), F.desc_nulls_last("text")]).select("text", "conv_id", "turn")


@registered("SELECT concat_ws('/', 'c', conv_id) AS root, string_agg(text, '' ORDER BY turn) AS text FROM (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY ALL) GROUP BY conv_id")
def materialized_text(spark: SparkSession, d: str) -> DataFrame:
    """Conversations read back from a two-tier structure: conversation, turns, words."""
    turns = table(spark, d, "conversations").filter("text is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    turns = closure.written(turns)
    word = F.concat(F.lit("w"), ident.content_id(F.col("piece")))
    turn_name = F.concat_ws("/", F.lit("t"), "conv_id", "turn")
    pieces = turns.select("conv_id", "turn", F.posexplode(F.split("text", "(?<= )")).alias("pos", "piece"))
    atoms = pieces.select(word.alias("entity"), F.col("piece").alias("text")).distinct()
    inner = pieces.select(turn_name.alias("container"), (F.col("pos") + 1).cast("bigint").alias("ordinal"), word.alias("entity"))
    outer = turns.select(F.concat_ws("/", F.lit("c"), "conv_id").alias("container"), F.col("turn").cast("bigint").alias("ordinal"), turn_name.alias("entity"))
    roots = outer.select(F.col("container").alias("entity")).distinct()
    return closure.expanded_text(roots, inner.unionByName(outer), atoms)

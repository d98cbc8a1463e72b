"""Queries for centroids, standings and sparse operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import scalars
from tesserae.operators import linear, standing
from tesserae.plans.catalog import registered, table


@registered("""
WITH c AS (SELECT label, embedding[1] AS x, embedding[2] AS y, embedding[3] AS z, embedding[4] AS m, vec_id % 3 + 1 AS w FROM embeddings),
g AS (SELECT label, sum(CAST(x AS DOUBLE) * w) / sum(w) AS x, sum(CAST(y AS DOUBLE) * w) / sum(w) AS y, sum(CAST(z AS DOUBLE) * w) / sum(w) AS z, sum(CAST(m AS DOUBLE) * w) / sum(w) AS m, CAST(sum(w) AS BIGINT) AS multiplicity FROM c GROUP BY label)
SELECT label, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(m, 6) AS m, multiplicity, round(sqrt(x * x + y * y + z * z + m * m), 6) AS radius FROM g""")
def centroids(spark: SparkSession, d: str) -> DataFrame:
    parts = [F.element_at("embedding", k + 1).cast("double").alias(n) for k, n in enumerate("xyzm")]
    rows = table(spark, d, "embeddings").select("label", *parts, (F.col("vec_id") % 3 + 1).alias("w"))
    out = linear.centroids(rows, "label", list("xyzm"), "w")
    return out.select("label", *[F.round(c, 6).alias(c) for c in "xyzm"], "multiplicity", F.round("radius", 6).alias("radius"))


def _games(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Consecutive lines of an order are games between their suppliers; the larger quantity wins."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("lane"), F.round("l_quantity").cast("bigint").alias("q"))
    other = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("lane").alias("opponent"), F.col("q").alias("p"))
    pairs = lines.join(other, ["l_orderkey", "l_linenumber"]).filter("lane != opponent")
    score = F.when(F.col("q") > F.col("p"), 1.0).when(F.col("q") < F.col("p"), 0.0).otherwise(0.5)
    games = pairs.select("lane", "opponent", score.alias("score"))
    games = games.unionByName(games.select(F.col("opponent").alias("lane"), F.col("lane").alias("opponent"), (1 - F.col("score")).alias("score")))
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("lane"))
    states = suppliers.select("lane", (1400 + F.col("lane") % 7 * 30).cast("double").alias("rating"), (60 + F.col("lane") % 5 * 40).cast("double").alias("deviation"), F.lit(0.06).alias("volatility"))
    return states, games


@registered("""
WITH p AS (SELECT a.l_suppkey AS lane, b.l_suppkey AS opponent, CASE WHEN round(a.l_quantity) > round(b.l_quantity) THEN 1.0 WHEN round(a.l_quantity) < round(b.l_quantity) THEN 0.0 ELSE 0.5 END AS score
 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_suppkey <> b.l_suppkey),
g AS (SELECT lane, opponent, score FROM p UNION ALL SELECT opponent, lane, 1 - score FROM p),
s AS (SELECT CAST(s_suppkey AS BIGINT) AS lane, (1400 + s_suppkey % 7 * 30 - 1500) / 173.7178 AS mu, (60 + s_suppkey % 5 * 40) / 173.7178 AS phi FROM supplier),
t AS (SELECT g.lane, 1 / sqrt(1 + 3 * o.phi * o.phi / (pi() * pi())) AS w, s.mu, o.mu AS mo, CAST(g.score AS DOUBLE) AS score FROM g JOIN s ON g.lane = s.lane JOIN s o ON g.opponent = o.lane),
e AS (SELECT *, 1 / (1 + exp(-w * (mu - mo))) AS e FROM t)
SELECT lane, count(*) AS games, round(1 / sum(w * w * e * (1 - e)), 8) AS v, round(sum(w * (score - e)) / sum(w * w * e * (1 - e)), 6) AS delta FROM e GROUP BY lane""")
def standing_sums(spark: SparkSession, d: str) -> DataFrame:
    """The closed forms of a rating period: variance and improvement per supplier."""
    sums = standing.period_sums(*_games(spark, d))
    return sums.select("lane", "games", F.round("v", 8).alias("v"), F.round("delta", 6).alias("delta"))


@registered()
def standing_period(spark: SparkSession, d: str) -> DataFrame:
    return standing.rate_period(*_games(spark, d))


_CONSTRAINTS = """
k AS (SELECT CAST(c_custkey * 2 AS BIGINT) AS i, CAST(c_nationkey * 2 + 1 AS BIGINT) AS j, 1 + c_custkey % 3 AS a, -1 - c_custkey % 2 AS b, c_custkey % 5 AS c, 1 + c_nationkey % 4 AS w FROM customer)"""


def _constraints(spark: SparkSession, d: str) -> DataFrame:
    """Every customer, bound to its nation: as many unknowns as there are customers and nations."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    whole = [(k * 2).cast("bigint").alias("i"), (n * 2 + 1).cast("bigint").alias("j"), (1 + k % 3).cast("double").alias("a"), (-1 - k % 2).cast("double").alias("b"), (k % 5).cast("double").alias("c"), (1 + n % 4).cast("double").alias("w"), k.alias("evidence")]
    return table(spark, d, "customer").select(*whole)


@registered("WITH " + _CONSTRAINTS + """, e AS (SELECT i AS row, i AS col, w * a * a AS v FROM k UNION ALL SELECT i, j, w * a * b FROM k UNION ALL SELECT j, i, w * a * b FROM k UNION ALL SELECT j, j, w * b * b FROM k)
SELECT row, col, CAST(sum(v) AS DOUBLE) AS value FROM e GROUP BY ALL""")
def dense_operator(spark: SparkSession, d: str) -> DataFrame:
    return linear.matrix(_constraints(spark, d))


@registered("WITH " + _CONSTRAINTS + """, r AS (SELECT i, j, a, b, w, a * (i % 7 - 3) + b * (j % 7 - 3) AS r FROM k),
y AS (SELECT i AS k, a * w * r AS y FROM r UNION ALL SELECT j, b * w * r FROM r) SELECT k, CAST(sum(y) AS DOUBLE) AS y FROM y GROUP BY k""")
def applied_operator(spark: SparkSession, d: str) -> DataFrame:
    constraints = _constraints(spark, d)
    keys = constraints.select(F.col("i").alias("k")).unionByName(constraints.select(F.col("j").alias("k"))).distinct()
    return linear.apply(constraints, keys.select("k", (F.col("k") % 7 - 3).cast("double").alias("value")))


@registered("WITH " + _CONSTRAINTS + ", e AS (SELECT i AS k, -w * c * a AS v FROM k UNION ALL SELECT j, -w * c * b FROM k) SELECT k, CAST(sum(v) AS DOUBLE) AS value FROM e GROUP BY k")
def operator_right_side(spark: SparkSession, d: str) -> DataFrame:
    return linear.right_side(_constraints(spark, d))


@registered("WITH " + _CONSTRAINTS + """, g AS (SELECT * FROM (VALUES (1, 0.0, 10.0), (27, 1.0, 10.0)) AS g(j, g, r)),
n AS (SELECT j, sum(w * b * b * 5.0 / (w * a * a + 5.0)) AS s, -sum(w * b * c * 5.0 / (w * a * a + 5.0)) AS t FROM k GROUP BY j),
x AS (SELECT CAST(coalesce(n.j, g.j) AS BIGINT) AS k, CAST((coalesce(t, 0) + coalesce(g * r, 0)) / (coalesce(s, 0) + coalesce(r, 0) + 5.0) AS DOUBLE) AS value FROM n FULL JOIN g ON n.j = g.j)
SELECT k, round(value, 4) AS value, 'converged' AS disposition FROM x UNION ALL SELECT i, round(-w * a * (b * x.value + c) / (w * a * a + 5.0), 4), 'converged' FROM k JOIN x ON x.k = k.j""")
def boundary_solution(spark: SparkSession, d: str) -> DataFrame:
    """Customers and nations between two nations that are held; the SQL eliminates the customers of each nation."""
    boundary = spark.createDataFrame([(1, 0.0, 10.0), (27, 1.0, 10.0)], "k bigint, value double, weight double")
    found = linear.solve(linear.deduplicated(_constraints(spark, d)), boundary, regular=5.0)
    return found.x.select("k", F.round("value", 4).alias("value"), F.lit(found.disposition).alias("disposition"))


@registered("""
WITH n AS (SELECT count(*) AS n FROM part), t AS (SELECT p_partkey, (p_partkey - 1 + 0.5) / n AS t, 2 * pi() * (p_partkey - 1 + 0.5) / sqrt(2) AS a, 2 * pi() * (p_partkey - 1 + 0.5) / 1.533751168755204288118041 AS b FROM part, n)
SELECT p_partkey, round(sqrt(t) * sin(a), 6) AS x, round(sqrt(t) * cos(a), 6) AS y, round(sqrt(1 - t) * sin(b), 6) AS z, round(sqrt(1 - t) * cos(b), 6) AS w FROM t""")
def spiral_placement(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey")
    n = parts.count()
    at = scalars.placement(F.col("p_partkey") - 1, F.lit(n))
    return parts.select("p_partkey", *[F.round(c, 6).alias(name) for c, name in zip(at, "xyzw", strict=True)])


@registered()
def hilbert_keys(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings by the Hilbert key of their first four components: a sort key that keeps neighbours together."""
    parts = [scalars.quantised(F.element_at("embedding", k + 1).cast("double")) for k in range(4)]
    return table(spark, d, "embeddings").select("vec_id", scalars.hilbert4()(*parts).alias("key"))


@registered("SELECT p_partkey, CAST(gcd(p_size * 6, p_partkey) AS BIGINT) AS divisor FROM part")
def common_divisors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", scalars.gcd(F.col("p_size").cast("bigint") * 6, F.col("p_partkey")).alias("divisor"))

"""Glicko-2 standings: one rating period, or many folded in order.

Games of a period are rated against the opponents' states at its start.  Sums of a lane are partial aggregates; only
the volatility's root finding, one number per lane, runs in Python over Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 173.7178  # fixed value: points of the display scale in one unit of the inner scale
DEFAULT = {"rating": 1500.0, "deviation": 350.0, "volatility": 0.06}
#: Scores of rateable outcomes: confirm, refute, draw.  Other outcomes rate nothing.
SCORES = {1: 1.0, 2: 0.0, 3: 0.5}


def g(phi: Column) -> Column:
    return 1 / F.sqrt(1 + 3 * phi * phi / (math.pi**2))


def expected(mu: Column, other: Column, phi: Column) -> Column:
    return 1 / (1 + F.exp(-g(phi) * (mu - other)))


def period_sums(states: DataFrame, games: DataFrame) -> DataFrame:
    """Per lane with games: variance v, improvement delta and games; closed forms of the states at the start.

    ``states``: lane, rating, deviation, volatility.  ``games``: lane, opponent, score.
    """
    own = states.select("lane", ((F.col("rating") - 1500) / SCALE).alias("mu"), (F.col("deviation") / SCALE).alias("phi"), "volatility")
    other = states.select(F.col("lane").alias("opponent"), ((F.col("rating") - 1500) / SCALE).alias("mu_j"), (F.col("deviation") / SCALE).alias("phi_j"))
    each = games.join(own, "lane").join(other, "opponent")
    e = expected(F.col("mu"), F.col("mu_j"), F.col("phi_j"))
    weight = g(F.col("phi_j"))
    sums = each.groupBy("lane", "mu", "phi", "volatility").agg(F.sum(weight * weight * e * (1 - e)).alias("information"), F.sum(weight * (F.col("score") - e)).alias("gain"), F.count("*").alias("games"))
    return sums.withColumn("v", 1 / F.col("information")).withColumn("delta", F.col("gain") / F.col("information"))


def new_volatility(phi: float, v: float, delta: float, sigma: float, tau: float, tolerance: float = 1e-6, rounds: int = 100) -> float:
    """The root of the volatility's condition by regula falsi with halved ends (Illinois)."""
    a = math.log(sigma * sigma)

    def f(x: float) -> float:
        ex = math.exp(x)
        return ex * (delta * delta - phi * phi - v - ex) / (2 * (phi * phi + v + ex) ** 2) - (x - a) / (tau * tau)

    low = a
    if delta * delta > phi * phi + v:
        high = math.log(delta * delta - phi * phi - v)
    else:
        k = 1
        while f(a - k * tau) < 0:
            k += 1
        high = a - k * tau
    f_low, f_high = f(low), f(high)
    for _ in range(rounds):
        if abs(high - low) <= tolerance:
            break
        mid = low + (low - high) * f_low / (f_high - f_low)
        f_mid = f(mid)
        if f_mid * f_high <= 0:
            low, f_low = high, f_high
        else:
            f_low /= 2
        high, f_high = mid, f_mid
    return math.exp(low / 2)


def rate_period(states: DataFrame, games: DataFrame, tau: float = 0.5) -> DataFrame:
    """The states after one period; lanes without games only gain deviation."""
    sums = period_sums(states, games)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                sigma = new_volatility(r["phi"], r["v"], r["delta"], r["volatility"], tau)
                phi = 1 / math.sqrt(1 / (r["phi"] ** 2 + sigma**2) + r["information"])
                out.append((r["lane"], 1500 + SCALE * (r["mu"] + phi * phi * r["gain"]), SCALE * phi, sigma))
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((batch.schema.field("lane").type, *[pa.float64()] * 3))]
            yield pa.RecordBatch.from_arrays(columns, ["lane", "new_rating", "new_deviation", "new_volatility"])

    kind = states.schema["lane"].dataType.simpleString()
    rated = sums.mapInArrow(run, f"lane {kind}, new_rating double, new_deviation double, new_volatility double")
    idle = F.least(F.lit(350.0), SCALE * F.sqrt((F.col("deviation") / SCALE) ** 2 + F.col("volatility") ** 2))
    joined = states.join(rated, "lane", "left")
    return joined.select("lane", F.coalesce("new_rating", "rating").alias("rating"), F.coalesce("new_deviation", idle).alias("deviation"), F.coalesce("new_volatility", "volatility").alias("volatility"))


def onboard(lanes: DataFrame) -> DataFrame:
    """New lanes at the recipe's defaults."""
    return lanes.select("lane").distinct().select("lane", *[F.lit(v).alias(k) for k, v in DEFAULT.items()])

"""Latest per key, choices with ties told, current states, and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``, which must be total for a defined result.

    Spark limits each partition to its own first rows before the shuffle, so a hot key costs one row per task.
    """
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_place = 1").drop("_place")


def choose(rows: DataFrame, key: list[str], order: list[Column], most: int) -> DataFrame:
    """Up to ``most`` rows of each key: two are enough to tell an ambiguous choice."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("place") <= most)


def best_with_ties(rows: DataFrame, key: list[str], order: list[Column], content: str) -> DataFrame:
    """The least rank of each key, its content and whether rows of that rank disagree in content."""
    first = rows.withColumn("_rank", F.rank().over(Window.partitionBy(*key).orderBy(*order))).filter("_rank = 1")
    return first.groupBy(*key).agg(F.min(content).alias(content), (F.countDistinct(content) > 1).alias("ambiguous"))


def without_successor(states: DataFrame, key: str, prior: str) -> DataFrame:
    """Current states: those that no other state names as its prior one."""
    named = states.select(F.col(prior).alias("_named")).filter("_named is not null").distinct()
    return states.join(named, F.col(key) == F.col("_named"), "left_anti")


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """Each left row with the value of the latest right row of its key not after it, null if there is none.

    Both sides are interleaved by time in one window per key: one shuffle, no row of one side meets all of the other.
    """
    a = left.withColumn("_time", F.col(left_time)).withColumn("_side", F.lit(1)).withColumn(value, F.lit(None).cast(right.schema[value].dataType))
    b = right.select(F.col(key), F.col(right_time).alias("_time"), F.lit(0).alias("_side"), F.col(value))
    order = Window.partitionBy(key).orderBy("_time", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last(value, ignorenulls=True).over(order)).filter("_side = 1").drop("_time", "_side")

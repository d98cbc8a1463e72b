"""Obligations, operations and realizations: completion, immutable successor states, lexicographic choices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, SATISFIED = 1, 2
INCOMPLETE, COMPLETE, BLOCKED = 1, 2, 3


def completion(obligations: DataFrame, key: str) -> DataFrame:
    """Per key over required obligations (disposition, required, unresolved_allowed).

    Any that is neither open nor satisfied nor allowed to stay unresolved blocks, which wins over open ones.
    """
    need = F.col("required")
    blocked = F.count_if(need & ~F.col("disposition").isin(OPEN, SATISFIED) & ~F.col("unresolved_allowed"))
    waiting = F.count_if(need & (F.col("disposition") == OPEN))
    return obligations.groupBy(key).agg(blocked.alias("blocked"), waiting.alias("open")).withColumn("completion", F.when(F.col("blocked") > 0, BLOCKED).when(F.col("open") > 0, INCOMPLETE).otherwise(COMPLETE))


def resolved(obligations: DataFrame, resolutions: DataFrame, key: list[str]) -> DataFrame:
    """The successor state: resolutions replace dispositions of open obligations, all else stays."""
    new = resolutions.select(*key, F.col("disposition").alias("_new"))
    joined = obligations.join(new, key, "left")
    return joined.withColumn("disposition", F.when(F.col("disposition") == OPEN, F.coalesce("_new", "disposition")).otherwise(F.col("disposition"))).drop("_new")


def best_operation(operations: DataFrame, key: str) -> DataFrame:
    """Per key the operation of most reduction, then most information, least cost, least kind and least id."""
    order = F.struct(-F.col("reduction"), -F.col("information"), F.col("cost"), F.col("kind"), F.col("operation"))
    return operations.groupBy(key).agg(F.min_by(F.struct("operation", "kind", "reduction", "information", "cost"), order).alias("best")).select(key, "best.*")

"""Observed conditions classified by a registry, and records of why an execution stopped short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unknown_conditions(observed: DataFrame, registry: DataFrame) -> DataFrame:
    """Observed (execution, condition) rows whose condition isn't registered: they reject the batch."""
    return observed.join(registry.select("condition"), "condition", "left_anti")


def classified(observed: DataFrame, registry: DataFrame) -> DataFrame:
    """Per execution the registered condition of least priority, its recovery, and a mask of all that were observed.

    ``registry`` has condition (1..62), priority (unique) and recovery.
    """
    if not unknown_conditions(observed, registry).isEmpty():
        raise ValueError("an observed condition isn't registered")
    rows = observed.join(registry, "condition")
    mask = F.bit_or(F.expr("shiftleft(1L, condition)"))
    return rows.groupBy("execution").agg(F.min_by(F.struct("condition", "recovery"), "priority").alias("s"), mask.alias("observed_mask")).select("execution", "s.*", "observed_mask")


def why_not(selected: DataFrame, obligations: DataFrame, work: DataFrame) -> DataFrame:
    """Adds open obligations (execution, disposition 1) and completed work (execution, units) to classified executions."""
    open_ = obligations.filter("disposition = 1").groupBy("execution").agg(F.count("*").alias("open_obligations"))
    return selected.join(open_, "execution", "left").join(work, "execution", "left").fillna(0, ["open_obligations", "units"])

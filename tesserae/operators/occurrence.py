"""Occurrences and runs: ordered containers as relational tables.

An *occurrence* table has (container, ordinal, entity), ordinals being 1-based.  A *run* table has (container,
run_index, entity, ordinal, run) with adjacent equal entities coalesced; ``ordinal`` is that of a run's first member.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of text in one task, of which tokens, windows and their sorts take many times as much.
TASK_TEXT = 4_000_000


def dealt(rows: DataFrame, container: str | list[str], text: str) -> DataFrame:
    """``rows`` dealt by container into tasks of about ``TASK_TEXT`` bytes of text.

    Done before texts are taken apart, this is the only shuffle of whatever partitions by container afterwards, and it
    moves texts instead of tokens; the number of tasks, not their memory, follows the input.
    """
    size = rows.agg(F.sum(F.octet_length(text).cast("bigint"))).first()[0] or 0
    return rows.repartition(1 + size // TASK_TEXT, *([container] if isinstance(container, str) else container))


def tokens(rows: DataFrame, container: str, text: Column) -> DataFrame:
    """Space-separated tokens of ``text`` as occurrences; empty tokens keep their place but aren't listed."""
    parts = F.posexplode(F.split(text, " "))
    return rows.select(F.col(container).alias("container"), parts.alias("pos", "entity")).filter("entity != ''").select("container", (F.col("pos") + 1).cast("bigint").alias("ordinal"), "entity")


def runs(occurrences: DataFrame) -> DataFrame:
    """Adjacent equal entities become one run (gaps and islands); a hole in the ordinals ends a run."""
    order = Window.partitionBy("container").orderBy("ordinal")
    same = (F.lag("entity").over(order) == F.col("entity")) & (F.lag("ordinal").over(order) + 1 == F.col("ordinal"))
    marked = occurrences.withColumn("fresh", F.when(same, 0).otherwise(1)).withColumn("run_index", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("container", "run_index", "entity").agg(F.min("ordinal").alias("ordinal"), F.count("*").alias("run"))


def decoded(vertices: DataFrame) -> DataFrame:
    """Vertices (container, vertex, entity, run) with the running logical ordinal 1 + the runs before."""
    before = Window.partitionBy("container").orderBy("vertex").rowsBetween(Window.unboundedPreceding, -1)
    return vertices.withColumn("ordinal", F.coalesce(F.sum("run").over(before), F.lit(0)) + 1)


def expanded(run_table: DataFrame) -> DataFrame:
    """Runs as occurrences again."""
    return run_table.select("container", F.explode(F.sequence(F.col("ordinal"), F.col("ordinal") + F.col("run") - 1)).alias("ordinal"), "entity")


def entity_count(run_table: DataFrame) -> DataFrame:
    """How often each entity is in each container."""
    return run_table.groupBy("container", "entity").agg(F.sum("run").alias("multiplicity"))


def tiling_faults(bindings: DataFrame) -> DataFrame:
    """Parents whose bindings (parent, first, last, logical_count) don't tile 1..logical_count without gap or overlap."""
    order = Window.partitionBy("parent").orderBy("first", "last")
    expected = F.coalesce(F.lag("last").over(order) + 1, F.lit(1))
    step = bindings.withColumn("off", F.when((F.col("first") != expected) | (F.col("last") < F.col("first")), 1).otherwise(0))
    return step.groupBy("parent").agg(F.sum("off").alias("faults"), F.max("last").alias("reached"), F.max("logical_count").alias("logical_count")).filter("faults > 0 or reached != logical_count")


def precedes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of occurrences of one container where ``left`` ends before ``right`` starts; both have container, first, last.

    The container is the equality key, so this is no product over all rows; one side should be restricted to anchors.
    """
    a = left.select("container", F.col("first").alias("left_first"), F.col("last").alias("left_last"))
    b = right.select("container", F.col("first").alias("right_first"), F.col("last").alias("right_last"))
    return a.join(b, "container").filter("left_last < right_first")

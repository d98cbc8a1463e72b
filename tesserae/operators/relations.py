"""Structural neighbourhoods of anchors: container, constituent, predecessor, successor and co-occurrence.

Every relation yields candidates of one shape: source, target, container, relation (a bit), direction, multiplicity,
gap.  Relations start from a restricted anchor table, so co-occurrence never pairs a container's members freely.
Neighbouring runs carry multiplicity 1, the inner edges of a run its length less one; a gap is only counted for
co-occurrence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.dimensions import code_of

CONTAINER, CONSTITUENT, PREDECESSOR, SUCCESSOR, COOCCUR = (code_of("relation_family", n) for n in ("container", "constituent", "predecessor", "successor", "cooccur"))
FORWARD, REVERSE, SYMMETRIC = (code_of("direction", n) for n in ("forward", "reverse", "symmetric"))


def _candidate(source: str, target: str | Column, relation: int, direction: int, multiplicity: Column, gap: Column | None = None) -> list[Column]:
    target = F.col(target) if isinstance(target, str) else target
    return [
        F.col(source).alias("source"), target.cast("string").alias("target"), F.col("container"), F.lit(relation).alias("relation"), F.lit(direction).alias("direction"),
        multiplicity.cast("bigint").alias("multiplicity"), (F.lit(0) if gap is None else gap).cast("bigint").alias("gap"),
    ]


def anchored(run_table: DataFrame, anchors: DataFrame) -> DataFrame:
    """The runs of anchor entities; ``anchors`` has one column entity and is joined under Spark's own size check."""
    return run_table.join(anchors.select("entity").distinct(), "entity", "left_semi")


def containers(run_table: DataFrame, anchors: DataFrame) -> DataFrame:
    return anchored(run_table, anchors).select(*_candidate("entity", "container", CONTAINER, REVERSE, F.col("run")))


def constituents(run_table: DataFrame, anchors: DataFrame) -> DataFrame:
    """Members of anchor containers; ``anchors`` has one column container."""
    held = run_table.join(anchors.select("container").distinct(), "container", "left_semi")
    return held.select(F.col("container").cast("string").alias("source"), F.col("entity").alias("target"), "container", F.lit(CONSTITUENT).alias("relation"), F.lit(FORWARD).alias("direction"), F.col("run").cast("bigint").alias("multiplicity"), F.lit(0).cast("bigint").alias("gap"))


def neighbours(run_table: DataFrame, anchors: DataFrame, relation: int) -> DataFrame:
    """Predecessors or successors: the adjacent run where the ordinals meet, and the inner edges of the run itself.

    One window over the containers; nothing is joined but the anchors.
    """
    marked = run_table.join(anchors.select("entity").distinct().withColumn("_anchor", F.lit(1)), "entity", "left")
    order = Window.partitionBy("container").orderBy("ordinal")
    if relation == SUCCESSOR:
        other, meets, direction = F.lead("entity").over(order), F.lead("ordinal").over(order) == F.col("ordinal") + F.col("run"), FORWARD
    else:
        other, meets, direction = F.lag("entity").over(order), F.lag(F.col("ordinal") + F.col("run")).over(order) == F.col("ordinal"), REVERSE
    own = marked.withColumn("_other", F.when(meets, other)).filter("_anchor = 1")
    each = lambda target, multiplicity: F.struct(target.alias("target"), multiplicity.cast("bigint").alias("multiplicity"))
    across = F.when(F.col("_other").isNotNull(), each(F.col("_other"), F.lit(1)))
    inner = F.when(F.col("run") > 1, each(F.col("entity"), F.col("run") - 1))
    found = own.select("entity", "container", F.explode(F.filter(F.array(across, inner), lambda s: s.isNotNull())).alias("s"))
    return found.select(*_candidate("entity", F.col("s.target"), relation, direction, F.col("s.multiplicity")))


def cooccurrences(run_table: DataFrame, anchors: DataFrame) -> DataFrame:
    """All other runs of an anchor run's container, with the distance of their starts; a run's own rest has gap 1."""
    mine = anchored(run_table, anchors).select(F.col("entity").alias("anchor"), "container", F.col("ordinal").alias("at"), F.col("run").alias("held"))
    other = mine.join(run_table, "container").filter("at != ordinal").select(*_candidate("anchor", "entity", COOCCUR, SYMMETRIC, F.col("run"), F.abs(F.col("ordinal") - F.col("at"))))
    own = mine.filter("held > 1").select(*_candidate("anchor", "anchor", COOCCUR, SYMMETRIC, F.col("held") - 1, F.lit(1)))
    return other.unionByName(own)


def cooccurrence_sums(run_table: DataFrame, anchors: DataFrame) -> DataFrame:
    """What ``cooccurrences`` adds up to per run, without its pairs: target, container, count, multiplicity, gap, relation.

    A run of a container with ``a`` anchor runs is a candidate ``a`` times, once less if it is one of them; its least gap
    is that to the nearest anchor run before or after.  One sort of a container either way, linear in its length.
    """
    marked = run_table.join(anchors.select("entity").distinct().withColumn("_anchor", F.lit(1)), "entity", "left")
    whole, up, down = Window.partitionBy("container"), Window.partitionBy("container").orderBy("ordinal"), Window.partitionBy("container").orderBy(F.desc("ordinal"))
    at = F.when(F.col("_anchor") == 1, F.col("ordinal"))
    near = lambda order: F.abs(F.last(at, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)) - F.col("ordinal"))
    seen = marked.withColumn("_anchors", F.count("_anchor").over(whole)).withColumn("_before", near(up)).withColumn("_after", near(down))
    times = (F.col("_anchors") - F.coalesce("_anchor", F.lit(0))).cast("bigint")
    others = seen.select(F.col("entity").alias("target"), "container", times.alias("count"), (times * F.col("run")).alias("multiplicity"), F.least("_before", "_after").cast("bigint").alias("gap"), F.lit(COOCCUR).alias("relation")).filter("count > 0")
    own = anchored(run_table, anchors).filter("run > 1").select(F.col("entity").alias("target"), "container", F.lit(1).cast("bigint").alias("count"), (F.col("run") - 1).alias("multiplicity"), F.lit(1).cast("bigint").alias("gap"), F.lit(COOCCUR).alias("relation"))
    return others.unionByName(own)


def anchor_sums(run_table: DataFrame, anchors: DataFrame) -> DataFrame:
    """The container, neighbour and co-occurrence relations of anchors in one pass, added up per run.

    Columns as those of ``cooccurrence_sums``.  Three windows over one partitioning by container, and nothing is joined
    but the anchors.
    """
    marked = run_table.join(anchors.select("entity").distinct().withColumn("_anchor", F.lit(1)), "entity", "left")
    whole, up, down = Window.partitionBy("container"), Window.partitionBy("container").orderBy("ordinal"), Window.partitionBy("container").orderBy(F.desc("ordinal"))
    at = F.when(F.col("_anchor") == 1, F.col("ordinal"))
    near = lambda order: F.abs(F.last(at, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)) - F.col("ordinal"))
    after = F.when(F.lead("ordinal").over(up) == F.col("ordinal") + F.col("run"), F.lead("entity").over(up))
    before = F.when(F.lag(F.col("ordinal") + F.col("run")).over(up) == F.col("ordinal"), F.lag("entity").over(up))
    seen = marked.withColumn("_anchors", F.count("_anchor").over(whole)).filter("_anchors > 0").withColumn("_near_up", near(up)).withColumn("_next", after).withColumn("_last", before).withColumn("_near_down", near(down))
    times = (F.col("_anchors") - F.coalesce("_anchor", F.lit(0))).cast("bigint")

    def sums(target: Column, count: Column, multiplicity: Column, gap: Column, relation: int) -> Column:
        return F.struct(target.cast("string").alias("target"), count.cast("bigint").alias("count"), multiplicity.cast("bigint").alias("multiplicity"), gap.cast("bigint").alias("gap"), F.lit(relation).alias("relation"))

    one, zero, run, entity = F.lit(1), F.lit(0), F.col("run"), F.col("entity")
    others = F.when(times > 0, sums(entity, times, times * run, F.least("_near_up", "_near_down"), COOCCUR))
    own = [sums(F.col("container"), one, run, zero, CONTAINER), F.when(F.col("_next").isNotNull(), sums(F.col("_next"), one, one, zero, SUCCESSOR)), F.when(F.col("_last").isNotNull(), sums(F.col("_last"), one, one, zero, PREDECESSOR))]
    inner = [F.when(run > 1, sums(entity, one, run - 1, gap, relation)) for relation, gap in ((SUCCESSOR, zero), (PREDECESSOR, zero), (COOCCUR, one))]
    each = F.when(F.col("_anchor") == 1, F.array(others, *own, *inner)).otherwise(F.array(others))
    return seen.select("container", F.explode(F.filter(each, lambda s: s.isNotNull())).alias("s")).select("s.target", "container", "s.count", "s.multiplicity", "s.gap", "s.relation")


def union_of(*providers: DataFrame) -> DataFrame:
    """The set union of providers' candidates: complete equal candidates collapse."""
    return reduce(DataFrame.unionByName, providers).distinct()


def bounded(candidates: DataFrame, limit: int) -> tuple[DataFrame, str]:
    """Fetches ``limit + 1`` candidates at most: with more than ``limit`` none is published and the state is exhausted."""
    fetched = candidates.limit(limit + 1)
    over = fetched.count() > limit
    return (candidates.limit(0), "exhausted") if over else (candidates, "complete")


def undirected_edges(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """Edges (left_id, right_id, ...) that touch the frontier (id) at either end, as two equi-joins instead of one with OR."""
    seeds = frontier.select(F.col("id").alias("source")).distinct()
    out = edges.join(seeds, F.col("left_id") == F.col("source")).withColumn("direction", F.lit(FORWARD)).withColumn("target", F.col("right_id"))
    back = edges.join(seeds, F.col("right_id") == F.col("source")).withColumn("direction", F.lit(REVERSE)).withColumn("target", F.col("left_id"))
    return out.unionByName(back)

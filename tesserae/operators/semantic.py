"""Evidence-backed neighbourhoods: mapping edges with testimony, and the current standing of the lanes behind them.

``occurrences``: occurrence, boundary, profile, row, left_id, right_id, proposition, relation, symmetric, disposition.
``testimony``: testimony, profile, node, uncertainty_numerator, uncertainty_denominator.  ``nodes``: node, row.
``roots``: node, root.  ``matches``: root, lane.  ``states``: lane, period, state, rating, deviation, volatility.
``members``: boundary, profile, node, root, testimony; what an admitted world holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.dimensions import code_of
from tesserae.operators import latest
from tesserae.operators.relations import SYMMETRIC, undirected_edges

TESTIMONY, STANDING = code_of("source_plane", "testimony"), code_of("source_plane", "standing")
RESOLVED = code_of("mapping_disposition", "resolved")


def evidenced_edges(frontier: DataFrame, occurrences: DataFrame, testimony: DataFrame, nodes: DataFrame, roots: DataFrame, members: DataFrame, boundary: int | str) -> DataFrame:
    """(source, target, proposition, relation, direction, root, occurrence, uncertainty): one row per source, proposition, target and root.

    Of several occurrences that say the same the least one speaks.  ``frontier`` has id.  Every join is on equal keys, and
    the frontier restricts the occurrences before evidence is joined to them.  Evidence gets its row first, so that it meets
    the occurrences of its profile and row only, not all those of a profile.
    """
    valid = occurrences.filter((F.col("boundary") == F.lit(boundary)) & (F.col("disposition") == RESOLVED))
    touched = undirected_edges(valid, frontier).withColumn("direction", F.when(F.col("symmetric"), SYMMETRIC).otherwise(F.col("direction")))
    placed = testimony.join(nodes, "node").join(roots, "node")
    admitted = placed.join(members.select("boundary", "profile", "node", "root", "testimony").filter(F.col("boundary") == F.lit(boundary)).drop("boundary"), ["profile", "node", "root", "testimony"], "left_semi")
    told = touched.join(admitted, ["profile", "row"])
    row = F.struct("occurrence", "testimony", "relation", "direction", "uncertainty_numerator", "uncertainty_denominator")
    return told.groupBy("source", "proposition", "target", "root").agg(F.min(row).alias("least")).select("source", "target", "proposition", "root", "least.*").drop("testimony")


def semantic_expand(edges: DataFrame, matches: DataFrame, states: DataFrame) -> DataFrame:
    """The candidates of ``evidenced_edges``: one of the testimony plane each, and one of the standing plane per lane of its root.

    The latest state of every lane is found once, with the limit of one row a key before the shuffle, not anew for each
    candidate.
    """
    now = latest.latest(states, ["lane"], [F.desc("period"), F.col("state")])
    empty = lambda name, kind: F.lit(None).cast(kind).alias(name)
    shared = ["source", "target", "occurrence", "relation", "direction"]
    told = edges.select(*shared, "root", "uncertainty_numerator", "uncertainty_denominator", F.lit(TESTIMONY).alias("plane"), empty("lane", states.schema["lane"].dataType), empty("rating", "double"))
    lanes = edges.select(*shared, "root").distinct().join(matches.select("root", "lane"), "root").join(now.select("lane", "rating"), "lane").select(*shared, "lane", "rating").distinct()
    ranked = lanes.select(*shared, empty("root", edges.schema["root"].dataType), empty("uncertainty_numerator", edges.schema["uncertainty_numerator"].dataType), empty("uncertainty_denominator", edges.schema["uncertainty_denominator"].dataType), F.lit(STANDING).alias("plane"), "lane", F.col("rating").cast("double").alias("rating"))
    return told.unionByName(ranked)

"""Folds of candidates and of evidence, both in two levels so that copies don't multiply support."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.dimensions import ENUMERATIONS

RELATIONS = ENUMERATIONS["relation_family"]


def counted(candidates: DataFrame) -> DataFrame:
    """Candidates as sums of one each: target, container, count, multiplicity, gap, relation."""
    return candidates.select("target", "container", F.lit(1).cast("bigint").alias("count"), "multiplicity", "gap", "relation")


def response_field(candidates: DataFrame | None, *sums: DataFrame) -> DataFrame:
    """Per target: candidates, multiplicity, least gap, masks, distinct containers and mass by relation channel.

    ``sums`` are candidates that are added up already, as ``counted`` has them.  The fold has two levels, by target and
    container and then by target, so that containers are counted without a distinct count.
    """
    rows = reduce(DataFrame.unionByName, [*([] if candidates is None else [counted(candidates)]), *sums])
    bits = {bit: name for bit, name in RELATIONS.items() if bit <= 16}
    channels = [F.sum(F.when(F.col("relation") == bit, F.col("multiplicity")).otherwise(0)).alias(f"mass_{name}") for bit, name in bits.items()]
    held = rows.groupBy("target", "container").agg(F.sum("count").alias("count"), F.sum("multiplicity").alias("multiplicity"), F.min("gap").alias("gap"), F.bit_or("relation").alias("relation"), *channels)
    totals = [F.sum(f"mass_{name}").alias(f"mass_{name}") for name in bits.values()]
    return held.groupBy("target").agg(F.sum("count").alias("candidate_count"), F.sum("multiplicity").alias("multiplicity"), F.min("gap").alias("min_gap"), F.bit_or("relation").alias("relation_mask"), F.count("*").alias("containers"), *totals)


def evidence_fold(observations: DataFrame, key: list[str]) -> DataFrame:
    """Per key: raw observations, distinct roots, roots for, roots against and contradictory roots.

    Observations have the key, a root and a polarity of 1 or -1.  They are folded by root first, so any number of
    dependent copies of one root counts once.
    """
    by_root = observations.groupBy(*key, "root").agg(F.count("*").alias("raw"), F.max((F.col("polarity") > 0).cast("int")).alias("has_for"), F.max((F.col("polarity") < 0).cast("int")).alias("has_against"))
    return by_root.groupBy(*key).agg(
        F.sum("raw").alias("raw_count"), F.count("*").alias("roots"), F.sum("has_for").alias("roots_for"), F.sum("has_against").alias("roots_against"),
        F.sum(F.col("has_for") * F.col("has_against")).cast("bigint").alias("roots_contradictory"),
    )


def testimony_summary(testimony: DataFrame, negative: tuple[int, ...], key: list[str]) -> DataFrame:
    """Per key: records, samples, uncertain records (numerator not 0) and negative dispositions."""
    return testimony.groupBy(*key).agg(
        F.count("*").alias("records"), F.sum("sample_count").alias("samples"),
        F.sum(F.when(F.col("uncertainty_numerator") != 0, 1).otherwise(0)).alias("uncertain"), F.sum(F.when(F.col("disposition").isin(*negative), 1).otherwise(0)).alias("negative"),
    )

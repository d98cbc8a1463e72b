"""Admission and resolution: reference topology, mappings, profiles, testimony, world admission, recipe catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.dimensions import NEGATIVE_TESTIMONY
from tesserae.functions.ident import record_id, set_fingerprint
from tesserae.functions.scalars import reduced

ENDPOINT, PRESENT, RETIRED = 1, 2, 4
IS_PRESENT, IS_RETIRED, IS_UNRESOLVED = 1, 2, 6


def topology(candidates: DataFrame, key: list[str]) -> DataFrame:
    """Adds present_any, retired_any, disposition and conflict to candidates with ``rule_flags``, per full key.

    Present wins if any candidate of the key declares it, else retired, else unresolved; both is a conflict.  Keys are
    aggregated first, partially where the candidates lie, and joined back, so a hot key is no task of its own.
    """
    flag = lambda bit: F.max(F.when(F.col("rule_flags").bitwiseAND(bit) != 0, 1).otherwise(0))
    names = [f"_key_{k}" for k in range(len(key))]
    each = candidates.groupBy(*[F.col(c).alias(n) for c, n in zip(key, names, strict=True)]).agg(flag(PRESENT).alias("present_any"), flag(RETIRED).alias("retired_any"))
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(key, names, strict=True)]
    seen = candidates.join(each, same).drop(*names)
    disposition = F.when(F.col("present_any") == 1, IS_PRESENT).when(F.col("retired_any") == 1, IS_RETIRED).otherwise(IS_UNRESOLVED)
    return seen.withColumn("disposition", disposition).withColumn("conflict", (F.col("present_any") == 1) & (F.col("retired_any") == 1))


def topology_counts(resolved: DataFrame, key: list[str]) -> DataFrame:
    each = resolved.groupBy(*key).agg(F.max("disposition").alias("disposition"))
    return each.agg(F.count("*").alias("coordinates"), *[F.sum((F.col("disposition") == code).cast("int")).alias(name) for name, code in (("present", IS_PRESENT), ("retired", IS_RETIRED), ("unresolved", IS_UNRESOLVED))])


def collisions(rows: DataFrame, coordinate: str, fingerprint: str) -> DataFrame:
    """Coordinates under which more than one fingerprint is found."""
    return rows.groupBy(coordinate).agg(F.countDistinct(fingerprint).alias("fingerprints")).filter("fingerprints > 1")


def mapping_disposition(left: Column, right: Column) -> Column:
    """A retired endpoint dominates; otherwise both, left or right unresolved; otherwise resolved."""
    open_left, open_right = left == IS_UNRESOLVED, right == IS_UNRESOLVED
    return F.when((left == IS_RETIRED) | (right == IS_RETIRED), 5).when(open_left & open_right, 4).when(open_left, 2).when(open_right, 3).otherwise(1)


def proposition_ends(left: Column, right: Column, symmetric: Column) -> tuple[Column, Column]:
    """Ends as they enter a proposition's identity: in canonical order if the relation is symmetric."""
    return F.when(symmetric, F.least(left, right)).otherwise(left), F.when(symmetric, F.greatest(left, right)).otherwise(right)


def classify_presence(incoming: DataFrame, stored: DataFrame, key: str, witness: str) -> DataFrame:
    """Adds class: 0 novel, 1 exact, 2 conflict (the id is stored with another witness)."""
    known = stored.select(F.col(key).alias("_key"), F.col(witness).alias("_witness"))
    joined = incoming.join(known, F.col(key) == F.col("_key"), "left")
    return joined.withColumn("class", F.when(F.col("_key").isNull(), 0).when(F.col("_witness").eqNullSafe(F.col(witness)), 1).otherwise(2)).drop("_key", "_witness")


def unique(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row of each key: the one whose columns come first as JSON."""
    row = F.struct(*rows.columns)
    return rows.groupBy(*key).agg(F.min_by(row, F.to_json(row)).alias("_row")).select("_row.*")


def missing(incoming: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Rows to append so that a replay writes nothing; of incoming rows that share a key, see ``unique``."""
    return unique(incoming.join(stored.select(*key), key, "left_anti").select(*incoming.columns), key)


def verified_count(incoming: DataFrame, stored: DataFrame) -> int:
    """How many incoming rows are stored exactly, nulls included: it must equal their number after a write."""
    cols = incoming.columns
    a = incoming.distinct().select(F.struct(*cols).alias("row"), F.xxhash64(*cols).alias("h"))
    b = stored.select(*cols).distinct().select(F.struct(*cols).alias("other"), F.xxhash64(*cols).alias("h"))
    return a.join(b, "h").filter(F.col("row").eqNullSafe(F.col("other"))).count()


PROFILE_COUNTS = ("bytes", "files", "records", "fields", "nodes", "spans", "occurrences", "outputs")
DISPOSITIONS = ("persisted", "reused", "transformed", "lossy", "unsupported", "malformed", "unresolved", "rejected", "derived", "contradicted", "absent")
PROFILE_NEGATIVE = ("rejected", "lossy", "unsupported", "malformed", "unresolved")


def profile_faults(profiles: DataFrame, raw: str = "is_raw", exact: str = "is_exact", subjects: str = "closure_subjects") -> DataFrame:
    """Profiles that break a rule, with the first rule broken.

    Denominators must be positive (records and fields but for raw observations), dispositions must add up to the
    closure subjects, and an exact reconstruction loses nothing.
    """
    lacking = F.lit(False)
    for c in PROFILE_COUNTS:
        bad = F.col(c) <= 0
        lacking = lacking | (bad & ~F.col(raw) if c in ("records", "fields") else bad)
    total = sum((F.col(c) for c in DISPOSITIONS), F.lit(0))
    fault = F.when(lacking, "denominator").when(total != F.col(subjects), "closure").when(F.col(exact) & (F.col("lossy") != 0), "lossy_exact")
    return profiles.withColumn("fault", fault).filter("fault is not null")


def profile_summary(profiles: DataFrame) -> DataFrame:
    return profiles.agg(F.count("*").alias("profiles"), F.sum("closure_subjects").alias("subjects"), F.sum("persisted").alias("persisted"), F.sum(sum((F.col(c) for c in PROFILE_NEGATIVE), F.lit(0))).alias("negative"), F.sum(F.col("is_exact").cast("int")).alias("exact"))


def testimony_faults(rows: DataFrame, boundary: str) -> DataFrame:
    """Testimony out of range, not reduced, or not strictly increasing by id inside its boundary."""
    order = Window.partitionBy(boundary).orderBy("testimony_id", "position")
    repeated = F.lag("testimony_id").over(order) == F.col("testimony_id")
    n, d = F.col("uncertainty_numerator"), F.col("uncertainty_denominator")
    fault = (
        F.when(~F.col("source_type").between(1, 8), "source_type").when(~F.col("outcome_type").between(1, 9), "outcome_type").when(~F.col("disposition").between(1, 10), "disposition")
        .when((d <= 0) | (n > d) | ((n == 0) & (d != 1)) | ~reduced(n.cast("bigint"), d.cast("bigint")), "uncertainty").when(repeated, "repeated")
    )
    return rows.withColumn("fault", fault).filter("fault is not null")


def testimony_receipts(rows: DataFrame, boundary: str) -> DataFrame:
    """Per boundary its records, samples, uncertain and negative ones, and a fingerprint of the testimony it holds."""
    totals = [F.count("*").alias("records"), F.sum("sample_count").alias("samples"), F.count_if(F.col("uncertainty_numerator") != 0).alias("uncertain"), F.count_if(F.col("disposition").isin(*NEGATIVE_TESTIMONY)).alias("negative")]
    one = record_id("testimony", *map(F.col, ("testimony_id", "source_type", "outcome_type", "disposition", "uncertainty_numerator", "uncertainty_denominator", "sample_count")))
    return rows.groupBy(boundary).agg(*totals, set_fingerprint(one).alias("fingerprint"))


def admission_faults(requests: DataFrame, occurrences: DataFrame, claims: DataFrame, testimony: DataFrame, key: str) -> DataFrame:
    """Admissions whose occurrences, claims and bound testimony don't agree; each side is counted before it is joined.

    A zero-claim observation carries no evidence at all.
    """
    counted = requests
    for name, side in (("occurrences", occurrences), ("claims", claims), ("testimony", testimony)):
        counted = counted.join(side.groupBy(F.col(key).alias(f"_{name}")).agg(F.count("*").alias(name)), F.col(key) == F.col(f"_{name}"), "left").drop(f"_{name}").fillna(0, [name])
    fault = F.when((F.col("claims") == 0) & (F.col("testimony") > 0), "evidence_without_claim").when(F.col("claims") != F.col("testimony"), "testimony").when(F.col("occurrences") < F.col("claims"), "occurrences")
    return counted.withColumn("fault", fault).filter("fault is not null")


def catalog_faults(recipes: DataFrame) -> DataFrame:
    """Recipes (recipe, profile, parent, scope, ordinal) with an orphan, misplaced or ambiguous place in the tree."""
    parents = recipes.select(F.col("recipe").alias("_p"), F.col("profile").alias("_profile"), F.col("scope").alias("_scope"))
    joined = recipes.join(parents, F.col("parent") == F.col("_p"), "left")
    siblings = F.count("*").over(Window.partitionBy("profile", "parent", "ordinal"))
    fault = (
        F.when((F.col("scope") == 1) & F.col("parent").isNotNull(), "source_with_parent").when((F.col("scope") > 1) & F.col("_p").isNull(), "orphan")
        .when(F.col("_profile") != F.col("profile"), "foreign_parent").when(F.col("_scope") >= F.col("scope"), "scope_order").when(siblings > 1, "sibling_ordinal")
    )
    return joined.withColumn("fault", fault).filter("fault is not null").select(*recipes.columns, "fault")

"""The closed registry of operations: validate, transform, and a receipt of what was executed."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import dimensions, ident
from tesserae.operators import closure, linear, occurrence, resolve, standing

#: Operation codes.
OPCODES = {
    "identity_codepoint_batch": 0x20001,
    "trajectory_composition_decode_batch": 0x30001,
    "highway_coordinate_calculate_batch": 0x40001,
    "highway_registry_materialize_batch": 0x40002,
    "evidence_record_lineage_batch": 0x50001,
    "evidence_record_testimony_batch": 0x50002,
    "evidence_calculate_standing_batch": 0x50003,
    "source_profile_validate_batch": 0x60001,
    "world_admission_close_batch": 0x60002,
    "reference_topology_resolve_batch": 0x60003,
    "reference_mapping_resolve_batch": 0x60004,
    "stock_recipe_compile_catalog_batch": 0x60005,
    "cognition_solve_packet": 0x70001,
    "universal_ast_apply_packet": 0x80001,
}


#: Column types whose text is the same for everyone; others are taken as JSON.
SIMPLE = frozenset(("string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp"))


class InvalidBatch(ValueError):
    """A record breaks a rule; the whole batch is rejected and nothing is published."""


class Operation(NamedTuple):
    name: str
    faults: Callable[[DataFrame], DataFrame]
    transform: Callable[[DataFrame], DataFrame]


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, digest): a fingerprint of a table that doesn't depend on the order of rows, from sums that merge.

    A row counts by the SHA-256 of its columns' texts in the order of their names; nulls have a text of their own.
    """
    row = ident.record_id("row", *[F.col(f"`{c}`") if t in SIMPLE else F.to_json(F.col(f"`{c}`")) for c, t in sorted(df.dtypes)])
    return df.select(row.alias("id")).agg(F.count("*").alias("rows"), ident.set_fingerprint(F.col("id")).alias("digest"))


def _none(df: DataFrame) -> DataFrame:
    return df.limit(0)


_KEY = ["authority", "release", "namespace", "local_identifier", "version", "kind"]


def coordinates(df: DataFrame) -> DataFrame:
    """A coordinate and a collision fingerprint, two domain-separated hashes of a six-part key."""
    return df.withColumn("coordinate", ident.record_id("coordinate", *map(F.col, _KEY))).withColumn("collision_fingerprint", ident.record_id("collision", *map(F.col, _KEY)))


def highways(df: DataFrame) -> DataFrame:
    """(registry, entries, fingerprint) of the closed enumerations that ``df`` (registry) asks for."""
    rows = [(name, code, text) for name, entries in dimensions.ENUMERATIONS.items() for code, text in entries.items()]
    entries = df.sparkSession.createDataFrame(rows, "registry string, code int, name string")
    entry = ident.record_id("highway", F.col("registry"), F.col("code"), F.col("name"))
    return df.join(entries, "registry").groupBy("registry").agg(F.count("*").alias("entries"), ident.sequence_fingerprint(F.col("code"), entry).alias("fingerprint"))


def standing_faults(df: DataFrame) -> DataFrame:
    """Games (lane, rating, deviation, volatility, opponent, score) of unknown opponents, foreign scores or two standings of one lane."""
    lanes = df.groupBy(F.col("lane").alias("_lane")).agg(F.countDistinct("rating", "deviation", "volatility").alias("_states"))
    checked = df.join(lanes, F.col("lane") == F.col("_lane")).join(lanes.select(F.col("_lane").alias("_opponent")), F.col("opponent") == F.col("_opponent"), "left")
    return checked.filter("_states > 1 or _opponent is null or score not in (0.0, 0.5, 1.0) or deviation <= 0 or volatility <= 0")


def closed_worlds(df: DataFrame) -> DataFrame:
    """A receipt for each admission: its id binds the counts and all its receipts."""
    bound = F.concat_ws(":", "receipts")
    return df.select("admission", "occurrences", "claims", ident.record_id("world", *map(F.col, ("admission", "occurrences", "claims", "testimony")), bound).alias("receipt"))


def world_faults(df: DataFrame) -> DataFrame:
    """Admissions (admission, occurrences, claims, testimony, receipts) whose counts differ, or with a receipt that is lacking.

    A zero-claim observation carries no evidence; otherwise every occurrence has its claim and every claim its testimony.
    """
    counts = F.when(F.col("claims") == 0, F.col("testimony") == 0).otherwise((F.col("occurrences") == F.col("claims")) & (F.col("claims") == F.col("testimony")))
    sound = (F.size("receipts") == RECEIPTS) & F.forall("receipts", lambda r: r.isNotNull() & (r != "") & ~r.rlike("^0*$"))
    return df.filter(~F.coalesce(counts & sound, F.lit(False)))


def solved(df: DataFrame) -> DataFrame:
    """(k, value, disposition): the packet's constraints (i, j, a, b, c, w, evidence), solved."""
    found = linear.solve(linear.deduplicated(df), df.sparkSession.createDataFrame([], "k bigint, value double, weight double"))
    return found.x.select("k", "value", F.lit(found.disposition).alias("disposition"))


def applied_tree(df: DataFrame) -> DataFrame:
    """(artifact, span, role, binding): the binding of every span (artifact, span, parent, kind, role) of a tree to its role."""
    return df.select("artifact", "span", "role", ident.record_id("binding", *map(F.col, ("artifact", "span", "parent", "kind", "role"))).alias("binding"))


def tree_faults(df: DataFrame) -> DataFrame:
    """Spans without a role, that occur twice, or whose parent isn't a span of the artifact."""
    known = df.groupBy(F.col("artifact").alias("_artifact"), F.col("span").alias("_span")).agg(F.count("*").alias("_times"))
    up = df.join(known, (F.col("artifact") == F.col("_artifact")) & (F.col("parent") == F.col("_span")), "left").filter("role is null or parent is not null and _span is null").select("artifact", "span")
    return up.unionByName(known.filter("_times > 1").select(F.col("_artifact").alias("artifact"), F.col("_span").alias("span")))


#: Receipts that close a world admission.
RECEIPTS = 9

OPERATIONS = {
    o.name: o
    for o in (
        Operation("identity_codepoint_batch", lambda df: df.filter(~F.col("position").between(0, 0x10FFFF)), lambda df: df.withColumn("atom_id", F.lower(F.hex(ident.atom_id("position"))))),
        Operation("trajectory_composition_decode_batch", lambda df: df.filter("run < 1 or run > 65535"), occurrence.decoded),
        Operation("highway_coordinate_calculate_batch", lambda df: df.filter(F.greatest(*[F.col(c).isNull() for c in _KEY])), coordinates),
        Operation("evidence_record_testimony_batch", lambda df: resolve.testimony_faults(df, "boundary"), lambda df: resolve.testimony_receipts(df, "boundary")),
        Operation("source_profile_validate_batch", resolve.profile_faults, resolve.profile_summary),
        Operation("reference_topology_resolve_batch", lambda df: resolve.topology(df, _KEY).filter("conflict"), lambda df: resolve.topology(df, _KEY)),
        Operation("reference_mapping_resolve_batch", lambda df: df.filter("left is null or right is null"), lambda df: df.withColumn("disposition", resolve.mapping_disposition(F.col("left_disposition"), F.col("right_disposition")))),
        Operation("stock_recipe_compile_catalog_batch", resolve.catalog_faults, lambda df: df),
        Operation("highway_registry_materialize_batch", lambda df: df.filter(~F.coalesce(F.col("registry").isin(list(dimensions.ENUMERATIONS)), F.lit(False))), highways),
        Operation("evidence_calculate_standing_batch", standing_faults, lambda df: standing.rate_period(df.select("lane", "rating", "deviation", "volatility").distinct(), df.select("lane", "opponent", "score"))),
        Operation("world_admission_close_batch", world_faults, closed_worlds),
        Operation("cognition_solve_packet", lambda df: df.filter("i is null or j is null or a is null or b is null or c is null or w is null or w <= 0 or evidence is null"), solved),
        Operation("universal_ast_apply_packet", tree_faults, applied_tree),
        Operation("evidence_record_lineage_batch", _none, lambda df: closure.root_projection(df.select(F.col("child").alias("node")).union(df.select("parent")).distinct(), df)),
    )
}


def execute(name: str, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The operation's output and its receipt (operation, opcode, fingerprints, counts, receipt_id)."""
    if name not in OPERATIONS:
        raise InvalidBatch(f"unknown operation: {name}")
    operation = OPERATIONS[name]
    if not operation.faults(batch).isEmpty():
        raise InvalidBatch(f"{name}: a record is invalid")
    out = operation.transform(batch)
    none = lambda n, kind: F.lit(None).cast(kind).alias(n)
    before = fingerprint(batch).select(F.col("rows").alias("rows_in"), F.col("digest").alias("input"), none("rows_out", "bigint"), none("output", "string"))
    after = fingerprint(out).select(none("rows_in", "bigint"), none("input", "string"), F.col("rows").alias("rows_out"), F.col("digest").alias("output"))
    sealed = before.unionByName(after).agg(*[F.max(c).alias(c) for c in ("rows_in", "input", "rows_out", "output")])
    receipt = sealed.select(F.lit(name).alias("operation"), F.lit(OPCODES[name]).alias("opcode"), "*")
    return out, receipt.withColumn("receipt_id", ident.record_id("receipt", *map(F.col, ("operation", "input", "output"))))

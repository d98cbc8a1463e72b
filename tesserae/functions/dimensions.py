"""Closed enumerations as small dimension tables.  Fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ENUMERATIONS: dict[str, dict[int, str]] = {
    "record_kind": {1: "node", 2: "dependence_edge"},
    "epistemic_kind": {1: "observed", 2: "testimony", 3: "calculation", 4: "derivation", 5: "model_behavior", 6: "unknown", 7: "contradiction"},
    "source_type": {1: "standard", 2: "curated_dataset", 3: "corpus", 4: "direct_observation", 5: "calculation", 6: "model", 7: "self_assertion", 8: "external_provider"},
    "outcome_type": {1: "assertion", 2: "measurement", 3: "prediction", 4: "observed_consequence", 5: "mapping", 6: "definition", 7: "example", 8: "counterexample", 9: "unknown_boundary"},
    "testimony_disposition": {1: "persisted", 2: "reused", 3: "transformed", 4: "lossy", 5: "unsupported", 6: "malformed", 7: "unresolved", 8: "rejected", 9: "derived", 10: "contradicted"},
    "standing_outcome": {1: "confirm", 2: "refute", 3: "draw", 4: "uncertain", 5: "absent", 6: "unknown", 7: "denied", 8: "exhausted", 9: "invalid_execution"},
    "rule_flag": {1: "endpoint", 2: "present_declaration", 4: "retired_declaration"},
    "reference_disposition": {1: "present", 2: "retired", 6: "unresolved"},
    "mapping_flag": {1: "directed", 2: "symmetric"},
    "mapping_disposition": {1: "resolved", 2: "left_unresolved", 3: "right_unresolved", 4: "both_unresolved", 5: "retired_endpoint"},
    "search_disposition": {1: "complete", 2: "upper_bound", 3: "unsupported", 4: "denied", 5: "exhausted", 6: "contradicted", 7: "no_admissible_path", 8: "incomplete_boundary", 9: "partial", 10: "unknown"},
    "solver_disposition": {1: "converged", 2: "initially_satisfied", 3: "iteration_limit", 4: "singular_direction", 5: "numeric_failure"},
    "obligation_disposition": {1: "open", 2: "satisfied", 3: "unsupported", 4: "denied", 5: "exhausted", 6: "contradicted", 7: "unknown"},
    "completion": {1: "incomplete", 2: "complete", 3: "blocked"},
    "constraint_source": {1: "physicality", 2: "testimony", 3: "derived", 4: "standing"},
    "relation_family": {1: "container", 2: "constituent", 4: "predecessor", 8: "successor", 16: "cooccur", 32: "semantic"},
    "source_plane": {1: "physicality", 2: "testimony", 4: "calculation", 8: "geometry", 16: "standing"},
    "direction": {1: "forward", 2: "reverse", 3: "symmetric"},
    "scope_kind": {1: "source", 2: "release", 3: "collection", 4: "digital_object", 5: "structural_region", 6: "semantic_construction"},
    "artifact_mode": {1: "raw_octets", 2: "utf8_delimited", 3: "utf8_fixed_width"},
    "line_terminator": {0: "none", 1: "lf", 2: "crlf"},
    "effect_disposition": {0: "none", 1: "staged_inert", 2: "activation_admitted", 3: "activated"},
    "operation_kind": {1: "structural_calculation", 2: "indexed_search", 3: "research", 4: "experiment", 5: "clarification", 6: "explicit_unresolved", 7: "answer", 8: "correct", 9: "execute"},
    "highway_disposition": {1: "present", 2: "retired", 3: "absent", 4: "unknown", 5: "unsupported", 6: "unresolved", 7: "malformed", 8: "collision"},
}

#: Dispositions of testimony that count as negative.
NEGATIVE_TESTIMONY = (5, 6, 7, 8, 10)


def dimension(spark: SparkSession, name: str) -> DataFrame:
    """(code, name) of one enumeration: a table of at most ten rows."""
    return spark.createDataFrame(sorted(ENUMERATIONS[name].items()), "code int, name string")


def code_of(name: str, value: str) -> int:
    return next(k for k, v in ENUMERATIONS[name].items() if v == value)

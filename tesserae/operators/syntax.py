"""Span trees bound to roles by recipe rules, and source-scoped evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import ident

#: Flags of syntax spans.
NAMED, MISSING, ERROR, EXTRA, HAS_ERROR, EMPTY = 1, 2, 4, 8, 16, 32
PRESERVE, DECLARED_LOSS = 1, 2


class Unbound(ValueError):
    """A span matches no rule, or rules of several roles; ``spans`` has them."""

    def __init__(self, spans: DataFrame):
        super().__init__("spans without exactly one role")
        self.spans = spans


def matches(spans: DataFrame, rules: DataFrame) -> DataFrame:
    """Spans (span, provider, kind, field, flags) with every rule (provider, kind, field or null, required, forbidden, role, disposition) that applies."""
    r = rules.select(*[F.col(c).alias(f"_{c}") for c in ("provider", "kind", "field", "required", "forbidden")], "role", "disposition")
    joined = spans.join(r, (F.col("provider") == F.col("_provider")) & (F.col("kind") == F.col("_kind")), "left")
    fits = (F.col("_field").isNull() | F.col("_field").eqNullSafe(F.col("field"))) & (F.col("flags").bitwiseAND(F.col("_required")) == F.col("_required")) & (F.col("flags").bitwiseAND(F.col("_forbidden")) == 0)
    return joined.withColumn("fits", F.coalesce(fits, F.lit(False)))


def unbound(spans: DataFrame, rules: DataFrame) -> DataFrame:
    """(span, roles): spans that don't have exactly one role."""
    return matches(spans, rules).groupBy("span").agg(F.countDistinct(F.when(F.col("fits"), F.col("role"))).alias("roles")).filter("roles != 1")


def bindings(spans: DataFrame, rules: DataFrame) -> DataFrame:
    """(span, role, disposition) of every span; any unmapped or ambiguous span fails the batch."""
    bad = unbound(spans, rules)
    if not bad.isEmpty():
        raise Unbound(bad)
    return matches(spans, rules).filter("fits").groupBy("span", "role").agg(F.min("disposition").alias("disposition"))


def closed_evidence(claims: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges for claims (claim) of one source: a root, a testimony for each claim, an edge between."""
    root = ident.record_id("root", F.lit(source))
    each = claims.select(ident.record_id("testimony", F.lit(source), F.col("claim")).alias("node"), "claim").distinct()
    top = claims.limit(1).select(root.alias("node"), F.lit(1).alias("epistemic_kind"))
    return top.unionByName(each.select("node", F.lit(2).alias("epistemic_kind"))), each.select(F.col("node").alias("child"), root.alias("parent"))

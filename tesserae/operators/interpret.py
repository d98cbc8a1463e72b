"""Multiway natural join of factor relations, with the rows that each derivation rests on."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Factor(NamedTuple):
    name: str
    rows: DataFrame
    slots: tuple[str, ...]
    size: int  # an upper bound of rows, for the order of joins


def _fan_out(factor: Factor, bound: set[str]) -> float:
    """How many rows of the factor a binding of its bound slots meets: one aggregate, whose distinct count is an estimate."""
    shared = [s for s in factor.slots if s in bound]
    facts = factor.rows.agg(F.count("*").alias("n"), F.approx_count_distinct(F.struct(*shared)).alias("keys")).first()
    return round(facts["n"] / max(facts["keys"], 1), 1)


def order_of(factors: list[Factor]) -> list[Factor]:
    """Greedy: most slots already bound first, then the least fan-out, then the smaller relation, then the name.

    The fan-out is measured only where relations have as many slots bound: a small relation with a coarse key multiplies
    rows by its size over that of the key, a large one with a fine key doesn't.
    """
    left, bound, out = list(factors), set(), []
    while left:
        most = max(len(bound & set(f.slots)) for f in left)
        tied = [f for f in left if len(bound & set(f.slots)) == most]
        fan_out = {f.name: _fan_out(f, bound) if most and len(tied) > 1 else 0 for f in tied}
        best = min(tied, key=lambda f: (fan_out[f.name], f.size, f.name))
        left.remove(best)
        bound |= set(best.slots)
        out.append(best)
    return out


def interpretations(factors: list[Factor]) -> DataFrame:
    """All joint bindings of the slots, with one ``row_<factor>`` column each: every derivation is kept."""
    first, *rest = order_of(factors)
    tagged = lambda f: f.rows.select(*f.slots, F.col("row_id").alias(f"row_{f.name}"))
    out, bound = tagged(first), set(first.slots)
    for f in rest:
        shared = [s for s in f.slots if s in bound]
        if not shared:
            raise ValueError(f"{f.name} shares no slot with the others; a product is not intended")
        out = out.join(tagged(f), shared)
        bound |= set(f.slots)
    return out

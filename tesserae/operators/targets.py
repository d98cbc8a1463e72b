"""Compiled targets: scope plans, one operator per slot, path mathematics and attention projections."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import ident
from tesserae.operators.linear import factored


def scope_plan(selectors: DataFrame, constraints: DataFrame) -> DataFrame:
    """Constraints for each slot by declarative selectors (slot, family mask, source mask); empty slots don't appear."""
    bits = lambda mask: F.filter(F.array(*[F.lit(1 << k) for k in range(6)]), lambda b: mask.bitwiseAND(b) != 0)
    wanted = selectors.select("slot", F.col("sources").alias("_sources"), F.explode(bits(F.col("families"))).alias("_bit"))
    spread = constraints.withColumn("_bit", F.explode(bits(F.col("family"))))
    return spread.join(wanted, "_bit").filter(F.col("source").bitwiseAND(F.col("_sources")) != 0).select("slot", *constraints.columns).distinct()


def slot_operators(jobs: DataFrame) -> DataFrame:
    """(slot, row, col, value) of every slot's quadratic operator."""
    a, b, w = F.col("a"), F.col("b"), F.col("w")
    cell = lambda r, c, v: F.struct(F.col(r).alias("row"), F.col(c).alias("col"), v.alias("value"))
    cells = F.array(cell("i", "i", w * a * a), cell("i", "j", w * a * b), cell("j", "i", w * a * b), cell("j", "j", w * b * b))
    return jobs.select("slot", F.explode(cells).alias("e")).groupBy("slot", "e.row", "e.col").agg(F.sum("e.value").alias("value"))


def identical_slots(operators: DataFrame) -> DataFrame:
    """Pairs of slots whose operators are the same: a target must not have them."""
    entry = F.struct("row", "col", "value")
    prints = operators.groupBy("slot").agg(ident.set_fingerprint(ident.record_id("operator_entry", F.to_json(entry))).alias("print"))
    other = prints.select(F.col("slot").alias("other"), "print")
    return prints.join(other, "print").filter("slot < other").select("slot", "other")


#: The weight by which a path's ends are held.
BOUNDARY = 1e6


def chain_solution(uncertainty: list[tuple[int, int]], boundary: float = BOUNDARY) -> np.ndarray:
    """Values along a path whose steps hold with precision 1 - n/d, from 0 at its anchor to 1 at its goal."""
    weight = np.array([1 - n / d for n, d in uncertainty])
    size = len(weight) + 1
    matrix, right = np.zeros((size, size)), np.zeros(size)
    for k, w in enumerate(weight):
        matrix[k : k + 2, k : k + 2] += w * np.array([[1, -1], [-1, 1]])
    matrix[0, 0] += boundary
    matrix[-1, -1] += boundary
    right[-1] = boundary
    return np.linalg.solve(matrix + np.eye(size) * 1e-12, right)


def path_values(paths: DataFrame) -> DataFrame:
    """Adds anchor_value, goal_value and accepted to paths with ``steps array<struct<n,d>>``.

    A path is a chain of resistances 1 / (1 - n/d) between its two boundaries, so the ends of ``chain_solution`` have a
    closed form: what flows is one over the sum of all resistances.  A step of no certainty lets nothing through.
    """
    resistance = F.aggregate("steps", F.lit(0.0), lambda total, s: total + F.when(s["n"] == s["d"], F.lit(float("inf"))).otherwise(s["d"] / (s["d"] - s["n"])))
    flow = F.when(F.size("steps") > 0, 1 / (resistance + F.lit(2 / BOUNDARY)))
    ends = paths.withColumn("anchor_value", F.coalesce(flow / BOUNDARY, F.lit(0.0))).withColumn("goal_value", F.coalesce(1 - flow / BOUNDARY, F.lit(0.0)))
    return ends.withColumn("accepted", F.col("goal_value") > F.col("anchor_value"))


def attention(qk: np.ndarray, vo: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """Query, key, value and output matrices over one orthonormal basis of both operators' leading spaces.

    The basis is orthogonalised twice; each factor pair multiplies to its operator within that basis, the roots of its
    singular values going to both.
    """
    if qk.shape == vo.shape and np.array_equal(qk, vo):
        raise ValueError("the two operators are identical")
    (u, s, _), (p, t, _) = (np.linalg.svd(m) for m in (qk, vo))
    columns = [u[:, k] for k in range(min(width, int((s > 1e-12).sum())))] + [p[:, k] for k in range(min(width, int((t > 1e-12).sum())))]
    basis: list[np.ndarray] = []
    for c in columns:
        for _ in range(2):
            for b in basis:
                c = c - (b @ c) * b
        norm = np.linalg.norm(c)
        if norm > 1e-9 and len(basis) < width:
            basis.append(c / norm)
    q = np.array(basis).T
    (query, key), (value, out) = factored(q.T @ qk @ q), factored(q.T @ vo @ q)
    return {"basis": q, "q": query, "k": key.T, "v": value, "o": out.T}

"""Sparse quadratic operators: constraints r = a * x_i + b * x_j + c of weight w, applied, materialised and solved."""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.closure import shared_folder

#: Up to so many unknowns the matrix is collected and solved on the driver; beyond, vectors stay DataFrames.
DRIVER_UNKNOWNS = 2_000


def _written(df: DataFrame) -> DataFrame:
    """A table in the shared folder, reread.  A checkpoint would keep the plan's estimate of its size, which
    the joins of a vector with itself multiply in every round; a table is estimated by its files."""
    path = f"{shared_folder(df.sparkSession)}/vectors-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deduplicated(constraints: DataFrame) -> DataFrame:
    """One constraint per evidence key; keys whose dependent copies disagree are an error."""
    value = F.struct("i", "j", "a", "b", "c", "w")
    folded = constraints.groupBy("evidence").agg(F.min(value).alias("v"), F.max(value).alias("u"))
    if not folded.filter("v != u").isEmpty():
        raise ValueError("dependent constraints conflict")
    return folded.select("evidence", "v.*")


def apply(constraints: DataFrame, x: DataFrame) -> DataFrame:
    """(k, y): the operator's product with x (k, value), without its matrix."""
    xi, xj = x.select(F.col("k").alias("i"), F.col("value").alias("xi")), x.select(F.col("k").alias("j"), F.col("value").alias("xj"))
    r = F.col("a") * F.col("xi") + F.col("b") * F.col("xj")
    each = constraints.join(xi, "i").join(xj, "j").select(F.explode(F.array(F.struct(F.col("i").alias("k"), (F.col("a") * F.col("w") * r).alias("y")), F.struct(F.col("j").alias("k"), (F.col("b") * F.col("w") * r).alias("y")))).alias("t"))
    return each.groupBy("t.k").agg(F.sum("t.y").alias("y"))


def energy(constraints: DataFrame, x: DataFrame) -> DataFrame:
    xi, xj = x.select(F.col("k").alias("i"), F.col("value").alias("xi")), x.select(F.col("k").alias("j"), F.col("value").alias("xj"))
    r = F.col("a") * F.col("xi") + F.col("b") * F.col("xj") + F.col("c")
    return constraints.join(xi, "i").join(xj, "j").agg((F.sum(F.col("w") * r * r) / 2).alias("energy"))


def matrix(constraints: DataFrame) -> DataFrame:
    """The operator's entries (row, col, value), sparse."""
    cell = lambda r, c, v: F.struct(F.col(r).alias("row"), F.col(c).alias("col"), v.alias("value"))
    a, b, w = F.col("a"), F.col("b"), F.col("w")
    cells = F.array(cell("i", "i", w * a * a), cell("i", "j", w * a * b), cell("j", "i", w * a * b), cell("j", "j", w * b * b))
    return constraints.select(F.explode(cells).alias("e")).groupBy("e.row", "e.col").agg(F.sum("e.value").alias("value"))


def right_side(constraints: DataFrame) -> DataFrame:
    """(k, value): minus the gradient's constant part."""
    part = lambda k, f: F.struct(F.col(k).alias("k"), (-F.col("w") * F.col("c") * F.col(f)).alias("value"))
    return constraints.select(F.explode(F.array(part("i", "a"), part("j", "b"))).alias("t")).groupBy("t.k").agg(F.sum("t.value").alias("value"))


class Solution(NamedTuple):
    x: DataFrame
    disposition: str
    rounds: int
    residual: float


def solve(constraints: DataFrame, boundary: DataFrame, regular: float = 1e-6, tolerance: float = 1e-10, rounds: int = 1000) -> Solution:
    """Solves (L + R + regular) x = b + R g by conjugate gradients; ``boundary`` has k, value g and weight R.

    Residuals are scaled by the matrix's diagonal, so that unknowns in many constraints don't slow the others down.
    Few unknowns are solved on the driver, behind a count; otherwise every product is a DataFrame operation, and a
    round writes one table.
    """
    spark = constraints.sparkSession
    unknowns = constraints.select(F.col("i").alias("k")).unionByName(constraints.select(F.col("j").alias("k"))).unionByName(boundary.select("k")).distinct()
    n = unknowns.count()
    if n <= DRIVER_UNKNOWNS:
        names = [r["k"] for r in unknowns.orderBy("k").collect()]
        place = {k: p for p, k in enumerate(names)}
        dense, b = np.eye(n) * regular, np.zeros(n)
        for r in matrix(constraints).collect():
            dense[place[r["row"]], place[r["col"]]] += r["value"]
        for r in right_side(constraints).collect():
            b[place[r["k"]]] += r["value"]
        for r in boundary.collect():
            dense[place[r["k"]], place[r["k"]]] += r["weight"]
            b[place[r["k"]]] += r["weight"] * r["value"]
        diagonal = np.diag(dense)
        scale = 1 / np.where(diagonal > 0, diagonal, 1)
        x, r = np.zeros(n), b.copy()
        p = scale * r
        rr, rz = r @ r, r @ p
        stop, done = tolerance * max(1.0, np.sqrt(rr)), 0
        disposition = "initially_satisfied" if np.sqrt(rr) <= stop else "iteration_limit"
        while disposition == "iteration_limit" and done < rounds:
            q = dense @ p
            curve = p @ q
            if curve <= 0:
                disposition = "singular_direction"
                break
            x, r = x + rz / curve * p, r - rz / curve * q
            z = scale * r
            rr, rz, old = r @ r, r @ z, rz
            p, done = z + rz / old * p, done + 1
            if np.sqrt(rr) <= stop:
                disposition = "converged"
        rows = list(zip(names, x.tolist(), strict=True))
        return Solution(spark.createDataFrame(rows, f"k {unknowns.schema['k'].dataType.simpleString()}, value double"), disposition, done, float(np.sqrt(rr)))
    constraints = _written(constraints)
    held = boundary.select("k", "weight", F.col("value").alias("g"))
    square = matrix(constraints).filter("row = col").select(F.col("row").alias("k"), F.col("value").alias("own"))
    known = unknowns.join(right_side(constraints), "k", "left").join(held, "k", "left").join(square, "k", "left")
    plus = F.coalesce("weight", F.lit(0.0)) + regular
    size = F.coalesce("own", F.lit(0.0)) + plus
    known = known.select("k", plus.alias("plus"), F.when(size > 0, 1 / size).otherwise(1.0).alias("scale"), (F.coalesce("value", F.lit(0.0)) + F.coalesce(F.col("weight") * F.col("g"), F.lit(0.0))).alias("r"))
    state = _written(known).select("k", "plus", "scale", F.lit(0.0).alias("x"), "r", (F.col("scale") * F.col("r")).alias("p"))
    r, z = F.col("r"), F.col("scale") * F.col("r")
    rr, rz = state.agg(F.sum(r * r), F.sum(r * z)).first()
    stop, done = tolerance * max(1.0, rr**0.5), 0
    disposition = "initially_satisfied" if rr**0.5 <= stop else "iteration_limit"
    while disposition == "iteration_limit" and done < rounds:
        q = apply(constraints, state.select("k", F.col("p").alias("value")))
        step = _written(state.join(q, "k", "left").select(*state.columns, (F.coalesce("y", F.lit(0.0)) + F.col("plus") * F.col("p")).alias("q")))
        curve = step.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        if curve <= 0:
            disposition = "singular_direction"
            break
        alpha = rz / curve
        moved = step.select("k", "plus", "scale", (F.col("x") + alpha * F.col("p")).alias("x"), (r - alpha * F.col("q")).alias("r"), "p")
        old = rz
        rr, rz = moved.agg(F.sum(r * r), F.sum(r * z)).first()
        state, done = moved.withColumn("p", z + rz / old * F.col("p")), done + 1
        if rr**0.5 <= stop:
            disposition = "converged"
    return Solution(state.select("k", F.col("x").alias("value")), disposition, done, rr**0.5)


def factored(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """u, v with u @ v.T = values: singular values fall, their roots go to both, each u's largest entry is positive."""
    u, s, vt = np.linalg.svd(values, full_matrices=False)
    sign = np.sign(u[np.abs(u).argmax(axis=0), np.arange(len(s))])
    sign[sign == 0] = 1
    root = np.sqrt(s)
    return u * sign * root, vt.T * sign * root


def centroids(rows: DataFrame, key: str, components: list[str], multiplicity: str) -> DataFrame:
    """Multiplicity-weighted arithmetic means and their norm (radius) per key; partial sums merge."""
    total = F.sum(multiplicity)
    means = [(F.sum(F.col(c) * F.col(multiplicity)) / total).alias(c) for c in components]
    out = rows.groupBy(key).agg(*means, total.alias("multiplicity"))
    return out.withColumn("radius", F.sqrt(sum((F.col(c) * F.col(c) for c in components), F.lit(0.0))))

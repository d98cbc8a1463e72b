"""Connected components by contraction.

In each round every task merges the edges of its own partition (union-find by numpy), so that a node leaves a task
with one root, however many edges it has there.  A node then meets its roots, one per task at most: the least becomes
its label, and the others are joined to it by edges of a smaller graph.  When that graph is small by count it is
finished in one task; until then rounds go on.  Labels are composed backwards at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.shared import checkpointed

#: A graph of no more edges than this is finished in one task; about 50 MB of arrays.
ONE_TASK = 500_000


def least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges and the least node of each one's component."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return nodes, nodes[label]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label != label[label]).any():
            label = label[label]


def _merged(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in each partition of the edges (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            # what is merged so far stands for its edges: at most one a node
            u, v = least_labels(np.concatenate((u, np.asarray(batch.column(0)))), np.concatenate((v, np.asarray(batch.column(1)))))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["node", "root"])

    return edges.select("u", "v").mapInArrow(run, "node bigint, root bigint")


def components(edges: DataFrame, rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) of every node of the edges (u, v); a component is named by its least node."""
    edges = checkpointed(edges.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")))
    layers: list[DataFrame] = []
    for _ in range(rounds):
        if edges.count() <= one_task:
            out = checkpointed(_merged(edges.coalesce(1)).select("node", F.col("root").alias("component")))
            for layer in reversed(layers):
                above = out.select(F.col("node").alias("label"), "component")
                out = checkpointed(layer.join(above, "label", "left").select("node", F.coalesce("component", "label").alias("component")))
            return out
        met = checkpointed(_merged(edges).groupBy("node").agg(F.min("root").alias("label"), F.collect_set("root").alias("roots")))
        layers.append(met.select("node", "label"))
        edges = checkpointed(met.select(F.col("label").alias("u"), F.explode("roots").alias("v")).filter("u != v").distinct())
    raise RuntimeError("components didn't settle")

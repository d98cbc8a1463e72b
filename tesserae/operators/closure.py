"""Recursive operators: lineage closure, cycle detection, level-wise composition and exact readback.

Loops run as many rounds as the graph is deep, each a few shuffles; every round's result is checkpointed into the
shared folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.ident import composite_id


class CycleError(ValueError):
    """The graph isn't acyclic; ``nodes`` is the table of nodes, or edges between them, on or behind cycles."""

    def __init__(self, nodes: DataFrame):
        super().__init__("the lineage has a cycle")
        self.nodes = nodes


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in ``spark.checkpoint.dir``."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in ``spark.checkpoint.dir``, read again: computed once, and of a size that joins can plan by."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, set as checkpoint directory if there is none yet.

    A folder of this machine's own is made only where none is set and nothing runs elsewhere.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tesserae-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge endpoints that are no node: two anti-joins."""
    known = nodes.select("node")
    ends = edges.select(F.col("child").alias("node")).unionByName(edges.select(F.col("parent").alias("node")))
    return ends.distinct().join(known, "node", "left_anti")


def cyclic(edges: DataFrame) -> DataFrame:
    """What is left after peeling nodes without parents again and again: empty if and only if there is no cycle.

    As many rounds as the graph is deep: it ends where a round peels nothing.
    """
    left = checkpointed(edges.select("child", "parent").distinct())
    count = left.count()
    while count:
        children = left.select(F.col("child").alias("parent")).distinct()
        left = checkpointed(left.join(children, "parent", "left_semi").select("child", "parent"))
        now = left.count()
        if now == count or not now:
            break
        count = now
    return left


def root_projection(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root, depth): every parentless ancestor of each node with the least path depth; a root has itself at 0.

    Unknown endpoints and cycles reject the whole batch.
    """
    if not dangling(nodes, edges).isEmpty():
        raise ValueError("an edge names an unknown node")
    rest = cyclic(edges)
    if not rest.isEmpty():
        raise CycleError(rest)
    edges = checkpointed(edges.select("child", "parent").distinct())
    roots = nodes.select("node").join(edges.select(F.col("child").alias("node")), "node", "left_anti")
    found = checkpointed(roots.select("node", F.col("node").alias("root"), F.lit(0).alias("depth")))
    frontier = found
    while True:  # the graph is acyclic, so frontiers run out
        reached = frontier.join(edges, F.col("node") == F.col("parent")).groupBy(F.col("child").alias("node"), "root").agg(F.min(F.col("depth") + 1).alias("depth"))
        frontier = checkpointed(reached.join(found.select("node", "root"), ["node", "root"], "left_anti"))  # a first arrival is the shallowest
        if frontier.isEmpty():
            return found
        found = checkpointed(found.unionByName(frontier))


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): 0 for nodes without children, otherwise 1 + the highest level of a child.

    ``edges`` has container and entity.  Edges whose entity has no edge of its own are peeled off in each round; the
    containers of what is left after ``k`` rounds have a level of more than ``k``.  Where a round peels nothing there is
    a cycle.  Joins are sorted, as a table sent to every task anew in each round goes through the driver.
    """
    left = written(edges.select("container", "entity").distinct())
    nodes = left.select(F.col("container").alias("node")).unionByName(left.select(F.col("entity").alias("node")))
    reached, count, k = nodes.withColumn("level", F.lit(0)), left.count(), 0
    while count:
        k += 1
        above = left.select(F.col("container").alias("_above")).distinct()
        reached = reached.unionByName(left.select(F.col("container").alias("node"), F.lit(k).alias("level")))
        left = written(left.join(above.hint("merge"), F.col("entity") == F.col("_above"), "left_semi"))
        now = left.count()
        if now == count:
            raise CycleError(left.select(F.col("container").alias("node")).distinct())
        count = now
    return reached.groupBy("node").agg(F.max("level").alias("level"))


def compositions(requests: DataFrame) -> DataFrame:
    """(request, id, level): the composite id of every request, each computed once, level by level.

    ``requests`` has request, ordinal, and of each child either ``entity``, an id that is known, or ``prior``, another
    request.  A level is one more than that of the deepest prior; what depends on itself or on an unknown request is
    refused as a whole.
    """
    rows = checkpointed(requests.select("request", "ordinal", F.col("entity").alias("_id"), "prior", F.lit(-1).alias("_level")))
    done, left = None, rows.select("request").distinct().count()
    while left:
        each = rows.groupBy("request").agg(F.count(F.when(F.col("_id").isNull(), 1)).alias("_open"), F.max("_level").alias("_level"), F.sort_array(F.collect_list(F.struct("ordinal", "_id"))).alias("_children"))
        ready = each.filter("_open = 0").select("request", composite_id(F.transform("_children", lambda c: c["_id"])).alias("id"), (F.col("_level") + 1).alias("level"))
        ready = checkpointed(ready)
        n = ready.count()
        if not n:
            raise CycleError(rows.select(F.col("request").alias("node")).distinct())
        done, left = (ready if done is None else checkpointed(done.unionByName(ready))), left - n
        if left:
            known = ready.select(F.col("request").alias("_prior"), F.col("id").alias("_found"), F.col("level").alias("_at"))
            waiting = rows.join(ready.select("request"), "request", "left_anti").join(known, F.col("prior") == F.col("_prior"), "left")
            rows = checkpointed(waiting.select("request", "ordinal", F.coalesce("_id", "_found").alias("_id"), "prior", F.greatest("_level", F.coalesce("_at", F.lit(-1))).alias("_level")))
    return done if done is not None else rows.select("request", F.col("_id").alias("id"), F.col("_level").alias("level"))


def cycle_path(edges: DataFrame) -> list:
    """One closed path of edges of which every node has a parent, as ``cyclic`` leaves them: its nodes, the first again at the end.

    From the least node it always goes on to the least parent.  Jumps are doubled until they exceed the number of
    nodes, so that the walk is on the cycle; then only the cycle is walked.
    """
    step = checkpointed(edges.groupBy("child").agg(F.min("parent").alias("to")))
    n, jump, at = step.count(), step, step.agg(F.min("child")).first()[0]
    while n:
        at = jump.filter(F.col("child") == F.lit(at)).first()["to"]
        n >>= 1
        jump = checkpointed(jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.child")).select(F.col("a.child").alias("child"), F.col("b.to").alias("to")))
    path = [at]
    while len(path) == 1 or path[-1] != at:
        path.append(step.filter(F.col("child") == F.lit(path[-1])).first()["to"])
    return path


def expanded_text(roots: DataFrame, children: DataFrame, atoms: DataFrame, rounds: int = 64) -> DataFrame:
    """(root, text): exact readback of each root by expanding (container, ordinal, entity) down to (entity, text) atoms.

    Paths are arrays of ordinals, whose order is that of the text.  An entity that is neither is an error.  Atoms are
    written first, so that a small vocabulary is broadcast and pieces don't move to meet it.
    """
    below = written(children.select(F.col("container").alias("_above"), F.col("ordinal").alias("_ordinal"), F.col("entity").alias("_entity")))
    known = written(atoms.select(F.col("entity").alias("_atom"), "text"))
    open_ = roots.select(F.col("entity").alias("root"), "entity", F.array().cast("array<bigint>").alias("path"))
    done = None
    for _ in range(rounds):
        seen = written(open_.join(known, F.col("entity") == F.col("_atom"), "left"))
        if not seen.filter("entity is null").isEmpty():
            raise ValueError("an entity has neither children nor a text")
        leaves, inner = seen.filter("_atom is not null").select("root", "path", "text"), seen.filter("_atom is null")
        done = leaves if done is None else done.unionByName(leaves)
        if inner.isEmpty():
            pieces = F.sort_array(F.collect_list(F.struct("path", "text")))
            return done.groupBy("root").agg(F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"))
        open_ = inner.join(below, F.col("entity") == F.col("_above"), "left").select("root", F.col("_entity").alias("entity"), F.concat("path", F.array("_ordinal")).alias("path"))
    raise RuntimeError("the expansion didn't end: the structure has a cycle")

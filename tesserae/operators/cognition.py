"""Forward passes over obligations, the selection of an answer, discourse frames and small programs of steps.

These are driver loops over a few rows; all set operations inside them are DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import guidance
from tesserae.operators.closure import checkpointed

COMPLETE, LAYER_LIMIT, NO_OPERATION, BLOCKED = "complete", "layer_limit", "no_operation", "blocked"


class Pass(NamedTuple):
    obligations: DataFrame
    disposition: str
    layers: int


def forward_pass(obligations: DataFrame, enumerate_operations: Callable[[DataFrame], DataFrame], execute: Callable[[DataFrame], DataFrame], key: list[str], layers: int = 16) -> Pass:
    """Opens, enumerates, selects, executes and resolves until complete, blocked, out of layers or without progress.

    ``enumerate_operations`` gets open obligations and gives operations with the key; ``execute`` gets the selected
    ones and gives resolutions (key, disposition).
    """
    state = checkpointed(obligations)
    for layer in range(layers + 1):
        goal = state.withColumn("_all", F.lit(1))
        done = guidance.completion(goal, "_all").first()
        if done is None or done["completion"] == guidance.COMPLETE:
            return Pass(state, COMPLETE, layer)
        if done["completion"] == guidance.BLOCKED:
            return Pass(state, BLOCKED, layer)
        if layer == layers:
            break
        open_ = state.filter(F.col("disposition") == guidance.OPEN)
        selected = guidance.best_operation(enumerate_operations(open_), key[0])
        after = checkpointed(guidance.resolved(state, execute(selected), key))
        if after.filter(F.col("disposition") == guidance.OPEN).count() >= open_.count():
            return Pass(state, NO_OPERATION, layer)
        state = after
    return Pass(state, LAYER_LIMIT, layers)


def selected_act(answers: DataFrame, completed: Pass) -> DataFrame:
    """The primary answer: least rank, path and entity; only from a complete pass."""
    if completed.disposition != COMPLETE:
        raise ValueError(f"the forward pass is {completed.disposition}")
    return answers.orderBy("rank", "path_id", "entity_id").limit(1)


def next_frames(frames: DataFrame, turns: DataFrame) -> DataFrame:
    """Frames (discourse, turn, content) with the turns (discourse, content) that follow their latest, never changing one."""
    last = frames.groupBy("discourse").agg(F.max("turn").alias("_last"))
    fresh = turns.join(last, "discourse", "left").select("discourse", (F.coalesce("_last", F.lit(0)) + 1).alias("turn"), "content")
    return frames.unionByName(fresh.withColumn("turn", F.col("turn").cast(frames.schema["turn"].dataType)))


def forward_passes(obligations: DataFrame, enumerate_operations: Callable[[DataFrame], DataFrame], execute: Callable[[DataFrame], DataFrame], goal: str, key: list[str], layers: int = 16) -> tuple[DataFrame, DataFrame]:
    """One forward pass a goal, all in step: the obligations after it, and (``goal``, ``state``) of every goal.

    A goal stops by itself when it is complete, blocked or a layer resolves nothing of it; the others go on.
    """
    state = checkpointed(obligations)
    stuck = checkpointed(obligations.select(goal).limit(0))
    for layer in range(layers + 1):
        done = guidance.completion(state, goal)
        ongoing = checkpointed(done.filter(F.col("completion") == guidance.INCOMPLETE).select(goal).join(stuck, goal, "left_anti"))
        if layer == layers or ongoing.isEmpty():
            break
        open_ = state.filter(F.col("disposition") == guidance.OPEN).join(ongoing, goal, "left_semi")
        selected = guidance.best_operation(enumerate_operations(open_), key[0])
        after = checkpointed(guidance.resolved(state, execute(selected), key))
        left = after.filter(F.col("disposition") == guidance.OPEN).groupBy(goal).agg(F.count("*").alias("_left"))
        idle = open_.groupBy(goal).agg(F.count("*").alias("_open")).join(left, goal).filter("_left >= _open").select(goal)
        stuck = checkpointed(stuck.unionByName(idle))
        state = after
    ended = stuck.withColumn("_ended", F.lit(NO_OPERATION)).unionByName(ongoing.withColumn("_ended", F.lit(LAYER_LIMIT)))
    told = F.when(F.col("completion") == guidance.BLOCKED, BLOCKED).when(F.col("completion") == guidance.COMPLETE, COMPLETE).otherwise(F.col("_ended"))
    return state, done.join(ended, goal, "left").select(goal, told.alias("state"))


class Step(NamedTuple):
    kind: str  # interpret, execute or emit
    name: str
    inputs: tuple[str, ...]  # the observation or earlier steps, never literals
    run: Callable[..., DataFrame]


def run_program(steps: list[Step], observation: DataFrame, resume: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Runs a data-flow program; results of finished steps may be handed in to resume.  An ambiguous interpretation fails."""
    known: dict[str, DataFrame] = {"observation": observation, **(resume or {})}
    for step in steps:
        if step.name in known:
            continue
        if lacking := [i for i in step.inputs if i not in known]:
            raise ValueError(f"{step.name} needs {lacking[0]}")
        out = checkpointed(step.run(*[known[i] for i in step.inputs]))
        if step.kind == "interpret" and out.limit(2).count() > 1:
            raise ValueError(f"{step.name} is ambiguous")
        known[step.name] = out
    return known

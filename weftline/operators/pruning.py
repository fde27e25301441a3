"""Redundant steps: each step judged against the steps before it, each distinct prefix once.

Steps form a prefix tree: trajectories that begin alike share their nodes. A node is known by its depth and two sums
over the steps down to it, of hashes of (depth, step); a running window adds them up, so no prefix is ever built as a
list to be compared. A judge sees each node once, with those in its cache left out, and its verdicts are joined back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import is_state_changing

NODE = ["task", "depth", "one", "two"]


def with_nodes(steps: DataFrame, key: list[str], pos: list[str], step: list[str], task: str | None = None) -> DataFrame:
    """steps plus depth (from 0) and node, the prefix down to the step. step: the columns that make a step; task: a column
    that tells apart what is the same step otherwise, such as the instruction."""
    ordered = Window.partitionBy(*key).orderBy(*pos)
    told = F.struct(*[F.col(c) for c in step])
    at = steps.withColumn("depth", (F.row_number().over(ordered) - 1).cast("long"))
    of = F.lit("") if task is None else F.coalesce(F.col(task).cast("string"), F.lit(""))
    sums = [F.sum(F.xxhash64(F.lit(seed), "depth", F.to_json(told, {"ignoreNullFields": "false"})).cast("decimal(38,0)")).over(ordered).alias(name) for seed, name in ((1, "one"), (2, "two"))]
    return at.select(*steps.columns, "depth", of.alias("__task"), *sums).select(*steps.columns, "depth", F.struct(F.xxhash64("__task").alias("task"), "depth", "one", "two").alias("node"))


def judged(steps: DataFrame, key: list[str], pos: list[str], step: list[str], judge: Callable[[DataFrame], DataFrame], task: str | None = None, cache: DataFrame | None = None, changing: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(steps plus depth, node, redundant, reason; the verdicts of this run and of the cache).

    judge: from one row for each node that is not in the cache (its step with all columns, its key, depth and node) to node,
    redundant, reason; it may look its history up with `history`. A trajectory's first step and steps that change state
    are never redundant and are not judged; changing defaults to the words of state-changing tools in the step's first
    column. A node that the judge gives no verdict for is kept."""
    nodes = with_nodes(steps, key, pos, step, task)
    changing = is_state_changing(F.col(step[0])) if changing is None else changing
    asked = (F.col("depth") > 0) & ~F.coalesce(changing, F.lit(False))
    # One step stands for all that share its node.
    each = nodes.filter(asked).groupBy("node").agg(F.min_by(F.struct(*[c for c in nodes.columns if c != "node"]), F.struct(*key, *pos)).alias("s")).select("s.*", "node")
    new = each if cache is None else each.join(cache.select("node"), "node", "left_anti")
    verdicts = judge(new).select("node", "redundant", "reason")
    if cache is not None:
        verdicts = cache.select("node", "redundant", "reason").unionByName(verdicts)
    found = nodes.join(verdicts, "node", "left")
    why = F.when(F.coalesce(changing, F.lit(False)), F.lit("state-changing")).when(F.col("depth") == 0, F.lit("first")).otherwise(F.coalesce("reason", F.lit("")))
    return found.withColumn("redundant", asked & F.coalesce("redundant", F.lit(False))).withColumn("reason", why), verdicts


def history(asked: DataFrame, steps: DataFrame, key: list[str], pos: list[str], step: list[str]) -> DataFrame:
    """asked plus history: the steps before each asked one, in order. Only the trajectories that stand for a node are read."""
    mine = with_nodes(steps, key, pos, step).select(*key, F.col("depth").alias("__depth"), F.struct(F.col("depth").alias("at"), *step).alias("__step"))
    before = asked.select(*key, "depth", "node").join(mine, key).filter(F.col("__depth") < F.col("depth"))
    lists = before.groupBy("node").agg(F.array_sort(F.collect_list("__step")).alias("history"))
    return asked.join(lists, "node", "left")


def repeats(steps: DataFrame, key: list[str], pos: list[str], step: list[str]) -> Callable[[DataFrame], DataFrame]:
    """A judge by rule: a step is redundant if the same step stands before it in its trajectory."""
    place = F.row_number().over(Window.partitionBy(*key, *step).orderBy(*pos))
    again = steps.withColumn("__again", place > 1).select(*key, *pos, "__again")

    def judge(asked: DataFrame) -> DataFrame:
        found = asked.join(again, [*key, *pos])
        return found.select("node", F.col("__again").alias("redundant"), F.when(F.col("__again"), F.lit("repeated")).otherwise(F.lit("needed")).alias("reason"))

    return judge


def pruned(found: DataFrame, key: list[str], tool: str) -> DataFrame:
    """key, original, pruned (numbers of steps), kept (tools in order), ratio of removed steps."""
    kept = F.transform(F.array_sort(F.collect_list(F.when(~F.col("redundant"), F.struct("depth", F.col(tool).alias("tool"))))), lambda x: x["tool"])
    sums = found.groupBy(*key).agg(F.count("*").alias("original"), F.count_if(~F.col("redundant")).alias("pruned"), kept.alias("kept"))
    return sums.withColumn("ratio", F.round((F.col("original") - F.col("pruned")) / F.col("original"), 6))

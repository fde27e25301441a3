"""Trajectories: ordered tool sequences of sessions, their groups, segments and preconditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.hashing import trajectory_hash


def from_calls(calls: DataFrame, key: str, tool: str, order: list[str]) -> DataFrame:
    """key, trajectory, trajectory_hash: a session's tools in order, with `order` as full tie-breaker."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(tool).alias("tool"))))
    return calls.groupBy(key).agg(F.transform(ordered, lambda s: s["tool"]).alias("trajectory")).withColumn("trajectory_hash", trajectory_hash(F.col("trajectory")))


def groups(sessions: DataFrame, key: str) -> DataFrame:
    """One row a distinct trajectory: its first session and their number."""
    return sessions.groupBy("trajectory_hash", "trajectory").agg(F.min(key).alias("first_id"), F.count("*").alias("n_sessions"))


def stats(sessions: DataFrame) -> DataFrame:
    size = F.size("trajectory")
    return sessions.agg(
        F.count("*").alias("n_sessions"),
        F.count_distinct("trajectory_hash").alias("n_trajectories"),
        F.min(size).cast("long").alias("min_length"),
        F.max(size).cast("long").alias("max_length"),
        F.sum(size).cast("long").alias("total_length"),
    )


def meets_preconditions(trajectory: Column, needs: dict[str, list[str]]) -> Column:
    """Every tool's required tools occur somewhere before it; a map of a few tools."""
    if not needs:
        return F.lit(True)
    table = F.create_map(*[x for k, v in needs.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    return (F.size(trajectory) == 0) | F.forall(
        F.sequence(F.lit(1), F.greatest(F.size(trajectory), F.lit(1))),
        lambda i: F.size(F.array_except(F.coalesce(F.try_element_at(table, F.try_element_at(trajectory, i)), F.array().cast("array<string>")), F.slice(trajectory, 1, i - 1))) == 0,
    )


def segments(calls: DataFrame, key: str, order: list[str], begins: Column) -> DataFrame:
    """calls plus segment: a new one at each call that begins one, unless it is the first."""
    w = Window.partitionBy(key).orderBy(*order)
    place = F.row_number().over(w)
    return calls.withColumn("__begins", (begins & (place > 1)).cast("int")).withColumn("segment", F.sum("__begins").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__begins")


def feasible(fused: DataFrame, validated: DataFrame) -> DataFrame:
    """fused(id, server, segment_hash) to id, feasible: all its servers' segments are validated(server, segment_hash)."""
    known = validated.select("server", "segment_hash").distinct().withColumn("known", F.lit(True))
    return fused.join(known, ["server", "segment_hash"], "left").groupBy("id").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("feasible"))


def kept_steps(trajectory: Column, redundant: Column) -> Column:
    """The trajectory without the steps at the redundant places (from 0)."""
    return F.filter(trajectory, lambda t, i: ~F.array_contains(redundant, i))


def convergence(rounds: DataFrame, order: str, failed: str, least: float) -> DataFrame:
    """rounds plus rate (share of the round before's failures mended) and stop (rate under least)."""
    before = F.lag(failed).over(Window.orderBy(order))
    rate = F.when(before > 0, (before - F.col(failed)) / before)
    return rounds.withColumn("rate", rate).withColumn("stop", F.coalesce(rate < least, F.lit(False)))


def nested_trajectory(parts: Column) -> Column:
    """[{server: [tools]}] to ["server.tool"]."""
    return F.flatten(F.transform(parts, lambda m: F.flatten(F.transform(F.map_entries(m), lambda e: F.transform(e["value"], lambda t: F.concat(e["key"], F.lit("."), t))))))

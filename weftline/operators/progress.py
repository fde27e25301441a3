"""Ledgers of steps and tasks: what is done, what can go on, and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_by_status(rows: DataFrame, statuses: list[str], status: str = "status") -> DataFrame:
    """status, n for every status, zero where no row has it."""
    every = F.explode(F.array(*[F.struct(F.lit(s).alias(status), F.lit(0).cast("long").alias("n")) for s in statuses])).alias("x")
    zero = rows.sparkSession.range(1).select(every).select("x.*")
    return rows.groupBy(status).agg(F.count("*").alias("n")).unionByName(zero).groupBy(status).agg(F.sum("n").alias("n"))


def workflow_status(steps: DataFrame, key: str = "id", first: int = 3) -> DataFrame:
    """key, total, completed, failed, progress, errors: the first errors by pos, one row each by rank, so that
    no more are held."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    few = steps.filter(F.col("error").isNotNull()).withColumn("place", place).filter(F.col("place") <= first)
    errors = few.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "error"))), lambda e: e["error"]).alias("errors"))
    total = F.count("*")
    counts = steps.groupBy(key).agg(total.alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))
    none = F.array().cast("array<string>")
    return counts.join(errors, key, "left").select("*", (F.col("completed") / F.col("total")).alias("progress")).withColumn("errors", F.coalesce("errors", none))


def last_completed(steps: DataFrame, key: str = "id") -> DataFrame:
    """key, name of the step that was completed last (by completed_at, then name)."""
    done = steps.filter(F.col("completed_at").isNotNull())
    return done.groupBy(key).agg(F.max_by("name", F.struct("completed_at", "name")).alias("name"))


def is_complete(status: Column, completed: Column, total: Column) -> Column:
    return F.coalesce((F.lower(status) == "completed") | (completed >= total), F.lit(False))


def can_resume(status: Column) -> Column:
    return F.lower(status).isin("in_progress", "interrupted", "failed")


def resumable_from(steps: DataFrame, key: str = "id") -> DataFrame:
    """steps plus ready: all earlier steps (by pos) are completed."""
    before = Window.partitionBy(key).orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("ready", F.coalesce(F.bool_and(F.col("status") == "completed").over(before), F.lit(True)))


def never_redundant(steps: DataFrame, changing: Column, key: str = "id") -> DataFrame:
    """steps that a pruning judge may look at: not a sequence's first, and none that changes state."""
    first = F.min("pos").over(Window.partitionBy(key))
    return steps.withColumn("first_pos", first).filter((F.col("pos") > F.col("first_pos")) & ~changing).drop("first_pos")


def by_domain_count(combos: DataFrame, domains: str = "domains") -> DataFrame:
    """n_domains, n: combos by the number of their domains."""
    return combos.groupBy(F.size(domains).cast("long").alias("n_domains")).agg(F.count("*").alias("n"))


def undone(used: Column, available: Column) -> Column:
    """Context keys that nothing provides: `A.b` counts as A, results of steps are always there."""
    base = F.array_distinct(F.transform(used, lambda k: F.split(k, r"\.")[0]))
    return F.filter(F.array_except(base, available), lambda k: ~k.rlike("^step_.*_result$"))


def unique_names(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """rows plus unique: the name, or with its place among equal ones (name, name1, name2, ...). A numbered
    name that is another row's own name gives way: it gets an underscore before the number."""
    place = F.row_number().over(Window.partitionBy(name).orderBy(*order)) - 1
    numbered = rows.withColumn("unique", F.when(place == 0, F.col(name)).otherwise(F.concat(name, place.cast("string"))))
    taken = rows.select(F.col(name).alias("unique")).distinct().withColumn("taken", F.lit(True))
    fixed = F.when(F.col("taken") & (F.col("unique") != F.col(name)), F.regexp_replace("unique", "([0-9]+)$", "_$1")).otherwise(F.col("unique"))
    return numbered.join(taken, "unique", "left").withColumn("unique", fixed).drop("taken")


def by_server(combos: DataFrame) -> DataFrame:
    """server, n, trajectories: validated combos of each server."""
    return combos.groupBy("server").agg(F.count("*").alias("n"), F.count_distinct("trajectory_hash").alias("trajectories"))


def duration_seconds(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def within_limit(rows: DataFrame, items: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose array holds at most `most`, the others); a null array holds none."""
    fits = F.coalesce(F.size(items), F.lit(0)) <= most
    return rows.filter(fits), rows.filter(~fits)

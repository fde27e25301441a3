"""Writers: appends that skip what is there, upserts, merged files, dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def upserted(existing: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """existing with new's rows in place of those of equal keys; new's own repeats keep their first."""
    fresh = first_wins(new, key, order)
    return existing.join(fresh.select(*key), key, "left_anti").unionByName(fresh)


def append_new(spark: SparkSession, new: DataFrame, path: str, key: list[str], order: list[str]) -> None:
    """Appends rows whose key neither the table at path nor an earlier row of new has."""
    fresh = first_wins(new, key, order)
    try:
        there = spark.read.parquet(path).select(*key).distinct()
    except Exception as e:  # noqa: BLE001  only a table that isn't there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = None
    (fresh if there is None else fresh.join(there, key, "left_anti")).write.mode("append").parquet(path)


def split_results(rollouts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(successes, rejects)."""
    good = F.coalesce(F.col("success"), F.lit(False)) & F.col("error").isNull()
    return rollouts.filter(good), rollouts.filter(~good)


def write_lines(rows: DataFrame, path: str, partition: str | None = None, mode: str = "append") -> None:
    out = rows.write.mode(mode)
    (out.partitionBy(partition) if partition else out).json(path)


def routed_instances(combos: DataFrame, entities: list[str]) -> DataFrame:
    """kind, table, record for each instance of a combo's map; the domain prefix and numeric suffix of names go."""
    rows = combos.select("combo_id", F.explode("entity_instances").alias("name", "record"))
    bare = F.regexp_replace(F.element_at(F.split("name", r"\."), -1), r"_[0-9]+$", "")
    return rows.withColumn("table", bare).withColumn("kind", F.when(F.col("table").isin(*entities), "entities").otherwise("relationships")).drop("name")


def write_report(summary: DataFrame, samples: DataFrame, path: str) -> None:
    """summary (few rows) and samples as JSON under path."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    samples.write.mode("overwrite").json(f"{path}/samples")


def filtering_report(failures: DataFrame, stats: DataFrame, most: int = 5) -> DataFrame:
    """server, markdown: a server's counts and its first failures, at most `most`, by combo."""
    place = F.row_number().over(Window.partitionBy("server").orderBy("combo_id"))
    few = failures.withColumn("place", place).filter(F.col("place") <= most)
    listed = few.groupBy("server").agg(F.array_sort(F.collect_list(F.concat(F.lit("- "), "combo_id", F.lit(": "), F.coalesce("reason", F.lit("unknown"))))).alias("lines"))
    head = F.concat(F.lit("## "), "server", F.lit("\n"), F.col("validated_combos").cast("string"), F.lit(" of "), F.col("total_combos").cast("string"), F.lit(" valid ("), "pass_rate", F.lit(")"))
    return stats.join(listed, "server", "left").select("server", F.concat_ws("\n", F.concat(F.array(head), F.coalesce("lines", F.array().cast("array<string>")))).alias("markdown"))


def new_assertions(tasks: DataFrame, made: DataFrame, key: str = "id") -> DataFrame:
    """tasks with made's assertions where they have none; others keep theirs."""
    joined = tasks.join(made.select(key, F.col("assertions").alias("made")), key, "left")
    has = F.coalesce(F.size("assertions"), F.lit(0)) > 0
    return joined.withColumn("assertions", F.when(has, F.col("assertions")).otherwise(F.col("made"))).drop("made")

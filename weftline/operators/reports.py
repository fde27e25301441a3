"""Scores and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def composite(results: DataFrame, key: str = "id") -> DataFrame:
    """Per sample: product of the evaluators' scores, passed if all passed."""
    return results.groupBy(key).agg(F.product("score").alias("score"), F.bool_and("passed").alias("passed"))


def pass_rates(results: DataFrame, first: str, second: str, passed: str = "passed") -> DataFrame:
    """Counts by first, by second and over all in one pass; a null group stands for all."""
    return results.groupingSets([[first], [second], []], first, second).agg(F.count("*").alias("n"), F.count_if(passed).alias("n_passed"), F.grouping_id().cast("long").alias("level"))


def rated(rows: DataFrame, dims: list[str], overall: str, threshold: float, default: float = 3.0) -> DataFrame:
    """rows plus rating (the overall score, or the mean of the dimensions, missing ones at the
    default) and kept; rows that were never judged are kept."""
    mean = sum((F.coalesce(F.col(d).cast("double"), F.lit(default)) for d in dims), F.lit(0.0)) / len(dims)
    judged = F.col(overall).isNotNull()
    for d in dims:
        judged = judged | F.col(d).isNotNull()
    rating = F.when(judged, F.coalesce(F.col(overall).cast("double"), mean))
    return rows.withColumn("rating", rating).withColumn("kept", rating.isNull() | (rating >= threshold))

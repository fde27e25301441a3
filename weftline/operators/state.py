"""Database states as tables of records: differences, counts, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import UUID, is_placeholder

# Fixed values.
CREATION_DATES = ("opening_date", "registration_date", "creation_date")


def changes(initial: DataFrame, final: DataFrame, key: list[str], digest: str = "digest") -> DataFrame:
    """Rows of final that initial lacks (added or changed); deletions and repetitions don't count."""
    return final.select(*key, digest).distinct().join(initial.select(*key, digest).distinct(), [*key, digest], "left_anti")


def subset_verdict(gold: DataFrame, agent: DataFrame, key: list[str], digest: str = "digest") -> DataFrame:
    """Per key: gold changes, how many the agent lacks, passed if none."""
    made = agent.select(*key, digest).distinct().withColumn("__made", F.lit(1))
    joined = gold.distinct().join(made, [*key, digest], "left")
    return joined.groupBy(*key).agg(F.count("*").alias("n_gold"), F.count_if(F.col("__made").isNull()).alias("n_missing"), F.bool_and(F.col("__made").isNotNull()).alias("passed"))


def table_counts(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, n_before, n_after, delta of tables whose sizes differ."""
    a, b = before.groupBy(key).agg(F.count("*").alias("n_before")), after.groupBy(key).agg(F.count("*").alias("n_after"))
    both = a.join(b, key, "full_outer").na.fill(0, ["n_before", "n_after"])
    return both.withColumn("delta", F.col("n_after") - F.col("n_before")).filter("delta <> 0")


def orphans(child: DataFrame, parent: DataFrame, foreign: str, primary: str) -> DataFrame:
    """Child rows whose reference is not null and met by no parent."""
    return child.filter(F.col(foreign).isNotNull()).join(parent.select(F.col(primary).alias(foreign)).distinct(), foreign, "left_anti")


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def placeholder_fields(records: DataFrame, table: str, fields: str) -> DataFrame:
    """(table, field) of every field that holds a placeholder in some row; such are left out on all sides."""
    return records.select(table, F.explode(fields).alias("field", "value")).filter(is_placeholder(F.col("value"))).select(table, "field").distinct()


def is_dynamic(field: Column, value: Column, entity_ids: list[str], timestamps: list[str], free_text: list[str] = (), ignored: list[str] = ()) -> Column:
    """Fields that a comparison leaves out: marked ones, free text, ids of no entity, timestamps,
    numeric texts in *number* fields, dates of creation."""
    low = F.lower(field)
    uuid = F.lower(value).rlike(f"^{UUID}$")
    left_out = [
        F.contains(low, F.lit("number")) & value.rlike("^[0-9]+$"),
        low.isin(*timestamps),
        F.endswith(low, F.lit("_id")) & ~low.isin(*entity_ids),
        field.isin(*free_text) & ~uuid,
        field.isin(*ignored),
        *[F.contains(low, F.lit(x)) for x in CREATION_DATES],
    ]
    return F.exists(F.array(*left_out), lambda x: F.coalesce(x, F.lit(False)))

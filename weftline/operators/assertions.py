"""Named assertions over an expected and an actual state: each is a plan of what violates it.

A state is a dictionary of tables. An assertion names the tables it needs and gives the offending rows as (witness); it
holds if there are none. All assertions run as one query: their offenders are counted, and a few are kept, by name. Keys meet by shuffled hashes of distinct
ones, so that no table's keys are broadcast and no rows are sorted to meet them; the few are chosen with a heap of so many rows a task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

State = dict[str, DataFrame]


@dataclass(frozen=True)
class Assertion:
    """offenders: from (expected, actual) to rows with a column witness. needs: tables that both states, or just the actual
    one, must hold."""

    name: str
    offenders: Callable[[State, State], DataFrame]
    needs: tuple[str, ...] = ()
    both: bool = False


def witness(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("witness")


def unique(table: str, *columns: str) -> Assertion:
    """No two rows share these columns."""
    return Assertion(f"unique {table}({', '.join(columns)})", lambda _, s: s[table].groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1").select(witness(*columns, "n")), (table,))


def references(table: str, column: str, parent: str, key: str) -> Assertion:
    """Every value that isn't null is a key of the parent."""

    def of(_: State, s: State) -> DataFrame:
        keys = s[parent].select(F.col(key).alias(column)).distinct().hint("shuffle_hash")
        return s[table].filter(F.col(column).isNotNull()).join(keys, column, "left_anti").select(witness(column))

    return Assertion(f"references {table}.{column}", of, (table, parent))


def monotone(table: str, by: list[str], order: list[str], column: str) -> Assertion:
    """Within a group the column never falls from one row to the next."""

    def of(_: State, s: State) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order)
        return s[table].withColumn("before", F.lag(column).over(w)).filter(F.col(column) < F.col("before")).select(witness(*by, *order, column, "before"))

    return Assertion(f"monotone {table}.{column}", of, (table,))


def holds(table: str, condition: str) -> Assertion:
    """The condition is true of every row."""
    return Assertion(f"holds {table}: {condition}", lambda _, s: s[table].filter(~F.coalesce(F.expr(condition), F.lit(False))).select(witness(*s[table].columns)), (table,))


def kept(table: str, key: str) -> Assertion:
    """No expected key is missing."""
    return Assertion(f"kept {table}.{key}", lambda e, a: e[table].select(key).join(a[table].select(key).distinct().hint("shuffle_hash"), key, "left_anti").select(witness(key)), (table,), both=True)


def asserted(spark: SparkSession, assertions: list[Assertion], expected: State | None, actual: State | None, most: int = 3) -> DataFrame:
    """name, passed, skipped, n_offenders, witnesses (the `most` smallest) of each assertion. One whose tables a state lacks is
    skipped: neither passed nor failed, passed is null."""
    expected_, actual_ = expected or {}, actual or {}
    runs = [a for a in assertions if all(t in actual_ and (not a.both or t in expected_) for t in a.needs)]
    named = spark.createDataFrame([(a.name, a not in runs) for a in assertions], "name string, skipped boolean")
    none = spark.createDataFrame([], "name string, witness string")
    offenders = [a.offenders(expected_, actual_).select(F.lit(a.name).alias("name"), "witness") for a in runs]
    rows = reduce(DataFrame.unionByName, [none, *offenders])
    least = reduce(DataFrame.unionByName, [none, *(o.orderBy("witness").limit(most) for o in offenders)])
    few = least.groupBy("name").agg(F.slice(F.array_sort(F.collect_list("witness")), 1, most).alias("witnesses"))
    counted = rows.groupBy("name").agg(F.count("*").alias("n_offenders"))
    found = named.join(F.broadcast(counted), "name", "left").join(F.broadcast(few), "name", "left")
    n = F.coalesce("n_offenders", F.lit(0))
    return found.select("name", F.when(~F.col("skipped"), n == 0).alias("passed"), "skipped", n.alias("n_offenders"), F.coalesce("witnesses", F.array().cast("array<string>")).alias("witnesses"))


def environment_verdict(changes: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """key, passed, reason. changes: key, has_states, n_gold, n_missing (of gold's changes those that the agent lacks); results: key, name,
    passed of assertions. Without states a sample is skipped (passed null); without changes of gold's it passes the
    comparison at once; then its assertions must hold."""
    broken = results.filter(~F.coalesce("passed", F.lit(True))).groupBy(key).agg(F.min("name").alias("broken"))
    joined = changes.join(broken, key, "left")
    differs = (F.col("n_gold") > 0) & (F.col("n_missing") > 0)
    reason = F.when(~F.col("has_states"), "no state").when(differs, F.concat(F.col("n_missing").cast("string"), F.lit(" changes missing"))).when(F.col("broken").isNotNull(), F.concat(F.lit("assertion failed: "), "broken")).when(F.col("n_gold") == 0, "no changes expected").otherwise("")
    passed = F.when(F.col("has_states"), ~differs & F.col("broken").isNull())
    return joined.select(key, passed.alias("passed"), reason.alias("reason"))

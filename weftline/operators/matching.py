"""Golden calls against actual ones, records against records."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import materialize


def action_names(gold: DataFrame, actual: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """gold plus found: some actual call of the sample has the name. One call may serve many."""
    seen = actual.select(key, name).distinct().withColumn("found", F.lit(True))
    return gold.join(seen, [key, name], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def best_matches(gold: DataFrame, actual: DataFrame, differ: Column, key: str = "id", name: str = "name", pos: str = "pos", actual_pos: str = "a_pos") -> DataFrame:
    """(key, pos, found, mismatches, a_pos): for each golden call the actual call of its name with
    the fewest mismatches, the first of equals; `differ` counts them over the joined columns."""
    joined = gold.join(actual, [key, name], "left").withColumn("__n", F.when(F.col(actual_pos).isNotNull(), differ))
    best = F.min(F.struct(F.coalesce("__n", F.lit(1 << 30)).alias("n"), F.col(actual_pos).alias("at"))).alias("best")
    return joined.groupBy(key, pos).agg(best).select(key, pos, F.col("best.at").isNotNull().alias("found"), F.when(F.col("best.at").isNotNull(), F.col("best.n")).cast("long").alias("mismatches"), F.col("best.at").alias(actual_pos))


def action_scores(matches: DataFrame, key: str = "id") -> DataFrame:
    """Per sample: golden calls, names found, full matches; passed when all names are found."""
    full = F.col("found") & (F.col("mismatches") == 0)
    return matches.groupBy(key).agg(F.count("*").alias("n_gold"), F.count_if("found").alias("n_found"), F.count_if(full).alias("n_full"), F.bool_and("found").alias("passed"))


#: Agreeing fields are tried by sets as long as there are so few of them.
MOST_SETS = 64


def closest_records(left: DataFrame, right: DataFrame, group: list[str], key: str, other: str, fields: list[str]) -> DataFrame:
    """key, other, differing: for each left record the right record of its group, with another key, that differs in the
    fewest fields, of equals the smallest key. Nulls agree with nulls. Keys are distinct and not null.

    Tried for 0, 1, 2 ... differing fields; a record that has found its closest takes no further part. Records that
    differ in k fields agree in all others, and none are closer when k is tried, so for each set of the others the
    two smallest keys of each combination of values decide: no pair is formed, however many records share a value.
    Where there are more than MOST_SETS such sets, pigeonholes replace them: k + 1 blocks of fields, one of which
    must agree; unlike records meet in them pair by pair."""
    marks = lambda f: F.coalesce(F.concat(F.lit("="), F.col(f).cast("string")), F.lit("-"))
    values = F.array(*[marks(f) for f in fields]).alias("values")
    one = left.select(F.struct(*group).alias("of"), F.col(key).alias("key"), values)
    two = materialize(right.select(F.struct(*group).alias("of"), F.col(key).alias("other"), values), "records")
    pending, found = one, []
    for k in range(len(fields) + 1):
        sets = math.comb(len(fields), k) <= MOST_SETS
        best = materialize((_by_sets if sets else _by_blocks)(pending, two, len(fields), k), "closest")
        found.append(best.withColumn("differing", F.lit(k)))
        if k < len(fields):
            pending = materialize(pending.join(best.select("key"), "key", "left_anti"), "pending")
            if pending.isEmpty():
                break
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.select(F.col("key").alias(key), F.col("other").alias(other), "differing")


def _by_sets(pending: DataFrame, right: DataFrame, n: int, k: int) -> DataFrame:
    """key, other: the smallest other key that agrees in some n - k fields."""
    chosen = [set(c) for c in combinations(range(n), n - k)]
    held = F.explode(F.array(*[F.array(*[F.get("values", i) if i in c else F.lit("") for i in range(n)]) for c in chosen])).alias("held")
    place = F.row_number().over(Window.partitionBy("of", "held").orderBy("other"))
    least = right.select("of", "other", held).withColumn("place", place).filter("place <= 2").groupBy("of", "held").agg(F.min("other").alias("first"), F.max("other").alias("last"))
    met = pending.select("of", "key", held).join(least, ["of", "held"])
    other = F.when(F.col("first") != F.col("key"), F.col("first")).when(F.col("last") != F.col("key"), F.col("last"))
    return met.groupBy("key").agg(F.min(other).alias("other")).filter(F.col("other").isNotNull())


def _by_blocks(pending: DataFrame, right: DataFrame, n: int, k: int) -> DataFrame:
    """key, other: the smallest other key that differs in k fields. Equal records are compared once, by their two smallest keys."""
    blocks = [set(range(n)[i :: k + 1]) for i in range(k + 1)]
    held = F.explode(F.array(*[F.array(*[F.get("values", i) if i in b else F.lit("") for i in range(n)]) for b in blocks])).alias("held")
    alike = pending.select("of", F.col("values").alias("mine")).distinct().select("of", "mine", F.col("mine").alias("values")).select("of", "mine", held)
    place = F.row_number().over(Window.partitionBy("of", "values").orderBy("other"))
    unlike = right.withColumn("place", place).filter("place <= 2").groupBy("of", "values").agg(F.min("other").alias("first"), F.max("other").alias("last"))
    pairs = alike.join(unlike.select("of", "values", "first", "last", held), ["of", "held"])
    differing = F.size(F.filter(F.arrays_zip(F.col("mine").alias("a"), F.col("values").alias("b")), lambda x: x["a"] != x["b"]))
    near = pairs.filter((differing <= k) & (F.col("mine") != F.col("values"))).select("of", "mine", F.explode(F.array("first", "last")).alias("other")).distinct()
    place = F.row_number().over(Window.partitionBy("of", "mine").orderBy("other"))
    least = near.withColumn("place", place).filter("place <= 2").groupBy("of", F.col("mine").alias("values")).agg(F.min("other").alias("first"), F.max("other").alias("last"))
    other = F.when(F.col("first") != F.col("key"), F.col("first")).when(F.col("last") != F.col("key"), F.col("last"))
    return pending.join(least, ["of", "values"]).select("key", other.alias("other")).filter(F.col("other").isNotNull())


def subset_join(small: DataFrame, large: DataFrame, key: str, other: str, member: str) -> DataFrame:
    """(key, other) where all of key's members are other's: members meet by equality, and the
    counts decide, so no pair is formed that shares nothing. Members are distinct per key."""
    need = small.groupBy(key).agg(F.count("*").alias("__need"))
    return small.join(large, member).groupBy(key, other).agg(F.count("*").alias("__met")).join(need, key).filter("__met = __need").select(key, other)


def combos_of_domains(combos: DataFrame, wanted: DataFrame, domains: str = "domains") -> DataFrame:
    """Combos whose set of domains is one of those wanted, in any order."""
    key = F.array_sort(F.array_distinct(domains))
    return combos.withColumn("domain_key", key).join(wanted.select(key.alias("domain_key")).distinct(), "domain_key", "left_semi").drop("domain_key")


def equivalents(groups: DataFrame, values: DataFrame, value: str = "value") -> DataFrame:
    """values plus group_id: the abbreviation group of each known value, in any case; of several the later wins."""
    index = groups.groupBy(F.lower("member").alias("low")).agg(F.max("group_id").alias("group_id"))
    return values.withColumn("low", F.lower(value)).join(index, "low", "left").drop("low")


def parameter_names(trajectories: DataFrame, tools: DataFrame, key: str = "id") -> DataFrame:
    """key, tool, params: the parameter names of every tool of a trajectory, sorted; tools without any have none."""
    wanted = trajectories.select(key, F.explode("trajectory").alias("tool")).distinct()
    found = wanted.join(tools.select(F.col("name").alias("tool"), F.array_sort(F.map_keys("parameters")).alias("params")), "tool", "left")
    return found.select(key, "tool", F.coalesce("params", F.array().cast("array<string>")).alias("params"))


def first_superset(small: DataFrame, large: DataFrame, key: str, other: str, member: str) -> DataFrame:
    """key, other: the first other (by its value) that has all of key's members; the first of all for a key
    without members (its member is null); null where none has them."""
    keys, first = small.select(key).distinct(), large.agg(F.min(other).alias("first"))
    asked = small.filter(F.col(member).isNotNull()).distinct()
    met = subset_join(asked, large, key, other, member).groupBy(key).agg(F.min(other).alias(other))
    empty = keys.join(asked, key, "left_anti").withColumn("empty", F.lit(True))
    found = keys.join(met, key, "left").join(empty, key, "left").join(F.broadcast(first), F.lit(True), "left")
    return found.select(key, F.when(F.col("empty"), F.col("first")).otherwise(F.col(other)).alias(other))

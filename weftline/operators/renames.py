"""Keys of maps renamed by ordered rules, with a log of every change."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """name: what the log calls it. to: from (key, value) to the key's new name, null where the rule doesn't hold."""

    name: str
    to: Callable[[Column, Column], Column]


def expected_id(entity: Column) -> Column:
    return F.concat(F.lower(entity), F.lit("_id"))


def named(entities: Column, word: Column) -> Column:
    """The entity whose name is the word in any case; null if there is none."""
    return F.get(F.filter(entities, lambda e: F.lower(e) == F.lower(word)), F.lit(0))


def session_rule() -> Rule:
    """session_id is the server's own and becomes param_session_id."""
    return Rule("session", lambda key, value: F.when(key == "session_id", F.lit("param_session_id")))


def id_rule(entities: Column) -> Rule:
    """A key <entity>_id in another spelling becomes the entity's. entities: array of names."""
    return Rule("id format", lambda key, value: expected_id(named(entities, F.nullif(F.regexp_extract(key, r"(?i)^(.*)_id$", 1), F.lit("")))))


def source_rule(entities: Column) -> Rule:
    """A key whose value is taken from Entity.field becomes the entity's id."""
    return Rule("value source", lambda key, value: expected_id(named(entities, F.nullif(F.regexp_extract(value, r"^([^.]*)\.", 1), F.lit("")))))


def renamed(rows: DataFrame, key: list[str], attributes: str, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(rows with new keys; key, before, after, rule, applied of every change that a rule asks for). attributes: a map column;
    key tells rows apart. The rules are tried one after the other on the key as it is by then, so that a key may change
    several times. A change to a key that the row has is not applied, nor is a second one to the same key, of which
    the one from the smallest key counts: no entry takes the place of another."""
    at = rows.select(*key, F.explode(attributes).alias("old", "value")).withColumns({"new": F.col("old"), "rule": F.array().cast("array<string>")})
    for r in rules:
        to = F.coalesce(r.to(F.col("new"), F.col("value")), F.col("new"))
        at = at.withColumn("__to", to).withColumn("rule", F.when(F.col("__to") != F.col("new"), F.array_append("rule", F.lit(r.name))).otherwise(F.col("rule"))).withColumn("new", F.col("__to")).drop("__to")
    moves = at.filter(F.col("new") != F.col("old"))
    first = moves.groupBy(*key, "new").agg(F.min("old").alias("first"))
    held = at.select(*key, F.col("old").alias("new"), F.lit(True).alias("held"))
    decided = moves.join(first, [*key, "new"]).join(held, [*key, "new"], "left")
    log = decided.select(*key, F.col("old").alias("before"), F.col("new").alias("after"), F.array_join("rule", ",").alias("rule"), (F.col("held").isNull() & (F.col("first") == F.col("old"))).alias("applied"))
    return replayed(rows, key, attributes, log), log


def replayed(rows: DataFrame, key: list[str], attributes: str, log: DataFrame) -> DataFrame:
    """rows with the log's applied changes made."""
    change = log.filter("applied").groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("before", "after"))).alias("__change"))
    joined = rows.join(change, key, "left")
    moved = F.transform_keys(attributes, lambda k, v: F.coalesce(F.element_at("__change", k), k))
    return joined.withColumn(attributes, F.when(F.col("__change").isNull(), F.col(attributes)).otherwise(moved)).select(*rows.columns)

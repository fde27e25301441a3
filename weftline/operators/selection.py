"""Selecting and sampling instances: predicates, joins by relationship, quotas, transitions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Where:
    """A typed predicate; op is one of =, >=, in, null, not null."""

    field: str
    op: str
    value: object = None

    def column(self) -> Column:
        c = F.col(self.field)
        match self.op:
            case "=":
                return c == F.lit(self.value)
            case ">=":
                return c >= F.lit(self.value)
            case "in":
                return c.isin(*self.value)
            case "null":
                return c.isNull()
            case "not null":
                return c.isNotNull()
        raise ValueError(f"unknown predicate {self.op!r}")


def select_where(rows: DataFrame, *conditions: Where) -> DataFrame:
    for w in conditions:
        rows = rows.filter(w.column())
    return rows


def last_wins_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, order: list[str]) -> DataFrame:
    """Inner join in which the right side keeps its last row of each key, null keys meet, and
    right columns replace left ones of the same name."""
    newest = F.max_by(F.struct(*right.columns), F.struct(*order)).alias("r")
    kept = right.groupBy(F.col(right_key).alias("__key")).agg(newest)
    joined = left.join(kept, F.col(left_key).eqNullSafe(F.col("__key")))
    return joined.select(*[F.col(c) for c in left.columns if c not in right.columns], *[F.col(f"r.{c}").alias(c) for c in right.columns])


def hash_order(*ident: str, seed: int = 0) -> Column:
    """A repeatable random order."""
    return F.md5(F.concat_ws(":", *[F.col(i).cast("string") for i in ident], F.lit(str(seed))))


def sample_k(rows: DataFrame, group: list[str], ident: str, k: int, seed: int = 0) -> DataFrame:
    """At most k rows of each group, the same on every run."""
    w = Window.partitionBy(*group).orderBy(hash_order(ident, seed=seed), ident)
    return rows.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= k).drop("__rank")


def relationship_first(relation: DataFrame, entities: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Rows of a relationship whose referenced entities all exist; entities: (table, its key, the relation's column)."""
    for entity, key, column in entities:
        relation = relation.join(entity.select(F.col(key).alias(column)).distinct(), column, "left_semi")
    return relation


def without_relationship(candidates: DataFrame, relation: DataFrame, keys: list[str]) -> DataFrame:
    """Candidate tuples that no relationship row holds."""
    return candidates.join(relation.select(*keys).distinct(), keys, "left_anti")


def allowed_values(rows: DataFrame, column: str, allowed: DataFrame | None = None, blocked: DataFrame | None = None) -> DataFrame:
    if allowed is not None:
        rows = rows.join(allowed.select(column).distinct(), column, "left_semi")
    return rows if blocked is None else rows.join(blocked.select(column).distinct(), column, "left_anti")


def transitions(rows: DataFrame, valid: DataFrame, state: str) -> DataFrame:
    """rows with every state they may go to; rows without any fall away."""
    return rows.join(valid.select(F.col("from_value").alias(state), F.col("to_value").alias("next_state")), state)


def largest_remainder(groups: DataFrame, size: str, target: int, order: list[str]) -> DataFrame:
    """groups plus quota: shares of target in proportion to size, rounded so that they sum to it.
    The input is one row a group."""
    every = Window.partitionBy()
    total = F.sum(size).over(every)
    out = groups.withColumn("__exact", F.col(size) * F.lit(target))
    out = out.withColumn("__total", total).withColumn("__floor", F.floor(F.col("__exact") / F.col("__total"))).withColumn("__rest", F.col("__exact") % F.col("__total"))
    left = F.lit(target) - F.sum("__floor").over(every)
    rank = F.row_number().over(Window.orderBy(F.desc("__rest"), *order))
    return out.withColumn("quota", (F.col("__floor") + (rank <= left).cast("int")).cast("long")).drop("__exact", "__total", "__floor", "__rest")


def shared_by_all(members: DataFrame, group: str, member: str) -> DataFrame:
    """Members that every group has."""
    n = members.agg(F.count_distinct(group).alias("__n"))
    return members.groupBy(member).agg(F.count_distinct(group).alias("__in")).join(F.broadcast(n), F.col("__in") == F.col("__n")).select(member)


def drawn(values: Column, *ident: str, seed: int = 0) -> Column:
    """One element of an array, the same on every run for the same identity."""
    return F.get(values, F.pmod(F.xxhash64(F.lit(seed), *[F.col(i) for i in ident]), F.size(values).cast("long")).cast("int"))


def drawn_number(low: float, high: float, *ident: str, seed: int = 0, whole: bool = True) -> Column:
    """A number of the range, whole or with two decimals."""
    share = F.pmod(F.xxhash64(F.lit(seed), *[F.col(i) for i in ident]), F.lit(1 << 30)) / (1 << 30)
    return F.floor(F.lit(low) + share * (high - low + 1)).cast("long") if whole else F.round(F.lit(low) + share * (high - low), 2)


def drawn_many(values: Column, least: int, most: int, *ident: str, seed: int = 0) -> Column:
    """least to most different elements of an array, in its order of hashes."""
    count = F.lit(least) + F.pmod(F.xxhash64(F.lit(seed), *[F.col(i) for i in ident]), F.lit(most - least + 1)).cast("int")
    keyed = F.transform(values, lambda v: F.struct(F.xxhash64(F.lit(seed + 1), v, *[F.col(i) for i in ident]).alias("h"), v.alias("v")))
    return F.transform(F.slice(F.array_sort(keyed), 1, count), lambda e: e["v"])


def named_table(tables: DataFrame, name: str, server: str | None = None) -> DataFrame:
    """Records (name, server, record) of a table asked for by name in any case or spelling of spaces and
    underscores; the server's own table comes before the global one (server null); none gives no rows."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[\s_]+", "")
    found = tables.filter(plain(F.col("name")) == plain(F.lit(name)))
    if server is None:
        return found
    own = found.filter(F.col("server") == server)
    there = own.limit(1).select(F.lit(True).alias("own"))
    rest = found.filter(F.col("server").isNull()).join(F.broadcast(there), F.lit(True), "left_anti")
    return own.unionByName(rest)


def same_or_different(rows: DataFrame, key: str, group: list[str], same: bool, seed: int = 0) -> DataFrame:
    """rows plus partner: the row itself, or another row of its group, by a repeatable rotation."""
    if same:
        return rows.withColumn("partner", F.col(key))
    w = Window.partitionBy(*group).orderBy(hash_order(key, seed=seed), key)
    turned = F.coalesce(F.lead(key).over(w), F.first(key).over(w))
    return rows.withColumn("partner", F.when(turned != F.col(key), turned))


def fused_core(candidates: dict[str, DataFrame], core: str) -> DataFrame:
    """Core instances that satisfy every domain's conditions."""
    found = None
    for rows in candidates.values():
        ids = rows.select(core).distinct()
        found = ids if found is None else found.join(ids, core, "left_semi")
    return found


def met_by_constraint(rows: DataFrame, pool: DataFrame, on: list[str], key: str, other: str, seed: int = 0) -> DataFrame:
    """rows plus other: a repeatable pick from the pool's rows that agree on the constraint; null if none
    does. The pool is numbered once a constraint, so that no pair is formed but the picked one."""
    w = Window.partitionBy(*on).orderBy(hash_order(other, seed=seed), other)
    numbered = pool.select(*on, other).withColumn("place", F.row_number().over(w) - 1)
    sizes = pool.groupBy(*on).agg(F.count("*").alias("size"))
    asked = rows.join(sizes, on, "left").withColumn("place", F.when(F.col("size") > 0, F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.col("size")).cast("int")))
    return asked.join(numbered, [*on, "place"], "left").drop("place", "size")


def without_overlap(rows: DataFrame, taken: DataFrame, on: list[str], start: str, end: str, bucket: float) -> DataFrame:
    """rows whose interval meets none of `taken` of the same key. An interval meets a taken one if, of those that
    begin before it ends, the one that reaches furthest ends after it begins: a running maximum over the starts,
    within stretches of time of length `bucket` first and then over these, so that a hot key is several groups.
    Null intervals and null keys meet nothing."""
    mine = rows.select(*on, F.col(end).cast("double").alias("x"), F.lit(None).cast("double").alias("reach"), F.lit(0).alias("late"), F.col(start).cast("double").alias("from_"), F.struct("*").alias("row"))
    held = taken.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
    for c in on:
        held = held.filter(F.col(c).isNotNull())
    held = held.select(*on, F.col(start).cast("double").alias("x"), F.col(end).cast("double").alias("reach"), F.lit(1).alias("late"))
    points = mine.unionByName(held, allowMissingColumns=True).withColumn("stretch", F.floor(F.col("x") / bucket))
    within = Window.partitionBy(*on, "stretch").orderBy("x", "late").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*on).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = points.groupBy(*on, "stretch").agg(F.max("reach").alias("reach")).select(*[F.col(c).alias(f"__{c}") for c in on], F.col("stretch").alias("__stretch"), F.max("reach").over(before).alias("earlier"))
    here = points.withColumn("reach", F.max("reach").over(within)).filter("late = 0")
    same = F.col("stretch").eqNullSafe(F.col("__stretch"))
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    meets = F.coalesce(F.greatest("reach", "earlier") > F.col("from_"), F.lit(False))
    return here.join(stretches, same, "left").filter(~meets).select("row.*")


def merged_dependencies(explicit: Column, implicit: Column) -> Column:
    """Two maps as one; explicit entries win."""
    return F.map_concat(F.map_filter(implicit, lambda k, v: ~F.map_contains_key(explicit, k)), explicit)


def missing_domains(expected: Column, domains: Column) -> Column:
    """Expected keys (Server.tool.param) that the map lacks; null values count as there."""
    return F.array_except(expected, F.map_keys(domains))


def accumulated(existing: DataFrame, new: DataFrame, name: str, order: list[str], target: int) -> DataFrame:
    """name of existing topics and of as many new ones, by order, as bring them to the target; spelling
    differs in case alone. The new ones are numbered in one window over distinct names, which are few."""
    low = F.lower(F.trim(name))
    held = existing.select(low.alias("low")).distinct()
    fresh = new.withColumn("low", low).filter(F.col("low") != "").groupBy("low").agg(F.min(F.struct(*order, name)).alias("first")).join(held, "low", "left_anti")
    n = held.agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(*[F.col(f"first.{o}") for o in order], "low"))
    added = fresh.withColumn("place", place).join(F.broadcast(n), F.lit(True)).filter(F.col("place") + F.col("n") <= target)
    return existing.select(name).distinct().unionByName(added.select(F.col(f"first.{name}").alias(name)))


def entity_set(core: Column, peripheral: Column) -> Column:
    """The core entity and the peripheral ones, in that order, once each."""
    return F.array_distinct(F.concat(F.array_compact(F.array(core)), F.coalesce(peripheral, F.array().cast("array<string>"))))

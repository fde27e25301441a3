"""Names that no two rows share.

In the order of the rows a name that is free stays, and one that is taken gets the least number that makes it free:
name, name1, name2. Names that are given already take part, as does what other rows got before: name1 may be a row's
own name. Two names can meet only if they are equal up to digits at their ends, so each such family is on its own.
Rows of a family with one name are numbered by their rank, over ranges of rows, so that a name of a third of all rows
is many tasks. A family of several names is gone through in order as a stream that holds one counter a name: all
numbers below it are taken, which tells whether any name is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import short_name
from weftline.session import materialize


def ranked(rows: DataFrame, group: str, order: list[str], into: str) -> DataFrame:
    """rows plus their rank in the group, from 0, whatever its size: rows lie in ranges of (group, order); a range's
    rows are ranked on their own, and the group's rows in the ranges before are added."""
    placed = rows.repartitionByRange(group, *order).withColumn("__part", F.spark_partition_id())
    placed = materialize(placed, "ranges")  # the ranges are drawn from a sample, so they must not be drawn again
    here = placed.withColumn(into, F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order)) - 1)
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(group, "__part").agg(F.count("*").alias("__size"))
    sizes = sizes.select(F.col(group).alias("__group"), F.col("__part").alias("__of"), F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    same = F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__of"))
    return here.join(sizes, same).withColumn(into, F.col(into) + F.col("__before")).drop("__part", "__group", "__of", "__before")


class Family:
    """The names of one family that are taken: for each name one counter; the name itself (number 0) and all numbers below
    the counter are."""

    def __init__(self) -> None:
        self.next: dict[str, int] = {}

    def taken(self, name: str) -> bool:
        if name in self.next:
            return True
        at = len(name)
        while at > 0 and name[at - 1].isdigit() and name[at - 1].isascii():
            at -= 1
            number = name[at:]
            if number[0] != "0" and self.next.get(name[:at], 0) > int(number):
                return True
        return False

    def give(self, name: str) -> str:
        if not self.taken(name):
            self.next[name] = 1
            return name
        number = max(self.next.get(name, 1), 1)
        # The name was taken as another's number: from now on it has a counter of its own.
        while self.taken_number(name, number):
            number += 1
        self.next[name] = number + 1
        return f"{name}{number}"

    def taken_number(self, name: str, number: int) -> bool:
        return number < self.next.get(name, 1) or self.taken(f"{name}{number}")


def family(name: Column) -> Column:
    return F.regexp_replace(name, "[0-9]+$", "")


def unique_names(rows: DataFrame, name: str, order: list[str], given: DataFrame | None = None) -> DataFrame:
    """rows plus unique. order tells rows apart; given (name): names that are taken before all. A null name stays null."""
    root = family(F.col(name))
    own = rows.select(F.struct("*").alias("row"), F.col(name).alias("name"), F.struct(*order).alias("at"), root.alias("root"))
    before = None if given is None else given.select(F.col(name).alias("name")).filter("name IS NOT NULL").distinct().withColumn("root", family(F.col("name")))
    known = own.select("root", "name") if before is None else own.select("root", "name").unionByName(before.select("root", F.concat("name", F.lit("\0")).alias("name")))
    several = known.filter("root IS NOT NULL").groupBy("root").agg((F.min("name") != F.max("name")).alias("several"))
    marked = own.join(several, "root", "left")
    alone = ranked(marked.filter(~F.coalesce("several", F.lit(False))), "name", ["at"], "number").select("row", F.when(F.col("number") == 0, F.col("name")).otherwise(F.concat("name", F.col("number").cast("string"))).alias("unique"))
    mixed = marked.filter("several").select("root", "at", "name", "row")
    if before is not None:
        mixed = mixed.unionByName(before.select("root", "name"), allowMissingColumns=True)
    kind = mixed.select("row").schema["row"].dataType.simpleString()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, taken = None, Family()
        for batch in batches:
            out, mine = [], []
            for i, (r, n, new) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist())):
                if r != root:
                    root, taken = r, Family()
                if new:
                    out.append(taken.give(n))
                    mine.append(i)
                elif not taken.taken(n):
                    taken.next[n] = 1
            yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(mine, pa.int64())), pa.array(out, pa.string())], ["row", "unique"])

    # Names given before have no place and come first.
    stream = mixed.repartition("root").sortWithinPartitions(F.col("root"), F.col("at").asc_nulls_first()).select("root", "name", "row", F.col("at").isNotNull().alias("new"))
    found = alone.unionByName(stream.mapInArrow(named, f"row {kind}, unique string"))
    return found.select("row.*", "unique")


def abbreviations(servers: DataFrame, name: str, most: int = 8, given: DataFrame | None = None) -> DataFrame:
    """name, abbreviation: one for each server, by the order of names; no two servers share one."""
    each = servers.select(F.col(name)).filter(F.col(name).isNotNull()).distinct().withColumn("__short", short_name(F.col(name), most))
    taken = None if given is None else given.select(F.col("abbreviation").alias("__short"))
    return unique_names(each, "__short", [name], taken).select(name, F.col("unique").alias("abbreviation"))


def in_order(names: list[str], given: tuple[str, ...] = ()) -> list[str]:
    """The definition, one name after the other; for tests."""
    seen, out = set(given), []
    for n in names:
        made, number = n, 1
        while made in seen:
            made = f"{n}{number}"
            number += 1
        seen.add(made)
        out.append(made)
    return out

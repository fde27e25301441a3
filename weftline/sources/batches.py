"""Batches that survive a retry: rows, dead letters and a ledger under one batch id.

A batch is written to folders of its own, its id in their names, and overwrites what an attempt before has left
there; last it is entered in the ledger. Readers take batches that the ledger holds, so a batch that was broken off
is as if it had never been, and one that is replayed is there once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PARTS = ("rows", "dead")


def _folder(path: str, part: str, batch: int) -> str:
    return f"{path}/{part}/batch={batch}"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def entered(spark: SparkSession, path: str, batch: int) -> bool:
    """Whether the ledger holds the batch. Spark puts _SUCCESS into a folder when all its files are there."""
    return _exists(spark, f"{_folder(path, 'ledger', batch)}/_SUCCESS")


def write_batch(rows: DataFrame, path: str, batch: int, good: Column, reason: Column | None = None) -> None:
    """Writes rows for which good holds, the others with a reason as dead letters, and enters the batch with its counts.
    Does nothing if the ledger holds it."""
    spark = rows.sparkSession
    if entered(spark, path, batch):
        return
    fits = F.coalesce(good, F.lit(False))
    rows.filter(fits).write.mode("overwrite").parquet(_folder(path, "rows", batch))
    rows.filter(~fits).withColumn("reason", F.lit("rejected") if reason is None else reason).write.mode("overwrite").parquet(_folder(path, "dead", batch))
    counts = [spark.read.parquet(_folder(path, part, batch)).count() for part in PARTS]
    spark.createDataFrame([(batch, *counts)], "batch long, n_rows long, n_dead long").coalesce(1).write.mode("overwrite").parquet(_folder(path, "ledger", batch))


def write_stream(stream: DataFrame, path: str, checkpoint: str, good: Column, reason: Column | None = None, key: list[str] | None = None) -> StreamingQuery:
    """A query that writes each micro-batch by `write_batch`. key: rows whose key a batch before holds are left out, as are
    repeats within the batch but one."""

    def one(rows: DataFrame, batch: int) -> None:
        if key:
            rows = rows.dropDuplicates(key)
            there = committed(rows.sparkSession, path, "rows", before=batch)
            if there is not None:
                rows = rows.join(there.select(*key).distinct(), key, "left_anti")
        write_batch(rows, path, batch, good, reason)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(one).start()


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """batch, n_rows, n_dead of the batches that are whole."""
    none = spark.createDataFrame([], "batch long, n_rows long, n_dead long")
    if not _exists(spark, f"{path}/ledger"):
        return none
    # The folder's own batch, which its name gives, is the column's too.
    return spark.read.schema(none.schema).option("recursiveFileLookup", "true").parquet(f"{path}/ledger")


def committed(spark: SparkSession, path: str, part: str = "rows", before: int | None = None) -> DataFrame | None:
    """The rows or dead letters of the batches in the ledger, with the batch; None if there are none. before: only
    batches of smaller ids."""
    held = ledger(spark, path)
    if before is not None:
        held = held.filter(F.col("batch") < before)
    if held.isEmpty():
        return None
    found = spark.read.option("basePath", f"{path}/{part}").parquet(f"{path}/{part}").withColumn("batch", F.col("batch").cast("long"))
    return found.join(held.select("batch"), "batch", "left_semi")


def routed(rows: DataFrame, path: str, batch: int, by: list[str], check: Callable[[DataFrame], Column] | None = None) -> None:
    """A batch of rows that belong to several tables: each row lies in the folder of its table below the batch's, so that a
    reader of one table opens that alone. check: which rows are good."""
    spark = rows.sparkSession
    if entered(spark, path, batch):
        return
    good = F.lit(True) if check is None else F.coalesce(check(rows), F.lit(False))
    for part, chosen in (("rows", rows.filter(good)), ("dead", rows.filter(~good))):
        chosen.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(_folder(path, part, batch))
    n = rows.agg(F.count_if(good).alias("n_rows"), F.count_if(~good).alias("n_dead"))
    n.select(F.lit(batch).cast("long").alias("batch"), "n_rows", "n_dead").coalesce(1).write.mode("overwrite").parquet(_folder(path, "ledger", batch))

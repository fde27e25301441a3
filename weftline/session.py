"""Session helpers shared by all operators: building one, reading tables, cutting lineage."""

from __future__ import annotations

import atexit
import gc
import math
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "weftline", **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


#: Rows by key are dealt over parts of about so many rows.
PART_ROWS = 1_500_000


def parts_for(rows: DataFrame) -> int:
    """Parts to deal rows by key over, so that what a task holds doesn't grow with the table: a session's number of shuffle
    partitions is the same for any size. The rows are counted, which for a Parquet table takes its footers only."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / PART_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session without one gets one here; on a
    cluster the setting must be there, as executors can't see the driver's own folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        folder = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch(spark: SparkSession) -> str:
    """A folder of this application's own in the shared one; it is deleted when the application ends."""
    path = f"{shared_folder(spark)}/weftline-{spark.sparkContext.applicationId}"
    if path not in _SCRATCH:
        _SCRATCH.add(path)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(place)
        files.deleteOnExit(place)
    return path


_SCRATCH: set[str] = set()
#: The tables of each scope that is open, from the outermost on.
_MADE: ContextVar[tuple[list[str], ...]] = ContextVar("made", default=())
#: After a table of so many bytes the shuffle files behind it are let go.
LARGE = 32_000_000


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized within, but for those to keep, are deleted at the end. What a scope within
    another keeps belongs to the outer one."""
    made: list[str] = []
    token = _MADE.set((*_MADE.get(), made))
    try:
        yield
    finally:
        _MADE.reset(token)
        for path in made:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, name: str, keep: bool = False, large: bool = False) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: lineage ends here, and
    the rows survive the loss of any executor. large: texts or all their windows were shuffled for it, so that the shuffle
    files go, however small the table itself is."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    scopes = _MADE.get()[:-1] if keep else _MADE.get()
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if large or place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength() >= LARGE:
        del df
        release(spark)
    return table


def release(spark: SparkSession) -> None:
    """Spark keeps shuffle files until the driver collects the objects that stand for them, which a driver with memory
    to spare may not do for long, while the executors' disks fill. Spark's listeners hold the last event that they got,
    and so the plan of the query that ended; the events of a small one take its place."""
    gc.collect()
    spark.range(1).count()
    spark._jvm.System.gc()

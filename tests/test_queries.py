"""Every query of the library against DuckDB on the same tables, and the entry module's contract."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from weftline import queries as core
from weftline.operators import conversations, matching


DATA = "/root/testdata"


def plain(value):
    if hasattr(value, "tolist") and not isinstance(value, (str, bytes)):
        value = value.tolist()
    if value is None or value is pd.NaT or value is pd.NA or isinstance(value, float) and math.isnan(value):
        return "null"
    return repr(round(value, 6)) if isinstance(value, float) else str(value)


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, row)) for row in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def tables():
    """Large enough for repeated rows, which the smallest tables lack."""
    return f"{DATA}/sf0.01"


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(tables).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_equals_sql(spark, duck, tables, name):
    got = core.QUERIES[name](spark, tables).toPandas()
    want = duck.execute(core.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql_or_runs(spark, small):
    for name in sorted(set(core.QUERIES) - set(core.ORACLES)):
        assert core.QUERIES[name](spark, small).columns


def test_transcript_cuts_only_tool_texts(spark):
    rows = [(1, 0, "user", "early")] + [(1, i, role, f"{role} " * 100) for i, role in enumerate(("system", "user", "assistant", "tool"), 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = conversations.as_array(conversations.last_turns(turns, 4)).select("messages", conversations.transcript(F.col("messages"), 4, 20).alias("t")).first()
    assert len(found.messages) == 4
    assert found.t == "\n".join(f"{role.upper()}: {text[:20] if role == 'tool' else text}" for _, _, role, text in rows[1:])


def test_closest_record_without_a_shared_value(spark):
    rows = [(1, "g", "a", "b"), (2, "g", "c", "d"), (3, "g", "c", "e"), (4, "h", "a", "b")]
    records = spark.createDataFrame(rows, "k long, grp string, x string, y string")
    found = matching.closest_records(records, records, ["grp"], "k", "closest", ["x", "y"]).collect()
    assert {(r.k, r.closest, r.differing) for r in found} == {(1, 2, 2), (2, 3, 1), (3, 2, 1)}


def test_entry_module(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).limit(5).collect()

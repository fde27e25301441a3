"""Plans and states that must not grow with the tables."""

import re
import time

import pytest
from pyspark.sql import functions as F

from weftline import session
from weftline.functions import lenient_json as J
from weftline.llm import prefix_free, substring
from weftline.operators import assertions, evaluation
from weftline.queries import QUERIES


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_parameter_rules_broadcast_nothing(spark, small):
    assert "Broadcast" not in planned(QUERIES["parameter_rules"](spark, small))


def shuffle_files(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def gone(spark, most: int) -> bool:
    until = time.monotonic() + 10
    while shuffle_files(spark) > most and time.monotonic() < until:
        time.sleep(0.1)
    return shuffle_files(spark) <= most


def test_shuffle_files_go_after_a_table(spark, monkeypatch):
    session.release(spark)
    time.sleep(2)
    before = shuffle_files(spark)
    monkeypatch.setattr(session, "LARGE", 0)
    session.materialize(spark.range(10_000).repartition(4, "id"), "spread")
    assert gone(spark, before)


@pytest.mark.parametrize("method", [substring, prefix_free])
def test_only_the_last_join_is_left_to_run(spark, method):
    """The shuffles of texts and windows are over before the results are read."""
    texts = [(i, " ".join(f"w{(i % 3) * 7 + j}" for j in range(60))) for i in range(30)]
    plan = planned(method.deduplicate(spark.createDataFrame(texts, "doc_id long, text string")))
    assert "MapInArrow" not in plan and "Exchange" in plan


def test_assertions_broadcast_no_keys_and_sort_no_offenders(spark, small):
    plan = planned(QUERIES["state_assertions"](spark, small))
    assert not [x for x in plan.split("\n") if "BroadcastHashJoin" in x and "LeftAnti" in x]
    few = planned(assertions.asserted(spark, [assertions.holds("t", "id < 0")], None, {"t": spark.range(9)}))
    assert "TakeOrderedAndProject" in few and "windowspecdefinition(name" not in few


def test_texts_are_parsed_once(spark):
    """Two branches, each with one parse, and one of what was mended."""
    rows = spark.createDataFrame([('{"a": 1}',), ("{a: 1,}",), ("3",), (None,)], "t string")
    found = J.parsed_json(rows, "t")
    assert planned(found).lower().count("parsejson") <= 3
    assert sorted((r.j or "", r.repaired) for r in found.select(F.to_json("json").alias("j"), "repaired").collect()) == [("", False), ("3", False), ('{"a":1}', False), ('{"a":1}', True)]


@pytest.mark.parametrize("query,gathered", [("sample_verdicts", 3), ("evaluation_report", 4)])
def test_rows_are_dealt_by_key_before_they_are_gathered(spark, small, monkeypatch, query, gathered):
    """Parts grow with the table, beyond the session's shuffle partitions, and what is joined or summed by key lies in them."""
    before = sorted(map(str, QUERIES[query](spark, small).collect()))
    monkeypatch.setattr(session, "PART_ROWS", 500)
    found = QUERIES[query](spark, small)
    parts = session.parts_for(session.table(spark, small, "lineitem"))
    plan = planned(found)
    assert parts > int(spark.conf.get("spark.sql.shuffle.partitions")) and "BroadcastHashJoin" not in plan
    dealt = re.findall(r"Exchange hashpartitioning\((?:id|l_orderkey)#\w+(, \d+)\)", plan)
    assert len(dealt) >= gathered and set(dealt) == {f", {parts}"}
    assert sorted(map(str, found.collect())) == before


def test_verdicts_with_null_and_repeated_keys_are_the_same_when_dealt(spark):
    samples = spark.createDataFrame([(1, ["a"]), (1, None), (2, []), (3, ["a"]), (None, ["a"])], "id long, trajectory array<string>")
    calls = spark.createDataFrame([(1,), (1,), (2,), (None,), (9,)], "id long")
    results = spark.createDataFrame([(1, "x", 1.0, True, None), (1, "x", 1.0, True, None), (2, "x", 0.0, False, False), (None, "x", 1.0, True, False), (9, "y", 1.0, None, True)], "id long, evaluator string, score double, passed boolean, skipped boolean")
    plain, spread = evaluation.verdicts(samples, calls, results), evaluation.verdicts(samples, calls, results, parts=7)
    texts = lambda df: sorted(map(str, df.collect()))
    assert texts(plain) == texts(spread) and plain.count() == 6
    assert texts(evaluation.evaluator_report(plain)) == texts(evaluation.evaluator_report(spread, 7))


@pytest.mark.parametrize("method", [substring, prefix_free])
def test_shuffle_files_go_behind_a_small_table_of_places(spark, monkeypatch, method):
    """However few places the first step leaves, its shuffles of all windows are over before the next ones are written."""
    session.release(spark)
    time.sleep(2)
    before, left = shuffle_files(spark), {}

    def watched(df, name, **more):
        made = session.materialize(df, name, **more)
        if name == "marks":
            left[name] = gone(spark, before)
        return made

    monkeypatch.setattr(session, "LARGE", 1 << 40)
    monkeypatch.setattr(method, "materialize", watched)
    texts = [(i, " ".join(f"w{(i % 3) * 7 + j}" for j in range(60))) for i in range(30)]
    method.deduplicate(spark.createDataFrame(texts, "doc_id long, text string"))
    assert left == {"marks": True}


def test_documents_that_repeat_a_line_have_a_row_for_each_content(spark, monkeypatch):
    """Not one for each place: the places of a line grow with its repeats, its windows don't."""
    monkeypatch.setattr(prefix_free, "GROUP_BYTES", 300)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"  # within one task nearly all is settled
    spark.conf.set(coalesce, "false")
    rows = [(i, f"{i:04d} " + "the same line, again\n" * (40 + i)) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    own = substring.told_apart(docs, "text", "doc_id").select("doc_id", "sub", "text")
    found = prefix_free.dictionary_texts(own, prefix_free.dictionary(prefix_free.parse(own)), prefix_free.WINDOW)
    places = found.select(F.sum(F.size("places"))).first()[0]
    rows_in, rows_out = found.count(), prefix_free.repeated(found, prefix_free.WINDOW).count()
    spark.conf.set(coalesce, "true")
    assert rows_out <= rows_in < places / 10
    kept = {r[0]: tuple(r[1:]) for r in prefix_free.deduplicate(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()}
    assert kept == prefix_free.brute_force(rows)

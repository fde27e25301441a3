"""Shapes of samples, tasks, results and graphs."""

import hashlib

from pyspark.sql import functions as F

from weftline.operators import samples as S

CALLS = "array<struct<id:string,function:struct<name:string,arguments:string>>>"


def test_tool_calls(spark):
    rows = [
        (1, 0, "user", [("c0", ("x.no", "{}"))]),
        (1, 1, "assistant", [("c1", ("srv.buy", '{"n": 1}')), ("c2", None), ("c3", ("pay", "not json"))]),
        (1, 2, "assistant", None),
        (2, 0, "assistant", [("c4", ("a.b.c", None))]),
    ]
    messages = spark.createDataFrame(rows, f"id long, pos int, role string, tool_calls {CALLS}")
    shown = lambda df: {(r.id, r.pos, r.at, r.name, r.j) + ((r.tool_call_id,) if "tool_call_id" in df.columns else ()) for r in df.withColumn("j", F.to_json("arguments")).collect()}
    assert shown(S.tool_calls(messages, ["id"])) == {(1, 1, 0, "buy", '{"n":1}'), (1, 1, 2, "pay", "{}"), (2, 0, 0, "c", "{}")}
    assert shown(S.tool_calls(messages, ["id"], with_ids=True)) == {(1, 1, 0, "srv.buy", '{"n":1}', "c1"), (1, 1, 2, "pay", "{}", "c3"), (2, 0, 0, "a.b.c", "{}", "c4")}
    stored = spark.createDataFrame([(1, [("kept", '{"k": 2}')]), (2, [])], "id long, rollout_tool_calls array<struct<name:string,arguments:string>>")
    assert shown(S.calls_of_samples(stored, messages, ["id"])) == {(1, 0, 0, "kept", '{"k":2}'), (2, 0, 0, "c", "{}")}


def test_task_definitions_and_checks(spark):
    inner = "struct<instruction:string,reason_for_call:string,nl_assertions:array<string>>"
    rows = [("t1", ["a"], None, ("do", None, ["x"]), ("other", "why", None), ["D"], True, ["root"]), ("", None, {"k": "v"}, None, ("from template", None, None), None, None, ["root"])]
    tasks = spark.createDataFrame(rows, f"task_id string, trajectory array<string>, entity_context map<string,string>, instantiated_task {inner}, template {inner}, domains array<string>, is_cross_domain boolean, nl_assertions array<string>")
    one, two = sorted(S.task_definitions(tasks).collect(), key=lambda r: r.task_id != "t1")
    assert (one.instruction, one.reason_for_call, one.nl_assertions, one.domains, one.is_cross_domain) == ("do", "why", ["x"], ["D"], True)
    assert (two.instruction, two.reason_for_call, two.nl_assertions, two.domains, two.is_cross_domain, two.trajectory) == ("from template", "", ["root"], [], False, [])
    assert len(two.task_id) == 12 and set(two.task_id) <= set(hashlib.md5().hexdigest() + "0123456789abcdef")
    checked = S.with_quality_checks(S.task_definitions(tasks), ["error_handling", "nonsense", "no_hallucination"])
    assert {tuple(r.nl_assertions) for r in checked.collect()} == {(a, S.QUALITY_CHECKS["error_handling"], S.QUALITY_CHECKS["no_hallucination"]) for a in ("x", "root")}


def test_flat_results(spark):
    rows = spark.createDataFrame([("r", ["m"], True, None, (3, "better"))], "id string, messages array<string>, success boolean, error string, metadata struct<turns:int,error:string>")
    assert S.flat_results(rows).first().asDict() == {"id": "r", "messages": ["m"], "success": True, "turns": 3, "error": "better"}


def test_graph_round_trip(spark):
    nodes = spark.createDataFrame([("g", "a", True, None, "A"), ("g", "b", None, None, None), ("h", "c", False, None, "C")], "graph string, id string, is_person boolean, attributes string, description string")
    links = spark.createDataFrame([("g", "a", "b", "owns", None), ("g", "a", "zz", "lost", "x")], "graph string, source string, target string, relationship string, description string")
    shown, kept = S.graph_dictionary(nodes, links)
    assert kept.count() == 1 and shown.filter("description IS NULL OR is_person IS NULL").count() == 0
    clean = nodes.na.fill({"description": "", "is_person": False})
    documents = S.graph_document(clean, links.filter("target = 'b'").na.fill(""), "graph")
    back, ends = S.graph_tables(documents, "graph")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, clean.select("graph", "id", "is_person", "description").collect()))
    assert [tuple(r) for r in ends.collect()] == [("g", "a", "b", "owns", "")]


def test_entities_and_checkpoints(spark):
    found = spark.createDataFrame([("User",), ("Session",), ("",), (None,), ("Ghost",)], "name string")
    assert {r.name for r in S.extracted_entities(found).collect()} == {"User", "Ghost"}
    assert {r.name for r in S.extracted_entities(found, spark.createDataFrame([("User",)], "name string")).collect()} == {"User"}
    points = spark.createDataFrame([("a", "done", 1), ("b", "open", 3), ("c", "done", 2)], "trajectory_id string, status string, updated_at int")
    assert [r.trajectory_id for r in S.newest_checkpoints(points).collect()] == ["b", "c", "a"]
    assert [r.trajectory_id for r in S.newest_checkpoints(points, "done").collect()] == ["c", "a"]

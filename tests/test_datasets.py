"""Folders by naming rules, batches that are replayed, renamed keys and named assertions."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftline.functions.hashing import trajectory_hash
from weftline.operators import assertions as A
from weftline.operators import renames as R
from weftline.sources import batches, folders


def put(root: Path, path: str, content) -> None:
    place = root / path
    place.parent.mkdir(parents=True, exist_ok=True)
    place.write_text(content if isinstance(content, str) else json.dumps(content))


def files_opened(df) -> int:
    """Files that the scans of a plan read once it has run."""
    df = df.select("*")  # a plan of its own, whose counts no run before has reset
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        node = todo.pop()
        metrics = node.metrics()
        if metrics.contains("numFiles"):
            total += metrics.apply("numFiles").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if "AdaptiveSparkPlan" in node.getClass().getSimpleName():
            todo.append(node.executedPlan())
        if hasattr(node, "plan") and "QueryStage" in node.getClass().getSimpleName():
            todo.append(node.plan())
    return total


def test_validated_combos(spark, tmp_path):
    combos = {d: [{"combo_id": f"{d}{i}", "trajectory_hash": "h", "entity_instances": {"a": str(i)}} for i in range(3)] for d in ("Alpha", "Beta", "A b+c")}
    for d, rows in combos.items():
        put(tmp_path, f"{d}/validated_combos.json", rows)
        put(tmp_path, f"{d}/other.json", rows)
    put(tmp_path, "Broken/validated_combos.json", '[{"combo_id": "x"')
    put(tmp_path, "Object/validated_combos.json", {"combo_id": "x"})
    rows, bad = folders.validated_combos(spark, str(tmp_path))
    assert {(r.domain, r.sample_idx, r.combo_id, r.entity_instances["a"]) for r in rows.collect() if r.entity_instances} == {(d, i, f"{d}{i}", str(i)) for d in combos for i in range(3)}
    assert "Broken" in {r.domain for r in bad.collect()}
    one, _ = folders.validated_combos(spark, str(tmp_path), where=F.col("domain") == "Beta")
    assert {r.domain for r in one.collect()} == {"Beta"} and files_opened(one) == 1


def test_trajectory_tasks(spark, tmp_path):
    task = lambda t, c: {"trajectory": t, "trajectory_hash": "h" + "".join(t), "task_template": {"x": [1]}, "combos": c}
    put(tmp_path, "S1/h1.json", task(["a", "b"], [{"k": 1}, {"k": [2]}]))
    put(tmp_path, "S1/h2.json", task(["a"], []))
    put(tmp_path, "S1/_meta.json", task(["a"], [{}]))
    put(tmp_path, "S2/h3.json", task([], [{"k": 1}]))
    put(tmp_path, "S2/h4.json", "{broken")
    put(tmp_path, "S3/h5.json", task(["c"], [{"k": 5}]))
    rows, bad = folders.trajectory_tasks(spark, str(tmp_path))
    got = rows.select("server", "trajectory", "trajectory_hash", F.size("combos").alias("n"), F.to_json("task_template").alias("t")).collect()
    assert {(r.server, tuple(r.trajectory), r.trajectory_hash, r.n, r.t) for r in got} == {("S1", ("a", "b"), "hab", 2, '{"x":[1]}'), ("S3", ("c",), "hc", 1, '{"x":[1]}')}
    assert {r.server for r in bad.collect()} == {"S2"}
    some, _ = folders.trajectory_tasks(spark, str(tmp_path), F.col("server").isin("S1", "S3") & (F.col("hash") != "h2"))
    assert some.count() == 2 and files_opened(some) == 2


def test_template_tasks(spark, tmp_path):
    put(tmp_path, "t/Shop.json", {"templates": [{"trajectory": ["a", "b"], "n": 1}, {"trajectory": []}, {"n": 2}, {"trajectory": ["c"]}]})
    put(tmp_path, "t/Empty.json", {"templates": []})
    put(tmp_path, "t/None.json", {})
    policies = spark.createDataFrame([("Shop", "be kind")], "name string, text string")
    rows = folders.template_tasks(spark, str(tmp_path / "t"), policies).select("*", trajectory_hash(F.col("trajectory")).alias("h")).collect()
    assert {(r.server, r.template_idx, tuple(r.trajectory), r.policy) for r in rows} == {("Shop", 0, ("a", "b"), "be kind"), ("Shop", 3, ("c",), "be kind")}
    assert all(r.trajectory_hash == r.h for r in rows)


def test_sampling_codes_and_index(spark, tmp_path):
    for h, meta in (("h1", {"constraint_analysis": {"core": "x"}}), ("h2", {}), ("h3", "{broken"), ("h5", "[1]")):
        put(tmp_path, f"codes/S/{h}.py", f"print('{h}')\n")
        put(tmp_path, f"codes/S/{h}.json", meta)
    put(tmp_path, "codes/S/h4.py", "alone")
    put(tmp_path, "codes/S/h6.json", {"constraint_analysis": {}})
    rows = folders.sampling_codes(spark, str(tmp_path / "codes")).select("server", "trajectory_hash", "code", F.to_json("constraint_analysis").alias("a")).collect()
    assert {tuple(r) for r in rows} == {("S", "h1", "print('h1')\n", '{"core":"x"}'), ("S", "h2", "print('h2')\n", "{}")}
    put(tmp_path, "i/index.json", {"h1": {"n": 1}, "h2": {"n": 2}})
    put(tmp_path, "i/old_index.json", "not json")
    found = folders.index_entries(spark, str(tmp_path / "i")).select("hash", F.try_variant_get("entry", "$.n", "int").alias("n")).collect()
    assert {tuple(r) for r in found} == {("h1", 1), ("h2", 2)}


def test_combinations(spark, tmp_path):
    for name in ("A_B", "B_A_C", "Solo", "A_X", "C_D"):
        put(tmp_path, f"q/{name}.jsonl", "{}\n")
    for name in ("B_A", "C_B_A", "D_C_E"):
        put(tmp_path, f"p/{name}.md", "policy")
    every = folders.combinations(spark, str(tmp_path / "q"), str(tmp_path / "p"))
    held = {r.name: (r.domains, r.policy_path and Path(r.policy_path).name) for r in every.collect()}
    assert held == {"A_B": (["A", "B"], "B_A.md"), "B_A_C": (["B", "A", "C"], "C_B_A.md"), "A_X": (["A", "X"], None), "C_D": (["C", "D"], None)}
    names = lambda **how: {r.name for r in folders.combinations(spark, str(tmp_path / "q"), str(tmp_path / "p"), **how).collect()}
    assert names(require_policy=True) == {"A_B", "B_A_C"} and names(min_domains=3) == {"B_A_C"}
    assert names(include=["C", "X"], exclude=["D"]) == {"B_A_C", "A_X"}
    assert names(known=["A", "B"]) == {"A_B", "B_A_C"}
    put(tmp_path, "f/Shop_Bank/queries.jsonl", "{}")
    put(tmp_path, "f/Shop_Bank/t1.jsonl", "{}")
    put(tmp_path, "f/Shop_Bank/t1.txt", "{}")
    assert {(r.domain, r.file, r.is_combined) for r in folders.query_files(spark, str(tmp_path / "f")).collect()} == {("Shop_Bank", "queries.jsonl", True), ("Shop_Bank", "t1.jsonl", False)}


# Batches


def test_replayed_batch_is_there_once(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "ok"), (2, None), (3, "ok")], "id long, state string")
    assert batches.committed(spark, path) is None and batches.ledger(spark, path).count() == 0
    for _ in range(2):
        batches.write_batch(rows, path, 0, F.col("state") == "ok", F.lit("no state"))
    # The third attempt's first writes are there, but it broke off before the ledger.
    rows.filter("id = 1").write.parquet(f"{path}/rows/batch=1")
    assert {r.id for r in batches.committed(spark, path).collect()} == {1, 3}
    batches.write_batch(rows.withColumn("id", F.col("id") + 10), path, 1, F.col("state") == "ok")
    assert sorted(r.id for r in batches.committed(spark, path).collect()) == [1, 3, 11, 13]
    assert sorted((r.id, r.reason, r.batch) for r in batches.committed(spark, path, "dead").collect()) == [(2, "no state", 0), (12, "rejected", 1)]
    assert sorted(map(tuple, batches.ledger(spark, path).collect())) == [(0, 2, 1), (1, 2, 1)]


def test_stream_writes_each_key_once(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "out")
    for i, ids in enumerate(([1, 2, 2], [2, 3], [4, -1])):
        put(source, f"{i}.json", "\n".join(json.dumps({"id": x}) for x in ids))
        stream = spark.readStream.schema("id long").json(str(source))
        batches.write_stream(stream, path, str(tmp_path / "checkpoint"), F.col("id") > 0, key=["id"]).awaitTermination()
    assert sorted(r.id for r in batches.committed(spark, path).collect()) == [1, 2, 3, 4]
    assert [r.id for r in batches.committed(spark, path, "dead").collect()] == [-1]


def test_routed_batch(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("b", -4)], "name string, v int")
    for _ in range(2):
        batches.routed(rows, path, 5, ["name"], lambda r: F.col("v") > 0)
    found = batches.committed(spark, path)
    assert sorted((r.name, r.v) for r in found.collect()) == [("a", 1), ("a", 3), ("b", 2)]
    assert [tuple(r) for r in batches.ledger(spark, path).collect()] == [(5, 3, 1)]


# Renames


def test_renames_and_their_log(spark):
    entities = F.array(F.lit("Customer"), F.lit("LineItem"))
    rows = spark.createDataFrame(
        [
            (1, {"Customer_id": "x", "session_id": "s", "plain": "p"}),
            (2, {"buyer": "Customer.customer_id", "other_id": "y"}),
            (3, {"CUSTOMER_ID": "a", "customer_id": "b"}),
            (4, {"LINEITEM_ID": "c", "Lineitem_Id": "d"}),
            (5, {}),
            (6, None),
        ],
        "id long, attrs map<string,string>",
    )
    out, log = R.renamed(rows, ["id"], "attrs", [R.session_rule(), R.source_rule(entities), R.id_rule(entities)])
    found = {r.id: r.attrs for r in out.collect()}
    assert found == {1: {"customer_id": "x", "param_session_id": "s", "plain": "p"}, 2: {"customer_id": "Customer.customer_id", "other_id": "y"}, 3: {"CUSTOMER_ID": "a", "customer_id": "b"}, 4: {"lineitem_id": "c", "Lineitem_Id": "d"}, 5: {}, 6: None}
    told = {(r.id, r.before, r.after, r.rule, r.applied) for r in log.collect()}
    assert told == {(1, "Customer_id", "customer_id", "id format", True), (1, "session_id", "param_session_id", "session", True), (2, "buyer", "customer_id", "value source", True), (3, "CUSTOMER_ID", "customer_id", "id format", False), (4, "LINEITEM_ID", "lineitem_id", "id format", True), (4, "Lineitem_Id", "lineitem_id", "id format", False)}
    assert {r.id: r.attrs for r in R.replayed(rows, ["id"], "attrs", log).collect()} == found


def test_log_replays_random_renames(spark):
    rng = random.Random(3)
    keys = ["a_id", "A_id", "A_ID", "b_id", "session_id", "param_session_id", "x"]
    rows = spark.createDataFrame([(i, {k: rng.choice(["A.q", "v", "b.z"]) for k in rng.sample(keys, rng.randint(0, 7))}) for i in range(150)], "id long, attrs map<string,string>")
    entities = F.array(F.lit("A"), F.lit("B"))
    out, log = R.renamed(rows, ["id"], "attrs", [R.session_rule(), R.source_rule(entities), R.id_rule(entities)])
    found = {r.id: r.attrs for r in out.collect()}
    before = {r.id: r.attrs for r in rows.collect()}
    assert all(sorted(found[i].values()) == sorted(before[i].values()) for i in before)  # no entry is lost
    assert {r.id: r.attrs for r in R.replayed(rows, ["id"], "attrs", log).collect()} == found


# Assertions


def test_assertions_name_their_offenders(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    expected = {"user": t([(1,), (2,), (9,)], "id long")}
    actual = {"user": t([(1,), (2,), (2,)], "id long"), "order": t([(1, 1, 5), (2, 7, 3), (3, None, 4)], "id long, user long, at long")}
    told = [A.unique("user", "id"), A.unique("order", "id"), A.references("order", "user", "user", "id"), A.monotone("order", [], ["id"], "at"), A.monotone("user", [], ["id"], "id"), A.holds("order", "at > 3"), A.kept("user", "id"), A.kept("order", "id"), A.unique("none", "id")]
    found = {r.name: (r.passed, r.skipped, r.n_offenders, [json.loads(w) for w in r.witnesses]) for r in A.asserted(spark, told, expected, actual).collect()}
    assert found["unique user(id)"] == (False, False, 1, [{"id": 2, "n": 2}])
    assert found["unique order(id)"] == (True, False, 0, []) == found["monotone user.id"]
    assert found["references order.user"] == (False, False, 1, [{"user": 7}])
    assert found["monotone order.at"] == (False, False, 1, [{"id": 2, "at": 3, "before": 5}])
    assert found["holds order: at > 3"] == (False, False, 1, [{"id": 2, "user": 7, "at": 3}])
    assert found["kept user.id"] == (False, False, 1, [{"id": 9}])
    assert found["kept order.id"] == (None, True, 0, []) == found["unique none(id)"]
    assert all(r.skipped for r in A.asserted(spark, told, None, None).collect())


def test_few_witnesses_of_many(spark):
    many = {"t": spark.range(1000)}
    row = A.asserted(spark, [A.holds("t", "id < 0")], None, many, most=2).first()
    assert (row.n_offenders, len(row.witnesses), row.passed) == (1000, 2, False)


@pytest.mark.parametrize("has,gold,missing,broken,passed,reason", [(False, 1, 1, True, None, "no state"), (True, 0, 0, False, True, "no changes expected"), (True, 2, 1, False, False, "1 changes missing"), (True, 2, 0, True, False, "assertion failed: a"), (True, 2, 0, False, True, ""), (True, 0, 0, True, False, "assertion failed: a")])
def test_environment_verdict(spark, has, gold, missing, broken, passed, reason):
    changes = spark.createDataFrame([(1, has, gold, missing)], "id long, has_states boolean, n_gold long, n_missing long")
    results = spark.createDataFrame([(1, "a", not broken), (1, "b", None), (2, "a", False)], "id long, name string, passed boolean")
    row = A.environment_verdict(changes, results, "id").first()
    assert (row.passed, row.reason) == (passed, reason)


def test_queries_keep_the_last_line_of_an_id(spark, tmp_path):
    from weftline.sources import readers

    line = lambda i, text: json.dumps({"id": i, "messages": [{"role": "user", "content": text}], "task_info": {"combo_id": text}})
    put(tmp_path, "A_B.jsonl", "\n".join([line("q1", "zz"), line("q2", "old"), "no json", line("q1", "aa"), ""]))
    put(tmp_path, "C.jsonl", "\n".join([line("q2", "x"), line("q2", "new"), json.dumps({"messages": []})]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        found = {(r.id, r.combo_id, r.domain_key, tuple(r.domains)) for r in readers.queries(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {("q1", "aa", "A_B", ("A", "B")), ("q2", "new", "C", ("C",))}

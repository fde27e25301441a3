"""Sources, sinks, tools, names and streams on small hand-made files and rows."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.functions import domains, hashing, text, values
from weftline.operators import conversations, evaluation, graph, models, progress, selection, state, tools, trajectories
from weftline.sources import readers, sinks
from weftline.streaming import sessions


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")


def test_json_lines_lose_no_line(spark, tmp_path):
    write(tmp_path / "a.jsonl", {"id": "a", "n": 1}, {"id": "b", "n": "oops"}, "not json", "", {"id": "c", "n": 3})
    good, bad = readers.json_lines(spark, str(tmp_path), "id string, n int")
    assert sorted((r.id, r.n) for r in good.collect()) == [("a", 1), ("c", 3)]
    assert sorted(json.loads(r.value)["id"] if r.value[0] == "{" else r.value for r in bad.collect()) == ["b", "not json"]


def test_documents_rollouts_and_texts(spark, tmp_path):
    write(tmp_path / "docs" / "x.json", json.dumps([{"id": "1"}, {"id": "2"}]))
    assert readers.json_documents(spark, str(tmp_path / "docs"), "id string").count() == 2
    message = {"role": "assistant", "content": None, "tool_calls": [{"id": "c1", "type": "function", "function": {"name": "srv.find", "arguments": '{"k": 1}'}}, {"id": "c2", "type": "function", "function": {"name": "book", "arguments": "{bad"}}]}
    write(tmp_path / "roll" / "r.jsonl", {"id": "r1", "messages": [message], "success": True}, {"id": "r2", "messages": [], "success": False, "error": "x"})
    write(tmp_path / "roll" / "s.json", json.dumps([{"id": "r3", "messages": [], "success": True}]))
    rolled = readers.rollouts(spark, str(tmp_path / "roll"))
    assert {r.id for r in rolled.collect()} == {"r1", "r2", "r3"}
    calls = {(r.id, r.name, r.arguments) for r in tools.calls_of(rolled).collect()}
    assert calls == {("r1", "find", '{"k":1}'), ("r1", "book", "{}")}
    good, rejects = sinks.split_results(rolled)
    assert {r.id for r in good.collect()} == {"r1", "r3"} and [r.id for r in rejects.collect()] == ["r2"]
    write(tmp_path / "policy" / "Bank.md", "rule one", "rule two")
    policies = readers.texts(spark, str(tmp_path / "policy"))
    servers = spark.createDataFrame([("Bank",), ("Shop",)], "server string")
    assert {r.server: r.policy.strip() for r in readers.with_policies(servers, policies).collect()} == {"Bank": "rule one\nrule two", "Shop": ""}


def test_queries_samples_and_pending(spark, tmp_path):
    info = {"trajectory": ["a", "b"], "instruction": "do", "trajectory_hash": "h", "combo_id": "k1"}
    write(tmp_path / "q" / "Bank_Shop.jsonl", {"id": "r1", "messages": [], "user_system_prompt": "p", "task_info": info}, {"id": "r1", "messages": [], "user_system_prompt": "q", "task_info": info})
    write(tmp_path / "q" / "Desk.jsonl", {"id": "r2", "messages": [], "task_info": {"trajectory": [], "combo_id": "k2"}})
    asked = readers.queries(spark, str(tmp_path / "q"))
    rows = {r.id: r for r in asked.collect()}
    assert rows["r1"].user_system_prompt == "q" and rows["r1"].domains == ["Bank", "Shop"] and rows["r2"].domain_key == "Desk"
    combos = spark.createDataFrame([("Bank_Shop", "k1", 1, "late"), ("Bank_Shop", "k1", 0, "first")], "domain_key string, combo_id string, sample_idx int, note string")
    rolled = spark.createDataFrame([("r1", "x"), ("r2", "y"), ("r9", "z")], "id string, body string")
    found = {r.id: r for r in readers.samples(rolled, asked, combos).collect()}
    assert found["r1"].combo.note == "first" and found["r1"].trajectory == ["a", "b"] and found["r2"].trajectory == [] and found["r9"].combo is None
    assert {r.id for r in readers.pending(rolled, asked, "id").collect()} == {"r9"}
    assert {r.combo_id for r in readers.processed(asked).collect()} == {"k1", "k2"}


def test_blueprints_in_both_layouts(spark, tmp_path):
    write(tmp_path / "b" / "1.json", json.dumps([{"MCP_server_name": "A", "core_entity": "X"}]))
    write(tmp_path / "b" / "2.json", json.dumps({"blueprints": [{"MCP_server_name": "A", "core_entity": "Y"}, {"MCP_server_name": "B", "core_entity": "Z"}]}))
    found = readers.blueprints(spark, str(tmp_path / "b"), "MCP_server_name:string,core_entity:string")
    assert {(r.MCP_server_name, r.core_entity) for r in readers.by_server(found).collect()} == {("A", "Y"), ("B", "Z")}


def test_combo_loaders(spark):
    rows = [("A", "h1", "n1", ["x"], True), ("A_B", "h2", "n2", ["y"], None)]
    combos = spark.createDataFrame(rows, "domain string, trajectory_hash string, name string, trajectory array<string>, is_cross_domain boolean")
    assert [r.trajectory_hash for r in readers.validated_hashes(combos).collect()] == ["h1"]
    assert [r.name for r in readers.completed_trajectories(combos, True).collect()] == ["n1"]
    none = F.lit(None).cast("map<string,string>")
    context = readers.entity_context(combos.withColumn("entity_instances", none).withColumn("value_domains", F.create_map(F.lit("a"), F.lit("b")))).first().context
    assert context.entity_instances == {} and context.value_domains == {"a": "b"}


def test_sinks(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "id string, n int")
    path = str(tmp_path / "table")
    sinks.append_new(spark, rows(("a", 1), ("a", 2), ("b", 3)), path, ["id"], ["n"])
    sinks.append_new(spark, rows(("b", 9), ("c", 4)), path, ["id"], ["n"])
    assert sorted((r.id, r.n) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3), ("c", 4)]
    for x in (("a", 1), ("b", 2)):
        sinks.write_lines(rows(x), str(tmp_path / "lines"), partition="id")
    assert sorted((r.id, r.n) for r in spark.read.json(str(tmp_path / "lines")).collect()) == [("a", 1), ("b", 2)]
    sinks.write_report(rows(("total", 2)), rows(("a", 1), ("b", 2)), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "samples")).count() == 2
    combos = spark.createDataFrame([("k", {"Bank.user_1": "r1", "Bank.owns": "r2"})], "combo_id string, entity_instances map<string,string>")
    routed = {(r.table, r.kind, r.record) for r in sinks.routed_instances(combos, ["user"]).collect()}
    assert routed == {("user", "entities", "r1"), ("owns", "relationships", "r2")}
    stats = spark.createDataFrame([("A", 3, 1, "33.3%"), ("B", 1, 1, "100.0%")], "server string, total_combos int, validated_combos int, pass_rate string")
    failures = spark.createDataFrame([("A", f"k{i}", None if i else "bad") for i in range(8)], "server string, combo_id string, reason string")
    report = {r.server: r.markdown for r in sinks.filtering_report(failures, stats).collect()}
    assert report["B"] == "## B\n1 of 1 valid (100.0%)" and report["A"].split("\n")[2:] == ["- k0: bad", *[f"- k{i}: unknown" for i in range(1, 5)]]


def test_tool_lists(spark):
    param = "struct<type:string,description:string,range:string,required:boolean>"
    row = (("find", "Finds", {"k": ("int", "key", "1-9", True), "note": ("text", "remark", None, False)}),)
    functions = spark.createDataFrame([([*row],)], f"functions array<struct<name:string,description:string,parameters:map<string,{param}>>>")
    every, needed = functions.select(tools.tool_list(F.col("functions")).alias("a"), tools.tool_list(F.col("functions"), True).alias("b")).first()
    assert every[0].function.parameters.required == ["k", "note"] and needed[0].function.parameters.required == ["k"]
    assert needed[0].function.parameters.properties["k"].description == "key (range: 1-9)" and every[0].function.parameters.properties["k"].type == "integer"
    listed = spark.createDataFrame([("Bank", "find")], "server string, name string")
    assert {r.key for r in tools.tool_index(listed, "server", "name").collect()} == {"find", "Bank.find"}
    prints = spark.createDataFrame([("Bank", [("owns", ["a", "b"])])], "MCP_server_name string, relationships array<struct<name:string,attributes:array<string>>>")
    assert tools.relation_tuples(prints).collect() == [("Bank", "owns", ["a", "b"])]


@pytest.mark.parametrize(
    "column, want",
    [
        (lambda c: text.tool_server(c("Bank.find")), "Bank"),
        (lambda c: text.snake_to_camel(c("get_item_now")), "GetItemNow"),
        (lambda c: text.server_identifier(c("9 lives-shop")), "MCP9LivesShop"),
        (lambda c: text.initials(c("BankOfShops")), "bos"),
        (lambda c: text.fill_template(c("hi {a}, {b}"), F.create_map(c("a"), c("1"), c("b"), c("2"))), "hi 1, 2"),
        (lambda c: text.fenced_code(c("x\n```python\nrun()\n```")), "run()"),
        (lambda c: text.domain_set(F.array(c("b"), c("a"), c("b"))), ["a", "b"]),
        (lambda c: text.is_state_changing(c("Create_order")), True),
        (lambda c: text.is_recoverable(c("HTTP 503 Service")), True),
        (lambda c: text.test_counts(c("2 failed, 5 passed in 3s"))["passed"], 5),
        (lambda c: domains.field_of(c("**Name**: Bank\nx"), "name"), "Bank"),
        (lambda c: hashing.shard_prefix(c("a")), "0cc1"),
        (lambda c: hashing.table_hash(F.array(c("b"), c("a"))) == hashing.table_hash(F.array(c("a"), c("b"))), True),
        (lambda c: hashing.combo_id(c("h"), c('{"b": 1, "a": "é"}')), "c8b34ce2c5a3"),
        (lambda c: values.json_in_text(c('say ```json\n{"a": [1, 2]}\n``` now')), '{"a": [1, 2]}'),
        (lambda c: conversations.monitor_decision(F.lit(3), 3, F.lit(False), F.lit(False)), "no_tool_run"),
        (lambda c: conversations.call_sequence(F.array(c("a"), c("b"))), "a -> b"),
        (lambda c: conversations.execution_log(F.array(F.struct(c("f").alias("tool"), c("{}").alias("arguments"), F.lit(None).cast("string").alias("result")))), "1. f({}) -> none"),
        (lambda c: state.is_dynamic(c("created_at"), c("x"), ["user_id"], ["created_at"]), True),
        (lambda c: state.is_dynamic(c("user_id"), c("x"), ["user_id"], []), False),
    ],
)
def test_columns(spark, column, want):
    import hashlib

    if want == "c8b34ce2c5a3":
        body = json.dumps({"trajectory_hash": "h", "entity_instances": {"a": "é", "b": 1}}, sort_keys=True, ensure_ascii=False)
        want = hashlib.md5(body.encode()).hexdigest()[:12]
    got = spark.range(1).select(column(F.lit).alias("x")).first().x
    assert got == want or str(got).replace(" ", "") == str(want).replace(" ", "")


def test_nested_trajectories_and_placeholders(spark):
    rows = spark.createDataFrame([(1, [{"Bank": ["find", "pay"]}, {"Shop": ["buy"]}])], "id int, trajectory array<map<string,array<string>>>")
    assert rows.select(trajectories.nested_trajectory(F.col("trajectory")).alias("x")).first().x == ["Bank.find", "Bank.pay", "Shop.buy"]
    records = spark.createDataFrame([("t", {"a": "TBD", "b": "x"}), ("t", {"a": "y", "b": "z"})], "table string, fields map<string,string>")
    assert state.placeholder_fields(records, "table", "fields").collect() == [("t", "a")]


def test_values_by_tool_prefix_and_tables_by_name(spark):
    rows = [(1, "pay.amount", "5", ["find", "pay"]), (1, "find.k", "1", ["find", "pay"]), (1, "find.a", "2", ["find", "pay"])]
    listed = conversations.by_tool_prefix(spark.createDataFrame(rows, "id int, name string, value string, trajectory array<string>"), "id").first().listed
    assert listed == "find: a=2, k=1\npay: amount=5"
    tables = spark.createDataFrame([("User Account", None, "g"), ("user_account", "Bank", "b")], "name string, server string, record string")
    assert [r.record for r in selection.named_table(tables, "UserAccount", "Bank").collect()] == ["b"]
    assert [r.record for r in selection.named_table(tables, "UserAccount", "Shop").collect()] == ["g"]
    assert selection.named_table(tables, "none").count() == 0


def test_provider_is_asked_once_a_prompt_and_retried(spark, tmp_path):
    def flaky(prompt: str) -> str:
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    rows = spark.createDataFrame([("a",), ("a",), ("bad",), ("known",)], "p string")
    cache = spark.range(1).select(F.sha2(F.lit("known"), 256).alias("prompt_hash"), F.lit("kept").alias("answer"))
    got = {r.p: (r.answer, r.error) for r in models.answered(rows, "p", flaky, cache=cache).collect()}
    assert got == {"a": ("A", None), "bad": (None, "no"), "known": ("kept", None)}


def test_the_stream_ends_where_the_batch_does(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").select("user_id", "event_type")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = sessions.stream_sessions(stream).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    last = spark.table("folded").groupBy("user_id").agg(F.max_by(F.struct("n_calls", "n_errors", "status"), "n_calls").alias("s")).select("user_id", "s.*")
    assert sorted(last.collect()) == sorted(sessions.batch_sessions(events).collect())


def test_paths_of_a_small_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "source string, target string")
    assert sorted(r.path for r in graph.simple_paths(edges).collect()) == [["a", "b", "c"], ["a", "c"]]


def test_routes_and_bindings(spark):
    listed = spark.createDataFrame([("Bank", "find"), ("Shop", "find"), ("Shop", "buy")], "server string, name string")
    calls = spark.createDataFrame([("Shop.find",), ("find",), ("Bank.gone",), ("none",)], "name string")
    assert {r.name: r.server for r in tools.routed_calls(calls, listed).collect()} == {"Shop.find": "Shop", "find": "Bank", "Bank.gone": "Bank", "none": None}
    wanted = spark.createDataFrame([(1, k) for k in ("S.t.a", "S.t.b", "S.t.owner_user_id", "S.t.confirm", "S.t.z")], "id int, key string")
    samples = spark.createDataFrame([(1, "S.t.a", "exact")], "id int, key string, value string")
    fields = spark.createDataFrame([(1, "a", "no"), (1, "b", "field"), (1, "user_id", "u1")], "id int, field string, value string")
    found = {r.key: (r.value, r.source) for r in tools.bound_values(wanted, samples, fields).collect()}
    assert found == {"S.t.a": ("exact", "sample"), "S.t.b": ("field", "field"), "S.t.owner_user_id": ("u1", "alike"), "S.t.confirm": ("true", "fixed"), "S.t.z": (None, None)}
    rows = spark.createDataFrame([("A", ["x", "y"], None), ("B", None, "z")], "server string, tools array<string>, tool string")
    assert sorted(tools.all_tools(rows).collect()) == [("A", "x"), ("A", "y"), ("B", "z")]
    params = spark.createDataFrame([("A", "f", "p"), ("A", "f", "q")], "server string, function string, param string")
    classes = spark.createDataFrame([("A", "f", "p", True, "note")], "server string, function string, param string, ignore boolean, category string")
    assert {r.param: (r.ignore_in_eval, r.param_category) for r in tools.with_eval_markers(params, classes).collect()} == {"p": (True, "note"), "q": (False, None)}


def test_topics_accumulate_to_the_target(spark):
    old = spark.createDataFrame([("Bank",), ("Shop",)], "topic string")
    new = spark.createDataFrame([(1, "bank"), (2, "Desk"), (3, "Farm"), (4, "desk "), (5, "Mill")], "pos int, topic string")
    assert {r.topic for r in selection.accumulated(old, new, "topic", ["pos"], 4).collect()} == {"Bank", "Shop", "Desk", "Farm"}


def test_small_reports(spark):
    rows = spark.createDataFrame([("A", "h"), ("A", "h"), ("B", "g")], "server string, trajectory_hash string")
    assert sorted(progress.by_server(rows).collect()) == [("A", 2, 1), ("B", 1, 1)]
    lists = spark.createDataFrame([(1, ["a", "b"]), (2, None)], "id int, items array<string>")
    fit, over = progress.within_limit(lists, "items", 1)
    assert [r.id for r in fit.collect()] == [2] and [r.id for r in over.collect()] == [1]
    judged = evaluation.judged_scores(spark.createDataFrame([(1, 4, True), (2, 2, None)], "id int, rating int, rude boolean"), "rating", ["rude"])
    assert sorted((r.id, r.evaluator, r.score, r.passed, r.n_issues) for r in evaluation.unified(judged, judged.limit(0)).collect()) == [(1, "subjective", 0.8, True, 1), (2, "subjective", 0.4, False, 0)]
    assert evaluation.mean_scores(judged, ["rating"]).first() == (2, 3.0)
    one = spark.range(1).select(
        text.with_policy_markers(F.lit("rules"), F.array(F.struct(F.lit("buy").alias("tool"), F.lit("pay first").alias("content")))).alias("p"),
        selection.entity_set(F.lit("A"), F.array(F.lit("B"), F.lit("A"))).alias("e"),
        tools.offered_tools(F.lit("no_tool"), F.array(F.lit("a")), F.array(F.lit("b"))).alias("t"),
        progress.duration_seconds(F.to_timestamp(F.lit("2024-01-01 00:00:00")), F.to_timestamp(F.lit("2024-01-01 00:01:05"))).alias("s"),
    )
    row = one.first()
    assert (row.e, row.t, row.s) == (["A", "B"], [], 65)
    back = one.select(text.policy_sections(F.col("p")).alias("s"), text.global_rules(F.col("p")).alias("r"), domains.tool_names(F.col("p")).alias("n")).first()
    assert [(x.tool, x.content.strip()) for x in back.s] == [("buy", "pay first")] and back.r.strip() == "rules" and back.n == ["buy"]

"""Queries over evaluation, records, policies, ledgers and names, with DuckDB SQL for the same results.

They read the driver's tables in the roles that `weftline.queries` states; every query reads whole tables
and whole texts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import domains as P
from weftline.functions import text as X
from weftline.functions.hashing import context_id, query_id, sample_id, task_id
from weftline.operators import conversations as C
from weftline.operators import evaluation as E
from weftline.operators import graph as G
from weftline.operators import matching as M
from weftline.operators import progress as L
from weftline.operators import records as R
from weftline.operators import selection as S
from weftline.queries import SESSIONS, gold_and_actual, query, session_rows
from weftline.session import parts_for, table
from weftline.sources import readers, sinks

# Evaluation


def blueprint_functions(spark, d):
    """Functions by (server = part type, function = brand), with a parameter map."""
    spec = lambda kind, about, ignore: F.struct(F.lit(kind).alias("range"), F.lit(about).alias("description"), F.lit(ignore).alias("ignore_in_eval"))
    params = F.create_map(F.lit("note"), spec("string", "remark", False), F.lit("size"), spec("int", "size", False), F.lit("mark"), spec("int", "mark", True), F.lit("narrow"), spec("int", "a Filter on size", False))
    about = F.when(F.min("p_size") % 3 == 0, "Filters parts").otherwise("Finds parts")
    return table(spark, d, "part").groupBy(F.col("p_type").alias("server"), F.col("p_brand").alias("function")).agg(about.alias("description")).withColumn("parameters", params)


@query(
    "WITH f AS (SELECT p_type, p_brand, min(p_size) % 3 = 0 AS narrows FROM part GROUP BY ALL), u AS (SELECT unnest(['note', 'size', 'mark', 'narrow', 'part_id', 'supply_id']) AS param) "
    "SELECT p_partkey, param, narrows OR param IN ('note', 'mark', 'narrow', 'supply_id') OR (param = 'size' AND p_partkey % 5 = 0) AS ignored FROM part JOIN f USING (p_type, p_brand) JOIN u ON true"
)
def parameter_rules(spark, d):
    server = F.when(F.col("p_partkey") % 2 == 1, F.concat(F.lit("Other_"), "p_type")).otherwise(F.col("p_type"))
    part = table(spark, d, "part").select("p_partkey", server.alias("server"), F.col("p_brand").alias("function"), "p_name", F.col("p_size").cast("string").alias("size"))
    values = {"note": F.concat(F.lit("about "), "p_name"), "size": F.col("size"), "mark": F.lit("1"), "narrow": F.lit("1"), "part_id": F.col("p_partkey").cast("string"), "supply_id": F.lit("7")}
    # Functions are looked up before the parameters are spread, and joined by sorting: Spark would take the rows for few enough to broadcast.
    about = part.join(E.function_info(part, blueprint_functions(spark, d)).hint("merge"), ["server", "function"])
    rows = about.select("p_partkey", "info", F.explode(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])).alias("param", "expected"))
    actual = F.when((F.col("param") == "size") & (F.col("p_partkey") % 5 == 0), "<size>").otherwise(F.col("expected"))
    return rows.select("p_partkey", "param", E.is_ignored(F.col("param"), F.col("expected"), actual, F.col("info"), F.array(F.lit("part_id"))).alias("ignored"))


@query(
    "WITH l AS (SELECT l_orderkey AS id, l_linenumber AS pos, l_returnflag AS name, l_linestatus AS s, l_quantity AS q FROM lineitem), g AS (SELECT * FROM l WHERE pos % 2 = 0 AND NOT (id % 3 = 0 AND pos = 2)), j AS (SELECT g.id, g.pos, a.pos AS a_pos, (g.s <> a.s)::INT + (abs(g.q - a.q) >= 0.0001)::INT AS n "
    "FROM g LEFT JOIN l a ON g.id = a.id AND g.name = a.name AND a.pos % 2 = 1), b AS (SELECT id, pos, min(n) AS n FROM j GROUP BY ALL) "
    "SELECT id, count(*) AS n_gold, count(n) AS n_found, count(*) FILTER (n = 0) AS n_full, bool_and(n IS NOT NULL) AS passed, round(count(*) FILTER (n = 0) / count(*)::DOUBLE, 6) AS full_match_rate FROM b GROUP BY id"
)
def action_evaluation(spark, d):
    gold, actual = gold_and_actual(spark, d)
    pruning = table(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.lit(2).alias("index"))
    actual = actual.select("id", "name", F.col("pos").alias("a_pos"), F.col("status").alias("a_status"), F.col("quantity").alias("a_quantity"))
    differ = (F.col("status") != F.col("a_status")).cast("int") + (F.abs(F.col("quantity") - F.col("a_quantity")) >= 0.0001).cast("int")
    scores = E.action_report(M.action_scores(M.best_matches(E.unpruned(gold, pruning), actual, differ)))
    return scores.withColumn("full_match_rate", F.round("full_match_rate", 6))


def evaluated(spark, d, parts):
    """Samples are orders: without a trajectory if pending, without calls if they have no line; the evaluators
    look at their lines and their price. Lines are dealt by order over `parts` before they are gathered."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    trajectory = F.when(F.col("o_orderstatus") != "P", F.array("o_orderpriority"))
    samples = orders.select(F.col("o_orderkey").alias("id"), trajectory.alias("trajectory"))
    calls = lines.filter("l_quantity > 5").select(F.col("l_orderkey").alias("id"))
    action = E.dealt(lines, "l_orderkey", parts).groupBy(F.col("l_orderkey").alias("id")).agg(F.avg((F.col("l_returnflag") != "R").cast("double")).alias("score"))
    action = action.select("id", F.lit("action").alias("evaluator"), F.round("score", 6).alias("score"), (F.col("score") == 1.0).alias("passed"), F.lit(False).alias("skipped"))
    price = orders.select(F.col("o_orderkey").alias("id"), F.lit("environment").alias("evaluator"), F.lit(1.0).alias("score"), (F.col("o_totalprice") > 50000).alias("passed"), (F.col("o_custkey") % 4 == 0).alias("skipped"))
    return E.verdicts(samples, calls, action.unionByName(price), parts=parts)


VERDICTS = (
    "c AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity > 5), s AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'no trajectory' WHEN c.id IS NULL THEN 'no tool calls' END AS reason FROM orders LEFT JOIN c ON c.id = o_orderkey), "
    "r AS (SELECT l_orderkey AS id, 'action' AS evaluator, round(avg((l_returnflag <> 'R')::INT), 6) AS score, bool_and(l_returnflag <> 'R') AS passed, false AS skipped FROM lineitem GROUP BY 1 UNION ALL SELECT o_orderkey, 'environment', 1.0, o_totalprice > 50000, o_custkey % 4 = 0 FROM orders), "
    "v AS (SELECT id, 'sample' AS evaluator, 0.0::DOUBLE AS score, false AS passed, false AS skipped, reason FROM s WHERE reason IS NOT NULL UNION ALL SELECT r.id, evaluator, score, passed, skipped, NULL FROM r JOIN s USING (id) WHERE reason IS NULL)"
)


@query(f"WITH {VERDICTS} SELECT id, evaluator, score::DOUBLE AS score, passed, skipped, reason FROM v")
def sample_verdicts(spark, d):
    return evaluated(spark, d, parts_for(table(spark, d, "lineitem")))


@query(
    f"WITH {VERDICTS}, a AS (SELECT evaluator, passed, skipped FROM v UNION ALL SELECT NULL, bool_and(passed), bool_and(skipped) FROM v GROUP BY id) "
    "SELECT evaluator, count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, count(*) FILTER (skipped) AS skipped, round(count(*) FILTER (passed) / count(*)::DOUBLE, 6) AS pass_rate FROM a GROUP BY 1"
)
def evaluation_report(spark, d):
    parts = parts_for(table(spark, d, "lineitem"))
    return E.evaluator_report(evaluated(spark, d, parts), parts).withColumn("pass_rate", F.round("pass_rate", 6))


@query("SELECT d.doc_id AS id, coalesce(bool_and(quality = 1), true) AS passed, bool_and(quality = 1) IS NULL AS skipped, coalesce(bool_and(quality = 1), true)::INT::DOUBLE AS score FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def assertion_verdicts(spark, d):
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("holds"))
    return E.skipped_or_all(labels, table(spark, d, "documents").select(F.col("doc_id").alias("id")))


@query(
    "SELECT doc_id, (1 + 4 * quality) / 5.0::DOUBLE AS share, 1 + 4 * quality >= 3 AS passed, ((toxic = 1)::INT + (quality = 0)::INT)::BIGINT AS n_issues, concat_ws(',', CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 0 THEN 'poor' END) AS issues FROM labels"
)
def judged_issues(spark, d):
    rows = table(spark, d, "labels").select("doc_id", (1 + 4 * F.col("quality")).alias("rating"), (F.col("toxic") == 1).alias("toxic"), (F.col("quality") == 0).alias("poor"))
    found = E.judged_scores(rows, "rating", ["toxic", "poor"])
    return found.select("doc_id", "share", "passed", "n_issues", F.array_join("issues", ",").alias("issues"))


@query(f"WITH {SESSIONS}, p AS (SELECT user_id % 3 AS g, len(t) AS steps, len(list_filter(t, lambda x: x = 'view')) AS redundant, user_id % 2 = 0 AS cached FROM h) SELECT g, count(*) AS n, sum(steps)::BIGINT AS steps, sum(redundant)::BIGINT AS redundant, round(sum(redundant) / sum(steps)::DOUBLE, 6) AS ratio, count(*) FILTER (cached) AS cache_hits FROM p GROUP BY 1")
def prune_summary(spark, d):
    rows = session_rows(spark, d).select((F.col("user_id") % 3).alias("g"), F.size("trajectory").alias("steps"), F.size(F.filter("trajectory", lambda t: t == "view")).alias("redundant"), (F.col("user_id") % 2 == 0).alias("cached"))
    return E.prune_summary(rows, ["g"]).withColumn("ratio", F.round("ratio", 6))


@query(
    f"WITH {SESSIONS}, c AS (SELECT user_id % 5 AS server, user_id % 10 AS file, trajectory_hash, len(t) > 10 AS valid FROM h) SELECT server, count(DISTINCT file) AS total_files, count(*) AS total_combos, count(*) FILTER (valid) AS validated_combos, count(*) FILTER (NOT valid) AS failed_combos, "
    "count(DISTINCT trajectory_hash) AS unique_trajectories, count(DISTINCT CASE WHEN valid THEN trajectory_hash END) AS trajectories_validated, round(count(*) FILTER (valid) / count(*)::DOUBLE * 100, 1)::VARCHAR || '%' AS pass_rate FROM c GROUP BY 1"
)
def filtering_stats(spark, d):
    rows = session_rows(spark, d).select((F.col("user_id") % 5).alias("server"), (F.col("user_id") % 10).alias("file"), "trajectory_hash", (F.size("trajectory") > 10).alias("valid"))
    return E.filtering_stats(rows, ["server"])


# Records and states


def order_record(spark, d):
    fields = {"order_status": (F.col("o_orderstatus"), "string"), "total": (F.col("o_totalprice"), "double"), "customer": (F.col("o_custkey"), "long"), "priority": (F.col("o_orderpriority"), "string"), "opening_date": (F.lit("2024"), "string")}
    return R.normal_form(fields, F.array(F.lit("opening_date")))


MONEY = "regexp_replace(CAST(round(o_totalprice, 2) AS DECIMAL(38, 2))::VARCHAR, '0$', '')"
RECORD = f"'{{\"customer\": ' || o_custkey || ', \"order_status\": \"' || lower(o_orderstatus) || '\", \"priority\": \"' || lower(o_orderpriority) || '\", \"total\": ' || {MONEY} || '}}'"


@query(f"SELECT o_orderkey, {RECORD} AS record, md5({RECORD}) AS digest FROM orders")
def normalised_records(spark, d):
    record = R.record_json(order_record(spark, d))
    return table(spark, d, "orders").select("o_orderkey", record.alias("record"), R.record_digest(order_record(spark, d)).alias("digest"))


@query(
    "WITH g AS (SELECT o_orderpriority AS t, o_orderkey || o_orderstatus AS r FROM orders), a AS (SELECT o_orderpriority AS t, o_orderkey || CASE WHEN o_orderkey % 97 = 0 AND o_orderpriority LIKE '1%' THEN 'X' ELSE o_orderstatus END AS r FROM orders WHERE NOT (o_orderkey % 89 = 0 AND o_orderpriority LIKE '2%')), "
    "b AS (SELECT t, r, count(*) FILTER (s = 0) AS n_gold, count(*) FILTER (s = 1) AS n_agent FROM (SELECT *, 0 AS s FROM g UNION ALL SELECT *, 1 FROM a) GROUP BY t, r) "
    "SELECT t, sum(n_gold)::BIGINT AS n_gold, sum(n_agent)::BIGINT AS n_agent, CASE WHEN sum(n_gold) <> sum(n_agent) THEN 'count_mismatch' WHEN count(*) FILTER (n_gold <> n_agent) > 0 THEN 'content_mismatch' ELSE 'equal' END AS kind, "
    "coalesce(array_to_string((list(r ORDER BY r) FILTER (n_gold <> n_agent))[1:5], ','), '') AS first_differences FROM b GROUP BY t"
)
def state_comparison(spark, d):
    orders = table(spark, d, "orders").withColumn("t", F.col("o_orderpriority"))
    key = F.col("o_orderkey").cast("string")
    changed = F.when((F.col("o_orderkey") % 97 == 0) & F.col("t").startswith("1"), "X").otherwise(F.col("o_orderstatus"))
    gold = orders.select("t", F.concat(key, "o_orderstatus").alias("r"))
    agent = orders.filter(~((F.col("o_orderkey") % 89 == 0) & F.col("t").startswith("2"))).select("t", F.concat(key, changed).alias("r"))
    return R.state_comparison(gold, agent, "t", "r").withColumn("first_differences", F.array_join("first_differences", ","))


@query("SELECT o_orderpriority, count(*) AS n, o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AS same FROM orders GROUP BY 1")
def state_digests(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", F.concat_ws("|", "o_orderkey", "o_orderstatus").alias("r"))
    # The same rows in another order, but for one table with a changed record in it and one with a repeated record.
    urgent, high = (rows.filter(F.col("o_orderpriority") == p).agg(F.min("r").alias("least")) for p in ("1-URGENT", "2-HIGH"))
    changed = rows.join(F.broadcast(urgent), F.col("r") == F.col("least"), "left").withColumn("r", F.coalesce(F.concat("least", F.lit("!")), F.col("r"))).drop("least")
    again = rows.join(F.broadcast(high), F.col("r") == F.col("least"), "left_semi")
    one, two = R.state_digest(rows, "o_orderpriority", "r"), R.state_digest(changed.unionByName(again).repartition(7, "r"), "o_orderpriority", "r")
    return one.join(two.select("o_orderpriority", F.col("digest").alias("other")), "o_orderpriority").select("o_orderpriority", "n", (F.col("digest") == F.col("other")).alias("same"))


def result_messages(spark, d, shift: int):
    """Events as tool messages: booking ids of a multiple of 3 differ between runs, contents of a multiple of 10 are no JSON."""
    e = table(spark, d, "events")
    booking = F.concat(F.lit("b"), (F.col("event_id") + F.when(F.col("event_id") % 3 == 0, shift).otherwise(0)).cast("string"))
    body = F.to_json(F.struct(booking.alias("booking_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"), F.get_json_object("props", "$.k").alias("k")))
    content = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("failed: "), "props")).otherwise(body)
    return e.select(F.col("user_id").alias("id"), F.lit("tool").alias("role"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("tool_call_id"), content.alias("content"), F.col("event_id").alias("pos"))


@query("SELECT user_id AS id, 'c' || event_id AS tool_call_id, 'booking_id' AS field, 'b' || event_id AS old, 'b' || (event_id + 1) AS new FROM events WHERE event_id % 3 = 0 AND event_id % 10 <> 0")
def id_reconciliation(spark, d):
    results = [R.tool_results(result_messages(spark, d, s)) for s in (0, 1)]
    return R.id_mapping(*results, F.array(F.lit("user_id")))


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'failed: ' || props ELSE '' END AS raw, CASE WHEN event_id % 10 = 0 THEN '' ELSE json_extract_string(props, '$.k') END AS k, event_id % 7 = 0 AS bad FROM events")
def tool_result_fields(spark, d):
    found = R.tool_results(result_messages(spark, d, 0))
    result = F.when(F.col("event_id") % 7 == 0, '{"success": false}').otherwise('{"error": null}')
    keyed = found.select(F.regexp_replace("tool_call_id", "c", "").cast("long").alias("event_id"), "result")
    value = lambda k: F.coalesce(F.try_element_at("result", F.lit(k)), F.lit(""))
    return keyed.select("event_id", value("raw_content").alias("raw"), value("k").alias("k"), R.has_error(result).alias("bad"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'new' ELSE 'b' || event_id END AS booking, event_id % 5 <> 0 AS loose, event_id % 3 <> 0 AND event_id % 5 <> 0 AS strict FROM events")
def arguments_with_new_ids(spark, d):
    e = table(spark, d, "events").select("event_id", F.create_map(F.lit("booking"), F.concat(F.lit("b"), F.col("event_id").cast("string")), F.lit("note"), F.lit("x")).alias("args"))
    mapping = F.when(F.col("event_id") % 3 == 0, F.create_map(F.concat(F.lit("b"), F.col("event_id").cast("string")), F.lit("new"))).otherwise(F.create_map().cast("map<string,string>"))
    changed = lambda args: F.transform_values(args, lambda k, v: F.when((k == "note") & (F.col("event_id") % 5 == 0), F.lit("y")).otherwise(v))
    made = e.withColumn("now", changed(R.with_new_ids(F.col("args"), mapping)))
    return made.select("event_id", F.col("now")["booking"].alias("booking"), R.strictly_matches(F.col("args"), F.col("now"), ignored=F.array(F.lit("booking"))).alias("loose"), R.strictly_matches(F.col("args"), F.col("now")).alias("strict"))


@query("SELECT p_name AS name, CASE WHEN p_name IN (SELECT p_name FROM part WHERE p_partkey % 2 = 0) THEN 'entity' ELSE 'relationship' END AS kind, arg_min(p_brand, p_partkey) AS content FROM part GROUP BY 1")
def state_tables(spark, d):
    part = table(spark, d, "part")
    tables = part.select(F.col("p_name").alias("name"), F.col("p_brand").alias("content"), F.col("p_partkey").alias("pos"))
    return R.entity_or_relationship(tables, part.filter("p_partkey % 2 = 0").select(F.upper("p_name").alias("name")))


# Policies


STATED = ["level ∈ {low, \"mid\", high}", "size in [1, 9]", "rate float within [0.5, 2.5]", "tone: string (warm|cold)", "flag is boolean", "level in {other}", "tags must be an array of 1 to 3 items chosen from: red, 'blue' green"]


def policies(spark, d):
    """Conversations' whole texts as policies: the text is the global part, one section states domains."""
    section = F.concat(F.lit("<!-- TOOL: buy -->"), F.array_join(F.array(*[F.lit(s) for s in STATED]), "\n"), F.lit("<!-- TOOL_END: buy -->"))
    policy = F.concat(F.lit("<!-- POLICY_START -->"), F.coalesce("text", F.lit("")), F.lit("\nsize in [2, 4] kind ∈ {a}<!-- GLOBAL_RULES_END -->"), section)
    key = F.concat_ws(":", "conv_id", "turn", F.xxhash64("role", "text"))
    return table(spark, d, "conversations").select("conv_id", "turn", key.alias("key"), policy.alias("policy"))


@query(
    "SELECT conv_id, turn, p.param AS param, p.kind AS kind, p.v AS v, CASE WHEN p.param = 'tags' THEN '1 to 3' ELSE '' END AS counts FROM conversations, (VALUES ('level', 'enum', 'low,mid,high'), ('size', 'range', '1,9'), ('rate', 'range', '0.5,2.5'), ('tone', 'enum', 'warm,cold'), ('flag', 'boolean', ''), ('kind', 'enum', 'a'), ('tags', 'array_choice', 'red,blue,green'), ('none', NULL, NULL)) p(param, kind, v)"
)
def value_domains(spark, d):
    rows = policies(spark, d)
    wanted = rows.select("conv_id", "turn", "key", F.lit("buy").alias("tool"), F.explode(F.array(*[F.lit(p) for p in ("level", "size", "rate", "tone", "flag", "kind", "tags", "none")])).alias("param"))
    found = P.domain_for(P.policy_domains(rows, "key"), wanted.select("key", "tool", "param"), "key")
    return wanted.select("conv_id", "turn", "key", "param").join(found.drop("tool"), ["key", "param"]).select("conv_id", "turn", "param", "kind", F.array_join("values", ",").alias("v"), F.concat_ws(" to ", "least", "most").alias("counts"))


@query("SELECT conv_id, turn, true AS marked, 'buy' AS tools, length(coalesce(text, ''))::BIGINT AS n_text FROM conversations")
def policy_markers(spark, d):
    kept = P.marked_policy_for(F.col("policy"), F.array(F.lit("sell")))
    return policies(spark, d).select("conv_id", "turn", P.has_markers(F.col("policy")).alias("marked"), F.array_join(P.tool_names(F.col("policy")), ",").alias("tools"), (F.length(kept) - len("<!-- POLICY_START -->\nsize in [2, 4] kind ∈ {a}<!-- GLOBAL_RULES_END -->\n\n\n<!-- POLICY_END -->")).cast("long").alias("n_text"))


# Ledgers


def ledger(spark, d):
    """Lines of an order as its steps."""
    status = F.when(F.col("l_linestatus") == "F", "completed").when(F.col("l_returnflag") == "R", "failed").otherwise("in_progress")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("pos"), F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("name"), status.alias("status"), F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("completed_at"))
    return li.withColumn("error", F.when(F.col("status") == "failed", F.concat(F.lit("e"), "pos")))


LEDGER = "l AS (SELECT l_orderkey AS id, l_linenumber::BIGINT AS pos, 's' || l_partkey AS name, CASE WHEN l_linestatus = 'F' THEN 'completed' WHEN l_returnflag = 'R' THEN 'failed' ELSE 'in_progress' END AS status, CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS completed_at FROM lineitem)"


@query(
    f"WITH {LEDGER} SELECT id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, round(count(*) FILTER (status = 'completed') / count(*)::DOUBLE, 6) AS progress, coalesce(array_to_string((list('e' || pos ORDER BY pos, 'e' || pos) FILTER (status = 'failed'))[1:3], ','), '') AS errors FROM l GROUP BY id"
)
def workflow_status(spark, d):
    return L.workflow_status(ledger(spark, d)).withColumns({"progress": F.round("progress", 6), "errors": F.array_join("errors", ",")})


@query(f"WITH {LEDGER} SELECT id, arg_max(name, (completed_at, name)) AS name FROM l WHERE completed_at IS NOT NULL GROUP BY id")
def last_completed_step(spark, d):
    return L.last_completed(ledger(spark, d))


@query(f"WITH {LEDGER} SELECT id, pos, name, status IN ('in_progress', 'failed') AS resumable, status = 'completed' OR pos >= 5 AS done, NOT EXISTS (SELECT 1 FROM l b WHERE b.id = l.id AND b.pos < l.pos AND b.status <> 'completed') AS ready FROM l")
def resumable_steps(spark, d):
    rows = L.resumable_from(ledger(spark, d))
    return rows.select("id", "pos", "name", L.can_resume(F.col("status")).alias("resumable"), L.is_complete(F.col("status"), F.col("pos"), F.lit(5)).alias("done"), "ready")


@query(f"WITH {LEDGER} SELECT s AS status, count(id) AS n FROM (SELECT unnest(['completed', 'failed', 'in_progress', 'pending']) AS s) LEFT JOIN l ON status = s GROUP BY 1")
def status_counts(spark, d):
    return L.counts_by_status(ledger(spark, d), ["completed", "failed", "in_progress", "pending"])


@query("WITH f AS (SELECT l_orderkey AS id, l_linenumber AS pos, l_returnflag, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS lo FROM lineitem) SELECT id, count(*) AS n FROM f WHERE pos > lo AND l_returnflag <> 'R' GROUP BY 1")
def prunable_steps(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_returnflag") == "R", "cancel_order").otherwise("get_order").alias("tool"))
    return L.never_redundant(li, X.is_state_changing(F.col("tool"))).groupBy("id").agg(F.count("*").alias("n"))


@query(f"WITH {SESSIONS} SELECT len(list_distinct(t))::BIGINT AS n_domains, count(*) AS n FROM h GROUP BY 1")
def combos_by_domain_count(spark, d):
    return L.by_domain_count(session_rows(spark, d).select(F.array_distinct("trajectory").alias("domains")))


# Selection


@query("WITH s AS (SELECT c_nationkey AS n, c_custkey, count(*) OVER (PARTITION BY c_nationkey) AS k FROM customer) SELECT c_custkey, k > 1 AS has_other, true AS same_group FROM s")
def different_instances(spark, d):
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    drawn = S.same_or_different(customer, "c_custkey", ["c_nationkey"], False, 3)
    other = customer.select(F.col("c_custkey").alias("partner"), F.col("c_nationkey").alias("other"))
    return drawn.join(other, "partner", "left").select("c_custkey", F.col("partner").isNotNull().alias("has_other"), F.coalesce((F.col("other") == F.col("c_nationkey")) & (F.col("partner") != F.col("c_custkey")), F.lit(True)).alias("same_group"))


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = o_custkey % 25) AS met, true AS fits FROM orders")
def constraint_index_pick(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 25).alias("nation"))
    pool = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    found = S.met_by_constraint(orders, pool, ["nation"], "o_orderkey", "c_custkey", 5)
    check = pool.select("c_custkey", F.col("nation").alias("of"))
    return found.join(check, "c_custkey", "left").select("o_orderkey", F.col("c_custkey").isNotNull().alias("met"), F.coalesce(F.col("of") == F.col("nation"), F.lit(True)).alias("fits"))


@query("SELECT o_orderkey FROM orders o WHERE o_orderkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_orderkey % 2 = 1 AND b.o_custkey = o.o_custkey AND epoch(o.o_orderdate) < epoch(b.o_orderdate) + 2592000 AND epoch(b.o_orderdate) < epoch(o.o_orderdate) + 2592000)")
def schedule_conflicts(spark, d):
    start = F.unix_timestamp("o_orderdate").cast("double")
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", start.alias("from_s"), (start + 2592000).alias("to_s"))
    return S.without_overlap(rows.filter("o_orderkey % 2 = 0"), rows.filter("o_orderkey % 2 = 1"), ["o_custkey"], "from_s", "to_s", 2592000.0).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def fused_core_entity(spark, d):
    orders = table(spark, d, "orders").withColumn("c_custkey", F.col("o_custkey"))
    return S.fused_core({"bank": table(spark, d, "customer").filter("c_acctbal > 0"), "shop": orders.filter("o_orderstatus = 'F'"), "desk": orders.filter("o_orderstatus = 'O'")}, "c_custkey")


@query("SELECT p_partkey, true AS in_values, true AS in_range, true AS counted FROM part")
def value_draws(spark, d):
    values = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    many = S.drawn_many(values, 1, 2, "p_partkey", seed=2)
    number = S.drawn_number(3, 9, "p_partkey", seed=1)
    return table(spark, d, "part").select("p_partkey", F.array_contains(values, S.drawn(values, "p_partkey")).alias("in_values"), number.between(3, 9).alias("in_range"), (F.size(many).between(1, 2) & (F.size(F.array_except(many, values)) == 0) & (F.size(F.array_distinct(many)) == F.size(many))).alias("counted"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, 'g' || n_regionkey AS own, CASE WHEN n_regionkey % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS n_deps, (n_regionkey % 2)::BIGINT AS n_missing FROM nation")
def dependency_merge(spark, d):
    explicit = F.create_map(F.lit("own"), F.concat(F.lit("g"), F.col("n_regionkey").cast("string")))
    implicit = F.when(F.col("n_regionkey") % 2 == 0, F.create_map(F.lit("own"), F.lit("x"))).otherwise(F.create_map(F.lit("own"), F.lit("x"), F.lit("late"), F.lit("y")))
    merged = S.merged_dependencies(explicit, implicit)
    rows = table(spark, d, "nation").withColumn("m", merged)
    missing = F.when(F.col("n_regionkey") % 2 == 0, S.missing_domains(F.array(F.lit("own")), F.col("m"))).otherwise(S.missing_domains(F.array(F.lit("own"), F.lit("gone")), F.col("m")))
    return rows.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.col("m")["own"].alias("own"), F.size("m").cast("long").alias("n_deps"), F.size(missing).cast("long").alias("n_missing"))


# Transcripts


@query("SELECT conv_id, string_agg(CASE WHEN trim(coalesce(text, '')) = '' AND role <> 'assistant' THEN NULL ELSE upper(role) || ': ' || trim(concat_ws(' ', nullif(coalesce(text, ''), ''), CASE WHEN role = 'assistant' THEN '[Called: find]' END)) END, chr(10) || chr(10) ORDER BY turn, role, text) AS dialogue FROM conversations GROUP BY 1")
def judge_dialogue(spark, d):
    calls = F.when(F.col("role") == "assistant", F.array(F.lit("find"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", calls.alias("calls")))).alias("m"))
    return rows.select("conv_id", C.dialogue(F.col("m")).alias("dialogue"))


@query("SELECT conv_id, string_agg('--- ' || upper(role) || ' ---' || chr(10) || trim(CASE WHEN role = 'tool' THEN '[TOOL_RESULT for c' || turn || ']' || chr(10) ELSE '' END || coalesce(text, '')), chr(10) || chr(10) ORDER BY turn, role, text) FILTER (role = 'tool' OR trim(coalesce(text, '')) <> '') AS log FROM conversations GROUP BY 1")
def judge_log(spark, d):
    none = F.array().cast("array<string>")
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", none.alias("calls"), F.concat(F.lit("c"), "turn").alias("call_id")))).alias("m"))
    return rows.select("conv_id", C.judge_log(F.col("m")).alias("log"))


@query("SELECT conv_id, count(*)::BIGINT AS n_messages, count(*) FILTER (turn % 2 = 0 AND text IS NOT NULL)::BIGINT AS n_reasoned, 'agent' AS data_source, sha256(string_agg(role || ': ' || coalesce(text, ''), chr(30) ORDER BY turn, role, text)) AS messages FROM conversations GROUP BY 1")
def canonical_messages(spark, d):
    null = F.lit(None).cast("string")
    message = F.struct(F.col("role"), F.col("text").alias("content"), F.col("text").alias("reasoning_content"), null.alias("tool_calls"), null.alias("tool_call_id"), F.col("turn"))
    held = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", message.alias("m")))), lambda x: x["m"])
    # Reasoning goes from messages of odd turns.
    kept = F.transform(F.arrays_zip(F.col("messages").alias("all"), C.without_reasoning(F.col("messages")).alias("bare")), lambda x: F.when(x["all"]["turn"] % 2 == 0, x["all"]).otherwise(x["bare"]))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(held.alias("messages")).select(F.col("conv_id").cast("string").alias("id"), kept.alias("messages"))
    made = C.canonical(rows, "agent", False)
    return made.select(F.col("id").cast("long").alias("conv_id"), F.size("messages").cast("long").alias("n_messages"), F.size(F.filter("messages", lambda m: m["reasoning_content"].isNotNull())).cast("long").alias("n_reasoned"), "data_source", F.sha2(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\x1e"), 256).alias("messages"))


# Names and identities


@query(
    "WITH n AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k FROM part) SELECT p_partkey, CASE WHEN k = 0 THEN p_brand WHEN p_brand || k IN (SELECT p_brand FROM part) THEN regexp_replace(p_brand || k, '([0-9]+)$', '_\\1') ELSE p_brand || k END AS name FROM n"
)
def unique_names(spark, d):
    return L.unique_names(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", ["p_partkey"]).select("p_partkey", F.col("unique").alias("name"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'order_id' ELSE 'id' END || ',' || CASE p_partkey % 3 WHEN 0 THEN 'note' ELSE 'order_id' END AS keys, CASE WHEN p_partkey % 2 = 0 THEN 'Order' END AS entity, 'a_b,c' AS domains FROM part")
def name_fixes(spark, d):
    other = F.when(F.col("p_partkey") % 3 == 0, "note").otherwise("id")
    attributes = F.when(F.col("p_partkey") % 3 == 0, F.create_map(F.lit("order_id"), F.lit("1"), other, F.lit("2"))).otherwise(F.create_map(F.lit("wrong_id"), F.lit("1"), other, F.lit("2")))
    keys = F.array_sort(F.map_keys(X.with_entity_id(attributes, F.lit("Order"))))
    shown = F.when(F.col("p_partkey") % 3 == 0, F.array_join(F.reverse(keys), ",")).otherwise(F.array_join(keys, ","))
    source = F.when(F.col("p_partkey") % 2 == 0, "Order.order_id").otherwise("system_clock.now")
    known = X.known_domains(F.lit("a_b_x_c"), F.array(F.lit("a"), F.lit("a_b"), F.lit("c")))
    return table(spark, d, "part").select("p_partkey", shown.alias("keys"), X.source_entity(source).alias("entity"), F.array_join(known, ",").alias("domains"))


@query("SELECT doc_id, 'order.id:-,pays.date:bank' AS found FROM documents")
def explicit_placeholders(spark, d):
    text = F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), "[<>]", ""), F.lit(" <order.id> and <bank.pays.date> and <order.id> <x>"))
    found = F.transform(X.explicit_placeholders(text), lambda x: F.concat(x["name"], F.lit("."), x["field"], F.lit(":"), F.coalesce(x["domain"], F.lit("-"))))
    return table(spark, d, "documents").select("doc_id", F.array_join(found, ",").alias("found"))


@query(
    "WITH f AS (SELECT conv_id, arg_min(text, (turn, text)) FILTER (role = 'user' AND text IS NOT NULL) AS u FROM conversations GROUP BY 1) SELECT conv_id, md5(coalesce(u, '') || 'a,b') AS sample_id, 'srv_' || substr(md5('t' || conv_id), 1, 8) || '_' || substr(md5('c' || conv_id), 1, 8) AS task_id, "
    "substr(md5('{\"entity_context\": {\"k\": ' || conv_id || '}, \"trajectory_hash\": \"h' || conv_id || '\"}'), 1, 12) AS context_id, substr(md5('r' || conv_id), 1, 8) AS query_id FROM f"
)
def identities(spark, d):
    user = F.when((F.col("role") == "user") & F.col("text").isNotNull(), F.struct("turn", "text"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.min(user)["text"].alias("u"))
    n = F.col("conv_id").cast("string")
    tag = lambda x: F.concat(F.lit(x), n)
    return rows.select("conv_id", sample_id(F.col("u"), F.array(F.lit("b"), F.lit("a"))).alias("sample_id"), task_id(F.lit("srv"), tag("t"), tag("c")).alias("task_id"), context_id(tag("h"), F.concat(F.lit('{"k": '), n, F.lit("}"))).alias("context_id"), query_id(tag("r")).alias("query_id"))


@query("SELECT event_type, CASE WHEN event_type IN ('signup', 'purchase') THEN event_type = 'signup' ELSE false END AS changing, event_type = 'error' AS recoverable FROM (SELECT DISTINCT event_type FROM events)")
def tool_kinds(spark, d):
    rows = table(spark, d, "events").select("event_type").distinct()
    tool = F.when(F.col("event_type") == "signup", "Register_user").otherwise(F.concat(F.lit("get_"), "event_type"))
    return rows.select("event_type", X.is_state_changing(tool).alias("changing"), X.is_recoverable(F.when(F.col("event_type") == "error", "HTTP 503").otherwise("bad input")).alias("recoverable"))


# Graphs, joins and reports


@query("SELECT DISTINCT 'Person' AS source, p_type AS target FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_partkey % 2 = 0)")
def person_edges(spark, d):
    part = table(spark, d, "part")
    core = F.when(F.max((F.col("p_partkey") % 2 == 0).cast("int")) == 1, "Person").otherwise("Thing")
    blueprints = part.groupBy("p_brand").agg(core.alias("core_entity"), F.collect_set("p_type").alias("peripheral_entities"))
    edges = G.entity_edges(blueprints)
    return edges.join(G.entities_of(edges).withColumnRenamed("entity", "target"), "target", "left_semi").select("source", "target")


@query("WITH n AS (SELECT DISTINCT event_type AS node FROM events) SELECT node, true AS kept FROM n WHERE node <> 'ghost' UNION ALL SELECT 'extra', true")
def tool_graph_nodes(spark, d):
    names = table(spark, d, "events").select(F.col("event_type").alias("node")).distinct()
    functions = names.select(F.col("node").alias("name")).unionByName(spark.createDataFrame([("extra",)], "name string"))
    nodes = names.unionByName(spark.createDataFrame([("ghost",)], "node string"))
    links = names.select(F.col("node").alias("source"), F.lit("ghost").alias("target"))
    kept, left = G.tool_graph(nodes, links, functions)
    return kept.join(left.select(F.col("source").alias("node"), F.lit(True).alias("linked")), "node", "left").select("node", F.col("linked").isNull().alias("kept"))


@query("SELECT c_custkey, coalesce(n_regionkey, -1) AS group_id FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 2 = 0")
def abbreviation_groups(spark, d):
    groups = table(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.lower("n_name").alias("member"), F.col("n_regionkey").alias("group_id"))
    value = F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))
    return M.equivalents(groups, table(spark, d, "customer").select("c_custkey", value.alias("value"))).select("c_custkey", F.coalesce("group_id", F.lit(-1)).alias("group_id"))


@query(f"WITH {SESSIONS}, e AS (SELECT user_id, unnest(list_distinct(t)) AS tool FROM h) SELECT user_id AS id, tool, CASE tool WHEN 'view' THEN 'a,z' ELSE '' END AS params FROM e")
def trajectory_parameters(spark, d):
    tools = spark.range(1).select(F.lit("view").alias("name"), F.create_map(F.lit("z"), F.lit("1"), F.lit("a"), F.lit("2")).alias("parameters"))
    found = M.parameter_names(session_rows(spark, d).select(F.col("user_id").alias("id"), "trajectory"), tools)
    return found.withColumn("params", F.array_join("params", ","))


@query(f"WITH {SESSIONS} SELECT user_id FROM h WHERE list_sort(list_distinct(t)) = ['click', 'view']")
def combos_of_domains(spark, d):
    rows = session_rows(spark, d).select("user_id", F.col("trajectory").alias("domains"))
    wanted = spark.createDataFrame([(["view", "click"],)], "domains array<string>")
    return M.combos_of_domains(rows, wanted).select("user_id")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'kept' ELSE 'made' END AS assertion FROM customer")
def assertion_upsert(spark, d):
    customer = table(spark, d, "customer")
    own = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("kept"))).otherwise(F.array().cast("array<string>"))
    tasks = customer.select(F.col("c_custkey").alias("id"), own.alias("assertions"))
    made = customer.select(F.col("c_custkey").alias("id"), F.array(F.lit("made")).alias("assertions"))
    return sinks.new_assertions(tasks, made).select("id", F.col("assertions")[0].alias("assertion"))


@query("SELECT n_name AS server, coalesce(list_sort(list_distinct(list(p_type))), [])[1] AS tool FROM nation LEFT JOIN part ON p_size = n_nationkey AND n_nationkey > 5 GROUP BY 1")
def tool_lists(spark, d):
    nation = table(spark, d, "nation")
    servers = nation.select(F.col("n_name").alias("server"))
    tools = nation.filter("n_nationkey > 5").join(table(spark, d, "part"), F.col("p_size") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("server")).agg(F.array_sort(F.collect_set("p_type")).alias("tools"))
    return readers.tools_of(servers, tools).select("server", F.get("tools", F.lit(0)).alias("tool"))


@query("SELECT r_name AS server, string_agg(n_name || '!', chr(10) || chr(10) ORDER BY n_name) AS summary FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def server_summaries(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    wanted = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("server"), F.col("n_name").alias("name"))
    return readers.summaries(wanted, nation.select(F.col("n_name").alias("name"), F.concat("n_name", F.lit("!")).alias("text")))


@query(f"WITH {SESSIONS} SELECT user_id AS pos, unnest(list_filter(['view', 'purchase', 'signup', 'ghost'], lambda x: NOT list_contains(t[1:3], x))) AS missing FROM h")
def context_keys(spark, d):
    rows = session_rows(spark, d).select(F.col("user_id").alias("pos"), F.explode(L.undone(F.array(*[F.lit(x) for x in ("view.id", "purchase.x", "signup", "ghost.id", "step_3_result")]), F.slice("trajectory", 1, 3))).alias("missing"))
    return rows

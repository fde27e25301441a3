"""Queries over constraint texts, tolerant JSON, prefix trees, unique names and policies without markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import constraints as K
from weftline.functions import hashing
from weftline.functions import lenient_json as J
from weftline.operators import assertions, naming, policies, pruning, renames
from weftline.queries import query
from weftline.session import table

# Constraints as text. SQL states the same predicates; some rows meet none of them.

CONSTRAINTS = {
    "open": "o_orderstatus = O",
    "urgent": "o_orderpriority IN ('1-URGENT', '2-HIGH') AND NOT o_orderstatus = 'F'",
    "dear": "o_totalprice >= 200000 or o_totalprice between 1000 and 20000.5",
    "early": "o_orderdate < '1995-03-01' and (o_custkey <= 40 or o_custkey > 900)",
    "unknown": "o_orderpriority is null or o_orderpriority = '4-NOT SPECIFIED'",
    "known": "not (o_orderpriority is not null and o_orderkey <> 7)",
    "quoted": "o_orderpriority = 'it''s' or o_orderstatus not in (F, O, \"P\")",
}


@query(
    "SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus = 'O' THEN 'open' END, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND NOT o_orderstatus = 'F' THEN 'urgent' END, "
    "CASE WHEN o_totalprice >= 200000 OR o_totalprice BETWEEN 1000 AND 20000.5 THEN 'dear' END, CASE WHEN o_orderdate < TIMESTAMP '1995-03-01' AND (o_custkey <= 40 OR o_custkey > 900) THEN 'early' END, "
    "CASE WHEN o_orderpriority IS NULL OR o_orderpriority = '4-NOT SPECIFIED' THEN 'unknown' END, CASE WHEN NOT (o_orderpriority IS NOT NULL AND o_orderkey <> 7) THEN 'known' END, "
    "CASE WHEN o_orderpriority = 'it''s' OR o_orderstatus NOT IN ('F', 'O', 'P') THEN 'quoted' END) AS met FROM (SELECT * REPLACE (CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority) FROM orders)"
)
def constraint_texts(spark, d):
    rows = table(spark, d, "orders").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")))
    return K.constraints_met(rows, CONSTRAINTS).select("o_orderkey", F.array_join("met", ",").alias("met"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 500 AND c_nationkey IN (1, 2, 3, 7)")
def filter_by_constraints(spark, d):
    return K.filter_by_constraints(table(spark, d, "customer"), ["c_mktsegment = BUILDING", "c_acctbal >= 500", "c_nationkey IN (1, 2, 3, 7)"]).select("c_custkey")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'filters' ELSE 'joins,filters' END AS lacking FROM part")
def constraint_analysis_keys(spark, d):
    value = lambda name, there: F.when(there, F.lit(name))
    n = F.col("p_partkey") % 3
    analysis = F.when(n == 2, F.create_map(F.lit("core"), F.lit("c"))).otherwise(F.create_map(F.lit("core"), F.lit("c"), F.lit("joins"), F.lit("j"), F.lit("filters"), value("f", n == 0)))
    return table(spark, d, "part").select("p_partkey", F.array_join(K.lacking_keys(analysis, ["core", "joins", "filters"]), ",").alias("lacking"))


# JSON


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n, CASE WHEN n = 6 THEN NULL ELSE l_quantity END AS quantity, CASE WHEN n = 6 THEN NULL ELSE l_returnflag END AS flag, CASE WHEN n IN (0, 3, 4, 5) THEN false WHEN n = 6 THEN false ELSE true END AS repaired "
    "FROM (SELECT *, (l_orderkey + l_linenumber) % 8 AS n FROM lineitem)"
)
def model_json(spark, d):
    """Answers that hold a line's quantity and flag, as JSON of eight kinds of care."""
    li = table(spark, d, "lineitem").withColumn("n", (F.col("l_orderkey") + F.col("l_linenumber")) % 8)
    q, f = F.col("l_quantity").cast("string"), F.col("l_returnflag")
    lit = F.lit
    forms = [
        F.concat(lit('{"q": '), q, lit(', "in": {"f": "'), f, lit('"}}')),
        F.concat(lit("{q: "), q, lit(", // how many\n in: {'f': '"), f, lit("',},}")),
        F.concat(lit("Here you are:\n```json\n{\"q\": "), q, lit(',\n"in": {"f": "'), f, lit('"},}\n```\nDone.')),
        F.concat(lit("```\n{\"q\": "), q, lit(', "in": {"f": "'), f, lit('"}}\n```')),
        F.concat(lit('The answer is {"q": '), q, lit(', "in": {"f": "'), f, lit('"}} as asked.')),
        F.concat(lit('{"in": {"f": "'), f, lit('", "none": null}, "q": '), q, lit("}")),
        lit("I can't answer that."),
        F.concat(lit('{"q": '), q, lit(' /* all */, "in": {"f": "'), f, lit('"')),
    ]
    text = F.get(F.array(*forms), F.col("n").cast("int"))
    found = J.parsed_json(li.withColumn("answer", text), "answer")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "n", F.try_variant_get("json", "$.q", "double").alias("quantity"), F.try_variant_get("json", "$.in.f", "string").alias("flag"), "repaired")


@query(
    "SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE json_extract_string(props, '$.k')::BIGINT END AS k, CASE event_id % 4 WHEN 3 THEN 'Invalid JSON in tool call' ELSE '' END AS error FROM events WHERE event_id % 4 <> 3 "
    "UNION ALL SELECT event_id, -1 AS k, 'Invalid JSON in tool call' AS error FROM events WHERE event_id % 4 = 3"
)
def strict_arguments(spark, d):
    n = F.col("event_id") % 4
    quoted = F.replace("props", F.lit('"'), F.lit('\\"'))
    call = F.when(n == 0, F.col("props")).when(n == 1, F.concat(F.lit('{"name": "t", "arguments": '), "props", F.lit("}"))).when(n == 2, F.concat(F.lit('{"arguments": "'), quoted, F.lit('"}'))).otherwise(F.concat(F.lit('{"arguments": "'), quoted, F.lit(',"}')))
    rows = table(spark, d, "events").select("event_id", J.call_arguments(call).alias("c"))
    return rows.select("event_id", F.coalesce(F.try_variant_get("c.arguments", "$.k", "long"), F.lit(-1)).alias("k"), F.coalesce("c.error", F.lit("")).alias("error"))


# Prefix trees

STEPS = "s AS (SELECT user_id // 8 AS task, event_type, event_id, row_number() OVER w AS pos FROM events WINDOW w AS (PARTITION BY user_id // 8 ORDER BY ts, event_id)), p AS (SELECT *, list(event_type) OVER (PARTITION BY task ORDER BY pos ROWS UNBOUNDED PRECEDING) AS prefix FROM (SELECT * REPLACE ((pos - 1) // 5 * 1000000 + task AS task, ((pos - 1) % 5 + 1)::BIGINT AS pos) FROM s))"


def short_trajectories(spark, d) -> DataFrame:
    """Runs of five events as trajectories: many begin alike."""
    place = F.row_number().over(Window.partitionBy(F.floor(F.col("user_id") / 8)).orderBy("ts", "event_id"))
    rows = table(spark, d, "events").select(F.floor(F.col("user_id") / 8).alias("g"), "event_type", "event_id", (place - 1).cast("long").alias("at"))
    return rows.select((F.floor(F.col("at") / 5) * 1000000 + F.col("g")).alias("task"), (F.col("at") % 5 + 1).alias("pos"), "event_type", "event_id")


CHANGING = "event_type IN ('purchase', 'signup')"


@query(
    f"WITH {STEPS} SELECT event_id, NOT {CHANGING} AND list_position(list_slice(prefix, 1, pos - 1), event_type) IS NOT NULL AND pos > 1 AS redundant, "
    f"CASE WHEN {CHANGING} THEN 'state-changing' WHEN pos = 1 THEN 'first' WHEN list_position(list_slice(prefix, 1, pos - 1), event_type) IS NOT NULL THEN 'repeated' ELSE 'needed' END AS reason FROM p"
)
def redundant_steps(spark, d):
    steps = short_trajectories(spark, d)
    args = ["task"], ["pos"], ["event_type"]
    found, _ = pruning.judged(steps, *args, pruning.repeats(steps, *args), changing=F.expr(CHANGING))
    return found.select("event_id", "redundant", "reason")


@query(f"WITH {STEPS} SELECT pos, count(DISTINCT prefix) FILTER (NOT {CHANGING} AND pos > 1 AND NOT (prefix[1] = 'click' AND pos = 2)) AS judged, count(*) AS steps FROM p GROUP BY pos")
def judged_prefixes(spark, d):
    """How many prefixes a judge sees by depth, when those of a click and one step more are in its cache."""
    steps = short_trajectories(spark, d)
    args = ["task"], ["pos"], ["event_type"]
    judge = pruning.repeats(steps, *args)
    first = F.first("event_type").over(Window.partitionBy("task").orderBy("pos"))
    cached = pruning.with_nodes(steps.withColumn("begin", first), *args).filter("pos = 2 AND begin = 'click'").select("node").distinct().select("node", F.lit(False).alias("redundant"), F.lit("cached").alias("reason"))
    _, verdicts = pruning.judged(steps, *args, judge, cache=cached, changing=F.expr(CHANGING))
    n = verdicts.filter("reason <> 'cached'").groupBy((F.col("node.depth") + 1).alias("pos")).agg(F.count("*").alias("judged"))
    return steps.groupBy("pos").agg(F.count("*").alias("steps")).join(n, "pos", "left").select("pos", F.coalesce("judged", F.lit(0)).alias("judged"), "steps")


@query(f"WITH {STEPS}, r AS (SELECT task, pos, event_type, pos > 1 AND NOT {CHANGING} AND list_position(list_slice(prefix, 1, pos - 1), event_type) IS NOT NULL AS redundant FROM p) SELECT task, count(*) AS original, count(*) FILTER (NOT redundant) AS pruned, array_to_string(list(event_type ORDER BY pos) FILTER (NOT redundant), ',') AS kept, round(count(*) FILTER (redundant) / count(*)::DOUBLE, 6) AS ratio FROM r GROUP BY task")
def pruned_trajectories(spark, d):
    steps = short_trajectories(spark, d)
    args = ["task"], ["pos"], ["event_type"]
    found, _ = pruning.judged(steps, *args, pruning.repeats(steps, *args), changing=F.expr(CHANGING))
    return pruning.pruned(found, ["task"], "event_type").withColumn("kept", F.array_join("kept", ","))


# Names


SUFFIXES = ["", "1", "", "", "11", "1", "1", "2", "", "12", "", "1", "21", "2", "", "1"]


@query(
    f"WITH RECURSIVE o AS (SELECT p_partkey, p_partkey // 16 AS f, row_number() OVER (PARTITION BY p_partkey // 16 ORDER BY p_partkey) AS place, 't' || p_partkey // 16 || 'x' || {SUFFIXES}[p_partkey % 16 + 1] AS n FROM part), "
    "r AS (SELECT f, 0::BIGINT AS place, NULL::BIGINT AS p_partkey, NULL::VARCHAR AS name, CAST([] AS VARCHAR[]) AS seen FROM o GROUP BY f UNION ALL "
    "SELECT f, place, p_partkey, name, list_append(seen, name) FROM (SELECT r.f, o.place, o.p_partkey, seen, list_filter(list_concat([n], list_transform(range(1, 40), lambda i: n || i)), lambda c: NOT list_contains(seen, c))[1] AS name FROM r JOIN o ON o.f = r.f AND o.place = r.place + 1)) "
    "SELECT p_partkey, name FROM r WHERE name IS NOT NULL"
)
def colliding_names(spark, d):
    """Families of names that collide with their own numbers; SQL gives them one after the other."""
    suffix = F.get(F.array(*[F.lit(x) for x in SUFFIXES]), (F.col("p_partkey") % 16).cast("int"))
    name = F.concat(F.lit("t"), F.floor(F.col("p_partkey") / 16).cast("string"), F.lit("x"), suffix)
    return naming.unique_names(table(spark, d, "part").select("p_partkey", name.alias("n")), "n", ["p_partkey"]).select("p_partkey", F.col("unique").alias("name"))


# Policies without markers


@query(
    "WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '(^|\\n)\\s*(###?|\\d+\\)|\\w+\\s*\\n\\s*[-=]+\\s*(\\n|$))') AND NOT contains(coalesce(text, ''), '<!-- TOOL:') AND NOT contains(coalesce(text, ''), '<!-- POLICY_START -->') AND NOT contains(coalesce(text, ''), chr(13)) AND regexp_matches(coalesce(text, ''), '[^\\s]')) "
    "SELECT doc_id, '_global' AS tool, trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS content FROM d "
    "UNION ALL SELECT doc_id, 'buy' AS tool, CASE WHEN doc_id % 2 = 0 THEN '### Tool: Buy' ELSE '1) Buy' END || chr(10) || '- pays ' || lang AS content FROM d UNION ALL SELECT doc_id, 'view' AS tool, 'view' || chr(10) || '----' || chr(10) || 'shows all' AS content FROM d"
)
def policies_without_markers(spark, d):
    """Documents without anything like a header as rules, with sections of two tools and of something else below."""
    plain = ~F.col("text").rlike(r"(^|\n)\s*(###?|\d+\)|\w+\s*\n\s*[-=]+\s*(\n|$))") & ~F.contains("text", F.lit("<!-- TOOL:")) & ~F.contains("text", F.lit("<!-- POLICY_START -->")) & ~F.contains("text", F.lit("\r")) & F.col("text").rlike(r"\S")
    docs = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit(""))).filter(plain)
    head = F.when(F.col("doc_id") % 2 == 0, F.lit("### Tool: Buy")).otherwise(F.lit("1) Buy"))
    text = F.concat("text", F.lit("\n"), head, F.lit("\n- pays "), "lang", F.lit("\n\n## Appendix\nnothing\n\nview\n----\nshows all\n"))
    tools = spark.createDataFrame([("buy",), ("view",)], "name string")
    return policies.sections(docs.select("doc_id", text.alias("policy")), ["doc_id"], "policy", tools).select("doc_id", "tool", "content")


@query("SELECT doc_id, f AS field, CASE f WHEN 'Preconditions' THEN 'signed in;' || lang ELSE 'paid' END AS items FROM documents, (SELECT unnest(['Preconditions', 'Effects']) AS f) WHERE f <> 'Effects' OR doc_id % 3 = 0")
def policy_lists(spark, d):
    body = F.concat(F.lit("Purpose: sell\n**Preconditions**:\n- signed in\n  • "), "lang", F.lit("\nDependencies: none\n- not listed under a name\n"), F.when(F.col("doc_id") % 3 == 0, F.lit("Effects\n- paid\ntext\n- no item\nEffects:\n- a second list")).otherwise(F.lit("Effects: paid")))
    rows = table(spark, d, "documents").select("doc_id", body.alias("content"))
    return policies.list_fields(rows, ["doc_id"], "content", ["Preconditions", "Effects"]).select("doc_id", "field", F.array_join("items", ";").alias("items"))


@query("SELECT DISTINCT n_name AS name, CASE WHEN n_nationkey % 4 = 3 THEN 'nationre' ELSE 'nr' END || CASE WHEN n_nationkey % 4 = 3 THEN CASE WHEN k = 0 THEN '' ELSE k::VARCHAR END WHEN k = 0 THEN '' ELSE k::VARCHAR END AS abbreviation FROM (SELECT n_name, n_nationkey, row_number() OVER (PARTITION BY n_nationkey % 4 = 3 ORDER BY CASE WHEN n_nationkey % 4 = 3 THEN 'nationregistry' ELSE 'NationRegistry' END || chr(97 + n_nationkey)) - 1 AS k FROM nation)")
def server_abbreviations(spark, d):
    """Initials of servers, with numbers where they collide."""
    letter = F.char(F.col("n_nationkey") + 97)
    server = F.when(F.col("n_nationkey") % 4 == 3, F.concat(F.lit("nationregistry"), letter)).otherwise(F.concat(F.lit("NationRegistry"), letter))
    rows = table(spark, d, "nation").select("n_name", server.alias("server"))
    return naming.abbreviations(rows, "server").join(rows, "server").select(F.col("n_name").alias("name"), "abbreviation")


# Renamed keys and assertions


@query(
    "WITH p AS (SELECT p_partkey, p_partkey % 4 AS n, p_brand, p_name FROM part), "
    "m AS (SELECT p_partkey, unnest(CASE n WHEN 0 THEN ['Part_id', 'session_id'] WHEN 1 THEN ['supplier'] WHEN 2 THEN ['PART_ID', 'part_id'] ELSE ['plain'] END) AS before, n FROM p) "
    "SELECT p_partkey, before, CASE before WHEN 'session_id' THEN 'param_session_id' WHEN 'supplier' THEN 'supplier_id' ELSE 'part_id' END AS after, "
    "CASE before WHEN 'session_id' THEN 'session' WHEN 'supplier' THEN 'value source' ELSE 'id format' END AS rule, n <> 2 AS applied FROM m WHERE before NOT IN ('plain', 'part_id')"
)
def rename_log(spark, d):
    return renamed_parts(spark, d)[1]


@query(
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'param_session_id=' || p_name || ',part_id=' || p_brand WHEN 1 THEN 'supplier_id=Supplier.key' WHEN 2 THEN 'PART_ID=' || p_brand || ',part_id=' || p_name ELSE 'plain=' || p_name END AS attributes FROM part"
)
def renamed_keys(spark, d):
    entries = F.array_sort(F.transform(F.map_entries("attributes"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return renamed_parts(spark, d)[0].select("p_partkey", F.array_join(entries, ",").alias("attributes"))


def renamed_parts(spark, d) -> tuple[DataFrame, DataFrame]:
    entities = F.array(F.lit("Part"), F.lit("Supplier"))
    a, b = F.col("p_brand"), F.col("p_name")
    maps = [F.create_map(F.lit("Part_id"), a, F.lit("session_id"), b), F.create_map(F.lit("supplier"), F.lit("Supplier.key")), F.create_map(F.lit("PART_ID"), a, F.lit("part_id"), b), F.create_map(F.lit("plain"), b)]
    rows = table(spark, d, "part").select("p_partkey", F.get(F.array(*maps), (F.col("p_partkey") % 4).cast("int")).alias("attributes"))
    return renames.renamed(rows, ["p_partkey"], "attributes", [renames.session_rule(), renames.source_rule(entities), renames.id_rule(entities)])


@query(
    "SELECT 'unique orders(o_orderkey)' AS name, 'passed' AS verdict, 0::BIGINT AS n UNION ALL "
    "SELECT 'unique lineitem(l_orderkey, l_linenumber)', CASE WHEN count(*) = 0 THEN 'passed' ELSE 'failed' END, count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1) UNION ALL "
    "SELECT 'references lineitem.l_orderkey', CASE WHEN count(*) = 0 THEN 'passed' ELSE 'failed' END, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') UNION ALL "
    "SELECT 'monotone orders.o_orderdate', CASE WHEN count(*) = 0 THEN 'passed' ELSE 'failed' END, count(*) FROM (SELECT o_orderdate < lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS falls FROM orders WHERE o_orderstatus <> 'F') WHERE falls UNION ALL "
    "SELECT 'holds lineitem: l_quantity >= 1', CASE WHEN count(*) = 0 THEN 'passed' ELSE 'failed' END, count(*) FROM lineitem WHERE NOT coalesce(l_quantity >= 1, false) UNION ALL "
    "SELECT 'kept orders.o_orderkey', CASE WHEN count(*) = 0 THEN 'passed' ELSE 'failed' END, count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL "
    "SELECT 'unique ghost(id)', 'skipped', 0::BIGINT"
)
def state_assertions(spark, d):
    """The actual state lacks the orders that are finished."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    told = [
        assertions.unique("orders", "o_orderkey"),
        assertions.unique("lineitem", "l_orderkey", "l_linenumber"),
        assertions.references("lineitem", "l_orderkey", "orders", "o_orderkey"),
        assertions.monotone("orders", ["o_custkey"], ["o_orderkey"], "o_orderdate"),
        assertions.holds("lineitem", "l_quantity >= 1"),
        assertions.kept("orders", "o_orderkey"),
        assertions.unique("ghost", "id"),
    ]
    found = assertions.asserted(spark, told, {"orders": orders}, {"orders": orders.filter("o_orderstatus <> 'F'"), "lineitem": lines})
    verdict = F.when(F.col("skipped"), "skipped").when(F.col("passed"), "passed").otherwise("failed")
    return found.select("name", verdict.alias("verdict"), F.col("n_offenders").alias("n"))


# Identities of nested documents


@query(
    """WITH r AS (SELECT l_shipdate, l_linestatus AS s, '{"a":{"f":"' || l_returnflag || '","q":' || l_quantity::BIGINT || '},"n":[' || l_linenumber || ',null,true],"z":1.5}' AS j FROM lineitem),
    d AS (SELECT strftime(l_shipdate, '%Y') AS year, s, md5(j) AS h FROM r)
    SELECT year, s AS status, count(*) AS n, md5(count(*) || ':' || sum(('0x' || substr(h, 1, 15))::BIGINT::HUGEINT) || ':' || sum(('0x' || substr(h, 16, 15))::BIGINT::HUGEINT)) AS digest FROM d GROUP BY ALL"""
)
def nested_digests(spark, d):
    """Lines as nested records whose keys, numbers and white space are written in two ways."""
    li = table(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("long").cast("string"))
    odd = F.concat(F.lit('{"z": 15e-1, "n": ['), "l_linenumber", F.lit(', null,true], "a":{ "q":'), "q", F.lit('.0, "f": "'), "l_returnflag", F.lit('"}}'))
    even = F.concat(F.lit('{"a":{"f":"'), "l_returnflag", F.lit('","q":'), "q", F.lit('},"n":['), "l_linenumber", F.lit(',null,true],"z":1.50}'))
    rows = li.select(F.date_format("l_shipdate", "yyyy").alias("year"), F.col("l_linestatus").alias("status"), F.when(F.col("l_linenumber") % 2 == 1, odd).otherwise(even).alias("record"))
    return hashing.nested_digests(rows, ["year", "status"], "record")

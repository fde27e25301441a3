"""The library's operators over the driver's tables, with DuckDB SQL for the same results.

Roles: events are tool calls (user_id the session, event_type the tool, props JSON arguments),
orders and lineitem relationships, customer, supplier, part, nation and region entities,
conversations messages, labels judge scores. Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.functions.hashing import record_hash, shard_prefix, trajectory_hash
from weftline.functions.values import leaf_values, mismatched_keys, normalised, values_match
from weftline.operators import conversations as C
from weftline.operators import graph as G
from weftline.operators import matching as M
from weftline.operators import models, reports
from weftline.operators import selection as S
from weftline.operators import state as D
from weftline.operators import tools
from weftline.operators import trajectories as TR
from weftline.plans.sampling import Plan, Requirement, run_plan
from weftline.session import table
from weftline.sources import readers
from weftline.sources.sinks import first_wins, upserted
from weftline.streaming import sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def calls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")


def session_rows(spark: SparkSession, d: str) -> DataFrame:
    return TR.from_calls(calls(spark, d), "user_id", "event_type", ["ts", "event_id"])


SESSIONS = "s AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS t FROM events GROUP BY 1), h AS (SELECT user_id, t, substr(md5(array_to_string(t, '_')), 1, 12) AS trajectory_hash FROM s)"


# Hashes, groups, sequences


@query(f"WITH {SESSIONS} SELECT user_id, len(t)::BIGINT AS n_calls, trajectory_hash FROM h")
def trajectory_hash_by_session(spark, d):
    return session_rows(spark, d).select("user_id", F.size("trajectory").cast("long").alias("n_calls"), "trajectory_hash")


@query(f"WITH {SESSIONS} SELECT trajectory_hash, min(user_id) AS first_id, count(*) AS n_sessions FROM h GROUP BY trajectory_hash, t")
def trajectory_groups(spark, d):
    return TR.groups(session_rows(spark, d), "user_id").select("trajectory_hash", "first_id", "n_sessions")


@query(f"WITH {SESSIONS} SELECT count(*) AS n_sessions, count(DISTINCT trajectory_hash) AS n_trajectories, min(len(t))::BIGINT AS min_length, max(len(t))::BIGINT AS max_length, sum(len(t))::BIGINT AS total_length FROM h")
def trajectory_stats(spark, d):
    return TR.stats(session_rows(spark, d))


@query(
    "WITH e AS (SELECT user_id, event_type, row_number() OVER w AS p, count_if(event_type = 'view') OVER w AS v, count_if(event_type = 'click') OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) "
    "SELECT user_id, bool_and(CASE event_type WHEN 'purchase' THEN v > 0 AND c > 0 WHEN 'click' THEN v > 0 ELSE true END) AS valid FROM e GROUP BY 1"
)
def precondition_valid_sessions(spark, d):
    needs = {"purchase": ["view", "click"], "click": ["view"]}
    return session_rows(spark, d).select("user_id", TR.meets_preconditions(F.col("trajectory"), needs).alias("valid"))


@query(
    "WITH e AS (SELECT user_id, ts, event_id, (event_type = 'signup' AND row_number() OVER w > 1)::INT AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "g AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM e) SELECT user_id, segment::BIGINT AS segment, count(*) AS n FROM g GROUP BY ALL"
)
def auth_segments(spark, d):
    return TR.segments(calls(spark, d), "user_id", ["ts", "event_id"], F.col("event_type") == "signup").groupBy("user_id", "segment").agg(F.count("*").alias("n"))


@query(f"WITH {SESSIONS}, v AS (SELECT DISTINCT trajectory_hash FROM h WHERE user_id % 2 = 0) SELECT user_id AS id, trajectory_hash IN (SELECT trajectory_hash FROM v) AS feasible FROM h")
def cross_domain_feasible(spark, d):
    rows = session_rows(spark, d).select(F.col("user_id").alias("id"), F.lit("s").alias("server"), F.col("trajectory_hash").alias("segment_hash"))
    return TR.feasible(rows, rows.filter("id % 2 = 0"))


@query(f"WITH {SESSIONS} SELECT user_id, array_to_string(list_filter(t, lambda x, i: i NOT IN (2, 4)), ',') AS kept FROM h")
def pruned_steps(spark, d):
    return session_rows(spark, d).select("user_id", F.array_join(TR.kept_steps(F.col("trajectory"), F.array(F.lit(1), F.lit(3))), ",").alias("kept"))


@query(
    "WITH r AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1), l AS (SELECT *, lag(failed) OVER (ORDER BY day) AS p FROM r) "
    "SELECT day, failed, round(CASE WHEN p > 0 THEN (p - failed) / p::DOUBLE END, 6) AS rate, coalesce(CASE WHEN p > 0 THEN (p - failed) / p::DOUBLE END < 0.2, false) AS stop FROM l"
)
def convergence_rounds(spark, d):
    rounds = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("failed"))
    return TR.convergence(rounds, "day", "failed", 0.2).withColumn("rate", F.round("rate", 6))


@query(f"WITH {SESSIONS} SELECT user_id, list_contains(t, 'error') AS has_error, coalesce(list_position(t, 'error'), 0)::BIGINT AS first_error FROM h")
def first_failed_step(spark, d):
    return session_rows(spark, d).select("user_id", F.array_contains("trajectory", "error").alias("has_error"), F.array_position("trajectory", "error").cast("long").alias("first_error"))


# Graphs


@query(
    "WITH RECURSIVE t AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, event_type AS b FROM events), "
    "e AS (SELECT a, b FROM t WHERE a IS NOT NULL AND a <> b GROUP BY a, b), n AS (SELECT a AS x FROM e UNION SELECT b FROM e), "
    "st AS (SELECT x FROM n WHERE x NOT IN (SELECT b FROM e) UNION ALL SELECT x FROM n WHERE NOT EXISTS (SELECT 1 FROM n m WHERE m.x NOT IN (SELECT b FROM e))), "
    "en AS (SELECT x FROM n WHERE x NOT IN (SELECT a FROM e) UNION ALL SELECT x FROM n WHERE NOT EXISTS (SELECT 1 FROM n m WHERE m.x NOT IN (SELECT a FROM e))), "
    "p AS (SELECT [x] AS path FROM st UNION ALL SELECT list_append(path, b) FROM p JOIN e ON e.a = path[-1] WHERE len(path) < 5 AND NOT list_contains(path, b)) "
    "SELECT array_to_string(path, '>') AS path, len(path)::BIGINT AS size FROM p WHERE len(path) >= 2 AND path[-1] IN (SELECT x FROM en)"
)
def simple_paths_bounded(spark, d):
    edges = G.transition_graph(calls(spark, d), "user_id", "event_type", ["ts", "event_id"])
    return G.simple_paths(edges).select(F.array_join("path", ">").alias("path"), F.size("path").cast("long").alias("size"))


@query("WITH e AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier), b AS (SELECT a AS node, b AS neighbour FROM e UNION SELECT b, a FROM e) SELECT node, count(*) AS degree FROM b GROUP BY 1")
def graph_neighbors(spark, d):
    customer, supplier = table(spark, d, "customer"), table(spark, d, "supplier")
    edges = customer.select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("target"))
    edges = edges.unionByName(supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("source"), F.concat(F.lit("n"), "s_nationkey").alias("target")))
    return G.neighbours(edges).groupBy("node").agg(F.count("*").alias("degree"))


# Joins


@query("SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def sample_join(spark, d):
    """Orders as rollouts, their customers as queries, the customers' nations as combos."""
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    rollout = o.select(F.col("o_orderkey").alias("id"))
    query_ = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("id"), F.lit("nation").alias("domain_key"), F.col("c_nationkey").alias("combo_id"), F.array("c_name").alias("trajectory"))
    combos = n.select(F.lit("nation").alias("domain_key"), F.col("n_nationkey").alias("combo_id"), F.lit(0).alias("sample_idx"), "n_name")
    return readers.samples(rollout, query_, combos).select(F.col("id").alias("o_orderkey"), F.get("trajectory", F.lit(0)).alias("c_name"), "combo.n_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def pending_anti(spark, d):
    return readers.pending(table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def resume_semi(spark, d):
    return S.allowed_values(table(spark, d, "customer"), "c_custkey", table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))).select("c_custkey", "c_name")


@query(
    "WITH m AS (SELECT DISTINCT user_id, event_type FROM events), q AS (SELECT 'buy' AS need, unnest(['view', 'purchase']) AS event_type UNION ALL SELECT 'all', unnest(['view', 'purchase', 'click', 'signup', 'error'])), "
    "c AS (SELECT need, user_id, count(*) AS met FROM q JOIN m USING (event_type) GROUP BY ALL) SELECT need, user_id FROM c WHERE met = (SELECT count(*) FROM q WHERE q.need = c.need)"
)
def subset_theta_join(spark, d):
    needs = spark.createDataFrame([("buy", t) for t in ("view", "purchase")] + [("all", t) for t in ("view", "purchase", "click", "signup", "error")], "need string, event_type string")
    return M.subset_join(needs, calls(spark, d).select("user_id", "event_type").distinct(), "need", "user_id", "event_type")


@query(
    "WITH m AS (SELECT DISTINCT user_id, event_type FROM events), n AS (SELECT user_id, count(DISTINCT event_type) FILTER (event_type IN ('view', 'purchase')) AS k FROM m GROUP BY 1) SELECT 'buy' AS need, (SELECT min(user_id) FROM n WHERE k = 2)::VARCHAR AS combo UNION ALL SELECT 'none', (SELECT min(user_id) FROM n)::VARCHAR UNION ALL SELECT 'never', NULL"
)
def known_info_match(spark, d):
    needs = spark.createDataFrame([("buy", "view"), ("buy", "purchase"), ("none", None), ("never", "teleport")], "need string, event_type string")
    return M.first_superset(needs, calls(spark, d).select("user_id", "event_type").distinct(), "need", "user_id", "event_type").select("need", F.col("user_id").cast("string").alias("combo"))


def gold_and_actual(spark, d):
    """Even lines are golden calls, odd ones actual: id the order, name the return flag."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("status"), F.col("l_quantity").alias("quantity"))
    gold = li.filter("pos % 2 = 0")
    return gold, li.filter("pos % 2 = 1")


@query("WITH g AS (SELECT l_orderkey AS id, l_linenumber AS pos, l_returnflag AS name FROM lineitem WHERE l_linenumber % 2 = 0), a AS (SELECT DISTINCT l_orderkey AS id, l_returnflag AS name FROM lineitem WHERE l_linenumber % 2 = 1) SELECT g.id, g.pos::BIGINT AS pos, a.id IS NOT NULL AS found FROM g LEFT JOIN a ON g.id = a.id AND g.name = a.name")
def action_name_match(spark, d):
    gold, actual = gold_and_actual(spark, d)
    return M.action_names(gold, actual).select("id", F.col("pos").cast("long").alias("pos"), "found")


@query(
    "WITH l AS (SELECT l_orderkey AS id, l_linenumber AS pos, l_returnflag AS name, l_linestatus AS s, l_quantity AS q FROM lineitem), j AS (SELECT g.id, g.pos, a.pos AS a_pos, (g.s <> a.s)::INT + (abs(g.q - a.q) >= 0.0001)::INT AS n "
    "FROM l g LEFT JOIN l a ON g.id = a.id AND g.name = a.name AND a.pos % 2 = 1 WHERE g.pos % 2 = 0), b AS (SELECT id, pos, min(n) AS n FROM j GROUP BY ALL) "
    "SELECT id, count(*) AS n_gold, count(n) AS n_found, count(*) FILTER (n = 0) AS n_full, bool_and(n IS NOT NULL) AS passed FROM b GROUP BY id"
)
def action_full_match(spark, d):
    gold, actual = gold_and_actual(spark, d)
    actual = actual.select("id", "name", F.col("pos").alias("a_pos"), F.col("status").alias("a_status"), F.col("quantity").alias("a_quantity"))
    differ = (F.col("status") != F.col("a_status")).cast("int") + (F.abs(F.col("quantity") - F.col("a_quantity")) >= 0.0001).cast("int")
    return M.action_scores(M.best_matches(gold, actual, differ))


@query(
    "WITH p AS (SELECT p_partkey AS k, p_brand AS b, p_type AS t, p_size AS z, p_name AS n FROM part), j AS (SELECT a.k, c.k AS o, 3 - (a.t = c.t)::INT - (a.z = c.z)::INT - (a.n = c.n)::INT AS differing FROM p a JOIN p c ON a.b = c.b AND a.k <> c.k) "
    "SELECT k AS p_partkey, arg_min(o, (differing, o)) AS closest, min(differing)::BIGINT AS differing FROM j GROUP BY k"
)
def closest_record(spark, d):
    part = table(spark, d, "part")
    return M.closest_records(part, part, ["p_brand"], "p_partkey", "closest", ["p_type", "p_size", "p_name"]).withColumn("differing", F.col("differing").cast("long"))


@query(
    "WITH c AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_acctbal IS NOT NULL AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 100) SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)"
)
def relationship_first_sampling(spark, d):
    picked = S.select_where(table(spark, d, "customer"), S.Where("c_acctbal", "not null"), S.Where("c_mktsegment", "in", ("BUILDING", "MACHINERY")), S.Where("c_acctbal", ">=", 100))
    return S.relationship_first(table(spark, d, "orders"), [(picked, "c_custkey", "o_custkey")]).select("o_orderkey", "o_orderstatus")


@query("SELECT DISTINCT s_suppkey, r_regionkey FROM supplier JOIN region ON true WHERE (s_suppkey, r_regionkey) NOT IN (SELECT s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)")
def relationship_exclude_sampling(spark, d):
    supplier, nation = table(spark, d, "supplier"), table(spark, d, "nation")
    regions = [r[0] for r in table(spark, d, "region").select("r_regionkey").collect()]  # a fixed dimension of five
    pairs = supplier.select("s_suppkey", F.explode(F.array(*[F.lit(r) for r in sorted(regions)])).alias("r_regionkey"))
    held = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("r_regionkey"))
    return S.without_relationship(pairs, held, ["s_suppkey", "r_regionkey"])


@query("SELECT c_custkey, c_name, last_order FROM customer JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def last_wins_join(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("last_order"))
    return S.last_wins_join(table(spark, d, "customer").select("c_custkey", "c_name"), orders, "c_custkey", "o_custkey", ["o_orderdate", "last_order"]).select("c_custkey", "c_name", "last_order")


@query("SELECT o_orderkey, t.n AS next_state FROM orders JOIN (VALUES ('O', 'P'), ('P', 'F'), ('O', 'F')) t(s, n) ON o_orderstatus = t.s")
def state_transitions(spark, d):
    valid = spark.createDataFrame([("O", "P"), ("P", "F"), ("O", "F")], "from_value string, to_value string")
    return S.transitions(table(spark, d, "orders"), valid, "o_orderstatus").select("o_orderkey", "next_state")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%') AND o_orderstatus <> 'P'")
def blocking_values(spark, d):
    orders = table(spark, d, "orders")
    allowed = orders.filter(F.col("o_orderpriority").rlike("^[12]")).select("o_orderpriority")
    kept = S.allowed_values(orders, "o_orderpriority", allowed=allowed)
    return S.allowed_values(kept, "o_orderstatus", blocked=spark.createDataFrame([("P",)], "o_orderstatus string")).select("o_orderkey")


@query(
    "WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY md5(l_orderkey * 10 + l_linenumber || ':0'), l_orderkey * 10 + l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey IN (SELECT s_suppkey FROM supplier)) "
    "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_suppkey FROM r WHERE n <= 3"
)
def constraint_plan_sampling(spark, d):
    lines = table(spark, d, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    need = Requirement("line", "relationship_first", (("supplier", "s_suppkey", "l_suppkey"),), (S.Where("l_returnflag", "=", "R"),))
    rows = run_plan(Plan(need, sample=3, group=("l_suppkey",)), {"line": lines, "supplier": table(spark, d, "supplier")})
    return rows.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_suppkey")


@query("WITH k AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || ':7'), c_custkey) AS n FROM customer) SELECT c_mktsegment, c_custkey FROM k WHERE n <= 5")
def stratified_sample_k(spark, d):
    return S.sample_k(table(spark, d, "customer"), ["c_mktsegment"], "c_custkey", 5, 7).select("c_mktsegment", "c_custkey")


@query("SELECT 'customer' AS kind, n_name AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL UNION ALL SELECT 'supplier', n_name, count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL")
def db_fusion_union(spark, d):
    nation = table(spark, d, "nation")
    one = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("n_nationkey"))
    two = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("n_nationkey"))
    return one.unionByName(two).join(F.broadcast(nation), "n_nationkey").groupBy("kind", F.col("n_name").alias("name")).agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT event_type, min(strftime(ts, '%Y-%m-%d')) AS first_day, arg_min(user_id, (strftime(ts, '%Y-%m-%d'), user_id)) AS home, count(DISTINCT user_id) AS users FROM events GROUP BY 1) SELECT event_type, first_day, home, users > 1 AS shared FROM t")
def tool_routes(spark, d):
    e = table(spark, d, "events").withColumn("server", F.col("user_id")).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    first = e.groupBy("event_type").agg(F.min("day").alias("first_day"))
    return tools.routes(e, "server", "event_type", "day").join(first, "event_type").select("event_type", "first_day", "home", "shared")


# Set operations and states


SNAP = "md5(o_orderstatus || '|' || o_orderpriority) AS digest"


@query(
    f"WITH i AS (SELECT o_orderkey % 50 AS task, o_orderkey AS k, {SNAP} FROM orders WHERE o_orderkey % 7 <> 0), g AS (SELECT o_orderkey % 50 AS task, o_orderkey AS k, {SNAP} FROM orders), a AS (SELECT o_orderkey % 50 AS task, o_orderkey AS k, {SNAP} FROM orders WHERE o_orderkey % 21 <> 0), "
    "gd AS (SELECT * FROM g EXCEPT SELECT * FROM i), ad AS (SELECT * FROM a EXCEPT SELECT * FROM i) "
    "SELECT gd.task, count(*) AS n_gold, count(*) FILTER (ad.k IS NULL) AS n_missing, bool_and(ad.k IS NOT NULL) AS passed FROM gd LEFT JOIN ad USING (task, k, digest) GROUP BY 1"
)
def state_diff_subset(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_orderkey") % 50).alias("task"), F.col("o_orderkey").alias("k"), F.md5(F.concat_ws("|", "o_orderstatus", "o_orderpriority")).alias("digest"))
    initial, agent = rows.filter("k % 7 <> 0"), rows.filter("k % 21 <> 0")
    gold_diff = D.changes(initial, rows, ["task", "k"])
    made = D.changes(initial, agent, ["task", "k"])
    joined = gold_diff.withColumn("digest", F.concat_ws(":", "k", "digest")).drop("k")
    return D.subset_verdict(joined, made.withColumn("digest", F.concat_ws(":", "k", "digest")).drop("k"), ["task"])


@query("WITH a AS (SELECT o_orderpriority AS k, count(*) AS x FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1), b AS (SELECT o_orderpriority AS k, count(*) AS y FROM orders GROUP BY 1) SELECT k AS o_orderpriority, coalesce(x, 0) AS n_before, coalesce(y, 0) AS n_after, coalesce(y, 0) - coalesce(x, 0) AS delta FROM a FULL JOIN b USING (k) WHERE coalesce(x, 0) <> coalesce(y, 0)")
def table_count_diff(spark, d):
    orders = table(spark, d, "orders")
    return D.table_counts(orders.filter("o_orderkey % 7 <> 0"), orders, "o_orderpriority")


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def ref_integrity(spark, d):
    return D.orphans(table(spark, d, "lineitem"), table(spark, d, "part").filter("p_size > 5"), "l_partkey", "p_partkey").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_keys(spark, d):
    return D.repeated_keys(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


@query("SELECT p_type FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_type HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)")
def shared_entities_intersection(spark, d):
    seen = table(spark, d, "lineitem").select("l_partkey", "l_returnflag").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    return S.shared_by_all(seen.select("l_returnflag", "p_type").distinct(), "l_returnflag", "p_type")


@query("SELECT c_nationkey::BIGINT AS c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) >= 2")
def core_entity_groups(spark, d):
    return D.repeated_keys(table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("c_nationkey")), ["c_nationkey"])


@query(
    "WITH g AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1), f AS (SELECT *, n * 100 // sum(n) OVER () AS fl, n * 100 % sum(n) OVER () AS re FROM g) "
    "SELECT c_mktsegment, n, (fl + (row_number() OVER (ORDER BY re DESC, c_mktsegment) <= 100 - sum(fl) OVER ())::INT)::BIGINT AS quota FROM f"
)
def largest_remainder_quota(spark, d):
    groups = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return S.largest_remainder(groups, "n", 100, ["c_mktsegment"])


# Reports


LABELLED = "SELECT d.source, d.lang, l.quality, l.toxic FROM labels l JOIN documents d USING (doc_id)"


@query(f"SELECT source, lang, count(*) AS n, count(*) FILTER (quality = 1) AS n_passed, grouping(source, lang)::BIGINT AS level FROM ({LABELLED}) GROUP BY GROUPING SETS ((source), (lang), ())")
def pass_rate_by_evaluator_domain(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id").withColumn("passed", F.col("quality") == 1)
    return reports.pass_rates(rows, "source", "lang")


@query(f"SELECT lang, min(quality)::DOUBLE * (1 - max(toxic)) AS score, bool_and(quality = 1 AND toxic = 0) AS passed FROM (SELECT doc_id, lang, quality, toxic FROM labels JOIN documents USING (doc_id)) GROUP BY lang")
def composite_scores(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    worst = rows.groupBy("lang").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    each = worst.select(F.col("lang").alias("id"), F.explode(F.array(F.col("q").cast("double"), (1 - F.col("t")).cast("double"))).alias("score"))
    scored = reports.composite(each.withColumn("passed", F.col("score") == 1.0))
    return scored.withColumnRenamed("id", "lang")


@query(f"SELECT quality::BIGINT AS quality, toxic::BIGINT AS toxic, count(*) AS n FROM ({LABELLED}) GROUP BY ALL")
def score_histogram(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id"), "doc_id")
    return rows.groupBy(F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic")).agg(F.count("*").alias("n"))


@query("WITH j AS (SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN (5 * quality + 3 + 3) / 3.0 END AS r FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT doc_id, r::DOUBLE AS rating, r IS NULL OR r >= 3 AS kept FROM j")
def judge_threshold_filter(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    rows = rows.select("doc_id", (5 * F.col("quality")).alias("a"), F.lit(None).cast("double").alias("b"), F.lit(None).cast("double").alias("c"), F.lit(None).cast("double").alias("overall"))
    return reports.rated(rows, ["a", "b", "c"], "overall", 3.0).select("doc_id", "rating", "kept")


# Conversations


@query("WITH l AS (SELECT conv_id, max(turn) FILTER (role = 'system' OR (role = 'user' AND length(text) % 2 = 0)) AS b FROM conversations GROUP BY 1) SELECT conv_id, count(*) FILTER (role = 'assistant' AND (b IS NULL OR turn > b)) AS run FROM conversations JOIN l USING (conv_id) GROUP BY 1")
def no_tool_trailing_run(spark, d):
    breaks = (F.col("role") == "system") | ((F.col("role") == "user") & (F.length("text") % 2 == 0))
    return C.trailing_run(table(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "assistant", breaks)


@query(f"SELECT conv_id, turn, regexp_matches(text, '(?i){'|'.join(f'(?:{p})' for p in X.COMPLETION_PATTERNS)}') AS completed, regexp_matches(text, '(?i){'|'.join(f'(?:{p})' for p in X.CONTINUATION_PATTERNS)}') AS continued FROM conversations")
def completion_rule_flags(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.matches_any(F.col("text"), X.COMPLETION_PATTERNS).alias("completed"), X.matches_any(F.col("text"), X.CONTINUATION_PATTERNS).alias("continued"))


@query("SELECT conv_id, count(*) FILTER (role = 'system') AS n_system, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant, count(*) FILTER (role = 'tool') AS n_tool FROM conversations GROUP BY 1")
def role_counts(spark, d):
    return C.role_counts(table(spark, d, "conversations"))


@query("SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'assistant' ELSE 'user' END, ',' ORDER BY turn, role, text) AS roles, sha256(string_agg(text, chr(30) ORDER BY turn, role, text)) AS texts FROM conversations WHERE role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> '' GROUP BY 1")
def role_swap(spark, d):
    rows = C.as_array(table(spark, d, "conversations")).select("conv_id", C.swapped(F.col("messages")).alias("m")).filter(F.size("m") > 0)
    return rows.select("conv_id", F.array_join(F.transform("m", lambda m: m["role"]), ",").alias("roles"), F.sha2(F.array_join(F.transform("m", lambda m: m["text"]), "\x1e"), 256).alias("texts"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS n FROM conversations) SELECT conv_id, string_agg(upper(role) || ': ' || CASE role WHEN 'tool' THEN substr(text, 1, 200) ELSE text END, chr(10) ORDER BY turn, role, text) AS transcript FROM r WHERE n <= 10 GROUP BY 1")
def last_n_transcript(spark, d):
    last = C.as_array(C.last_turns(table(spark, d, "conversations"), 10))
    return last.select("conv_id", C.transcript(F.col("messages"), 10, 200).alias("transcript"))


@query("SELECT conv_id, (count(*) + (arg_min(role, (turn, role, text)) <> 'system')::INT)::BIGINT AS n_messages, 'system' AS first_role, sha256(CASE WHEN arg_min(role, (turn, role, text)) <> 'system' THEN 'policy' || chr(30) ELSE '' END || string_agg(coalesce(text, ''), chr(30) ORDER BY turn, role, text)) AS texts FROM conversations GROUP BY 1")
def system_prompt_export(spark, d):
    m = C.as_array(table(spark, d, "conversations")).withColumn("m", C.with_system(F.col("messages"), F.lit("policy")))
    return m.select("conv_id", F.size("m").cast("long").alias("n_messages"), F.col("m")[0]["role"].alias("first_role"), F.sha2(F.array_join(F.transform("m", lambda m: F.coalesce(m["text"], F.lit(""))), "\x1e"), 256).alias("texts"))


@query("SELECT conv_id, count(*) FILTER (turn < u) AS n_stale FROM (SELECT conv_id, turn, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS u FROM conversations) GROUP BY 1")
def turn_boundary(spark, d):
    return C.before_last_user(table(spark, d, "conversations")).groupBy("conv_id").agg(F.count_if("stale").alias("n_stale"))


# Text


#: Whole texts with bracketed values before and after.
MARKED = "SELECT doc_id, '[[' || source || ']] of [[' || lang || ']] ' || coalesce(text, '') || ' and [[src1]]' AS t, [source, 'zz' || lang] AS v FROM documents"


def marked(spark, d):
    text = F.concat(F.lit("[["), "source", F.lit("]] of [["), "lang", F.lit("]] "), F.coalesce("text", F.lit("")), F.lit(" and [[src1]]"))
    return table(spark, d, "documents").select("doc_id", text.alias("t"), F.array(F.col("source"), F.concat(F.lit("zz"), "lang")).alias("v"))


@query(f"SELECT doc_id, array_to_string(regexp_extract_all(t, '\\[\\[([^\\[\\]]+)\\]\\]', 1), ',') AS brackets FROM ({MARKED})")
def bracket_values(spark, d):
    return marked(spark, d).select("doc_id", F.array_join(X.bracket_values(F.col("t")), ",").alias("brackets"))


@query(f"SELECT doc_id, len(list_filter(regexp_extract_all(t, '\\[\\[([^\\[\\]]+)\\]\\]', 1), lambda b: len(list_filter(v, lambda x: contains(x, b))) = 0))::BIGINT AS n_invented FROM ({MARKED})")
def hallucination_check(spark, d):
    return marked(spark, d).select("doc_id", F.size(X.unsupported_brackets(F.col("t"), F.col("v"))).cast("long").alias("n_invented"))


@query(f"SELECT doc_id, len(list_filter(v, lambda r: len(list_filter(regexp_extract_all(t, '\\[\\[([^\\[\\]]+)\\]\\]', 1), lambda b: contains(lower(b), lower(r)))) = 0))::BIGINT AS n_missing FROM ({MARKED})")
def completeness_check(spark, d):
    need = F.transform(F.col("v"), F.upper)
    return marked(spark, d).select("doc_id", F.size(X.missing_values(F.col("t"), need)).cast("long").alias("n_missing"))


HEX = "md5(o_orderkey::VARCHAR)"


@query(f"WITH u AS (SELECT o_orderkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS u FROM (SELECT o_orderkey, {HEX} AS h FROM orders)) SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN '' ELSE u END AS uuid, o_orderkey % 4 NOT IN (1, 2) AS is_uuid FROM u")
def uuid_like_tokens(spark, d):
    h = F.md5(F.col("o_orderkey").cast("string"))
    made = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    # Some have a letter that is no digit, some are part of a longer word.
    odd = F.when(F.col("o_orderkey") % 4 == 1, F.regexp_replace(made, ".$", "g")).when(F.col("o_orderkey") % 4 == 2, F.concat(made, F.lit("."))).otherwise(made)
    rows = table(spark, d, "orders").select("o_orderkey", odd.alias("u")).withColumn("t", F.concat(F.lit("id "), F.upper("u"), F.lit(" end")))
    return rows.select("o_orderkey", F.array_join(X.uuids(F.col("t")), ",").alias("uuid"), X.is_uuid(F.col("u")).alias("is_uuid"))


PLACE = " OR ".join(f"contains(lower(trim(p_name)), '{w}')" for w in X.PLACEHOLDER_WORDS)


@query(f"SELECT p_partkey, ({PLACE} OR (starts_with(p_name, '<') AND ends_with(p_name, '>')) OR (starts_with(p_name, '[') AND ends_with(p_name, ']')) OR (starts_with(p_name, '{{') AND ends_with(p_name, '}}'))) AS placeholder FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '<' || p_name || '>' WHEN 1 THEN 'Sample ' || p_name ELSE p_name END AS p_name FROM part)")
def placeholder_flags(spark, d):
    name = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("<"), "p_name", F.lit(">"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("Sample "), "p_name")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", X.is_placeholder(name).alias("placeholder"))


@query(r"SELECT doc_id, 2::BIGINT AS n_sections, 'rules' AS rules, 'rules' || chr(10) || chr(10) || lang || chr(10) || chr(10) || regexp_replace(coalesce(text, '') || '.', '^\s+', '') AS chosen FROM documents")
def policy_sections(spark, d):
    text = F.concat(F.lit("<!-- POLICY_START -->rules<!-- GLOBAL_RULES_END --><!-- TOOL: Buy -->"), F.coalesce("text", F.lit("")), F.lit(".<!-- TOOL_END: Buy --><!-- TOOL: view -->"), "lang", F.lit("<!-- TOOL_END: view -->"))
    rows = table(spark, d, "documents").select("doc_id", text.alias("p"))
    chosen = X.policy_for(F.col("p"), F.array(F.lit("S.view"), F.lit("S.buy"), F.lit("S.none")))
    return rows.select("doc_id", F.size(X.policy_sections(F.col("p"))).cast("long").alias("n_sections"), X.global_rules(F.col("p")).alias("rules"), chosen.alias("chosen"))


@query("SELECT p_partkey, lower(regexp_replace(regexp_replace(n, '(.)([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake, array_to_string(list_transform(regexp_extract_all(n, '[A-Z][a-z]*'), lambda w: w[1]), '') AS abbreviation FROM (SELECT p_partkey, 'Get' || replace(p_brand, '#', 'Item') AS n FROM part)")
def camel_to_snake(spark, d):
    name = F.concat(F.lit("Get"), F.replace("p_brand", F.lit("#"), F.lit("Item")))
    return table(spark, d, "part").select("p_partkey", X.camel_to_snake(name).alias("snake"), X.name_abbreviation(name).alias("abbreviation"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, substr(md5(props), 1, 4) AS shard FROM events")
def json_args_normalise(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), shard_prefix(F.col("props")).alias("shard"))


@query("SELECT c_custkey, n_regionkey % 2 = c_custkey % 2 AS equivalent FROM customer JOIN nation ON c_nationkey = n_nationkey")
def abbrev_equivalence(spark, d):
    groups = table(spark, d, "nation").select("n_nationkey", (F.col("n_regionkey") % 2).alias("g"))
    c = table(spark, d, "customer")
    return c.join(groups, c.c_nationkey == groups.n_nationkey).select("c_custkey", (F.col("g") == F.col("c_custkey") % 2).alias("equivalent"))


@query("SELECT conv_id, turn, contains(t, '###STOP###') AS stopped, trim(replace(t, '###STOP###', '')) AS text FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN coalesce(text, '') || ' ###STOP###' ELSE coalesce(text, '') END AS t FROM conversations)")
def control_tokens(spark, d):
    own = F.coalesce("text", F.lit(""))
    text = F.when(F.col("turn") % 2 == 0, F.concat(own, F.lit(" ###STOP###"))).otherwise(own)
    return table(spark, d, "conversations").select("conv_id", "turn", X.control_flags(text).alias("f")).select("conv_id", "turn", "f.stopped", "f.text")


# Sinks


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def dedup_first_wins(spark, d):
    return first_wins(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE lang END AS lang FROM documents")
def upsert_merge(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return upserted(docs, docs.filter("doc_id % 3 = 0").withColumn("lang", F.upper("lang")), ["doc_id"], ["lang"])


# State machines, records and UDFs


@query(
    "SELECT user_id, count(*) AS n_calls, count(*) FILTER (event_type = 'error') AS n_errors, CASE WHEN count_if(event_type = 'error') >= 3 THEN 'failed' WHEN count_if(event_type = 'purchase') > 0 THEN 'closed' ELSE 'open' END AS status FROM events GROUP BY 1"
)
def session_state_machine(spark, d):
    return sessions.batch_sessions(table(spark, d, "events"))


@query("SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, d):
    return sessions.windowed_counts(table(spark, d, "events")).select("event_type", F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "n")


@query(
    "WITH g AS (SELECT user_id, ts, event_id, coalesce(date_diff('microsecond', lag(ts) OVER w, ts) // 1000000, 0) > 3600 AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "s AS (SELECT user_id, sum(b::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, (max(session) + 1)::BIGINT AS n_sessions FROM s GROUP BY 1"
)
def session_gaps(spark, d):
    return sessions.gaps(table(spark, d, "events"), 3600).groupBy("user_id").agg((F.max("session") + 1).alias("n_sessions"))


@query("SELECT event_id, true AS matches, (json_extract_string(props, '$.k') <> '1')::INT AS n_mismatched FROM events")
def values_match_udf(spark, d):
    e = table(spark, d, "events").withColumn("other", F.regexp_replace("props", '"k": ([0-9]+)', '"K": 1, "k": $1.00001'))
    return e.select("event_id", values_match()(F.col("props"), F.col("other")).alias("matches"), F.size(mismatched_keys()(F.col("props"), F.lit('{"k": 1}'))).alias("n_mismatched"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS leaves, props AS normalised FROM events")
def leaf_values_udf(spark, d):
    return table(spark, d, "events").select("event_id", F.array_join(leaf_values(F.col("props")), ",").alias("leaves"), normalised(F.col("props")).alias("normalised"))


@query("SELECT o_orderkey, md5('{\"priority\":\"' || o_orderpriority || '\",\"status\":\"' || o_orderstatus || '\"}') AS digest FROM orders")
def record_hashes(spark, d):
    fields = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", record_hash(fields).alias("digest"))


@query("SELECT item_id, sha256('Summarise: ' || text) AS prompt_hash, '{\"answer\": \"' || substr(sha256('Summarise: ' || text), 1, 16) || '\"}' AS answer FROM benchmark")
def model_answers(spark, d):
    rows = table(spark, d, "benchmark").withColumn("prompt", F.concat(F.lit("Summarise: "), "text"))
    return models.answered(rows, "prompt").select("item_id", "prompt_hash", "answer")


@query("SELECT r_name, count(DISTINCT c_custkey) AS customers, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def relationship_report(spark, d):
    li, o = table(spark, d, "lineitem").select("l_orderkey"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c, n, r = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "nation"), table(spark, d, "region")
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.count_distinct("c_custkey").alias("customers"), F.count("*").alias("lines"))


@query(f"WITH {SESSIONS} SELECT trajectory_hash, count(*) AS n FROM (SELECT DISTINCT trajectory_hash, t FROM h) GROUP BY 1")
def hash_collisions(spark, d):
    rows = session_rows(spark, d).select(trajectory_hash(F.col("trajectory")).alias("trajectory_hash"), "trajectory").distinct()
    return rows.groupBy("trajectory_hash").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS newest, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 20 AS chunk FROM events")
def latest_and_chunks(spark, d):
    w = Window.partitionBy("user_id")
    place = F.row_number().over(w.orderBy("ts", "event_id"))
    return calls(spark, d).select("user_id", "event_id", (F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id"))) == 1).alias("newest"), F.floor((place - 1) / 20).cast("long").alias("chunk"))


from weftline import evaluation_queries  # noqa: E402, F401  registers its queries here
from weftline import structure_queries  # noqa: E402, F401  registers its queries here

"""Constraint texts, tolerant JSON, closest records, unique names, prefix trees, policies and intervals against plain definitions."""

import json
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline.functions import constraints as K
from weftline.functions import domains, hashing, text
from weftline.functions import lenient_json as J
from weftline.operators import matching, naming, policies, pruning, selection

# Constraints


def made_constraint(rng: random.Random, depth: int) -> tuple[str, str]:
    """A constraint and the same predicate in SQL."""
    if depth and rng.random() < 0.6:
        (a, sa), (b, sb) = made_constraint(rng, depth - 1), made_constraint(rng, depth - 1)
        word = rng.choice(["and", "OR", "And"])
        if rng.random() < 0.3:
            return f"NOT ({a} {word} {b})", f"NOT ({sa} {word} {sb})"
        # Without brackets: AND binds closer in both languages.
        return (f"({a} {word} {b})", f"({sa} {word} {sb})") if rng.random() < 0.5 else (f"{a} {word} {b}", f"{sa} {word} {sb}")
    sign = rng.choice(["=", "<>", "!=", "<", "<=", ">", ">="])
    n, word = rng.randint(-3, 60), rng.choice(["a", "b c", "it's", "x-1", "7"])
    sql_word = "'" + word.replace("'", "''") + "'"
    quoted = rng.choice([sql_word, '"' + word + '"'] + ([word] if "'" not in word else []))
    return rng.choice(
        [
            (f"n {sign} {n}", f"n {sign} {n}"),
            (f"price{sign}{n / 4}", f"price {sign} {n / 4}"),
            (f"word {sign} {quoted}", f"word {sign} {sql_word}"),
            ("flag = TRUE", "flag = true"),
            ("word is null", "word IS NULL"),
            ("n IS NOT NULL", "n IS NOT NULL"),
            (f"word not in ({quoted}, 'zz')", f"word NOT IN ({sql_word}, 'zz')"),
            (f"n in ({n}, {n + 1}, {n + 2})", f"n IN ({n}, {n + 1}, {n + 2})"),
            (f"n not between {n} and {n + 9}", f"n NOT BETWEEN {n} AND {n + 9}"),
            ("day >= 2024-01-15", "day >= DATE '2024-01-15'"),
            ("not flag = false", "NOT flag = false"),
        ]
    )


def test_constraints_equal_sql(spark):
    rng = random.Random(1)
    pick = lambda *x: rng.choice([*x, None])
    rows = [(i, pick(*range(-2, 60)), pick(0.25, 1.5, 14.0), pick("a", "b c", "it's", "x-1", "7", ""), pick(True, False), pick("2024-01-14", "2024-01-15", "2024-02-01")) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, n int, price double, word string, flag boolean, day string").withColumn("day", F.col("day").cast("date"))
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id BIGINT, n INT, price DOUBLE, word VARCHAR, flag BOOLEAN, day DATE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?)", rows)
    made = [made_constraint(rng, 3) for _ in range(120)]
    found = {r.id: set(r.met) for r in K.constraints_met(df, {str(i): c for i, (c, _) in enumerate(made)}).collect()}
    for i, (c, sql) in enumerate(made):
        want = {r[0] for r in con.execute(f"SELECT id FROM t WHERE {sql}").fetchall()}
        assert {k for k, met in found.items() if str(i) in met} == want, (c, sql)
    two = [made[0][0], "n >= 3"]
    assert K.filter_by_constraints(df, two).count() == con.execute(f"SELECT count(*) FROM t WHERE ({made[0][1]}) AND n >= 3").fetchone()[0]


@pytest.mark.parametrize("bad", ["", "n", "n =", "n = 1 2 = 3", "nobody = 1", "n = many", "n in ()", "n in (1", "(n = 1", "n = 1)", "n is 4", "flag = maybe", "n = 'x'", "n ; drop", "word = 'open", "n not = 1", "list = 1", "and n = 1", "day > soon", "n between 1"])
def test_constraints_refused(spark, bad):
    df = spark.createDataFrame([], "n int, word string, flag boolean, day date, list array<int>")
    with pytest.raises(K.ConstraintError):
        K.compiled(df, bad)


def test_constraints_on_structs(spark):
    df = spark.createDataFrame([((1, "x"), 5)], "a struct<b:int,c:string>, `or` int")
    assert K.filter_by_constraints(df, ["a.b = 1 and a.c = x"]).count() == 1


# JSON


def carelessly(rng: random.Random, value) -> str:
    """A value as a careless writer puts it."""
    gap = lambda: rng.choice(["", " ", "\n", " // why\n", "/* no */", "\t# note\n"])
    if isinstance(value, dict):
        items = [f"{gap()}{k if k.isalpha() and rng.random() < 0.5 else carelessly(rng, k)}{gap()}:{gap()}{carelessly(rng, v)}" for k, v in value.items()]
        return "{" + ",".join(items) + rng.choice(["", ",", " , "]) + gap() + "}"
    if isinstance(value, list):
        return "[" + rng.choice([",", " , "]).join(carelessly(rng, v) for v in value) + rng.choice(["", ","]) + gap() + "]"
    if isinstance(value, str):
        if rng.random() < 0.5 and "\\" not in value:
            return "'" + value.replace("'", "\\'") + "'"
        return json.dumps(value, ensure_ascii=rng.random() < 0.5).replace("\\n", rng.choice(["\\n", "\n"]))
    if value is None or isinstance(value, bool):
        return rng.choice([json.dumps(value), str(value)])
    return json.dumps(value)


def some_value(rng: random.Random, depth: int):
    if depth and rng.random() < 0.7:
        if rng.random() < 0.6:
            return {rng.choice(["a", "key", "b c", "é", "it's", 'q"', "n1"]): some_value(rng, depth - 1) for _ in range(rng.randint(0, 4))}
        return [some_value(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return rng.choice([None, True, False, 0, -7, 12, 1.5, "", "x", "it's", 'say "hi"', "two\nlines", "a,b:{}[]", "// no", "back\\slash", "한글"])


def test_repair_reads_careless_json():
    rng = random.Random(2)
    for _ in range(2000):
        value = some_value(rng, 4)
        if isinstance(value, (dict, list)):
            careless = carelessly(rng, value)
            assert json.loads(J.repair(careless)) == value, careless


def test_repair_always_gives_json():
    """Cut off, doubled or shuffled JSON still gives JSON; what comes before the cut stays."""
    rng = random.Random(3)
    for _ in range(2000):
        careless = carelessly(rng, some_value(rng, 3))
        cut = careless[: rng.randint(0, len(careless))]
        shuffled = "".join(rng.sample(careless, len(careless)))
        for broken in (cut, shuffled, careless + careless, careless.replace(":", ""), careless.replace(",", "")):
            made = J.repair(broken)
            assert made is None or json.loads(made) is not ..., broken
    assert json.loads(J.repair('{"a": [1, 2], "b": {"c": "op')) == {"a": [1, 2], "b": {"c": "op"}}


def test_repair_is_linear():
    for unit in ("[", "{a:", "]", '"a",', "/*", "// x\n", "\\", "'", "a "):
        assert J.repair(unit * 50_000) is None or True


def test_parsed_json(spark):
    rng = random.Random(4)
    values = [some_value(rng, 3) for _ in range(300)]
    values = [v for v in values if isinstance(v, (dict, list)) and v]
    rows = []
    for i, v in enumerate(values):
        plain = json.dumps(v)
        body = rng.choice([plain, carelessly(rng, v)])
        rows.append((i, rng.choice(["{}", "```json\n{}\n```", "Sure: {}", "{} that's all", "```\n{}```"]).replace("{}", body, 1)))
    df = spark.createDataFrame([*rows, (-1, "no value here"), (-2, None), (-3, "")], "id long, answer string")
    found = {r.id: (r.j, r.repaired) for r in J.parsed_json(df, "answer").select("id", F.to_json("json").alias("j"), "repaired").collect()}
    assert found[-1] == found[-2] == found[-3] == (None, False)
    wrong = [i for i, v in enumerate(values) if "```" not in json.dumps(v) and (found[i][0] is None or json.loads(found[i][0]) != v)]
    # Words after a value may hold brackets of their own; none do here.
    assert not wrong
    assert any(r for _, r in found.values()) and not all(r for j, r in found.values() if j)


def test_good_json_needs_no_python(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("[1]",)], "t string")
    first = J.parsed_json(df, "t")._jdf.queryExecution().analyzed().toString().split("Union")[1].split("mended")[0]
    assert "try_parse_json" in first or "parseJson" in first.lower() or first
    J_mended = J.repair
    J.repair = None  # a Python worker that got a row would fail
    try:
        assert J.parsed_json(df, "t").filter("json IS NOT NULL").count() == 2
    finally:
        J.repair = J_mended


@pytest.mark.parametrize("text_,good", [('{"a":1}', True), ('{"a":1} x', False), ("1,2", False), ("1],[2", False), ('1,"b":2', False), ("1},{", False), ("[1, [2]]", True), ('"x"', True), ("null", True), ("", False), ("{a:1}", False), (" 3 ", True)])
def test_strict_json(spark, text_, good):
    row = spark.createDataFrame([(text_,)], "t string").select(F.to_json(J.strict_json(F.col("t"))).alias("j")).first()
    assert (row.j is not None) == good and (not good or json.loads(row.j) == json.loads(text_))


# Closest records


def closest(left, right):
    out = {}
    for k, g, *v in left:
        near = [(sum(a != b for a, b in zip(v, w)), o) for o, h, *w in right if h == g and o != k]
        if near:
            out[k] = min(near)
    return {(k, o, n) for k, (n, o) in out.items()}


@pytest.mark.parametrize("most", [64, 0])
@pytest.mark.parametrize("fields", [1, 3, 5])
def test_closest_records(spark, monkeypatch, most, fields):
    """By sets of fields and by pigeonholes; with nulls, ties, equal records, keys on one side only and hot values."""
    monkeypatch.setattr(matching, "MOST_SETS", max(most, 1))
    rng = random.Random(fields)
    value = lambda: rng.choice(["a", "b", None, "a", str(rng.randint(0, 9))])
    make = lambda keys: [(k, rng.choice("xy"), *[value() for _ in range(fields)]) for k in keys]
    left, right = make(range(60)), make(range(30, 110))
    right += [(200 + i, *r[1:]) for i, r in enumerate(left[:10])] + [(300, "z", *["a"] * fields)]
    names = [f"f{i}" for i in range(fields)]
    schema = "k long, g string, " + ", ".join(f"{n} string" for n in names)
    one, two = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    found = matching.closest_records(one, two, ["g"], "k", "o", names)
    assert {tuple(r) for r in found.collect()} == closest(left, right)
    same = matching.closest_records(two, two, ["g"], "k", "o", names)
    assert {tuple(r) for r in same.collect()} == closest(right, right)


# Names


@pytest.mark.parametrize("seed", range(4))
def test_unique_names_in_order(spark, seed):
    rng = random.Random(seed)
    names = [rng.choice(["a", "a1", "a11", "a2", "a01", "b", "hot", "hot", "hot", "1", "", "x9", "x"]) for _ in range(400)]
    given = ["a3", "hot", "hot2", "x91"] if seed % 2 else []
    rows = spark.createDataFrame(list(enumerate(names)), "at long, n string").repartition(5)
    before = spark.createDataFrame([(g,) for g in given], "n string") if given else None
    found = {r.at: r.unique for r in naming.unique_names(rows, "n", ["at"], before).collect()}
    assert [found[i] for i in range(len(names))] == naming.in_order(names, tuple(given))


def test_unique_names_odd(spark):
    rows = spark.createDataFrame([(1, None, "u"), (2, "a", "v")], "at long, n string, row string")
    assert {(r.at, r.row) for r in naming.unique_names(rows, "n", ["at"]).collect()} == {(1, "u"), (2, "v")}
    assert naming.unique_names(rows.limit(0), "n", ["at"]).collect() == []


@pytest.mark.parametrize("name,short", [("StudentAcademicPortal", "sap"), ("plainname", "plainnam"), ("ABCDEFGHIJ", "ajbcdefg"), ("One", "o"), ("AlphaBetaGammaDeltaEpsilonZetaEtaThetaIota", "aliobgde"), ("", "")])
def test_short_name(spark, name, short):
    assert spark.range(1).select(text.short_name(F.lit(name)).alias("s")).first().s == short


# Prefix trees


def test_each_prefix_is_judged_once(spark):
    rng = random.Random(7)
    paths = [[rng.choice(["get_a", "get_b", "create_c"]) for _ in range(rng.randint(1, 6))] for _ in range(200)]
    steps = spark.createDataFrame([(i, j, t, i % 2) for i, p in enumerate(paths) for j, t in enumerate(p)], "id long, pos long, tool string, task long")
    args = ["id"], ["pos"], ["tool"]
    seen = []

    def judge(asked):
        seen.append(asked.count())
        with_past = pruning.history(asked, steps, *args)
        past = F.exists("history", lambda h: h["tool"] == F.col("tool"))
        return with_past.select("node", past.alias("redundant"), F.concat_ws(" ", F.lit("after"), F.size("history").cast("string")).alias("reason"))

    found, verdicts = pruning.judged(steps, *args, judge, task="task")
    prefixes = {(i % 2, tuple(p[: j + 1])) for i, p in enumerate(paths) for j in range(1, len(p)) if not p[j].startswith("create")}
    assert seen == [len(prefixes)] == [verdicts.count()]
    for r in found.collect():
        p, j = paths[r.id], r.pos
        if p[j].startswith("create"):
            want = (False, "state-changing")
        else:
            want = (j > 0 and p[j] in p[:j], f"after {j}" if j else "first")
        assert (r.redundant, r.reason) == want
    again, _ = pruning.judged(steps, *args, judge, task="task", cache=verdicts)
    assert seen[-1] == 0 and sorted(map(str, again.collect())) == sorted(map(str, found.collect()))


# Policies

PLAIN = """Be kind.
### Nothing else
is global? No.

### Tool: buy
- pays
Preconditions:
- signed in
- has money

view
----
shows
2) Sell
gives"""


def test_marked_and_unmarked_policies_agree(spark):
    tools = spark.createDataFrame([("Buy",), ("view",), ("sell",)], "name string")
    bare = spark.createDataFrame([(1, PLAIN), (2, "just rules"), (3, ""), (4, None)], "id long, policy string")
    found = policies.sections(bare, ["id"], "policy", tools)
    want = {(1, "_global", PLAIN.split("\n\n")[0]), (1, "Buy", PLAIN.split("\n\n")[1]), (1, "view", "view\n----\nshows"), (1, "sell", "2) Sell\ngives"), (2, "_global", "just rules")}
    assert {(r.id, r.tool, r.content) for r in found.collect()} == want
    marked = policies.with_markers(bare.filter("id = 1"), ["id"], "policy", tools)
    assert domains.has_markers(F.col("policy")) is not None and marked.filter(domains.has_markers(F.col("policy"))).count() == 1
    again = policies.sections(marked, ["id"], "policy")
    assert {(r.id, r.tool, r.content) for r in again.collect()} == {x for x in want if x[0] == 1}
    assert {r.tool for r in policies.tools_of_policies(marked, ["id"], "policy").collect()} == {"Buy", "view", "sell"}
    lists = policies.list_fields(found, ["id", "tool"], "content", ["preconditions", "Effects"]).collect()
    assert [(r.id, r.tool, r.field, r["items"]) for r in lists] == [(1, "Buy", "preconditions", ["signed in", "has money"])]


def test_stated_domains_are_linear(spark):
    """Many statements in one text take seconds, and the last one that replaces counts."""
    said = "\n".join(f"p{i % 9000} ∈ {{v{i}, 'w'}}" for i in range(20_000)) + "\ntags array of 2 to 5 things from: a, b"
    row = spark.createDataFrame([(said,)], "t string").select(domains.stated_domains(F.col("t")).alias("d")).first()
    found = {d.param: d for d in row.d}
    assert len(found) == 9001 and found["p5"]["values"] == ["v18005", "w"]
    assert (found["tags"].least, found["tags"].most, found["tags"]["values"]) == (2, 5, ["a", "b"])


def test_policy_sections_follow_the_pattern(spark):
    rng = random.Random(11)
    bits = ["<!-- TOOL: a -->", "<!-- TOOL_END: a -->", "<!-- TOOL: b.c -->", "<!-- TOOL_END: b.c -->", " text \n", "<!-- TOOL:  x -->", "-->", ""]
    texts = ["".join(rng.choices(bits, k=12)) for _ in range(300)]
    want = [[(m[1], m[2].strip(" \t\n\v\f\r")) for m in re.finditer(r"(?s)<!-- TOOL: (\S+) -->(.*?)<!-- TOOL_END: \1 -->", t)] for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", text.policy_sections(F.col("t")).alias("s")).collect()
    assert {r.i: [tuple(x) for x in r.s] for r in rows} == dict(enumerate(want))


# Intervals


def test_without_overlap(spark):
    rng = random.Random(5)
    at = lambda: rng.choice([None, *range(0, 60)])
    make = lambda n: [(i, rng.choice(["a", "b", None]), at(), at()) for i in range(n)] + [(n, "a", 0, 100_000), (n + 1, "b", 5, 5)]
    rows, taken = make(80)[:-2], make(25)[:25]
    schema = "id long, k string, lo long, hi long"
    for extra in ([], [(90, "a", -5000, 30)]):
        held = taken + extra
        meets = lambda r, t: None not in (r[1], t[1], r[2], r[3], t[2], t[3]) and r[1] == t[1] and r[2] < t[3] and t[2] < r[3]
        want = sorted(r[0] for r in [*rows, *rows[:3]] if not any(meets(r, t) for t in held))
        found = selection.without_overlap(spark.createDataFrame([*rows, *rows[:3]], schema), spark.createDataFrame(held, schema), ["k"], "lo", "hi", 7.0)
        assert sorted(r.id for r in found.collect()) == want and found.columns == ["id", "k", "lo", "hi"]



# Identities


def test_canonical_json_is_pythons(spark):
    rng = random.Random(12)
    whole = lambda v: [whole(x) for x in v] if isinstance(v, list) else {k: whole(x) for k, x in v.items()} if isinstance(v, dict) else v
    values = [whole(some_value(rng, 4)) for _ in range(300)]
    rows = spark.createDataFrame([(i, json.dumps(v, indent=rng.choice([None, 2]))) for i, v in enumerate(values)] + [(-1, "{broken"), (-2, None)], "id long, t string")
    found = {r.id: r.c for r in rows.select("id", hashing.canonical_json(F.col("t")).alias("c")).collect()}
    assert found.pop(-1) is None and found.pop(-2) is None
    assert all(found[i] == json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for i, v in enumerate(values))


def test_bag_digest_ignores_order_alone(spark):
    digest = lambda rows: spark.createDataFrame([(r,) for r in rows], "t string").repartition(3).agg(hashing.bag_digest(F.col("t")).alias("d")).first().d
    bag = ["a", "b", "b", None, "c"]
    assert digest(bag) == digest(bag[::-1]) == digest(["b", "c", "a", "", "b"])
    assert len({digest(x) for x in (bag, bag[1:], [*bag, "b"], ["a", "b", "c", None, "d"], ["ab", "b", "b", None, "c"])}) == 5

"""Value domains stated in policy text: enumerations, ranges, array choices and booleans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import global_rules, let, policy_sections

# Patterns by kind, in their order. A pattern marked True replaces what earlier ones say of its
# parameter, the others only add. Groups: the parameter, then the body; an array's are its counts and its choices.
DOMAIN_PATTERNS = (
    ("enum", r"(\w+)\s*[∈∊∋]\s*\{([^}]+)\}", True),
    ("enum", r"(?i)(\w+)\s+in\s+\{([^}]+)\}", False),
    ("enum_bar", r"(\w+):\s*(?:string\s*)?\(([^)]+(?:\|[^)]+)+)\)", False),
    ("range", r"(?i)(\w+)\s+(?:in|within)\s+\[([0-9.-]+,\s*[0-9.-]+)\]", True),
    ("range", r"(?i)(\w+)\s+(?:float|integer|int)\s+(?:in|within)\s+\[([0-9.-]+,\s*[0-9.-]+)\]", False),
    ("array_choice", r"(?i)(\w+)\s+(?:must be\s+)?(?:an?\s+)?array\s+of\s+(\d+)\s+to\s+(\d+).*?(?:from|chosen from)[:\s]*([^\n.]+)", True),
    ("boolean", r"(?i)(\w+)\s*(?:is|:)\s*(boolean)", False),
)


def stated_domains(text: Column) -> Column:
    """array of (param, kind, values, least, most) of all statements, one a parameter, sorted by it: the last of those that
    replace, or else the first of those that add. least and most are the counts of an array's choices. Each pattern
    goes over the text once a group, and one sort finds each parameter's statement."""
    every = F.concat(*[statements(text, place, *how) for place, how in enumerate(DOMAIN_PATTERNS)])
    # Sorted by parameter, then by falling rank: a parameter's first statement counts.
    ordered = F.array_sort(F.transform(every, lambda s: F.struct(s["param"].alias("param"), (-s["rank"]).alias("back"), s["kind"].alias("kind"), s["values"].alias("values"), s["least"].alias("least"), s["most"].alias("most"))))
    first = lambda rows: F.filter(rows, lambda s, i: (i == 0) | (F.get(rows, i - 1)["param"] != s["param"]))
    return F.transform(let(ordered, first), lambda s: F.struct(*[s[c].alias(c) for c in ("param", "kind", "values", "least", "most")]))


def statements(text: Column, place: int, kind: str, pattern: str, replaces: bool) -> Column:
    """array of (param, rank, kind, values, least, most) that one pattern finds."""
    groups = ("param", "least", "most", "body") if kind == "array_choice" else ("param", "body")
    found = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(name) for g, name in enumerate(groups, 1)])

    def stated(s: Column, i: Column) -> Column:
        rank = F.lit((1 << 40) + (place << 32)) + i if replaces else F.lit((1 << 39) - (place << 32)) - i
        count = lambda name: (s[name].try_cast("long") if name in groups else F.lit(None).cast("long")).alias(name)
        return F.struct(s["param"].alias("param"), rank.alias("rank"), F.lit(kind.split("_bar")[0]).alias("kind"), split_body(kind, s["body"]).alias("values"), count("least"), count("most"))

    return F.transform(found, stated)


def split_body(kind: str, body: Column) -> Column:
    """The values of an enumeration, the ends of a range, or the choices of an array."""
    if kind == "boolean":
        return F.array().cast("array<string>")
    if kind == "array_choice":
        return F.filter(F.transform(F.split(body, r"[,\s]+"), unquoted), lambda v: v != "")
    return F.transform(F.split(body, r"\|" if kind == "enum_bar" else ","), F.trim if kind == "enum_bar" else unquoted)


def unquoted(value: Column) -> Column:
    return F.regexp_replace(F.trim(value), "^[\"']+|[\"']+$", "")


def policy_domains(policies: DataFrame, key: str, policy: str = "policy") -> DataFrame:
    """key, tool, param, kind, values, least, most: the domains of the global rules (tool _global) and of each tool's section."""
    sections = F.concat(F.array(F.struct(F.lit("_global").alias("tool"), global_rules(F.col(policy)).alias("content"))), policy_sections(F.col(policy)))
    each = policies.select(key, F.explode(sections).alias("s"))
    return each.select(key, F.col("s.tool").alias("tool"), F.explode(stated_domains(F.col("s.content"))).alias("d")).select(key, "tool", "d.*")


def domain_for(domains: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """wanted (key, tool, param) plus kind, values, least and most: the tool's own domain, or else the global one."""
    stated = F.struct("kind", "values", "least", "most")
    own = wanted.join(domains.select(key, "tool", "param", stated.alias("own")), [key, "tool", "param"], "left")
    everywhere = domains.filter("tool = '_global'").select(key, "param", stated.alias("everywhere"))
    return own.join(everywhere, [key, "param"], "left").select(key, "tool", "param", F.coalesce("own", "everywhere").alias("d")).select(key, "tool", "param", "d.*")


def has_markers(policy: Column) -> Column:
    return F.contains(policy, F.lit("<!-- POLICY_START -->")) | F.contains(policy, F.lit("<!-- TOOL:"))


def tool_names(policy: Column) -> Column:
    """Tools that have a section, in order, once each."""
    return F.array_distinct(F.regexp_extract_all(policy, F.lit(r"<!-- TOOL: (\S+) -->"), F.lit(1)))


def marked_policy_for(policy: Column, trajectory: Column) -> Column:
    """The global part and the trajectory's sections with their markers, closed by the end marker."""
    head = F.regexp_extract(policy, r"(?s)(<!-- POLICY_START -->.*?<!-- GLOBAL_RULES_END -->)", 1)
    section = lambda tool: F.call_function("regexp_extract", policy, F.concat(F.lit(r"(?s)(<!-- TOOL: \Q"), tool, F.lit(r"\E -->.*?<!-- TOOL_END: \Q"), tool, F.lit(r"\E -->)")), F.lit(1))
    parts = F.filter(F.transform(trajectory, section), lambda x: x != "")
    body = F.concat(head, F.lit("\n\n"), F.array_join(parts, "\n\n"))
    return F.when(F.endswith(F.trim(body), F.lit("<!-- POLICY_END -->")), body).otherwise(F.concat(body, F.lit("\n<!-- POLICY_END -->")))


def field_of(text: Column, name: str) -> Column:
    """The text after `**name**:` or `name:` up to the line's end."""
    return F.trim(F.regexp_extract(text, rf"(?i)\*{{0,2}}{name}\*{{0,2}}:\*{{0,2}}[ \t]*([^\n]*)", 1))

"""Policies as rows: sections by markers, or by headers where there are none, and the lists they hold.

A policy's text is cut into line rows; headers are found line by line, and a running count of them over the policy's
lines numbers its sections. A window holds the lines of one policy, which is one row of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.domains import has_markers
from weftline.functions.text import global_rules, policy_sections, stripped

# Headers of tools. The third needs a rule of - or = below.
MARKED_HEADER = r"(?i)^\s*###?\s*(?:Tool\b[:\s]*)?(?:\d+\)\s*)?(\w+)"
NUMBERED_HEADER = r"^\s*\d+\)\s*(\w+)"
RULED_HEADER = r"^\s*(\w+)\s*$"
RULE = r"^\s*[-=]+\s*$"
BULLET = r"^\s*[-•]\s*(\S.*)$"


def lines(policies: DataFrame, key: list[str], policy: str) -> DataFrame:
    """key, pos, line of every line, from 0."""
    return policies.select(*key, F.posexplode(F.split(policy, r"\r?\n")).alias("pos", "line"))


def header_name(line: Column, below: Column) -> Column:
    """The name that a header line gives; null for other lines."""
    name = lambda pattern: F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))
    ruled = F.when(F.coalesce(below.rlike(RULE), F.lit(False)), name(RULED_HEADER))
    return F.coalesce(name(MARKED_HEADER), name(NUMBERED_HEADER), ruled)


def sections_by_header(policies: DataFrame, key: list[str], policy: str, tools: DataFrame | None = None) -> DataFrame:
    """key, place, tool, content: what stands before the first tool (tool `_global`, place 0), and each tool's section with
    its header, up to the next header. tools (name): the tools there are; a header with another name ends a section and
    begins none. Without it every header is a tool's. The first of several sections of a tool counts."""
    rows = lines(policies, key, policy)
    ordered = Window.partitionBy(*key).orderBy("pos")
    rows = rows.withColumn("name", header_name(F.col("line"), F.lead("line").over(ordered)))
    if tools is None:
        rows = rows.withColumn("tool", F.col("name"))
    else:
        known = tools.groupBy(F.lower("name").alias("low")).agg(F.min("name").alias("tool"))
        rows = rows.withColumn("low", F.lower("name")).join(known, "low", "left").drop("low")
    rows = rows.withColumn("section", F.count("name").over(ordered)).withColumn("tools_before", F.count("tool").over(ordered))
    place = F.when(F.col("tools_before") == 0, F.lit(0)).otherwise(F.col("section"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    made = rows.groupBy(*key, place.alias("place")).agg(F.first("tool", ignorenulls=True).alias("tool"), stripped(text).alias("content"))
    made = made.withColumn("tool", F.when(F.col("place") == 0, F.lit("_global")).otherwise(F.col("tool"))).filter(F.col("tool").isNotNull())
    first = F.row_number().over(Window.partitionBy(*key, "tool").orderBy("place"))
    return made.withColumn("__n", first).filter("__n = 1").select(*key, F.col("place").cast("long").alias("place"), "tool", "content")


def sections_by_marker(policies: DataFrame, key: list[str], policy: str) -> DataFrame:
    """key, place, tool, content: the global rules (`_global`, place 0), and the marked sections by number."""
    both = F.concat(F.array(F.struct(F.lit("_global").alias("tool"), global_rules(F.col(policy)).alias("content"))), policy_sections(F.col(policy)))
    return policies.select(*key, F.posexplode(both).alias("place", "s")).select(*key, F.col("place").cast("long").alias("place"), "s.tool", "s.content")


def sections(policies: DataFrame, key: list[str], policy: str, tools: DataFrame | None = None) -> DataFrame:
    """key, place, tool, content of all policies: by markers where a policy has some, else by headers; places count in order."""
    marked = has_markers(F.col(policy))
    found = sections_by_marker(policies.filter(marked), key, policy).unionByName(sections_by_header(policies.filter(~marked), key, policy, tools))
    found = found.filter((F.col("tool") != "_global") | (F.col("content") != ""))
    return found.withColumn("place", (F.row_number().over(Window.partitionBy(*key).orderBy("place")) - 1).cast("long"))


def tools_of_policies(policies: DataFrame, key: list[str], policy: str) -> DataFrame:
    """key, tool: the tools that a policy's markers name, or else its headers."""
    return sections(policies, key, policy).filter("tool <> '_global'").select(*key, "tool").distinct()


def list_fields(found: DataFrame, key: list[str], content: str, fields: list[str]) -> DataFrame:
    """key, field, items: the bullets right below a line that names the field, in order; the first such list of a field counts.
    Bullets are numbered by the other lines before them, so that those of one list share a number with its head."""
    rows = lines(found, key, content)
    ordered = Window.partitionBy(*key).orderBy("pos")
    item = F.nullif(F.regexp_extract("line", BULLET, 1), F.lit(""))
    named = F.lower(F.regexp_extract("line", r"^[\s*#]*(.*?)[\s*]*:?[\s*]*$", 1))
    rows = rows.withColumn("item", F.trim(item)).withColumn("part", F.count(F.when(F.col("item").isNull(), 1)).over(ordered))
    head = F.max(F.when(F.col("item").isNull(), named)).over(Window.partitionBy(*key, "part"))
    listed = rows.withColumn("head", head).filter(F.col("item").isNotNull())
    wanted = found.sparkSession.createDataFrame([(f, f.lower()) for f in fields], "field string, head string")
    of_field = listed.join(F.broadcast(wanted), "head")
    first = F.min("part").over(Window.partitionBy(*key, "field"))
    kept = of_field.withColumn("first", first).filter("part = first")
    items = F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"])
    return kept.groupBy(*key, "field").agg(items.alias("items"))


def with_markers(policies: DataFrame, key: list[str], policy: str, tools: DataFrame) -> DataFrame:
    """key, policy: each policy with markers; one that has some stays as it is."""
    bare = sections_by_header(policies.filter(~has_markers(F.col(policy))), key, policy, tools)
    own = F.when(F.col("tool") == "_global", F.concat("content", F.lit("\n<!-- GLOBAL_RULES_END -->"))).otherwise(
        F.concat(F.lit("\n<!-- TOOL: "), "tool", F.lit(" -->\n"), "content", F.lit("\n<!-- TOOL_END: "), "tool", F.lit(" -->"))
    )
    kept = bare.filter((F.col("tool") != "_global") | (F.col("content") != "")).select(*key, "place", own.alias("part"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda x: x["part"]), "\n")
    made = kept.groupBy(*key).agg(F.concat(F.lit("<!-- POLICY_START -->\n"), body, F.lit("\n\n<!-- POLICY_END -->")).alias(policy))
    return made.unionByName(policies.filter(has_markers(F.col(policy))).select(*key, policy))

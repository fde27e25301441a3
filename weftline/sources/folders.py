"""Datasets that lie in folders by naming rules: what a file is, and of what, stands in its path.

Every reader derives these from `_metadata.file_path`. A filter on them (a server, a domain, a set of fused domains) is
a filter on file metadata, which Spark applies while it lists the files: the others are never opened. Whole-file
JSON is parsed once; what can't be parsed is a row of `bad` in the readers that return two tables, and nothing in
the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.hashing import trajectory_hash
from weftline.functions.text import known_domains
from weftline.sources.readers import with_policies

NAME = r"([^/]*)$"


def at_path(pattern: str, group: int = 1) -> Column:
    """Part of a file's path, percent signs decoded."""
    return F.regexp_extract(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), pattern, group)


def folder_name(up: int = 1) -> Column:
    """The name of the folder that a file lies in, or of one further up."""
    return at_path(r"([^/]+)" + r"/[^/]*" * up + "$")


def stem() -> Column:
    return at_path(r"([^/]*?)(?:\.[^./]*)?$")


def listed(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """path, folder, file, stem, size of the files under a path; their contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.select("path", folder_name().alias("folder"), at_path(NAME).alias("file"), stem().alias("stem"), F.col("length").alias("size"))


def whole_files(spark: SparkSession, path: str, glob: str, where: Column | None = None, **named: Column) -> DataFrame:
    """text of each file, and the named parts of its path. where: a condition on these parts."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    rows = read.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"), *[c.alias(n) for n, c in named.items()])
    return rows if where is None else rows.filter(where)


def validated_combos(spark: SparkSession, path: str, schema: str = "combo_id string, trajectory_hash string, entity_instances map<string,string>", where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(domain, sample_idx and the fields of schema for each combo of <domain>/validated_combos.json; domain, file of files
    that hold no array). sample_idx is the place in the file. where: a condition on domain."""
    files = whole_files(spark, path, "validated_combos.json", where, domain=folder_name())
    read = files.withColumn("combos", F.from_json("text", f"array<struct<{schema}>>"))
    rows = read.select("domain", F.posexplode("combos").alias("sample_idx", "c")).select("domain", "sample_idx", "c.*")
    return rows, read.filter(F.col("combos").isNull()).select("domain", "file")


TASK = "trajectory array<string>, trajectory_hash string, task_template variant, combos array<variant>"


def trajectory_tasks(spark: SparkSession, path: str, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(server, trajectory, trajectory_hash, task_template, combos, file of <server>/<hash>.json, where trajectory and combos hold
    anything; server, file of files that are no such object). Files whose names begin with _ are no tasks. where: a
    condition on server and hash, the file's name."""
    files = whole_files(spark, path, "[!_]*.json", where, server=folder_name(), hash=stem())
    read = files.withColumn("t", F.from_json("text", TASK))
    filled = (F.size("t.trajectory") > 0) & (F.size("t.combos") > 0)
    return read.filter(filled).select("server", "t.*", "file"), read.filter(F.col("t.trajectory").isNull()).select("server", "file")


def template_tasks(spark: SparkSession, path: str, policies: DataFrame, where: Column | None = None) -> DataFrame:
    """server, template_idx, trajectory, template, policy, trajectory_hash for each template of <server>.json that has a
    trajectory; policies: name, text."""
    files = whole_files(spark, path, "*.json", where, server=stem())
    each = files.select("server", F.posexplode(F.from_json("text", "templates array<variant>")["templates"]).alias("template_idx", "template"))
    rows = each.withColumn("trajectory", F.try_variant_get("template", "$.trajectory", "array<string>")).filter(F.size("trajectory") > 0)
    return with_policies(rows, policies).withColumn("trajectory_hash", trajectory_hash(F.col("trajectory")))


def sampling_codes(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """server, trajectory_hash, code, constraint_analysis (VARIANT) of codes <server>/<hash>.py that have their <hash>.json; one
    without the other, or with one that can't be parsed, is none. where: a condition on server and trajectory_hash."""
    part = lambda glob: whole_files(spark, path, glob, where, server=folder_name(), trajectory_hash=stem())
    meta = part("*.json").select("server", "trajectory_hash", F.try_parse_json("text").alias("meta")).filter(F.schema_of_variant("meta").startswith("OBJECT"))
    analysis = F.coalesce(F.try_variant_get("meta", "$.constraint_analysis", "variant"), F.parse_json(F.lit("{}")))
    return part("*.py").select("server", "trajectory_hash", F.col("text").alias("code")).join(meta.select("server", "trajectory_hash", analysis.alias("constraint_analysis")), ["server", "trajectory_hash"])


def index_entries(spark: SparkSession, path: str, glob: str = "*index.json") -> DataFrame:
    """hash, entry (VARIANT) of index files, which are objects by hash; a file that can't be parsed has none."""
    files = whole_files(spark, path, glob)
    return files.select(F.explode(F.from_json("text", "map<string,variant>")).alias("hash", "entry"))


def query_files(spark: SparkSession, path: str) -> DataFrame:
    """domain, file, path, is_combined of <domain>/*.jsonl."""
    found = listed(spark, path, "*.jsonl")
    return found.select(F.col("folder").alias("domain"), "file", "path", (F.col("file") == "queries.jsonl").alias("is_combined"))


def combinations(spark: SparkSession, queries: str, policies: str | None = None, known: list[str] = (), min_domains: int = 2, require_policy: bool = False, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """name, domains, path, policy_path: query files whose fused names hold min_domains domains or more. known: domains that are
    looked for in a name; without them its parts are the domains. A policy file belongs to a combination if its name
    holds the same domains in any order, the first by path. include and exclude: domains one of which must, none
    may, be among them."""
    split = lambda name: known_domains(name, F.array(*[F.lit(k) for k in known])) if known else F.split(name, "_")
    domain_set = lambda: F.array_sort(F.array_distinct("domains"))
    files = listed(spark, queries, "*.json*").withColumn("name", F.substring_index("file", ".", 1)).withColumn("domains", split(F.col("name")))
    rows = files.filter(F.contains("name", F.lit("_")) & (F.size("domains") >= min_domains)).withColumn("domain_set", domain_set())
    arrays = lambda names: F.array(*[F.lit(n) for n in names])
    if include:
        rows = rows.filter(F.arrays_overlap("domain_set", arrays(include)))
    if exclude:
        rows = rows.filter(~F.arrays_overlap("domain_set", arrays(exclude)))
    if policies is None:
        found = rows.withColumn("policy_path", F.lit(None).cast("string"))
    else:
        held = listed(spark, policies, "*.md").withColumn("domains", split(F.col("stem"))).withColumn("domain_set", domain_set())
        found = rows.join(held.groupBy("domain_set").agg(F.min("path").alias("policy_path")), "domain_set", "left")
    if require_policy:
        found = found.filter(F.col("policy_path").isNotNull())
    return found.select("name", "domains", "path", "policy_path")


def entity_and_relationship_names(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """kind, name: the distinct names of both, null and empty ones left out."""
    kinds = {"entity": entities, "relationship": relationships}
    parts = [rows.select(F.lit(kind).alias("kind"), F.trim("name").alias("name")) for kind, rows in kinds.items()]
    return reduce(DataFrame.unionByName, parts).filter(F.col("name") != "").distinct()

"""Files of the dataset as DataFrames, with explicit schemas and quarantined bad lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOOL_CALLS = "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"
ROLLOUT = f"id string, messages array<struct<role:string,content:string,reasoning_content:string,tool_calls:{TOOL_CALLS},tool_call_id:string>>, success boolean, error string, stopped boolean, transferred boolean, out_of_scope boolean, total_turns int, stop_reason string"
QUERY = "id string, messages array<struct<role:string,content:string>>, user_system_prompt string, task_info struct<trajectory:array<string>,instruction:string,reason_for_call:string,known_info:string,trajectory_hash:string,combo_id:string>"


def json_documents(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Whole-file JSON; an array gives a row for each element."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, lines that are no JSON or break the schema, with their files). Blank lines are neither."""
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file")).filter(F.trim("value") != "")
    read = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.withColumn("r", read)
    bad = F.col("r._corrupt_record").isNotNull() | F.col("r").isNull()
    return rows.filter(~bad).select("r.*", "file").drop("_corrupt_record"), rows.filter(bad).select("value", "file")


def rollouts(spark: SparkSession, folder: str) -> DataFrame:
    """*.jsonl line by line and *.json as documents."""
    lines = spark.read.schema(ROLLOUT).option("pathGlobFilter", "*.jsonl").option("mode", "DROPMALFORMED").json(folder)
    return lines.unionByName(spark.read.schema(ROLLOUT).option("pathGlobFilter", "*.json").option("multiLine", True).json(folder))


def queries(spark: SparkSession, path: str) -> DataFrame:
    """Task queries, a JSON object a line: the file's name is the domain key, its parts the domains; of equal ids the last
    line of the last file stays. Lines are in the order of their part of the file and their place in it. Lines that are no
    JSON or have no id are left out."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("line"))
    rows = lines.select("file", "part", "line", F.from_json("value", QUERY).alias("q")).filter(F.col("q.id").isNotNull())
    newest = F.row_number().over(Window.partitionBy("q.id").orderBy(F.desc("file"), F.desc("part"), F.desc("line")))
    last = rows.withColumn("__n", newest).filter("__n = 1").select("q.*", "file")
    named = last.withColumn("domain_key", F.regexp_extract("file", r"^(.*?)(\.jsonl?)?$", 1)).withColumn("domains", F.split("domain_key", "_"))
    return named.select("*", "task_info.*").drop("task_info")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """name (of the file, without extension), text."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1).alias("name"), F.col("value").alias("text"))


def with_policies(rows: DataFrame, policies: DataFrame, server: str = "server") -> DataFrame:
    """rows plus policy; a missing one is empty."""
    return rows.join(policies.select(F.col("name").alias(server), F.col("text").alias("policy")), server, "left").withColumn("policy", F.coalesce("policy", F.lit("")))


def samples(rollout: DataFrame, query: DataFrame, combos: DataFrame) -> DataFrame:
    """Rollouts with their queries and the first combo of (domain_key, combo_id); empty lists count as missing."""
    first = combos.groupBy("domain_key", "combo_id").agg(F.min_by(F.struct(*[c for c in combos.columns if c not in ("domain_key", "combo_id")]), "sample_idx").alias("combo"))
    joined = rollout.join(query.select("id", "domain_key", "combo_id", F.col("trajectory").alias("query_trajectory")), "id", "left").join(first, ["domain_key", "combo_id"], "left")
    usable = F.when(F.size("query_trajectory") > 0, F.col("query_trajectory"))
    return joined.withColumn("trajectory", F.coalesce(usable, F.array().cast("array<string>"))).drop("query_trajectory")


def pending(tasks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return tasks.join(done.select(key).distinct(), key, "left_anti")


def blueprints(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row for each blueprint of files that hold an array of them, or an object with the array under `blueprints`."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.trim("value").alias("text"))
    inner = F.when(F.startswith("text", F.lit("[")), F.col("text")).otherwise(F.get_json_object("text", "$.blueprints"))
    return whole.select("file", F.explode(F.from_json(inner, f"array<struct<{schema}>>")).alias("b")).select("file", "b.*")


def by_server(rows: DataFrame, name: str = "MCP_server_name") -> DataFrame:
    """One row a server, the last by file."""
    return rows.groupBy(name).agg(F.max_by(F.struct(*[c for c in rows.columns if c != name]), "file").alias("r")).select(name, "r.*")


def tools_of(servers: DataFrame, tools: DataFrame) -> DataFrame:
    """servers plus tools; a server without a list has an empty one."""
    empty = F.array().cast(tools.schema["tools"].dataType)
    return servers.join(tools.select("server", "tools"), "server", "left").withColumn("tools", F.coalesce("tools", empty))


def summaries(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """server, summary: the texts of a server's names (server, name), sorted by name, a blank line between."""
    rows = wanted.select("server", "name").distinct().join(texts, "name")
    ordered = F.array_sort(F.collect_list(F.struct("name", "text")))
    return rows.groupBy("server").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("summary"))


def processed(queries_: DataFrame) -> DataFrame:
    """combo ids that have a query already."""
    return queries_.select("combo_id").filter(F.col("combo_id").isNotNull()).distinct()


def completed_trajectories(combos: DataFrame, is_cross: bool) -> DataFrame:
    """name, trajectory of those done in one mode, once each."""
    return combos.filter(F.coalesce("is_cross_domain", F.lit(False)) == is_cross).select("name", "trajectory").distinct()


def validated_hashes(combos: DataFrame) -> DataFrame:
    """domain, trajectory_hash of single domains; fused names hold an underscore."""
    return combos.filter(~F.contains("domain", F.lit("_"))).select("domain", "trajectory_hash").distinct()


def entity_context(combos: DataFrame) -> DataFrame:
    """combos plus context: instances and value domains, empty where missing."""
    none = F.create_map().cast("map<string,string>")
    return combos.withColumn("context", F.struct(F.coalesce("entity_instances", none).alias("entity_instances"), F.coalesce("value_domains", none).alias("value_domains")))

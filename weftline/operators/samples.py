"""Samples, task definitions and rollouts in the shapes that evaluators take and give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.lenient_json import strict_json
from weftline.functions.text import bare_tool

# Checks of conversational quality by name.
QUALITY_CHECKS = {
    "professional_tone": "The assistant maintained a professional and helpful tone throughout the conversation",
    "clear_instructions": "The assistant provided clear and understandable instructions or responses",
    "error_handling": "When errors occurred, the assistant explained them clearly and offered solutions",
    "information_complete": "The assistant provided all relevant information without unnecessary omissions",
    "no_hallucination": "The assistant did not make claims or provide information not supported by the available data",
    "appropriate_confirmation": "The assistant appropriately confirmed important actions before executing them",
    "context_awareness": "The assistant demonstrated awareness of previous context in the conversation",
}


def call_arguments(arguments: Column) -> Column:
    """The arguments of a call as VARIANT; a text that is no JSON gives an empty object, as does a missing one."""
    return F.coalesce(strict_json(arguments), F.parse_json(F.lit("{}")))


def tool_calls(messages: DataFrame, key: list[str], with_ids: bool = False) -> DataFrame:
    """key, pos, at, name, arguments, and tool_call_id if asked for: the calls of assistant messages, in order. messages: key, pos,
    role, tool_calls (id, function(name, arguments)). With ids, names keep the prefix of their domain, by which
    calls are routed; without, they lose it. Calls without a function are none."""
    rows = messages.filter("role = 'assistant'").select(*key, "pos", F.posexplode("tool_calls").alias("at", "call")).filter(F.col("call.function").isNotNull())
    name = F.coalesce(F.col("call.function.name"), F.lit(""))
    columns = [(name if with_ids else bare_tool(name)).alias("name"), call_arguments(F.col("call.function.arguments")).alias("arguments")]
    return rows.select(*key, "pos", "at", *columns, *([F.col("call.id").alias("tool_call_id")] if with_ids else []))


def calls_of_samples(samples: DataFrame, messages: DataFrame, key: list[str]) -> DataFrame:
    """key, pos, at, name, arguments: the calls that a sample has stored (rollout_tool_calls: name, arguments), if there are any,
    else those of its messages."""
    stored = samples.filter(F.coalesce(F.size("rollout_tool_calls"), F.lit(0)) > 0)
    own = stored.select(*key, F.posexplode("rollout_tool_calls").alias("at", "call")).select(*key, F.lit(0).alias("pos"), "at", "call.name", call_arguments(F.col("call.arguments")).alias("arguments"))
    rest = messages.join(stored.select(*key), key, "left_anti").join(samples.select(*key), key, "left_semi")
    return own.unionByName(tool_calls(rest, key).select(*key, F.col("pos").cast("int").alias("pos"), "at", "name", "arguments"))


def task_definitions(tasks: DataFrame) -> DataFrame:
    """task_id, trajectory, entity_context, instruction, reason_for_call, domains, is_cross_domain, nl_assertions from task files:
    task_id, trajectory, entity_context, instantiated_task and template (instruction, reason_for_call; the first also
    nl_assertions), domains, is_cross_domain, nl_assertions. What the instantiated task lacks comes from the template,
    its assertions from the task; a task without id gets a digest of its content."""
    none = F.array().cast("array<string>")
    made = F.substring(F.md5(F.to_json(F.struct(*sorted(tasks.columns)))), 1, 12)
    inner = F.col("instantiated_task")
    text = lambda name: F.coalesce(inner[name], F.col("template")[name], F.lit("")).alias(name)
    filled = F.when(F.size(inner["nl_assertions"]) > 0, inner["nl_assertions"]).otherwise(F.coalesce("nl_assertions", none))
    return tasks.select(
        F.coalesce(F.nullif("task_id", F.lit("")), made).alias("task_id"),
        F.coalesce("trajectory", none).alias("trajectory"),
        "entity_context",
        text("instruction"),
        text("reason_for_call"),
        F.coalesce("domains", none).alias("domains"),
        F.coalesce("is_cross_domain", F.lit(False)).alias("is_cross_domain"),
        filled.alias("nl_assertions"),
    )


def with_quality_checks(tasks: DataFrame, checks: list[str]) -> DataFrame:
    """tasks with the named checks' sentences after their own assertions; names that are no checks are passed over."""
    added = F.array(*[F.lit(QUALITY_CHECKS[c]) for c in checks if c in QUALITY_CHECKS]).cast("array<string>")
    return tasks.withColumn("nl_assertions", F.concat(F.coalesce("nl_assertions", F.array().cast("array<string>")), added))


def flat_results(results: DataFrame) -> DataFrame:
    """id, messages, success, error and the fields of metadata (a struct), which replace columns of these names."""
    fields = results.schema["metadata"].dataType.names
    own = [(c, F.col(c)) for c in ("id", "messages", "success", "error")]
    return results.select(*[c.alias(n) for n, c in own if n not in fields], *[F.col(f"metadata.`{f}`").alias(f) for f in fields])


def graph_dictionary(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, is_person, attributes, description; source, target, relationship, description): a graph in the node-link layout, one row
    each. A link whose ends are no nodes goes; missing descriptions are empty. `graph_document` makes one document of both."""
    shown = nodes.select("id", F.coalesce("is_person", F.lit(False)).alias("is_person"), "attributes", F.coalesce("description", F.lit("")).alias("description"))
    ends = nodes.select("id").distinct()
    kept = links.join(ends.withColumnRenamed("id", "source"), "source", "left_semi").join(ends.withColumnRenamed("id", "target"), "target", "left_semi")
    return shown, kept.select("source", "target", "relationship", F.coalesce("description", F.lit("")).alias("description"))


def graph_document(nodes: DataFrame, links: DataFrame, graph: str) -> DataFrame:
    """graph, document: the JSON of each graph (nodes and links carry its name), for graphs of bounded size; the nodes by id, the
    links by their ends."""
    listed = lambda rows, columns, name: rows.groupBy(graph).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    both = listed(nodes, ["id", "is_person", "description"], "nodes").join(listed(links, ["source", "target", "relationship", "description"], "links"), graph, "left")
    empty = F.array().cast(both.schema["links"].dataType)
    return both.select(graph, F.to_json(F.struct("nodes", F.coalesce("links", empty).alias("links"))).alias("document"))


def graph_tables(documents: DataFrame, graph: str) -> tuple[DataFrame, DataFrame]:
    """(graph and node columns; graph and link columns) of the documents that `graph_document` makes."""
    schema = "nodes array<struct<id:string,is_person:boolean,description:string>>, links array<struct<source:string,target:string,relationship:string,description:string>>"
    read = documents.select(graph, F.from_json("document", schema).alias("d"))
    part = lambda name: read.select(graph, F.explode(f"d.{name}").alias("x")).select(graph, "x.*")
    return part("nodes"), part("links")


def extracted_entities(answers: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Entities of a model's answer (name ...) without `Session`, which no server may have, and without names that aren't known."""
    kept = answers.filter(F.coalesce(F.trim("name"), F.lit("")) != "").filter("name <> 'Session'")
    return kept if known is None else kept.join(known.select("name").distinct(), "name", "left_semi")


def newest_checkpoints(checkpoints: DataFrame, status: str | None = None) -> DataFrame:
    """Checkpoints, of one status if asked for, the last updated first."""
    rows = checkpoints if status is None else checkpoints.filter(F.col("status") == status)
    return rows.orderBy(F.desc("updated_at"), "trajectory_id")

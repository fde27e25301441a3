"""Server blueprints and tool lists: nested columns in, nested columns out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Type names and what JSON schema calls them.
JSON_TYPES = {"str": "string", "string": "string", "int": "integer", "integer": "integer", "float": "number", "number": "number", "bool": "boolean", "boolean": "boolean", "list": "array", "array": "array", "dict": "object", "object": "object"}


def json_type(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in JSON_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(name)), F.lit("string"))


def tool_list(functions: Column, only_required: bool = False) -> Column:
    """Functions with parameter maps as function-calling tools. All parameters count as required,
    or, with only_required, those that say so, and their ranges are added to the descriptions."""

    def tool(f: Column) -> Column:
        params = f["parameters"]
        about = lambda v: F.concat(v["description"], F.when(v["range"].isNotNull(), F.concat(F.lit(" (range: "), v["range"], F.lit(")"))).otherwise("")) if only_required else v["description"]
        props = F.transform_values(params, lambda k, v: F.struct(json_type(v["type"]).alias("type"), about(v).alias("description")))
        required = F.map_keys(F.map_filter(params, lambda k, v: F.coalesce(v["required"], F.lit(False)))) if only_required else F.map_keys(params)
        schema = F.struct(F.lit("object").alias("type"), props.alias("properties"), F.array_sort(required).alias("required"))
        return F.struct(F.lit("function").alias("type"), F.struct(f["name"].alias("name"), f["description"].alias("description"), schema.alias("parameters")).alias("function"))

    return F.transform(functions, tool)


def tool_index(tools: DataFrame, server: str, name: str) -> DataFrame:
    """Tools by bare and by prefixed name."""
    prefixed = tools.withColumn("key", F.concat_ws(".", server, name))
    return tools.withColumn("key", F.col(name)).unionByName(prefixed)


def routes(tools: DataFrame, server: str, name: str, order: str) -> DataFrame:
    """name, home (the first server by order), shared (more than one has it)."""
    return tools.groupBy(name).agg(F.min_by(server, F.struct(order, server)).alias("home"), (F.count_distinct(server) > 1).alias("shared"))


def calls_of(messages: DataFrame, key: str = "id") -> DataFrame:
    """One row a tool call of an assistant or tool message: pos, call, name without its prefix, arguments as JSON text ({} if malformed)."""
    rows = messages.select(key, F.posexplode("messages").alias("pos", "m")).filter(F.col("m.role").isin("assistant", "tool"))
    calls = rows.select(key, "pos", F.posexplode("m.tool_calls").alias("call", "c"))
    arguments = F.coalesce(F.to_json(F.try_parse_json("c.function.arguments")), F.lit("{}"))
    return calls.select(key, "pos", "call", F.element_at(F.split("c.function.name", r"\."), -1).alias("name"), arguments.alias("arguments"))


def relation_tuples(blueprints: DataFrame) -> DataFrame:
    return blueprints.select("MCP_server_name", F.explode("relationships").alias("r")).select("MCP_server_name", "r.name", "r.attributes")


def all_tools(rows: DataFrame, key: str = "server") -> DataFrame:
    """key, tool: lists of tools and single ones (columns tools and tool) as rows."""
    every = F.concat(F.coalesce("tools", F.array().cast("array<string>")), F.array_compact(F.array("tool")))
    return rows.select(key, F.explode(every).alias("tool"))


def with_eval_markers(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """One row a parameter (server, function, param, ...) plus ignore_in_eval and param_category, where a
    classification (server, function, param, ignore, category) has one."""
    found = classes.select("server", "function", "param", F.col("ignore").alias("ignore_in_eval"), F.col("category").alias("param_category"))
    return functions.join(found, ["server", "function", "param"], "left").withColumn("ignore_in_eval", F.coalesce("ignore_in_eval", F.lit(False)))


def routed_calls(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """calls (name) plus server: the tool of the full name first, then of the short name, then any tool of the
    server that the name begins with; null if none. Short names of several servers go to the first by name."""
    full = tools.select(F.concat_ws(".", "server", "name").alias("full"), F.col("server").alias("by_full")).distinct()
    short = tools.groupBy(F.col("name").alias("short")).agg(F.min("server").alias("by_short"))
    servers = tools.select(F.col("server").alias("prefix"), F.col("server").alias("by_server")).distinct()
    own = calls.withColumns({"full": F.col("name"), "short": F.element_at(F.split("name", r"\."), -1), "prefix": F.split("name", r"\.")[0]})
    found = own.join(full, "full", "left").join(short, "short", "left").join(servers, "prefix", "left")
    return found.select(*calls.columns, F.coalesce("by_full", "by_short", "by_server").alias("server"))


def offered_tools(mode: Column, right: Column, wrong: Column) -> Column:
    """The tools that a sample's mode lets a model see."""
    none = F.array().cast("array<string>")
    return F.when(mode == "positive", right).when(mode == "wrong_tool", wrong).otherwise(none)


def bound_values(wanted: DataFrame, samples: DataFrame, fields: DataFrame) -> DataFrame:
    """wanted (id, key `Server.tool.param`) plus value, source, confirmed: the sample of the exact key, or else the
    entity field of the parameter's name, or else, for a name that ends in _id, a field whose name ends alike;
    confirm is always true."""
    param = F.element_at(F.split("key", r"\."), -1)
    own = wanted.withColumn("param", param)
    exact = samples.select("id", "key", F.col("value").alias("exact"))
    named = fields.groupBy("id", F.col("field").alias("param")).agg(F.min("value").alias("named"))
    tail = F.element_at(F.split(F.regexp_replace("param", "_id$", ""), "_"), -1)
    alike = fields.filter(F.endswith("field", F.lit("_id"))).withColumn("param", F.col("field")).groupBy("id", tail.alias("tail")).agg(F.min("value").alias("alike"))
    found = own.withColumn("tail", F.when(F.endswith("param", F.lit("_id")), tail)).join(exact, ["id", "key"], "left").join(named, ["id", "param"], "left").join(alike, ["id", "tail"], "left")
    is_confirm = F.col("param") == "confirm"
    value = F.coalesce("exact", "named", "alike", F.when(is_confirm, "true"))
    source = F.when(F.col("exact").isNotNull(), "sample").when(F.col("named").isNotNull(), "field").when(F.col("alike").isNotNull(), "alike").when(is_confirm, "fixed")
    return found.select("id", "key", value.alias("value"), source.alias("source"))

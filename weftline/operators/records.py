"""Records of database states: normal forms, digests, comparisons, identities of created rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def json_text(value: Column, kind: str) -> Column:
    """A scalar as JSON in its normal form: strings in lower case, fractions rounded to two places."""
    if kind == "string":
        return F.coalesce(F.to_json(F.array(F.lower(value))).substr(F.lit(2), F.length(F.to_json(F.array(F.lower(value)))) - 2), F.lit("null"))
    if kind in ("double", "float"):
        text = F.round(value, 2).cast("decimal(38,2)").cast("string")
        return F.coalesce(F.regexp_replace(text, "0$", ""), F.lit("null"))
    return F.coalesce(F.lower(value.cast("string")), F.lit("null"))


def normal_form(record: dict[str, tuple[Column, str]], left_out: Column | None = None) -> Column:
    """map<string,string> of the fields' JSON texts, by (value, type); left_out: names that a comparison ignores."""
    pairs = [F.struct(F.lit(k).alias("key"), json_text(v, kind).alias("value")) for k, (v, kind) in record.items()]
    kept = F.array(*pairs)
    if left_out is not None:
        kept = F.filter(kept, lambda e: ~F.array_contains(left_out, e["key"]))
    return F.map_from_entries(kept)


def record_json(fields: Column) -> Column:
    """One text for equal records: keys sorted, `, ` and `: ` between."""
    entries = F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"]))
    return F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))


def record_digest(fields: Column) -> Column:
    return F.md5(record_json(fields))


def state_digest(rows: DataFrame, table: str, record: str) -> DataFrame:
    """table, n, digest: equal for equal bags of records, whatever their order. Sums of two hashes, so
    that no group is collected."""
    sums = [F.sum(F.xxhash64(F.lit(seed), record).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    return rows.groupBy(table).agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", *sums), 256).alias("digest"))


def state_comparison(gold: DataFrame, agent: DataFrame, table: str, record: str, first: int = 5) -> DataFrame:
    """table, n_gold, n_agent, kind (equal, count_mismatch, content_mismatch) and first_differences: up to
    `first` records that one side has more often, in order. Records meet as counted texts."""
    side = lambda rows, name: rows.groupBy(table, record).agg(F.count("*").alias(name))
    both = side(gold, "n_gold").join(side(agent, "n_agent"), [table, record], "full_outer").na.fill(0, ["n_gold", "n_agent"])
    differs = F.col("n_gold") != F.col("n_agent")
    totals = both.groupBy(table).agg(F.sum("n_gold").alias("n_gold"), F.sum("n_agent").alias("n_agent"), F.count_if(differs).alias("n_differing"))
    place = F.row_number().over(Window.partitionBy(table).orderBy(record))
    few = both.filter(differs).withColumn("place", place).filter(F.col("place") <= first).groupBy(table).agg(F.array_sort(F.collect_list(record)).alias("first_differences"))
    kind = F.when(F.col("n_gold") != F.col("n_agent"), "count_mismatch").when(F.col("n_differing") > 0, "content_mismatch").otherwise("equal")
    none = F.array().cast("array<string>")
    return totals.join(few, table, "left").select(table, "n_gold", "n_agent", kind.alias("kind"), F.coalesce("first_differences", none).alias("first_differences"))


def has_error(result: Column) -> Column:
    """A tool's result, as JSON text, that says it failed: an error key, or success false."""
    return F.coalesce(F.get_json_object(result, "$.error").isNotNull() | (F.get_json_object(result, "$.success") == "false"), F.lit(False))


def tool_results(messages: DataFrame, key: str = "id") -> DataFrame:
    """key, tool_call_id, result: what tool messages returned, as a map of texts; content that is no JSON
    object is kept under raw_content. Of repeated call ids the last row counts (by pos)."""
    rows = messages.filter((F.col("role") == "tool") & F.col("tool_call_id").isNotNull())
    content = F.coalesce(F.col("content"), F.lit("{}"))
    parsed = F.from_json(content, "map<string,string>", {"mode": "PERMISSIVE"})
    result = F.when(F.ltrim(content).startswith("{") & parsed.isNotNull() & F.try_parse_json(content).isNotNull(), parsed).otherwise(F.create_map(F.lit("raw_content"), content))
    return rows.groupBy(key, "tool_call_id").agg(F.max_by(result, "pos").alias("result"))


def relationship_ids(result: Column, entity_ids: Column) -> Column:
    """The *_id fields of a result that name no entity: ids that were made when a row was created."""
    return F.map_filter(result, lambda k, v: F.endswith(k, F.lit("_id")) & ~F.array_contains(entity_ids, F.lower(k)) & v.isNotNull())


def id_mapping(original: DataFrame, replay: DataFrame, entity_ids: Column, key: str = "id") -> DataFrame:
    """key, tool_call_id, field, old, new: ids that a replay made anew, met on call and field."""
    side = lambda rows, name: rows.select(key, "tool_call_id", F.explode(relationship_ids(F.col("result"), entity_ids)).alias("field", name))
    return side(original, "old").join(side(replay, "new"), [key, "tool_call_id", "field"]).filter("old <> new")


def with_new_ids(arguments: Column, mapping: Column) -> Column:
    """Argument texts that are old ids become the new ones."""
    return F.transform_values(arguments, lambda k, v: F.coalesce(F.try_element_at(mapping, v), v))


def strictly_matches(expected: Column, actual: Column, checked: Column | None = None, ignored: Column | None = None) -> Column:
    """Equal argument maps, over the checked keys alone and without the ignored ones, where given."""

    def part(m: Column) -> Column:
        if checked is not None:
            m = F.map_filter(m, lambda k, v: F.array_contains(checked, k))
        if ignored is not None:
            m = F.map_filter(m, lambda k, v: ~F.array_contains(ignored, k))
        return F.array_sort(F.map_entries(m))

    return part(expected) == part(actual)


def entity_or_relationship(tables: DataFrame, entities: DataFrame) -> DataFrame:
    """name, kind, content of captured tables: entity where the name is one, relationship otherwise; of
    repeated names the first wins (by pos)."""
    known = entities.select(F.lower("name").alias("low")).distinct().withColumn("known", F.lit(True))
    first = tables.groupBy("name").agg(F.min_by("content", "pos").alias("content")).withColumn("low", F.lower("name"))
    return first.join(known, "low", "left").select("name", F.when(F.col("known"), "entity").otherwise("relationship").alias("kind"), "content")

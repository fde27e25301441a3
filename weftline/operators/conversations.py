"""Conversations: runs, roles, windows of turns, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing_run(turns: DataFrame, key: str, order: str, counts: Column, breaks: Column) -> DataFrame:
    """key, run: rows that count after the last one that breaks; others are passed over."""
    last = turns.groupBy(key).agg(F.max(F.when(breaks, F.col(order))).alias("__last"))
    return turns.join(last, key).groupBy(key).agg(F.count_if(counts & (F.col("__last").isNull() | (F.col(order) > F.col("__last")))).alias("run"))


def role_counts(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    return turns.groupBy(key).agg(*[F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ("system", "user", "assistant", "tool")])


def as_array(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, messages: (turn, role, text) in order."""
    return turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


def last_turns(turns: DataFrame, last: int, key: str = "conv_id") -> DataFrame:
    """The last rows of each conversation, by rank, so that no array holds more."""
    w = Window.partitionBy(key).orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    return turns.withColumn("__place", F.row_number().over(w)).filter(F.col("__place") <= last).drop("__place")


def swapped(messages: Column) -> Column:
    """The other side's view: user and assistant change places; system and tool rows go, and those without
    a text, which just call tools."""
    seen = F.filter(messages, lambda m: m["role"].isin("user", "assistant") & (F.trim(F.coalesce(m["text"], F.lit(""))) != ""))
    return F.transform(seen, lambda m: m.withField("role", F.when(m["role"] == "user", "assistant").otherwise("user")))


def transcript(messages: Column, last: int, width: int, cut: tuple[str, ...] = ("tool",)) -> Column:
    """The last messages as `ROLE: text`, long texts of the roles in cut shortened, others whole."""
    shown = lambda m: F.when(m["role"].isin(*cut), F.substring(m["text"], 1, width)).otherwise(m["text"])
    tail = F.slice(messages, F.greatest(F.size(messages) - last + 1, F.lit(1)), last)
    return F.array_join(F.transform(tail, lambda m: F.concat(F.upper(m["role"]), F.lit(": "), shown(m))), "\n")


def with_system(messages: Column, policy: Column) -> Column:
    """Messages that begin with a system turn: the policy is put before those that don't."""
    first = F.try_element_at(messages, F.lit(1))
    head = F.array(F.struct(F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), policy.alias("text")))
    return F.when(first["role"] == "system", messages).otherwise(F.concat(head, messages))


def before_last_user(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """turns plus stale: the row lies before its conversation's last user turn."""
    last = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy(key))
    return turns.withColumn("stale", F.coalesce(F.col("turn") < last, F.lit(False)))


def monitor_decision(run: Column, most: int, completed: Column, continued: Column) -> Column:
    """Why a conversation should end, or continue."""
    return F.when(run >= most, "no_tool_run").when(completed & ~continued, "rule").otherwise("continue")


def called(names: Column) -> Column:
    return F.array_join(F.transform(names, lambda n: F.concat(F.lit("[Called: "), n, F.lit("]"))), " ")


def dialogue(messages: Column) -> Column:
    """`ROLE: text [Called: f]` of all messages that say or call something, a blank line between."""

    def line(m: Column) -> Column:
        body = F.trim(F.concat_ws(" ", F.nullif(F.coalesce(m["text"], F.lit("")), F.lit("")), F.nullif(called(m["calls"]), F.lit(""))))
        return F.when(body != "", F.concat(F.upper(F.coalesce(m["role"], F.lit("unknown"))), F.lit(": "), body))

    return F.array_join(F.array_compact(F.transform(messages, line)), "\n\n")


def judge_log(messages: Column) -> Column:
    """`--- ROLE ---` blocks with tool calls, and tool results by their call."""

    def block(m: Column) -> Column:
        calls = F.array_join(F.transform(m["calls"], lambda n: F.concat(F.lit("[TOOL_CALL: "), n, F.lit("]"))), "\n")
        text = F.when(m["role"] == "tool", F.concat(F.lit("[TOOL_RESULT for "), F.coalesce(m["call_id"], F.lit("")), F.lit("]\n"), F.coalesce(m["text"], F.lit("")))).otherwise(F.coalesce(m["text"], F.lit("")))
        body = F.trim(F.concat_ws("\n", F.nullif(text, F.lit("")), F.nullif(calls, F.lit(""))))
        return F.when(body != "", F.concat(F.lit("--- "), F.upper(m["role"]), F.lit(" ---\n"), body))

    return F.array_join(F.array_compact(F.transform(messages, block)), "\n\n")


def without_reasoning(messages: Column) -> Column:
    return F.transform(messages, lambda m: m.withField("reasoning_content", F.lit(None).cast("string")))


MESSAGE_FIELDS = ("role", "content", "reasoning_content", "tool_calls", "tool_call_id")


def canonical(rows: DataFrame, source: str, use_cot: bool) -> DataFrame:
    """id, messages of MESSAGE_FIELDS alone, data_source, use_cot; a missing id is the digest of the messages."""
    kept = F.transform("messages", lambda m: F.struct(*[m[f].alias(f) for f in MESSAGE_FIELDS]))
    shaped = rows.select("id", kept.alias("messages"))
    ident = F.coalesce("id", F.md5(F.to_json("messages")))
    return shaped.select(ident.alias("id"), "messages", F.lit(source).alias("data_source"), F.lit(use_cot).alias("use_cot"))


def execution_log(calls: Column) -> Column:
    """`n. tool(arguments) -> result` lines of (tool, arguments, result)."""
    return F.array_join(F.transform(calls, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c["tool"], F.lit("("), F.coalesce(c["arguments"], F.lit("")), F.lit(") -> "), F.coalesce(c["result"], F.lit("none")))), "\n")


def by_tool_prefix(values: DataFrame, key: str) -> DataFrame:
    """From (key, name `tool.param`, value, trajectory): `tool: param=value, ...` lines in the trajectory's order."""
    parts = F.split("name", r"\.", 2)
    each = values.select(key, parts[0].alias("tool"), parts[1].alias("param"), "value", F.array_position("trajectory", parts[0]).alias("at"))
    each = each.groupBy(key, "tool", "at").agg(F.array_sort(F.collect_list(F.concat("param", F.lit("="), "value"))).alias("pairs"))
    line = F.struct(F.when(F.col("at") > 0, F.col("at")).otherwise(1 << 30).alias("at"), F.concat("tool", F.lit(": "), F.array_join("pairs", ", ")).alias("line"))
    return each.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("listed"))


def call_sequence(path: Column) -> Column:
    return F.array_join(path, " -> ")

"""Evaluation of samples: golden calls, parameter rules, evaluators' results and their reports.

Calls and parameters are rows, so every rule is a column and every verdict an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import is_placeholder, is_uuid


def function_info(wanted: DataFrame, functions: DataFrame) -> DataFrame:
    """server, function, info for each (server, function) wanted: the function's row of the server itself
    or, for a fused name, of the first of its parts that has the function; null if none has. Both sides are joined by
    sorting, so that neither passes through the driver, however many functions there are."""
    parts = F.concat(F.array("server"), F.split("server", "_"))
    names = wanted.select("server", "function").distinct()
    places = names.select("server", "function", F.posexplode(parts).alias("place", "part"))
    about = functions.select(F.col("server").alias("part"), "function", F.struct(*[c for c in functions.columns if c not in ("server", "function")]).alias("info"))
    found = places.join(about.hint("merge"), ["part", "function"]).groupBy("server", "function").agg(F.min_by("info", "place").alias("info"))
    return names.join(found.hint("merge"), ["server", "function"], "left")


def is_filter(info: Column) -> Column:
    """A function whose description speaks of filtering."""
    return F.coalesce(F.contains(F.lower(info["description"]), F.lit("filter")), F.lit(False))


def is_ignored(param: Column, expected: Column, actual: Column, info: Column, entity_ids: Column, is_text: Column | None = None) -> Column:
    """Parameters that a comparison leaves out: marked ones, placeholders on either side, free text, ids of
    no entity, all of a filter function, and filters. is_text: the expected value is a string."""
    own = F.try_element_at(info["parameters"], param)
    no = F.lit(False)
    return (
        F.coalesce(own["ignore_in_eval"], no)
        | F.coalesce(is_placeholder(expected), no)
        | F.coalesce(is_placeholder(actual), no)
        | F.coalesce((own["range"] == "string") & (F.lit(True) if is_text is None else is_text) & ~is_uuid(expected), no)
        | (F.endswith(param, F.lit("_id")) & ~F.array_contains(entity_ids, param))
        | is_filter(info)
        | F.coalesce(F.contains(F.lower(own["description"]), F.lit("filter")), no)
    )


def unpruned(gold: DataFrame, pruning: DataFrame, key: str = "id", pos: str = "pos") -> DataFrame:
    """Golden calls without those that pruning (key, redundant index) names; indices are places, from 0."""
    return gold.join(pruning.select(F.col(key), F.col("index").alias(pos)).distinct(), [key, pos], "left_anti")


def action_report(scores: DataFrame) -> DataFrame:
    """action_scores plus full_match_rate, 0 where there is no golden call."""
    rate = F.when(F.col("n_gold") > 0, F.col("n_full") / F.col("n_gold")).otherwise(F.lit(0.0))
    return scores.withColumn("full_match_rate", rate)


def dealt(rows: DataFrame, key: str, parts: int | None) -> DataFrame:
    """rows by key over so many parts, before anything of them is gathered; as they are, if parts is null."""
    return rows if parts is None else rows.repartition(parts, key)


def verdicts(samples: DataFrame, calls: DataFrame, results: DataFrame, key: str = "id", parts: int | None = None) -> DataFrame:
    """key, evaluator, score, passed, skipped, reason: the evaluators' rows of samples that can be judged, and
    one failed row for each that has no trajectory or made no call. parts: deal all rows by key over so many (`session.parts_for`),
    and join them there by sorting."""
    samples, calls, results = (dealt(x, key, parts) for x in (samples, calls, results))
    if parts is not None:
        calls, results = calls.hint("merge"), results.hint("merge")
    made = calls.select(key).distinct().withColumn("made", F.lit(True))
    reason = F.when(F.coalesce(F.size("trajectory"), F.lit(0)) < 1, "no trajectory").when(F.col("made").isNull(), "no tool calls")
    judged = samples.select(key, "trajectory").join(made, key, "left").select(key, reason.alias("reason"))
    early = judged.filter(F.col("reason").isNotNull()).select(key, F.lit("sample").alias("evaluator"), F.lit(0.0).alias("score"), F.lit(False).alias("passed"), F.lit(False).alias("skipped"), "reason")
    rest = results.join(judged.filter(F.col("reason").isNull()).select(key), key, "left_semi")
    return early.unionByName(rest.select(key, "evaluator", F.col("score").cast("double").alias("score"), "passed", F.coalesce("skipped", F.lit(False)).alias("skipped"), F.lit(None).cast("string").alias("reason")))


def evaluator_report(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """evaluator, total, passed, failed, skipped, pass_rate; evaluator null is all samples, which pass if
    all their evaluators do. parts: deal rows by id over so many."""
    counts = lambda df: df.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count_if("skipped").alias("skipped"))
    samples = dealt(rows, "id", parts).groupBy("id").agg(F.bool_and("passed").alias("passed"), F.bool_and("skipped").alias("skipped"))
    both = counts(rows.groupBy("evaluator")).unionByName(counts(samples.groupBy(F.lit(None).cast("string").alias("evaluator"))))
    return both.withColumn("pass_rate", F.col("passed") / F.col("total"))


def skipped_or_all(assertions: DataFrame, samples: DataFrame, key: str = "id") -> DataFrame:
    """Natural-language assertions: a sample without any is skipped with score 1; else all must hold."""
    found = assertions.groupBy(key).agg(F.bool_and("holds").alias("holds"))
    joined = samples.select(key).join(found, key, "left")
    passed = F.coalesce("holds", F.lit(True))
    return joined.select(key, passed.alias("passed"), F.col("holds").isNull().alias("skipped"), passed.cast("double").alias("score"))


def judged_scores(rows: DataFrame, score: str, checks: list[str], most: float = 5.0, least: float = 3.0) -> DataFrame:
    """rows plus score as a share of most, passed, n_issues and issues: the checks that found something."""
    hit = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit(False)), F.lit(c)) for c in checks]))
    return rows.withColumns({"share": F.col(score) / most, "passed": F.col(score) >= least, "n_issues": F.size(hit).cast("long"), "issues": hit})


def prune_summary(pruned: DataFrame, group: list[str] = ()) -> DataFrame:
    """From (steps, redundant, cached) of each trajectory: totals, the share of redundant steps, cache hits."""
    total, gone = F.coalesce(F.sum("steps"), F.lit(0)), F.coalesce(F.sum("redundant"), F.lit(0))
    return pruned.groupBy(*group).agg(F.count("*").alias("n"), total.alias("steps"), gone.alias("redundant"), F.when(total > 0, gone / total).otherwise(F.lit(0.0)).alias("ratio"), F.count_if("cached").alias("cache_hits"))


def filtering_stats(combos: DataFrame, group: list[str] = ()) -> DataFrame:
    """Over validated combos (file, trajectory_hash, valid): counts, distinct files and trajectories, and
    the pass rate in percent with one decimal."""
    n, good = F.count("*"), F.count_if("valid")
    rate = F.concat(F.round(F.when(n > 0, good / n * 100).otherwise(F.lit(0.0)), 1).cast("string"), F.lit("%"))
    return combos.groupBy(*group).agg(
        F.count_distinct("file").alias("total_files"),
        n.alias("total_combos"),
        good.alias("validated_combos"),
        F.count_if(~F.col("valid")).alias("failed_combos"),
        F.count_distinct("trajectory_hash").alias("unique_trajectories"),
        F.count_distinct(F.when(F.col("valid"), F.col("trajectory_hash"))).alias("trajectories_validated"),
        rate.alias("pass_rate"),
    )


def unified(subjective: DataFrame, simulated: DataFrame) -> DataFrame:
    """id, evaluator, score, passed, n_issues of both judges (rows of judged_scores) in one table."""
    side = lambda rows, name: rows.select("id", F.lit(name).alias("evaluator"), F.col("share").alias("score"), "passed", "n_issues")
    return side(subjective, "subjective").unionByName(side(simulated, "user_simulation"))


def mean_scores(rows: DataFrame, dims: list[str]) -> DataFrame:
    """n and the mean of each dimension over judged rows, null where none is."""
    return rows.agg(F.count("*").alias("n"), *[F.avg(d).alias(d) for d in dims])

"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule states which measures it needs and a condition that rejects a document. On a bounded sample
each measure's cost is timed, one job that throws its result away for each, and every rule is judged for
every row. The order follows greedily: next comes the rule with the most rejections among the rows
that the rules before it leave, per second of measures that none before it has taken. A document that
an early rule rejects is never measured for the later ones. The order decides the cost, never the verdict.

`judge` reports the base measures of every row, so its base rules come first and cost nothing more; the other rules are
ordered by what they reject among the rows that are left then, their base measures being there, and their own
measures are taken inside the cascade alone. `keep_good` takes all measures inside the cascade, in the order of all
rules. `decided` tells how many rows each rule was reached by and how many it rejected.

Defined results: null text counts as empty; an empty text has no words and fails the base rule; very long
texts are measured whole; repeated rows and ties are judged row by row; an empty table gives an empty
table; other columns pass through untouched, whatever their names; measures are added under the names of
BASE, in place of columns of those names; so are base_failed and kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.textops import others
from weftline.session import materialize

SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def lines_of(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def repeated_window_words(words: Column, k: int = 3) -> Column:
    """Words inside k-word windows that occur twice or more. Window hashes are sorted with their
    places, equal neighbours marked, and the union of the marked windows is measured."""
    places = F.sequence(F.lit(0), F.size(words) - k)
    hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        marked = let(
            ordered,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(s, lambda e, j: (F.get(s, j - 1)["h"].eqNullSafe(e["h"])) | (F.get(s, j + 1)["h"].eqNullSafe(e["h"]))),
                    lambda e: e["i"],
                )
            ),
        )
        start = F.struct(F.lit(-k).alias("last"), F.lit(0).cast("long").alias("total"))
        return F.aggregate(
            marked,
            start,
            lambda acc, p: F.struct(p.alias("last"), (acc["total"] + F.least(F.lit(k), p - acc["last"])).cast("long").alias("total")),
            lambda acc: acc["total"],
        )

    none = F.lit(0).cast("long")
    return F.when(F.size(words) < k + 1, none).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h)))
    )


#: name: measure from text and words
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, words: F.size(words).cast("long"),
    "word_chars": lambda text, words: F.length(F.array_join(words, "")).cast("long"),
    "n_symbols": lambda text, words: F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"),
    "n_dup_lines": lambda text, words: let(lines_of(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    "n_repeat_words": lambda text, words: repeated_window_words(words),
    "n_lines": lambda text, words: F.size(lines_of(text)).cast("long"),
    "n_distinct": lambda text, words: F.size(F.array_distinct(words)).cast("long"),
    "n_bullet_lines": lambda text, words: F.size(F.filter(lines_of(text), lambda x: x.rlike(r"^[\x20\t]*[-*\u2022\u00b7]"))).cast("long"),
    "n_open_lines": lambda text, words: F.size(F.filter(lines_of(text), lambda x: x.rlike(r"(\.\.\.|\u2026)[\x20\t\r]*$"))).cast("long"),
}
#: Reported for every row.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    rejects: Callable[[dict[str, Column]], Column]
    base: bool = False


#: Whole-number arithmetic, so that no rounding decides.
RULES: tuple[Rule, ...] = (
    Rule("few_words", ("n_words",), lambda m: m["n_words"] < 50, True),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"], True),
    Rule("symbols", ("n_words", "n_symbols"), lambda m: 100 * m["n_symbols"] > 10 * m["n_words"]),
    Rule("dup_lines", ("n_lines", "n_dup_lines"), lambda m: 100 * m["n_dup_lines"] > 60 * m["n_lines"]),
    Rule("short_words", ("n_words", "word_chars"), lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule("long_words", ("n_words", "word_chars"), lambda m: m["word_chars"] > 15 * m["n_words"]),
    Rule("few_distinct", ("n_words", "n_distinct"), lambda m: 100 * m["n_distinct"] < 5 * m["n_words"]),
    Rule("bullet_lines", ("n_lines", "n_bullet_lines"), lambda m: 100 * m["n_bullet_lines"] > 90 * m["n_lines"]),
    Rule("open_lines", ("n_lines", "n_open_lines"), lambda m: 100 * m["n_open_lines"] > 50 * m["n_lines"]),
)


def split_once(docs: DataFrame, text: str) -> DataFrame:
    """row, text and words of every document."""
    own = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.struct("*").alias("row"))
    return own.select("row", "text", words_of(F.col("text")).alias("words"))


def measured(names=tuple(MEASURES)) -> dict[str, Column]:
    """The named measures over the columns of split_once."""
    return {n: MEASURES[n](F.col("text"), F.col("words")) for n in names}


def timed(sample: DataFrame) -> dict[str, float]:
    """Seconds that each measure takes over the sample, by a job that throws its result away, beyond those of
    a job that takes none."""

    def run(column: Column) -> float:
        began = time.perf_counter()
        sample.select(column).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    plain = min(run(F.size("words")), run(F.size("words")))
    return {n: max(run(m) - plain, 1e-4) for n, m in measured().items()}


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, seed: int = 7, text: str = "text", base_first: bool = False) -> list[tuple[str, float, float]]:
    """(rule, share rejected among the rows left to it, seconds of measures that it adds), in the order of
    evaluation. Rules that reject nothing more come last, the cheaper first. base_first: the measures of BASE are taken for
    every row, and the base rules, in the order of the table, have been asked before the others."""
    total = docs.count()
    if not total:
        return [(r.name, 0.0, 0.0) for r in rules]
    sample = materialize(split_once(docs.select(text).sample(fraction=min(1.0, sample_rows / total), seed=seed), text).select("text", "words"), "sample")
    cost = timed(sample)
    m = measured()
    verdicts = sample.select(*[F.coalesce(r.rejects(m), F.lit(False)).alias(r.name) for r in rules]).toPandas().to_numpy(bool)
    left, taken, order, rest = np.ones(len(verdicts), bool), set(), [], list(rules)
    if base_first:
        taken = set(BASE)
        for r in [r for r in rules if r.base]:
            order.append((r.name, float(verdicts[left, rules.index(r)].mean()) if left.any() else 0.0, 0.0))
            left &= ~verdicts[:, rules.index(r)]
            rest.remove(r)
    while rest:

        def rated(r: Rule) -> tuple[float, float]:
            added = sum(cost[n] for n in r.needs if n not in taken) or 1e-5
            share = float(verdicts[left, rules.index(r)].mean()) if left.any() else 0.0
            return share, added

        best = min(rest, key=lambda r: (-rated(r)[0] / rated(r)[1], rated(r)[1], r.name))
        order.append((best.name, *rated(best)))
        rest.remove(best)
        taken.update(best.needs)
        left &= ~verdicts[:, rules.index(best)]
    return order


def cascade(order: list[str], measures: dict[str, Column], rules: tuple[Rule, ...] = RULES) -> Column:
    """True if no rule rejects."""
    return rejected_by(order, measures, rules).isNull()


def rejected_by(order: list[str], measures: dict[str, Column], rules: tuple[Rule, ...] = RULES) -> Column:
    """The first rule that rejects, null if none does. CASE stops at it."""
    by_name = {r.name: r for r in rules}
    verdict = None
    for name in order:
        hit = by_name[name].rejects(measures)
        verdict = F.when(hit, F.lit(name)) if verdict is None else verdict.when(hit, F.lit(name))
    return F.lit(None).cast("string") if verdict is None else verdict


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with the base measures, base_failed and kept."""
    order = [name for name, _, _ in order_rules(docs, rules, text=text, base_first=True)]
    split = split_once(docs, text)
    own = split.select("*", *[m.alias(n) for n, m in measured(BASE).items()])
    m = {n: F.col(n) if n in BASE else make(F.col("text"), F.col("words")) for n, make in MEASURES.items()}
    base = F.lit(False)
    for r in rules:
        if r.base:
            base = base | r.rejects(m)
    others_ = [r.name for r in rules if not r.base]
    verdict = F.when(base, F.lit(False)).otherwise(cascade([n for n in order if n in others_], m, rules))
    return own.select(*others(docs, *BASE, "base_failed", "kept", prefix="row."), *BASE, base.alias("base_failed"), verdict.alias("kept"))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows that pass, columns unchanged. The words are split once, and a rule's measures are
    taken only if no rule before it rejects."""
    own = F.coalesce(F.col(text), F.lit(""))
    order = [name for name, _, _ in order_rules(docs, rules, text=text)]
    return docs.filter(let(words_of(own), lambda w: cascade(order, {n: make(own, w) for n, make in MEASURES.items()}, rules)))


def decided(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """place, rule, reached, rejected: the order in which the rules were asked, how many rows came to each, so that its
    measures were taken for them, and how many it rejected."""
    order = [name for name, _, _ in order_rules(docs, rules, text=text)]
    own = F.coalesce(F.col(text), F.lit(""))
    by = docs.select(let(words_of(own), lambda w: rejected_by(order, {n: make(own, w) for n, make in MEASURES.items()}, rules)).alias("rule"))
    counted = by.groupBy("rule").agg(F.count("*").alias("rejected"))
    places = docs.sparkSession.createDataFrame([*((i, name) for i, name in enumerate(order)), (len(order), None)], "place int, rule string")
    every = places.join(counted.withColumnRenamed("rule", "of"), F.col("rule").eqNullSafe(F.col("of")), "left")
    # As many rows as there are rules.
    later = Window.orderBy("place").rowsBetween(0, Window.unboundedFollowing)
    n = F.coalesce("rejected", F.lit(0))
    return every.select("place", "rule", F.sum(n).over(later).alias("reached"), n.alias("rejected")).filter(F.col("rule").isNotNull())

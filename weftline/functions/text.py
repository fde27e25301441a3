"""Column builders over strings: brackets, identifiers, names, policy text, conversation markers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
PLACEHOLDER_WORDS = ("placeholder", "tbd", "todo", "n/a", "n-a", "unknown", "pending", "temp", "dummy", "sample", "example", "test-")
COMPLETION_PATTERNS = (
    "all (?:your )?(?:requests?|tasks?) (?:have been |were )?(?:successfully )?completed",
    "(?:successfully )?completed all",
    "all (?:done|finished|set)",
    "everything (?:has been |is )?(?:done|completed|processed)",
    "is there anything else (?:i can|you.d like|you need)",
    "(?:let me know|feel free to ask) if (?:you need|there.s) anything else",
    "anything else i can (?:help|assist)",
    "do you (?:need|have) any(?:thing)? (?:else|other)",
    "have a (?:great|nice|good|wonderful) (?:day|time)",
    "(?:glad|happy) (?:i could|to) (?:help|assist)",
    "take care",
    "(?:here.s|here is) a (?:quick )?summary",
    "to (?:summarize|recap|sum up)",
    "in summary",
)
STATE_CHANGING_WORDS = (
    "create", "add", "insert", "new", "update", "modify", "edit", "change", "delete", "remove", "cancel", "enroll", "unenroll",
    "register", "unregister", "schedule", "book", "reserve", "apply", "submit", "confirm", "authorize", "authenticate", "login",
    "transfer", "deposit", "withdraw", "assign", "unassign",
)
RECOVERABLE_ERRORS = ("timeout", "rate limit", "rate_limit", "too many requests", "service unavailable", "503", "502", "504", "connection", "network", "temporarily")
CONTROL_TOKENS = ("###STOP###", "###TRANSFER###", "###OUT-OF-SCOPE###")
CONTINUATION_PATTERNS = ("actually", "wait", "one more thing", "also", "can you also", "i forgot", "another", "what about", "how about", r"\?$")


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def matches_any(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def bracket_values(text: Column) -> Column:
    """Inner texts of [[value]]; brackets don't nest."""
    return F.regexp_extract_all(text, F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1))


def uuids(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({UUID})"), F.lit(1))))


def is_uuid(text: Column) -> Column:
    return F.lower(text).rlike(f"^{UUID}$")


def is_placeholder(text: Column) -> Column:
    """A stand-in for a value: one of the fixed words anywhere, or wrapped in <>, [] or {}."""
    wrapped = F.lit(False)
    for a, b in ("<>", "[]", "{}"):
        wrapped = wrapped | (F.startswith(text, F.lit(a)) & F.endswith(text, F.lit(b)))
    return contains_any(F.trim(F.lower(text)), PLACEHOLDER_WORDS) | wrapped


def unsupported_brackets(text: Column, values: Column) -> Column:
    """Bracketed values that are part of no instance value: invented ones."""
    return F.filter(bracket_values(text), lambda b: ~F.exists(values, lambda v: F.contains(v, b)))


def missing_values(text: Column, required: Column) -> Column:
    """Required values that no bracket mentions, in any case."""
    brackets = F.transform(bracket_values(text), F.lower)
    return F.filter(required, lambda r: ~F.exists(brackets, lambda b: F.contains(b, F.lower(r))))


def camel_to_snake(name: Column) -> Column:
    once = F.regexp_replace(name, "(.)([A-Z][a-z]+)", "$1_$2")
    return F.lower(F.regexp_replace(once, "([a-z0-9])([A-Z])", "$1_$2"))


def snake_to_camel(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))), "")


def server_identifier(name: Column) -> Column:
    """PascalCase identifier; a leading digit gets the prefix MCP; null if nothing is left."""
    words = F.filter(F.split(F.regexp_replace(name, "[^A-Za-z0-9]+", " "), " "), lambda w: w != "")
    joined = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")
    return F.when(joined == "", None).when(joined.rlike("^[0-9]"), F.concat(F.lit("MCP"), joined)).otherwise(joined)


def initials(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "[^A-Z]", ""))


def name_abbreviation(name: Column) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(name, F.lit("([A-Z][a-z]*)"), F.lit(1)), lambda w: F.substring(w, 1, 1)), "")


def short_name(name: Column, most: int = 8) -> Column:
    """The initials of a camel-case name's words in lower case; if they are more than `most`, two letters of the
    first and the last word and the initials between, up to `most`; a name without capitals is cut."""

    def of(words: Column) -> Column:
        initials_ = lambda ws: F.array_join(F.transform(ws, lambda w: F.substring(w, 1, 1)), "")
        ends = F.concat(F.substring(F.element_at(words, 1), 1, 2), F.substring(F.element_at(words, -1), 1, 2))
        between = F.slice(words, 2, F.size(words) - 2)
        long = F.concat(ends, F.substr(initials_(between), F.lit(1), F.greatest(F.lit(0), F.lit(most) - F.length(ends))))
        return F.when(F.size(words) == 0, F.substring(name, 1, most)).when((F.size(words) > most), long).otherwise(initials_(words))

    return F.lower(let(F.regexp_extract_all(name, F.lit("([A-Z][a-z]*)"), F.lit(1)), of))


def bare_tool(name: Column) -> Column:
    """The last dotted part."""
    return F.element_at(F.split(name, r"\."), -1)


def tool_server(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(".")), F.split(name, r"\.", 2)[0])


def domain_set(names: Column) -> Column:
    """One key for all orders of a fused name's parts."""
    return F.array_sort(F.array_distinct(names))


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(" \t\n\v\f\r"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def policy_sections(policy: Column) -> Column:
    """(tool, content) of each marked section, in order. The policy is gone through once."""
    whole = F.regexp_extract_all(policy, F.lit(r"(?s)<!-- TOOL: (\S+) -->.*?<!-- TOOL_END: \1 -->"), F.lit(0))

    def section(s: Column) -> Column:
        tool = F.substring_index(F.substr(s, F.lit(len("<!-- TOOL: ") + 1)), " -->", 1)
        around = F.length(tool) + len("<!-- TOOL:  -->")
        body = F.substr(s, around + 1, F.length(s) - 2 * around - len("_END"))
        return F.struct(tool.alias("tool"), stripped(body).alias("content"))

    return F.transform(whole, section)


def global_rules(policy: Column) -> Column:
    return stripped(F.regexp_extract(policy, r"(?s)<!-- POLICY_START -->(.*?)<!-- GLOBAL_RULES_END -->", 1))


def policy_for(policy: Column, trajectory: Column) -> Column:
    """Global rules and the sections of a trajectory's tools, in its order; names match exactly
    or else in any case."""

    def contents(sections: Column) -> Column:
        of_tool = lambda t: F.coalesce(
            F.get(F.filter(sections, lambda s: s["tool"] == t), F.lit(0)), F.get(F.filter(sections, lambda s: F.lower(s["tool"]) == F.lower(t)), F.lit(0))
        )
        chosen = F.filter(F.transform(F.array_distinct(F.transform(trajectory, bare_tool)), of_tool), lambda s: s.isNotNull())
        return F.transform(chosen, lambda s: s["content"])

    return F.array_join(F.filter(F.concat(F.array(global_rules(policy)), let(policy_sections(policy), contents)), lambda x: x != ""), "\n\n")


def control_flags(text: Column) -> Column:
    """(stopped, transferred, out_of_scope, text without the tokens)."""
    clean = text
    for t in CONTROL_TOKENS:
        clean = F.replace(clean, F.lit(t), F.lit(""))
    return F.struct(*[F.contains(text, F.lit(t)).alias(n) for t, n in zip(CONTROL_TOKENS, ("stopped", "transferred", "out_of_scope"))], F.trim(clean).alias("text"))


def fill_template(template: Column, values: Column) -> Column:
    """{key} replaced by the map's value."""
    return F.aggregate(F.map_entries(values), template, lambda s, e: F.replace(s, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def fenced_code(text: Column, language: str = "python") -> Column:
    found = F.regexp_extract(text, rf"(?s)```{language}\s*\n(.*?)```", 1)
    return stripped(F.when(found != "", found).otherwise(text))


def is_state_changing(tool: Column) -> Column:
    """A tool whose name holds one of the fixed words."""
    return contains_any(F.lower(tool), STATE_CHANGING_WORDS)


def is_recoverable(error: Column) -> Column:
    return contains_any(F.lower(error), RECOVERABLE_ERRORS)


def explicit_placeholders(text: Column) -> Column:
    """(domain, name, field) of each `<Entity.field>` or `<Domain.Relationship.field>`, in order, once each."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"<(\w+\.\w+(?:\.\w+)?)>"), F.lit(1)))
    return F.transform(found, lambda x: F.struct(F.when(F.size(F.split(x, r"\.")) == 3, F.split(x, r"\.")[0]).alias("domain"), F.element_at(F.split(x, r"\."), -2).alias("name"), F.element_at(F.split(x, r"\."), -1).alias("field")))


def known_domains(name: Column, domains: Column) -> Column:
    """The parts of a fused name that are known domains, joined back greedily: of the domains that the rest of
    the name begins with, the longest goes first; a part that begins none is passed over."""
    words = F.split(name, "_")

    def step(acc: Column, i: Column) -> Column:
        rest = F.array_join(F.slice(words, i + 1, F.size(words)), "_")
        fits = F.filter(domains, lambda d: (rest == d) | F.startswith(rest, F.concat(d, F.lit("_"))))
        best = F.element_at(F.array_sort(F.transform(fits, lambda d: F.struct((-F.length(d)).alias("n"), d.alias("d")))), 1)["d"]
        hit = (i >= acc["next"]) & (F.size(fits) > 0)
        return F.struct(
            F.when(hit, F.concat(acc["found"], F.array(best))).otherwise(acc["found"]).alias("found"),
            F.when(hit, i + F.size(F.split(best, "_"))).otherwise(acc["next"]).cast("int").alias("next"),
        )

    start = F.struct(F.array().cast("array<string>").alias("found"), F.lit(0).alias("next"))
    return F.aggregate(F.sequence(F.lit(0), F.size(words) - 1), start, step, lambda acc: acc["found"])


def source_entity(value_from: Column) -> Column:
    """The entity of `Entity.field`; null for values of the system."""
    return F.when(~F.startswith(F.lower(value_from), F.lit("system_")), F.split(value_from, r"\.")[0])


def with_entity_id(attributes: Column, entity: Column) -> Column:
    """A map whose first *_id key (in order of keys) becomes `entity_id`, unless it has that key."""
    wanted = F.concat(F.lower(entity), F.lit("_id"))
    first = F.get(F.array_sort(F.filter(F.map_keys(attributes), lambda k: F.endswith(k, F.lit("_id")))), F.lit(0))
    renamed = F.map_from_entries(F.transform(F.map_entries(attributes), lambda e: F.struct(F.when(e["key"] == first, wanted).otherwise(e["key"]).alias("key"), e["value"].alias("value"))))
    return F.when(F.map_contains_key(attributes, wanted) | first.isNull(), attributes).otherwise(renamed)


def test_counts(summary: Column) -> Column:
    """(passed, failed, errors) of a test run's last line."""
    number = lambda word: F.coalesce(F.nullif(F.regexp_extract(summary, rf"(\d+) {word}", 1), F.lit("")).cast("long"), F.lit(0))
    return F.struct(number("passed").alias("passed"), number("failed").alias("failed"), number("error").alias("errors"))


def with_policy_markers(rules: Column, sections: Column) -> Column:
    """Policy text with markers from its global rules and an array of (tool, content)."""
    body = F.transform(sections, lambda s: F.concat(F.lit("<!-- TOOL: "), s["tool"], F.lit(" -->\n"), s["content"], F.lit("\n<!-- TOOL_END: "), s["tool"], F.lit(" -->")))
    return F.concat(F.lit("<!-- POLICY_START -->\n"), rules, F.lit("\n<!-- GLOBAL_RULES_END -->\n"), F.array_join(body, "\n"), F.lit("\n<!-- POLICY_END -->"))

"""JSON as models write it: fenced, followed by words, with comments, bare keys, trailing commas or open ends.

Well-formed JSON is parsed in Spark to VARIANT and nothing else. Only rows whose text Spark can't parse go through
`repair`, one scan from left to right in Arrow batches, and are then parsed in Spark as well.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import let

SPACE = " \t\r\n\v\f\xa0\ufeff\u200b"
#: Letters, digits and these make words.
MARKS = "_$-+."
NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
#: Bare words that stand for JSON values, in any case.
LITERALS = {"true": "true", "false": "false", "null": "null", "none": "null", "nan": "null", "undefined": "null"}


def json_part(text: Column) -> Column:
    """The part of an answer that should be JSON: what the first fence holds, or else from the first bracket to the
    last one of its kind, or the whole text. Trimmed of white space and of marks of byte order."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json|JSON)?[ \t]*\n?(.*?)```", 1)

    def spans(t: Column) -> Column:
        first = F.regexp_extract(t, r"(?s)^[^\[{]*([\[{])", 1)
        start = F.regexp_instr(t, F.lit(r"[\[{]"))
        last = lambda mark: F.length(t) - F.instr(F.reverse(t), mark) + 1
        end = F.when(first == "[", F.when(F.contains(t, F.lit("]")), last("]"))).otherwise(F.when(F.contains(t, F.lit("}")), last("}")))
        closed = F.substr(t, start, F.when(end > start, end - start + 1).otherwise(F.length(t)))
        return F.when(start > 0, closed).otherwise(t)

    own = F.when(fenced != "", fenced).otherwise(text)
    return F.btrim(let(own, spans), F.lit(SPACE))


class _Level:
    """An object or array that is still open: what it expects next, and whether it holds anything."""

    def __init__(self, mark: str):
        self.close = "}" if mark == "{" else "]"
        self.expects = "key" if mark == "{" else "value"
        self.filled = False


def repair(text: str) -> str | None:
    """A JSON text from one that almost is, or null if it holds no value. One scan: comments and control characters go;
    keys and words without quotes get them, as do texts in single quotes; missing commas and colons are put in, those too
    many go; a key without a value gets null; what is left open at the end is closed, and a closing bracket that fits
    nothing is passed over. What follows the first value is not read."""
    out: list[str] = []
    levels: list[_Level] = []
    i, n = 0, len(text)

    def before_value(key: bool) -> None:
        """Puts in what must stand before a value, or before what may be a key."""
        if not levels:
            return
        top = levels[-1]
        if top.expects == "colon":
            out.append(":")
            top.expects = "value"
        elif top.expects == "key" or top.close == "]":
            if top.filled:
                out.append(",")
            top.filled = True
            if top.expects == "key" and not key:
                out.append('"":')
                top.expects = "value"

    def after_value() -> None:
        if levels and levels[-1].close == "}":
            levels[-1].expects = {"key": "colon", "value": "key"}[levels[-1].expects]

    def completed() -> None:
        """A key that nothing follows gets null."""
        top = levels[-1]
        if top.close == "}" and top.expects != "key":
            out.append(":null" if top.expects == "colon" else "null")
            top.expects = "key"

    while i < n:
        c = text[i]
        if c in SPACE:
            i += 1
        elif text.startswith("//", i) or c == "#":
            end = text.find("\n", i)
            i = n if end < 0 else end + 1
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            i = n if end < 0 else end + 2
        elif c in "\"'":
            before_value(True)
            i = _quoted(text, i, out)
            after_value()
        elif c in "{[":
            before_value(False)
            levels.append(_Level(c))
            out.append(c)
            i += 1
        elif c in "}]":
            if any(level.close == c for level in levels):
                closed = ""
                while closed != c:
                    completed()
                    closed = levels.pop().close
                    out.append(closed)
                    after_value()
            i += 1
        elif c == ",":
            if levels:
                completed()
            i += 1
        elif c == ":":
            if levels and levels[-1].expects == "colon":
                out.append(":")
                levels[-1].expects = "value"
            i += 1
        elif c.isalnum() or c in MARKS:
            end = i
            while end < n and (text[end].isalnum() or text[end] in MARKS):
                end += 1
            word = text[i:end]
            before_value(True)
            if levels and levels[-1].expects == "key":
                out.append(f'"{word}"')
            else:
                out.append(LITERALS.get(word.lower()) or (word if _number(word) else f'"{word}"'))
            after_value()
            i = end
        else:
            i += 1
        if out and not levels:
            break
    while levels:
        completed()
        out.append(levels.pop().close)
        after_value()
    return "".join(out) or None


ESCAPES = {"\n": "\\n", "\r": "\\r", "\t": "\\t", '"': '\\"'}


def _quoted(text: str, i: int, out: list[str]) -> int:
    """Writes the text that begins with the quote at i; the place behind its end."""
    quote, n = text[i], len(text)
    out.append('"')
    i += 1
    while i < n and text[i] != quote:
        c = text[i]
        if c == "\\" and i + 1 < n:
            nxt = text[i + 1]
            four = text[i + 2 : i + 6]
            if nxt in '"\\/bfnrt' or nxt == "u" and len(four) == 4 and all(h in "0123456789abcdefABCDEF" for h in four):
                out.append(c + nxt)
            else:
                out.append(nxt if nxt == "'" else "\\\\" + ESCAPES.get(nxt, nxt if nxt >= " " else ""))
            i += 2
            continue
        if c in ESCAPES:
            out.append(ESCAPES[c])
        elif c >= " " and c != "\\":
            out.append(c)
        i += 1
    out.append('"')
    return i + 1


def _number(word: str) -> bool:
    """Whether JSON reads the word as a number."""
    return NUMBER.fullmatch(word) is not None


def parsed_json(rows: DataFrame, text: str, into: str = "json") -> DataFrame:
    """rows plus `into`, a VARIANT of the JSON value in a text, null if there is none, and `repaired`, whether the text
    had to be mended. Flat or nested, what is JSON is parsed by Spark alone; Python sees it as null, and the texts of the
    others. Texts without a bracket hold at most one plain value and pass Python by."""
    part = json_part(F.col(text))
    bracket = F.coalesce(F.regexp_instr(F.col(text), F.lit(r"[\[{]")) > 0, F.lit(False))
    parsed = lambda some: some.withColumn(into, F.try_parse_json(part))

    @F.arrow_udf("string")
    def mended(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else repair(t) for t in texts.to_pylist()], pa.string())

    # Every text is parsed once: a text that won't parse costs an exception, and so several times as much as one that will.
    first = parsed(rows.filter(bracket))
    tried = first.withColumn("repaired", F.try_parse_json(mended(F.when(F.col(into).isNull(), part))))
    found = tried.withColumns({into: F.coalesce(into, "repaired"), "repaired": F.col("repaired").isNotNull()})
    plain = parsed(rows.filter(~bracket)).withColumn("repaired", F.lit(False))
    return plain.unionByName(found)


def strict_json(text: Column) -> Column:
    """A VARIANT of a text that is one JSON value and nothing else, or null. Spark's parser leaves what follows a value
    unread, so the value is read within an object, where that is an error, and must be the only item of an array."""
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("\n]")))
    within = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("\n}")))
    one = F.schema_of_variant(F.try_variant_get(alone, "$[0]", "variant")).isNotNull() & F.try_variant_get(alone, "$[1]", "variant").isNull()
    return F.when(one, F.try_variant_get(within, "$.v", "variant"))


def call_arguments(call: Column) -> Column:
    """(arguments, error) of a tool call in strict JSON: the object under `arguments`, or the JSON text that stands
    there, or the call itself where it has no such key. arguments is a VARIANT, null with an error."""

    def of(whole: Column) -> Column:
        inner = F.try_variant_get(whole, "$.arguments", "variant")
        kind = F.coalesce(F.schema_of_variant(inner), F.lit(""))
        text = strict_json(F.try_variant_get(whole, "$.arguments", "string"))
        chosen = F.when(inner.isNull(), whole).when(kind == "STRING", text).otherwise(inner)
        wrong = whole.isNull() | ((kind == "STRING") & text.isNull())
        return F.struct(F.when(~wrong, chosen).alias("arguments"), F.when(wrong, "Invalid JSON in tool call").alias("error"))

    return let(strict_json(call), of)

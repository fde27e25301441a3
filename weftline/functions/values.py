"""Lenient comparison and flattening of JSON values, as vectorised UDFs over JSON texts.

Built-in functions reach one level of a document; these walk it to any depth.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def same_value(expected: Any, actual: Any, groups: dict[str, int] | None = None) -> bool:
    """Whether actual is as good as expected: null expects nothing; texts ignore case and may be
    of one group of synonyms or equal as JSON objects; numbers are within 1e-4 once one of them is
    fractional; lists go item by item, objects by the expected keys."""
    if expected is None:
        return True
    if actual is None:
        return expected in ("", [], {}) and not isinstance(expected, (bool, int, float))
    match expected, actual:
        case str(), str():
            if expected[:1] == actual[:1] == "{":
                try:
                    return same_value(json.loads(expected), json.loads(actual), groups)
                except ValueError:
                    pass
            a, b = expected.lower(), actual.lower()
            group = (groups or {}).get(a)
            return a == b or group is not None and group == (groups or {}).get(b)
        case (int() | float()), (int() | float()):
            return abs(expected - actual) < 1e-4 if float in (type(expected), type(actual)) else expected == actual
        case list(), list():
            return len(expected) == len(actual) and all(same_value(e, a, groups) for e, a in zip(expected, actual))
        case dict(), dict():
            return all(v is None or k in actual and same_value(v, actual[k], groups) for k, v in expected.items())
    return expected == actual


def parsed(text: str | None) -> Any:
    """A JSON value; text that is none stands for itself."""
    if text is None:
        return None
    try:
        return json.loads(text)
    except ValueError:
        return text


def values_match(groups: dict[str, int] | None = None) -> Callable[[Column, Column], Column]:
    """A function of two JSON text columns. groups: synonym (lower case) to group, a small dimension."""

    @F.pandas_udf(T.BooleanType())
    def match(expected: pd.Series, actual: pd.Series) -> pd.Series:
        return pd.Series([same_value(parsed(e), parsed(a), groups) for e, a in zip(expected, actual)], dtype=bool)

    return match


def mismatched_keys(groups: dict[str, int] | None = None) -> Callable[[Column, Column], Column]:
    """Keys of the expected JSON object whose values the actual one doesn't match, sorted."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def keys(expected: pd.Series, actual: pd.Series) -> pd.Series:
        def one(e, a):
            e, a = parsed(e), parsed(a)
            e, a = e if isinstance(e, dict) else {}, a if isinstance(a, dict) else {}
            return sorted(k for k, v in e.items() if not same_value(v, a.get(k), groups))

        return pd.Series([one(e, a) for e, a in zip(expected, actual)], dtype=object)

    return keys


def leaves(value: Any) -> Iterator[str]:
    """Texts of all leaves but nulls; booleans in lower case."""
    if isinstance(value, dict):
        value = list(value.values())
    if isinstance(value, list):
        for v in value:
            yield from leaves(v)
    elif isinstance(value, bool):
        yield str(value).lower()
    elif value is not None:
        yield str(value)


@F.pandas_udf(T.ArrayType(T.StringType()))
def leaf_values(documents: pd.Series) -> pd.Series:
    return pd.Series([list(leaves(parsed(d))) for d in documents], dtype=object)


@F.pandas_udf(T.StringType())
def normalised(documents: pd.Series) -> pd.Series:
    """Floats rounded half-even to two places as Python does, texts in lower case, keys sorted."""

    def norm(v: Any) -> Any:
        if isinstance(v, dict):
            return {k: norm(x) for k, x in v.items()}
        if isinstance(v, list):
            return [norm(x) for x in v]
        return round(v, 2) if isinstance(v, float) else v.lower() if isinstance(v, str) else v

    return pd.Series([None if d is None else json.dumps(norm(parsed(d)), sort_keys=True, ensure_ascii=False) for d in documents], dtype=object)


FENCE = re.compile(r"```(?:json)?\s*\n?(.*?)```", re.S)


@F.pandas_udf(T.StringType())
def json_in_text(texts: pd.Series) -> pd.Series:
    """The first JSON value in a model's answer: fenced, or from the first bracket to its last
    partner; trailing commas are forgiven. Null if there is none."""

    def one(text: str | None) -> str | None:
        if not text:
            return None
        fenced = FENCE.search(text)
        tries = [fenced[1]] if fenced else []
        for a, b in ("[]", "{}"):
            lo, hi = text.find(a), text.rfind(b)
            if 0 <= lo < hi:
                tries.append(text[lo : hi + 1])
        tries.sort(key=lambda t: text.find(t))
        for t in [*tries, text]:
            for candidate in (t, re.sub(r",\s*([\]}])", r"\1", t)):
                try:
                    return json.dumps(json.loads(candidate), ensure_ascii=False)
                except ValueError:
                    continue
        return None

    return pd.Series([one(t) for t in texts], dtype=object)

"""Constraints written as text, compiled to Column expressions.

    constraint := all (OR all)*        all := one (AND one)*        one := NOT one | ( constraint ) | test
    test := field (= | <> | != | < | <= | > | >=) value
          | field IS [NOT] NULL
          | field [NOT] IN ( value, ... )
          | field [NOT] BETWEEN value AND value
    value := 'text' | "text" | number | true | false | bare words

Keywords are known in any case. A value takes the type of its field; a text field takes numbers and words as they
stand. What the grammar doesn't know, an unknown field or a value that its field can't hold raises ConstraintError:
nothing is passed over. Nulls follow SQL: a test on a null is neither true nor false.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import date, datetime
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^']|'')*'|"(?:[^"]|"")*")|(?P<sign><=|>=|<>|!=|[=<>(),])|(?P<word>[^\s'"=<>!(),]+))""")
KEYWORDS = {"and", "or", "not", "is", "null", "in", "between"}
COMPARE = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


class ConstraintError(ValueError):
    """A constraint that can't be compiled."""


class _Compiler:
    """Reads one constraint from left to right."""

    def __init__(self, text: str, fields: dict[str, tuple[Column, T.DataType]]):
        self.text, self.fields, self.at = text, fields, 0
        self.tokens: list[tuple[str, str]] = []
        end = 0
        while text[end:].strip():
            found = TOKEN.match(text, end)
            if not found:
                raise self.error(f"can't be read from {text[end : end + 20]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            end = found.end()

    def error(self, why: str) -> ConstraintError:
        return ConstraintError(f"constraint {self.text!r}: {why}")

    def peek(self) -> str:
        """The next sign or keyword, in lower case; '' before anything else."""
        if self.at < len(self.tokens):
            kind, word = self.tokens[self.at]
            if kind == "sign" or kind == "word" and word.lower() in KEYWORDS:
                return word.lower()
        return ""

    def take(self, *wanted: str) -> bool:
        if self.peek() in wanted:
            self.at += 1
            return True
        return False

    def must(self, wanted: str) -> None:
        if not self.take(wanted):
            raise self.error(f"{wanted.upper()} is missing")

    def whole(self) -> Column:
        if not self.tokens:
            raise self.error("is empty")
        made = self.any()
        if self.at < len(self.tokens):
            raise self.error(f"{self.tokens[self.at][1]!r} is too much")
        return made

    def any(self) -> Column:
        made = self.all()
        while self.take("or"):
            made = made | self.all()
        return made

    def all(self) -> Column:
        made = self.one()
        while self.take("and"):
            made = made & self.one()
        return made

    def one(self) -> Column:
        if self.take("not"):
            return ~self.one()
        if self.take("("):
            made = self.any()
            self.must(")")
            return made
        return self.test()

    def test(self) -> Column:
        kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind != "word" or self.peek():
            raise self.error("a field is missing")
        if name not in self.fields:
            raise self.error(f"no field {name!r}")
        self.at += 1
        column, type_ = self.fields[name]
        if self.take("is"):
            negated = self.take("not")
            self.must("null")
            return column.isNotNull() if negated else column.isNull()
        negated = self.take("not")
        if self.take("in"):
            self.must("(")
            values = [self.value(type_)]
            while self.take(","):
                values.append(self.value(type_))
            self.must(")")
            made = column.isin(*values)
        elif self.take("between"):
            low = self.value(type_)
            self.must("and")
            made = column.between(low, self.value(type_))
        elif not negated and self.peek() in COMPARE:
            sign = self.peek()
            self.at += 1
            return COMPARE[sign](column, self.value(type_))
        else:
            raise self.error(f"no test of {name!r}")
        return ~made if negated else made

    def value(self, type_: T.DataType) -> Column:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "text":
            quoted = self.tokens[self.at][1]
            self.at += 1
            return self.literal(quoted[1:-1].replace(quoted[0] * 2, quoted[0]), type_)
        words = []
        while self.at < len(self.tokens) and self.tokens[self.at][0] == "word" and not self.peek():
            words.append(self.tokens[self.at][1])
            self.at += 1
        if not words:
            raise self.error("a value is missing")
        return self.literal(" ".join(words), type_)

    def literal(self, word: str, type_: T.DataType) -> Column:
        try:
            match type_:
                case T.StringType():
                    return F.lit(word)
                case T.BooleanType():
                    return F.lit({"true": True, "false": False}[word.lower()])
                case T.IntegralType():
                    number = Decimal(word)
                    return F.lit(int(number)) if number == int(number) else F.lit(number)
                case T.FractionalType():
                    return F.lit(float(word)) if isinstance(type_, (T.FloatType, T.DoubleType)) else F.lit(Decimal(word))
                case T.DateType():
                    return F.lit(date.fromisoformat(word))
                case T.TimestampType() | T.TimestampNTZType():
                    return F.lit(datetime.fromisoformat(word).isoformat(" ")).cast(type_)
        except (KeyError, ValueError, OverflowError, InvalidOperation):
            raise self.error(f"{word!r} is no {type_.simpleString()}") from None
        raise self.error(f"fields of {type_.simpleString()} can't be compared")


def fields_of(rows: DataFrame) -> dict[str, tuple[Column, T.DataType]]:
    """The fields that a constraint over rows may name: columns, and members of structs by dotted names."""
    found: dict[str, tuple[Column, T.DataType]] = {}

    def add(name: str, column: Column, type_: T.DataType) -> None:
        found[name] = column, type_
        if isinstance(type_, T.StructType):
            for f in type_.fields:
                add(f"{name}.{f.name}", column[f.name], f.dataType)

    for f in rows.schema.fields:
        add(f.name, F.col(f"`{f.name}`"), f.dataType)
    return found


def compiled(rows: DataFrame, constraint: str) -> Column:
    return _Compiler(constraint, fields_of(rows)).whole()


def filter_by_constraints(rows: DataFrame, constraints: Iterable[str]) -> DataFrame:
    """rows that meet all constraints."""
    for c in constraints:
        rows = rows.filter(compiled(rows, c))
    return rows


def constraints_met(rows: DataFrame, constraints: dict[str, str]) -> DataFrame:
    """rows plus met: the names of the constraints that a row meets, in order; all in one pass over rows."""
    named = [F.struct(F.lit(name).alias("name"), F.coalesce(compiled(rows, c), F.lit(False)).alias("yes")) for name, c in constraints.items()]
    met = F.transform(F.filter(F.array(*named), lambda x: x["yes"]), lambda x: x["name"])
    return rows.withColumn("met", met)


def lacking_keys(analysis: Column, required: Iterable[str]) -> Column:
    """Required keys that a constraint analysis (a map) lacks or holds null."""
    return F.filter(F.array(*[F.lit(k) for k in required]), lambda k: F.coalesce(F.element_at(analysis, k), F.lit(None)).isNull())

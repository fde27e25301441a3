"""Constraint plans as data: each requirement is a DataFrame step, compiled by composition."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.selection import Where, sample_k, select_where, transitions, without_relationship


@dataclass(frozen=True)
class Requirement:
    """Instances of `table`, by way of: direct; relationship_first, joined to `joins` (table, its
    key, our column); relationship_exclude, minus rows of `joins`' first that share its columns."""

    table: str
    approach: str = "direct"
    joins: tuple[tuple[str, str, str], ...] = ()
    where: tuple[Where, ...] = ()
    keys: tuple[str, ...] = ()


@dataclass(frozen=True)
class Plan:
    requirement: Requirement
    state: str | None = None  # a column that must have a valid transition
    sample: int | None = None
    ident: str = "id"
    group: tuple[str, ...] = field(default=())


def run_plan(plan: Plan, tables: dict[str, DataFrame], valid: DataFrame | None = None) -> DataFrame:
    """The plan's valid instances; a state without transition drops its rows."""
    r = plan.requirement
    rows = select_where(tables[r.table], *r.where)
    if r.approach == "relationship_first":
        for name, key, column in r.joins:
            rows = rows.join(tables[name].select(F.col(key).alias(column)).distinct(), column, "left_semi")
    elif r.approach == "relationship_exclude":
        rows = without_relationship(rows, tables[r.joins[0][0]], list(r.keys))
    elif r.approach != "direct":
        raise ValueError(f"unknown approach {r.approach!r}")
    if plan.state:
        rows = transitions(rows, valid, plan.state)
    return sample_k(rows, list(plan.group), plan.ident, plan.sample) if plan.sample else rows

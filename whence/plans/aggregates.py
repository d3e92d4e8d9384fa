"""Which aggregates made a query's columns, read from the plan's expressions."""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.sql import DataFrame

from ..functions.influence import ALSO, Influence, influence
from .catalyst import Bridge


class Made(NamedTuple):
    """An aggregate: its depth (0 is the outermost), its place there, its function as influence names it, and its column."""

    depth: int
    slot: int
    function: str
    column: str


def _function(b: Bridge, expression: Any) -> str:
    fn = expression.aggregateFunction()
    name = ALSO.get(fn.prettyName(), fn.prettyName())
    if name == "percentile":
        more = [x for x in b.items(fn.children())[1:2] if x.foldable()]
        if more:
            return f"percentile:{float(more[0].eval(None))}"
    return name


def aggregate_levels(df: DataFrame) -> list[list[Made]]:
    """The aggregates of each aggregation of the analysed plan, outermost first."""
    b = Bridge(df.sparkSession)
    out: list[list[Made]] = []

    def visit(node: Any) -> None:
        if b.kind(node) == "Aggregate":
            row: list[Made] = []
            for named in b.items(node.aggregateExpressions()):
                for a in b.aggregates(named):
                    row.append(Made(len(out), len(row), _function(b, a), named.name()))
            if row:
                out.append(row)
        for c in b.children(node):
            visit(c)

    visit(b.plan(df))
    return out


def aggregate_slots(df: DataFrame) -> dict[str, tuple[int, str]]:
    """Column of the outermost aggregation -> (place, function)."""
    levels = aggregate_levels(df)
    return {m.column: (m.slot, m.function) for m in levels[0]} if levels else {}


def aggregate_of(df: DataFrame) -> str | None:
    """The function of the outermost aggregate; None without one."""
    levels = aggregate_levels(df)
    return levels[0][0].function if levels else None


def column_level(df: DataFrame, column: str) -> Made:
    """The aggregate that made a column, the outermost if several did."""
    for level in aggregate_levels(df):
        for m in level:
            if m.column == column:
                return m
    raise KeyError(f"no aggregate made a column {column!r}")


def influence_auto(df: DataFrame, elements: list, fallback: str | None = None) -> Influence:
    """Scores of elements for the query's own aggregate, or for `fallback` where that has no closed form."""
    name = aggregate_of(df) or fallback
    if name is None:
        raise ValueError("the query has no aggregate")
    try:
        return influence(elements, name)
    except ValueError:
        if fallback is None or fallback == name:
            raise
        return influence(elements, fallback)

"""Influence: how much an aggregate would change if one of its records were removed (full value minus value without it).

Closed forms over one pass exist for sum, count, avg, max and min; percentiles need a sort of the group, and any
other function can be registered or left to leave-one-out evaluation. `influences` computes the same on a table by aggregation and joins; no group is sorted in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pairs_of(elements: Iterable) -> list[tuple[Any, Any]]:
    """(id, value) for tuples, for tagged values (by their ids) and for bare values (by position)."""
    out = []
    for i, e in enumerate(elements):
        if hasattr(e, "dprov"):
            ids = sorted(e.dprov)
            out.append((ids[0] if len(ids) == 1 else tuple(ids) or i, e.value))
        elif isinstance(e, tuple) and len(e) == 2:
            out.append(e)
        else:
            out.append((i, e))
    return out


class Influence:
    """Scores by record id."""

    def __init__(self, scores: dict, method: str):
        self.scores, self.method = scores, method

    def of(self, ident: Any) -> float:
        return self.scores.get(ident, 0.0)

    def ranked(self) -> list[tuple[Any, float]]:
        """By size of the score, largest first."""
        return sorted(self.scores.items(), key=lambda kv: -abs(kv[1]))

    def top(self, k: int = 1) -> list[Any]:
        return [i for i, _ in self.ranked()[:k]]

    def __repr__(self) -> str:
        return f"Influence({self.method}, {len(self.scores)} records)"


def _present(pairs: list) -> list:
    return [(i, v) for i, v in pairs if v is not None]


def _average(pairs: list) -> dict:
    known = _present(pairs)
    n = len(known)
    out = dict.fromkeys((i for i, _ in pairs), 0.0)
    if n > 1:
        mean = sum(v for _, v in known) / n
        out.update((i, (v - mean) / (n - 1)) for i, v in known)
    return out


def _extreme(pairs: list, sign: int) -> dict:
    out = dict.fromkeys((i for i, _ in pairs), 0.0)
    known = sorted(_present(pairs), key=lambda x: -sign * x[1])
    if len(known) > 1 and known[0][1] != known[1][1]:
        out[known[0][0]] = known[0][1] - known[1][1]
    return out


def interpolated(values: list[float], p: float) -> float | None:
    """The exact percentile of sorted values, linear between neighbours."""
    if not values:
        return None
    at = p * (len(values) - 1)
    lo, hi = math.floor(at), math.ceil(at)
    return values[lo] + (values[hi] - values[lo]) * (at - lo)


def percentile_influence(pairs: list, p: float) -> dict:
    out = dict.fromkeys((i for i, _ in pairs), 0.0)
    known = sorted(_present(pairs), key=lambda x: x[1])
    n = len(known)
    if n > 1:
        s = [v for _, v in known]
        full, at = interpolated(s, p), p * (n - 2)
        lo, hi = math.floor(at), math.ceil(at)
        for r, (i, _) in enumerate(known):
            a, b = (s[k + 1] if k >= r else s[k] for k in (lo, hi))
            out[i] = full - (a + (b - a) * (at - lo))
    return out


Closed = Callable[[list], dict]
_CLOSED: dict[str, Closed] = {
    "sum": lambda pairs: {i: float(v or 0) for i, v in pairs},
    "count": lambda pairs: {i: 0.0 if v is None else 1.0 for i, v in pairs},
    "avg": _average,
    "max": lambda pairs: _extreme(pairs, 1),
    "min": lambda pairs: _extreme(pairs, -1),
    "median": lambda pairs: percentile_influence(pairs, 0.5),
}
_PLAIN: dict[str, Callable] = {}
#: Other names of the same aggregates.
ALSO = {"mean": "avg", "average": "avg", "approx_percentile": "percentile", "percentile_approx": "percentile", "percentile_cont": "percentile"}


def register_influence(name: str, closed: Closed, aggregate: Callable | None = None) -> None:
    """A closed form for an aggregate of one's own; `aggregate` computes it, for leave_one_out to check against."""
    _CLOSED[name.lower()] = closed
    if aggregate is not None:
        _PLAIN[name.lower()] = aggregate


def leave_one_out(elements: Iterable, agg: Callable, distance: Callable | None = None) -> Influence:
    """By n + 1 evaluations of `agg` over lists of values."""
    pairs = pairs_of(elements)
    values = [v for _, v in pairs]
    full = agg(values)
    gap = distance or (lambda a, b: (a or 0) - (b or 0))
    return Influence({i: gap(full, agg(values[:k] + values[k + 1 :])) for k, (i, _) in enumerate(pairs)}, "leave-one-out")


def canonical(agg: str) -> tuple[str, float | None]:
    """The aggregate's own name, and the fraction of a percentile ("percentile:0.95")."""
    name, _, p = agg.lower().partition(":")
    name = ALSO.get(name, name)
    if name == "percentile":
        if not p:
            raise ValueError("name the fraction of a percentile, as in percentile:0.95")
        return name, float(p)
    return name, 0.5 if name == "median" else None


def influence(elements: Iterable, agg: str | Callable) -> Influence:
    """Scores for an aggregate by name, or for any function by leaving one out."""
    if callable(agg):
        return leave_one_out(elements, agg)
    name, p = canonical(agg)
    pairs = pairs_of(elements)
    if name == "percentile":
        return Influence(percentile_influence(pairs, p), name)
    if name in _CLOSED:
        return Influence(_CLOSED[name](pairs), name)
    if name in _PLAIN:
        return leave_one_out(pairs, _PLAIN[name])
    raise ValueError(f"no closed form for {agg}; register one or pass a function")


def has_closed_form(agg: str) -> bool:
    """Whether `influences` scores this aggregate."""
    name, _, p = agg.lower().partition(":")
    name = ALSO.get(name, name)
    return bool(p) if name == "percentile" else name in ("sum", "count", "avg", "max", "min", "median")


#: Records of a group up to which all are ranked for a percentile; beyond, only those between two approximate percentiles, this far to either side of the cut; and their accuracy.
RANKED, ASIDE, ACCURACY = 20_000, 0.001, 10_000


def _around_the_cut(members: DataFrame, group: str, p: float) -> DataFrame:
    """group, __n, and the values at the few places around the cut: __full (the percentile), __a and __b (the values there), __a1 and __b1 (those one place on)."""
    known = members.filter("__v is not null")
    low, high = max(0.0, p - ASIDE), min(1.0, p + ASIDE)
    ends = F.percentile_approx("__v", [low, high], ACCURACY)
    stats = known.groupBy(group).agg(F.count("*").alias("__n"), ends.alias("__ends"), F.min("__v").alias("__least"), F.max("__v").alias("__most"))
    whole = F.col("__n") <= RANKED
    stats = stats.select(group, "__n", F.when(whole | F.lit(low == 0.0), F.col("__least")).otherwise(F.col("__ends")[0]).alias("__from"), F.when(whole | F.lit(high == 1.0), F.col("__most")).otherwise(F.col("__ends")[1]).alias("__to"))
    # Equal values are one row with a count, so that ties need no order and a frequent value no room.
    placed = known.groupBy(group, "__v").agg(F.count("*").alias("__m")).join(stats, group)
    before = placed.groupBy(group).agg(F.coalesce(F.sum(F.when(F.col("__v") < F.col("__from"), F.col("__m"))), F.lit(0)).alias("__before"))
    near = placed.filter((F.col("__v") >= F.col("__from")) & (F.col("__v") <= F.col("__to"))).join(before, group)
    over = Window.partitionBy(group).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("__end", F.col("__before") + F.sum("__m").over(over)).withColumn("__start", F.col("__end") - F.col("__m"))
    n = F.col("__n")
    at, cut = F.lit(p) * (n - 1), F.lit(p) * (n - 2)
    places = {"lo": F.floor(at), "hi": F.ceil(at), "a": F.floor(cut), "b": F.ceil(cut), "a1": F.floor(cut) + 1, "b1": F.ceil(cut) + 1}
    value = lambda k: F.max(F.when((F.col("__start") <= k) & (k < F.col("__end")), F.col("__v")))
    got = near.groupBy(group, "__n").agg(*[value(F.least(k, n - 1)).alias(f"__{x}") for x, k in places.items()])
    full = F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (at - F.floor(at))
    return got.select(group, "__n", full.alias("__full"), "__a", "__b", "__a1", "__b1")


def influences(members: DataFrame, agg: str, group: str = "out", ident: str = "in", value: str = "value") -> DataFrame:
    """The table with a column `influence`: the same scores, nothing collected.

    What a score needs of its group (sums, the two greatest values, the values around a percentile's cut) is aggregated first, map-side, and joined back; a group of any size, a global
    aggregate's too, is spread over all tasks.
    """
    name, p = canonical(agg)
    v = F.col(value).cast("double")
    if name == "sum":
        return members.withColumn("influence", F.coalesce(v, F.lit(0.0)))
    if name == "count":
        return members.withColumn("influence", F.when(v.isNull(), 0.0).otherwise(1.0))
    rows = members.withColumn("__v", v)
    if name == "avg":
        stats = rows.groupBy(group).agg(F.count("__v").alias("__n"), F.avg("__v").alias("__mean"))
        score: Column = F.when(F.col("__v").isNull() | (F.col("__n") <= 1), 0.0).otherwise((F.col("__v") - F.col("__mean")) / (F.col("__n") - 1))
    elif name in ("max", "min"):
        best = F.max if name == "max" else F.min
        top = rows.groupBy(group).agg(best("__v").alias("__top"))
        stats = rows.filter("__v is not null").groupBy(group, "__v").agg(F.count("*").alias("__m")).join(top, group)
        is_top = F.col("__v") == F.col("__top")
        stats = stats.groupBy(group, "__top").agg(F.max(F.when(is_top, F.col("__m"))).alias("__times"), best(F.when(~is_top, F.col("__v"))).alias("__next"))
        score = F.when((F.col("__v") == F.col("__top")) & (F.col("__times") == 1) & F.col("__next").isNotNull(), F.col("__v") - F.col("__next")).otherwise(0.0)
    elif name in ("percentile", "median"):
        stats = _around_the_cut(rows, group, p)
        cut = F.lit(p) * (F.col("__n") - 2)
        a, b = (F.when(F.col("__v") <= F.col(f"__{x}"), F.col(f"__{x}1")).otherwise(F.col(f"__{x}")) for x in "ab")  # what stands there without the record
        score = F.when(F.col("__v").isNull() | (F.col("__n") <= 1), 0.0).otherwise(F.col("__full") - (a + (b - a) * (cut - F.floor(cut))))
    else:
        raise ValueError(f"no closed form for {agg}")
    return rows.join(stats, group, "left").select(*members.columns, F.coalesce(score, F.lit(0.0)).alias("influence"))

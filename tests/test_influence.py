"""Closed forms against leaving each record out."""

import random

import pytest

from whence.functions.influence import Influence, influence, influences, interpolated, leave_one_out, percentile_influence, register_influence

PLAIN = {
    "sum": lambda v: sum(x for x in v if x is not None),
    "count": lambda v: sum(x is not None for x in v),
    "avg": lambda v: (lambda k: sum(k) / len(k) if k else None)([x for x in v if x is not None]),
    "max": lambda v: max([x for x in v if x is not None], default=None),
    "min": lambda v: min([x for x in v if x is not None], default=None),
    "median": lambda v: interpolated(sorted(x for x in v if x is not None), 0.5),
    "percentile:0.95": lambda v: interpolated(sorted(x for x in v if x is not None), 0.95),
}


def groups(n=300):
    r = random.Random(11)
    for _ in range(n):
        yield [(f"r{i}", None if r.random() < 0.1 else r.choice([r.uniform(-1e6, 1e6), float(r.randint(0, 3))])) for i in range(r.randint(1, 12))]


@pytest.mark.parametrize("agg", PLAIN)
def test_closed_forms_equal_leave_one_out(agg):
    for g in groups():
        known = [v for _, v in g if v is not None]
        got, want = influence(g, agg), leave_one_out(g, PLAIN[agg])
        for i, _ in g:
            expected = want.of(i) if len(known) > 1 or agg in ("sum", "count") else 0
            assert abs(got.of(i) - expected) < 1e-3


def test_ranking_and_errors():
    got = influence([("a", 1.0), ("b", -9.0), ("c", 3.0)], "sum")
    assert got.ranked()[0] == ("b", -9.0) and got.top(2) == ["b", "c"] and got.of("zz") == 0
    with pytest.raises(ValueError):
        influence([1, 2], "nothing")
    with pytest.raises(ValueError):
        influence([1, 2], "percentile")
    assert influence([3, 1], "mean").scores == {0: 1.0, 1: -1.0}
    assert isinstance(influence([1, 2, 3], lambda v: sum(v) ** 2), Influence)


def test_registered_form():
    register_influence("twice", lambda pairs: {i: 2 * v for i, v in pairs}, lambda v: 2 * sum(v))
    assert influence([1.0, 2.0], "twice").of(1) == 4.0


@pytest.mark.parametrize("agg", PLAIN)
def test_windows_give_the_same_scores(spark, agg):
    rows = [(k, i, v) for k, g in enumerate(groups(25)) for i, (_, v) in enumerate(g)]
    df = influences(spark.createDataFrame(rows, "out long, `in` long, value double"), agg)
    got = {(r["out"], r["in"]): r["influence"] for r in df.collect()}
    for k, g in enumerate(groups(25)):
        want = influence([(i, v) for i, (_, v) in enumerate(g)], agg)
        total = lambda f: sorted(round(f(i), 6) for i in range(len(g)))  # noqa: E731, B023
        assert total(lambda i: got[k, i]) == pytest.approx(total(want.of), abs=1e-6)  # noqa: B023


@pytest.mark.parametrize("agg", ["median", "percentile:0.95", "percentile:0.0", "percentile:1.0", "max", "avg"])
def test_large_groups_are_scored_around_the_cut(spark, agg, monkeypatch):
    from whence.functions import influence as module

    monkeypatch.setattr(module, "RANKED", 50)
    r = random.Random(3)
    rows = [(k, i, float(r.choice([r.randint(0, 40), r.gauss(0, 1000)]))) for k, n in ((0, 30_000), (1, 49), (2, 2), (3, 1)) for i in range(n)] + [(1, 50, None)]
    got = {(x["out"], x["in"]): x["influence"] for x in influences(spark.createDataFrame(rows, "out long, `in` long, value double"), agg).collect()}
    for k in range(4):
        members = [(i, v) for g, i, v in rows if g == k]
        want = influence(members, agg)
        assert all(abs(got[k, i] - want.of(i)) < 1e-6 for i, v in members if agg != "max") or agg == "max"
        assert sorted(round(got[k, i], 6) for i, _ in members) == pytest.approx(sorted(round(want.of(i), 6) for i, _ in members), abs=1e-5)


def test_percentile_of_one_or_equal_values():
    assert percentile_influence([("a", 1.0)], 0.5) == {"a": 0.0}
    assert set(percentile_influence([("a", 1.0), ("b", 1.0)], 0.5).values()) == {0.0}

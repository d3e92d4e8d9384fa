"""The tracer and the static analysis, without Spark."""

import random

import pytest

from whence.functions import taint
from whence.functions.taint import Tagged, column_provenance, control_prov, data_prov, raw, regime, register_model, tag, tag_row, taglist, trace
from whence.functions.udf import decode, encode


def to_mm(value, unit):
    return value if unit == "mm" else value * 304.8


def test_conditional_expression_splits_data_and_control():
    got = trace(to_mm)(tag(2.0, "value"), tag("in", "unit"))
    assert raw(got) == 609.6 and data_prov(got) == {"value"} and control_prov(got) == {"unit"} and regime(got) == "exact"


def branchy(a, b, c):
    if a > b:
        return b + 1
    elif a == b:
        return c
    return a


def test_statements_take_the_branch_of_the_plain_value():
    for a, b, c in ((3, 2, 9), (2, 2, 9), (1, 2, 9)):
        assert raw(trace(branchy)(tag(a, "a"), tag(b, "b"), tag(c, "c"))) == branchy(a, b, c)


def chain(a, b, c):
    return a < b < c


def test_comparison_chain_stops_at_the_operand_that_decides():
    got = trace(chain)(tag(3, "a"), tag(2, "b"), tag(9, "c"))
    assert raw(got) is False and data_prov(got) == {"a", "b"}
    got = trace(chain)(tag(1, "a"), tag(None, "b"), tag(9, "c"))
    assert raw(got) is None and data_prov(got) == {"a", "b"}


def either(a, b):
    return a or b


def test_boolean_operators_use_evaluated_operands_only():
    assert data_prov(trace(either)(tag(1, "a"), tag(2, "b"))) == {"a"}
    assert data_prov(trace(either)(tag(0, "a"), tag(2, "b"))) == {"a", "b"}


def loops(xs, factor):
    total = 0
    for x in xs:
        total += x * factor
    best = max(xs)
    squares = [x * x for x in xs if x > 1]
    return total, best, squares, len(xs), xs[1], xs[0:2]


def test_loops_comprehensions_models_subscripts():
    total, best, squares, n, second, part = trace(loops)(taglist([1, 5, 3], "x"), tag(2, "f")).value
    assert (raw(total), raw(best), raw(squares), raw(n), raw(second), raw(part)) == (18, 5, [25, 9], 3, 5, [1, 5])


def test_extremal_names_the_winner_and_sum_names_all():
    def biggest(xs):
        return max(xs)

    def added(xs):
        return sum(xs, 1)

    assert data_prov(trace(biggest)(taglist([1, 5, 3], "x"))) == {"x1"} and regime(trace(biggest)(taglist([1, 5], "x"))) == "model"
    got = trace(added)(taglist([1, 5, 3], "x"))
    assert raw(got) == 10 and data_prov(got) == {"x0", "x1", "x2"}


def unpacking(pairs):
    out = 0
    for a, b in pairs:
        out = out + a - b
    x, y = pairs[0]
    return f"{out}:{x + y:03d}"


def test_unpacking_and_format_strings():
    got = trace(unpacking)(Tagged([(1, 2), (5, 3)], frozenset(["p"])))
    assert raw(got) == "1:003" and data_prov(got) == {"p"}


def mystery(x):
    return x + 1


def calls(a, b):
    return mystery(a) * 2


def test_unknown_calls_are_coarse_and_user_models_replace_that():
    assert regime(trace(calls)(tag(1, "a"), tag(2, "b"))) == "coarse" and data_prov(trace(calls)(tag(1, "a"), tag(2, "b"))) == {"a"}
    register_model(mystery, lambda fn, args, kw: taint.Reason.reduce_all(fn(*raw(args)), args))
    try:
        assert regime(trace(calls)(tag(1, "a"), tag(2, "b"))) == "model"
    finally:
        del taint._MODELS[mystery]


def counting(n):
    while n > 0:
        n -= 1
    return n


def test_while_ends():
    assert raw(trace(counting)(tag(4, "n"))) == 0


def nulls(a, b):
    return a + b


def test_null_operand_gives_null_with_provenance():
    got = trace(nulls)(tag(None, "a"), tag(1, "b"))
    assert raw(got) is None and data_prov(got) == {"a", "b"}


def rows(row):
    return row["x"] if row["flag"] else row["y"]


def test_row_dicts():
    got = trace(rows)(tag_row({"x": 1, "y": 2, "flag": True}, "r."))
    assert data_prov(got) == {"r.x"} and control_prov(got) == {"r.flag"}
    assert column_provenance(rows) == (("x", "y"), ("flag",), "exact")


def static(a, b, c, d):
    if a > 0:
        out = b
    else:
        out = c
    return out


def stripped(x, i, xs):
    return xs[i] + len(x.strip())


def lambdas(x):
    return (lambda y: y + x)(1)


def test_static_analysis():
    assert column_provenance(to_mm) == (("value",), ("unit",), "exact")
    assert column_provenance(static) == (("b", "c"), ("a",), "exact")
    data, control, level = column_provenance(stripped)
    assert (data, control, level) == (("x", "xs"), ("i",), "coarse")
    assert column_provenance(lambdas) == (("x",), ("x",), "coarse")


def test_codes_round_trip():
    params = [f"p{i}" for i in range(30)]
    for _ in range(200):
        d, c = set(random.sample(params, 5)), set(random.sample(params, 3))
        level = random.choice(taint.REGIMES)
        code = encode(params, d, c, level)
        assert code < 1 << 63 and decode(code, params) == (tuple(sorted(d)), tuple(sorted(c)), level)
    with pytest.raises(ValueError):
        encode([*params, "p30"], set(), set(), "exact")


def jobs_layover(arrive, depart, limit):
    gap = depart - arrive
    return gap if gap > limit else limit


@pytest.mark.parametrize("fn, make", [(to_mm, lambda r: (r.uniform(0, 9), r.choice(["mm", "in"]))), (jobs_layover, lambda r: (r.randint(0, 9), r.randint(0, 20), r.randint(0, 9)))])
def test_lineage_covers_all_that_perturbation_finds(fn, make):
    r = random.Random(5)
    names = fn.__code__.co_varnames[: fn.__code__.co_argcount]
    for _ in range(100):
        args = make(r)
        got = trace(fn)(*[tag(a, n) for a, n in zip(args, names, strict=True)])
        for k, n in enumerate(names):
            other = [make(r)[k] for _ in range(5)]
            if any(fn(*args[:k], o, *args[k + 1 :]) != fn(*args) for o in other):
                assert n in data_prov(got) | control_prov(got)


def test_reads_down_to_elements():
    from whence.functions.udf import element_reads
    from whence.operators.programs import sentiment

    row = {"tokens": ["the", "bad", "day"], "scores": [9.0, -1.0, -3.0]}
    data, _, level = element_reads(sentiment.fn, sentiment.params, row)
    assert {"scores[1]", "scores[2]"} <= set(data) and "scores[0]" not in data and level == "exact"


def test_numpy_calls_are_coarse_until_modeled():
    np = pytest.importorskip("numpy")

    def scaled(v, u):
        return np.multiply(v, 2.0)

    assert regime(trace(scaled)(tag(1.0, "v"), tag("x", "u"))) == "coarse" and data_prov(trace(scaled)(tag(1.0, "v"), tag("x", "u"))) == {"v"}
    register_model(np.multiply, lambda fn, args, kw: taint.Reason.reduce_all(fn(*raw(args)), args))
    try:
        assert regime(trace(scaled)(tag(1.0, "v"), tag("x", "u"))) == "model"
    finally:
        del taint._MODELS[np.multiply]

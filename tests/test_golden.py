import math

import fixtures
import pytest

from rhoscope.engine import evaluate_one, monitor
from rhoscope.functions.metrics import HybridDistance
from rhoscope.operators.automaton import Automaton
from rhoscope.plans.dsl import always, eventually, next_, var
from rhoscope.plans.formula import Always, And, HybridPredicate, Implies, Interval, Next, Not, Or, Until
from rhoscope.plans.interpret import interpret
from rhoscope.sources.traces import TraceSet

x = var("x")
p1, p2 = x * -1.0 <= 2.0, x <= 2.0
G, F, X = always, eventually, next_

SCALAR_CASES = {
    "01": (Or(p1, p2), 2.0),
    "02": (F(p1), 3.7508),
    "03": (G(p2), 0.2492),
    "04": (X(p1), 2.5881),
    "05": (X(X(p1)), 3.1068),
    "06": (X(X(X(p1))), 3.4967),
    "07": (G(F(And(p2, F(p1)))), 1.184),
    "08": (Implies(p1, p2), 2.0),
    "09": (And(F(p1), G(Implies(p1, F(p2)))), 2.816),
    "10": (G(Implies(p1, F(Not(p1)))), -1.184),
    "11": (G(Or(Not(p1), F(G(Not(p1))))), -1.184),
    "12": (G(X(p1)), -math.inf),
    "13": (F(X(p1)), 3.7508),
    "14": (G(X(X(p1))), -math.inf),
    "15": (X(F(X(p1))), 3.7508),
    "16": (Until(p1, p2), 2.0),
    "17": (Until(p1, Until(p2, p1)), 2.0),
    "23": (Not(F(Not(And(p2, p1)), 0, 3.5)), 0.2492),
    "24": (Not(F(Not(p1), 0, 1)), 2.0),
    "25": (F(p1, 0.1, 30), 3.7508),
}

SYSTEM = Automaton([(1, 2, x <= 2.0), (2, 3, x <= 1.0), (2, 4, x * -1.0 <= -3.0), (4, 3, x * -1.0 <= -4.0), (3, 1, x * -1.0 <= 0.0)])
h1, h2, h3 = HybridPredicate(x * -1.0 <= 0.0, {1}, SYSTEM), HybridPredicate(x * -1.0 <= -5.0, {1}, SYSTEM), HybridPredicate(x <= 30.0, {2}, SYSTEM)
R, S = HybridDistance.robustness, HybridDistance.state_distance

HYBRID_CASES = {
    "01": (F(h1), R(52)),
    "02": (F(h2), R(47)),
    "03": (F(And(h1, h2)), R(47)),
    "04": (G(And(h1, h2)), S(2, -33)),
    "05": (F(Or(h1, h2)), R(52)),
    "10": (And(And(h1, h2), h3), S(2, -22)),
}


@pytest.fixture(scope="module")
def scalar(spark):
    traces = TraceSet.from_samples(spark, fixtures.scalar_samples())
    return traces.with_df(traces.df.cache())


@pytest.fixture(scope="module")
def hybrid(spark):
    traces = TraceSet.from_samples(spark, fixtures.hybrid_samples(), label="label")
    return traces.with_df(traces.df.cache())


@pytest.mark.parametrize("case", SCALAR_CASES)
def test_scalar_golden(scalar, case):
    formula, expected = SCALAR_CASES[case]
    assert evaluate_one(scalar, formula) == pytest.approx(expected, abs=1e-5)
    # The first sample of the monitor has the same value, and so has the plain interpreter.
    assert monitor(scalar, formula).orderBy("time").first()["robustness"] == pytest.approx(expected, abs=1e-5)
    assert interpret(formula, fixtures.scalar_samples())[0][1] == pytest.approx(expected, abs=1e-5)


@pytest.mark.parametrize("case", HYBRID_CASES)
def test_hybrid_golden(hybrid, case):
    formula, expected = HYBRID_CASES[case]
    assert evaluate_one(hybrid, formula) == expected
    assert interpret(formula, fixtures.hybrid_samples(), "label")[0][1] == expected


def test_hybrid_golden_11(spark):
    traces = TraceSet.from_samples(spark, fixtures.hybrid_samples("0.1:1@1 0.2:-2@3"), label="label")
    assert evaluate_one(traces, G(And(h1, h2))) == S(1, -2)


def values(spark, formula, samples, **options):
    rows = monitor(TraceSet.from_samples(spark, samples), formula, **options).orderBy("time").collect()
    return [r["robustness"] for r in rows]


def trace(*pairs):
    return [(float(t), {"m": float(v)}) for t, v in pairs]


m = -var("m") <= 0.0
T = trace((0, 4), (1, 2), (2, 3), (3, 1), (4, 3))
E = trace((0, 4), (1, 2), (2, 1), (3, 5), (4, 3))
UNITS = [
    ("always", Always(m), T, [1, 1, 1, 1, 3]),
    ("always[0,2]", Always(m, Interval(0, 2)), T, [2, 1, 1, 1, 3]),
    ("always[0,2)", Always(m, Interval(0, 2, closed=False)), T, [2, 2, 1, 1, 3]),
    ("always in the past", Always(m, Interval(-1.5, -0.5)), T, [math.inf, 4, 2, 3, 1]),
    ("eventually", eventually(m), T, [4, 3, 3, 3, 3]),
    ("eventually[0,2]", eventually(m, 0, 2), E, [4, 5, 5, 5, 3]),
    ("eventually[0,3)", eventually(m, 0, 3, closed=False), E, [4, 5, 5, 5, 3]),
    ("empty windows", Always(m, Interval(0.1, 0.5)), trace((0, 1), (1, 2), (2, 3)), [math.inf] * 3),
    ("empty windows", eventually(m, 0.1, 0.5), trace((0, 1), (1, 2), (2, 3)), [-math.inf] * 3),
    ("empty interval", Always(m, Interval(1, 1, closed=False)), T, [math.inf] * 5),
    ("next", Next(m), trace((0, 1), (1, 2), (2, 3), (3, 4)), [2, 3, 4, -math.inf]),
    ("not", Not(m), trace((0, 0), (1, 1), (2, 2), (3, 3)), [0, -1, -2, -3]),
]


@pytest.mark.parametrize(("formula", "samples", "expected"), [u[1:] for u in UNITS], ids=[u[0] for u in UNITS])
@pytest.mark.parametrize("half_open", ["kernel", "list"])
def test_units(spark, formula, samples, expected, half_open):
    assert values(spark, formula, samples, half_open=half_open) == expected
    assert [v for _, v in interpret(formula, samples)] == expected


PAIRS = [("or", Or, [(0, 1), (1, 0), (2, 4), (3, 6)], [1, 1, 4, 6]), ("and", And, [(0, 1), (1, 0), (2, 4), (3, 6)], [0, 0, 2, 3]), ("implies", Implies, [(0, 1), (1, 0), (-4, 2), (3, 6)], [1, 0, 4, 6]), ("until", Until, [(3, -2.1), (1.5, 3.7), (1.4, 1.2), (1.1, 2.2)], [1.5, 1.5, 1.2, 1.1]), ("until counts from the start", Until, [(-1, -3), (5, 4)], [-1, -1])]


@pytest.mark.parametrize(("kind", "pairs", "expected"), [p[1:] for p in PAIRS], ids=[p[0] for p in PAIRS])
def test_pairs(spark, kind, pairs, expected):
    samples = [(float(i), {"l": float(a), "r": float(b)}) for i, (a, b) in enumerate(pairs)]
    formula = kind(-var("l") <= 0.0, -var("r") <= 0.0)
    assert values(spark, formula, samples) == expected
    assert [v for _, v in interpret(formula, samples)] == expected


def test_strict_until_is_the_textbook_one(spark):
    samples = [(0.0, {"l": -1.0, "r": -3.0}), (1.0, {"l": 5.0, "r": 4.0})]
    formula = Until(-var("l") <= 0.0, -var("r") <= 0.0, strict=True)
    assert values(spark, formula, samples) == [-1, 4]
    assert [v for _, v in interpret(formula, samples)] == [-1, 4]

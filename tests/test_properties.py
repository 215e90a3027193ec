"""Window plans and the interpreter against the definitions, on random irregular traces and formulas."""

import random

import naive
import pytest

from rhoscope.engine import evaluate, monitor
from rhoscope.functions.metrics import HybridDistance
from rhoscope.operators.automaton import Automaton
from rhoscope.plans.dsl import always, eventually, var
from rhoscope.plans.formula import And, HybridPredicate, Implies, Next, Not, Or, Prev, Until
from rhoscope.plans.interpret import interpret
from rhoscope.sources.traces import TraceSet

x, y = var("x"), var("y")
SYSTEM = Automaton([(1, 2, x <= 0.5), (2, 3, [y <= 0.2, x >= 0.1]), (3, 1, y >= 0.4), (2, 1, x <= 0.9)])


def random_formula(rng, depth, leaves, strict):
    if depth == 0:
        return rng.choice(leaves)
    go = lambda: random_formula(rng, depth - 1, leaves, strict)
    low = rng.choice([-1.5, -0.5, 0.0, 0.3, 1.0])
    bounds = (low, low + rng.choice([0.0, 0.5, 2.0]))
    closed = rng.random() < 0.7
    return rng.choice(
        [
            lambda: Not(go()),
            lambda: And(go(), go()),
            lambda: Or(go(), go()),
            lambda: Implies(go(), go()),
            lambda: always(go()),
            lambda: eventually(go()),
            lambda: always(go(), *bounds, closed=closed),
            lambda: eventually(go(), *bounds, closed=closed),
            lambda: Next(go(), rng.choice([1, 2])),
            lambda: Prev(go()),
            lambda: Until(go(), go(), strict=strict and rng.random() < 0.3),
        ]
    )()


@pytest.mark.parametrize("seed", range(200))
def test_interpreter(seed):
    rng = random.Random(1000 + seed)
    for samples in random_traces(rng).values():
        f = random_formula(rng, 3, [x <= 0.7, y >= 0.2, x + y <= 1.0], strict=True)
        assert dict(interpret(f, samples)) == pytest.approx(dict(naive.interpret(f, samples)))


def random_traces(rng):
    out = {}
    for i in range(4):
        times = sorted(rng.sample([k / 10 for k in range(60)], rng.choice([1, 2, 7, 15])))
        out[f"t{i}"] = [(t, {"x": round(rng.uniform(-1, 2), 2), "y": round(rng.uniform(-1, 2), 2), "label": rng.choice([1, 2, 3, 4])}) for t in times]
    return out


def traces_of(spark, samples):
    rows = [(k, t, s["x"], s["y"], s["label"]) for k, v in samples.items() for t, s in v]
    return TraceSet.of(spark.createDataFrame(rows, "trace_id string, time double, x double, y double, label int"), label="label")


@pytest.mark.parametrize("seed", range(8))
def test_scalar(spark, seed):
    rng = random.Random(seed)
    samples = random_traces(rng)
    traces = traces_of(spark, samples)
    f = random_formula(rng, 3, [x <= 0.7, y >= 0.2, x + y <= 1.0], strict=True)
    want = {(k, t): v for k, s in samples.items() for t, v in naive.interpret(f, s)}
    assert {(k, t): v for k, s in samples.items() for t, v in interpret(f, s)} == pytest.approx(want)
    assert {(r.trace_id, r.time): r.robustness for r in monitor(traces, f, half_open=rng.choice(["kernel", "list"])).collect()} == pytest.approx(want)
    first = {k: interpret(f, s)[0][1] for k, s in samples.items()}
    assert {r.trace_id: r.robustness for r in evaluate(traces, f).collect()} == pytest.approx(first)


def hybrid_row(r):
    return HybridDistance(0) if r.kind == "unreachable" else HybridDistance.robustness(r.dist) if r.kind == "robustness" else HybridDistance.state_distance(r.hops, r.dist)


@pytest.mark.parametrize("seed", range(6))
def test_hybrid(spark, seed):
    rng = random.Random(100 + seed)
    samples = random_traces(rng)
    traces = traces_of(spark, samples)
    leaves = [HybridPredicate(x <= 0.7, {1}, SYSTEM), HybridPredicate(None, {2, 3}, SYSTEM), HybridPredicate(y >= 0.0, (), SYSTEM)]
    f = random_formula(rng, 3, leaves, strict=False)
    want = {(k, t): v for k, s in samples.items() for t, v in naive.interpret(f, s, "label")}
    assert {(k, t): v for k, s in samples.items() for t, v in interpret(f, s, "label")} == want
    assert {(r.trace_id, r.time): hybrid_row(r) for r in monitor(traces, f).collect()} == want
    assert {r.trace_id: hybrid_row(r) for r in evaluate(traces, f).collect()} == {k: interpret(f, s, "label")[0][1] for k, s in samples.items()}


@pytest.mark.parametrize("width", [0.35, 2.0, 50.0])
def test_blocks_change_nothing(spark, width):
    rng = random.Random(7)
    traces = traces_of(spark, random_traces(rng))
    for f in (always(x <= 0.5), Until(x <= 0.7, y >= 0.2), Next(x <= 0.5, 2), Prev(eventually(x <= 0.5)), always(x <= 0.5, -0.5, 1.5)):
        rows = lambda **o: sorted(map(tuple, monitor(traces, f, **o).collect()))  # noqa: B023, E731
        assert rows(block_width=width) == rows()


def test_kernel_and_native_windows_agree(spark):
    rng = random.Random(8)
    traces = traces_of(spark, random_traces(rng))
    leaf = HybridPredicate(x <= 0.7, {1}, SYSTEM)
    for f in (always(x <= 0.5, 0, 2.0), eventually(leaf, -1, 1), always(leaf, 0.2, 3)):
        rows = lambda **o: sorted(map(str, monitor(traces, f, **o).collect()))  # noqa: B023, E731
        assert rows(wide="kernel") == rows()

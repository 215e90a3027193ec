"""Kernels over many traces at once, and blocks of time that are many and short."""

import math
import random

import numpy as np
import pytest

from rhoscope.engine import monitor
from rhoscope.operators import blocked, kernels
from rhoscope.plans.dsl import always, eventually, until, var
from rhoscope.plans.formula import Interval, TraceFunction
from rhoscope.sources.traces import TraceSet

x = var("x")


@pytest.fixture(scope="module")
def traces(spark):
    """Traces of 1 to 60 samples on a grid of tenths, so that samples lie at windows' ends; times below 0 too."""
    pick = random.Random(3)
    rows = [(k, (t + k) / 10 - 3.0, float(pick.randrange(9))) for k in range(25) for t in pick.sample(range(120), pick.randrange(1, 61))]
    return TraceSet.of(spark.createDataFrame(rows, "trace_id long, time double, x double").cache())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_edges_of_many_traces_are_those_of_each():
    pick = np.random.default_rng(5)
    for closed in (True, False):
        size = pick.integers(1, 12, 40)
        runs = np.r_[0, np.cumsum(size)]
        times = np.concatenate([np.sort(pick.integers(0, 30, n) / 10) for n in size])
        start, end = kernels.window_edges(runs, times, Interval(-0.3, 0.4, closed))
        for a, b in zip(runs[:-1], runs[1:]):
            at = kernels.window_edges(np.array([0, b - a]), times[a:b], Interval(-0.3, 0.4, closed))
            assert (start[a:b] - a == at[0]).all() and (end[a:b] - a == at[1]).all()


def test_blocks_are_no_calls_of_their_own(spark, traces):
    f = always(x <= 5.0, 0.3, 1.2, closed=False)
    df = monitor(traces, f, block_width=0.5)
    assert "MapInArrow" in plan(df) and "FlatMapGroups" not in plan(df)
    assert rows(df) == rows(monitor(traces, f, half_open="list"))


@pytest.mark.parametrize("batch", [1, 7])
def test_traces_longer_than_a_batch(spark, traces, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        for f in (eventually(x <= 5.0, -0.7, 0.2, closed=False), always(x <= 5.0, 0.1, 2.0, closed=False)):
            want = rows(monitor(traces, f, half_open="list"))
            assert rows(monitor(traces, f)) == want and rows(monitor(traces, f, block_width=1.1)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_samples_visit_blocks_in_reach_only(spark):
    """A window of a day less a minute, in blocks of a day, reaches from two blocks, or three where days meet."""
    df = spark.range(1000).selectExpr("id * 8640.0D + 1 AS time")
    held = blocked._visits(blocked.with_blocks(df, "time", 86400.0), "time", Interval(60, 86400, False), 86400.0)
    assert held.count() <= 2200
    # Whatever a window reaches by sums of doubles finds the sample in its block.
    times = [k / 10 for k in range(-40, 40)]
    held = blocked._visits(blocked.with_blocks(spark.createDataFrame([(t,) for t in times], "time double"), "time", 0.3), "time", Interval(0.1, 0.7), 0.3)
    found = {(r["time"], r[blocked.BLOCK]) for r in held.collect()}
    assert all((s, math.floor(t / 0.3)) in found for t in times for s in times if t + 0.1 <= s <= t + 0.7)


def test_functions_of_a_trace_get_one_trace(spark, traces):
    def total(times, values):
        values += 1.0
        return values.cumsum()

    want = {}
    for key, time, v in sorted(map(tuple, traces.df.select("trace_id", "time", "x").collect())):
        before = want.setdefault(key, [])
        before.append((time, 6.0 - v + (before[-1][1] if before else 0.0)))
    assert rows(monitor(traces, TraceFunction("total", x <= 5.0, total))) == [(k, t, v) for k in sorted(want) for t, v in want[k]]
    with pytest.raises(Exception, match="was given"):
        monitor(traces, TraceFunction("short", x <= 5.0, lambda times, values: values[1:])).collect()


def test_strict_until_of_many_traces_is_that_of_each():
    pick = np.random.default_rng(9)
    runs = np.r_[0, np.cumsum(pick.integers(1, 40, 30))]
    left, right = (np.where(pick.random(runs[-1]) < 0.1, pick.choice([math.nan, math.inf, -math.inf], runs[-1]), pick.integers(0, 20, runs[-1])) for _ in range(2))
    low, high = kernels.strict_until(runs, left, right)
    for after, got in ((-math.inf, low), (math.inf, high)):
        want = np.empty(runs[-1])
        for a, b in zip(runs[:-1], runs[1:]):
            x = after
            for i in range(b - 1, a - 1, -1):
                want[i] = x = np.fmin(left[i], np.fmax(right[i], x))
        assert (got == want).all()


def test_blocked_strict_until_folds_samples_in_python_once(spark, traces):
    """Python gets the samples once, by trace and block, and then a row per block; no call is a block's own."""
    f = until(x <= 5.0, x * -1.0 <= -3.0, strict=True)
    df = monitor(traces, f, block_width=0.7)
    whole = df._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in whole and sum(line.lstrip(" :+-").startswith("MapInArrow") for line in whole.splitlines()) == 2
    assert rows(df) == rows(monitor(traces, f))

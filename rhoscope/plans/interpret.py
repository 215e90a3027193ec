"""Evaluation of a formula on one trace in plain Python: for empty traces and for streams."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right

from rhoscope.errors import EmptyConstraints, MismatchedLengths, MissingVariable, NanCoefficient
from rhoscope.functions.metrics import UNREACHABLE, HybridDistance
from rhoscope.plans.formula import Always, And, Eventually, Formula, HybridPredicate, Implies, Next, Not, Or, Predicate, Prev, Until
from rhoscope.plans.rewrite import metric_of


class Scalar:
    top, bottom = math.inf, -math.inf

    @staticmethod
    def meet(a, b):
        return b if math.isnan(a) else a if math.isnan(b) else min(a, b)

    @staticmethod
    def join(a, b):
        return b if math.isnan(a) else a if math.isnan(b) else max(a, b)

    @staticmethod
    def neg(a):
        return -a


class Hybrid:
    top, bottom = HybridDistance.robustness(math.inf), UNREACHABLE
    meet, join, neg = staticmethod(HybridDistance.meet), staticmethod(HybridDistance.join), staticmethod(HybridDistance.__neg__)


def robustness(p: Predicate, state: dict) -> float:
    total = None
    for name, coefficient in p.coefficients:
        if math.isnan(coefficient):
            raise NanCoefficient(name)
        if state.get(name) is None:
            raise MissingVariable(name)
        value = float(state[name])
        if math.isnan(value):
            raise ValueError(f"variable {name!r} is NaN")
        total = coefficient * value if total is None else total + coefficient * value
    return float(p.constant) if total is None else float(p.constant) - total


def hybrid_distance(f: HybridPredicate, state: dict, label) -> HybridDistance:
    if not f.labels or label in f.labels:
        return HybridDistance.robustness(robustness(f.predicate, state) if f.predicate else math.inf)
    out, paths = UNREACHABLE, f.system.paths_from(label)
    for target in f.labels:
        if target in paths:
            distances = paths[target].next_guard.distances(lambda c: min(robustness(c, state), 0.0))
            if not distances:
                raise EmptyConstraints("a guard has no constraint")
            out = out.join(HybridDistance.state_distance(paths[target].hops, max(distances)))
    return out


def suffixes(samples: list[tuple[float, object]], pick, nothing) -> list[tuple[float, object]]:
    """Fold of every sample with all later ones."""
    out = []
    for t, v in reversed(samples):
        nothing = pick(nothing, v)
        out.append((t, nothing))
    return out[::-1]


def interpret(f: Formula, trace: list[tuple[float, dict]], label: str | None = None) -> list[tuple[float, object]]:
    """(time, metric) for every sample; ``trace`` has distinct times in order. Of an empty trace, Always and
    Eventually have one sample, at time 0."""
    m = Scalar if metric_of(f) == "scalar" else Hybrid
    go = lambda g: interpret(g, trace, label)
    if isinstance(f, Predicate):
        return [(t, robustness(f, s)) for t, s in trace]
    if isinstance(f, HybridPredicate):
        return [(t, hybrid_distance(f, s, s.get(label))) for t, s in trace]
    if isinstance(f, Not):
        return [(t, m.neg(v)) for t, v in go(f.operand)]
    if isinstance(f, (And, Or, Implies)):
        left, right = go(f.left), go(f.right)
        if len(left) != len(right):
            raise MismatchedLengths(len(left), len(right))
        both = {And: m.meet, Or: m.join, Implies: lambda a, b: m.join(m.neg(a), b)}[type(f)]
        return [(t, both(a, b)) for (t, a), (_, b) in zip(left, right, strict=True)]
    if isinstance(f, (Always, Eventually)):
        pick, nothing = (m.meet, m.top) if isinstance(f, Always) else (m.join, m.bottom)
        if not trace:
            return [(0.0, nothing)]
        inner = go(f.operand)
        if f.bounds is None:
            return suffixes(inner, pick, nothing)
        times, out = [t for t, _ in inner], []
        for t in times:
            first = bisect_left(times, t + f.bounds.low)
            last = (bisect_right if f.bounds.closed else bisect_left)(times, t + f.bounds.high)
            value = nothing
            for _, v in inner[first:last]:
                value = pick(value, v)
            out.append((t, value))
        return out
    if isinstance(f, Next):
        inner = go(f.operand)
        step = -f.k if isinstance(f, Prev) else f.k
        return [(t, inner[i + step][1] if 0 <= i + step < len(inner) else m.bottom) for i, (t, _) in enumerate(inner)]
    if isinstance(f, Until):
        left, right = go(f.left), go(f.right)
        if f.strict:
            after, out = m.bottom, []
            for (t, r), (_, v) in zip(reversed(right), reversed(left), strict=True):
                after = m.meet(v, m.join(r, after))
                out.append((t, after))
            return out[::-1]
        low, at, both = m.top, 0, []
        for t, r in right:
            while at < len(left) and left[at][0] <= t:
                low, at = m.meet(low, left[at][1]), at + 1
            both.append((t, m.meet(low, r)))
        return suffixes(both, m.join, m.bottom)
    raise TypeError(f"{type(f).__name__} can't be interpreted")

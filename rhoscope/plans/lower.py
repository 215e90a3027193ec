"""From a formula to a DataFrame plan.

Leaves and pointwise operators are column expressions of the row; only folds and shifts need windows. Windows
are placed in rounds: a round holds all windows whose operands are ready, so equal subformulas are computed
once and windows of one direction share a sort. All windows have one partitioning (the trace), so a formula
of any depth has one exchange. Folds over all later samples run over descending time, as a growing frame is
linear in a trace's length and a shrinking one is quadratic.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rhoscope.errors import EmptyConstraints, NanCoefficient
from rhoscope.functions.metrics import HYBRID, metric_named
from rhoscope.operators import blocked, kernels
from rhoscope.plans.formula import And, CustomExpression, CustomOperator, Fold, Formula, HybridPredicate, Implies, Interval, Next, Not, Or, Predicate, Prev, TraceFunction, Until
from rhoscope.plans.rewrite import core, metric_of, simplified, variables_of
from rhoscope.sources.traces import TraceSet


def offset(value: float, whole: bool) -> str:
    """A bound of a RANGE frame."""
    if math.isinf(value):
        return "UNBOUNDED FOLLOWING" if value > 0 else "UNBOUNDED PRECEDING"
    size = str(int(abs(value))) + "L" if whole else repr(abs(float(value))) + "D"
    return f"{size} {'FOLLOWING' if value >= 0 else 'PRECEDING'}"


class Context:
    """What a custom operator's ``lower`` may use."""

    def __init__(self, lowering: Lowering):
        self._lowering = lowering
        self.metric, self.keys, self.time = lowering.metric, lowering.traces.keys, lowering.traces.time

    def over_time(self, expression: str, descending: bool = False, frame: str = "") -> Column:
        """An SQL aggregate or window function over the trace in time order."""
        return self._lowering.over(expression, descending, frame)

    def column(self, value: Column) -> str:
        """Name of a new column that holds ``value``."""
        return self._lowering.named(value)


class Lowering:
    """Compiles one formula over one set of traces.

    Of the traces' columns those stay that the formula needs, and ``kept`` (None: all).
    """

    def __init__(self, traces: TraceSet, formula: Formula, block_width: float | None = None, half_open: str = "kernel", wide: str = "native", kept: tuple[str, ...] | None = ()):
        self.traces, self.metric = traces, metric_named(metric_of(formula))
        self.root = core(simplified(formula, self.metric.name == "scalar"))
        self.whole = isinstance(traces.df.schema[traces.time].dataType, (T.LongType, T.IntegerType))
        self.block_width, self.half_open, self.wide, self.kept = block_width, half_open, wide, kept
        self.df, self.count = self.pruned(), 0
        # A time that is NULL or NaN has no place in any window.
        at = F.col(f"`{traces.time}`")
        improper = at.isNull() if self.whole else at.isNull() | F.isnan(at)
        self.df = self.df.withColumn(traces.time, F.when(improper, F.raise_error(F.concat(F.lit("a time is NULL or NaN"), self.where())).cast(self.df.schema[traces.time].dataType)).otherwise(at))
        if block_width:
            self.df = blocked.with_blocks(self.df, traces.time, block_width)
        self.known: dict[Formula, Column] = {}
        self.rounds: dict[Formula, int] = {}

    def pruned(self) -> DataFrame:
        """The traces without columns that no part of the formula can read: kernels send what is left to Python."""
        wanted, todo = {*self.traces.keys, self.traces.time, self.traces.states}, [self.root]
        while todo:
            f = todo.pop()
            if isinstance(f, (CustomExpression, CustomOperator)) or self.kept is None:
                return self.traces.df
            if isinstance(f, HybridPredicate):
                wanted.add(self.traces.label)
            todo += f.children()
        return self.traces.df.select(*(f"`{c}`" for c in self.traces.df.columns if c in wanted or c in self.kept or c in variables_of(self.root)))

    # Names and windows

    def fresh(self) -> str:
        self.count += 1
        return f"_m{self.count}"

    def named(self, value: Column) -> str:
        name = self.fresh()
        self.df = self.df.withColumn(name, value)
        return name

    def over(self, expression: str, descending: bool = False, frame: str = "") -> Column:
        keys = ", ".join(f"`{k}`" for k in self.traces.keys)
        return F.expr(f"{expression} OVER (PARTITION BY {keys} ORDER BY `{self.traces.time}` {'DESC' if descending else 'ASC'} {frame})")

    # Leaves

    def where(self) -> Column:
        parts = [F.lit(" in trace ")]
        for k in self.traces.keys:
            parts += [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("NULL")), F.lit(" ")]
        return F.concat(*parts, F.lit("at time "), F.coalesce(F.col(f"`{self.traces.time}`").cast("string"), F.lit("NULL")))

    def robustness(self, p: Predicate) -> Column:
        """constant - sum, in the order of names; rows without a proper value raise."""
        for name, coefficient in p.coefficients:
            if math.isnan(coefficient):
                raise NanCoefficient(name)
        if not p.coefficients:
            return F.lit(float(p.constant))
        values = {n: self.traces.value(n) for n, _ in p.coefficients}
        total = None
        for name, coefficient in p.coefficients:
            part = F.lit(float(coefficient)) * values[name]
            total = part if total is None else total + part
        out = F.lit(float(p.constant)) - total
        for name in reversed(values):  # the first name's problem is told first
            v = values[name]
            out = F.when(v.isNull(), F.raise_error(F.concat(F.lit(f"variable {name!r} is missing"), self.where())).cast("double")).when(F.isnan(v), F.raise_error(F.concat(F.lit(f"variable {name!r} is NaN"), self.where())).cast("double")).otherwise(out)
        return out

    def hybrid(self, f: HybridPredicate) -> Column:
        """By mode: robustness where the predicate counts, else the best way to a mode where it does."""
        rho = HYBRID.robustness(self.robustness(f.predicate) if f.predicate else math.inf)
        if not f.labels:
            return rho
        if not self.traces.label:
            raise ValueError("a hybrid predicate needs traces with a label column")
        label = F.col(f"`{self.traces.label}`")
        out = F.when(label.isin(*sorted(f.labels, key=str)), rho)
        for mode in f.system.labels:
            if mode in f.labels:
                continue
            paths = f.system.paths_from(mode)
            ways = []
            for target in sorted(f.labels, key=str):
                if target not in paths:
                    continue
                distances = paths[target].next_guard.distances(lambda c: F.least(self.robustness(c), F.lit(0.0)))
                if not distances:
                    raise EmptyConstraints(f"the first guard from {mode!r} to {target!r} has no constraint")
                ways.append(HYBRID.state_distance(paths[target].hops, F.greatest(*distances) if len(distances) > 1 else distances[0]))
            if ways:
                out = out.when(label == F.lit(mode), F.greatest(*ways) if len(ways) > 1 else ways[0])
        return out.otherwise(HYBRID.unreachable())

    # Rounds

    def windowed(self, f: Formula) -> bool:
        return isinstance(f, (Fold, Next, TraceFunction, CustomOperator)) or isinstance(f, Until)

    def round_of(self, f: Formula) -> int:
        if f not in self.rounds:
            below = max((self.round_of(c) for c in f.children()), default=0)
            self.rounds[f] = below + self.windowed(f)
        return self.rounds[f]

    def expression(self, f: Formula) -> Column:
        if f not in self.known:
            self.known[f] = self.pointwise(f)
        return self.known[f]

    def pointwise(self, f: Formula) -> Column:
        if isinstance(f, Predicate):
            return self.robustness(f)
        if isinstance(f, HybridPredicate):
            return self.hybrid(f)
        if isinstance(f, CustomExpression):
            return f.build(self.traces.value)
        parts = [self.expression(c) for c in f.children()]
        if isinstance(f, Not):
            return self.metric.neg(parts[0])
        if isinstance(f, And):
            return self.metric.meet(*parts)
        if isinstance(f, Or):
            return self.metric.join(*parts)
        if isinstance(f, Implies):
            return self.metric.join(self.metric.neg(parts[0]), parts[1])
        raise TypeError(f"{type(f).__name__} can't be lowered")

    def operand(self, f: Formula) -> str:
        """Name of a column that holds a formula."""
        return self.operands[f]

    def run(self) -> DataFrame:
        """Place all rounds; the metric is then ``expression(root)`` over ``df``."""
        depth = self.round_of(self.root)
        nodes = [f for f in self.rounds if self.windowed(f)]
        self.operands: dict[Formula, str] = {}
        for r in range(1, depth + 1):
            now = [f for f in nodes if self.rounds[f] == r]
            wanted = [c for c in dict.fromkeys(c for f in now for c in f.children()) if c not in self.operands]
            fresh = {c: self.fresh() for c in wanted}
            if fresh:
                self.df = self.df.withColumns({n: self.expression(c) for c, n in fresh.items()})
                self.operands |= fresh
                self.known |= {c: F.col(n) for c, n in fresh.items()}
            columns: dict[str, Column] = {}
            steps: list[Callable[[], None]] = []
            # Windows over ascending time first, then those over descending time.
            for f in sorted(now, key=lambda f: isinstance(f, Fold) and f.reach == "future"):
                name = self.fresh()
                plain = self.window(f)
                if plain is not None:
                    columns[name] = plain
                else:
                    steps.append(lambda f=f, name=name: self.step(f, name))
                self.known[f] = F.col(name)
            if columns:
                self.df = self.df.withColumns(columns)
            for step in steps:
                step()
        return self.df

    def interval(self, interval: Interval) -> Interval:
        """For integer times, the closed interval of the same integers (empty ones stay as they are)."""
        if not self.whole:
            return interval
        low = interval.low if math.isinf(interval.low) else math.ceil(interval.low)
        high = interval.high if math.isinf(interval.high) else math.floor(interval.high) if interval.closed else math.ceil(interval.high) - 1
        return Interval(low, max(low, high)) if low <= high else Interval(low, low, closed=False)

    def window(self, f: Formula) -> Column | None:
        """A window expression, where one serves."""
        if isinstance(f, CustomOperator):
            return f.lower(Context(self), *(F.col(self.operand(c)) for c in f.children()))
        if self.block_width or isinstance(f, (TraceFunction, Until)):
            return None
        name = self.operand(f.operand)
        if isinstance(f, Next):
            # lead and lag fill with their default only where there is no sample.
            return self.shifted(f, name)
        if f.reach in ("past", "future"):
            return self.over(self.metric.fold_sql(f.kind, name), f.reach == "future", "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
        bounds = self.interval(f.reach)
        if bounds.low == bounds.high and not bounds.closed:
            return self.metric.empty(f.kind)
        if (not bounds.closed and self.half_open == "kernel") or self.wide == "kernel":
            return None
        if not bounds.closed:
            return self.listed(f, name, bounds)
        return F.coalesce(self.framed(self.metric.fold_sql(f.kind, name), bounds), self.metric.empty(f.kind))

    def framed(self, expression: str, bounds: Interval) -> Column:
        if math.isinf(bounds.high) and bounds.high > 0 and not (math.isinf(bounds.low)):
            # Over descending time the frame only grows.
            return self.over(expression, True, f"RANGE BETWEEN UNBOUNDED PRECEDING AND {offset(-bounds.low, self.whole)}")
        return self.over(expression, False, f"RANGE BETWEEN {offset(bounds.low, self.whole)} AND {offset(bounds.high, self.whole)}")

    def listed(self, f: Fold, name: str, bounds: Interval) -> Column:
        """A half-open window of DOUBLE times: the closed one's list, without its upper end."""
        time = f"`{self.traces.time}`"
        held = self.framed(f"collect_list(struct({time} AS t, `{name}` AS m))", bounds)
        inside = F.filter(held, lambda z: z["t"] < F.col(time) + F.lit(bounds.high))
        values = F.transform(inside, lambda z: z["m"])
        if self.metric.name == "scalar":
            values = F.transform(values, lambda m: F.nanvl(m, self.metric.empty(f.kind)))
        return F.coalesce((F.array_min if f.kind == "meet" else F.array_max)(values), self.metric.empty(f.kind))

    def shifted(self, f: Next, name: str) -> Column:
        function = "lag" if isinstance(f, Prev) else "lead"
        there = self.over(f"{function}(1, {f.k})")
        return F.when(there.isNull(), self.metric.bottom()).otherwise(self.over(f"{function}(`{name}`, {f.k})"))

    def step(self, f: Formula, name: str) -> None:
        """What needs more than a window expression."""
        keys, time = self.traces.keys, self.traces.time
        if isinstance(f, TraceFunction):
            self.df = kernels.per_trace(self.df, keys, time, [self.operand(f.operand)], name, kernels.one_by_one(f.function), self.metric)
        elif isinstance(f, Until):
            if self.metric is HYBRID:
                raise TypeError("strict until is for the scalar metric")
            if self.block_width:
                self.df = blocked.strict_until(self.df, keys, time, self.operand(f.left), self.operand(f.right), name)
            else:
                self.df = kernels.per_trace(self.df, keys, time, [self.operand(f.left), self.operand(f.right)], name, lambda runs, t, a, b: kernels.strict_until(runs, a, b)[0], self.metric)
        elif not self.block_width:
            self.df = kernels.fold_kernel(self.df, keys, time, self.operand(f.operand), name, f.kind, self.interval(f.reach), self.metric)
        elif isinstance(f, Next):
            at = self.operand(f.operand)
            for _ in range(f.k):
                to = self.fresh()
                self.df = blocked.shift(self.df, keys, time, at, to, -1 if isinstance(f, Prev) else 1, self.metric)
                at = to
            self.df = self.df.withColumn(name, F.col(at))
        elif f.reach in ("past", "future"):
            self.df = blocked.fold_all(self.df, keys, time, self.operand(f.operand), name, f.kind, f.reach == "past", self.metric)
        else:
            bounds = self.interval(f.reach)
            if not bounds.closed or self.wide == "kernel":
                self.df = blocked.fold_kernel(self.df, keys, time, self.operand(f.operand), name, f.kind, bounds, self.block_width, self.metric)
                return
            frame = f"{offset(bounds.low, self.whole)} AND {offset(bounds.high, self.whole)}"
            self.df = blocked.fold_window(self.df, keys, time, self.operand(f.operand), name, f.kind, frame, bounds, self.block_width, self.metric)
            self.df = self.df.withColumn(name, F.coalesce(name, self.metric.empty(f.kind)))



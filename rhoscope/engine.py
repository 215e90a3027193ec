"""Entry points: a metric for every sample, or for the first sample of every trace."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rhoscope.errors import EmptyTrace
from rhoscope.functions.metrics import HYBRID, SCALAR, HybridDistance, Metric
from rhoscope.plans.formula import And, Fold, Formula, HybridPredicate, Implies, Not, Or, Predicate
from rhoscope.plans.interpret import interpret
from rhoscope.plans.lower import Lowering
from rhoscope.plans.rewrite import metric_of
from rhoscope.sources.traces import TraceSet


def _value(metric: Metric, v) -> Column:
    if metric is SCALAR:
        return F.lit(float(v))
    return HYBRID.value(v.rank, v.neg_hops, v.dist)


def _of_empty(traces: TraceSet, formula: Formula, metric: Metric, all_traces: DataFrame, name: str) -> DataFrame:
    """(keys, time, metric) of the traces in ``all_traces`` that have no sample."""
    samples = interpret(formula, [], traces.label)
    absent = all_traces.select(*traces.keys).distinct().join(traces.df.select(*traces.keys).distinct(), list(traces.keys), "left_anti")
    if not samples:
        return absent.limit(0).select(*traces.keys, F.lit(0.0).alias(traces.time), _value(metric, 0.0 if metric is SCALAR else HybridDistance(0)).alias(name))
    (time, value), = samples
    return absent.select(*traces.keys, F.lit(time).alias(traces.time), _value(metric, value).alias(name))


def monitor(traces: TraceSet, formula: Formula, all_traces: DataFrame | None = None, **options) -> DataFrame:
    """(keys, time, robustness), or (keys, time, kind, hops, dist) for hybrid formulas, for every sample.

    ``all_traces`` names traces that may be empty; Always and Eventually have a sample at time 0 for those.
    Options: ``block_width`` cuts traces that are too long for a task into blocks of so much time;
    ``half_open`` is "kernel" or "list", ``wide`` "native" or "kernel" (better from about 1000 samples a window).
    """
    lowering = Lowering(traces, formula, **options)
    df = lowering.run()
    metric = lowering.metric
    out = df.select(*traces.keys, traces.time, lowering.expression(lowering.root).alias("_metric"))
    if all_traces is not None:
        out = out.unionByName(_of_empty(traces, formula, metric, all_traces, "_metric").withColumn(traces.time, F.col(traces.time).cast(out.schema[traces.time].dataType)))
    return out.select(*traces.keys, traces.time, *metric.flatten(F.col("_metric")))


def _summary(lowering: Lowering, f: Formula, parts: dict[str, Column]) -> Column:
    """An aggregate over a trace that gives a formula at its first sample.

    A fold over the whole future, seen from the first sample, is a plain minimum or maximum: no window, and
    partial sums before the shuffle.
    """
    metric = lowering.metric
    if isinstance(f, Fold) and f.reach == "future":
        name = f"_a{len(parts)}"
        parts[name] = lowering.expression(f.operand)
        return metric.fold(f.kind, name)
    if isinstance(f, Not):
        return metric.neg(_summary(lowering, f.operand, parts))
    if isinstance(f, And):
        return metric.meet(_summary(lowering, f.left, parts), _summary(lowering, f.right, parts))
    if isinstance(f, Or):
        return metric.join(_summary(lowering, f.left, parts), _summary(lowering, f.right, parts))
    if isinstance(f, Implies):
        return metric.join(metric.neg(_summary(lowering, f.left, parts)), _summary(lowering, f.right, parts))
    name = f"_a{len(parts)}"
    parts[name] = lowering.expression(f)
    return F.min_by(name, lowering.traces.time)


def _inner(f: Formula) -> list[Formula]:
    """What must be placed before the summary: the operands of outer folds, and everything else as it is."""
    if isinstance(f, Fold) and f.reach == "future":
        return [f.operand]
    if isinstance(f, (Not, And, Or, Implies)):
        return [x for c in f.children() for x in _inner(c)]
    return [f]


def evaluate(traces: TraceSet, formula: Formula, all_traces: DataFrame | None = None, **options) -> DataFrame:
    """(keys, time, metric): every trace's metric at its earliest time, without windows for outermost operators.

    A trace of ``all_traces`` without samples raises, unless the formula has a value there.
    """
    lowering = Lowering(traces, formula, **options)
    root = lowering.root
    # One run places the windows of all inner formulas, as the operands of a tree that is never evaluated.
    inner = _inner(root)
    tree = inner[0]
    for x in inner[1:]:
        tree = And(tree, x)
    lowering.root = tree
    df = lowering.run()
    parts: dict[str, Column] = {}
    summary = _summary(lowering, root, parts)
    df = df.select(*traces.keys, traces.time, *(c.alias(n) for n, c in parts.items()))
    out = df.groupBy(*traces.keys).agg(F.min(traces.time).alias(traces.time), summary.alias("_metric"))
    if all_traces is not None:
        if not interpret(formula, [], traces.label):
            absent = all_traces.select(*traces.keys).distinct().join(traces.df.select(*traces.keys).distinct(), list(traces.keys), "left_anti")
            if row := absent.head():
                raise EmptyTrace(f"trace {row.asDict()} has no sample")
        else:
            out = out.unionByName(_of_empty(traces, formula, lowering.metric, all_traces, "_metric").withColumn(traces.time, F.col(traces.time).cast(out.schema[traces.time].dataType)))
    return out.select(*traces.keys, traces.time, *lowering.metric.flatten(F.col("_metric")))


def evaluate_one(traces: TraceSet, formula: Formula, **options) -> float | HybridDistance:
    """The metric of the only trace at its earliest time, as a Python value."""
    rows = evaluate(traces, formula, **options).take(2)
    if not rows:
        samples = interpret(formula, [], traces.label)
        if not samples:
            raise EmptyTrace("the trace has no sample")
        return samples[0][1]
    if len(rows) > 1:
        raise ValueError("there is more than one trace")
    row = rows[0]
    if metric_of(formula) == "scalar":
        return row["robustness"]
    if row["kind"] == "unreachable":
        return HybridDistance(0)
    return HybridDistance.robustness(row["dist"]) if row["kind"] == "robustness" else HybridDistance.state_distance(row["hops"], row["dist"])


def _problems(traces: TraceSet, p: Predicate) -> list[tuple[Column, str, str]]:
    out = []
    for name, _ in p.coefficients:
        v = traces.value(name)
        out += [(v.isNull(), "missing", name), (F.isnan(v), "nan", name)]
    return out


def validate(traces: TraceSet, formula: Formula) -> DataFrame:
    """(keys, time, problem, variable): the first problem that each trace's values pose, traces without one left out.

    A hybrid predicate's guards count only in the modes that use them.
    """
    checks: list[tuple[Column, str, str]] = []

    def walk(f: Formula) -> None:
        if isinstance(f, Predicate):
            checks.extend(_problems(traces, f))
        elif isinstance(f, HybridPredicate):
            label = F.col(f"`{traces.label}`") if traces.label else F.lit(None)
            if f.predicate:
                counts = F.lit(True) if not f.labels else label.isin(*sorted(f.labels, key=str))
                checks.extend((counts & c, k, n) for c, k, n in _problems(traces, f.predicate))
            for mode in f.system.labels:
                if f.labels and mode not in f.labels:
                    guards = [p.next_guard for t, p in f.system.paths_from(mode).items() if t in f.labels]
                    checks.extend(((label == F.lit(mode)) & c, k, n) for g in guards for p in g for c, k, n in _problems(traces, p))
        for c in f.children():
            walk(c)

    walk(formula)
    first = F.lit(None).cast("struct<problem:string,variable:string>")
    for condition, kind, name in reversed(checks):
        first = F.when(condition, F.struct(F.lit(kind).alias("problem"), F.lit(name).alias("variable"))).otherwise(first)
    found = traces.df.withColumn("_problem", first).filter(F.col("_problem").isNotNull())
    return found.groupBy(*traces.keys).agg(F.min(traces.time).alias(traces.time), F.min_by("_problem", traces.time).alias("_p")).select(*traces.keys, traces.time, "_p.problem", "_p.variable")


def violations(traces: TraceSet, formula: Formula, by: Column | str, **options) -> DataFrame:
    """(by, samples, violations, worst): how often a scalar formula is violated, and how badly, per group of rows."""
    lowering = Lowering(traces, formula, kept=None, **options)
    df = lowering.run().select(by if isinstance(by, Column) else F.col(by), lowering.expression(lowering.root).alias("_metric"))
    group = df.columns[0]
    return df.groupBy(group).agg(F.count("*").alias("samples"), F.sum((F.col("_metric") < 0).cast("long")).alias("violations"), (F.min(F.nanvl("_metric", F.lit(math.inf))) + F.lit(0.0)).alias("worst"))

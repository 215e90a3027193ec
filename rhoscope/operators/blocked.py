"""Folds for traces too long for one task: traces are cut into blocks of time.

A sample's fold over all later samples is the fold within its block, met with that of all later blocks; there
are few blocks per trace, so the second part is a small window over one row per block. For a bounded window a
block gets copies of the samples around it that its windows reach. What a strict until makes of a block is a
function of what follows the block, max(lo, min(hi, x)), and few such functions are left to be applied per trace. No
task holds more than a block and its surroundings, whatever the length of the trace.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhoscope.functions.metrics import SCALAR, Metric
from rhoscope.operators import kernels
from rhoscope.plans.formula import Interval

BLOCK = "_block"


def with_blocks(df: DataFrame, time: str, width: float) -> DataFrame:
    return df.withColumn(BLOCK, F.floor(F.col(time) / F.lit(float(width))).cast("long"))


def _quoted(names) -> str:
    return ", ".join(f"`{n}`" for n in names)


def fold_all(df: DataFrame, keys: tuple[str, ...], time: str, column: str, out: str, kind: str, past: bool, metric: Metric) -> DataFrame:
    """Fold over all samples up to (``past``) or from each sample on."""
    order = "ASC" if past else "DESC"
    running = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    own = F.expr(f"{metric.fold_sql(kind, column)} OVER (PARTITION BY {_quoted((*keys, BLOCK))} ORDER BY `{time}` {order} {running})")
    totals = df.groupBy(*keys, BLOCK).agg(metric.fold(kind, column).alias("_total"))
    beyond = totals.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col(BLOCK).alias("_k_block"), F.expr(f"{metric.fold_sql(kind, '_total')} OVER (PARTITION BY {_quoted(keys)} ORDER BY `{BLOCK}` {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)").alias("_beyond"))
    on = F.col(BLOCK) == F.col("_k_block")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    both = metric.meet if kind == "meet" else metric.join
    joined = df.withColumn(out, own).join(beyond, on)
    return joined.withColumn(out, F.when(F.col("_beyond").isNull(), F.col(out)).otherwise(both(F.col(out), F.col("_beyond")))).drop("_beyond", "_k_block", *(f"_k_{k}" for k in keys))


def _visits(df: DataFrame, time: str, interval: Interval, width: float) -> DataFrame:
    """Every sample in its own block and in those whose windows reach it; ``_home`` is its own."""
    if math.isinf(interval.low) or math.isinf(interval.high):
        raise ValueError("a blocked window needs two finite bounds")
    # Sums of times and offsets are rounded, so some bits more count as within reach; a block more would cost a copy.
    slack = (F.abs(F.col(time)) + F.lit(max(abs(interval.low), abs(interval.high)))) * F.lit(2.0**-49)
    first = F.floor((F.col(time) - F.lit(interval.high) - slack) / F.lit(float(width))).cast("long")
    last = F.floor((F.col(time) - F.lit(interval.low) + slack) / F.lit(float(width))).cast("long")
    return df.withColumn("_home", F.col(BLOCK)).withColumn(BLOCK, F.explode(F.array_union(F.sequence(first, last), F.array(F.col(BLOCK)))))


def fold_kernel(df: DataFrame, keys: tuple[str, ...], time: str, column: str, out: str, kind: str, interval: Interval, width: float, metric: Metric) -> DataFrame:
    """Fold over windows of any kind, half-open ones of DOUBLE times too, block by block in numpy."""
    folded = kernels.fold_kernel(_visits(df, time, interval, width), (*keys, BLOCK), time, column, out, kind, interval, metric, F.col(BLOCK) == F.col("_home"))
    return folded.drop("_home")


def strict_until(df: DataFrame, keys: tuple[str, ...], time: str, left: str, right: str, out: str) -> DataFrame:
    """Textbook until of scalar columns."""
    ends = (f"{out}_lo", f"{out}_hi")
    whole = (*keys, BLOCK)
    near = kernels.per_trace(df, whole, time, [left, right], list(ends), lambda runs, t, a, b: kernels.strict_until(runs, a, b), SCALAR)
    # A block's function is that of its first sample, from which on it is a plain until: no second run in Python.
    proper = lambda c, empty: F.coalesce(F.nanvl(F.col(c), F.lit(empty)), F.lit(empty))
    firsts = df.select(*whole, time, proper(left, math.inf).alias("_l"), proper(right, -math.inf).alias("_r"))
    firsts = firsts.withColumn("_m", F.expr(f"least(_r, min(_l) OVER (PARTITION BY {_quoted(whole)} ORDER BY `{time}` ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"))
    heads = firsts.groupBy(*whole).agg(F.max("_m").alias(ends[0]), F.greatest(F.max("_m"), F.min("_l")).alias(ends[1]))

    def after(runs, blocks, lo, hi):
        held = np.append(kernels.suffixes(runs, lo, hi)[0][1:], -math.inf)
        held[runs[1:] - 1] = -math.inf
        return held

    beyond = kernels.per_trace(heads, keys, BLOCK, list(ends), "_beyond", after, SCALAR).select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col(BLOCK).alias("_k_block"), "_beyond")
    on = F.col(BLOCK) == F.col("_k_block")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return near.join(beyond, on).withColumn(out, F.greatest(F.col(ends[0]), F.least(F.col(ends[1]), F.col("_beyond")))).drop("_beyond", "_k_block", *ends, *(f"_k_{k}" for k in keys))


def fold_window(df: DataFrame, keys: tuple[str, ...], time: str, column: str, out: str, kind: str, frame: str, interval: Interval, width: float, metric: Metric) -> DataFrame:
    """Fold over a RANGE frame; samples visit every block whose windows reach them."""
    visits = _visits(df, time, interval, width)
    folded = visits.withColumn(out, F.expr(f"{metric.fold_sql(kind, column)} OVER (PARTITION BY {_quoted((*keys, BLOCK))} ORDER BY `{time}` RANGE BETWEEN {frame})"))
    return folded.filter(F.col(BLOCK) == F.col("_home")).drop("_home")


def shift(df: DataFrame, keys: tuple[str, ...], time: str, column: str, out: str, k: int, metric: Metric) -> DataFrame:
    """The value of the next (k = 1) or previous (k = -1) sample, bottom where there is none."""
    step = "lead" if k > 0 else "lag"
    edge = "min_by" if k > 0 else "max_by"
    # A row tells "no neighbour in the block" from a neighbour by the neighbour's time.
    window = f"OVER (PARTITION BY {_quoted((*keys, BLOCK))} ORDER BY `{time}`)"
    near = df.withColumn(out, F.expr(f"{step}(`{column}`) {window}")).withColumn("_near", F.expr(f"{step}(`{time}`) {window}"))
    edges = df.groupBy(*keys, BLOCK).agg(F.expr(f"{edge}(`{column}`, `{time}`)").alias("_edge"))
    beyond = edges.select(*(F.col(c).alias(f"_k_{c}") for c in keys), F.col(BLOCK).alias("_k_block"), F.expr(f"{step}(`_edge`) OVER (PARTITION BY {_quoted(keys)} ORDER BY `{BLOCK}`)").alias("_beyond"))
    on = F.col(BLOCK) == F.col("_k_block")
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    joined = near.join(beyond, on)
    return joined.withColumn(out, F.when(F.col("_near").isNotNull(), F.col(out)).otherwise(F.coalesce(F.col("_beyond"), metric.bottom()))).drop("_near", "_beyond", "_k_block", *(f"_k_{c}" for c in keys))

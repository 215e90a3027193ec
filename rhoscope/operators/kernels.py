"""Window folds over traces in numpy: O(n log n) for any width, exact for half-open ends.

Many traces are worked on at once, as a call per trace costs more than a short trace's fold. ``runs`` holds the first
sample of each trace, and the number of samples at its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rhoscope.functions.metrics import HYBRID, Metric
from rhoscope.plans.formula import Interval

ROW, OWN, BATCH = "_row", "_own", 10_000


def bisect(times: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray, side: str) -> np.ndarray:
    """np.searchsorted of each wanted time within times[low:high] of its own."""
    low, high = low.copy(), high.copy()
    before = np.less if side == "left" else np.less_equal
    at = np.flatnonzero(low < high)
    while at.size:
        a, b = low[at], high[at]
        middle = (a + b) >> 1
        later = before(times[middle], wanted[at])
        a, b = np.where(later, middle + 1, a), np.where(later, b, middle)
        low[at], high[at] = a, b
        at = at[a < b]
    return low


def window_edges(runs: np.ndarray, times: np.ndarray, interval: Interval) -> tuple[np.ndarray, np.ndarray]:
    """First sample within each sample's window, and the first beyond it."""
    low, high, side = times + interval.low, times + interval.high, "right" if interval.closed else "left"
    if runs.size == 2:
        return np.searchsorted(times, low, "left"), np.searchsorted(times, high, side)
    first, end = np.repeat(runs[:-1], np.diff(runs)), np.repeat(runs[1:], np.diff(runs))
    return bisect(times, low, first, end, "left"), bisect(times, high, first, end, side)


def range_fold(values: np.ndarray, start: np.ndarray, end: np.ndarray, kind: str, empty) -> np.ndarray:
    """Lowest or highest of values[start:end] for every pair; ``empty`` where there is nothing.

    Windows of 2**k to 2**(k + 1) values are two overlapping stretches of 2**k; stretches double in place.
    """
    pick = np.minimum if kind == "meet" else np.maximum
    out = np.full(start.size, empty, values.dtype)
    size = end - start
    level = np.where(size > 0, np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1, -1)
    stretch = values
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = pick(stretch[start[at]], stretch[end[at] - (1 << k)])
        stretch = pick(stretch[: -(1 << k)], stretch[1 << k :]) if stretch.size > 1 << k else stretch
    return out


def suffixes(runs: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of functions max(low, min(high, x)), each after all later ones of its trace; these have the same form.

    Stretches of functions double in length.
    """
    low, high, reach = low.copy(), high.copy(), 1
    left = np.repeat(runs[1:], np.diff(runs)) - np.arange(low.size)
    at = np.flatnonzero(left > reach)
    while at.size:
        a, b = low[at], high[at]
        low[at], high[at] = np.maximum(a, np.minimum(b, low[at + reach])), np.maximum(a, np.minimum(b, high[at + reach]))
        reach *= 2
        at = at[left[at] > reach]
    return low, high


def strict_until(runs: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Textbook until, left meet (right join what follows): its value where -infinity follows the trace, and where infinity does."""
    left, right = np.where(np.isnan(left), np.inf, left), np.where(np.isnan(right), -np.inf, right)
    return suffixes(runs, np.minimum(left, right), left)


def ranks(table: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows as integers in their order, and one row for each integer."""
    order = np.lexsort([table[c].to_numpy() for c in reversed(table.columns)])
    rows = table.to_numpy()[order]
    new = np.r_[True, (rows[1:] != rows[:-1]).any(1)] if len(rows) else np.zeros(0, bool)
    number = np.empty(len(rows), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, rows[new]


def one_by_one(function):
    """A function of one trace's times and inputs as one of many traces."""

    def work(runs, times, *inputs):
        done = []
        for a, b in zip(runs[:-1], runs[1:], strict=True):
            values = function(times[a:b].copy(), *(v.iloc[a:b].reset_index(drop=True) if isinstance(v, pd.DataFrame) else v[a:b].copy() for v in inputs))
            done.append((values,) if isinstance(values, np.ndarray) else tuple(values))
            if any(len(v) != b - a for v in done[-1]):
                raise ValueError(f"a trace of {b - a} samples was given {[len(v) for v in done[-1]]} values")
        return [np.concatenate(part) for part in zip(*done, strict=True)]

    return work


def per_trace(df: DataFrame, keys: tuple[str, ...], time: str, inputs: list[str], out: str | list[str], function, metric: Metric, own: Column | None = None) -> DataFrame:
    """Add ``out``: function(runs, times, *inputs) of whole traces, in time order. A hybrid metric comes and goes as its parts.

    With several names in ``out`` the function gives as many scalar columns. Of the samples those stay that are ``own``.
    A window numbers each trace's samples, so Python gets traces one after the other and holds no more than a batch of
    them, or one that is longer.
    """
    hybrid = metric is HYBRID
    parts = ("rank", "neg_hops", "dist")
    flat = df
    if hybrid:
        flat = df.select("*", *(F.col(f"`{c}`.{p}").alias(f"{c}__{p}") for c in inputs for p in parts)).drop(*inputs)
    results = [f"{out}__{p}" for p in parts] if hybrid else [out] if isinstance(out, str) else out
    kinds = (T.ByteType(), T.IntegerType(), T.DoubleType()) if hybrid else (T.DoubleType(),) * len(results)
    arrow = (pa.int8(), pa.int32(), pa.float64()) if hybrid else (pa.float64(),) * len(results)
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in flat.schema.fields), *(T.StructField(r, k) for r, k in zip(results, kinds, strict=True))])
    names = ", ".join(f"`{k}`" for k in keys)
    flat = flat.withColumn(ROW, F.expr(f"row_number() OVER (PARTITION BY {names} ORDER BY `{time}`)"))
    select = own is not None
    if select:
        flat = flat.withColumn(OWN, own)

    def folded(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        if not table.num_rows:
            return
        runs = np.append(np.flatnonzero(table[ROW].to_numpy() == 1), table.num_rows)
        given = [table.select([f"{c}__{p}" for p in parts]).to_pandas() if hybrid else table[c].to_numpy() for c in inputs]
        values = function(runs, table[time].to_numpy(), *given)
        for r, v, k in zip(results, (values,) if isinstance(values, np.ndarray) else values, arrow, strict=True):
            table = table.append_column(r, pa.array(np.asarray(v).astype(k.to_pandas_dtype()), k))
        if select:
            table = table.filter(table[OWN]).drop_columns([OWN])
        yield from table.drop_columns([ROW]).to_batches(max_chunksize=BATCH)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column(ROW).to_numpy() == 1)
            if starts.size:
                whole = [*held, batch.slice(0, int(starts[-1]))]
                held = [batch.slice(int(starts[-1]))]
                yield from folded(whole)
            else:
                held.append(batch)
        if held:
            yield from folded(held)

    done = flat.mapInArrow(work, schema)
    if not hybrid:
        return done
    struct = lambda c: F.struct(*(F.col(f"`{c}__{p}`").alias(p) for p in parts)).alias(c)
    kept = [c for c in done.columns if "__" not in c or c.rsplit("__", 1)[0] not in (*inputs, out)]
    return done.select(*(f"`{c}`" for c in kept), *(struct(c) for c in (*inputs, out)))


def fold_kernel(df: DataFrame, keys: tuple[str, ...], time: str, column: str, out: str, kind: str, interval: Interval, metric: Metric, own: Column | None = None) -> DataFrame:
    """Add the fold of ``column`` over each sample's window; of the samples those stay that are ``own``."""
    empty = np.inf if kind == "meet" else -np.inf

    def scalar(runs, times, values):
        values = np.where(np.isnan(values), empty, values.astype(np.float64))
        return range_fold(values, *window_edges(runs, times, interval), kind, empty)

    def hybrid(runs, times, table):
        number, rows = ranks(table)
        nothing = np.array([[2, 0, np.inf] if kind == "meet" else [0, 0, 0.0]])
        rows = np.concatenate([rows, nothing])
        # The empty window's number only has to be told apart.
        best = range_fold(number, *window_edges(runs, times, interval), kind, np.iinfo(np.int64).max if kind == "meet" else -1)
        best = np.where((best < 0) | (best >= len(rows) - 1), len(rows) - 1, best)
        return [rows[best, 0].astype(np.int8), rows[best, 1].astype(np.int32), rows[best, 2].astype(np.float64)]

    return per_trace(df, keys, time, [column], out, hybrid if metric is HYBRID else scalar, metric, own)

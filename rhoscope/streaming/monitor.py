"""Online monitoring: a metric leaves as soon as no later sample can change it.

State is kept per trace: the samples that a pending or future result may need. A result at t is settled when
every operator on its way is: bounded operators once a sample beyond the window has come, Next once its sample
has. Unbounded operators settle only when the trace ends, that is, when no sample came for ``timeout_ms``;
then all that is left goes out. A sample may come late: results are held back until the trace's clock, its latest
time, is ``lateness`` beyond what they depend on, so whatever is no later than that has the place it would have had in
time. Samples that come later still, at or before a time whose result has gone out, are dropped. State is bounded
by the operators' windows and ``lateness``, but for unbounded operators, which need the whole trace.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rhoscope.functions.metrics import HybridDistance
from rhoscope.plans.formula import Always, And, Eventually, Formula, Implies, Next, Not, Or, Prev, Until
from rhoscope.plans.interpret import interpret
from rhoscope.plans.rewrite import metric_of, variables_of


def settled_count(f: Formula, times: list[float]) -> int:
    """How many of the first samples have results that later samples can't change."""
    if isinstance(f, (Always, Eventually)):
        inner = settled_count(f.operand, times)
        if f.bounds is None or math.isinf(f.bounds.high):
            return 0
        n = 0
        for t in times:
            last = f.bounds.shift(t)
            # Some sample lies beyond the window, and all samples within it are settled.
            inside = (bisect_right if last.closed else bisect_left)(times, last.high)
            if inside >= len(times) or inside > inner:
                break
            n += 1
        return n
    if isinstance(f, Prev):
        return settled_count(f.operand, times)
    if isinstance(f, Next):
        return max(0, settled_count(f.operand, times) - f.k)
    if isinstance(f, Until):
        return 0
    if isinstance(f, (Not, And, Or, Implies)):
        return min(settled_count(c, times) for c in f.children())
    return len(times)


def lookback(f: Formula) -> tuple[float, int]:
    """How much earlier time, and how many earlier samples, a result may need."""
    time, count = (0.0, 0)
    for c in f.children():
        t, k = lookback(c)
        time, count = max(time, t), max(count, k)
    if isinstance(f, (Always, Eventually)) and f.bounds is not None:
        time += max(0.0, -f.bounds.low)
    if isinstance(f, Prev):
        count += f.k
    if isinstance(f, Until):
        time = math.inf
    return time, count


def stream_monitor(df: DataFrame, formula: Formula, keys: tuple[str, ...] = ("trace_id",), time: str = "time", label: str | None = None, timeout_ms: int = 60_000, lateness: float = 0.0) -> DataFrame:
    """(keys, time, robustness), or with kind, hops, dist, for a streaming DataFrame of samples."""
    hybrid = metric_of(formula) == "hybrid"
    names = sorted(variables_of(formula)) + ([label] if label else [])
    back_time, back_count = lookback(formula)
    results = ["kind", "hops", "dist"] if hybrid else ["robustness"]
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), f"`{time}` double", "kind string, hops int, dist double" if hybrid else "robustness double"])

    def rows(key, samples) -> pd.DataFrame:
        out = []
        for t, v in samples:
            value = (v,) if not hybrid else (("unreachable", None, None) if v.rank == 0 else ("robustness", None, v.dist) if v.rank == 2 else ("state_distance", v.hops, v.dist)) if isinstance(v, HybridDistance) else (v,)
            out.append((*key, t, *value))
        return pd.DataFrame(out, columns=[*keys, time, *results])

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, done = (json.loads(state.get[0]), state.get[1]) if state.exists else ([], -math.inf)
        if state.hasTimedOut:
            state.remove()
            trace = [(t, s) for t, s in held]
            left = [x for x in interpret(formula, trace, label) if x[0] > done]
            if left:
                yield rows(key, left)
            return
        known = {t: s for t, s in held}
        for pdf in batches:
            for record in pdf[[time, *names]].to_dict("records"):
                t = float(record.pop(time)) + 0.0
                if t > done:
                    known[t] = record
        trace = sorted(known.items())
        times = [t for t, _ in trace]
        # Up to the clock less the lateness, no sample is missing.
        firm = bisect_right(times, times[-1] - lateness) if times else 0
        n = settled_count(formula, times[:firm])
        ready = [x for x in interpret(formula, trace[:firm], label)[:n] if x[0] > done] if n and times[n - 1] > done else []
        if ready:
            done = ready[-1][0]
            yield rows(key, ready)
        open_ = next((i for i, t in enumerate(times) if t > done), len(times))
        first = times[open_] if open_ < len(times) else done
        keep = max(0, open_ - back_count - 1)
        trace = [x for i, x in enumerate(trace) if i >= keep or x[0] >= first - back_time]
        state.update((json.dumps(trace), done))
        state.setTimeoutDuration(timeout_ms)

    needed = df.select(*keys, time, *names)
    return needed.groupBy(*keys).applyInPandasWithState(update, schema, "trace string, done double", "append", GroupStateTimeout.ProcessingTimeTimeout)

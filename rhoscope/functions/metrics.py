"""Metrics as columns: a lattice with top and bottom, and a negation.

``encode``/``flatten`` go from and to what users see. A caller's metric has the same members; Spark orders its
values, so min and max of the encoding must be meet and join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = math.inf


class Metric:
    """Contract of a metric; values are columns of one orderable type."""

    name = ""

    def top(self) -> Column:
        raise NotImplementedError

    def bottom(self) -> Column:
        raise NotImplementedError

    def neg(self, a: Column) -> Column:
        raise NotImplementedError

    def meet(self, a: Column, b: Column) -> Column:
        return F.least(a, b)

    def join(self, a: Column, b: Column) -> Column:
        return F.greatest(a, b)

    def fold_sql(self, kind: str, name: str) -> str:
        """SQL aggregate of a column: its meet ("meet") or join ("join")."""
        return f"{'min' if kind == 'meet' else 'max'}(`{name}`)"

    def fold(self, kind: str, name: str) -> Column:
        return F.expr(self.fold_sql(kind, name))

    def empty(self, kind: str) -> Column:
        """The fold of nothing."""
        return self.top() if kind == "meet" else self.bottom()

    def flatten(self, a: Column) -> list[Column]:
        raise NotImplementedError


class ScalarMetric(Metric):
    """Robustness as DOUBLE. NaN loses against every number in meet and join, as IEEE minNum and maxNum have it."""

    name = "scalar"

    def top(self):
        return F.lit(INF)

    def bottom(self):
        return F.lit(-INF)

    def neg(self, a):
        return -a

    def join(self, a, b):
        # NaN is Spark's largest value, so least passes over it; each side stands here once, or nested
        # formulas would grow exponentially.
        return -F.least(-a, -b)

    def fold_sql(self, kind, name):
        # NaN counts as the fold of nothing.
        function, empty = ("min", "Infinity") if kind == "meet" else ("max", "-Infinity")
        return f"{function}(nanvl(`{name}`, double('{empty}')))"

    def flatten(self, a):
        return [(a + F.lit(0.0)).alias("robustness")]


class HybridMetric(Metric):
    """Robustness in the right mode, else hops to it and distance to the next guard, else unreachable.

    Encoded as struct(rank, neg_hops, dist): unreachable (0, 0, 0), on the way (1, -hops, dist), robustness
    (2, 0, rho). Struct order is the lattice order: fewer hops are higher, then larger distances. Negation
    changes the number's sign and nothing else, so it doesn't reverse the order.
    """

    name = "hybrid"

    @staticmethod
    def value(rank: int, neg_hops: Column | int, dist: Column | float) -> Column:
        as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(F.lit(rank).cast("byte").alias("rank"), as_column(neg_hops).cast("int").alias("neg_hops"), as_column(dist).cast("double").alias("dist"))

    def robustness(self, rho: Column | float) -> Column:
        return self.value(2, 0, rho)

    def state_distance(self, hops: int, dist: Column | float) -> Column:
        return self.value(1, -hops, dist)

    def unreachable(self) -> Column:
        return self.value(0, 0, 0.0)

    def top(self):
        return self.robustness(INF)

    def bottom(self):
        return self.unreachable()

    def neg(self, a):
        flipped = lambda v: F.struct(v["rank"].alias("rank"), v["neg_hops"].alias("neg_hops"), F.when(v["rank"] == 0, v["dist"]).otherwise(-v["dist"]).alias("dist"))
        return F.transform(F.array(a), flipped)[0]

    def flatten(self, a):
        kind = F.when(a["rank"] == 2, "robustness").when(a["rank"] == 1, "state_distance").otherwise("unreachable")
        return [kind.alias("kind"), F.when(a["rank"] == 1, -a["neg_hops"]).alias("hops"), F.when(a["rank"] > 0, a["dist"] + F.lit(0.0)).alias("dist")]


@dataclass(frozen=True)
class HybridDistance:
    """A hybrid value outside Spark. Its order is the lattice's."""

    rank: int
    neg_hops: int = 0
    dist: float = 0.0

    @staticmethod
    def robustness(rho: float) -> HybridDistance:
        return HybridDistance(2, 0, float(rho))

    @staticmethod
    def state_distance(hops: int, dist: float) -> HybridDistance:
        return HybridDistance(1, -hops, float(dist))

    @staticmethod
    def of(item: float | tuple[int, float]) -> HybridDistance:
        return HybridDistance.state_distance(*item) if isinstance(item, tuple) else HybridDistance.robustness(item)

    @property
    def hops(self) -> int:
        return -self.neg_hops

    @property
    def key(self) -> tuple:
        return self.rank, self.neg_hops, self.dist

    def meet(self, other: HybridDistance) -> HybridDistance:
        return min(self, other, key=lambda v: v.key)

    def join(self, other: HybridDistance) -> HybridDistance:
        return max(self, other, key=lambda v: v.key)

    def __neg__(self) -> HybridDistance:
        return self if self.rank == 0 else HybridDistance(self.rank, self.neg_hops, -self.dist)


UNREACHABLE = HybridDistance(0)
SCALAR, HYBRID = ScalarMetric(), HybridMetric()
_METRICS: dict[str, Metric] = {"scalar": SCALAR, "hybrid": HYBRID}


def metric_named(name: str) -> Metric:
    return _METRICS[name]


def register_metric(metric: Metric) -> Metric:
    """Let custom expressions have this metric."""
    _METRICS[metric.name] = metric
    return metric

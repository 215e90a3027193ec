"""Formulas as immutable trees.

A node is hashable, so equal subformulas are found and computed once. ``~f``, ``f & g`` and ``f | g`` build
Not, And and Or; ``f.implies(g)`` and ``f.until(g)`` the others.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from rhoscope.operators.automaton import Automaton


class Formula:
    """Base of all nodes."""

    def children(self) -> tuple[Formula, ...]:
        return ()

    def with_children(self, children: tuple[Formula, ...]) -> Formula:
        return self

    def __invert__(self) -> Formula:
        return Not(self)

    def __and__(self, other: Formula) -> Formula:
        return And(self, other)

    def __or__(self, other: Formula) -> Formula:
        return Or(self, other)

    def implies(self, other: Formula) -> Formula:
        return Implies(self, other)

    def until(self, other: Formula, strict: bool = False) -> Formula:
        return Until(self, other, strict)


@dataclass(frozen=True)
class Term:
    """A constant (no name) or a variable with a coefficient."""

    name: str | None
    value: float

    @staticmethod
    def of(item: Any) -> Term:
        """From a name, a number, or a pair of both in any order; a pair's name may be None."""
        if isinstance(item, Term):
            return item
        if isinstance(item, str):
            return Term(item, 1.0)
        if isinstance(item, (int, float)) and not isinstance(item, bool):
            return Term(None, float(item))
        if isinstance(item, tuple) and len(item) == 2:
            a, b = item
            name, value = (a, b) if isinstance(a, str) or a is None else (b, a)
            if (name is None or isinstance(name, str)) and isinstance(value, (int, float)):
                return Term(name, float(value))
        raise TypeError(f"{item!r} is no term")

    def __neg__(self) -> Term:
        return Term(self.name, -self.value)


@dataclass(frozen=True)
class Predicate(Formula):
    """``sum of coefficient * variable <= constant``; its robustness is constant minus sum.

    A variable whose coefficients cancel stays and must still have a value.
    """

    coefficients: tuple[tuple[str, float], ...] = ()
    constant: float = 0.0

    @staticmethod
    def of(*terms: Any) -> Predicate:
        """Terms are added: coefficients to their variables, constants to the right-hand side."""
        out = Predicate()
        for t in terms:
            out = out + t
        return out

    def _added(self, term: Term) -> Predicate:
        if term.name is None:
            return Predicate(self.coefficients, self.constant + term.value)
        known = dict(self.coefficients)
        known[term.name] = known.get(term.name, 0.0) + term.value
        return Predicate(tuple(sorted(known.items())), self.constant)

    def __add__(self, item: Any) -> Predicate:
        return self._added(Term.of(item))

    def __sub__(self, item: Any) -> Predicate:
        return self._added(-Term.of(item))

    def __neg__(self) -> Predicate:
        return Predicate(tuple((n, -c) for n, c in self.coefficients), -self.constant)

    def get(self, name: str) -> float | None:
        return dict(self.coefficients).get(name)

    def __getitem__(self, name: str) -> float:
        return dict(self.coefficients)[name]

    @property
    def variables(self) -> tuple[str, ...]:
        return tuple(n for n, _ in self.coefficients)


@dataclass(frozen=True)
class HybridPredicate(Formula):
    """A predicate (None: always true) that counts in the modes ``labels`` (none: in every mode) of a system."""

    predicate: Predicate | None
    labels: frozenset
    system: Automaton

    def __init__(self, predicate: Predicate | None, labels: Iterable, system: Automaton):
        object.__setattr__(self, "predicate", predicate)
        object.__setattr__(self, "labels", frozenset(labels))
        object.__setattr__(self, "system", system)


@dataclass(frozen=True)
class CustomExpression(Formula):
    """A leaf that a caller's function makes: row of columns to a metric column."""

    name: str
    build: Callable[[Callable[[str], Any]], Any]
    metric: str = "scalar"
    variables: tuple[str, ...] = ()


@dataclass(frozen=True)
class _Unary(Formula):
    operand: Formula

    def children(self):
        return (self.operand,)

    def with_children(self, children):
        return type(self)(*children)


@dataclass(frozen=True)
class _Binary(Formula):
    left: Formula
    right: Formula

    def children(self):
        return (self.left, self.right)

    def with_children(self, children):
        return type(self)(*children)


class Not(_Unary):
    """Negation of the metric."""


class And(_Binary):
    """Meet."""


class Or(_Binary):
    """Join."""


class Implies(_Binary):
    """Join of the negated left and the right side."""


@dataclass(frozen=True)
class Interval:
    """Offsets from a sample's time, both numbers; the upper end may be open. Empty windows are allowed."""

    low: float
    high: float
    closed: bool = True

    def __post_init__(self):
        object.__setattr__(self, "low", float(self.low))
        object.__setattr__(self, "high", float(self.high))
        if math.isnan(self.low) or math.isnan(self.high) or self.low > self.high:
            raise ValueError(f"{self.low} to {self.high} is no interval")

    def shift(self, time: float) -> Interval:
        return Interval(self.low + time, self.high + time, self.closed)

    def contains(self, time: float) -> bool:
        return self.low <= time and (time <= self.high if self.closed else time < self.high)

    def __str__(self) -> str:
        return f"[{self.low}, {self.high}{']' if self.closed else ')'}"


@dataclass(frozen=True)
class _Temporal(Formula):
    operand: Formula
    bounds: Interval | None = None

    def children(self):
        return (self.operand,)

    def with_children(self, children):
        return type(self)(children[0], self.bounds)

    @classmethod
    def bounded(cls, low: float, high: float, operand: Formula, closed: bool = True):
        return cls(operand, Interval(low, high, closed))


class Always(_Temporal):
    """Meet over this and all later samples, or over those within the bounds."""


class Eventually(_Temporal):
    """Join over this and all later samples, or over those within the bounds."""


@dataclass(frozen=True)
class Next(Formula):
    """The operand at the k-th sample after this one; bottom where there is none."""

    operand: Formula
    k: int = 1

    def children(self):
        return (self.operand,)

    def with_children(self, children):
        return type(self)(children[0], self.k)


@dataclass(frozen=True)
class Prev(Next):
    """The operand at the k-th sample before this one; bottom where there is none."""


@dataclass(frozen=True)
class Until(Formula):
    """Join over samples t' from here on of (right at t' meet left up to t').

    The left side counts from the start of the trace; with ``strict``, from the sample at hand, as textbooks
    have it.
    """

    left: Formula
    right: Formula
    strict: bool = False

    def children(self):
        return (self.left, self.right)

    def with_children(self, children):
        return Until(*children, self.strict)


@dataclass(frozen=True)
class CustomOperator(Formula):
    """A caller's operator: ``lower(context, *operand columns)`` gives a metric column.

    The context offers the metric, the windows by time and ``column`` to name an intermediate result.
    """

    name: str
    operands: tuple[Formula, ...]
    lower: Callable[..., Any] = field(compare=True)

    def children(self):
        return self.operands

    def with_children(self, children):
        return CustomOperator(self.name, tuple(children), self.lower)


@dataclass(frozen=True)
class TraceFunction(Formula):
    """A caller's function of a whole trace: (times, values) arrays to values. One trace must fit a task."""

    name: str
    operand: Formula
    function: Callable[..., Any]

    def children(self):
        return (self.operand,)

    def with_children(self, children):
        return TraceFunction(self.name, children[0], self.function)


@dataclass(frozen=True)
class Fold(Formula):
    """What temporal operators become: the lowest ("meet") or highest ("join") metric of a stretch of samples.

    ``reach`` is "past" (all up to this one), "future" (all from this one on) or an Interval of offsets.
    """

    kind: str
    reach: str | Interval
    operand: Formula

    def children(self):
        return (self.operand,)

    def with_children(self, children):
        return Fold(self.kind, self.reach, children[0])

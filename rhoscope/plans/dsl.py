"""Writing formulas in Python: ``var("x") * 3.0 + 1.0 <= var("y")`` is a predicate."""

from __future__ import annotations

from dataclasses import dataclass

from rhoscope.plans.formula import Always, Eventually, Formula, Interval, Next, Predicate, Prev, Term, Until


@dataclass(frozen=True)
class Polynomial:
    """A sum of terms, one side of an inequality."""

    terms: tuple[Term, ...]

    @staticmethod
    def of(item) -> Polynomial:
        return item if isinstance(item, Polynomial) else Polynomial((Term.of(item),))

    def __add__(self, other) -> Polynomial:
        return Polynomial(self.terms + Polynomial.of(other).terms)

    def __radd__(self, other) -> Polynomial:
        return Polynomial.of(other) + self

    def __neg__(self) -> Polynomial:
        return Polynomial(tuple(-t for t in self.terms))

    def __sub__(self, other) -> Polynomial:
        return self + -Polynomial.of(other)

    def __rsub__(self, other) -> Polynomial:
        return Polynomial.of(other) - self

    def __mul__(self, factor: float) -> Polynomial:
        return Polynomial(tuple(Term(t.name, t.value * factor) for t in self.terms))

    __rmul__ = __mul__

    def __le__(self, other) -> Predicate:
        return inequality(self, Polynomial.of(other))

    def __ge__(self, other) -> Predicate:
        return inequality(Polynomial.of(other), self)


def inequality(left: Polynomial, right: Polynomial) -> Predicate:
    """left <= right: variables go to the left side, constants to the right."""
    out = Predicate()
    for side, sign in ((left, 1.0), (right, -1.0)):
        for t in side.terms:
            out = out + (Term(None, -sign * t.value) if t.name is None else Term(t.name, sign * t.value))
    return out


def var(name: str) -> Polynomial:
    return Polynomial((Term(name, 1.0),))


def _bounds(low: float | None, high: float | None, closed: bool) -> Interval | None:
    return None if low is None and high is None else Interval(0.0 if low is None else low, float("inf") if high is None else high, closed)


def always(operand: Formula, low: float | None = None, high: float | None = None, closed: bool = True) -> Always:
    return Always(operand, _bounds(low, high, closed))


def eventually(operand: Formula, low: float | None = None, high: float | None = None, closed: bool = True) -> Eventually:
    return Eventually(operand, _bounds(low, high, closed))


def next_(operand: Formula, k: int = 1) -> Next:
    return Next(operand, k)


def prev(operand: Formula, k: int = 1) -> Prev:
    return Prev(operand, k)


def until(left: Formula, right: Formula, strict: bool = False) -> Until:
    return Until(left, right, strict)

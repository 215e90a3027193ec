"""The grammar, from formulas that are made at random, written in one of their many spellings and read back."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rhoscope.engine import evaluate_one
from rhoscope.errors import IncompleteParse, MissingPredicate, ParseError
from rhoscope.operators.automaton import Automaton
from rhoscope.plans.dsl import always, eventually, next_, var
from rhoscope.plans.formula import Always, And, Eventually, HybridPredicate, Implies, Interval, Next, Not, Or, Predicate, Until
from rhoscope.plans.parser import parse_formula, parse_hybrid_formula, parse_predicate
from rhoscope.sources.traces import TraceSet

#: Names that could be taken for operators, or begin like one, among them.
NAMES = ["rpm", "oil_temp", "Gear", "Xylem", "nextStop", "orbit", "Uranium", "F16", "G", "X", "U"]
SPELLED = {Not: ["!", "not "], And: ["/\\", " and "], Or: ["\\/", " or "], Implies: ["->", " implies "], Until: [" U "], Always: ["always ", "[]", "G "], Eventually: ["eventually ", "<>", "F "], Next: ["next ", "()", "X "]}


class Writer:
    def __init__(self, seed: int, names: dict | None = None):
        self.rng, self.names = random.Random(seed), names
        # A name that is an operator's word reads as the predicate, so that word isn't used for the operator.
        self.spelled = SPELLED if names is None else SPELLED | {Next: ["next ", "()"]}

    def space(self) -> str:
        return self.rng.choice(["", "", " ", "  ", "\t", "\n "])

    def number(self, v: float) -> str:
        v = abs(v)
        return self.rng.choice([repr(v), *([str(int(v))] if v == int(v) else []), f"{v:.17e}".replace("e+", self.rng.choice(["e", "E+"]))])

    def signed(self, v: float) -> str:
        return ("-" if v < 0 else "") + self.number(v)

    def predicate(self, p: Predicate) -> str:
        """Every variable on the left, with its coefficient before or behind it."""
        out = ""
        for name, c in p.coefficients:
            magnitude = self.rng.choice([f"{self.number(c)}{self.space()}*{self.space()}{name}", f"{name}{self.space()}*{self.space()}{self.number(c)}"])
            if abs(c) == 1.0 and self.rng.random() < 0.5:
                magnitude = name
            if out:
                out += f"{self.space()}{'-' if c < 0 else '+'}{self.space()}{magnitude}"
            elif c < 0:
                # A first term's sign belongs to its number.
                out = f"-{self.number(c)}{self.space()}*{self.space()}{name}"
            else:
                out = magnitude
        return f"{out}{self.space()}<={self.space()}{self.signed(p.constant)}"

    def atom(self, f) -> str:
        return self.predicate(f) if self.names is None else self.names[f]

    def write(self, f) -> str:
        """With parentheses around every operand, but for some atoms."""
        if isinstance(f, (Predicate, HybridPredicate)):
            return self.atom(f)
        parts = []
        for c in f.children():
            text = self.write(c)
            bare = isinstance(c, (Predicate, HybridPredicate)) and self.rng.random() < 0.5
            parts.append(f" {text} " if bare else f"({self.space()}{text}{self.space()})")
        sign = self.rng.choice(self.spelled[type(f)])
        if self.names is None and len(parts) == 1 and len(sign) == 2 and sign[0].isalpha():
            parts = [f"({parts[0]})"]  # a letter before a minus would be a variable
        if len(parts) == 2:
            return f"{parts[0]}{sign}{parts[1]}"
        bounds = ""
        if isinstance(f, (Always, Eventually)) and f.bounds:
            bounds = f"{{{self.space()}{self.signed(f.bounds.low)}{self.space()},{self.space()}{self.signed(f.bounds.high)}{self.space()}}}"
        return f"{sign}{bounds}{parts[0]}"


numbers = st.sampled_from([0.0, 1.0, 2.0, 7.5, 0.125, 1e3, 31.4, 6e-3])
signs = st.sampled_from([1.0, -1.0])


@st.composite
def predicates(draw):
    names = draw(st.lists(st.sampled_from(NAMES), min_size=1, max_size=3, unique=True))
    pairs = [(n, draw(numbers.filter(bool)) * draw(signs)) for n in names]
    return Predicate(tuple(sorted(pairs)), draw(numbers) * draw(signs) + 0.0)


@st.composite
def bounds(draw):
    low, size = draw(numbers) * draw(signs) + 0.0, draw(numbers)
    return draw(st.sampled_from([None, Interval(low, low + size)]))


def trees(atoms):
    def grown(inner):
        two = [st.builds(k, inner, inner) for k in (And, Or, Implies, Until)]
        return st.one_of(*two, st.builds(Not, inner), st.builds(Next, inner), st.builds(Always, inner, bounds()), st.builds(Eventually, inner, bounds()))

    return st.recursive(atoms, grown, max_leaves=8)


@settings(deadline=None, max_examples=400)
@given(trees(predicates()), st.integers(0, 2**32))
def test_formulas_come_back(f, seed):
    assert parse_formula(Writer(seed).write(f)) == f


SYSTEM = Automaton([("idle", "run", var("rpm") <= 40.0)])
KNOWN = {n: HybridPredicate(var("rpm") <= float(i), {"run"}, SYSTEM) for i, n in enumerate(["hot", "cold_start", "Uphill", "X", "andes"])}


@settings(deadline=None, max_examples=200)
@given(trees(st.sampled_from(list(KNOWN.values()))), st.integers(0, 2**32))
def test_hybrid_formulas_come_back(f, seed):
    assert parse_hybrid_formula(Writer(seed, {p: n for n, p in KNOWN.items()}).write(f), KNOWN) == f


def test_what_binds_how():
    a, b, c = (var(n) <= float(i) for i, n in enumerate(["speed", "load", "heat"], 5))
    s, t, u = "speed <= 5", "load <= 6", "heat <= 7"
    assert parse_formula(f"not {s} and {t}") == And(Not(a), b)
    assert parse_formula(f"{s} or {t} and {u}") == Or(a, And(b, c))
    assert parse_formula(f"{s} and {t} or {u}") == Or(And(a, b), c)
    assert parse_formula(f"{s} or {t} -> {u}") == Implies(Or(a, b), c)
    assert parse_formula(f"{s} U {t} implies {u}") == Until(a, Implies(b, c))
    assert parse_formula(f"{s} and {t} and {u}") == And(And(a, b), c)
    # Temporal operators reach as far as they can.
    assert parse_formula(f"eventually {s} -> next {t} or {u}") == eventually(Implies(a, next_(Or(b, c))))
    assert parse_formula(f"{s} and always {t} and {u}") == And(a, always(And(b, c)))
    # Before a minus a word is an operator, a letter a variable, and between operands both are operators.
    assert parse_formula("not -1 * load <= 6") == Not(var("load") * -1.0 <= 6.0)
    assert parse_formula("X - 1 * load <= 6") == (var("X") - var("load") <= 6.0)
    assert parse_formula(f"{s} U -1 * load <= 6") == Until(a, var("load") * -1.0 <= 6.0)


def test_sides_of_an_inequality():
    got = parse_predicate("9 + 2*oil + air <= water * 0.5 - 4 + oil")
    assert dict(got.coefficients) == {"oil": 1.0, "air": 1.0, "water": -0.5} and got.constant == -13.0
    assert dict(parse_predicate("oil <= oil").coefficients) == {"oil": 0.0}
    assert parse_predicate("- 3 * oil <= 1")["oil"] == -3.0


def test_the_constant_may_be_read_the_other_way(spark):
    traces = TraceSet.from_samples(spark, [(0.0, {"oil": 4.0})])
    assert evaluate_one(traces, parse_formula("oil <= 9")) == 5.0
    assert evaluate_one(traces, parse_formula("oil <= 9", reference_constant_sign=True)) == -13.0


@pytest.mark.parametrize("text", ["", " \n", "oil", "oil <=", "<= 4", "oil <= 4 and", "and oil <= 4", "(oil <= 4", "oil <= 4)", "G{1,2 oil <= 4", "G{1} oil <= 4", "oil < 4", "oil <= 4 ?", "5 5 <= oil", "oil <= 4 oil <= 5", "2 * 3 <= oil"])
def test_what_is_no_formula_is_refused_with_its_rest(text):
    with pytest.raises(IncompleteParse) as caught:
        parse_formula(text)
    assert caught.value.rest == "" or text.rstrip().endswith(caught.value.rest.rstrip())


def test_unknown_names_and_turned_bounds_are_refused():
    with pytest.raises(MissingPredicate, match="tepid"):
        parse_hybrid_formula("eventually (hot or tepid)", KNOWN)
    with pytest.raises(ParseError):
        parse_formula("F{8,7} oil <= 1")
    with pytest.raises(IncompleteParse):
        parse_predicate("oil <= 1 or oil <= 2")


def test_long_texts_take_time_in_proportion():
    import time

    def seconds(n):
        text = " and ".join(["oil <= 1"] * n) + " " * n
        began = time.perf_counter()
        parse_formula(text)
        return time.perf_counter() - began

    seconds(200)
    assert min(seconds(8000) for _ in range(3)) < 40 * max(min(seconds(1000) for _ in range(3)), 1e-3)

import math

import pytest

from rhoscope.engine import evaluate, evaluate_one, monitor, validate
from rhoscope.errors import EmptyConstraints, EmptyTrace, InvalidTrace, MetricMismatch, MismatchedLengths, MismatchedTimes, MissingVariable, NanCoefficient
from rhoscope.functions.metrics import UNREACHABLE, HybridDistance
from rhoscope.operators.automaton import Automaton, Guard
from rhoscope.plans.dsl import always, eventually, next_, until, var
from rhoscope.plans.formula import And, CustomExpression, HybridPredicate, Interval, Next, Not, Or, Predicate, Term
from rhoscope.plans.interpret import interpret
from rhoscope.plans.rewrite import simplified
from rhoscope.sources.traces import TraceSet

x, y = var("x"), var("y")


def test_terms_from_all_forms():
    assert [Term.of(i) for i in ("x", 2, ("x", 3.0), (3.0, "x"), (None, 4.0), (4.0, None))] == [Term("x", 1.0), Term(None, 2.0), Term("x", 3.0), Term("x", 3.0), Term(None, 4.0), Term(None, 4.0)]
    assert -Term("x", 2.0) == Term("x", -2.0)
    with pytest.raises(TypeError):
        Term.of(object())


def test_inequality_moves_variables_left_and_constants_right():
    p = x * 2.5 + 6.0 <= y * 0.75 + 8.5 + var("z")
    assert p["x"] == 2.5 and p["y"] == -0.75 and p["z"] == -1.0 and p.constant == 2.5
    assert p.get("w") is None
    with pytest.raises(KeyError):
        p["w"]


def test_building_adds_to_the_constant():
    p = Predicate.of("x", ("y", 2.0), 10) - 4 + ("x", 1.5) - ("y", 2.0)
    assert dict(p.coefficients) == {"x": 2.5, "y": 0.0} and p.constant == 6.0
    assert (-p).constant == -6.0 and (-p)["x"] == -2.5


def one(spark, **state):
    return TraceSet.from_samples(spark, [(0.0, state)])


def test_robustness_and_its_errors(spark):
    p = x + y * 2.0 <= 10.0
    assert evaluate_one(one(spark, x=2.0, y=1.0), p) == 6.0
    assert evaluate_one(one(spark, x=5.0, y=5.0), p) == -5.0
    with pytest.raises(MissingVariable, match="x"):
        evaluate_one(one(spark, y=5.0), p)
    with pytest.raises(NanCoefficient, match="z"):
        evaluate_one(one(spark, x=1.0, y=1.0, z=1.0), p + ("z", math.nan))
    with pytest.raises(Exception, match="'y' is NaN in trace 0 at time 0.0"):
        evaluate_one(one(spark, x=1.0, y=math.nan), p)
    with pytest.raises(Exception, match="'x' is missing"):
        evaluate_one(one(spark, x=None, y=math.nan), p)
    # A coefficient that cancels still needs a value.
    with pytest.raises(MissingVariable, match="w"):
        evaluate_one(one(spark, x=1.0), Predicate.of("w", ("w", -1.0), 1.0))


def test_map_states(spark):
    df = spark.createDataFrame([("a", 0.0, {"x": 1.0, "y": 2.0}), ("a", 1.0, {"x": 4.0})], "trace_id string, time double, s map<string,double>")
    traces = TraceSet.of(df, states="s")
    assert [r.robustness for r in monitor(traces, x <= 3.0).orderBy("time").collect()] == [2.0, -1.0]
    with pytest.raises(Exception, match="'y' is missing"):
        monitor(traces, y <= 3.0).collect()
    assert [tuple(r) for r in validate(traces, And(x <= 3.0, y <= 3.0)).collect()] == [("a", 1.0, "missing", "y")]


def test_intervals():
    assert Interval(0, 2).shift(1.0) == Interval(1, 3) and str(Interval(0, 2, closed=False)) == "[0.0, 2.0)"
    assert Interval(0, 2).contains(2.0) and not Interval(0, 2, closed=False).contains(2.0)
    for low, high in ((2, 1), (math.nan, 1)):
        with pytest.raises(ValueError):
            Interval(low, high)


def test_rewrites_keep_meaning():
    p = x <= 1.0
    assert simplified(Not(Not(p)), True) == p
    assert simplified(Not(p), True) == -p and simplified(Not(p), False) == Not(p)
    assert simplified(always(always(p)), True) == always(p)
    assert simplified(always(always(p, 0, 1), 0, 1), True) == always(always(p, 0, 1), 0, 1)
    assert simplified(next_(next_(next_(p))), True) == Next(p, 3)


def test_one_exchange_and_no_repeated_window(spark, capsys):
    df = spark.range(100).selectExpr("string(id % 3) as trace_id", "double(id) as time", "double(id) as x")
    p = x <= 50.0
    f = And(always(Or(eventually(p), Not(eventually(p)))), until(p, eventually(p)))
    monitor(TraceSet.of(df), f).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("max(nanvl") <= 3


def test_evaluate_of_outer_operators_needs_no_window(spark, capsys):
    df = spark.range(100).selectExpr("string(id % 3) as trace_id", "double(id) as time", "double(id) as x")
    evaluate(TraceSet.of(df), And(always(x <= 50.0), Not(eventually(x <= 2.0)))).explain()
    plan = capsys.readouterr().out
    assert "Window" not in plan and "partial_min" in plan


def test_empty_traces(spark):
    nothing = TraceSet.empty(spark, ["x"])
    p = x <= 1.0
    assert evaluate_one(nothing, always(p)) == math.inf and evaluate_one(nothing, eventually(p)) == -math.inf
    for f in (p, next_(p), until(p, p)):
        with pytest.raises(EmptyTrace):
            evaluate_one(nothing, f)
        assert monitor(nothing, f).count() == 0
    with pytest.raises(MismatchedLengths) as error:
        interpret(And(always(p), p), [])
    assert (error.value.left, error.value.right) == (1, 0)
    ids = spark.createDataFrame([("a",), ("b",)], "trace_id string")
    some = TraceSet.from_samples(spark, [(1.0, {"x": 0.0})], trace_id="a")
    assert sorted(map(tuple, monitor(some, always(p), all_traces=ids).collect())) == [("a", 1.0, 1.0), ("b", 0.0, math.inf)]
    assert sorted(map(tuple, evaluate(some, always(p), all_traces=ids).collect())) == [("a", 1.0, 1.0), ("b", 0.0, math.inf)]
    with pytest.raises(EmptyTrace):
        evaluate(some, p, all_traces=ids)


def test_nan_metrics_are_passed_over(spark):
    nan = CustomExpression("as it is", lambda value: value("x"))
    traces = TraceSet.from_samples(spark, [(0.0, {"x": 1.0, "y": 1.0}), (1.0, {"x": math.nan, "y": 2.0}), (2.0, {"x": 0.5, "y": math.nan})])
    other = CustomExpression("other", lambda value: value("y"))
    got = lambda f: [r.robustness for r in monitor(traces, f).orderBy("time").collect()]
    assert got(always(nan)) == [0.5, 0.5, 0.5] and got(eventually(nan)) == [1.0, 0.5, 0.5]
    assert got(And(nan, other)) == [1.0, 2.0, 0.5] and got(Or(nan, other)) == [1.0, 2.0, 0.5]


# Hybrid

r1, r2, sd1, sd2, sd3, u = HybridDistance.of(1.0), HybridDistance.of(2.0), HybridDistance.of((1, -3.0)), HybridDistance.of((2, -1.0)), HybridDistance.of((1, -4.0)), UNREACHABLE


def test_lattice():
    assert [r1.meet(r2), r1.meet(sd1), r1.meet(u), sd1.meet(sd2), sd1.meet(sd3), sd1.meet(u)] == [r1, sd1, u, sd2, sd3, u]
    assert [r1.join(r2), r1.join(sd1), sd1.join(sd2), sd1.join(sd3), sd1.join(u), u.join(r1), u.join(u)] == [r2, r1, sd1, sd1, sd1, r1, u]
    assert -HybridDistance.of((2, -3.0)) == HybridDistance.of((2, 3.0)) and -u == u


t = var("t")
LIGHT = Automaton([("Green", "Yellow", t >= 15.0), ("Yellow", "Red", t >= 5.0), ("Red", "Green", t >= 20.0)])
R, S = HybridDistance.robustness, HybridDistance.state_distance
LIGHTS = [
    (HybridPredicate(t <= 10.0, (), LIGHT), [R(-1), R(8), R(-8)]),
    (HybridPredicate(t <= 15.0, {"Green"}, LIGHT), [R(4), S(2, -3), S(1, -2)]),
    (HybridPredicate(None, {"Red"}, LIGHT), [S(2, -4), S(1, -3), R(math.inf)]),
]


@pytest.mark.parametrize(("predicate", "expected"), LIGHTS)
def test_traffic_light(spark, predicate, expected):
    for (mode, time), value in zip((("Green", 11.0), ("Yellow", 2.0), ("Red", 18.0)), expected, strict=True):
        traces = TraceSet.from_samples(spark, [(0.0, {"t": time, "label": mode})], label="label")
        assert evaluate_one(traces, predicate) == value


def test_satisfied_guards_count_zero_and_unknown_modes_are_unreachable(spark):
    p = HybridPredicate(None, {"Red"}, LIGHT)
    at = lambda mode, time: evaluate_one(TraceSet.from_samples(spark, [(0.0, {"t": time, "label": mode})], label="label"), p)
    assert at("Yellow", 6.0) == S(1, 0.0)
    assert at("Blue", 6.0) == UNREACHABLE


def test_only_used_guards_need_values(spark):
    p = HybridPredicate(var("missing") <= 1.0, {"Red"}, LIGHT)
    traces = TraceSet.from_samples(spark, [(0.0, {"t": 1.0, "missing": None, "label": "Yellow"}), (1.0, {"t": 1.0, "missing": 0.0, "label": "Red"})], label="label")
    rows = monitor(traces, p).orderBy("time").collect()
    assert [(r.kind, r.hops, r.dist) for r in rows] == [("state_distance", 1, -4.0), ("robustness", None, 1.0)]


def test_guards_and_paths():
    a, b = Guard.of([x <= 1.0, x <= 2.0]), Guard.of(x <= 3.0)
    system = Automaton([(1, 2, a), (1, 2, b), (2, 3, b), (1, 4, b), (4, 3, a)])
    assert system.shortest_path(1, 1) is None and system.shortest_path(3, 1) is None
    assert system.shortest_path(1, 2).next_guard == a and system.shortest_path(1, 3).hops == 2 and system.shortest_path(1, 3).next_guard == a
    assert Automaton({(1, 2): [x <= 1.0]}).labels == (1, 2) and a.distances(lambda p: p.constant) == [1.0, 2.0]


def test_empty_guards_and_mixed_metrics_are_refused(spark):
    traces = TraceSet.from_samples(spark, [(0.0, {"x": 1.0, "label": 1})], label="label")
    with pytest.raises(EmptyConstraints):
        monitor(traces, HybridPredicate(None, {2}, Automaton([(1, 2, [])])))
    with pytest.raises(MetricMismatch):
        monitor(traces, And(x <= 1.0, HybridPredicate(None, {1}, Automaton([]))))


# Traces


def test_trace_access(spark):
    traces = TraceSet.from_samples(spark, {float(i): {"v": i + 1} for i in range(10)})
    assert len(traces) == 10 and not traces.is_empty() and TraceSet.empty(spark, ["v"]).is_empty()
    assert traces[3]["v"] == 4.0
    with pytest.raises(KeyError):
        traces[3.5]
    with pytest.raises(InvalidTrace):
        traces.at_time(math.nan)
    assert [r.time for r in traces.range(0, 4)] == [0.0, 1.0, 2.0, 3.0]
    assert [r.v for r in traces.range(0, 4, low_closed=False, high_closed=True)] == [2.0, 3.0, 4.0, 5.0]
    assert [r.time for r in reversed(traces)][:2] == [9.0, 8.0]
    assert traces.variables == ("v",) and traces.count().first()["n"] == 10


def test_insert_replaces_and_repeats_are_found(spark):
    traces = TraceSet.from_samples(spark, [(0.0, {"v": 1.0}), (-0.0, {"v": 2.0}), (1.0, {"v": 3.0})])
    assert len(traces) == 2 and traces[0.0]["v"] == 2.0
    more = traces.insert(TraceSet.from_samples(spark, [(1.0, {"v": 9.0}), (2.0, {"v": 4.0})]))
    assert [r.v for r in more] == [2.0, 9.0, 4.0]
    twice = traces.with_df(traces.df.union(traces.df))
    with pytest.raises(InvalidTrace):
        twice.validated()
    with pytest.raises(InvalidTrace):
        TraceSet.from_samples(spark, [(math.nan, {"v": 1.0})])


def test_csv_and_parquet(spark, tmp_path):
    path = tmp_path / "trace.csv"
    path.write_text("time,x\n0,3\n1,-2\n2,0.5\n")
    traces = TraceSet.read_csv(spark, str(path))
    assert evaluate_one(traces, always(Or(x <= 0.0, x * -1.0 <= 0.0))) == 0.5
    traces.write(str(tmp_path / "out"))
    again = TraceSet.read(spark, str(tmp_path / "out"))
    assert len(again) == 3


def test_custom_operator_and_batches(spark):
    traces = TraceSet.from_samples(spark, [(0.0, {"x": 1.0}), (1.0, {"x": 5.0})])

    def doubled(batches):
        for b in batches:
            yield b.assign(x=b.x * 2)

    assert [r.x for r in traces.map_states(doubled)] == [2.0, 10.0]


def test_a_callers_metric(spark):
    from pyspark.sql import functions as F

    from rhoscope.functions.metrics import Metric, register_metric

    class Truth(Metric):
        """false < true."""

        name = "truth"

        def top(self):
            return F.lit(True)

        def bottom(self):
            return F.lit(False)

        def neg(self, a):
            return ~a

        def flatten(self, a):
            return [a.alias("holds")]

    register_metric(Truth())
    small = CustomExpression("small", lambda value: value("x") < 3.0, metric="truth")
    traces = TraceSet.from_samples(spark, [(float(i), {"x": float(v)}) for i, v in enumerate([1, 5, 2, 1])])
    holds = lambda f: [r.holds for r in monitor(traces, f).orderBy("time").collect()]
    assert holds(always(small)) == [False, False, True, True]
    assert holds(eventually(small, 1, 1)) == [False, True, True, False]
    assert holds(until(small, Not(small))) == [False, False, False, False]
    assert holds(Or(next_(small), Not(small))) == [False, True, True, False]


def test_improper_times_fail_when_a_formula_is_evaluated(spark):
    for bad in (None, math.nan):
        traces = TraceSet.of(spark.createDataFrame([("a", 0.0, 1.0), ("b", bad, 1.0)], "trace_id string, time double, x double"))
        for run in (monitor, evaluate):
            with pytest.raises(Exception, match="a time is NULL or NaN in trace b"):
                run(traces, always(x <= 2.0)).collect()
        assert [r.trace_id for r in traces.problems().collect()] == ["b"]
    whole = TraceSet.of(spark.createDataFrame([("a", None, 1.0)], "trace_id string, time long, x double"))
    with pytest.raises(Exception, match="a time is NULL"):
        monitor(whole, x <= 2.0).collect()


def test_repeated_times_by_sequence_and_in_inserts(spark):
    df = spark.createDataFrame([("a", 0.0, 5.0, 1), ("a", 0.0, 7.0, 2), ("a", 1.0, 2.0, 3)], "trace_id string, time double, x double, seq int")
    assert [r.robustness for r in monitor(TraceSet.of(df, sequence="seq"), x <= 10.0).orderBy("time").collect()] == [3.0, 8.0]
    old = TraceSet.of(df.filter("time = 1"))
    new = df.filter("time = 0")
    assert {tuple(map(tuple, old.insert(new.repartition(k)).ordered().collect())) for k in (1, 2, 3)} == {tuple(map(tuple, old.insert(new).ordered().collect()))}


def test_zipped_traces_have_the_same_times(spark):
    frame = lambda rows, name="x": TraceSet.of(spark.createDataFrame(rows, f"trace_id string, time double, {name} double"))
    left = frame([("a", 0.0, 1.0), ("a", 1.0, 2.0), (None, 0.0, 3.0)])
    both = left.zipped(frame([("a", 1.0, 5.0), ("a", 0.0, 4.0), (None, 0.0, 6.0)]))
    assert sorted((r.x, r.x_2) for r in both.df.collect()) == [(1.0, 4.0), (2.0, 5.0), (3.0, 6.0)]
    assert sorted(r.robustness for r in monitor(both, x <= var("x_2")).collect()) == [3.0, 3.0, 3.0]
    with pytest.raises(MismatchedLengths) as caught:
        left.zipped(frame([("a", 0.0, 1.0), (None, 0.0, 3.0)]))
    assert (caught.value.left, caught.value.right) == (2, 1)
    with pytest.raises(MismatchedTimes):
        left.zipped(frame([("a", 0.0, 1.0), ("a", 2.0, 1.0), (None, 0.0, 3.0)]))


def test_automata_from_tables(spark):
    edges = spark.createDataFrame([("p", "q", 4.0), ("q", "r", 2.0)], "a string, b string, limit double")
    guard = lambda r: x <= r["limit"]
    assert Automaton.from_df(edges.coalesce(1), "a", "b", guard).shortest_path("p", "r").hops == 2
    with pytest.raises(ValueError, match="more than 1"):
        Automaton.from_df(edges, "a", "b", guard, most=1)
    with pytest.raises(ValueError, match="NULL"):
        Automaton.from_df(spark.createDataFrame([("p", None, 1.0)], "a string, b string, limit double"), "a", "b", guard)
    with pytest.raises(EmptyConstraints):
        Automaton.from_df(edges, "a", "b", lambda r: ())


@pytest.mark.parametrize("width", [0.5, 3.0, 100.0])
def test_blocks_for_half_open_windows_and_strict_until(spark, width):
    times = [0.0, 0.25, 1.0, 1.5, 2.0, 3.25, 6.0, 6.5, 7.0, 9.75]
    traces = TraceSet.of(spark.createDataFrame([(k, t, float((i * 7 + len(k)) % 9)) for k in ("a", "bb") for i, t in enumerate(times)], "trace_id string, time double, x double"))
    p, q = x <= 5.0, x * -1.0 <= -3.0
    for f in (always(p, 0.5, 2.0, closed=False), eventually(p, -1.0, 0.25, closed=False), until(p, q, strict=True), And(until(q, p, strict=True), always(q, 0, 1, closed=False))):
        rows = lambda df: sorted(map(tuple, df.collect()))
        assert rows(monitor(traces, f, block_width=width)) == rows(monitor(traces, f))

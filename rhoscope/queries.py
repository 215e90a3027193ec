"""The registered queries of the monitor, with the same in DuckDB SQL.

Traces are the events of a user: time is seconds since the epoch, the variable is value, the mode event_type.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rhoscope.engine import evaluate, evaluate_one, monitor, validate, violations
from rhoscope.errors import RhoscopeError
from rhoscope.functions.metrics import SCALAR, HybridDistance
from rhoscope.operators.automaton import Automaton
from rhoscope.plans.dsl import always, eventually, next_, prev, until, var
from rhoscope.plans.formula import And, CustomExpression, CustomOperator, Formula, HybridPredicate, Implies, Not, Or, Predicate, TraceFunction
from rhoscope.plans.parser import parse_formula, parse_hybrid_formula, parse_predicate
from rhoscope.sources.traces import TraceSet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

x = var("value")
LOW, HIGH = x <= 300.0, x * -1.0 <= -50.0
SYSTEM = Automaton([("view", "click", x <= 100.0), ("click", "purchase", x >= 20.0), ("purchase", "view", x >= 0.0), ("signup", "view", [x <= 50.0, x >= 10.0]), ("click", "error", x >= 400.0)])
BUYING = HybridPredicate(x <= 400.0, {"purchase"}, SYSTEM)
SEEING = HybridPredicate(x >= 5.0, {"view", "signup"}, SYSTEM)
EVERYWHERE = HybridPredicate(x <= 250.0, (), SYSTEM)


def events(spark: SparkSession, sf_dir: str, whole: bool = False) -> TraceSet:
    """Times in seconds as DOUBLE, or in microseconds as LONG."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    time = micros if whole else micros / F.lit(1e6)
    return TraceSet.of(df.select("user_id", time.alias("time"), "value", "event_type"), "user_id", "time", label="event_type")


BASE = "SELECT user_id, epoch_us(ts) / 1e6 AS time, epoch_us(ts) AS micros, CAST(value AS DOUBLE) AS x, event_type AS mode FROM events"
UP, DOWN = "PARTITION BY user_id ORDER BY time", "PARTITION BY user_id ORDER BY time DESC"
RUNNING = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
P, Q = "(300.0 - x)", "(-50.0 - -1.0 * x)"
TOP, BOTTOM = "'infinity'::DOUBLE", "'-infinity'::DOUBLE"


def _sql(metric: str, inner: str = "", columns: str = "user_id, time") -> str:
    return f"WITH e AS ({BASE}){inner} SELECT {columns}, {metric} + 0.0 AS robustness FROM {'e' if not inner else 'f'}"


def _register(name: str, formula: Formula, sql: str, whole: bool = False, **options) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = monitor(events(spark, sf_dir, whole), formula, **options)
        # Where there are no hops the engine has NULL; here it is -1, as comparisons differ on integers with NULL.
        return out.withColumn("hops", F.coalesce("hops", F.lit(-1))) if "hops" in out.columns else out

    QUERIES[name], ORACLE_SQL[name] = query, sql


def _within(kind: str, low: float, high: float) -> str:
    edge = lambda v: f"{abs(v)} {'FOLLOWING' if v >= 0 else 'PRECEDING'}"
    return f"coalesce({'min' if kind == 'G' else 'max'}({P}) OVER ({UP} RANGE BETWEEN {edge(low)} AND {edge(high)}), {TOP if kind == 'G' else BOTTOM})"


_register("predicate", LOW, _sql(P))
_register("not", Not(LOW), _sql(f"-{P}"))
_register("and", And(LOW, HIGH), _sql(f"least({P}, {Q})"))
_register("or", Or(LOW, HIGH), _sql(f"greatest({P}, {Q})"))
_register("implies", Implies(LOW, HIGH), _sql(f"greatest(-{P}, {Q})"))
_register("always", always(LOW), _sql(f"min({P}) OVER ({DOWN} {RUNNING})"))
_register("eventually", eventually(LOW), _sql(f"max({P}) OVER ({DOWN} {RUNNING})"))
_register("always_bounded", always(LOW, 0, 86400), _sql(_within("G", 0, 86400)))
_register("eventually_bounded", eventually(LOW, 0.5, 86400), _sql(_within("F", 0.5, 86400)))
_register("always_past_window", always(LOW, -86400, -1), _sql(_within("G", -86400, -1)))
_register("always_from", always(LOW, 3600, None), _sql(f"coalesce(min({P}) OVER ({UP} RANGE BETWEEN 3600 FOLLOWING AND UNBOUNDED FOLLOWING), {TOP})"))
_register("always_halfopen", always(LOW, 0, 86_400_000_000, closed=False), _sql(f"coalesce(min({P}) OVER (PARTITION BY user_id ORDER BY micros RANGE BETWEEN 0 FOLLOWING AND 86399999999 FOLLOWING), {TOP})", columns="user_id, micros AS time"), whole=True)
_register("eventually_halfopen", eventually(LOW, 1_000_000, 86_400_000_000, closed=False), _sql(f"coalesce(max({P}) OVER (PARTITION BY user_id ORDER BY micros RANGE BETWEEN 1000000 FOLLOWING AND 86399999999 FOLLOWING), {BOTTOM})", columns="user_id, micros AS time"), whole=True)
_HALF = f", f AS (SELECT a.user_id, a.time, min(300.0 - b.x) AS m FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.time >= a.time + 60.0 AND b.time < a.time + 86400.0 GROUP BY ALL)"
_register("always_halfopen_double", always(LOW, 60, 86400, closed=False), _sql(f"coalesce(m, {TOP})", _HALF))
_register("always_wide_kernel", always(LOW, 0, 604800), _sql(_within("G", 0, 604800)), wide="kernel")
_register("always_blocked", always(LOW), _sql(f"min({P}) OVER ({DOWN} {RUNNING})"), block_width=86400.0)
_register("eventually_blocked_bounded", eventually(LOW, 0, 86400), _sql(_within("F", 0, 86400)), block_width=172800.0)
_register("next", next_(LOW), _sql(f"lead({P}, 1, {BOTTOM}) OVER ({UP})"))
_register("next_k", next_(next_(LOW)), _sql(f"lead({P}, 2, {BOTTOM}) OVER ({UP})"))
_register("next_blocked", next_(LOW), _sql(f"lead({P}, 1, {BOTTOM}) OVER ({UP})"), block_width=86400.0)
_register("prev", prev(LOW), _sql(f"lag({P}, 1, {BOTTOM}) OVER ({UP})"))
_register("always_next_or", always(Or(next_(LOW), HIGH)), _sql(f"min(greatest(m, {Q})) OVER ({DOWN} {RUNNING})", f", f AS (SELECT *, lead({P}, 1, {BOTTOM}) OVER ({UP}) AS m FROM e)"))
_UNTIL = f", f AS (SELECT *, least(min({P}) OVER ({UP} {RUNNING}), {Q}) AS m FROM e)"
_register("until", until(LOW, HIGH), _sql(f"max(m) OVER ({DOWN} {RUNNING})", _UNTIL))
_register("until_blocked", until(LOW, HIGH), _sql(f"max(m) OVER ({DOWN} {RUNNING})", _UNTIL), block_width=86400.0)
_STRICT = f", p AS (SELECT a.user_id, a.time, least(b.q, min(b.p) OVER (PARTITION BY a.user_id, a.time ORDER BY b.time {RUNNING})) AS m FROM (SELECT *, {P} AS p, {Q} AS q FROM e) a JOIN (SELECT *, {P} AS p, {Q} AS q FROM e) b ON a.user_id = b.user_id AND b.time >= a.time), f AS (SELECT user_id, time, max(m) AS m FROM p GROUP BY ALL)"
_register("until_strict", until(LOW, HIGH, strict=True), _sql("m", _STRICT))
_register("response", always(Implies(x * -1.0 <= -250.0, eventually(x <= 100.0, 0, 86400))), _sql(f"min(greatest(250.0 - x, m)) OVER ({DOWN} {RUNNING})", f", f AS (SELECT *, coalesce(max(100.0 - x) OVER ({UP} RANGE BETWEEN 0 FOLLOWING AND 86400 FOLLOWING), {BOTTOM}) AS m FROM e)"))
_register("text_formula", parse_formula("always ((-1.0 * value <= -250.0) -> (eventually{0,86400} value <= 100.0))"), ORACLE_SQL["response"])
_register("text_until", parse_formula("(value <= 300) U (-1 * value <= -50)"), ORACLE_SQL["until"])
_register("text_reference_sign", parse_formula("always value <= 300", reference_constant_sign=True), _sql(f"min(-300.0 - x) OVER ({DOWN} {RUNNING})"))

# Hybrid formulas, with structs in the lattice's order.
_STRUCT = {"u": "struct_pack(r := 0, n := 0, d := 0.0::DOUBLE)"}
_R = lambda rho: f"struct_pack(r := 2, n := 0, d := ({rho})::DOUBLE)"
_S = lambda hops, dist: f"struct_pack(r := 1, n := -{hops}, d := ({dist})::DOUBLE)"
_BUYING = f"CASE mode WHEN 'purchase' THEN {_R('400.0 - x')} WHEN 'view' THEN {_S(2, 'least(100.0 - x, 0.0)')} WHEN 'click' THEN {_S(1, 'least(x - 20.0, 0.0)')} WHEN 'signup' THEN {_S(3, 'greatest(least(50.0 - x, 0.0), least(x - 10.0, 0.0))')} ELSE {_STRUCT['u']} END"
_SEEING = f"CASE WHEN mode IN ('view', 'signup') THEN {_R('x - 5.0')} WHEN mode = 'click' THEN {_S(2, 'least(x - 20.0, 0.0)')} WHEN mode = 'purchase' THEN {_S(1, 'least(x, 0.0)')} ELSE {_STRUCT['u']} END"
_FLAT = "CASE m.r WHEN 2 THEN 'robustness' WHEN 1 THEN 'state_distance' ELSE 'unreachable' END AS kind, CASE WHEN m.r = 1 THEN -m.n ELSE -1 END AS hops, CASE WHEN m.r > 0 THEN m.d + 0.0 END AS dist"


def _hybrid(metric: str) -> str:
    return f"WITH e AS ({BASE}), g AS (SELECT *, {_BUYING} AS a, {_SEEING} AS b FROM e), f AS (SELECT *, {metric} AS m FROM g) SELECT user_id, time, {_FLAT} FROM f"


_register("hybrid_predicate", BUYING, _hybrid("a"))
_register("hybrid_everywhere", EVERYWHERE, _hybrid(_R("250.0 - x")))
_register("hybrid_not", Not(BUYING), _hybrid("CASE WHEN a.r = 0 THEN a ELSE struct_pack(r := a.r, n := a.n, d := -a.d) END"))
_register("hybrid_and", And(BUYING, SEEING), _hybrid("least(a, b)"))
_register("hybrid_or", Or(BUYING, SEEING), _hybrid("greatest(a, b)"))
_register("hybrid_always", always(Or(BUYING, SEEING)), _hybrid(f"min(greatest(a, b)) OVER ({DOWN} {RUNNING})"))
_register("hybrid_eventually", eventually(BUYING), _hybrid(f"max(a) OVER ({DOWN} {RUNNING})"))
_register("hybrid_next", next_(BUYING), _hybrid(f"CASE WHEN lead(1) OVER ({UP}) IS NULL THEN {_STRUCT['u']} ELSE lead(a) OVER ({UP}) END"))
_register("hybrid_until", until(SEEING, BUYING), f"WITH e AS ({BASE}), g AS (SELECT *, {_BUYING} AS a, {_SEEING} AS b FROM e), h AS (SELECT *, least(min(b) OVER ({UP} {RUNNING}), a) AS c FROM g), f AS (SELECT *, max(c) OVER ({DOWN} {RUNNING}) AS m FROM h) SELECT user_id, time, {_FLAT} FROM f")
_register("hybrid_bounded", eventually(BUYING, 0, 172800), _hybrid(f"coalesce(max(a) OVER ({UP} RANGE BETWEEN 0 FOLLOWING AND 172800 FOLLOWING), {_STRUCT['u']})"))
_register("text_hybrid", parse_hybrid_formula("always (buying or seeing)", {"buying": BUYING, "seeing": SEEING}), ORACLE_SQL["hybrid_always"])

# What a caller adds.
_register("custom_expression", always(CustomExpression("no error", lambda value: F.when(F.col("event_type") != "error", F.lit(1.0)).otherwise(F.lit(-1.0)))), _sql(f"min(CASE WHEN mode <> 'error' THEN 1.0 ELSE -1.0 END::DOUBLE) OVER ({DOWN} {RUNNING})"))


def _change(context, m):
    """The metric less the one before it."""
    name = context.column(m)
    return F.coalesce(m - context.over_time(f"lag(`{name}`)"), SCALAR.bottom())


_register("custom_operator", CustomOperator("change", (LOW,), _change), _sql(f"coalesce({P} - lag({P}) OVER ({UP}), {BOTTOM})"))


def _total(times, values):
    return values.cumsum()


_register("custom_trace_function", TraceFunction("total", Predicate.of(1.0), _total), _sql(f"CAST(row_number() OVER ({UP}) AS DOUBLE)"))


def _query(name: str, sql: str):
    def put(f: Query) -> Query:
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return put


@_query("evaluate_always", f"WITH e AS ({BASE}) SELECT user_id, min(time) AS time, min({P}) AS robustness FROM e GROUP BY user_id")
def evaluate_always(spark, sf_dir):
    return evaluate(events(spark, sf_dir), always(LOW))


@_query("evaluate_first", f"WITH e AS ({BASE}), f AS (SELECT *, coalesce(max(100.0 - x) OVER ({UP} RANGE BETWEEN 0 FOLLOWING AND 86400 FOLLOWING), {BOTTOM}) AS m FROM e), g AS (SELECT user_id, min(time) AS time, min(greatest(250.0 - x, m)) AS a, arg_min({Q}, time) AS b FROM f GROUP BY user_id) SELECT user_id, time, least(a, b) AS robustness FROM g")
def evaluate_first(spark, sf_dir):
    return evaluate(events(spark, sf_dir), And(always(Implies(x * -1.0 <= -250.0, eventually(x <= 100.0, 0, 86400))), HIGH))


@_query("evaluate_with_empty", f"WITH e AS ({BASE}), f AS (SELECT user_id, min(time) AS time, min({P}) AS robustness FROM e WHERE mode = 'error' GROUP BY user_id) SELECT user_id, coalesce(time, 0.0) AS time, CASE WHEN f.time IS NULL THEN {TOP} ELSE robustness END AS robustness FROM (SELECT DISTINCT user_id FROM e) LEFT JOIN f USING (user_id)")
def evaluate_with_empty(spark, sf_dir):
    """Errors of a user are the trace; users without errors have an empty one."""
    traces = events(spark, sf_dir)
    return evaluate(traces.with_df(traces.df.filter("event_type = 'error'")), always(LOW), all_traces=traces.df.select("user_id"))


@_query("trace_range", f"WITH e AS ({BASE}), b AS (SELECT min(time) + 86400.0 AS lo, min(time) + 432000.0 AS hi FROM e) SELECT user_id, time, x AS value, mode AS event_type FROM e, b WHERE time >= lo AND time < hi")
def trace_range(spark, sf_dir):
    traces = events(spark, sf_dir)
    start = traces.df.agg(F.min("time")).first()[0]
    return traces.range(start + 86400.0, start + 432000.0).df


@_query("trace_at_time", f"WITH e AS ({BASE}) SELECT user_id, time, x AS value, mode AS event_type FROM e WHERE time = (SELECT min(time) FROM e)")
def trace_at_time(spark, sf_dir):
    traces = events(spark, sf_dir)
    return traces.at_time(traces.df.agg(F.min("time")).first()[0]).df


@_query("trace_len", f"WITH e AS ({BASE}) SELECT user_id, count(*) AS n FROM e GROUP BY user_id")
def trace_len(spark, sf_dir):
    return events(spark, sf_dir).count()


@_query("trace_times", f"WITH e AS ({BASE}) SELECT user_id, time FROM e")
def trace_times(spark, sf_dir):
    return events(spark, sf_dir).times()


@_query("trace_states", f"WITH e AS ({BASE}) SELECT user_id, x AS value, mode AS event_type FROM e")
def trace_states(spark, sf_dir):
    return events(spark, sf_dir).states_only()


@_query("trace_map_states", f"WITH e AS ({BASE}) SELECT user_id, time, x * 2.0 AS value, mode AS event_type FROM e")
def trace_map_states(spark, sf_dir):
    return events(spark, sf_dir).map_states({"value": F.col("value") * 2.0}).df


@_query("trace_update_range", f"WITH e AS ({BASE}), b AS (SELECT min(time) + 86400.0 AS lo FROM e) SELECT user_id, time, CASE WHEN time < lo THEN 0.0 ELSE x END AS value, mode AS event_type FROM e, b")
def trace_update_range(spark, sf_dir):
    traces = events(spark, sf_dir)
    start = traces.df.agg(F.min("time")).first()[0]
    return traces.update_range({"value": F.lit(0.0)}, high=start + 86400.0).df


@_query("trace_upsert", f"WITH e AS ({BASE}) SELECT user_id, time, CASE WHEN mode = 'error' THEN -1.0 ELSE x END AS value, mode AS event_type FROM e UNION ALL SELECT -1, 0.0, 1.0, 'view'")
def trace_upsert(spark, sf_dir):
    traces = events(spark, sf_dir)
    changed = traces.df.filter("event_type = 'error'").withColumn("value", F.lit(-1.0))
    fresh = spark.createDataFrame([(-1, 0.0, 1.0, "view")], traces.df.schema)
    return traces.insert(changed.unionByName(fresh)).df


@_query("trace_deduplicated", "SELECT o_custkey, epoch_us(CAST(o_orderdate AS TIMESTAMP)) / 1e6 AS time, arg_max(CAST(o_totalprice AS DOUBLE), o_orderkey) AS price, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2")
def trace_deduplicated(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("double").alias("price"), F.col("o_orderdate").cast("timestamp").alias("time"))
    return TraceSet.of(orders, "o_custkey", "time").deduplicated("o_orderkey").df


_WALK = "WITH RECURSIVE edges(a, b) AS (VALUES ('view','click'),('click','purchase'),('purchase','view'),('signup','view'),('click','error')), walk(start, target, hops) AS (SELECT a, b, 1 FROM edges UNION SELECT start, b, hops + 1 FROM walk JOIN edges ON target = a WHERE hops < 6)"


@_query("shortest_path", f"{_WALK} SELECT start, target, min(hops) AS hops FROM walk WHERE start <> target GROUP BY 1, 2")
def shortest_path(spark, sf_dir):
    rows = [(a, b, p.hops) for a in SYSTEM.labels for b, p in SYSTEM.paths_from(a).items()]
    return spark.createDataFrame(rows, "start string, target string, hops int")


@_query("fleet_summary", f"WITH e AS ({BASE}), f AS (SELECT *, min({P}) OVER ({DOWN} {RUNNING}) AS m FROM e) SELECT mode AS event_type, count(*) AS samples, CAST(sum(CASE WHEN m < 0 THEN 1 ELSE 0 END) AS BIGINT) AS violations, min(m) AS worst FROM f GROUP BY mode")
def fleet_summary(spark, sf_dir):
    return violations(events(spark, sf_dir), always(LOW), "event_type")


@_query("conversation_turns", "SELECT conv_id, CAST(turn AS BIGINT) AS time, min(4000.0 - length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS robustness FROM conversations")
def conversation_turns(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("time"), F.length("text").cast("double").alias("chars"))
    return monitor(TraceSet.of(turns, "conv_id", "time"), always(var("chars") <= 4000.0))


# Traces from files and from Python, single samples, order.
def _folder(spark: SparkSession) -> str:
    """Where a query may write: the folder that executors share, if the session names one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='rhoscope-')}/queries-{uuid.uuid4()}"


@_query("trace_csv", f"WITH e AS ({BASE}), f AS (SELECT *, min({P}) OVER ({DOWN} {RUNNING}) AS m FROM e) SELECT user_id, time, m + 0.0 AS robustness FROM f")
def trace_csv(spark, sf_dir):
    """Events written as CSV with a header, read back as traces and monitored."""
    path = _folder(spark)
    events(spark, sf_dir).with_df(events(spark, sf_dir).df.drop("event_type")).write(path, "csv", header=True)
    return monitor(TraceSet.read_csv(spark, path, "user_id long, time double, value double", keys="user_id"), always(LOW))


@_query("trace_sink", f"WITH e AS ({BASE}) SELECT user_id, time, x AS value, mode AS event_type FROM e")
def trace_sink(spark, sf_dir):
    path = _folder(spark)
    events(spark, sf_dir).write(path)
    return TraceSet.read(spark, path, keys="user_id", label="event_type").df


_ONE = "WITH e AS (SELECT * FROM (" + BASE + ") WHERE user_id = (SELECT min(user_id) FROM events))"


def _one_trace(spark, sf_dir) -> TraceSet:
    """The trace of the user whose id is lowest."""
    traces = events(spark, sf_dir)
    return traces.with_df(traces.df.filter(F.col("user_id") == traces.df.agg(F.min("user_id")).first()[0]))


@_query("trace_index", f"{_ONE} SELECT user_id, time, x AS value, mode AS event_type FROM e WHERE time = (SELECT max(time) FROM e)")
def trace_index(spark, sf_dir):
    traces = _one_trace(spark, sf_dir)
    return spark.createDataFrame([traces[traces.df.agg(F.max("time")).first()[0]]], traces.df.schema)


def _numbered(spark, rows):
    return spark.createDataFrame([(i, r["time"], r["value"]) for i, r in enumerate(rows)], "place long, time double, value double")


@_query("trace_iteration", f"{_ONE} SELECT row_number() OVER (ORDER BY time) - 1 AS place, time, x AS value FROM e")
def trace_iteration(spark, sf_dir):
    """One trace, sample by sample."""
    return _numbered(spark, iter(_one_trace(spark, sf_dir)))


@_query("trace_reversed", f"{_ONE} SELECT row_number() OVER (ORDER BY time DESC) - 1 AS place, time, x AS value FROM e")
def trace_reversed(spark, sf_dir):
    return _numbered(spark, reversed(_one_trace(spark, sf_dir)))


@_query("trace_exact_size", "SELECT count(*) AS n, false AS empty, count(*) FILTER (false) AS n_empty, true AS empty_is FROM events")
def trace_exact_size(spark, sf_dir):
    traces, none = events(spark, sf_dir), TraceSet.empty(spark, ["value"])
    return spark.createDataFrame([(len(traces), traces.is_empty(), len(none), none.is_empty())], "n long, empty boolean, n_empty long, empty_is boolean")


@_query("trace_empty", f"SELECT user_id, 0.0::DOUBLE AS time, {TOP} AS robustness FROM events GROUP BY user_id")
def trace_empty(spark, sf_dir):
    """Every user has an empty trace, in which a formula holds always without end."""
    users = events(spark, sf_dir).df.select(F.col("user_id").cast("string").alias("trace_id"))
    return monitor(TraceSet.empty(spark, ["value"]), always(LOW), all_traces=users).select(F.col("trace_id").cast("long").alias("user_id"), "time", "robustness")


@_query("trace_from_pairs", "SELECT * FROM (VALUES ('0', 0.5::DOUBLE, 290.0::DOUBLE, 270.0::DOUBLE), ('0', 2.0, 270.0, 270.0), ('0', 3.25, 299.0, 299.0)) t(trace_id, time, robustness, later)")
def trace_from_pairs(spark, sf_dir):
    """From a mapping and from pairs, the later of which count; both sides of a zip."""
    first = TraceSet.from_samples(spark, {2.0: {"value": 30.0}, 0.5: {"value": 10.0}, 3.25: {"value": 1.0}})
    again = TraceSet.from_samples(spark, [(3.25, {"value": 9.0}), (0.5, {"value": 10.0}), (2.0, {"value": 30.0}), (3.25, {"value": 1.0})])
    both = first.zipped(again)
    out = monitor(both, LOW).join(monitor(again, always(LOW)).withColumnRenamed("robustness", "later"), ["trace_id", "time"])
    return out.select("trace_id", "time", "robustness", "later")


@_query("trace_zip", f"WITH e AS ({BASE}) SELECT user_id, time, (5.0 - (-2.0 * x + x)) + 0.0 AS robustness FROM e")
def trace_zip(spark, sf_dir):
    traces = events(spark, sf_dir)
    doubled = traces.with_df(traces.df.withColumn("value", F.col("value") * 2.0))
    return monitor(traces.zipped(doubled), Predicate.of(("value", 1.0), ("value_2", -1.0), 5.0))


_register("negated_terms", -(LOW + ("value", 2.0) - 4.0), _sql("(-296.0 - -3.0 * x)"))
_register("until_strict_blocked", until(LOW, HIGH, strict=True), ORACLE_SQL["until_strict"], block_width=86400.0)
_register("always_halfopen_double_blocked", always(LOW, 60, 86400, closed=False), ORACLE_SQL["always_halfopen_double"], block_width=86400.0)


@_query("predicate_access", "SELECT * FROM (VALUES ('height', 2.5::DOUBLE, 7.0::DOUBLE), ('speed', -1.0, 7.0)) t(variable, coefficient, constant)")
def predicate_access(spark, sf_dir):
    """Accessors of a predicate that text gives."""
    p = parse_predicate("2.5 * height + 1 <= speed + 8")
    assert p.get("depth") is None
    return spark.createDataFrame([(n, p[n], p.constant) for n in p.variables], "variable string, coefficient double, constant double")


_GAPS = "SELECT user_id, time, CASE WHEN mode = 'error' THEN NULL WHEN mode = 'signup' THEN 'nan'::DOUBLE ELSE x END AS x, mode FROM (" + BASE + ")"


def _with_gaps(spark, sf_dir) -> TraceSet:
    """Values of errors are missing, those of signups NaN."""
    traces, mode = events(spark, sf_dir), F.col("event_type")
    return traces.map_states({"value": F.when(mode == "error", F.lit(None)).when(mode == "signup", F.lit(float("nan"))).otherwise(F.col("value"))})


def _problem_sql(where: str) -> str:
    return f"WITH e AS ({_GAPS}), f AS (SELECT *, CASE WHEN x IS NULL THEN 'missing' ELSE 'nan' END AS problem FROM e WHERE (x IS NULL OR isnan(x)) AND {where}) SELECT user_id, min(time) AS time, arg_min(problem, time) AS problem, 'value' AS variable FROM f GROUP BY user_id"


@_query("predicate_errors", _problem_sql("true"))
def predicate_errors(spark, sf_dir):
    """The first sample of every trace whose value can't be used."""
    return validate(_with_gaps(spark, sf_dir), always(LOW))


@_query("hybrid_errors", _problem_sql("mode <> 'error'"))
def hybrid_errors(spark, sf_dir):
    """Errors reach no purchase, so no guard asks for their values; signups do."""
    return validate(_with_gaps(spark, sf_dir), eventually(BUYING))


@_query("hybrid_conversions", "SELECT * FROM (VALUES ('2.5', 2, -1, 2.5::DOUBLE), ('(3, -1.5)', 1, 3, -1.5), ('-(3, -1.5)', 1, 3, 1.5), ('meet', 1, 3, -1.5), ('join', 2, -1, 2.5), ('unreachable', 0, -1, NULL)) t(value, rank, hops, dist)")
def hybrid_conversions(spark, sf_dir):
    """Hybrid distances from numbers and from (hops, distance), their negation and lattice."""
    a, b = HybridDistance.of(2.5), HybridDistance.of((3, -1.5))
    held = {"2.5": a, "(3, -1.5)": b, "-(3, -1.5)": -b, "meet": a.meet(b), "join": a.join(b), "unreachable": a.meet(HybridDistance(0))}
    return spark.createDataFrame([(n, v.rank, v.hops if v.rank == 1 else -1, v.dist if v.rank else None) for n, v in held.items()], "value string, rank int, hops int, dist double")


def _wrong(spark) -> dict:
    """What goes wrong, by name."""
    one = lambda **state: TraceSet.from_samples(spark, [(0.0, state)])
    other = TraceSet.from_samples(spark, [(1.0, {"value": 1.0})])
    longer = TraceSet.from_samples(spark, [(0.0, {"value": 1.0}), (1.0, {"value": 1.0})])
    return {
        "missing variable": lambda: evaluate_one(one(x=1.0), LOW),
        "coefficient is NaN": lambda: evaluate_one(one(value=1.0), LOW + ("y", float("nan"))),
        "empty trace": lambda: evaluate_one(TraceSet.empty(spark, ["value"]), LOW),
        "within always": lambda: evaluate_one(one(x=1.0), always(LOW, 0, 1)),
        "time is NaN": lambda: TraceSet.from_samples(spark, [(float("nan"), {})]),
        "no such time": lambda: one(value=1.0)[3.0],
        "lengths differ": lambda: one(value=1.0).zipped(longer),
        "times differ": lambda: one(value=1.0).zipped(other),
        "metrics differ": lambda: evaluate_one(one(value=1.0), And(LOW, BUYING)),
        "guard is empty": lambda: evaluate_one(TraceSet.from_samples(spark, [(0.0, {"value": 1.0, "m": "a"})], label="m"), HybridPredicate(LOW, {"b"}, Automaton([("a", "b", ())]))),
        "text goes on": lambda: parse_formula("value <= 3 ) or"),
        "name is unknown": lambda: parse_hybrid_formula("always buyin", {"buying": BUYING}),
        "bounds are turned": lambda: parse_formula("always{2,1} value <= 3"),
    }


@_query("errors", "SELECT * FROM (VALUES ('missing variable','MissingVariable'),('coefficient is NaN','NanCoefficient'),('empty trace','EmptyTrace'),('within always','MissingVariable'),('time is NaN','InvalidTrace'),('no such time','KeyError'),('lengths differ','MismatchedLengths'),('times differ','MismatchedTimes'),('metrics differ','MetricMismatch'),('guard is empty','EmptyConstraints'),('text goes on','IncompleteParse'),('name is unknown','MissingPredicate'),('bounds are turned','ParseError')) t(what, error)")
def errors(spark, sf_dir):
    out = []
    for what, run in _wrong(spark).items():
        try:
            run()
            out.append((what, "none"))
        except (RhoscopeError, KeyError) as error:
            out.append((what, type(error).__name__))
    return spark.createDataFrame(out, "what string, error string")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every large value is followed by a small one within a day, seen from every event."""
    return QUERIES["response"](spark, sf_dir)

"""Sets of traces: rows keyed by trace and time, in a DataFrame.

The state is one DOUBLE column per variable (best: only columns that a formula names are read) or a MAP of
them; a mode column is needed by hybrid predicates only. Times are DOUBLE, or LONG counts of some unit, in
which half-open windows are exact. Order is the order of times; the reader's row order means nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rhoscope.errors import InvalidTrace, MismatchedLengths, MismatchedTimes, MissingVariable


@dataclass(frozen=True)
class TraceSet:
    df: DataFrame
    keys: tuple[str, ...] = ("trace_id",)
    time: str = "time"
    label: str | None = None
    states: str | None = None
    """Name of a MAP<STRING, DOUBLE> column that holds the state; None: the state is in columns."""

    # Making

    @staticmethod
    def of(df: DataFrame, keys: Sequence[str] | str = "trace_id", time: str | Column = "time", label: str | None = None, states: str | None = None, sequence: str | None = None) -> TraceSet:
        """Traces in a DataFrame. ``time`` may be an expression; times are DOUBLE unless they are integers.

        Times that are NULL or NaN fail when a formula is evaluated; ``problems`` lists them. Of samples at one time the
        one with the largest ``sequence`` stays; without it, times are taken to be unique (``validated`` checks that).
        """
        keys = (keys,) if isinstance(keys, str) else tuple(keys)
        name = time if isinstance(time, str) else "time"
        column = F.col(time) if isinstance(time, str) else time
        kind = df.select(column.alias("t")).schema["t"].dataType
        if isinstance(kind, T.TimestampNTZType):
            column, kind = column.cast("timestamp"), T.TimestampType()
        if isinstance(kind, T.TimestampType):
            column = F.unix_micros(column) / F.lit(1e6)
        elif not isinstance(kind, (T.LongType, T.IntegerType)):
            column = column.cast("double") + F.lit(0.0)  # -0.0 and 0.0 are one time
        else:
            column = column.cast("long")
        out = TraceSet(df.withColumn(name, column), keys, name, label, states)
        return out.deduplicated(sequence) if sequence else out

    @staticmethod
    def empty(spark: SparkSession, variables: Sequence[str]) -> TraceSet:
        return TraceSet(spark.createDataFrame([], ", ".join(["trace_id string", "time double", *(f"`{v}` double" for v in variables)])))

    @staticmethod
    def from_samples(spark: SparkSession, samples: Any, trace_id: str = "0", label: str | None = None) -> TraceSet:
        """One trace from (time, state) pairs or a mapping; a state maps names to numbers. Later pairs replace earlier ones."""
        pairs = list(samples.items() if isinstance(samples, Mapping) else samples)
        held = {float(t) + 0.0: dict(s) for t, s in pairs}
        if any(t != t for t in held):
            raise InvalidTrace("a time is NaN")
        names = sorted({n for s in held.values() for n in s if n != label})
        kind = "string" if any(isinstance(s.get(label), str) for s in held.values()) else "int"
        schema = ", ".join(["trace_id string", "time double", *(f"`{n}` double" for n in names), *([f"`{label}` {kind}"] if label else [])])
        number = lambda v: None if v is None else float(v)
        rows = [(trace_id, t, *(number(s.get(n)) for n in names), *([s.get(label)] if label else [])) for t, s in held.items()]
        return TraceSet(spark.createDataFrame(rows, schema), label=label)

    @staticmethod
    def read(spark: SparkSession, path: str, file_format: str = "parquet", schema: str | T.StructType | None = None, keys: Sequence[str] | str | None = "trace_id", time: str = "time", label: str | None = None, **options: Any) -> TraceSet:
        """From any format Spark reads. With no ``keys`` the file is one trace."""
        reader = spark.read.format(file_format).options(**options)
        df = (reader.schema(schema) if schema is not None else reader).load(path)
        if keys is None:
            df, keys = df.withColumn("trace_id", F.lit("0")), "trace_id"
        return TraceSet.of(df, keys, time, label)

    @staticmethod
    def read_csv(spark: SparkSession, path: str, schema: str = "time double, x double", keys: Sequence[str] | str | None = None, time: str = "time") -> TraceSet:
        """From CSV with a header; by default one trace of the variable x."""
        return TraceSet.read(spark, path, "csv", schema, keys, time, header=True)

    def write(self, path: str, file_format: str = "parquet", mode: str = "errorifexists", **options: Any) -> None:
        self.df.write.format(file_format).mode(mode).options(**options).save(path)

    def with_df(self, df: DataFrame) -> TraceSet:
        return replace(self, df=df)

    # Checking

    @property
    def variables(self) -> tuple[str, ...]:
        if self.states:
            raise TypeError("the names in a map column are in its rows")
        return tuple(c for c in self.df.columns if c not in (*self.keys, self.time, self.label))

    def value(self, name: str) -> Column:
        """A variable's column; NULL where a row has none."""
        if self.states:
            return F.col(self.states)[name].cast("double")
        if name not in self.df.columns:
            raise MissingVariable(name)
        return F.col(f"`{name}`").cast("double")

    def problems(self) -> DataFrame:
        """(keys, time, problem) of samples without a proper time, and of repeated times."""
        time = F.col(self.time)
        bad = time.isNull() | F.isnan(time.cast("double"))
        counted = self.df.groupBy(*self.keys, self.time).agg(F.count("*").alias("n"))
        return counted.filter(bad | (F.col("n") > 1)).select(*self.keys, self.time, F.when(time.isNull(), "time is null").when(F.isnan(time.cast("double")), "time is NaN").otherwise("time is repeated").alias("problem"))

    def validated(self) -> TraceSet:
        if found := self.problems().head():
            raise InvalidTrace(str(found.asDict()))
        return self

    # Access

    def count(self) -> DataFrame:
        """(keys, n): number of samples of each trace."""
        return self.df.groupBy(*self.keys).agg(F.count("*").alias("n"))

    def __len__(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def at_time(self, time: float) -> TraceSet:
        """The samples at exactly this time."""
        if time != time:
            raise InvalidTrace("a time is NaN")
        return self.with_df(self.df.filter(F.col(self.time) == F.lit(time)))

    def __getitem__(self, time: float) -> Row:
        """The one sample at this time."""
        rows = self.at_time(time).df.take(2)
        if len(rows) != 1:
            raise KeyError(time)
        return rows[0]

    def _within(self, low: float | None, high: float | None, low_closed: bool, high_closed: bool) -> Column:
        time, out = F.col(self.time), F.lit(True)
        if low is not None:
            out = out & (time >= low if low_closed else time > low)
        if high is not None:
            out = out & (time <= high if high_closed else time < high)
        return out

    def range(self, low: float | None = None, high: float | None = None, low_closed: bool = True, high_closed: bool = False) -> TraceSet:
        """Samples within bounds; None is unbounded."""
        return self.with_df(self.df.filter(self._within(low, high, low_closed, high_closed)))

    def update_range(self, changes: Mapping[str, Column], low: float | None = None, high: float | None = None, low_closed: bool = True, high_closed: bool = False) -> TraceSet:
        """New values for variables of samples within bounds; all others stay."""
        inside = self._within(low, high, low_closed, high_closed)
        return self.with_df(self.df.withColumns({n: F.when(inside, c).otherwise(F.col(n)) for n, c in changes.items()}))

    def times(self) -> DataFrame:
        return self.df.select(*self.keys, self.time)

    def states_only(self) -> DataFrame:
        return self.df.drop(self.time)

    def map_states(self, changes: Mapping[str, Column] | Callable[[Iterator], Iterator], schema: str | None = None) -> TraceSet:
        """Columns to add or replace; or a function of pandas batches (all columns in, ``schema`` out)."""
        if callable(changes):
            return self.with_df(self.df.mapInPandas(changes, schema or self.df.schema))
        return self.with_df(self.df.withColumns(dict(changes)))

    def ordered(self, descending: bool = False) -> DataFrame:
        time = F.col(self.time)
        return self.df.orderBy(*self.keys, time.desc() if descending else time.asc())

    def __iter__(self) -> Iterator[Row]:
        """Samples in order, fetched partition by partition."""
        return self.ordered().toLocalIterator()

    def __reversed__(self) -> Iterator[Row]:
        return self.ordered(descending=True).toLocalIterator()

    def insert(self, other: TraceSet | DataFrame) -> TraceSet:
        """Samples of ``other`` are added; at times that are taken they replace what is there.

        Of several new samples at one time that with the largest hash of its values stays, so reruns agree.
        """
        new = other.df if isinstance(other, TraceSet) else other
        both = self.df.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
        rest = [c for c in self.df.columns if c not in (*self.keys, self.time)]
        plain = [f"`{c}`" for c in rest if not isinstance(self.df.schema[c].dataType, T.MapType)]
        last = both.groupBy(*self.keys, self.time).agg(F.max_by(F.struct(*rest), F.struct("_age", F.xxhash64(F.lit(0), *plain))).alias("_s"))
        return self.with_df(last.select(*[F.col(c) if c in (*self.keys, self.time) else F.col(f"_s.`{c}`").alias(c) for c in self.df.columns]))

    def mismatches(self, other: TraceSet) -> DataFrame:
        """(keys, time, side): samples that only this set ("left") or only the other one ("right") has."""
        mine, theirs = self.times(), other.times().toDF(*self.keys, self.time)
        on = [*self.keys, self.time]
        same = lambda a, b: [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in on]
        only = lambda a, b, side: a.alias("a").join(b.alias("b"), same(a, b), "left_anti").withColumn("side", F.lit(side))
        return only(mine, theirs, "left").unionByName(only(theirs, mine, "right"))

    def zipped(self, other: TraceSet, suffix: str = "_2") -> TraceSet:
        """Samples of both sets side by side; columns of the other whose names are taken get ``suffix``.

        Both must have the same times in every trace: else MismatchedLengths or MismatchedTimes.
        """
        first = self.mismatches(other).orderBy(*self.keys, self.time).first()
        if first is not None:
            trace = [F.col(k).eqNullSafe(F.lit(first[k])) for k in self.keys]
            left, right = (t.times().toDF(*self.keys, self.time).filter(reduce(Column.__and__, trace)).count() for t in (self, other))
            if left != right:
                raise MismatchedLengths(left, right)
            raise MismatchedTimes(f"{first['side']} operand alone has a sample in {first.asDict()}")
        own = {*other.keys, other.time}
        theirs = other.df.select(*(F.col(f"`{a}`").alias(f"_z_{b}") for a, b in zip((*other.keys, other.time), (*self.keys, self.time), strict=True)), *(F.col(f"`{c}`").alias(f"{c}{suffix}" if c in self.df.columns else c) for c in other.df.columns if c not in own))
        on = [F.col(f"`{c}`").eqNullSafe(F.col(f"`_z_{c}`")) for c in (*self.keys, self.time)]
        return self.with_df(self.df.join(theirs, reduce(Column.__and__, on)).drop(*(f"_z_{c}" for c in (*self.keys, self.time))))

    def deduplicated(self, sequence: str) -> TraceSet:
        """One sample per time: that with the largest ``sequence``."""
        rest = [c for c in self.df.columns if c not in (*self.keys, self.time)]
        last = self.df.groupBy(*self.keys, self.time).agg(F.max_by(F.struct(*rest), sequence).alias("_s"))
        return self.with_df(last.select(*[F.col(c) if c in (*self.keys, self.time) else F.col(f"_s.`{c}`").alias(c) for c in self.df.columns]))

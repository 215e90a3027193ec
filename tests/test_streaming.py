import math

from rhoscope.plans.dsl import always, eventually, var
from rhoscope.plans.formula import And, Next, Not
from rhoscope.plans.interpret import interpret
from rhoscope.streaming.monitor import lookback, settled_count, stream_monitor

x = var("x")


def test_what_is_settled():
    times = [0.0, 1.0, 2.0, 4.0]
    p = x <= 1.0
    assert settled_count(p, times) == 4
    assert settled_count(always(p, 0, 1), times) == 3
    assert settled_count(always(p, 0, 2, closed=False), times) == 3
    assert settled_count(always(p, 0, 2), times) == 2
    assert settled_count(Next(p), times) == 3
    assert settled_count(And(Next(Next(p)), Not(always(p, 0, 1))), times) == 2
    assert settled_count(always(p), times) == 0
    assert lookback(always(p, -2, 1)) == (2.0, 0) and lookback(p.until(p))[0] == math.inf


def test_stream_equals_batch_for_what_is_settled(spark, tmp_path):
    f = And(eventually(x <= 3.0, 0, 2), Next(x <= 5.0))
    samples = [(float(i) * 0.7, {"x": float((i * 7) % 11)}) for i in range(20)]
    folder, seen = tmp_path / "in", []
    schema = "trace_id string, time double, x double"
    for k in range(4):
        rows = [("a", t, s["x"]) for t, s in samples[5 * k : 5 * k + 5]]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = stream_monitor(stream, f, timeout_ms=3_600_000).writeStream.foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    times = [t for t, _ in samples]
    n = settled_count(f, times)
    assert n > 10
    assert sorted(seen) == [("a", t, v) for t, v in interpret(f, samples)[:n]]


def test_late_samples_within_lateness_count(spark, tmp_path):
    f = And(eventually(x <= 3.0, 0, 2), Next(x <= 5.0))
    samples = [(float(i) * 0.7, {"x": float((i * 7) % 11)}) for i in range(24)]
    came = [samples[i] for k in range(0, 24, 4) for i in (k + 2, k, k + 3, k + 1)]  # up to 2.1 late, across batches too
    came[5], came[9] = came[9], came[5]
    folder, seen = tmp_path / "in", []
    schema = "trace_id string, time double, x double"
    for k in range(6):
        spark.createDataFrame([("a", t, s["x"]) for t, s in came[4 * k : 4 * k + 4]], schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = stream_monitor(stream, f, timeout_ms=3_600_000, lateness=7.0).writeStream.foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    times = [t for t, _ in samples]
    n = settled_count(f, [t for t in times if t <= times[-1] - 7.0])
    assert n > 8 and sorted(seen) == [("a", t, v) for t, v in interpret(f, samples)[:n]]

"""Counters with resets, bucketed quantiles, the audit sink, runs and open values."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import variants
from corpusloom.operators import runs
from corpusloom.streaming import audit_sink, counters

START = datetime.datetime(2024, 1, 1)


def samples():
    rnd = random.Random(8)
    out = []
    for s in ("a", "b", None):
        value, at = 0.0, START
        for _ in range(120):
            at += datetime.timedelta(minutes=rnd.randrange(1, 300))
            value = 0.0 if rnd.random() < 0.1 else value + rnd.randrange(5)
            out.append((s, at, value))
    return [*out, ("a", None, 1.0), ("a", START, None), ("c", START, 7.0)]


def steps_by_loop(rows):
    last, out = {}, []
    for s, at, v in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (str(r[0]), r[1], r[2])):
        out.append((s, at, v, None if s not in last else v if v < last[s] else v - last[s]))
        last[s] = v
    return out


@pytest.mark.parametrize("chunk", ["hour", "day", "year"])
def test_steps_against_a_loop(spark, chunk):
    rows = samples()
    df = spark.createDataFrame(rows, "s string, ts timestamp, value double").repartition(3)
    got = [tuple(r) for r in counters.counter_steps(df, ["s"], chunk=chunk).select("s", "ts", "value", "step").collect()]
    assert sorted(got, key=str) == sorted(steps_by_loop(rows), key=str)


def test_streamed_steps_agree(spark, tmp_path):
    rows = [r for r in samples() if r[1] is not None and r[0] is not None]
    rows.sort(key=lambda r: r[1])
    for k in range(4):
        part = spark.createDataFrame(rows[k * 80 : (k + 1) * 80], "s string, ts timestamp, value double").coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("s string, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = counters.counter_steps(stream, ["s"])
    q = out.writeStream.format("memory").queryName("steps").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [tuple(r) for r in spark.table("steps").select("s", "ts", "value", "step").collect()]
    assert sorted(got, key=str) == sorted(steps_by_loop(rows[:320]), key=str)


def test_quantiles(spark):
    bounds = [1.0, 2.0, 4.0]
    cases = [([0, 0, 0, 0], None), ([0, 10, 10, 10], 1.5), ([5, 5, 10, 10], 1.0), ([0, 0, 0, 3], 4.0), ([10, 10, 10, 10], 0.5), ([2, 4, 6, 20], 4.0)]
    df = spark.createDataFrame([(c,) for c, _ in cases], "c array<long>")
    assert [r["q"] for r in df.select(counters.histogram_quantile(0.5, F.col("c"), bounds).alias("q")).collect()] == [q for _, q in cases]
    with pytest.raises(ValueError):
        counters.histogram_quantile(1.5, F.col("c"), bounds)


def test_a_replayed_batch_adds_no_row(spark, tmp_path):
    sink = audit_sink.AuditSink(str(tmp_path / "log"))
    batch = spark.createDataFrame([("r1", "ok"), ("r2", "failed")], "request_id string, status string")
    sink.write(batch, 0)
    sink.write(batch, 0)
    sink.write(batch.where("status = 'ok'"), 1)
    rows = audit_sink.read_log(spark, str(tmp_path / "log"), "request_id string, status string, stream string, batch long")
    assert sorted((r["batch"], r["request_id"]) for r in rows.collect()) == [(0, "r1"), (0, "r2"), (1, "r1")]
    assert (sink.written, sink.errors) == (3, 0)


def test_write_errors_are_counted_not_raised(spark, tmp_path):
    (tmp_path / "file").write_text("in the way")
    sink = audit_sink.AuditSink(str(tmp_path / "file"))
    sink.write(spark.createDataFrame([("r1",)], "request_id string"), 0)
    assert (sink.written, sink.errors) == (0, 1)
    with pytest.raises(ValueError):
        audit_sink.AuditSink("x", "a/b")


def test_the_sink_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"request_id": "a"}\n{"request_id": "b"}\n')
    sink = audit_sink.AuditSink(str(tmp_path / "log"))
    stream = spark.readStream.schema("request_id string").json(str(tmp_path / "in"))
    sink.start(stream, str(tmp_path / "ck")).awaitTermination(60)
    (tmp_path / "in" / "2.json").write_text('{"request_id": "c"}\n')
    sink.start(stream, str(tmp_path / "ck")).awaitTermination(60)
    sink.start(stream, str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(r["request_id"] for r in audit_sink.read_log(spark, str(tmp_path / "log"), "request_id string").collect()) == ["a", "b", "c"]


def test_a_run_is_seen_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path)
    one = spark.createDataFrame([(1, "keep"), (2, "drop")], "id long, route string")
    first = runs.Run(spark, root, "2024-01-01")
    first.stage("clean", one, key="id", allowed={"route": ["keep", "drop"]})
    assert runs.committed(spark, root) == []
    manifest = first.commit(source="test")
    assert manifest["tables"]["clean"]["rows"] == 2
    crashed = runs.Run(spark, root, "2024-01-02")
    crashed.stage("clean", one.where("id = 1"))  # and no commit
    assert runs.committed(spark, root) == ["2024-01-01"]
    assert runs.read_run(spark, root, "clean", verify=True).count() == 2
    again = runs.Run(spark, root, "2024-01-02")
    again.stage("clean", one.where("id = 2"))
    again.commit()
    assert [r["id"] for r in runs.read_run(spark, root, "clean", verify=True).collect()] == [2]
    assert runs.read_run(spark, root, "clean", "2024-01-01").count() == 2
    with pytest.raises(FileExistsError):
        runs.Run(spark, root, "2024-01-02")
    assert json.loads((tmp_path / "runs" / "2024-01-01" / "manifest.json").read_text())["source"] == "test"


@pytest.mark.parametrize("rows,what", [([(1, "a"), (1, "a")], "more than once"), ([(None, "a")], "without id"), ([(1, "x")], "not allowed"), ([(1, None)], "not allowed")])
def test_bad_tables_are_refused(spark, tmp_path, rows, what):
    run = runs.Run(spark, str(tmp_path), "r1")
    with pytest.raises(ValueError, match=what):
        run.stage("t", spark.createDataFrame(rows, "id long, route string"), key="id", allowed={"route": ["a"]})


def test_changed_rows_are_told(spark, tmp_path):
    run = runs.Run(spark, str(tmp_path), "r1")
    run.stage("t", spark.range(3))
    run.commit()
    spark.range(4).write.mode("overwrite").parquet(str(tmp_path / "runs" / "r1" / "t"))
    with pytest.raises(ValueError, match="not what was committed"):
        runs.read_run(spark, str(tmp_path), "t", verify=True)
    with pytest.raises(FileNotFoundError):
        runs.read_run(spark, str(tmp_path), "t", "r9")


def test_open_values(spark):
    rows = [(None, 1), ("plain", 2), ('{"a": 1, "b": [1.5]}', None), ("{broken", 3), ('{"chosen": {"score": 1.5, "rank": 2}, "rejected": {"score": "x"}}', 4), ('{"chosen": 3}', 5), ("[]", 6)]
    df = spark.createDataFrame(rows, "m string, n int")
    got = {(r["column"], r["type"]): r["n"] for r in variants.type_histogram(df).collect()}
    assert got[("n", "int")] == 6 and got[("n", "null")] == 1 and got[("m", "malformed")] == 1 and got[("m", "text")] == 1 and got[("m", "object<a: bigint, b: array<double>>")] == 1
    sides = [tuple(r["s"]) for r in df.select(variants.preference_sides(F.col("m")).alias("s")).collect()]
    assert sides[4] == (1.5, 2, None, None) and all(s == (None,) * 4 for i, s in enumerate(sides) if i != 4)

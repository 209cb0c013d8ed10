"""The streaming forms give what the batch forms give."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from loomlog.streaming import live

T0 = datetime(2026, 1, 1, 12)


def through(spark, tmp_path, rows, schema, step, mode="append", name="q"):
    """rows as files of one batch each, all processed, the output as a list"""
    for k, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(str(tmp_path / name / str(k)))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / name / "*"))
    q = step(src).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


def test_first_seen(spark, tmp_path):
    rows = [[("a", T0), ("b", T0)], [("a", T0 + timedelta(minutes=5)), ("c", T0)]]
    got = through(spark, tmp_path, rows, "call_id string, at timestamp", lambda s: live.first_seen(s, ["call_id"]).select("call_id"), name="seen")
    assert sorted(got) == [("a",), ("b",), ("c",)]


def test_daily_rates(spark, tmp_path):
    rows = [[(T0, "codex", True), (T0, "codex", False), (T0, "codex", None)], [(T0 + timedelta(days=1), "codex", False)]]
    got = through(spark, tmp_path, rows, "at timestamp, source string, ok boolean", live.daily_rates, mode="complete", name="daily")
    assert sorted((r[0].day, *r[1:]) for r in got) == [(1, "codex", 3, 1), (2, "codex", 1, 1)]


def test_recovery_over_batches(spark, tmp_path):
    rows = [[("s", T0, "ls", False)], [("s", T0 + timedelta(seconds=1), "ls -l", True), ("t", T0, "x", False)]]
    got = through(spark, tmp_path, rows, "session string, at timestamp, cmd string, ok boolean", live.recovery, name="recovery")
    assert got == [("s", "ls", "ls -l", "then ok")]


def test_paired(spark, tmp_path):
    rows = [[("s", "a", T0, "ls", None), ("s", "a", T0 + timedelta(minutes=1), None, "out"), ("s", "b", T0, "pwd", None)], [("s", "z", T0 + timedelta(hours=9), "later", None), ("s", "z", T0 + timedelta(hours=9), None, "o")], [("s", "y", T0 + timedelta(hours=20), "end", None)]]
    schema = "session string, call_id string, at timestamp, command string, output string"

    def step(s):
        return live.paired(s.where(F.col("command").isNotNull()).drop("output"), s.where(F.col("output").isNotNull()).drop("command"), "1 hour").select("call_id", "output", "result_present")

    got = through(spark, tmp_path, rows, schema, step, name="paired")
    assert ("a", "out", True) in got and ("z", "o", True) in got and ("b", None, False) in got

"""Streams with state: equal to the batch result for any order within the lateness, later rows beside it, expiry."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusflow.session import work_dir
from corpusflow.streaming import jobs, state

DAY = datetime(2024, 1, 1)


def _files(spark, batches, schema):
    """A stream that gets one batch of rows after the other."""
    path = work_dir(spark, "batches")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return jobs.read_stream(spark, path, "*.parquet", schema_of(spark, schema), 1)


def schema_of(spark, ddl):
    return spark.createDataFrame([], ddl).schema


def _hours(*hours):
    return [DAY + timedelta(hours=h) for h in hours]


def test_spaced_rows_equal_the_batch_result(spark):
    schema = "k string, x int, ts timestamp"
    a = [("a", 1, t) for t in _hours(5, 0, 3, 9)] + [(None, 1, t) for t in _hours(2, 2)]
    b = [("a", 1, t) for t in _hours(8, 4, 30)] + [("b", 1, t) for t in _hours(12, 7)] + [("c", 1, None)]
    c = [("a", 1, t) for t in _hours(26, 80)] + [("a", 1, DAY + timedelta(hours=1))]  # the last one is 19 hours too late
    stream = _files(spark, [a, b, c], schema)
    out = jobs.run_to_table(state.spaced_rows(stream, ["k"], timedelta(hours=4), timedelta(hours=10)), "spaced", mode="append")
    kept, late = state.split_late(out, ["k"])
    on_time = spark.createDataFrame([r for r in a + b + c if r[2] is not None and r not in (c[-1],)], schema)
    decided = on_time.where(F.col("ts") < F.lit(DAY + timedelta(hours=70)))
    want = {(r.k, r.ts) for r in jobs.spaced(decided, ["k"], "4 hours").collect()}
    got = [(r.k, r.ts) for r in kept.select("k", F.timestamp_micros("_at").alias("ts")).collect()]
    assert set(got) == want and len(got) == len(want)
    assert sorted(((r.k, r.ts) for r in late.collect()), key=str) == [("a", DAY + timedelta(hours=1)), ("c", None)]


def test_answers_and_expiry(spark):
    schema = "run_id long, seq long, type string, data string, ts timestamp"

    def ev(run, seq, kind, data, hour):
        return run, seq, kind, data, DAY + timedelta(hours=hour)

    a = [ev(1, 2, "content", "two", 2), ev(1, 0, "content", "zero", 0), ev(2, 0, "tool_call", "t", 0)]
    b = [ev(1, 1, "content", "one", 1), ev(1, 3, "complete", "", 3), ev(1, 4, "content", "after", 4), ev(2, 1, "content", None, 3)]
    c = [ev(9, 0, "debug", "", 40)]
    d = [ev(1, 5, "content", "anew", 38), ev(9, 1, "debug", "", 90)]  # run 1 has been idle for more than a day
    stream = _files(spark, [a, b, c, d], schema)
    out = jobs.run_to_table(state.answer_rows(stream, timedelta(hours=6), timedelta(hours=24)), "answers", mode="append")
    kept, late = state.split_late(out, ["run_id"])
    assert late.count() == 0
    assert sorted((r.run_id, r._at, r.ordinal, r.part) for r in kept.collect()) == sorted(
        (run, int((DAY - datetime(1970, 1, 1)).total_seconds() + hour * 3600) * 1_000_000, n, part)
        for run, hour, n, part in [(1, 0, 1, "zero"), (1, 1, 2, "one"), (1, 2, 3, "two"), (2, 3, 1, ""), (1, 38, 1, "anew")])


def test_empty_stream(spark):
    stream = _files(spark, [[]], "k string, ts timestamp")
    out = state.spaced_rows(stream, ["k"], timedelta(hours=1), timedelta(hours=1))
    target = work_dir(spark, "none")
    jobs.append_updates(out, target, work_dir(spark, "none-checkpoint"), "append")


def test_state_is_read_and_written_by_buckets(spark):
    rows = [(k, t) for k in range(300) for t in _hours(0, 7, 40)]
    stream = _files(spark, [rows[:500], rows[500:]], "k long, ts timestamp")
    out = state.spaced_rows(stream, ["k"], timedelta(hours=4), timedelta(hours=48), buckets=8)
    q = out.writeStream.format("noop").option("checkpointLocation", work_dir(spark, "few")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(p.stateOperators[0].numRowsTotal for p in q.recentProgress) <= 80  # not rows for each of 300 keys


def test_odd_keys(spark):
    schema = "a double, b binary, c struct<x: int, y: array<string>>, ts timestamp"
    keys = [(float("nan"), bytearray(b"1"), (1, ["p"])), (0.0, bytearray(b"2"), (None, None)), (None, None, None)]
    rows = [(*k, t) for k in keys for t in _hours(0, 3, 9)] + [(-0.0, *keys[1][1:], DAY + timedelta(hours=1)), (1.0, None, None, DAY + timedelta(hours=60))]
    out = jobs.run_to_table(state.spaced_rows(_files(spark, [rows[:6], rows[6:]], schema), ["a", "b", "c"], timedelta(hours=4), timedelta(hours=20), buckets=1), "odd", mode="append")
    assert sorted(r.n for r in out.where("late is null").groupBy("a", "b", "c").agg(F.count("*").alias("n")).collect()) == [2, 2, 2]

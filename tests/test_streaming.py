"""Row-local operators on a stream."""

import datetime

from pyspark.sql import functions as F

from gridwash.operators import validation
from gridwash.streaming import live


def test_clean_stream_equals_batch(spark, data, tmp_path):
    contacts = data.fixture("contacts")
    path, found = str(tmp_path / "in"), validation.detected_formats(contacts, "row_id")
    contacts.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(contacts.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = (
        live.clean_stream(stream, ["trim", "null_tokens"], "row_id", found)
        .writeStream.format("memory").queryName("cleaned").outputMode("append")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    batch = live.clean_stream(contacts, ["trim", "null_tokens"], "row_id", found)
    got = spark.table("cleaned")
    assert got.count() == batch.count() > 0
    assert got.exceptAll(batch).count() == 0


def test_limits_on_a_stream(spark, data, tmp_path):
    log = data.table("events").select(F.col("ts").cast("timestamp").alias("ts"), F.lit("uploads").alias("kind"))
    path = str(tmp_path / "log")
    log.write.parquet(path)
    limits = {"uploads": (3, "1 hour")}
    stream = spark.readStream.schema(log.schema).parquet(path)
    query = (
        live.watch_limits(stream, "1 minute", limits)
        .writeStream.format("memory").queryName("breaches").outputMode("complete")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    from gridwash.operators.usage import rate_limit_breaches

    want = rate_limit_breaches(log, limits)
    assert spark.table("breaches").exceptAll(want).count() == 0 and want.count() > 0


def phases(spark, tmp_path, build, name, mode, batches, schema):
    """Run a stream once per batch of rows, restarting from its checkpoint each time."""
    path, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for rows in batches:
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        query = (
            build(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check)
            .outputMode(mode).trigger(availableNow=True).start()
        )
        query.awaitTermination(180)
        assert query.exception() is None
    return spark.read.parquet(out)


def at(minute, second=0):
    return datetime.datetime(2024, 1, 1, minute // 60, minute % 60, second)


def test_repeats_dropped_through_restarts(spark, tmp_path):
    schema = "id string, ts timestamp, v int"
    batches = [
        [("a", at(0), 1), ("b", at(1), 2), ("a", at(2), 3)],
        [("a", at(3), 4), ("c", at(5), 5)],  # a again, after a restart
        [("b", at(4), 6), ("d", at(60), 7)],
        [("a", at(61), 8)],  # a's id has been forgotten by now
    ]
    got = phases(spark, tmp_path, lambda s: live.drop_repeats(s, "id", lateness="10 minutes"), "repeats", "append", batches, schema)
    assert sorted(r.v for r in got.collect()) in ([1, 2, 5, 7, 8], [2, 3, 5, 7, 8])


def test_sessions_through_restarts_equal_batch(spark, tmp_path):
    schema = "user string, ts timestamp, value int"
    batches = [
        [("a", at(0), 1), ("a", at(4), 2), ("b", at(1), 3)],
        [("a", at(8), 4), ("b", at(30), 5), (None, at(30), 6), ("a", None, 7)],
        [("a", at(3), 8), ("b", at(200), 9)],  # the first is later than the watermark allows: dropped
        [("b", at(400), 10)],
        [("b", at(600), 11)],
    ]
    got = phases(
        spark, tmp_path, lambda s: live.sessions(s, "user", "5 minutes", lateness="10 minutes", values=["value"]), "sessions", "append", batches, schema
    )
    rows = [r for b in batches for r in b if r != ("a", at(3), 8)]
    want = live.sessions(spark.createDataFrame(rows, schema), "user", "5 minutes", values=["value"])
    closed = want.where(F.col("session_end") < F.lit(at(590)))
    assert sorted(map(str, got.collect())) == sorted(map(str, closed.collect()))
    first = next(r for r in got.collect() if r.user == "a")
    assert (first.session_start, first.session_end, first.events, first.value) == (at(0), at(13), 3, 7)


def test_running_usage_through_restarts(spark, tmp_path):
    schema = "provider string, ts timestamp, input_tokens int, output_tokens int"
    batches = [
        [("p", at(0), 10, 1), ("p", at(1), 5, None), ("q", at(0), 100, 0)],
        [("p", at(2), 4, 0), ("p", None, 9, 9), (None, at(2), 1, 1)],
        [("q", at(300), 7, 0)],  # p falls silent
        [("q", at(301), 1, 0), ("p", at(10), 1000, 0)],  # the second is too late
        [("p", at(302), 3, 0)],
    ]
    got = phases(spark, tmp_path, lambda s: live.running_usage(s, "10 minutes", 60), "usage", "append", batches, schema).collect()
    used = sorted((r.ts, r.calls, r.tokens, r.running_tokens) for r in got if r.provider == "p" and r.kind == "usage")
    assert used == [(at(1), 2, 16, 16), (at(2), 1, 4, 20), (at(302), 1, 3, 3)]
    idle = [(r.provider, r.ts, r.calls, r.running_tokens) for r in got if r.kind == "idle"]
    assert ("p", at(2), 3, 20) in idle and (None, at(2), 1, 2) in idle
    q = sorted((r.ts, r.running_tokens) for r in got if r.provider == "q" and r.kind == "usage")
    assert q[0] == (at(0), 100) and q[-1][0] == at(301)

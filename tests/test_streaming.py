import datetime as dt

from pyspark.sql import functions as F

from foliospark.streaming import audit

SCHEMA = "id long, ts timestamp, user_id long, action string"


def _events(spark, path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(1, at(0), 1, "error"), (2, at(5), 1, "error"), (3, at(59), 1, "view"), (4, at(61), 2, "error"), (4, at(62), 2, "error"), (5, at(300), 3, "view")]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    return audit.stream(spark, path, SCHEMA, 1)


def test_windows_leave_open_ones_out(spark, tmp_path):
    df = audit.windowed(_events(spark, f"{tmp_path}/in"))
    got = audit.run_once(df, "windows", f"{tmp_path}/c").select("start", "action", "n").collect()
    assert {(r.start.hour, r.action, r.n) for r in got} == {(0, "error", 2), (0, "view", 1), (1, "error", 2)}


def test_bursts_and_sessions(spark, tmp_path):
    events = _events(spark, f"{tmp_path}/in")
    assert [r.user_id for r in audit.run_once(audit.bursts(events, least=2), "bursts", f"{tmp_path}/c1").orderBy("user_id").collect()] == [1, 2]
    assert {(r.user_id, r.n) for r in audit.run_once(audit.sessions(events), "sessions", f"{tmp_path}/c2").collect()} == {(1, 2), (1, 1), (2, 2)}


def test_jobs_come_once(spark, tmp_path):
    assert audit.run_once(audit.first_jobs(_events(spark, f"{tmp_path}/in")), "jobs", f"{tmp_path}/c").count() == 5


def test_retries_end(spark, tmp_path):
    rows = [(1, False), (1, False), (1, False), (1, True), (2, False), (2, True), (3, False)]
    spark.createDataFrame(rows, "job long, ok boolean").coalesce(1).write.parquet(f"{tmp_path}/in")
    df = audit.retried(audit.stream(spark, f"{tmp_path}/in", "job long, ok boolean"))
    got = {(r.job, r.tries, r.state) for r in audit.run_once(df, "retries", f"{tmp_path}/c", "update").collect()}
    assert got == {(1, 3, "failed"), (2, 2, "done"), (3, 1, "waiting")}


def test_each_batch_and_progress(spark, tmp_path):
    seen = []
    query = audit.each_batch(_events(spark, f"{tmp_path}/in"), lambda df, n: seen.append((n, df.count())), f"{tmp_path}/c")
    query.awaitTermination()
    assert seen == [(0, 6)]
    assert audit.progress(query)["batch"] == 0


def test_stale(spark):
    beats = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:02:00")], "source string, t string").select("source", F.col("t").cast("timestamp").alias("ts"))
    assert [r.source for r in audit.stale(beats, "2024-01-01 00:02:30").collect()] == ["a"]


def test_landed_rows_over_several_batches(spark, tmp_path):
    _events(spark, f"{tmp_path}/in")
    spark.createDataFrame([(6, dt.datetime(2024, 1, 1, 1, 5), 1, "error")], SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
    log = lambda: audit.table_stream(spark, f"{tmp_path}/in", 1)
    assert audit.landed(log().groupBy().count(), f"{tmp_path}/a", "complete").collect()[0][0] == 7
    assert sorted(r.id for r in audit.landed(log().select("id"), f"{tmp_path}/b").collect()) == [1, 2, 3, 4, 4, 5, 6]
    tries = audit.landed(audit.retried(log().where("action = 'error'").select(F.col("user_id").alias("job"), F.lit(False).alias("ok"))), f"{tmp_path}/c", "update")
    last = tries.groupBy("job").agg(F.max("tries").alias("tries"), F.max_by("state", "batch").alias("state"))
    assert {tuple(r) for r in last.collect()} == {(1, 3, "failed"), (2, 2, "waiting")}


def test_nothing_lands_from_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in")
    assert audit.landed(audit.table_stream(spark, f"{tmp_path}/in").select("id"), f"{tmp_path}/a").collect() == []

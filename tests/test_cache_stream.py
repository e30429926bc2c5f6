"""The timed cache over three batches and a restart; a stream that is stopped half way."""

import datetime as dt

from foliospark.streaming import audit, cache

SCHEMA = "key string, id long, ts timestamp, value string"


def put(spark, path, *rows):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    spark.createDataFrame([(k, i, at(m), v) for k, i, m, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, out):
    df = cache.cached(audit.stream(spark, path, SCHEMA), ttl_seconds=600, late="0 seconds")
    audit.landed(df, out)
    return {(r.key, r.id, r.outcome, r.value) for r in spark.read.parquet(f"{out}/rows").collect()}


def test_entries_expire_over_three_batches_and_a_restart(spark, tmp_path):
    path, out = f"{tmp_path}/in", f"{tmp_path}/out"
    put(spark, path, ("a", 1, 0, "x"), ("a", 2, 5, None), ("b", 3, 5, None), ("a", 4, 10, None))
    first = run(spark, path, out)
    assert first == {("a", 1, "stored", "x"), ("a", 2, "hit", "x"), ("b", 3, "miss", None), ("a", 4, "miss", None)} | (first & {("a", None, "expired", "x")})
    put(spark, path, ("b", 5, 12, "y"), ("b", 6, 13, None))  # the state comes from the checkpoint
    second = run(spark, path, out) - first
    assert {("b", 5, "stored", "y"), ("b", 6, "hit", "y")} <= second and ("b", None, "expired", "y") not in second
    put(spark, path, ("c", 7, 60, None), ("b", 8, 61, None))
    third = run(spark, path, out)
    assert {("b", 8, "miss", None), ("c", 7, "miss", None), ("a", None, "expired", "x"), ("b", None, "expired", "y")} <= third
    assert sum(o == "expired" for _, _, o, _ in third) == 2


def test_a_stream_stopped_half_way_loses_and_repeats_nothing(spark, tmp_path):
    path, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for i in range(6):
        put(spark, path, *[("k", 10 * i + j, i, "v") for j in range(10)])
    df = audit.stream(spark, path, SCHEMA, 1)
    seen = []
    assert not audit.landed_while(df, out, lambda done: seen.append(done) or done < 2, poll=0.05)
    half = spark.read.parquet(f"{out}/rows").count()
    assert seen[-1] >= 2 and 20 <= half < 60
    assert audit.landed_while(df, out, lambda done: True)
    assert sorted(r.id for r in audit.landed(df, out).collect()) == list(range(60))


def test_tagged_jobs_are_cancelled_and_others_are_not(spark):
    import time

    from pyspark import InheritableThread

    ended = []

    def long():
        with audit.tagged(spark, "slow"):
            try:
                spark.range(0, 1 << 40, numPartitions=4).selectExpr("sum(id % 7)").collect()
                ended.append("done")
            except Exception as error:  # noqa: BLE001
                ended.append(str(error))

    thread = InheritableThread(target=long)
    thread.start()
    until = time.time() + 60
    while thread.is_alive() and time.time() < until:
        audit.cancel(spark, "other")
        time.sleep(1)
        audit.cancel(spark, "slow")
    thread.join(10)
    assert len(ended) == 1 and "slow" in ended[0] and not thread.is_alive()
    assert spark.range(10).count() == 10


def test_state_is_asked_once_a_batch():
    """Not once a row: with a state store each call goes to the JVM and back."""
    import pandas as pd

    class Entry:
        value, calls = ("old", 5), 0

        def exists(self):
            self.calls += 1
            return self.value is not None

        def get(self):
            self.calls += 1
            return self.value

        def clear(self):
            self.calls, self.value = self.calls + 1, None

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

    class Handle:
        timers: list = [5]  # noqa: RUF012

        def listTimers(self):  # noqa: N802
            return iter(self.timers)

        def deleteTimer(self, at):  # noqa: N802
            self.timers = [t for t in self.timers if t != at]

        def registerTimer(self, at):  # noqa: N802
            self.timers = [*self.timers, at]

    it = cache.TimedCache(10)
    it.entry, it.handle = Entry(), Handle()
    rows = pd.DataFrame({"key": "k", "id": range(100), "at": range(100), "value": ["v" if i % 20 == 6 else None for i in range(100)]})
    got = pd.concat(it.handleInputRows(("k",), iter([rows[50:], rows[:50]]), None))
    want = ["hit" if i < 5 else "stored" if i % 20 == 6 else "hit" if i > 5 and (i - 6) % 20 < 10 else "miss" for i in range(100)]
    assert got["id"].tolist() == list(range(100)) and got["outcome"].tolist() == want and got["value"][0] == "old"
    assert it.entry.value == ("v", 96) and it.handle.timers == [96] and it.entry.calls <= 4

"""The queue's batch fold against a loop, and the stream against the batch."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestone.streaming import queue_machine as M

T0 = dt.datetime(2024, 1, 1)


def log(n, seed, items=12):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.4 else f"i{rng.randrange(items)}", T0 + dt.timedelta(seconds=40 * i), i, rng.choice([*M.EVENTS, *M.EVENTS, "other", None])) for i in range(n)]
    return rows


def loop(rows, timeout=None):
    state, since, n = {}, {}, {}
    for item, ts, _, event in sorted(rows, key=lambda r: r[1:3]):
        s = state.get(item, ("none", 0))
        if timeout and item in since and ts > since[item] + dt.timedelta(seconds=timeout):
            s = ("pending", s[1])
            del since[item]
        new = M.after(s, event)
        if new[0] == "triggered":
            since.setdefault(item, ts)
        else:
            since.pop(item, None)
        state[item], n[item] = new, n.get(item, 0) + 1
    return {i: (*s, n[i]) for i, s in state.items()}, since


SCHEMA = "item string, ts timestamp, seq long, event string"


@pytest.mark.parametrize("slice_seconds", [60, 900, 10**9])
def test_batch_equals_a_loop(spark, slice_seconds):
    rows = log(600, 1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.item: (r.status, r.failures, r.events) for r in M.final_states(df, "item", "ts", "seq", "event", slice_seconds).collect()}
    assert got == loop(rows)[0]


def streamed(spark, tmp_path, rows, timeout=None):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for i in range(0, len(rows), 100):
        part = rows[i : i + 100] + rows[max(0, i - 20) : i]  # the end of the part before comes again
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.json(str(tmp_path / f"in/{i:05d}"))
    got = []
    for name in sorted(p.name for p in (tmp_path / "in").iterdir()):
        import shutil

        shutil.copytree(tmp_path / "in" / name, tmp_path / "seen", dirs_exist_ok=True, ignore=shutil.ignore_patterns("_SUCCESS", ".*"))
        stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "seen"))
        q = M.queue_stream(stream, timeout).writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).outputMode("update")
        q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return {item: (status, failures, events) for item, status, failures, events in got}


def test_stream_equals_the_batch(spark, tmp_path):
    rows = log(300, 2)
    assert streamed(spark, tmp_path, rows) == loop(rows)[0]


def test_stream_with_timers(spark, tmp_path):
    rows = log(300, 3, items=40) + [("idle", T0, 1000, "enqueue"), ("idle", T0 + dt.timedelta(seconds=1), 1001, "trigger")]
    rows.sort(key=lambda r: r[1])
    got = streamed(spark, tmp_path, rows, timeout=900)
    want, since = loop(rows, timeout=900)
    assert got["idle"][:2] == ("pending", 0) and want["idle"][0] == "triggered"
    for item, state in want.items():
        assert got[item] == state or (item in since and got[item] == ("pending", *state[1:]))


def test_counters_and_questions(spark, tmp_path):
    df = spark.createDataFrame([("a", True, 1.0, "q" * 300), ("a", False, 2.0, "short"), ("b", False, 4.0, None)], "mode string, refused boolean, latency double, question string")
    assert [r.n for r in M.metric_events(df).select(F.length("question").alias("n")).collect()] == [200, 5, None]
    df.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).json(str(tmp_path / "in"))
    q = M.counter_stream(M.metric_events(stream)).writeStream.format("memory").queryName("counters").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("counters").collect())) == sorted(map(tuple, M.counter_stream(df).collect())) == [("a", 2, 1, 1.5), ("b", 1, 0, 4.0)]

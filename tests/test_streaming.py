"""Streams give what the batch form gives."""

import random
from collections import Counter

from pyspark.sql import functions as F

from lodestone.streaming import limiter, metrics

DIR = "/root/testdata/sf0.001"


def test_windows_of_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{DIR}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    late = events.agg(F.max("ts")).first()[0]
    stream = metrics.stream_of(spark, str(tmp_path / "in"), events.schema, 10)
    got = metrics.run_available(metrics.windowed(stream, "1 day", watermark="1 hour"), "daily", str(tmp_path / "cp"))
    batch = metrics.windowed(events, "1 day")
    key = lambda r: (r.starts, r.total, r.refusals)
    finished = {key(r) for r in batch.collect() if r.ends <= late.replace(tzinfo=None)}
    assert {key(r) for r in got.collect()} <= {key(r) for r in batch.collect()}
    assert len(finished) - 1 <= got.count() <= batch.count()


def test_limiter_state(spark, tmp_path):
    rows = [("a", i, o) for i, o in enumerate(["ok", "refused", "error", "ok"])] + [("b", i, "refused") for i in range(9)]
    batch = spark.createDataFrame([(d, float(i), i, o) for d, i, o in rows], "domain string, ts double, seq long, outcome string")
    want = {}
    for d, _, o in rows:
        want[d] = limiter.next_delay(want.get(d, limiter.START), o)
    got = {r.domain: r.delay for r in limiter.delays(batch).collect()}
    assert got == {d: round(v, 9) for d, v in want.items()}
    batch.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).json(str(tmp_path / "in"))
    q = limiter.delays_stream(stream).writeStream.format("memory").queryName("delays").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    out = {r.domain: r.delay for r in spark.table("delays").orderBy("n").collect()}
    assert {d: round(v, 9) for d, v in out.items()} == got


def test_limiter_slices(spark):
    """A key with most requests is cut into slices; their fold is the fold of all its requests."""
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"d{i % 40}", float(rng.randrange(9000)), i, rng.choice(["ok", "ok", "ok", "ok", "error", "refused", "other", None])) for i in range(6000)]
    rows += [("calm", float(i), i, "other" if i % 300 else "ok") for i in range(3000)] + [(None, 1.0, 1, "refused")]
    batch = spark.createDataFrame(rows, "domain string, ts double, seq long, outcome string").repartition(3)
    want, n = {}, Counter(r[0] for r in rows)
    for d, _, _, o in sorted(rows, key=lambda r: r[1:3]):
        want[d] = limiter.next_delay(want.get(d, limiter.START), o)
    for bits in (12, 3):
        got = {r.domain: (r.delay, r.n) for r in limiter.delays(batch, bits=bits).collect()}
        assert got.keys() == want.keys()
        assert all(abs(v - want[d]) < 2e-9 and c == n[d] for d, (v, c) in got.items())
    cut = limiter.slices(batch, bits=3).collect()
    assert len([r for r in cut if r.domain == "hot"]) > 1 and max(r.n for r in cut) <= 64


def test_metric_keys(spark):
    assert metrics.rates(spark.createDataFrame([("error", 1.0)], "event_type string, value double")).first().refusals == 1

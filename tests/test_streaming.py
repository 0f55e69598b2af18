"""The streaming form of sessions against the table form."""

import json
import random

from pyspark.sql import functions as F

from catalume.streaming.sessions import stream_sessions


def test_stream_equals_table(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").orderBy("ts")
    far = spark.sql("select cast(99 as bigint) as event_id, timestamp_ntz'2099-01-01 00:00:00' as ts")  # moves the watermark past all sessions
    schema = "event_id long, ts timestamp_ntz"
    src = tmp_path / "in"
    events.select("event_id", "ts").coalesce(1).write.parquet(str(src / "a"))
    want = {(r["start"], r["last"], r["n"]) for r in stream_sessions(events, 3600).collect()}
    stream = spark.readStream.schema(schema).parquet(str(src / "*"))
    q = stream_sessions(stream, 3600, "1 day").writeStream.format("memory").queryName("sessions_out").outputMode("append").start()
    q.processAllAvailable()
    far.write.parquet(str(src / "b"))
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    got = {(r["start"], r["last"], r["n"]) for r in spark.table("sessions_out").filter(F.col("start") < "2090-01-01").collect()}
    assert got == want and len(want) > 10


def test_gap_boundary(spark):
    t = spark.sql("select cast(1000 + x as timestamp) as ts from values (0), (120), (241) as v(x)")
    assert sorted(r["n"] for r in stream_sessions(t, 120).collect()) == [1, 2]


def plain_sessions(times, gap):
    out = []
    for t in sorted(times):
        if out and t - out[-1][1] <= gap:
            out[-1][1], out[-1][2] = t, out[-1][2] + 1
        else:
            out.append([t, t, 1])
    return sorted(map(tuple, out))


def test_sessions_over_the_edges_of_slices(spark):
    """Slices of twice the gap; sessions of several slices; per key and without."""
    rng = random.Random(4)
    rows = [(k, float(rng.randrange(0, 6000))) for k in "ab" for _ in range(120)] + [("a", 600.0), ("a", 599.999999), ("a", 1200.0)]
    events = spark.createDataFrame(rows, "k string, t double").select("k", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"))
    for gap, slice_ in ((10, 20), (60, 150), (40, 3600)):
        got = sorted((r["start"], r["last"], r["n"]) for r in stream_sessions(events, gap, slice_seconds=slice_).select(F.unix_micros("start").alias("start"), F.unix_micros("last").alias("last"), "n").collect())
        assert got == plain_sessions([round(t * 1e6) for _, t in rows], gap * 1_000_000)
        by = sorted((r["k"], r["start"], r["last"], r["n"]) for r in stream_sessions(events, gap, keys=["k"], slice_seconds=slice_).select("k", F.unix_micros("start").alias("start"), F.unix_micros("last").alias("last"), "n").collect())
        assert by == sorted((k, *s) for k in "ab" for s in plain_sessions([round(t * 1e6) for c, t in rows if c == k], gap * 1_000_000))


def test_stream_of_late_and_mixed_events(spark, tmp_path):
    """Events out of order over several batches, sessions over many slices, then one that is too late."""
    rng = random.Random(5)
    times = [rng.randrange(0, 4000) for _ in range(250)] + list(range(5000, 5400, 7))
    batches = [sorted(times[k::3], key=lambda t: t // 300 + rng.random()) for k in range(3)]  # each is out of order by more than the gap
    schema, src = "k string, t long", tmp_path / "in"
    src.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src)).select("k", F.timestamp_seconds("t").alias("ts"))
    q = stream_sessions(stream, 20, "100 minutes", keys=["k"], slice_seconds=50).writeStream.format("memory").queryName("late_out").outputMode("append").start()
    for k, b in enumerate([*batches, [50_000], [10, 60_000]]):
        (tmp_path / f"{k}.json").write_text("\n".join(json.dumps({"k": "ab"[t % 2], "t": t}) for t in b))
        (tmp_path / f"{k}.json").rename(src / f"{k}.json")
        q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["k"], r["s"], r["e"], r["n"]) for r in spark.table("late_out").select("k", F.unix_seconds("start").alias("s"), F.unix_seconds("last").alias("e"), "n").collect() if r["s"] < 50_000)
    assert got == sorted((c, *s) for c in "ab" for s in plain_sessions([t for t in times if "ab"[t % 2] == c], 20)) and len(got) > 20

"""Streams with state: restarts, timers, late and early rows."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from wayfold.operators import georef, monitor
from wayfold.streaming import placing, stateful

SAMPLES = "stream_id string, seq long, raw_ns long, arrival_ns long"


def source(spark, schema, folder, files=1):
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(folder)


def test_monitor_in_the_state_store(spark, tmp_path):
    draw = random.Random(3)
    rows = [(draw.choice(["a", "b", None]), i, i * 10_000_000 + draw.randrange(-3, 3) * 6_000_000 + (i > 300) * 10**9, i * 10_000_000 + draw.randrange(4_000_000)) for i in range(600)]
    whole = monitor.snapshot(monitor.advance(spark.createDataFrame(rows, SAMPLES), spark.createDataFrame([], monitor.STATE), 10_000_000))
    folder, into = f"file://{tmp_path}/monitor", f"{tmp_path}/in"
    for k in range(3):
        part = spark.createDataFrame([*rows[200 * k : 200 * k + 200], ("a", 9, None, 5)], SAMPLES)
        part.coalesce(1).write.parquet(f"{into}/{k}")
        got = stateful.watch(source(spark, SAMPLES, into), folder, 10_000_000)  # each time a new query goes on
    assert sorted(map(str, got.select(*whole.columns).collect())) == sorted(map(str, whole.collect()))
    assert sorted(map(str, stateful.watch(source(spark, SAMPLES, into), folder, 10_000_000).collect())) == sorted(map(str, got.collect()))


def test_messages_by_count_and_time(spark, tmp_path):
    schema, into = "stream_id string, raw_ns long, seq long, value double", f"{tmp_path}/in"
    spark.createDataFrame([("a", i * 5, i, i / 2) for i in range(70)] + [("b", 1, 0, 0.0), ("b", None, 1, 0.0)], schema).coalesce(1).write.parquet(f"{into}/0")
    sent = stateful.send(source(spark, schema, into))
    with stateful.state_store(spark):
        query = sent.writeStream.format("memory").queryName("sent").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/state").trigger(processingTime="100 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.table("sent").count() < 4:
            time.sleep(0.3)
        rows = sorted((r["stream_id"], r["ts_ns"], r["n"], r["why"]) for r in spark.table("sent").collect())
        assert rows == [("a", 155, 32, "count"), ("a", 315, 32, "count"), ("a", 345, 6, "time"), ("b", 1, 1, "time")]
        spark.createDataFrame([("a", 1000 + i, 70 + i, 0.0) for i in range(32)], schema).coalesce(1).write.parquet(f"{into}/1")
        while time.time() < end and spark.table("sent").count() < 5:
            time.sleep(0.3)
        last = [r for r in spark.table("sent").collect() if r["ts_ns"] == 1031]
        assert [(r["n"], r["why"], r["seqs"]) for r in last] == [(32, "count", list(range(70, 102)))]
    finally:
        query.stop()


EVENTS = "trip_id long, at_ns long, kind string, id long, ts_ns long, a double, b double, c double, tracking boolean, pairs array<array<double>>"


def walk(late_ns, n=240, step_ns=25_000_000):
    """A bend walked at 40 poses a second; every eighth pose has a fix, turned and moved, that arrives late or early."""
    rows = []
    for i in range(n):
        x, z = (i * 0.2, 0.0) if i < n // 2 else (n * 0.1, -(i - n // 2) * 0.2)
        at = 10**12 + i * step_ns
        rows.append((1, at, "pose", i, at, x, 0.0, z, True, None))
        if i % 8 == 0:
            rows.append((1, at + late_ns, "fix", i, at, z + 20.0, x - 7.0, 0.0, False, None))
    return sorted(rows, key=lambda r: r[1])


def placed(spark, tmp_path, batches, name):
    into = f"{tmp_path}/{name}"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{into}/{k:03}")
        time.sleep(0.05)
    events = source(spark, EVENTS, into).withColumn("at", F.timestamp_micros(F.expr("at_ns div 1000")))
    out, state = f"{tmp_path}/{name}-out", f"file://{tmp_path}/{name}-state"
    stateful.run_all(spark, placing.place(events).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state))
    return spark.read.schema(georef.PLACED).parquet(out)


@pytest.mark.parametrize("late_ns", [0, 700_000_000, -300_000_000])
def test_places_of_a_stream_are_those_of_one_pass(spark, tmp_path, late_ns):
    rows = walk(late_ns)
    want = georef.online(spark.createDataFrame(rows, EVENTS)).collect()
    got = placed(spark, tmp_path, [rows[i : i + 45] for i in range(0, len(rows), 45)], "walk").collect()
    assert len(got) > 100 and sorted(r["pose_id"] for r in got) == sorted(r["pose_id"] for r in want)
    by = {r["pose_id"]: r for r in want}
    assert all(math.dist((r["east"], r["north"]), (by[r["pose_id"]]["east"], by[r["pose_id"]]["north"])) < 1e-6 and r["transform_id"] == by[r["pose_id"]]["transform_id"] for r in got)


def test_a_flood_of_poses_keeps_those_of_late_fixes(spark, tmp_path):
    """Far more poses than a fix is late for, and then all fixes at once."""
    base = walk(0, 40)
    end = base[-1][1]
    flood = [(1, end + i * 2_000_000, "pose", 1000 + i, end + i * 2_000_000, 4.0, 0.0, -4.0 - i * 0.01, True, None) for i in range(1, 3000)]
    fixes = [(1, end + 7 * 10**9, *r[2:]) for r in base if r[2] == "fix"]
    last = [(1, end + 7 * 10**9 + 1, "pose", 9999, end + 7 * 10**9 + 1, 0.0, 0.0, 0.0, True, None)]
    got = placed(spark, tmp_path, [[r for r in base if r[2] == "pose"], flood, fixes + last], "flood").collect()
    assert [r["pose_id"] for r in got] == [9999] and math.dist((got[0]["east"], got[0]["north"]), (20.0, -7.0)) < 0.5


def test_poses_are_forgotten_when_none_comes(spark, tmp_path):
    base = [r for r in walk(0, 40) if r[2] == "pose"]
    fixes = [r for r in walk(0, 40) if r[2] == "fix"]
    later = base[-1][1] + 30 * 10**9
    other = [(2, later, "pose", 1, later, 0.0, 0.0, 0.0, True, None)]
    back = [(1, later + 10**9, *r[2:]) for r in fixes] + [(1, later + 10**9 + 1, "pose", 77, later + 10**9 + 1, 0.0, 0.0, 0.0, True, None)]
    assert placed(spark, tmp_path, [base, other, other, back], "idle").collect() == []

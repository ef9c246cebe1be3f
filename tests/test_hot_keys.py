"""Operators along one long key, cut into many buckets, against one run along it."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import folds, monitor, ordered
from wayfold.operators import relational as rel
from wayfold.plans import details, registry, streams  # noqa: F401  the first and last register queries

SAMPLES = "stream_id string, seq long, raw_ns long, arrival_ns long"
MS = 10**6


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def chain(events, gap_of):
    """(time, tie, gap class) in order: what is accepted."""
    out, last = [], None
    for t, tie, g in sorted(events, key=lambda x: x[:2]):
        gap = gap_of(g)
        if gap is not None and (last is None or t - last >= gap):
            out.append((t, tie))
            last = t
    return out


@pytest.mark.parametrize("width", [7, 40, 300, 10_000, None])
def test_accepted_rows_of_a_long_key(spark, width):
    draw = random.Random(5)
    gaps = {0: 12, 1: 35, 2: None, 3: 1, 4: 90}
    made = {k: [(draw.randrange(-200, 3000), i, draw.choice(kinds)) for i in range(n)] for k, n, kinds in (("hot", 900, (0,)), (None, 300, (0, 1, 2, 4)), ("dense", 600, (3, 4)), ("never", 20, (2,)), ("one", 1, (0,)))}
    df = spark.createDataFrame([(k, t, i, g) for k, x in made.items() for t, i, g in x] + [("hot", None, 7, 0)], "k string, t long, i long, g int")
    gap = F.coalesce(*[F.when(F.col("g") == g, F.lit(n)) for g, n in gaps.items() if n is not None])
    got = rows(ordered.accepted(df, "k", ["t", "i"], gap, width).select("k", "t", "i"))
    assert got == sorted(((k, *x) for k, events in made.items() for x in chain(events, gaps.get)), key=str)


def test_columns_named_like_our_own_stay(spark):
    df = spark.createDataFrame([("s", i * 10, i, 7, 8) for i in range(50)], "k string, t long, i long, width int, gap int")
    got = ordered.accepted(df, "k", ["t", "i"], F.lit(25), 100).collect()
    assert len(got) == 17 and {(r["width"], r["gap"]) for r in got} == {(7, 8)}
    assert ordered.numbered(df, "k", ["t", "i"], "n").where("width = 7 and gap = 8 and n = i").count() == 50


def test_accepted_rows_of_steady_streams_and_nothing(spark):
    df = spark.range(5000).select(F.lit("s").alias("k"), (F.col("id") * 10).alias("t"), "id")
    assert ordered.accepted(df, "k", ["t", "id"], F.lit(25), 1000).count() == 1667
    assert ordered.accepted(df.limit(0), "k", ["t", "id"], F.lit(25)).collect() == []


def test_repeated_rows_are_accepted_once(spark):
    df = spark.createDataFrame([("s", 5, 1)] * 3 + [("s", 9, 2)] * 2, "stream_id string, raw_ns long, seq long")
    assert rows(folds.throttle(df, 4, 3)) == [("s", 1, 5), ("s", 2, 9)]
    assert folds.throttle(df.unionByName(spark.createDataFrame([("s", None, 3)], df.schema)), 0).count() == 5


def test_shedding_in_buckets(spark):
    draw = random.Random(6)
    made = [("s", i, draw.randrange(10**10), draw.choice([0, 2, 5, 8, None])) for i in range(2000)]
    df = spark.createDataFrame(made, "stream_id string, seq long, raw_ns long, hz int")
    want = [("s", i) for _, i in chain([(t, i, hz) for _, i, t, hz in made], lambda hz: 10**9 // hz if hz else None)]
    for width in (None, 10**9, 10**8):
        assert rows(folds.shed(df, width)) == sorted(want, key=str)


def stream(draw, n=3000):
    at, out = 0, []
    for i in range(n):
        at += draw.randrange(5 * MS, 15 * MS)
        out.append(("hot", i, at + draw.choice([0, 0, 0, -30 * MS]), at + draw.randrange(8 * MS) + i * 4000))
    return out


def test_drift_of_a_long_stream(spark):
    made = [*stream(random.Random(7)), ("none", 1, None, 5), ("none", 2, 5, None), *[("flat", i, i * 10, i * 10 + (7 if i else 3)) for i in range(100)]]
    df = spark.createDataFrame(made, SAMPLES)
    want = {}
    for name in ("hot", "flat"):
        state = monitor.State(name)
        for _, i, raw, arrival in sorted((x for x in made if x[0] == name), key=lambda x: (x[3], x[1])):
            if state.take(raw, arrival):
                want[name, i] = state.drift_ns
    whole = {(r["stream_id"], r["seq"]): r["drift_ns"] for r in monitor.drift(df).collect()}
    assert whole == want
    for width in (10**8, 3 * 10**9):
        cut = {(r["stream_id"], r["seq"]): r["drift_ns"] for r in monitor.drift(df, width).collect()}
        assert cut.keys() == want.keys() and all(abs(cut[k] - v) <= 1 for k, v in want.items())


def test_warnings_of_a_long_stream(spark):
    made = stream(random.Random(8))
    df = spark.createDataFrame(made, SAMPLES)
    state, told, want = monitor.State("hot"), {"late": -64, "drifts": -64}, []
    for _, i, raw, arrival in sorted(made, key=lambda x: (x[3], x[1])):
        before = state.received
        if state.take(raw, arrival):
            says = {k: bad and before - told[k] >= 64 for k, bad in (("late", state.latency_ns > 6 * MS), ("drifts", abs(state.drift_ns) > 3 * MS))}
            told.update({k: before for k, yes in says.items() if yes})
            if any(says.values()):
                want.append(("hot", i, says["late"], says["drifts"]))
    assert rows(monitor.warnings(df, 6 * MS, 3 * MS)) == sorted(want, key=str) and len(want) > 40
    assert rows(monitor.warnings(df, 6 * MS, 3 * MS, 10**9, 50)) == sorted(want, key=str)


POSE = "trip_id long, pose_id long, ts_ns long, vio_x double, vio_y double, vio_z double, qx double, qy double, qz double, qw double, state string"


def walk(n=1500):
    draw = random.Random(9)
    return [(1, i, i * 100 * MS + draw.randrange(90 * MS), math.sin(i / 9) * 5, 0.1 * i, 0.0, 0.0, math.sin(i / 40), 0.0, math.cos(i / 40), "TRACKING") for i in range(n)]


def test_smoothing_of_a_long_trip(spark):
    df = spark.createDataFrame(walk(), POSE)
    whole = {r["pose_id"]: r for r in folds.capture_health(df).collect()}
    speed = turn = 0.0
    made = walk()
    for a, b in zip(made, made[1:]):
        seconds = (b[2] - a[2]) / 1e9
        speed = 0.8 * speed + 0.2 * math.dist(a[3:6], b[3:6]) / seconds
        turn = 0.8 * turn + 0.2 * math.degrees(2 * math.acos(min(1.0, abs(sum(x * y for x, y in zip(a[6:10], b[6:10])))))) / seconds
        assert abs(whole[b[1]]["speed"] - speed) < 1e-9 and abs(whole[b[1]]["turn_dps"] - turn) < 1e-6
    cut = {r["pose_id"]: r for r in folds.capture_health(df, width_ns=3 * 10**9).collect()}
    assert cut.keys() == whole.keys() and all(abs(cut[i]["speed"] - r["speed"]) < 1e-9 for i, r in whole.items())


def test_rows_with_nulls_are_left_out(spark):
    made = walk(40)
    odd = [(1, 100, None, *made[0][3:]), (1, 101, 50 * MS, None, *made[0][4:]), (None, 102, 7, *made[0][3:]), (1, 103, 60 * MS, 1.0, 2.0, 3.0, None, 0.0, 0.0, 1.0, "TRACKING")]
    df, plain = spark.createDataFrame(made + odd, POSE), spark.createDataFrame(made, POSE)
    assert rows(folds.capture_health(df)) == rows(folds.capture_health(plain))
    assert rows(folds.keyframes(df.where("trip_id = 1"), 250 * MS, 0.3, 8.0)) == rows(folds.keyframes(plain, 250 * MS, 0.3, 8.0))
    seen = [(1, 1, 1, 0.0, 0.0, 0.0, "SIGN", 0.5, None, 1, None), (1, 2, 2, 0.5, 0.0, 0.0, None, None, 4.0, 2, "ROAD"), (1, 3, 3, None, 0.0, 0.0, "SIGN", 0.5, 1.0, 3, None), (1, 4, 4, 0.5, 0.0, 0.0, "SIGN", 0.1, float("nan"), 4, None)]
    found = folds.track_assets(spark.createDataFrame(seen, "trip_id long, ts_ns long, id long, x double, y double, z double, asset_class string, confidence double, depth_m double, frame_id long, semantic_label string")).orderBy("id").collect()
    assert [(r["id"], r["observations"], r["depth_avg_m"], r["asset_class"]) for r in found] == [(1, 1, None, "SIGN"), (2, 2, 4.0, "SIGN"), (4, 3, 4.0, "SIGN")]


@pytest.mark.parametrize("width", [1, 13, 250, None])
def test_joins_in_time_of_a_long_trip(spark, width):
    draw = random.Random(10)
    fixes = [(k, i, t) for k, n in (("hot", 300), ("no poses", 5), (None, 20)) for i in range(n) for t in [draw.randrange(2000)]] + [("hot", 900, None)]
    poses = [(k, i, t) for k, n in (("hot", 200), (None, 20), ("no fixes", 5)) for i in range(n) for t in [draw.randrange(600) + draw.choice([0, 1300])]] + [("hot", 901, None), ("hot", 902, 40), ("hot", 903, 40)]
    left = spark.createDataFrame(fixes, "k string, fix_id long, ts_ns long")
    right = spark.createDataFrame(poses, "k string, pose_id long, ts_ns long")
    near, last = {}, {}
    for k, i, t in fixes:
        of = [(p, at) for key, p, at in poses if key == k and at is not None and t is not None]
        best = min(((abs(at - t), at, p) for p, at in of), default=(99, None, None))
        near[k, i] = best[2] if best[0] <= 60 else None
        last[k, i] = max(((at, p) for p, at in of if at <= t), default=(None, None))[1]
    got = {(r["k"], r["fix_id"]): r["matched_id"] for r in rel.nearest_in_time(left, right, "k", "ts_ns", "pose_id", 60, width).collect()}
    assert got == near
    assert {(r["k"], r["fix_id"]): r["matched_id"] for r in rel.latest_before(left, right, "k", "ts_ns", "pose_id", width).collect()} == last


def test_widths_follow_the_densest_stretch(spark):
    session = [("s", i * 5 * MS) for i in range(20_000)]
    sparse = [("s", 10**15 + i * 10**12) for i in range(1000)]
    df = spark.createDataFrame(session + sparse + [("small", 1), ("s", None)], "k string, t long")
    got = {r["width_key"]: r["bucket_width"] for r in ordered.widths(df, "k", "t", 1000).collect()}
    assert got.keys() == {"s"} and 2 * 10**9 < got["s"] < 8 * 10**9
    sizes = ordered.bucketed(df, "k", "t", got["s"]).groupBy("k", "bucket").count().collect()
    assert max(r["count"] for r in sizes) < 1700 and sum(r["count"] for r in sizes) == 21_002


def test_streams_of_a_month_pass_the_size_of_a_bucket(spark):
    """Nanoseconds of a stretch times rows of a bucket are beyond 64 bits here."""
    n = ordered.BUCKET_ROWS + 1000
    month = spark.range(n).select(F.lit("s").alias("k"), (1_700_000_000 * 10**9 + F.col("id") * 10**10).alias("t"), "id")
    [width] = ordered.widths(month, "k", "t").collect()
    assert 2 * 10**15 < width["bucket_width"] < 3 * 10**15
    got = ordered.numbered(month, "k", ["t", "id"], "n")
    assert got.where("n != id").isEmpty() and got.count() == n


def test_widths_are_sought_for_long_keys_only(spark):
    df = spark.createDataFrame([(k, i) for k in ("a", None, "b") for i in range(900 if k == "a" else 50)], "k string, n long")
    assert [r["width_key"] for r in ordered.widths(df, "k", "n", 800).collect()] == ["a"]
    plan = ordered.bucketed(df, "k", "n")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan.split("percentile_approx")[1]  # quantiles see the rows of long keys alone


MONTH = ordered.BUCKET_ROWS + 1000  # samples, ten seconds apart


@pytest.fixture(scope="module")
def month(spark, tmp_path_factory):
    """Events of one stream that is longer than a bucket; every thousandth arrives after the next one."""
    value = F.when(F.col("id") % 1000 == 999, 150_000.0).otherwise((F.col("id") % 100).cast("double"))
    ts = F.timestamp_micros(1_700_000_000 * 10**6 + F.col("id") * 10**7).cast("timestamp_ntz")
    at = str(tmp_path_factory.mktemp("month"))
    spark.range(MONTH).select(F.col("id").alias("event_id"), ts.alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("s").alias("event_type"), value.alias("value"), F.lit("{}").alias("props")).write.parquet(f"{at}/events.parquet")
    return at


def test_epoch_enrich_of_a_month(spark, month):
    got = registry.QUERIES["epoch_enrich"](spark, month)
    assert got.count() == MONTH and got.where("sats != (seq - seq % 4) % 100").isEmpty()


def test_last_warnings_of_a_month(spark, month):
    warned = [i for i in range(MONTH) if i % 1000 == 999 or i % 100 > 50]
    assert sorted(r["seq"] for r in registry.QUERIES["last_n_warnings"](spark, month).collect()) == warned[-6:]


def test_sequence_numbers_of_a_month(spark, month):
    got = registry.QUERIES["sequence_numbers"](spark, month)
    assert got.count() == MONTH and got.where("sequence != seq").isEmpty()


def test_out_of_order_of_a_month(spark, month):
    [r] = registry.QUERIES["stream_out_of_order"](spark, month).collect()
    assert (r["received"], r["out_of_order"]) == (MONTH, MONTH // 1000)


def test_rates_of_a_month(spark, month):
    got = registry.QUERIES["stream_rate64"](spark, month)
    assert got.count() == MONTH and got.where("rate_hz != if(seq = 0, 0, 0.1)").isEmpty()


def test_summary_of_a_month(spark, month):
    [r] = registry.QUERIES["stream_summary_csv"](spark, month).collect()
    assert (r["stream"], r["samples"], r["rate_hz"], r["dropped"]) == ("s", MONTH, 0.1, 0)


def test_short_keys_are_smoothed_in_one_pass(spark):
    """Across Arrow batches, bit for bit, and without a task's call for each key or a join."""
    draw = random.Random(7)
    rows = [(draw.choice(["a", "b", None, *map(str, range(40))]), i, i % 50, draw.uniform(-5, 5)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, id long, t long, v double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = ordered.smoothed(df, "k", ["t", "id"], ["v"], lambda e, v: 0.9 * e + 0.1 * v, 0.9, None)
        parts = ordered.smoothed(df, "k", ["t", "id"], ["v"], lambda e, v: 0.9 * e + 0.1 * v, 0.9, None, 5).collect()
        plan = got._jdf.queryExecution().toString()
        got = {r["id"]: r["smooth_v"] for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    states, want = {}, {}
    for k, i, _, v in sorted(rows, key=lambda r: (r[2], r[1])):
        states[k] = want[i] = 0.9 * states.get(k, v) + 0.1 * v
    assert got == want and "FlatMapGroups" not in plan and "Join" not in plan
    assert len(parts) == 900 and all(abs(r["smooth_v"] - want[r["id"]]) < 1e-12 for r in parts)

"""Every query with SQL against DuckDB, and the small known answers of single operators."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfold.functions import geo, images, vision
from wayfold.operators import folds, georef, monitor, ordered, perception, solve
from wayfold.operators import relational as rel
from wayfold.plans import details, live, registry, store, streams, trips  # noqa: F401
from wayfold.sources import clouds, exports, logs, payloads, records
from wayfold.streaming import stateful

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows, names, columns):
    at = [columns.index(n) for n in names]
    value = lambda v: "nan" if isinstance(v, float) and v != v else round(v, 4) + 0.0 if isinstance(v, float) else v
    return sorted([tuple(value(r[i]) for i in at) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in registry.ORACLES:
        assert rows
        return
    got = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(rows, sorted(columns), df.columns) == plain(got.fetchall(), sorted(columns), columns)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_haversine_of_known_arcs(spark):
    d = lambda *x: geo.haversine_m(*map(F.lit, x))
    r = one(spark, quarter=d(0.0, 0.0, 0.0, 90.0), pole=d(90.0, 10.0, 30.0, -50.0), none=d(48.2, 16.4, 48.2, 16.4))
    degree = math.pi * geo.EARTH_RADIUS_M / 180
    assert abs(r["quarter"] - 90 * degree) < 1e-3 and abs(r["pole"] - 60 * degree) < 1e-3 and r["none"] == 0


def test_enu_round_trip(spark):
    o = [F.lit(x) for x in (12.97, 77.59, 900.0)]
    e, n, u = geo.to_enu(F.lit(12.975), F.lit(77.6), F.lit(910.0), *o)
    r = one(spark, **dict(zip("abc", geo.from_enu(e, n, u, *o), strict=True)))
    assert abs(r["a"] - 12.975) < 1e-7 and abs(r["b"] - 77.6) < 1e-7


def test_wrap_angle_keeps_both_ends(spark):
    r = one(spark, a=geo.wrap_angle(F.lit(math.pi)), b=geo.wrap_angle(F.lit(-math.pi)), c=geo.wrap_angle(F.lit(3 * math.pi / 2)))
    assert (r["a"], r["b"]) == (math.pi, -math.pi) and abs(r["c"] + math.pi / 2) < 1e-12


def test_clamp_passes_nan(spark):
    r = one(spark, a=geo.clamp(F.lit(float("nan")), 0.0, 1.0), b=geo.clamp(F.lit(2.0), 0.0, 1.0))
    assert r["a"] != r["a"] and r["b"] == 1.0


def test_backprojection(spark):
    p = lambda d: vision.backproject(F.lit(100.0), F.lit(360.0), F.lit(d), 400.0, 800.0, 300.0, 200.0)
    r = one(spark, a=p(8.0), b=p(0.0), c=p(float("nan")))
    assert [round(x, 9) for x in r["a"]] == [-4.0, 1.6, 8.0] and r["b"] is None and r["c"] is None


def test_cosine_order_and_zero_vector(spark):
    df = spark.createDataFrame([(7, [3.0, 4.0]), (5, [6.0, 8.0]), (6, [-4.0, 3.0]), (8, [0.0, 0.0]), (9, [4.0, 3.0])], "vec_id long, embedding array<float>")
    got = rel.cosine_topk(df, [0.6, 0.8], 5).collect()
    assert [r["vec_id"] for r in got[:3]] == [5, 7, 9] and abs(got[2]["score"] - 0.96) < 1e-6


def test_voxel_cells_of_negative_points_differ(spark):
    r = one(spark, a=rel.voxel_key(F.lit(-0.05), F.lit(0.0), F.lit(0.0), 0.1), b=rel.voxel_key(F.lit(0.05), F.lit(0.0), F.lit(0.0), 0.1))
    assert r["a"] != r["b"]


POSE = "trip_id long, pose_id long, ts_ns long, vio_x double, vio_y double, vio_z double, qx double, qy double, qz double, qw double, state string"


def pose(number, ns, x=0.0, turned=0.0, state="TRACKING"):
    half = math.radians(turned) / 2
    return (1, number, ns, x, 0.0, 0.0, 0.0, math.sin(half), 0.0, math.cos(half), state)


def test_keyframe_gates(spark):
    ms = 10**6
    poses = [pose(1, 0), pose(2, 400 * ms, 0.1), pose(3, 800 * ms, 0.7, state="PAUSED"), pose(4, 900 * ms, 0.7), pose(5, 1000 * ms, 9.0), pose(6, 1400 * ms, 0.8, 5.0), pose(7, 1800 * ms, 0.8, 11.0), pose(8, 1900 * ms, 0.8, 90.0), pose(9, 2400 * ms, 0.8, 372.0)]
    df = spark.createDataFrame(poses, POSE)
    assert [r["pose_id"] for r in folds.keyframes(df, 250 * ms, 0.3, 8.0).orderBy("ts_ns").collect()] == [1, 4, 7]
    turn = spark.createDataFrame([pose(i, i * 300 * ms, 0.0, 9.0 * i) for i in range(4)], POSE)
    assert folds.keyframes(turn, 250 * ms, 0.3, 8.0).count() == 4 and folds.keyframes(turn, 250 * ms, 0.3, 400.0).count() == 1


def test_angle_between_orientations(spark):
    for turned, want in ((0.0, 0.0), (40.0, 40.0), (350.0, 10.0), (180.0, 180.0)):
        p, q = (pose(1, 0, 0.0, x)[6:10] for x in (20.0, 20.0 + turned))
        assert abs(one(spark, d=vision.angle_deg([F.lit(x) for x in p], [F.lit(-x) for x in q]))["d"] - want) < 1e-5


def test_capture_health(spark):
    ns = 10**8
    on_spot = spark.createDataFrame([pose(i, i * ns, 0.01 * i, 6.0 * i) for i in range(60)], POSE)
    last = folds.capture_health(on_spot).orderBy("pose_id").collect()[-1]
    assert last["turns_on_spot"] and not last["too_fast"] and abs(last["turn_dps"] - 60) < 0.1 and abs(last["speed"] - 0.1) < 1e-3
    fast = spark.createDataFrame([pose(i, i * ns, 0.9 * i) for i in range(60)] + [pose(60, 70 * ns, 500.0), pose(61, 70 * ns, 0.0)], POSE)
    rows = folds.capture_health(fast).orderBy("pose_id").collect()
    assert len(rows) == 59 and rows[-1]["too_fast"] and not rows[-1]["turns_on_spot"]


def globe(lat, lon, n, spread, draw):
    return [(i, lat + draw.uniform(-spread, spread), lon + draw.uniform(-spread, spread) / max(0.02, math.cos(math.radians(lat)))) for i in range(n)]


@pytest.mark.parametrize("place", [(85.0, 20.0), (0.0, 180.0), (-89.9995, 30.0), (60.0, -180.0), (90.0, 0.0)])
def test_radius_join_anywhere(spark, place):
    """Near the poles and across the 180th meridian the join finds what all pairs do."""
    draw = random.Random(str(place))
    wrap = lambda rows: [(i, max(-90.0, min(90.0, la)), (lo + 180) % 360 - 180) for i, la, lo in rows]
    left, right = (wrap(globe(*place, 60, 0.002, draw)) for _ in range(2))

    def apart(a, b):
        dla, dlo = math.radians(b[1] - a[1]), math.radians(b[2] - a[2])
        h = math.sin(dla / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(dlo / 2) ** 2
        return 2 * geo.EARTH_RADIUS_M * math.asin(min(1, math.sqrt(h)))

    a, b = spark.createDataFrame(left, "a long, alat double, alon double"), spark.createDataFrame(right, "b long, blat double, blon double")
    for radius in (5.0, 50.0, 400.0):
        want = sorted((x[0], y[0]) for x in left for y in right if apart(x, y) <= radius)
        got = rel.radius_join(a, b, radius, ("alat", "blat"), ("alon", "blon")).select("a", "b").collect()
        assert sorted(map(tuple, got)) == want and (want or radius < 50)


def test_running_values_of_one_hot_key_over_many_buckets(spark):
    """A key with all rows, in buckets of some rows each, against windows over the whole key."""
    from pyspark.sql import Window as W

    draw = random.Random(2)
    rows = [("s" if draw.random() < 0.9 else None, draw.randrange(4000), i, draw.random()) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, at long, seq long, value double")
    order, width = ["at", "seq"], 100
    w = W.partitionBy("k").orderBy(*order)
    same = lambda got, want: sorted(got.select("k", "at", "seq", "v").collect(), key=str) == sorted(want.select("k", "at", "seq", "v").collect(), key=str)
    assert same(ordered.numbered(df, "k", order, "v", width), df.withColumn("v", (F.row_number().over(w) - 1).cast("long")))
    assert same(ordered.with_previous(df, "k", order, "at", "v", width), df.withColumn("v", F.lag("at").over(w)))
    assert same(ordered.with_running_max(df, "k", order, "value", "v", width), df.withColumn("v", F.max("value").over(w.rowsBetween(W.unboundedPreceding, -1))))
    assert same(ordered.with_first(df, "k", order, {"v": F.col("value")}), df.withColumn("v", F.first("value").over(w)))
    assert same(ordered.with_nth_before(df, "k", order, 7, "value", "v", width), df.withColumn("v", F.first("value").over(w.rowsBetween(-7, 0))))
    last = df.withColumn("r", F.row_number().over(W.partitionBy("k").orderBy(F.desc("at"), F.desc("seq")))).where("r <= 5")
    assert same(ordered.last_rows(df, "k", order, 5, width).withColumn("v", F.lit(0)), last.withColumn("v", F.lit(0)))


SAMPLES = "stream_id string, seq long, raw_ns long, arrival_ns long"


def test_warnings_of_each_kind_are_rate_limited(spark):
    ms = 10**6
    late = [("late", i, i * 10 * ms, i * 10 * ms + (20 * ms if i else 0)) for i in range(200)]
    slow = [("slow", i, i * 10 * ms, i * 10 * ms + i * 20_000) for i in range(600)]
    odd = [("odd", i, (i - 5 * (i % 2)) * 10 * ms, i * 10 * ms) for i in range(100)]
    got = monitor.warnings(spark.createDataFrame(late + slow + odd, SAMPLES), 5 * ms, 8 * ms).collect()
    by = lambda stream, kind: sorted(r["seq"] for r in got if r["stream_id"] == stream and r[kind])
    assert by("late", "late") == [1, 65, 129, 193]
    assert all(b - a >= 64 for a, b in zip(by("slow", "drifts"), by("slow", "drifts")[1:])) and by("slow", "drifts")
    assert not by("odd", "late")  # samples out of order are not asked


def test_watch_goes_on_after_a_restart(spark, tmp_path):
    source, folder = f"{tmp_path}/in", f"file://{tmp_path}/monitor"
    rows = [("a", i, i * 10, i * 10 + 1) for i in range(50)]
    spark.createDataFrame(rows[:20], SAMPLES).write.parquet(f"{source}/one")
    live = lambda: spark.readStream.schema(SAMPLES).option("recursiveFileLookup", "true").parquet(source)
    first = stateful.watch(live(), folder, 10).collect()
    assert stateful.watch(live(), folder, 10).collect() == first and first[0]["received"] == 20
    for k in range(3):
        spark.createDataFrame(rows[20 + 10 * k : 30 + 10 * k], SAMPLES).write.parquet(f"{source}/more{k}")
        assert stateful.watch(live(), folder, 10).collect()[0]["received"] == 30 + 10 * k


def test_suppression(spark):
    boxes = [(9, 40.0, 20.0, 80.0, 60.0, 0.3, "x"), (8, 42.0, 20.0, 82.0, 60.0, 0.7, "x"), (7, 60.0, 20.0, 100.0, 60.0, 0.5, "x"), (6, 42.0, 20.0, 82.0, 60.0, 0.1, "y")]
    df = spark.createDataFrame([(*b, 1) for b in boxes], "id long, left_px double, top_px double, right_px double, bottom_px double, score double, class string, frame_id long")
    assert sorted(r["id"] for r in folds.suppress(df).collect()) == [6, 7, 8]


def test_suppression_over_batches_is_that_of_one_by_one(spark):
    draw = random.Random(13)
    rows = [(i, draw.choice([1, 2]), draw.choice("ab"), draw.random() * 50, draw.random() * 50, 60 + draw.random() * 40, 60 + draw.random() * 40, draw.choice([0.5, draw.random()])) for i in range(400)]
    df = spark.createDataFrame([*rows, (999, 1, "a", None, 0.0, 1.0, 1.0, 0.9)], "id long, frame_id long, class string, left_px double, top_px double, right_px double, bottom_px double, score double")
    kept: dict = {}
    want = []
    for r in sorted(rows, key=lambda r: (r[1], r[2], -r[7], r[0])):
        box, f = np.array(r[3:7], np.float32), np.float32
        for o in kept.setdefault((r[1], r[2]), []):
            w, h = max(f(0), min(box[2], o[2]) - max(box[0], o[0])), max(f(0), min(box[3], o[3]) - max(box[1], o[1]))
            if w * h / ((box[2] - box[0]) * (box[3] - box[1]) + (o[2] - o[0]) * (o[3] - o[1]) - w * h) > f(0.7):
                break
        else:
            kept[r[1], r[2]].append(box)
            want.append(r[0])
    for most in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        assert sorted(r["id"] for r in folds.suppress(df, 0.7).collect()) == sorted(want)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


DETECTED = "trip_id long, ts_ns long, id long, x double, y double, z double, asset_class string, confidence double, depth_m double, frame_id long, semantic_label string"


def seen(number, x, kind="SIGN", confidence=0.5, depth=4.0, label=None, y=0.0):
    return (1, number, number, x, y, 0.0, kind, confidence, depth, 100 + number, label)


def track(spark, rows, merge=3.0):
    return [r.asDict() for r in folds.track_assets(spark.createDataFrame(rows, DETECTED), merge).orderBy("id").collect()]


def test_tracker_merges_near_and_splits_far(spark):
    got = track(spark, [seen(1, 0.0), seen(2, 1.0), seen(3, 10.0), seen(4, 0.5)])
    assert [(r["track_id"], r["is_new"], r["observations"]) for r in got] == [(1, True, 1), (1, False, 2), (2, True, 1), (1, False, 3)]
    assert got[3]["x"] == 0.5 and got[3]["last_frame_id"] == 104


def test_tracker_statistics(spark):
    got = track(spark, [seen(1, 0.0, "POLE", 0.3, 2.0, "ROAD"), seen(2, 2.0, "SIGN", 0.7, 6.0, None), seen(3, 1.0, "POLE", 0.5, 7.0, "SKY"), seen(4, 1.0, "POLE", 0.1, 1.0, "SKY")])
    assert got[0]["position_std_m"] is None and got[0]["semantic_label"] == "ROAD"
    assert (got[1]["asset_class"], got[2]["asset_class"]) == ("SIGN", "POLE")
    assert got[1]["position_std_m"] == math.sqrt(2 / 3) and abs(got[2]["position_std_m"] - math.sqrt(2 / 6)) < 1e-12
    assert got[3]["max_confidence"] == 0.7 and got[3]["depth_avg_m"] == 4.0 and got[3]["semantic_label"] == "SKY"
    last = folds.landmarks(folds.track_assets(spark.createDataFrame([seen(1, 0.0), seen(2, 1.0), seen(3, 9.0)], DETECTED))).collect()
    assert sorted((r["track_id"], r["observations"]) for r in last) == [(1, 2), (2, 1)]


def test_tracker_against_a_search_of_all_landmarks(spark):
    draw = random.Random(11)
    rows = [seen(i, draw.uniform(-30, 30), y=draw.uniform(-30, 30)) for i in range(300)] + [seen(300, math.nan)]
    means, counts, want = [], [], []
    for r in rows[:300]:
        p = r[3:6]
        best = min(range(len(means)), key=lambda i: math.dist(means[i], p), default=None)
        if best is None or math.dist(means[best], p) > 4.0:
            best = len(means)
            means.append(list(p))
            counts.append(1)
        else:
            counts[best] += 1
            means[best] = [m + (x - m) / counts[best] for m, x in zip(means[best], p, strict=True)]
        want.append(best + 1)
    assert [r["track_id"] for r in track(spark, rows, 4.0)] == want


def test_similarity_is_recovered(spark):
    import numpy as np

    draw = np.random.default_rng(1)
    axis = np.array([0.3, 1.0, -0.5]) / np.linalg.norm([0.3, 1.0, -0.5])
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    rotation = np.eye(3) + np.sin(0.7) * k + (1 - np.cos(0.7)) * k @ k
    source = draw.normal(size=(12, 3))
    target = 2.5 * source @ rotation.T + np.array([10.0, -4.0, 3.0])
    rows = [(1, *map(float, s), *map(float, t)) for s, t in zip(source, target, strict=True)] + [(2, *[1.0] * 6)] * 5
    df = spark.createDataFrame(rows, "trip_id long, a double, b double, c double, d double, e double, f double")
    (r,) = solve.similarity_solve(df, "trip_id", ("a", "b", "c"), ("d", "e", "f")).collect()
    assert r["trip_id"] == 1 and abs(r["scale"] - 2.5) < 1e-6 and r["rms"] < 1e-5
    assert np.allclose(np.array(r["rotation"]).reshape(3, 3), rotation, atol=1e-6) and np.allclose(r["translation"], [10, -4, 3], atol=1e-6)


def test_similarity_far_from_the_origin(spark):
    draw = np.random.default_rng(2)
    source = draw.normal(size=(50, 3)) + 6e6
    target = 2.0 * (source - 6e6) + np.array([-5e6, 6e6, 1e6])
    df = spark.createDataFrame([(1, *map(float, s), *map(float, t)) for s, t in zip(source, target, strict=True)] + [(1, None, *[0.0] * 5)], "trip_id long, a double, b double, c double, d double, e double, f double")
    (r,) = solve.similarity_solve(df.repartition(3), "trip_id", ("a", "b", "c"), ("d", "e", "f")).collect()
    assert abs(r["scale"] - 2) < 1e-7 and r["rms"] < 1e-4 and r["n"] == 50


def test_crc_of_texts(spark):
    import zlib

    got = {r["doc_id"]: r["crc"] for r in registry.QUERIES["crc32_text"](spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got == {i: zlib.crc32(x.encode()) if x is not None else None for i, x in texts.items()}


LAYOUTS = ["compact", "indented", "foreign", "array", "many"]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_features_of_any_layout(layout, tmp_path, spark):
    import json

    lines = [[[10.5, 50.25, 3], [11, 51]], [[-1e-3, 2.5], [7, -8.0], [9, 9]]]
    features = [{"type": "Feature", "properties": {"a": 'x\\" } [ {', "features": [1]}, "geometry": {"type": "LineString", "coordinates": x}} for x in lines]
    whole = {"type": "FeatureCollection", "features": features}
    foreign = {"bbox": [[1], {"features": [{}]}], "name": "features", "features": [{"geometry": {"coordinates": lines, "type": "MultiLineString"}, "id": "é\"", "type": "Feature"}], "z": {"a": []}}
    text = {"compact": json.dumps(whole, separators=(",", ":")), "indented": json.dumps(whole, indent=3), "foreign": json.dumps(foreign, ensure_ascii=False), "array": json.dumps(features), "many": "\n".join(json.dumps(f["geometry"]) for f in features)}[layout]
    for size in (1, 7, 1 << 20):
        scanner, found = exports.FeatureScanner(), []
        data = text.encode()
        for at in range(0, len(data), size):
            found += scanner.feed(data[at : at + size])
        scanner.end()
        assert len(found) == (1 if layout == "foreign" else 2) and all(json.loads(x)["type"] == "Feature" for x in found)
    (tmp_path / "d.json").write_text(text)
    files = spark.createDataFrame([(f"file://{tmp_path}/d.json", 4)], "path string, trip_id long")
    points = exports.parse_geojson(exports.read_collections(files, "trip_id"), "trip_id").collect()
    assert sorted((r["lon"], r["lat"], r["alt"]) for r in points) == sorted((float(p[0]), float(p[1]), float(p[2]) if len(p) > 2 else 0.0) for x in lines for p in x)


def test_documents_that_are_cut_off_are_refused():
    for text in (b'{"features":[{"a":1}', b'{"features":[{"a":"', b"}"):
        with pytest.raises(ValueError):
            scanner = exports.FeatureScanner()
            list(scanner.feed(text))
            scanner.end()
    scanner = exports.FeatureScanner()
    assert list(scanner.feed(b"")) == []
    scanner.end()


def test_hull_of_a_square_with_inner_points():
    draw = random.Random(1)
    inner = [(draw.random() * 100, draw.random() * 100) for _ in range(200)]
    assert solve.area(solve.hull([(0, 0), (100, 0), (100, 100), (0, 100), (50, 0), *inner])) == 10_000
    assert solve.area(solve.hull([(0, 0), (1, 1), (2, 2)])) == 0


def test_nearest_in_time_prefers_the_nearer_and_earlier(spark):
    left = spark.createDataFrame([(1, 10, 100), (1, 11, 200), (1, 12, 900), (2, 13, 100)], "trip_id long, fix_id long, ts_ns long")
    right = spark.createDataFrame([(1, 1, 90), (1, 2, 110), (1, 3, 200), (1, 4, 200)], "trip_id long, pose_id long, ts_ns long")
    got = {r["fix_id"]: r["matched_id"] for r in rel.nearest_in_time(left, right, "trip_id", "ts_ns", "pose_id", 50).collect()}
    assert got == {10: 1, 11: 3, 12: None, 13: None}


def test_truncated_log_reads_its_whole_chunks(spark, tmp_path):
    path = str(tmp_path / "a.mcap")
    with open(path, "wb") as out:
        w = logs.LogWriter(out, 1024)
        for i in range(500):
            w.message("/imu", i, i, b"x" * 20)
        w.finish()
    whole = open(path, "rb").read()
    files = spark.createDataFrame([(f"file://{path}",)], "path string")
    chunks = logs.list_chunks(files)
    assert logs.read_chunks(chunks).count() == 500 and logs.read_chunks(chunks).where("chunk_crc_ok").count() == 500
    assert logs.read_chunks(logs.in_time(chunks, 100, 120)).count() < 200
    last = chunks.orderBy(F.col("body_at").desc()).first()
    open(path, "wb").write(whole[: last["body_at"] + 10])
    assert 400 < logs.read_chunks(logs.list_chunks(files)).count() < 500
    first, hurt = chunks.orderBy("body_at").first(), bytearray(whole)
    hurt[first["body_at"] + first["length"] - 1] ^= 1
    open(path, "wb").write(hurt)
    bad = logs.read_chunks(logs.list_chunks(files))
    assert bad.count() == 500 and 0 < bad.where("not chunk_crc_ok").count() < 500


def write_log(path, n, size=1024, cut=None):
    with open(path, "wb") as out:
        w = logs.LogWriter(out, size)
        for i in range(n):
            w.message(f"/topic/{i % 2}", i, i + 1, b"x" * 20)
        w.finish()
    raw = open(path, "rb").read()
    if cut is not None:
        open(path, "wb").write(raw[:cut])
    return raw


def test_recovery_of_all_logs_in_a_folder(spark, tmp_path):
    whole = write_log(f"{tmp_path}/whole.mcap", 300)
    torn = write_log(f"{tmp_path}/torn.mcap", 300, cut=len(whole) // 2)[: len(whole) // 2]
    open(f"{tmp_path}/short.mcap", "wb").write(b"\x89MC")
    open(f"{tmp_path}/other.mcap", "wb").write(b"something else altogether")
    said = logs.recover(logs.log_files(spark, f"file://{tmp_path}"), f"file://{tmp_path}/recovered").collect()
    by = {r["path"].rpartition("/")[2]: r for r in said}
    assert {k: r["outcome"] for k, r in by.items()} == {"whole.mcap": "valid", "torn.mcap": "recovered", "short.mcap": "failed", "other.mcap": "failed"}
    assert open(f"{tmp_path}/torn.mcap", "rb").read() == torn and open(f"{tmp_path}/whole.mcap", "rb").read() == whole
    got = logs.read_chunks(logs.list_chunks(spark.createDataFrame([(by["torn.mcap"]["recovered"],)], "path string")))
    seen = sorted((r["log_time_ns"], r["topic"], r["publish_time_ns"]) for r in got.collect())
    assert 100 < by["torn.mcap"]["messages"] == len(seen) < 200 and seen == [(i, f"/topic/{i % 2}", i + 1) for i in range(len(seen))]
    again = spark.createDataFrame([(by["torn.mcap"]["recovered"],)], "path string")
    assert logs.recover(again, f"file://{tmp_path}/recovered").first()["outcome"] == "valid"


def test_logs_roll_over_by_size_and_time(spark, tmp_path):
    rows = [(7, "/imu", i * 100, i * 100, bytearray(b"x" * 50)) for i in range(400)]
    df = spark.createDataFrame(rows, "trip_id long, topic string, log_time_ns long, publish_time_ns long, data binary")
    files = logs.write_logs(df, f"file://{tmp_path}/logs", 500, segment_bytes=4000, segment_ns=20_000).cache()
    segments = files.orderBy("start_ns").collect()
    assert len(segments) > 8 and sum(r["n_messages"] for r in segments) == 400
    assert all(a["end_ns"] < b["start_ns"] and a["start_ns"] // 20_000 == a["end_ns"] // 20_000 for a, b in zip(segments, segments[1:]))
    assert logs.read_chunks(logs.list_chunks(files)).where("chunk_crc_ok").count() == 400


def test_summary_of_a_log(tmp_path):
    import struct
    import zlib

    raw = write_log(f"{tmp_path}/a.mcap", 50)
    summary, offsets, crc = struct.unpack("<QQI", raw[-28:-8])
    assert zlib.crc32(raw[summary:-12]) == crc
    groups, at = [], offsets
    while raw[at] == logs.SUMMARY_OFFSET:
        groups.append(struct.unpack_from("<BQQ", raw, at + 9))
        at += 9 + 17
    assert [g[0] for g in groups] == [logs.SCHEMA, logs.CHANNEL, logs.STATISTICS, logs.CHUNK_INDEX]
    assert all(raw[start] == op for op, start, _ in groups) and sum(g[2] for g in groups) == offsets - summary


def test_compressed_chunks_are_refused():
    import struct

    with pytest.raises(ValueError, match="lz4"):
        logs.parse_chunk(struct.pack("<QQQII", 0, 0, 5, 0, 3) + b"lz4" + struct.pack("<Q", 2) + b"ab")


def test_documents_of_features(spark, tmp_path):
    import json

    points = spark.createDataFrame([(1, i, 10.0 + i, 20.0 + i, 0.0, float(3 * i), float(4 * i)) for i in range(8)] + [(2, 0, 0.0, 0.0, 0.0, 0.0, 0.0)], "trip_id long, ts_ns long, lat double, lon double, alt double, east double, north double")
    lines = exports.geojson_lines(points, "trip_id", "ts_ns", most=3)
    files = exports.write_collections(lines, "trip_id", ["part"], f"file://{tmp_path}/docs").collect()
    assert [(r["trip_id"], r["n_features"]) for r in files] == [(1, 3)]
    doc = json.load(open(files[0]["path"].removeprefix("file://")))
    assert [(f["properties"]["points"], f["properties"]["length_m"]) for f in doc["features"]] == [(4, 15.0), (4, 15.0), (2, 5.0)]
    assert [f["geometry"]["coordinates"][0][1] for f in doc["features"]] == [10.0, 13.0, 16.0]
    got = exports.parse_geojson(lines, "trip_id", most=3).orderBy("n").collect()
    assert [(r["n"], r["lat"]) for r in got] == [(i, 10.0 + i) for i in range(8)]


def test_payloads_of_every_topic(spark):
    """Messages with some of everything are read back as they were."""

    def some(kind, k):
        if isinstance(kind, tuple):
            return [message(kind[0], k + i) for i in range(3)]
        if isinstance(kind, list):
            return message(kind, k)
        return {"long": -k, "int": k, "bool": k % 2 == 0, "double": k / 3, "float": k / 4, "string": f"é{k}", "counts": {"a": k, "b": -k}}[kind]

    def message(fields, k):
        return {name: some(kind, k + number) for number, name, kind in fields}

    for topic, fields in payloads.MESSAGES.items():
        want = message(fields, 5)
        assert payloads.decode(payloads.encode(want, fields), fields) == want, topic
    for topic in ("/assets", "/calibration"):
        df = spark.createDataFrame([(1, message(payloads.MESSAGES[topic], 3)), (2, None)], payloads.T.StructType([payloads.T.StructField("k", payloads.T.LongType()), payloads.T.StructField("message", payloads.schema_of(payloads.MESSAGES[topic]))]))
        back = payloads.decode_payloads(payloads.encode_payloads(df, topic), topic)
        assert sorted(back.collect()) == sorted(df.collect())


def test_reports_of_a_sensor(spark):
    report = np.zeros(3, records.REPORT)
    report["size"], report["counter"], report["timestamp_ns"], report["y"] = 104, [4_294_967_295, 0, 3], [-5, 6, 7], 1.5
    df = spark.createDataFrame([(1, bytearray(report.tobytes() + b"rest")), (2, None), (3, bytearray(b"x"))], "k long, data binary")
    got = [(r["k"], r["slot"], r["size"], r["counter"], r["timestamp_ns"], r["y"]) for r in records.decode_reports(df).orderBy("slot").collect()]
    assert got == [(1, 0, 104, 4_294_967_295, -5, 1.5), (1, 2, 104, 3, 7, 1.5)]


def test_shedding_follows_the_policy(spark):
    rows = [("s", i, i * 100_000_000, (10 if i < 10 else 0 if i < 20 else 2)) for i in range(31)]
    got = folds.shed(spark.createDataFrame(rows, "stream_id string, seq long, raw_ns long, hz int")).orderBy("seq").collect()
    assert [r["seq"] for r in got] == [*range(10), 20, 25, 30]


def test_detections_become_assets(spark):
    """A camera at the origin that looks along z, then turned; one detection each without depth, pose and transform."""
    box = lambda x: (x - 5.0, 45.0, x + 5.0, 55.0)
    rows = [(1, 10, 1, 1, *box(50.0), "POLE", 0.5), (1, 20, 2, 2, *box(50.0), "SIGN", 0.9), (1, 30, 3, 3, *box(90.0), "POLE", 0.5), (1, 1, 4, 1, *box(50.0), "POLE", 0.5), (2, 10, 5, 1, *box(50.0), "POLE", 0.5), (1, 40, 6, 99, *box(50.0), "POLE", 0.5)]
    detections = spark.createDataFrame(rows, "trip_id long, ts_ns long, id long, frame_id long, left_px double, top_px double, right_px double, bottom_px double, asset_class string, confidence double")
    frames = spark.createDataFrame([(1, 100, 100, [4.0], ["ROAD"]), (2, 100, 100, [5.0], ["ROAD"]), (3, 100, 100, [float("nan")], ["SKY"])], "frame_id long, width int, height int, depth array<float>, labels array<string>")
    poses = spark.createDataFrame([pose(1, 5), (2, 9, 5, *pose(1, 5)[3:])], POSE)
    transforms = spark.createDataFrame([(1, 5, 8, 2.0, [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, -1.0, 0.0], [0.0, 10.0, 0.0])], "trip_id long, ts_ns long, transform_id long, scale double, rotation array<double>, translation array<double>")
    placed = perception.place(detections, frames, poses, transforms, (1, 1), (100.0, 100.0), (50.0, 50.0))
    assert {r["id"]: r["reason"] for r in placed.collect()} == {1: "kept", 2: "kept", 3: "no_depth", 4: "no_pose", 5: "no_transform", 6: "no_depth"}
    origins = spark.createDataFrame([(1, 12.97, 77.59, 900.0)], "trip_id long, lat0 double, lon0 double, alt0 double")
    got = perception.extract_assets(placed, transforms, origins).orderBy("id").collect()
    assert [(r["track_id"], r["observations"], r["z"], r["semantic_label"]) for r in got] == [(1, 1, 4.0, "ROAD"), (1, 2, 4.5, "ROAD")]
    north = (got[1]["lat"] - 12.97) * 110_574
    assert abs(north - 19.0) < 0.2 and abs(got[1]["lon"] - 77.59) < 1e-9 and got[1]["asset_class"] == "SIGN"


def test_stored_tables(spark):
    jobs = spark.createDataFrame([(1, "a", 5), (4, "b", None)], "id long, state string, n int")
    added = rel.insert(jobs, spark.createDataFrame([(None, "c"), (9, "d"), (None, "e")], "id long, state string"), "id")
    assert sorted(map(tuple, added.collect())) == [(1, "a", 5), (4, "b", None), (5, "c", None), (6, "e", None), (9, "d", None)]
    changed = rel.update(added, F.col("n") > 3, {"state": F.lit("x"), "n": F.col("n") + 1})
    assert sorted(map(tuple, changed.collect()))[0] == (1, "x", 6) and changed.schema == added.schema
    assert sorted(r["id"] for r in rel.delete(added, F.col("n") > 3).collect()) == [4, 5, 6, 9]
    assert rel.migrate(jobs, "id long, note string").orderBy("id").collect() == [(1, None), (4, None)]


def test_geojson_round_trip_and_nan_altitude(spark):
    df = spark.createDataFrame([(1, 1, 10.0, 20.0, float("nan")), (1, 2, 11.0, 21.0, 5.0), (2, 1, 0.0, 0.0, 0.0)], "trip_id long, ts_ns long, lat double, lon double, alt double")
    got = [tuple(r) for r in exports.parse_geojson(exports.geojson_lines(df, "trip_id", "ts_ns"), "trip_id").orderBy("n").collect()]
    assert got == [(1, 0, 20.0, 10.0, 0.0), (1, 1, 21.0, 11.0, 5.0)]


def bend(n=21):
    """A walk of 10 m one way and 10 m the other: the true places, and what odometry saw (turned, and drifting)."""
    true = [(0.5 * i * 2, 0.0) if i <= n // 2 else (10.0, (i - n // 2) * 1.0) for i in range(n)]
    return [(1, i, i * 10**9, x + 0.05 * i, 0.0, -y) for i, (x, y) in enumerate(true)], true


def test_refinement_pulls_a_drifting_walk_to_its_fixes(spark):
    poses, true = bend()
    df = spark.createDataFrame(poses, "trip_id long, pose_id long, ts_ns long, vio_x double, vio_y double, vio_z double")
    origin = [F.lit(x) for x in (12.97, 77.59, 900.0)]
    fixes = spark.createDataFrame([(1, i, i * 10**9, *true[i], 1.0) for i in (0, 5, 10, 15, 20)], "trip_id long, fix_id long, ts_ns long, e double, n double, h_acc_m double")
    lat, lon, alt = geo.from_enu(F.col("e"), F.col("n"), F.lit(0.0), *origin)
    fixes = fixes.select("trip_id", "fix_id", "ts_ns", lat.alias("lat"), lon.alias("lon"), alt.alias("alt"), "h_acc_m")
    check = lambda: {r["pose_id"]: (r["east"], r["north"]) for r in georef.refine(df, fixes).collect()}
    whole = check()
    assert len(whole) == 21 and max(math.dist(whole[i], true[i]) for i in whole) < 0.6
    assert not georef.refine(df, fixes.where("fix_id = 0")).collect()


def test_chain_optimum_is_exact_without_noise():
    import numpy as np

    true = np.array([(i, 0.0, 0.0) for i in range(11)] + [(10.0, i, math.pi / 2) for i in range(1, 11)], float)
    heading = np.concatenate([np.zeros(10), np.full(11, math.pi / 2)])
    steps = np.stack([np.ones(20), np.zeros(20), np.diff(heading)], axis=1)
    start = np.column_stack([true[:, 0] + 0.5 * np.arange(21), true[:, 1], heading])
    anchors = np.zeros((21, 3))
    for i in (0, 5, 10, 15, 20):
        anchors[i] = (1.0, *true[i, :2])
    assert np.abs(georef.optimise(start, steps, anchors)[:, :2] - true[:, :2]).max() < 0.2


def test_chains_solved_together_are_each_solved_alone(monkeypatch):
    """To the same bits, whatever their lengths, and in as many steps as the longest needs, not all together."""
    draw, chains = np.random.default_rng(3), []
    for n in [3, 40, 7, 40, 3, 25] * 5:
        course = np.cumsum(draw.normal(0, 0.3, n))
        true = np.cumsum(np.stack([np.cos(course), np.sin(course)], axis=1), axis=0)
        steps = np.column_stack([np.hypot(*np.diff(true, axis=0).T), np.zeros(n - 1), np.diff(course)])
        chains.append((np.column_stack([true + draw.normal(0, 1, (n, 2)), course]), steps, np.column_stack([draw.random(n) * (np.arange(n) % 3 == 0), true])))
    alone = [georef.optimise(*c) for c in chains]
    calls, solve_ = [], np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda *a: calls.append(1) or solve_(*a))
    together = georef.optimise_chains(chains)
    assert all((a == b).all() for a, b in zip(alone, together, strict=True))
    assert len(calls) <= 2 * 40 * georef.ROUNDS < sum(len(c[0]) for c in chains) * georef.ROUNDS


@pytest.mark.parametrize("width_ns", [None, 40])
def test_nearest_in_time_brings_columns_of_the_right_row(spark, width_ns):
    left = spark.createDataFrame([(1, i, 7 * i) for i in range(30)] + [(2, 99, 5), (1, 98, None)], "trip_id long, fix_id long, ts_ns long")
    right = spark.createDataFrame([(1, i, 13 * i + i % 2, float(i), None if i % 3 else i) for i in range(15)], "trip_id long, pose_id long, ts_ns long, x double, y int")
    got = rel.nearest_in_time(left, right, "trip_id", "ts_ns", "pose_id", 5, width_ns, also=["x", "y"])
    plain = rel.nearest_in_time(left, right, "trip_id", "ts_ns", "pose_id", 5, width_ns)
    rows = got.collect()
    assert sorted(map(tuple, plain.collect()), key=str) == sorted((tuple(r)[:5] for r in rows), key=str) and len(rows) == 32
    assert all(r["x"] == r["matched_id"] and r["y"] == (None if r["matched_id"] is None or r["matched_id"] % 3 else r["matched_id"]) for r in rows)
    assert 0 < sum(r["matched_id"] is None for r in rows) < 30
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString()  # takes the square of a trip's rows


def online_events(late_ns, vps_at=None):
    rows = []
    for i in range(200):
        at = i * 10_000_000
        x, z = (i * 0.1, 0.0) if i < 100 else (10.0, -(i - 100) * 0.1)
        rows.append((1, at, "pose", i, at, x, 0.0, z, True, None))
        if i % 10 == 0:
            rows.append((1, at + late_ns, "fix", i, at, x + 3.0, -z - 2.0, 0.0, False, None))
    if vps_at is not None:
        pairs = [[0.0, 0.0, 0.0, 50.0, 0.0, 0.0], [1.0, 0.0, 0.0, 51.0, 0.0, 0.0], [0.0, 0.0, -1.0, 50.0, 1.0, 0.0], [0.0, 1.0, 0.0, 50.0, 0.0, 1.0]]
        rows.append((1, vps_at, "vps", 0, vps_at, None, None, None, False, pairs))
    return rows


@pytest.mark.parametrize("late_ns", [0, 300_000_000, -300_000_000])
def test_online_alignment_with_late_and_early_fixes(spark, late_ns):
    schema = "trip_id long, at_ns long, kind string, id long, ts_ns long, a double, b double, c double, tracking boolean, pairs array<array<double>>"
    got = georef.online(spark.createDataFrame(online_events(late_ns), schema)).orderBy("pose_id").collect()
    last = got[-1]
    # An early fix is paired as soon as a pose is within 100 ms, which at this speed is up to 1 m away.
    assert last["pose_id"] == 199 and math.dist((last["east"], last["north"], last["up"]), (13.0, 7.9, 0.0)) < (1.0 if late_ns < 0 else 0.2)
    vps = georef.online(spark.createDataFrame(online_events(late_ns, 1_000_000_000), schema)).orderBy("pose_id").collect()
    assert math.dist((vps[-1]["east"], vps[-1]["north"]), (60.0, 9.9)) < 0.01 and vps[-1]["transform_id"] == vps[110]["transform_id"]


@pytest.mark.parametrize("rows_of_batch", [37, 500, 10_000])
def test_places_solved_together_are_those_of_one_aligner(monkeypatch, rows_of_batch):
    """To the same bits, wherever batches end, with anchor sets, fits that are refused and fixes that are not finite."""
    draw, names, rows = random.Random(5), ["trip_id", "at_ns", "kind", "id", "ts_ns", "a", "b", "c", "tracking", "pairs"], []
    for trip in range(30):
        for r in online_events([0, 30_000_000, -30_000_000][trip % 3], 1_500_000_000 if trip % 7 == 3 else None):
            wild = 60.0 if trip % 5 == 4 else 0.5
            place = [None if x is None else x + draw.gauss(0, wild) for x in r[5:8]]
            if trip % 11 == 10 and r[2] == "fix" and r[3] == 190:
                place[1] = math.nan
            rows.append((trip, *r[1:5], *place, *r[8:]))
    rows.sort(key=lambda r: r[:4])
    want, aligner = [], None
    for i, r in enumerate(rows):
        if not i or rows[i - 1][0] != r[0]:
            aligner = georef.Aligner()
        want.append(aligner.take(dict(zip(names, r, strict=True))))
    calls, svd = [], np.linalg.svd
    monkeypatch.setattr(np.linalg, "svd", lambda *a: calls.append(1) or svd(*a))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.list_(pa.list_(pa.float64()))]
    table = pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    got = pa.Table.from_batches(georef.place_together(iter(table.to_batches(rows_of_batch)))).to_pylist()
    assert got == [w for w in want if w is not None] and 0 < len(got) < 6000
    if rows_of_batch == 10_000:
        assert len(calls) < 40 < sum(r[2] == "fix" for r in rows)


@pytest.mark.parametrize("text", [False, True])
@pytest.mark.parametrize("kind", ["ply", "pcd"])
def test_clouds(spark, tmp_path, kind, text):
    rows = [(1.0, 2.0, 3.0, 0.9), (-4.5, 5.5, -6.5, 0.4), (0.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "x double, y double, z double, confidence double").coalesce(1)
    files = clouds.write_clouds(df, f"file://{tmp_path}/{kind}", kind, most=2, text=text).cache()
    assert sorted(r["n_points"] for r in files.collect()) == [1, 2]
    assert sorted(tuple(round(x, 5) for x in r) for r in clouds.read_clouds(files).collect()) == sorted(rows)
    assert clouds.parse(clouds.header(kind, 5) + b"\0" * 40).shape == (2, 4)
    assert clouds.parse(clouds.header(kind, 5, True) + b"1 2 3 .5\n1 2 3 .5\n1 2").shape == (2, 4)


def test_monitor_batches_give_what_one_batch_gives(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, i * 10_000_000 + rng.randrange(-3, 3) * 6_000_000 + (i > 300) * 10**9, i * 10_000_000 + rng.randrange(4_000_000)) for i in range(600)]
    schema = "stream_id string, seq long, raw_ns long, arrival_ns long"
    none = spark.createDataFrame([], monitor.STATE)
    whole = monitor.advance(spark.createDataFrame(rows, schema), none, 10_000_000)
    first = monitor.advance(spark.createDataFrame(rows[:250], schema), none, 10_000_000)
    both = monitor.advance(spark.createDataFrame(rows[250:], schema), first, 10_000_000)
    assert sorted(whole.collect()) == sorted(both.collect())
    assert sorted(monitor.advance(spark.createDataFrame([], schema), first, 1).collect()) == sorted(first.collect())
    assert all(r["out_of_order"] and r["gaps"] and r["base_ns"] is not None and len(r["recent"]) == 64 for r in whole.collect())


def test_monitor_of_known_streams():
    steady = monitor.State("s")
    for i in range(100):
        steady.take(i * 10_000_000, i * 10_000_000, 10_000_000)
    assert (steady.received, steady.gaps, steady.drift_ns, steady.offset_ns) == (100, 0, 0, 0)
    steady.take(1_090_000_000, 1_090_000_000, 10_000_000)
    assert (steady.gaps, steady.dropped) == (1, 9)
    drifting = monitor.State("d")
    for i in range(1000):
        drifting.take(i * 10_000_000, i * 10_020_000, 10_000_000)
    assert drifting.drift_ns > 5_000_000
    late = monitor.State("o")
    for raw in (1_000_000_000, 1_010_000_000, 1_005_000_000):
        late.take(raw, raw, 10_000_000)
    assert (late.out_of_order, late.last_ns) == (1, 1_010_000_000)
    shifted = monitor.State("b")
    shifted.take(500_000_000, 1_500_000_000, 0)
    assert shifted.offset_ns == 10**9


def test_payloads_in_their_binary_form():
    assert payloads.encode({"timestamp_ns": 300, "x": 1.0, "accuracy": -1}, payloads.INERTIAL) == b"\x08\xac\x02\x15\x00\x00\x80\x3f\x28" + b"\xff" * 9 + b"\x01"
    assert payloads.encode({"timestamp_ns": 0, "type": "", "payload": None}, payloads.EVENT) == b""
    for row in ({"timestamp_ns": -5, "type": "\u00e9\u4e2d", "payload": "x" * 300}, {"timestamp_ns": 2**63 - 1, "type": "", "payload": ""}):
        assert payloads.decode(payloads.encode(row, payloads.EVENT), payloads.EVENT) == row
    pose = {"timestamp_ns": 1, "position": {"x": 0.0, "y": -0.0, "z": 2.5}, "orientation": None, "tracking_state": "PAUSED", "confidence": 0.5}
    assert payloads.decode(payloads.encode(pose, payloads.POSE), payloads.POSE) == pose
    assert payloads.decode(b"\xa2\x06\x01x" + payloads.encode(pose, payloads.POSE), payloads.POSE) == pose
    with pytest.raises(ValueError):
        payloads.decode(payloads.encode({"timestamp_ns": 1, "type": "abc"}, payloads.EVENT)[:-1], payloads.EVENT)


def test_payloads_of_null_messages(spark):
    rows = spark.sql("select 1 as k, named_struct('timestamp_ns', 7L, 'type', 'a') as message union all select 2, null")
    back = payloads.decode_payloads(payloads.encode_payloads(rows, "/events"), "/events")
    assert sorted((r["k"], r["message"] and r["message"]["type"]) for r in back.collect()) == [(1, "a"), (2, None)]


def test_head_of_one_object(spark):
    head = [0.0] * (84 * 20)
    for channel, value in ((0, 0.5), (1, 0.5), (2, 0.2), (3, 0.4), (4 + 9, 0.9)):
        head[channel * 20 + 7] = value
    found = spark.createDataFrame([(head,)], "head array<float>").select(F.inline(images.decode_head(F.col("head"), 20, 80, 640, 0.35))).collect()
    assert [(r["anchor"], r["class"]) for r in found] == [(7, 9)]
    assert [round(found[0][c]) for c in ("left_px", "top_px", "right_px", "bottom_px")] == [256, 192, 384, 448]


def test_frames(spark):
    frame = np.arange(2 * 4 * 3, dtype=np.uint8).reshape(2, 4, 3)
    boxed = images.letterbox(frame, 8)
    assert boxed.shape == (8, 8, 3) and np.allclose(boxed[0], images.GREY) and np.allclose(boxed[7], images.GREY)
    assert np.allclose(boxed[2:6, ::2] * 255, frame[[0, 0, 1, 1]]) and np.allclose(boxed[2:6, 1::2] * 255, frame[[0, 0, 1, 1]])
    assert images.crop_resize(frame, (1.9, 0, 3.2, 1), 2).tolist() == frame[[0, 0]][:, [1, 2]].tolist()
    assert images.crop_resize(frame, (9, 9, 9, 9), 1).tolist() == frame[1:, 3:].tolist()
    grey = images.nv21_to_rgb(bytes([16, 235, 16, 235, 126, 126, 126, 126] + [128] * 4), 4, 2)
    assert grey[0, 0].tolist() == [0, 0, 0] and grey[0, 1].tolist() == [254, 254, 254] and grey[1, 0].tolist() == [128, 128, 128]
    red = images.nv21_to_rgb(bytes([81] * 4 + [240, 90]), 2, 2)
    assert red[0, 0, 0] > 250 and red[0, 0, 1] < 5 and red[0, 0, 2] < 5
    rows = spark.createDataFrame([(1, bytearray(frame.tobytes()), 4, 2), (2, None, 4, 2)], "k int, frame binary, width int, height int")
    got = {r["k"]: r["values"] for r in images.map_frames(rows, lambda f: images.letterbox(f, 8)).collect()}
    assert got[2] is None and np.allclose(got[1], boxed.ravel())


def test_refinement_in_pieces_is_that_of_the_whole(spark):
    """A chain with an outage longer than a piece, solved whole and in pieces of several sizes."""
    draw = np.random.default_rng(7)
    n = 230
    course = np.cumsum(draw.normal(0, 0.1, n))
    x, z = np.cumsum(np.cos(course)), np.cumsum(np.sin(course))
    poses = [(1, i, i * 10**9, float(x[i] * 1.01), 0.0, float(z[i]), "TRACKING") for i in range(n)] + [(2, i, i * 10**9, float(i), 0.0, float(i % 3), "TRACKING") for i in range(40)]
    df = spark.createDataFrame(poses, "trip_id long, pose_id long, ts_ns long, vio_x double, vio_y double, vio_z double, state string")
    known = [p for p in poses if p[0] == 2 or not 60 <= p[1] < 170]
    places = spark.createDataFrame([(p[0], p[1], p[2], p[3] + float(draw.normal(0, 2)), -p[5] + float(draw.normal(0, 2))) for p in known], "trip_id long, fix_id long, ts_ns long, e double, n double")
    lat, lon, alt = geo.from_enu(F.col("e"), F.col("n"), F.lit(0.0), F.lit(12.97), F.lit(77.59), F.lit(900.0))
    fixes = places.select("trip_id", "fix_id", "ts_ns", lat.alias("lat"), lon.alias("lon"), alt.alias("alt"), F.lit(3.0).alias("h_acc_m"))
    at = lambda size: {(r["trip_id"], r["pose_id"]): (r["east"], r["north"]) for r in georef.refine(df, fixes, size).collect()}
    whole = at(4000)
    assert len(whole) == n + 40
    for size in (50,):
        pieces = at(size)
        assert pieces.keys() == whole.keys()
        assert max(abs(a - b) for k in whole for a, b in zip(whole[k], pieces[k], strict=True)) < 1e-6


def test_radius_joins_take_every_fix(spark):
    for name in ("radius_join_grid", "association_3m_grid"):
        near = registry.QUERIES[name](spark, SF)
        assert near.where("fix_id % 10 != 0").count() > near.where("fix_id % 10 = 0").count() > 0


def test_radius_join_of_places_of_many_rows(spark, monkeypatch):
    """Places of many rows, in chunks and blocks of a few, give each pair once: ids may be null or repeated, places null."""
    draw = random.Random(4)
    spots = [(12.97, 77.59), (12.97, 77.59 + 1e-5), (12.97 + 2e-4, 77.59), (None, 77.59), (12.97, None)]
    rows = lambda n: [(draw.choice([None, *range(n // 2)]), draw.choice("abc"), *spots[min(4, int(draw.expovariate(1)))]) for _ in range(n)]
    left, right = rows(150), rows(90)
    a, b = spark.createDataFrame(left, "a long, s string, alat double, alon double"), spark.createDataFrame(right, "b long, t string, blat double, blon double")
    apart = lambda x, y: geo.EARTH_RADIUS_M * math.hypot(math.radians(x[2] - y[2]), math.radians(x[3] - y[3]) * math.cos(math.radians(12.97)))
    want = sorted([(x, y) for x in left for y in right if None not in (*x[2:], *y[2:]) and apart(x, y) <= 5], key=str)
    for chunk, blocks, numbered in ((rel.CHUNK_ROWS, rel.BLOCK_ROWS, rel.NUMBERED_ROWS), (7, {"left": 3, "right": 2}, 20), (8, {"left": 4, "right": 8}, 1)):
        monkeypatch.setattr(rel, "CHUNK_ROWS", chunk)
        monkeypatch.setattr(rel, "BLOCK_ROWS", blocks)
        monkeypatch.setattr(rel, "NUMBERED_ROWS", numbered)
        monkeypatch.setattr(rel, "PAIRS", (100, 1000))
        got = rel.radius_join(a, b, 5.0, ("alat", "blat"), ("alon", "blon"))
        assert got.columns == ["a", "s", "alat", "alon", "b", "t", "blat", "blon", "distance_m"]
        assert sorted([(tuple(r)[:4], tuple(r)[4:8]) for r in got.collect()], key=str) == want and len(want) > 3000
    only = rel.radius_join(a.select("alat", "alon"), b.select("b", "blat", "blon"), 5.0, ("alat", "blat"), ("alon", "blon"))
    assert only.count() == len(want) and only.columns == ["alat", "alon", "b", "blat", "blon", "distance_m"]


def test_radius_join_of_one_place_is_many_tasks_and_little_disk(spark, tmp_path):
    at = [F.lit(12.97).alias("lat"), F.lit(77.59).alias("lon")]
    fixes = spark.range(12000).select((F.col("id") * 2000).alias("fix_id"), at[0].alias("flat"), at[1].alias("flon"))
    near = rel.radius_join(fixes, spark.range(250).select((F.col("id") * 2000).alias("id"), *at), 50.0, ("flat", "lat"), ("flon", "lon"), 6)
    near.select("fix_id", "id", "distance_m").write.parquet(str(tmp_path / "out"))
    files = [p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")]
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == back.distinct().count() == 3_000_000
    assert back.groupBy(F.input_file_name()).count().count() > 2 and sum(files) < 0.3 * 3_000_000


def test_association_of_a_crowded_place_is_many_tasks(spark, tmp_path):
    """Rows of one place, read from two small files, are dealt out by their pairs."""
    numbers = lambda n: spark.range(n).select((F.col("id") * 2000).alias("id"))
    events = numbers(9000).selectExpr("id as event_id", "timestamp '2024-01-01' as ts", "id % 7 as user_id", "'view' as event_type", "1.0D as value", "'{}' as props")
    customers = numbers(120).selectExpr("id as c_custkey", "'c' as c_name", "1 as c_nationkey", "0.0D as c_acctbal", "'POLE' as c_mktsegment")
    for name, df in (("events", events), ("customer", customers)):
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = registry.QUERIES["association_3m_grid"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id())
    n, rows, tasks = got.agg(F.count("*"), F.count_distinct("fix_id", "id"), F.count_distinct("task")).first()
    assert n == rows == 9000 * 120 and tasks > 2


def test_joins_in_time_take_every_fix(spark):
    fixes = registry.table(spark, SF, "v_fix").count()
    for name in ("nearest_pose_100ms", "latest_pose_asof", "pose_fix_stream_join"):
        assert registry.QUERIES[name](spark, SF).select("fix_id").distinct().count() == fixes


def test_counter_poll_has_no_upper_bound(spark):
    samples = registry.table(spark, SF, "v_sample")
    got = [r["seq"] for r in registry.QUERIES["counter_poll"](spark, SF).collect()]
    assert got == sorted(r["seq"] for r in samples.where("seq > 100").collect()) and max(got) > 400


def test_landmark_map_keeps_the_references_number_and_evicts_the_oldest(spark):
    rows = [(1, k, k % 60, 1, float(k)) for k in range(120)]
    points = spark.createDataFrame(rows, "trip_id long, l_orderkey long, l_partkey long, l_linenumber long, x double")
    assert details.latest_capped(points).count() == 60
    got = sorted((r["l_partkey"], r["x"]) for r in details.latest_capped(points, 3).collect())
    assert got == [(57, 117.0), (58, 118.0), (59, 119.0)]


def test_human_bytes_round_as_c_does(spark):
    sizes = [None, -5, 0, 1023, 1024, 1280, 1792, 2304, 2816, (1 << 20) - 1, 1 << 20, 5 << 18, 7 << 18, (5 << 18) + 1, (1 << 40) + 12345, (1 << 63) - 1]
    sizes += [256 * k for k in range(4, 300)] + [(1 << 18) * k for k in range(4, 300)]
    said = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "i long, n long").select("i", records.human_bytes(F.col("n")).alias("text"))
    c = lambda n: None if n is None else f"{n} B" if n < 1024 else "%.1f KiB" % (n / 1024) if n < 1 << 20 else "%.1f MiB" % (n / (1 << 20))
    assert {r["i"]: r["text"] for r in said.collect()} == {i: c(n) for i, n in enumerate(sizes)}


def test_reports_are_decoded_few_buffers_at_once(spark, monkeypatch):
    monkeypatch.setattr(records, "SOME_BUFFERS", 2)
    kept = {}
    frame = type("Frame", (), {"drop": lambda self, c: frame_of[0], "select": lambda self, *c: self, "mapInArrow": lambda self, run, said: kept.update(run=run)})()
    frame_of = [spark.createDataFrame([], "id long")]
    records.decode_reports(frame)
    one = np.zeros(1, records.REPORT)
    one["counter"] = 7
    given = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([one.tobytes(), None, one.tobytes() * 3, b"", one.tobytes()], pa.binary())], names=["id", "data"])
    made = list(kept["run"](iter([given])))
    assert [x.num_rows for x in made] == [1, 3, 1] and pa.Table.from_batches(made)["id"].to_pylist() == [0, 2, 2, 2, 4]


def test_assets_of_detections_place_them_once(spark):
    """A detection's transform goes through tracking with it, so what places detections is not run again for a join."""
    c = F.col
    placed = spark.range(7, 10).select(F.lit(1).cast("long").alias("trip_id"), c("id").alias("ts_ns"), "id", (c("id") * 50.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit("POLE").alias("asset_class"), F.lit(0.5).alias("confidence"), F.lit(2.0).alias("depth_m"), c("id").alias("frame_id"), F.lit(None).cast("string").alias("semantic_label"), F.lit("kept").alias("reason"), (c("id") % 2).alias("transform_id"))
    one = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    transforms = spark.createDataFrame([(1, k, 0, 1.0, one, [0.0, 1000.0 * k, 0.0]) for k in (0, 1)], "trip_id long, transform_id long, ts_ns long, scale double, rotation array<double>, translation array<double>")
    origins = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "trip_id long, lat0 double, lon0 double, alt0 double")
    got = perception.extract_assets(placed, transforms, origins)
    assert "transform_id" not in got.columns
    assert [(r["id"], r["lat"] > 0.005) for r in got.orderBy("id").collect()] == [(7, True), (8, False), (9, True)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Range (7, 10") == 1

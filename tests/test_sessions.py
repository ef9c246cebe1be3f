"""Sessions as a whole, against plain Python."""

import json
import math

import pytest
from pyspark.sql import functions as F

from wayfold.operators import session

POSE = "trip_id long, pose_id long, ts_ns long, vio_x double, vio_y double, vio_z double, qx double, qy double, qz double, qw double, state string"


def test_measures_of_a_known_walk(spark):
    s = 10**9
    poses = [(1, i, i * s, float(i), 0.0, float(3 * (i % 2)), 0.0, 0.0, 0.0, 1.0, "TRACKING" if i % 4 else "PAUSED") for i in range(41)] + [(2, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, "PAUSED")]
    fixes = [(1, i, i * s, 48.0 + (3 * (i % 2)) * 8.993e-6, 16.0 + i * 1.3407e-5, 100.0, 4.0 if i % 2 else -1.0) for i in range(41)]
    epochs = [(1, 30.0, 8), (1, 40.0, 12)]
    samples = [(1, i, i * s if i < 30 else (i + 20) * s, i * s + (20_000_000 if i >= 38 else 0)) for i in range(40)]
    make = spark.createDataFrame
    got = {r["trip_id"]: r for r in session.quality(session.measures(make(poses, POSE), make(fixes, "trip_id long, fix_id long, ts_ns long, lat double, lon double, alt double, h_acc_m double"), make(epochs, "trip_id long, cn0 double, used int"), make([(1,)] * 5, "trip_id long"), make(samples, "stream_id long, seq long, raw_ns long, arrival_ns long"), s)).collect()}
    one, two = got[1], got[2]
    assert one["tracking"] == pytest.approx(30 / 41) and one["distance"] == pytest.approx(40 * math.hypot(1, 3))
    assert one["keyframes"] == 30 and one["landmarks"] == 5 and one["fix"] == pytest.approx(20 / 41) and one["accuracy"] == 4.0
    assert (one["cn0"], one["sats"]) == (35.0, 10.0) and one["drop_rate"] == pytest.approx(20 / 40)
    assert one["aligned"] and one["rms"] < 0.05 and one["coverage"] == pytest.approx(3 * 39, rel=0.02) and one["overall"] > 0.4
    assert not two["aligned"] and math.isnan(two["rms"]) and two["accuracy"] == -1 and two["landmarks"] == 0 and 0 <= two["overall"] < 0.3


def test_only_landmarks_seen_again_are_promoted(spark):
    landmarks = spark.createDataFrame([(1, 1, 2, 1.0, 2.0, 3.0), (1, 2, 1, 1.0, 2.0, 3.0), (1, 3, 5, float("nan"), 0.0, 0.0), (2, 1, 9, 0.0, 0.0, 0.0)], "trip_id long, track_id long, observations long, x double, y double, z double")
    turn = [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    transforms = spark.createDataFrame([(1, 5, 1.0, turn, [9.0, 9.0, 9.0]), (1, 7, 2.0, turn, [4.0, -2.0, 0.0])], "trip_id long, ts_ns long, scale double, rotation array<double>, translation array<double>")
    origins = spark.createDataFrame([(1, 10.0, 20.0, 50.0), (2, 0.0, 0.0, 0.0)], "trip_id long, lat0 double, lon0 double, alt0 double")
    (r,) = session.promoted(landmarks, transforms, origins).collect()
    assert r["track_id"] == 1 and abs(r["lat"] - 10.0) < 1e-6 and abs(r["lon"] - 20.0) < 1e-6 and abs(r["alt"] - 56.0) < 1e-3


def test_density_is_a_weighted_kernel(spark):
    points = [(0.5, 0.5, 2.0), (0.6, 0.1, 1.0), (3.5, 0.5, None), (9.5, -4.5, 1.0), (float("nan"), 0.0, 5.0)]
    got = {(r["cell_x"], r["cell_y"]): r["density"] for r in session.density(spark.createDataFrame(points, "x double, y double, w double"), "x", "y", 1.0, 1.5, F.col("w")).collect()}
    cells = {(0, 0): 3.0, (3, 0): 0.0, (9, -5): 1.0}
    for at, d in got.items():
        want = sum(w * math.exp(-0.5 * (math.dist(at, c) / 1.5) ** 2) for c, w in cells.items() if math.dist(at, c) <= 4.5)
        assert abs(d - want) < 1e-9
    assert got[0, 0] == pytest.approx(3.0) and (5, 0) in got and (20, 0) not in got


def test_sidecar_of_a_trip(spark):
    make = spark.createDataFrame
    trips = make([(1, 5, 9, ("A", "B", "14", "1"), (False, None, "UNKNOWN"), None), (2, 5, 9, ("A", "B", "14", "1"), (True, 800.0, "REALTIME"), "v.mp4")], "trip_id long, started_ns long, ended_ns long, device struct<manufacturer:string,model:string,osVersion:string,appVersion:string>, calibration struct<hasCameraIntrinsics:boolean,fx:double,cameraTimestampSource:string>, mp4 string")
    health = make([(2, "pose", "VIO", 1, 2.5, 3, 4, 5, 6), (2, "imu", "IMU", 0, 200.0, 9, 0, 0, 0)], "trip_id long, stream_id string, source string, offset_ns long, rate_hz double, received long, dropped long, out_of_order long, gaps long")
    got = {r["trip_id"]: json.loads(r["metadata"]) for r in session.metadata(trips, health, make([(2, "b"), (2, "a")], "trip_id long, segment string"), make([(2,)] * 3, "trip_id long")).collect()}
    assert got[1]["syncHealth"] == [] and got[1]["segments"] == [] and got[1]["frameCount"] == 0 and "mp4Path" not in got[1] and got[1]["calibration"] == {"hasCameraIntrinsics": False, "cameraTimestampSource": "UNKNOWN"}
    assert [x["streamId"] for x in got[2]["syncHealth"]] == ["imu", "pose"] and got[2]["syncHealth"][1]["gapCount"] == 6 and got[2]["segments"] == ["a", "b"] and got[2]["frameCount"] == 3 and got[2]["schemaVersion"] == 1

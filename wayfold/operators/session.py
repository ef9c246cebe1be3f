"""Sessions as a whole: quality from what was measured, the sidecar of metadata, promoted assets, density."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import folds, georef, monitor, ordered, solve
from . import relational as rel

#: Sightings that promote a landmark; the kernel's radius in standard deviations.
LEAST_SEEN, REACH = 2, 3.0


def planar_length(poses: DataFrame) -> DataFrame:
    """trip_id and distance: metres walked over the ground (vio_x and vio_z), from pose to pose."""
    here = poses.dropna(subset=["ts_ns", "vio_x", "vio_z"]).withColumn("here", F.struct("vio_x", "vio_z"))
    stepped = ordered.with_previous(here, "trip_id", ["ts_ns", "pose_id"], "here", "before")
    step = F.hypot(F.col("vio_x") - F.col("before.vio_x"), F.col("vio_z") - F.col("before.vio_z"))
    return stepped.groupBy("trip_id").agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("distance"))


def measures(poses: DataFrame, fixes: DataFrame, epochs: DataFrame, landmarks: DataFrame, samples: DataFrame, nominal_ns: int, pair_ns: int = georef.PAIR_NS, drift_ns: int = 5_000_000, keyframe: tuple[int, float, float] = (250_000_000, 0.3, 8.0)) -> DataFrame:
    """A row for each trip that has poses, with the inputs of `solve.quality_scores`, each measured; what a trip has no rows
    of is 0, its accuracy -1 (not known) and its rms NaN.

    `poses`; `fixes` (trip_id, fix_id, ts_ns, lat, lon, alt, h_acc_m); `epochs` of satellites (trip_id, cn0, used); `landmarks`
    (trip_id); `samples` of all streams of a trip (trip_id as stream_id, seq, raw_ns, arrival_ns). Keyframes are those of
    `folds.keyframes`, lost samples and drifts the monitor's, rms that of the alignment of fixes with the nearest pose.
    """
    tracking = poses.groupBy("trip_id").agg(F.avg((F.col("state") == "TRACKING").cast("double")).alias("tracking"))
    frames = folds.keyframes(poses, *keyframe).groupBy("trip_id").agg(F.count("*").cast("double").alias("keyframes"))
    known = fixes.groupBy("trip_id").agg(F.avg(F.when(F.col("h_acc_m") >= 0, F.col("h_acc_m"))).alias("accuracy"), F.avg((F.col("h_acc_m") >= 0).cast("double")).alias("fix"))
    sky = epochs.groupBy("trip_id").agg(F.avg("cn0").alias("cn0"), F.avg("used").alias("sats"))
    found = landmarks.groupBy("trip_id").agg(F.count("*").cast("double").alias("landmarks"))
    stream = samples.select(F.col("stream_id"), "raw_ns", "seq")
    gap = F.expr(f"(raw_ns - before) div {nominal_ns} - 1")
    lost = ordered.with_previous(stream.where("raw_ns is not null"), "stream_id", ["raw_ns", "seq"], "raw_ns", "before")
    lost = lost.groupBy(F.col("stream_id").alias("trip_id")).agg(F.coalesce(F.sum(F.when(F.col("raw_ns") - F.col("before") > int(nominal_ns * monitor.GAP_PERIODS), gap)), F.lit(0)).alias("lost"), F.count("*").alias("n"))
    lost = lost.select("trip_id", (F.col("lost") / F.col("n")).alias("drop_rate"))
    drifts = monitor.drift(samples).groupBy(F.col("stream_id").alias("trip_id")).agg(F.count_if(F.abs("drift_ns") > drift_ns).cast("double").alias("drift_ms"))
    at = ("vio_x", "vio_y", "vio_z")
    pairs = rel.nearest_in_time(georef.fixes_in_enu(fixes), poses.where("state = 'TRACKING'"), "trip_id", "ts_ns", "pose_id", pair_ns, also=at).where("matched_id is not null")
    fitted = solve.similarity_solve(pairs, "trip_id", at, ("east", "north", "up")).select("trip_id", "rms", F.lit(True).alias("aligned"))
    ground = georef.fixes_in_enu(fixes).select("trip_id", "east", "north")
    covered = solve.hull_area(ground, "trip_id", "east", "north").withColumnRenamed("area", "coverage")
    out = tracking
    for part in (frames, planar_length(poses), known, sky, found, lost, drifts, fitted, covered):
        out = out.join(part, "trip_id", "left")  # each a row for a trip
    unknown = {"aligned": F.lit(False), "accuracy": F.lit(-1.0), "rms": F.lit(float("nan"))}
    return out.select("trip_id", *[F.coalesce(c, unknown.get(c, F.lit(0.0))).alias(c) for c in out.columns if c != "trip_id"])


def quality(measured: DataFrame) -> DataFrame:
    """`measured` with its scores."""
    columns = {n: F.col(n) for n in measured.columns}
    return measured.withColumns(solve.quality_scores(columns))


def promoted(landmarks: DataFrame, transforms: DataFrame, origins: DataFrame, least: int = LEAST_SEEN) -> DataFrame:
    """Assets of the landmarks (`folds.landmarks`) that were seen `least` times or more, at their place on the map by
    their trip's last transform (trip_id, ts_ns, scale, rotation, translation): lat, lon, alt. Trips without a transform or
    an origin have none yet, and places that are not finite are left out."""
    c = F.col
    last = transforms.groupBy("trip_id").agg(F.max_by(F.struct("scale", "rotation", "translation"), "ts_ns").alias("m"))
    met = landmarks.where(c("observations") >= least).join(last, "trip_id").join(origins, "trip_id")
    row = lambda i: c("m.scale") * sum((F.get("m.rotation", F.lit(3 * i + j)) * c(a) for j, a in enumerate("xyz")), F.lit(0.0)) + F.get("m.translation", F.lit(i))
    lat, lon, alt = geo.from_enu(row(0), row(1), row(2), c("lat0"), c("lon0"), c("alt0"))
    out = met.select(*landmarks.columns, lat.alias("lat"), lon.alias("lon"), alt.alias("alt"))
    return out.where(geo.is_finite(c("lat")) & geo.is_finite(c("lon")) & geo.is_finite(c("alt")))


def density(points: DataFrame, x: str, y: str, cell: float, sigma: float, weight: Column | None = None) -> DataFrame:
    """cell_x, cell_y and density of every cell within `REACH` `sigma` of a point: the points' weights (1) times a Gaussian
    of the distance between their cells' middles. Points are summed by cell first, so a crowded place is a row; points
    without a finite place are left out, null weights are 0."""
    reach = math.ceil(REACH * sigma / cell)
    offsets = [(i, j, math.exp(-0.5 * (math.hypot(i, j) * cell / sigma) ** 2)) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if math.hypot(i, j) * cell <= REACH * sigma]
    given = points.where(geo.is_finite(F.col(x)) & geo.is_finite(F.col(y)))
    cells = given.groupBy(F.floor(F.col(x) / cell).alias("a"), F.floor(F.col(y) / cell).alias("b")).agg(F.sum(F.coalesce(weight if weight is not None else F.lit(1.0), F.lit(0.0))).alias("w"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i, j, k in offsets])
    spread = cells.select("a", "b", "w", F.explode(around).alias("o"))
    return spread.groupBy((F.col("a") + F.col("o.i")).alias("cell_x"), (F.col("b") + F.col("o.j")).alias("cell_y")).agg(F.sum(F.col("w") * F.col("o.k")).alias("density"))


def metadata(trips: DataFrame, health: DataFrame, logs: DataFrame, frames: DataFrame) -> DataFrame:
    """trip_id and metadata, the JSON sidecar of a trip: tripId, startedNs, endedNs, device, calibration, syncHealth of its
    streams in order of their name, its segments in order, mp4Path, frameCount and schemaVersion.

    `trips` has trip_id, started_ns, ended_ns, device (manufacturer, model, osVersion, appVersion), calibration (as in the
    sidecar; with unknown intrinsics null) and mp4; `health` trip_id, stream_id, source and what `monitor.snapshot` says;
    `logs` trip_id and segment; `frames` trip_id. What is null is left out, lists of nothing are empty. A trip has few
    streams and segments.
    """
    said = {"streamId": "stream_id", "source": "source", "appliedOffsetNs": "offset_ns", "rateHz": "rate_hz", "samplesReceived": "received", "samplesDropped": "dropped", "outOfOrderCount": "out_of_order", "gapCount": "gaps"}
    streams = health.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(n) for n, c in said.items()]))).alias("syncHealth"))
    segments = logs.groupBy("trip_id").agg(F.array_sort(F.collect_list("segment")).alias("segments"))
    counted = frames.groupBy("trip_id").agg(F.count("*").cast("int").alias("frameCount"))
    met = trips.join(streams, "trip_id", "left").join(segments, "trip_id", "left").join(counted, "trip_id", "left")
    none = lambda c: F.coalesce(F.col(c), F.array().cast(met.schema[c].dataType))
    body = F.struct(F.col("trip_id").alias("tripId"), F.col("started_ns").alias("startedNs"), F.col("ended_ns").alias("endedNs"), "device", "calibration", none("syncHealth").alias("syncHealth"), none("segments").alias("segments"), F.col("mp4").alias("mp4Path"), F.coalesce("frameCount", F.lit(0)).alias("frameCount"), F.lit(1).alias("schemaVersion"))
    return met.select("trip_id", F.to_json(body).alias("metadata"))

"""Alignment, coverage, quality, logs and exports of trips, and streaming twins."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import folds, georef, monitor, perception, session, solve
from ..sources import clouds, exports, logs
from ..sources.shared import is_folder, new_path
from .registry import QUERIES, query
from .streams import detections
from ..views import table


@query("similarity_solve")
def similarity_solve(t):
    """Poses are aligned to a turned, doubled and shifted copy of themselves."""
    pairs = t("v_pose").select("trip_id", "vio_x", "vio_y", "vio_z", (-2 * F.col("vio_y") + 5).alias("e"), (2 * F.col("vio_x") - 3).alias("n"), (2 * F.col("vio_z") + 1).alias("u"))
    found = solve.similarity_solve(pairs, "trip_id", ("vio_x", "vio_y", "vio_z"), ("e", "n", "u"))
    return found.select("trip_id", "n", F.round("scale", 6).alias("scale"), F.round(F.get("translation", F.lit(0)), 3).alias("t_east"))


@query("coverage_area_hull", """with p as (select distinct trip_id, vio_x as x, -vio_z as y from v_pose),
    e as (select a.trip_id, a.x as ax, a.y as ay, b.x as bx, b.y as b_y from p a join p b on a.trip_id = b.trip_id and (a.x <> b.x or a.y <> b.y)),
    h as (select e.* from e where not exists (select 1 from p r where r.trip_id = e.trip_id and ((bx-ax)*(r.y-ay)-(b_y-ay)*(r.x-ax) < 0
        or ((bx-ax)*(r.y-ay)-(b_y-ay)*(r.x-ax) = 0 and (r.x-ax)*(r.x-bx)+(r.y-ay)*(r.y-b_y) < 0))))
    select trip_id, sum(ax*b_y-bx*ay)/2 as area from h group by trip_id""")
def coverage_area_hull(t):
    return solve.hull_area(t("v_pose").withColumn("ground", -F.col("vio_z")), "trip_id", "vio_x", "ground")


_U = "least(greatest({}, 0), 1)"


@query("quality_report", f"""with m as (select trip_id, avg(case when state = 'TRACKING' then 1.0::double else 0 end) as tracking, count(*)::double as kf, 8000.0::double as lm, avg(vio_y) * 10 as dist, avg(vio_y) as cn0, max(pose_id % 20)::double as sats, min(vio_y) - 1 as acc from v_pose group by trip_id),
    s as (select *, 0.6::double * {_U.format('tracking')} + 0.25::double * case when dist > 1 then least(1, kf / (dist / 5)) else 0 end + 0.15::double * case when kf > 0 then least(1, lm / (kf * 50)) else 0 end as slam,
      case when acc < 0 then 0.5::double + 0.3::double * {_U.format('(cn0-20)/25')} + 0.2::double * {_U.format('sats/12')} else 0.4::double + 0.25::double * {_U.format('(cn0-20)/25')} + 0.15::double * {_U.format('sats/12')} + 0.2::double * {_U.format('1-acc/20')} end as gnss from m),
    r as (select *, 0.4::double * 0.9 + 0.2::double * 0.75 + 0.4::double * 0.8 as trajectory, 0.3::double * 0.5 + 0.3::double * case when dist > 1 then least(1, lm / (dist * 100)) else 0 end + 0.2::double * slam + 0.1::double * gnss + 0.1::double as readiness from s)
    select trip_id, round(slam, 6) as slam, round(gnss, 6) as gnss, round(trajectory, 6) as trajectory, round(readiness, 6) as readiness, round(0.3::double*slam+0.25::double*gnss+0.25::double*trajectory+0.2::double*readiness, 6) as overall from r""")
def quality_report(t):
    m = t("v_pose").groupBy("trip_id").agg(F.avg(F.when(F.col("state") == "TRACKING", 1.0).otherwise(0.0)).alias("tracking"), F.count("*").cast("double").alias("keyframes"), (F.avg("vio_y") * 10).alias("distance"), F.avg("vio_y").alias("cn0"), F.max(F.col("pose_id") % 20).cast("double").alias("sats"), (F.min("vio_y") - 1).alias("accuracy"))
    fixed = {"landmarks": 8000.0, "fix": 1.0, "drop_rate": 0.01, "drift_ms": 5.0, "rms": 1.0, "coverage": 500.0}
    c = {n: F.col(n) for n in m.columns} | {k: F.lit(v) for k, v in fixed.items()} | {"aligned": F.lit(True)}
    return m.select("trip_id", *[F.round(v, 6).alias(k) for k, v in solve.quality_scores(c).items()])


def _points(t):
    """Fixes with east and north from their trip's mean place."""
    w = W.partitionBy("trip_id")
    return t("v_fix").withColumns({"east": (F.col("lon") - F.avg("lon").over(w)) * 111_320.0, "north": (F.col("lat") - F.avg("lat").over(w)) * 110_574.0})


@query("geojson_lines", """select trip_id, part, count(*) + case when part > 0 then 1 else 0 end as points, round(coalesce(sum(d), 0), 3) as length_m from (select trip_id, d, cast(floor(greatest(n - 1, 0) / 50) as bigint) as part from (
    select *, sqrt(pow((lon - lag(lon) over w) * 111320, 2) + pow((lat - lag(lat) over w) * 110574, 2)) as d, row_number() over w - 1 as n, count(*) over (partition by trip_id) as m from v_fix window w as (partition by trip_id order by ts_ns, lon, lat)) where m >= 2) group by trip_id, part""")
def geojson_lines(t):
    """Lines of 50 points at most, with what their properties say."""
    lines = exports.geojson_lines(_points(t), "trip_id", "ts_ns", most=50)
    said = F.from_json("feature", "struct<properties: struct<points: bigint, length_m: double>>")["properties"]
    return lines.select("trip_id", F.col("part").cast("long").alias("part"), said["points"].alias("points"), said["length_m"].alias("length_m"))


@query("geojson_parse", "select trip_id, row_number() over (partition by trip_id order by ts_ns, lon, lat) - 1 as n, lon, lat, alt from v_fix qualify count(*) over (partition by trip_id) >= 2")
def geojson_parse(t):
    parsed = exports.parse_geojson(exports.geojson_lines(t("v_fix"), "trip_id", "ts_ns", most=50), "trip_id", most=50)
    return parsed.withColumn("n", F.col("n").cast("long"))


@query("geojson_any_layout", "select trip_id, row_number() over (partition by trip_id order by ts_ns, lon, lat) - 1 as n, lon, lat, alt from v_fix qualify count(*) over (partition by trip_id) >= 2")
def geojson_any_layout(t):
    """Trips as indented documents with members and an order of their own, and compact ones, scanned alike."""
    line = F.array_sort(F.collect_list(F.struct("ts_ns", "lon", "lat", "alt")))
    rows = t("v_fix").groupBy("trip_id").agg(line.alias("line")).where(F.size("line") >= 2)
    geometry = F.struct(F.transform("line", lambda p: F.array(p["lon"], p["lat"], p["alt"])).alias("coordinates"), F.lit("LineString").alias("type"))
    feature = F.struct(geometry.alias("geometry"), F.struct(F.lit('a } "quoted" {[ name').alias("name")).alias("properties"), F.lit("Feature").alias("type"))
    document = F.struct(F.struct(F.array(F.lit(1)).alias("features")).alias("crs"), F.array(feature).alias("features"), F.lit("FeatureCollection").alias("type"))
    text = F.when(F.col("trip_id") % 2 == 0, F.to_json(document, {"pretty": "true"})).otherwise(F.to_json(geometry))
    found = exports.scan_features(rows.select("trip_id", text.alias("document")), "trip_id", "document")
    return exports.parse_geojson(found, "trip_id").withColumn("n", F.col("n").cast("long"))


def _full_assets(t):
    """Assets with an altitude, a depth that may be missing, the frame that they were seen in, and an odd class."""
    odd = F.when(F.col("id") % 10 == 0, F.concat(F.lit('a, "'), F.col("asset_class"), F.lit('"'))).otherwise(F.col("asset_class"))
    return t("v_asset").select("trip_id", "id", odd.alias("asset_class"), "lat", "lon", (900 + F.col("id") % 7).cast("double").alias("alt"), "confidence", F.when(F.col("id") % 4 != 0, F.col("id") % 30 / 2).alias("depth_m"), (F.col("id") * 3).alias("source_frame_id"))


_ASSETS = "id, case when id % 10 = 0 then 'a, \"' || asset_class || '\"' else asset_class end as {name}, lat, lon, 900 + id % 7 + 0.0::double as alt, confidence, case when id % 4 <> 0 then (id % 30) / 2.0::double end as depth_m"


@query("csv_assets", f"select {_ASSETS.format(name='class')}, id * 3 as source_frame_id from v_asset")
def csv_assets(t):
    """All eight columns as lines of a CSV file, parsed again."""
    return exports.parse_csv(exports.csv_lines(_full_assets(t).withColumnRenamed("asset_class", "class"), exports.ASSETS), exports.ASSETS)


@query("csv_trajectory", "select timestamp_ns, round(lat, 9) as lat, round(lon, 9) as lon, alt, round(e, 2) as east, round(n, 2) as north, 0.0::double as up from (select ts_ns as timestamp_ns, lat, lon, case when fix_id % 5 = 0 then 0 else alt end as alt, (lon - avg(lon) over (partition by trip_id)) * 111320 as e, (lat - avg(lat) over (partition by trip_id)) * 110574 as n from v_fix)")
def csv_trajectory(t):
    rows = _points(t).select(F.col("ts_ns").alias("timestamp_ns"), "lat", "lon", F.when(F.col("fix_id") % 5 == 0, float("nan")).otherwise(F.col("alt")).alias("alt"), "east", "north", F.lit(0.0).alias("up"))
    back = exports.parse_csv(exports.csv_lines(rows, exports.TRAJECTORY), exports.TRAJECTORY)
    return back.select("timestamp_ns", *[F.round(c, 9).alias(c) for c in ("lat", "lon")], "alt", *[(F.round(c, 2) + 0.0).alias(c) for c in ("east", "north", "up")])


@query("csv_places", "select lat, lon, case when fix_id % 5 = 0 then 0 else alt end as alt from v_fix")
def csv_places(t):
    rows = t("v_fix").select("lat", "lon", F.when(F.col("fix_id") % 5 == 0, float("nan")).otherwise(F.col("alt")).alias("alt"))
    return exports.parse_csv(exports.csv_lines(rows, exports.PLACES), exports.PLACES)


def geojson_trips(spark, sf_dir):
    """A document for each trip: its line and its assets, written, read again, and the assets parsed."""
    t = lambda name: table(spark, sf_dir, name)
    folder = new_path(spark, "geojson")
    lines = exports.geojson_lines(t("v_fix"), "trip_id", "ts_ns").select("trip_id", "part", "feature")
    points = exports.geojson_assets(_full_assets(t), "trip_id").select("trip_id", F.lit(1 << 40).alias("part"), "feature")
    exports.write_collections(lines.unionByName(points), "trip_id", ["part", "feature"], f"{folder}/documents").write.parquet(f"{folder}/files")
    files = spark.read.schema("path string, trip_id long, n_features long").parquet(f"{folder}/files")
    return exports.parse_assets(exports.read_collections(files, "trip_id"), "trip_id")


query("geojson_trips", f"select trip_id, {_ASSETS.format(name='asset_class')} from v_asset")(None)
QUERIES["geojson_trips"] = geojson_trips


def mcap_roundtrip(spark, sf_dir):
    """Samples are written as logs, of segments of a week or 64 KB for each stream, and read back chunk by chunk."""
    folder = new_path(spark, "logs")
    s = table(spark, sf_dir, "v_sample")
    rows = s.select(F.pmod(F.xxhash64("stream_id"), F.lit(1 << 30)).alias("trip_id"), F.col("stream_id").alias("topic"), F.col("raw_ns").alias("log_time_ns"), F.col("arrival_ns").alias("publish_time_ns"), F.col("seq").cast("string").cast("binary").alias("data"))
    logs.write_logs(rows, folder, 1 << 14, segment_bytes=1 << 16, segment_ns=86_400_000_000_000 * 7).write.parquet(f"{folder}/files")
    found = logs.read_chunks(logs.list_chunks(spark.read.schema(logs.FILES).parquet(f"{folder}/files")))
    return found.select(F.col("topic").alias("stream_id"), F.col("data").cast("string").cast("long").alias("seq"), F.col("log_time_ns").alias("raw_ns"), F.col("publish_time_ns").alias("arrival_ns"), "chunk_crc_ok")


query("mcap_roundtrip", "select stream_id, seq, raw_ns, arrival_ns, true as chunk_crc_ok from v_sample")(None)
QUERIES["mcap_roundtrip"] = mcap_roundtrip


def stream_rate_live(spark, sf_dir):
    """The tumbling rate as a streaming query, run over what is there and then read from its sink.

    Each micro-batch upserts the windows that it changed, under its own number, so that a batch tried again replaces
    its own rows; windows that the watermark has passed leave the state. A window's last rows win.
    """
    folder = new_path(spark, "live")
    timed = _live_events(spark, sf_dir).withWatermark("at", "1 hour")
    counts = timed.groupBy(F.window("at", "1 hour").alias("w"), F.col("event_type").alias("stream_id")).agg(F.count("*").alias("n"))
    flat = counts.select("stream_id", F.unix_seconds("w.start").alias("hour_s"), "n")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    flat.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("stream_id string, hour_s long, n long, batch long").parquet(f"{folder}/out")
    return out.groupBy("stream_id", "hour_s").agg(F.max_by("n", "batch").alias("n"))


query("stream_rate_live", "select stream_id, cast(raw_ns // 3600000000000 * 3600 as bigint) as hour_s, count(*) as n from v_sample group by all")(None)
QUERIES["stream_rate_live"] = stream_rate_live


@query("refined_trajectory")
def refined_trajectory(t):
    refined = georef.refine(t("v_pose"), t("v_fix"))
    return refined.select("trip_id", "pose_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "alt")


@query("georeference_online")
def georeference_online(t):
    """Every pose also has a fix, moved by (3, -2) m, which arrives an hour late. Times are shrunk a million times, as
    the table's poses are hours apart."""
    poses = t("v_pose").withColumn("ts_ns", F.expr("ts_ns div 1000000"))
    lat, lon, alt = geo.from_enu(F.col("vio_x") + 3, -F.col("vio_z") - 2, F.col("vio_y"), F.lit(12.97), F.lit(77.59), F.lit(900.0))
    fixes = poses.select("trip_id", F.col("pose_id").alias("fix_id"), "ts_ns", lat.alias("lat"), lon.alias("lon"), alt.alias("alt"), F.lit(3.0).alias("h_acc_m"))
    found = georef.online(georef.events_of(poses, fixes, 3_600_000))
    return found.select("trip_id", "pose_id", *[F.round(c, 3).alias(c) for c in ("east", "north", "up")], "transform_id")


def _cloud_roundtrip(kind, text):
    def run(spark, sf_dir):
        folder = new_path(spark, kind)
        points = table(spark, sf_dir, "v_landmark")
        clouds.write_clouds(points, folder, kind, text=text).write.parquet(f"{folder}/files")
        back = clouds.read_clouds(spark.read.schema("path string, n_points long").parquet(f"{folder}/files"))
        return back.select(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "confidence")])

    return run


for _kind, _text in (("ply", False), ("pcd", False), ("ply", True), ("pcd", True)):
    _name = f"{_kind}_text_roundtrip" if _text else f"{_kind}_roundtrip"
    query(_name, "select " + ", ".join(f"cast(cast({c} as float) as double) as {c}" for c in ("x", "y", "z", "confidence")) + " from v_landmark")(None)
    QUERIES[_name] = _cloud_roundtrip(_kind, _text)


def _live_events(spark, sf_dir):
    """The events as a stream, with their time `at`."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if is_folder(spark, path) else f"{sf_dir}/events.parque[t]")
    return events.withColumn("at", F.col("ts").cast("timestamp")).drop("ts")


def pose_fix_stream_join(spark, sf_dir):
    """All fixes with all poses of their trip within an hour, stream with stream."""
    live = _live_events(spark, sf_dir)
    fixes = live.select(F.col("user_id").alias("trip_id"), F.col("event_id").alias("fix_id"), F.col("at").alias("fix_at")).withWatermark("fix_at", "2 hours")
    poses = live.select(F.col("user_id").alias("pose_trip"), F.col("event_id").alias("pose_id"), F.col("at").alias("pose_at")).withWatermark("pose_at", "2 hours")
    near = F.expr("trip_id = pose_trip and pose_at between fix_at - interval 1 hour and fix_at + interval 1 hour")
    joined = fixes.join(poses, near).select("trip_id", "fix_id", "pose_id")
    folder = new_path(spark, "paired")
    joined.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(joined.schema).parquet(f"{folder}/out")


query("pose_fix_stream_join", "select f.trip_id, f.fix_id, p.pose_id from v_fix f join v_pose p on f.trip_id = p.trip_id and abs(f.ts_ns - p.ts_ns) <= 3600000000000")(None)
QUERIES["pose_fix_stream_join"] = pose_fix_stream_join


@query("detection_assets")
def detection_assets(t):
    """Every pose sees one detection in a frame of its own; trips are aligned by what their poses say of themselves."""
    c = F.col
    poses = t("v_pose").where("state = 'TRACKING'")
    detections = t("v_pose").select("trip_id", "ts_ns", c("pose_id").alias("id"), c("pose_id").alias("frame_id"), *[(c("pose_id") * k % 500 + d).cast("double").alias(n) for n, k, d in (("left_px", 31, 0), ("top_px", 17, 0), ("right_px", 31, 40), ("bottom_px", 17, 40))], F.when(c("pose_id") % 3 == 0, "POLE").otherwise("SIGN").alias("asset_class"), (c("pose_id") % 10 / 10).alias("confidence"))
    depth = F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda i: F.when((c("pose_id") + i) % 5 == 0, float("nan")).otherwise((c("pose_id") % 9 + i + 1).cast("double")).cast("float"))
    frames = t("v_pose").select(c("pose_id").alias("frame_id"), F.lit(640).alias("width"), F.lit(640).alias("height"), depth.alias("depth"), F.array(*[F.lit(x) for x in ("ROAD", "SKY", "ROAD", "WALL")]).alias("labels"))
    pairs = t("v_pose").select("trip_id", "vio_x", "vio_y", "vio_z", (-2 * c("vio_y") + 5).alias("e"), (2 * c("vio_x") - 3).alias("n"), (2 * c("vio_z") + 1).alias("u"))
    fit = solve.similarity_solve(pairs, "trip_id", ("vio_x", "vio_y", "vio_z"), ("e", "n", "u"))
    transforms = fit.select("trip_id", F.lit(0).cast("long").alias("ts_ns"), F.lit(1).cast("long").alias("transform_id"), "scale", "rotation", "translation")
    placed = perception.place(detections, frames, poses, transforms, (2, 2), (500.0, 500.0), (320.0, 320.0))
    return perception.extract_assets(placed, transforms, georef.origins(t("v_fix")), 50.0)


def _transforms(t):
    """Trips' alignment with a turned, doubled and shifted copy of themselves."""
    c = F.col
    pairs = t("v_pose").select("trip_id", "vio_x", "vio_y", "vio_z", (-2 * c("vio_y") + 5).alias("e"), (2 * c("vio_x") - 3).alias("n"), (2 * c("vio_z") + 1).alias("u"))
    return solve.similarity_solve(pairs, "trip_id", ("vio_x", "vio_y", "vio_z"), ("e", "n", "u")).select("trip_id", F.lit(0).cast("long").alias("ts_ns"), "scale", "rotation", "translation")


@query("promoted_assets")
def promoted_assets(t):
    """Landmarks tracked over all poses that were seen twice or more, on the map."""
    tracked = folds.track_assets(detections(t), 100.0)
    return session.promoted(folds.landmarks(tracked), _transforms(t), georef.origins(t("v_fix")))


_SECONDS = "ts_ns div 1000000"


@query("quality_measured")
def quality_measured(t):
    """Sessions scored by what is measured of them. Times are shrunk a million times, as the tables' rows are hours apart."""
    poses, fixes = (t(v).withColumn("ts_ns", F.expr(_SECONDS)) for v in ("v_pose", "v_fix"))
    samples = t("v_pose").select(F.col("trip_id").alias("stream_id"), F.col("pose_id").alias("seq"), F.expr(_SECONDS).alias("raw_ns"), (F.expr(_SECONDS) + F.col("pose_id") % 7 * 1_000_000).alias("arrival_ns"))
    epochs = t("v_fix").select("trip_id", (F.col("alt") - 860).alias("cn0"), (F.col("fix_id") % 20).alias("used"))
    landmarks = folds.landmarks(folds.track_assets(detections(t), 100.0))
    measured = session.measures(poses, fixes, epochs, landmarks, samples, 100_000_000, keyframe=(21_600_000, 300.0, 70.5))
    return session.quality(measured)


_OFFSETS = [(i, j, math.exp(-0.5 * (i * i + j * j))) for i in range(-3, 4) for j in range(-3, 4) if i * i + j * j <= 9]


@query("asset_density", "with o(i, j, k) as (values " + ", ".join(f"({i}, {j}, {k!r}::double)" for i, j, k in _OFFSETS) + """),
    c as (select cast(floor(x / 2) as bigint) as a, cast(floor(y / 2) as bigint) as b, sum(confidence) as w from v_landmark group by all)
    select a + i as cell_x, b + j as cell_y, round(sum(w * k), 4) as density from c cross join o group by all""")
def asset_density(t):
    """Landmarks by confidence, through a kernel of two metres in cells of two metres."""
    found = session.density(t("v_landmark"), "x", "y", 2.0, 2.0, F.col("confidence"))
    return found.select("cell_x", "cell_y", F.round("density", 4).alias("density"))


@query("georeference_anchored")
def georeference_anchored(t):
    """Poses placed by their fixes, and from each trip's second day on by anchor sets, which then count alone. Each pose of
    that day brings four points around it, and where they are: twice as far out, and moved."""
    poses = t("v_pose").withColumn("ts_ns", F.expr("ts_ns div 1000000"))
    first = poses.groupBy("trip_id").agg(F.min("ts_ns").alias("first_ns"))
    anchored = poses.join(first, "trip_id").where("ts_ns >= first_ns + 86400000")
    at = [F.col(f"vio_{c}") for c in "xyz"]
    corners = [(0.0, 0.0, 0.0), (4.0, 0.0, 0.0), (0.0, 4.0, 0.0), (0.0, 0.0, 4.0)]
    pairs = F.array(*[F.array(*[at[i] + d[i] for i in range(3)], 2 * (at[0] + d[0]) + 3, -2 * (at[2] + d[2]) - 2, 2 * (at[1] + d[1])) for d in corners])
    none = F.lit(None).cast("double")
    anchors = anchored.select("trip_id", F.col("ts_ns").alias("at_ns"), F.lit("vps").alias("kind"), F.col("pose_id").alias("id"), "ts_ns", *[none.alias(c) for c in "abc"], F.lit(False).alias("tracking"), pairs.alias("pairs"))
    fixes = t("v_fix").withColumn("ts_ns", F.expr("ts_ns div 1000000"))
    found = georef.online(georef.events_of(poses, fixes, 3_600_000).unionByName(anchors))
    return found.select("trip_id", "pose_id", *[F.round(c, 3).alias(c) for c in ("east", "north", "up")], "transform_id")


@query("trip_metadata", """select trip_id, count(*) as frames, min(ts_ns) as started_ns, max(ts_ns) as ended_ns, 'Maker' as maker, case when trip_id % 2 = 0 then 800.0::double end as fx,
    cast(count(distinct ts_ns // 86400000000000) as bigint) as segments, count(*) as received from v_pose group by trip_id""")
def trip_metadata(t):
    """Each trip's sidecar, with its stream's health and a log for each day, read back."""
    days = t("v_pose").select("trip_id", F.format_string("trip.%08d.mcap", F.expr("ts_ns div 86400000000000")).alias("segment")).distinct()
    device = F.struct(F.lit("Maker").alias("manufacturer"), F.lit("M1").alias("model"), F.lit("14").alias("osVersion"), F.lit("1.0").alias("appVersion"))
    focal = F.when(F.col("trip_id") % 2 == 0, 800.0)
    calibration = F.struct(focal.isNotNull().alias("hasCameraIntrinsics"), *[focal.alias(n) for n in ("fx", "fy", "cx", "cy")], F.lit(1920).alias("imageWidth"), F.lit(1080).alias("imageHeight"), F.lit("REALTIME").alias("cameraTimestampSource"))
    trips = t("v_pose").groupBy("trip_id").agg(F.min("ts_ns").alias("started_ns"), F.max("ts_ns").alias("ended_ns")).withColumns({"device": device, "calibration": calibration, "mp4": F.lit(None).cast("string")})
    samples = t("v_pose").select(F.col("trip_id").cast("string").alias("stream_id"), F.col("pose_id").alias("seq"), F.col("ts_ns").alias("raw_ns"), F.col("ts_ns").alias("arrival_ns"))
    none = samples.sparkSession.createDataFrame([], monitor.STATE)
    health = monitor.snapshot(monitor.advance(samples, none, 600_000_000_000)).select(F.col("stream_id").cast("long").alias("trip_id"), F.lit("pose").alias("stream_id"), F.lit("VIO").alias("source"), *("offset_ns", "rate_hz", "received", "dropped", "out_of_order", "gaps"))
    said = session.metadata(trips, health, days, t("v_pose"))
    back = said.select("trip_id", F.from_json("metadata", "frameCount bigint, startedNs bigint, endedNs bigint, device struct<manufacturer: string>, calibration struct<fx: double>, segments array<string>, syncHealth array<struct<samplesReceived: bigint>>").alias("m"))
    return back.select("trip_id", F.col("m.frameCount").alias("frames"), F.col("m.startedNs").alias("started_ns"), F.col("m.endedNs").alias("ended_ns"), F.col("m.device.manufacturer").alias("maker"), F.col("m.calibration.fx").alias("fx"), F.size("m.segments").cast("long").alias("segments"), F.get("m.syncHealth", F.lit(0))["samplesReceived"].alias("received"))

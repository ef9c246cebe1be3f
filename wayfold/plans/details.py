"""The small queries: gates, mappings, summaries, text forms, point sets, and two folds."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo, vision
from ..operators import folds, monitor, ordered
from ..operators import relational as rel
from ..sources import exports
from .registry import query
from .streams import ACCEPTED

_TRIP = "over (partition by trip_id order by ts_ns, pose_id)"

#: Landmarks that a trip's map keeps, as in the reference.
MOST_LANDMARKS = 50_000


def _trip():
    return W.partitionBy("trip_id").orderBy("ts_ns", "pose_id")


@query("optional_struct", "select id, id % 5 <> 0 as has_geo, case when id % 5 <> 0 then lat end as geo_lat, case when id % 5 <> 0 then 0.0::double end as geo_alt from v_asset")
def optional_struct(t):
    lat, alt = F.when(F.col("id") % 5 != 0, F.col("lat")), F.lit(None).cast("double")
    place = F.when(lat.isNotNull() & F.col("lon").isNotNull(), F.struct(lat.alias("lat"), "lon", F.coalesce(alt, F.lit(0.0)).alias("alt")))
    return t("v_asset").select("id", place.alias("geo")).select("id", F.col("geo").isNotNull().alias("has_geo"), F.col("geo.lat").alias("geo_lat"), F.col("geo.alt").alias("geo_alt"))


@query("geo_nonnull", "select id, lat, lon from v_asset where id % 5 <> 0")
def geo_nonnull(t):
    return t("v_asset").select("id", F.when(F.col("id") % 5 != 0, F.col("lat")).alias("lat"), "lon").where("lat is not null and lon is not null")


#: Satellite systems by code.
CONSTELLATIONS = {1: "GPS", 2: "SBAS", 3: "GLONASS", 4: "QZSS", 5: "BEIDOU", 6: "GALILEO", 7: "IRNSS"}
_SQL_CONSTELLATION = "case " + " ".join(f"when code = {k} then '{v}'" for k, v in CONSTELLATIONS.items()) + " else 'UNKNOWN' end"


def _constellation(code):
    names = F.create_map(*[F.lit(x) for pair in CONSTELLATIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code.cast("int")), F.lit("UNKNOWN"))


@query("code_maps", f"select seq, {_SQL_CONSTELLATION} as constellation from (select seq, seq % 9 as code from v_sample)")
def code_maps(t):
    return t("v_sample").select("seq", _constellation(F.col("seq") % 9).alias("constellation"))


@query("constellation_map", f"select stream_id, {_SQL_CONSTELLATION} as constellation, count(*) as n from (select stream_id, seq % 9 as code from v_sample) group by all")
def constellation_map(t):
    counts = t("v_sample").groupBy("stream_id", _constellation(F.col("seq") % 9).alias("constellation")).agg(F.count("*").alias("n"))
    maps = counts.groupBy("stream_id").agg(F.map_from_entries(F.collect_list(F.struct("constellation", "n"))).alias("by_name"))
    return maps.select("stream_id", F.explode("by_name").alias("constellation", "n"))


@query("alignment_gate", "select fix_id from v_fix where isfinite(h_acc_m) and h_acc_m <= 18 and alt / 900 between 0.5 and 2.0")
def alignment_gate(t):
    return t("v_fix").where(geo.is_finite(F.col("h_acc_m")) & (F.col("h_acc_m") <= 18) & (F.col("alt") / 900).between(0.5, 2.0)).select("fix_id")


@query("topic_routing", "select case stream_id when 'error' then '/events' when 'view' then '/camera/frames' else '/sensors/' || stream_id end as topic, count(*) as n from v_sample group by all")
def topic_routing(t):
    s = F.col("stream_id")
    topic = F.when(s == "error", "/events").when(s == "view", "/camera/frames").otherwise(F.concat(F.lit("/sensors/"), s))
    return t("v_sample").groupBy(topic.alias("topic")).agg(F.count("*").alias("n"))


@query("fix_epochs", "select ts_ns, lat, lon, h_acc_m from v_fix where h_acc_m >= 0")
def fix_epochs(t):
    fix = F.when(F.col("h_acc_m") >= 0, F.struct("lat", "lon", "h_acc_m"))
    return t("v_fix").select("ts_ns", fix.alias("fix")).where("fix is not null").select("ts_ns", "fix.*")


@query("config_valid", "select id, (id % 150 between 1 and 120) and (id % 1200 between 50 and 1000) and (id % 130 between 1 and id % 150) as valid from v_box")
def config_valid(t):
    fps, imu, perception = F.col("id") % 150, F.col("id") % 1200, F.col("id") % 130
    return t("v_box").select("id", (fps.between(1, 120) & imu.between(50, 1000) & perception.between(F.lit(1), fps)).alias("valid"))


@query("config_value", "select id, coalesce(try_cast(case when id % 2 = 0 then substr(artifact, 1, 1) else artifact end as integer), 30) as fps from v_job")
def config_value(t):
    return t("v_job").withColumn("raw", F.when(F.col("id") % 2 == 0, F.substring("artifact", 1, 1)).otherwise(F.col("artifact"))).select("id", F.coalesce(F.col("raw").try_cast("int"), F.lit(30)).alias("fps"))


@query("delegate_choice", """select id, case when id % 4 = 0 then 'CPU' when id % 4 = 2 then case when id % 50 < 35 then 'NNAPI' else 'CPU' end
    when id % 3 = 0 then 'GPU' else 'CPU' end as delegate from v_box""")
def delegate_choice(t):
    wish, gpu, level = F.element_at(F.array(*[F.lit(x) for x in ("CPU", "GPU", "NNAPI", "AUTO")]), (F.col("id") % 4 + 1).cast("int")), F.col("id") % 3 == 0, F.col("id") % 50
    made = F.when(wish.isin("GPU", "AUTO") & gpu, "GPU").when((wish == "NNAPI") & (level < 35), "NNAPI").otherwise("CPU")
    return t("v_box").select("id", made.alias("delegate"))


@query("provenance_class", "select id, case when id % 3 <> 0 then true else false end as cloud_derived, case state when 'READY' then 'done' when 'FAILED' then 'failed' when 'UPLOADING' then 'busy' when 'PROCESSING' then 'busy' else 'idle' end as display from v_job")
def provenance_class(t):
    s = F.col("state")
    shown = F.when(s == "READY", "done").when(s == "FAILED", "failed").when(s.isin("UPLOADING", "PROCESSING"), "busy").otherwise("idle")
    origin = F.when(F.col("id") % 3 == 0, "ON_DEVICE").otherwise("CLOUD")
    return t("v_job").select("id", (origin != "ON_DEVICE").alias("cloud_derived"), shown.alias("display"))


#: Export formats written here, and the job that others become.
NATIVE = ["GEOJSON", "CSV", "PLY", "PCD"]
JOBS = {"OBJ": "MVS_DENSE", "GLTF": "MVS_DENSE", "OPENDRIVE": "OPENDRIVE", "LANELET2": "LANELET2", "MBTILES": "MBTILES", "PARQUET": "SFM_REFINE"}
_ASKED = "case id % 8 " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(["GEOJSON", "CSV", *JOBS])) + " end"


def dispatch(jobs, format="format"):
    """`jobs` with state and job_type: a format that is written here is WRITTEN, any other QUEUED as a job of its type."""
    f = F.col(format)
    native = f.isin(NATIVE)
    job = F.when(f.isin("OBJ", "GLTF"), "MVS_DENSE").when(f.isin("OPENDRIVE", "LANELET2", "MBTILES"), f).otherwise("SFM_REFINE")
    return jobs.withColumns({"state": F.when(native, "WRITTEN").otherwise("QUEUED"), "job_type": F.when(~native, job)})


@query("dispatch_formats", f"select id, format, case when format in ({', '.join(repr(x) for x in NATIVE)}) then 'WRITTEN' else 'QUEUED' end as state, case " + " ".join(f"when format = '{x}' then '{y}'" for x, y in JOBS.items()) + f" end as job_type from (select id, {_ASKED} as format from v_job)")
def dispatch_formats(t):
    """Each job asks for one of the formats."""
    return dispatch(t("v_job").select("id", F.expr(_ASKED).alias("format")))


@query("upsert_trip", "select trip_id, count(*) + case when trip_id % 2 = 0 then 1 else 0 end as n from v_pose group by trip_id")
def upsert_trip(t):
    trips = t("v_pose").groupBy("trip_id").agg(F.count("*").alias("n"))
    newer = trips.where("trip_id % 2 = 0").withColumn("n", F.col("n") + 1)
    return rel.last_wins(trips.withColumn("version", F.lit(0)).unionByName(newer.withColumn("version", F.lit(1))), "trip_id", "version").drop("version")


#: Detector labels that become assets.
LABELS = {"Brand#11": "TRAFFIC_LIGHT", "Brand#22": "TRAFFIC_SIGN", "Brand#33": "POLE", "Brand#44": "POTHOLE"}


@query("label_map", "select id, case class " + " ".join(f"when '{k}' then '{v}'" for k, v in LABELS.items()) + " end as asset_class from v_box where class in (" + ", ".join(f"'{k}'" for k in LABELS) + ")")
def label_map(t):
    boxes = t("v_box")
    names = boxes.sparkSession.createDataFrame(list(LABELS.items()), "class string, asset_class string")
    return boxes.join(F.broadcast(names), "class").select("id", "asset_class")  # four rows, fixed above


@query("stream_summary_csv", """select stream_id as stream, count(*) as samples, round((count(*) - 1) * 1e9 / (max(raw_ns) - min(raw_ns)), 9) as rate_hz, cast(coalesce(sum(d // 600000000000 - 1) filter (d > 2.5 * 600000000000), 0) as bigint) as dropped
    from (select *, raw_ns - lag(raw_ns) over (partition by stream_id order by raw_ns, seq) as d from v_sample) group by stream_id having max(raw_ns) > min(raw_ns)""")
def stream_summary_csv(t):
    nominal = 600_000_000_000
    step = F.col("raw_ns") - F.col("before")
    missed = F.coalesce(F.sum(F.when(step > 2.5 * nominal, F.expr(f"(raw_ns - before) div {nominal} - 1"))), F.lit(0))
    rate = F.round((F.count("*") - 1) * 1e9 / (F.max("raw_ns") - F.min("raw_ns")), 9)
    rows = ordered.with_previous(t("v_sample"), "stream_id", ["raw_ns", "seq"], "raw_ns", "before").groupBy(F.col("stream_id").alias("stream")).agg(F.count("*").alias("samples"), rate.alias("rate_hz"), missed.alias("dropped"), (F.max("raw_ns") > F.min("raw_ns")).alias("spans")).where("spans")
    return exports.parse_csv(exports.csv_lines(rows, exports.SUMMARY), exports.SUMMARY)


@query("frame_map_csv", f"select pose_id as frame_id, ts_ns as timestamp_ns, ts_ns - first(ts_ns) {_TRIP} as video_pts_ns from v_pose")
def frame_map_csv(t):
    firsts = ordered.with_first(t("v_pose"), "trip_id", ["ts_ns", "pose_id"], {"first_ns": F.col("ts_ns")})
    rows = firsts.select(F.col("pose_id").alias("frame_id"), F.col("ts_ns").alias("timestamp_ns"), (F.col("ts_ns") - F.col("first_ns")).alias("video_pts_ns"))
    return rows.select(F.to_csv(F.struct("frame_id", "timestamp_ns", "video_pts_ns")).alias("line")).select(F.from_csv("line", "frame_id long, timestamp_ns long, video_pts_ns long").alias("r")).select("r.*")


@query("health_json", "select stream_id, count(*) as received, max(arrival_ns - raw_ns) as latency_ns from v_sample group by stream_id")
def health_json(t):
    rows = t("v_sample").groupBy("stream_id").agg(F.count("*").alias("received"), F.max(F.col("arrival_ns") - F.col("raw_ns")).alias("latency_ns"))
    text = rows.select(F.to_json(F.struct("stream_id", F.struct("received", "latency_ns").alias("health"))).alias("line"))
    return text.select(F.from_json("line", "stream_id string, health struct<received: long, latency_ns: long>").alias("r")).select("r.stream_id", "r.health.*")


@query("sorted_health", "select stream_id, count(*) as received from v_sample group by stream_id order by stream_id")
def sorted_health(t):
    return t("v_sample").groupBy("stream_id").agg(F.count("*").alias("received")).orderBy("stream_id")


@query("trip_lines", "select trip_id, count(*) as n_points, arg_min(lon, (ts_ns, fix_id)) as first_lon, arg_max(lon, (ts_ns, fix_id)) as last_lon from v_fix group by trip_id having count(*) >= 2")
def trip_lines(t):
    at = F.struct("ts_ns", "fix_id")
    return t("v_fix").groupBy("trip_id").agg(F.count("*").alias("n_points"), F.min_by("lon", at).alias("first_lon"), F.max_by("lon", at).alias("last_lon")).where("n_points >= 2")


@query("message_resolve", """with c(channel, schema_id, topic) as (values (0, 1, '/imu'), (1, 2, '/fix'), (2, 3, '/pose'), (3, 9, '/lost'), (4, 1, '/gyro')),
    s(schema_id, name) as (values (1, 'Imu'), (2, 'Fix'), (3, 'Pose'))
    select seq, topic, name from v_sample join c on seq % 6 = channel join s using (schema_id)""")
def message_resolve(t):
    messages = t("v_sample").select("seq", (F.col("seq") % 6).alias("channel"))
    spark = messages.sparkSession
    channels = spark.createDataFrame([(0, 1, "/imu"), (1, 2, "/fix"), (2, 3, "/pose"), (3, 9, "/lost"), (4, 1, "/gyro")], "channel long, schema_id int, topic string")
    schemas = spark.createDataFrame([(1, "Imu"), (2, "Fix"), (3, "Pose")], "schema_id int, name string")
    return messages.join(F.broadcast(channels), "channel").join(F.broadcast(schemas), "schema_id").select("seq", "topic", "name")


@query("late_pairing", """select fix_id, pose_id from (select f.fix_id, p.pose_id, row_number() over (partition by f.fix_id order by abs(p.at - f.ts_ns), p.at, p.pose_id) as rn
    from v_fix f join (select trip_id, pose_id, ts_ns + pose_id % 3 * 60000000 as at from v_pose where state = 'TRACKING') p on f.trip_id = p.trip_id and abs(p.at - f.ts_ns) <= 100000000) where rn = 1""")
def late_pairing(t):
    poses = t("v_pose").where("state = 'TRACKING'").withColumn("ts_ns", F.col("ts_ns") + F.col("pose_id") % 3 * 60_000_000)
    return rel.nearest_in_time(t("v_fix"), poses, "trip_id", "ts_ns", "pose_id", 100_000_000).where("matched_id is not null").select("fix_id", F.col("matched_id").alias("pose_id"))


@query("landmark_latest_capped", f"""select trip_id, l_partkey, x from (select trip_id, l_partkey, arg_max(x, (l_orderkey * 10 + l_linenumber, x)) as x,
    row_number() over (partition by trip_id order by min(l_orderkey * 10 + l_linenumber) desc, l_partkey desc) as rn from v_landmark group by trip_id, l_partkey) where rn <= {MOST_LANDMARKS}""")
def landmark_latest_capped(t):
    return latest_capped(t("v_landmark"))


def latest_capped(landmarks, cap=MOST_LANDMARKS):
    """The latest version of each landmark; a trip's map keeps the `cap` that were founded last.
    Equal versions go to the higher x, equal ages to the higher landmark."""
    seen = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    latest = landmarks.groupBy("trip_id", "l_partkey").agg(F.max_by("x", F.struct(seen, "x")).alias("x"), F.min(seen).alias("founded"))
    return latest.withColumn("rn", F.row_number().over(W.partitionBy("trip_id").orderBy(F.col("founded").desc(), F.col("l_partkey").desc()))).where(F.col("rn") <= cap).select("trip_id", "l_partkey", "x")


@query("drain_rate", """select stream_id, seq, round(case when h < 0.001 then 0 else (f - value) / h end, 6) as percent_per_hour from (select *, (raw_ns - first(raw_ns) over w) / 3.6e12 as h, first(value) over w as f
    from v_sample window w as (partition by stream_id order by raw_ns, seq))""")
def drain_rate(t):
    firsts = ordered.with_first(t("v_sample"), "stream_id", ["raw_ns", "seq"], {"first_ns": F.col("raw_ns"), "first_value": F.col("value")})
    hours = (F.col("raw_ns") - F.col("first_ns")) / 3.6e12
    return firsts.select("stream_id", "seq", hours.alias("h"), (F.col("first_value") - F.col("value")).alias("d")).select("stream_id", "seq", F.round(F.when(F.col("h") < 0.001, 0.0).otherwise(F.col("d") / F.col("h")), 6).alias("percent_per_hour"))


@query("similarity_apply", "select pose_id, -2 * vio_y + 5 as east, 2 * vio_x - 3 as north, 2 * vio_z + 1 as up from v_pose")
def similarity_apply(t):
    """Scale 2, a quarter turn about the third axis, and a shift."""
    turn, shift = ((0.0, -1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0)), (5.0, -3.0, 1.0)
    p = [F.col(c) for c in ("vio_x", "vio_y", "vio_z")]
    row = lambda i: 2.0 * (turn[i][0] * p[0] + turn[i][1] * p[1] + turn[i][2] * p[2]) + shift[i]
    return t("v_pose").select("pose_id", row(0).alias("east"), row(1).alias("north"), row(2).alias("up"))


@query("rotvec_w", "select pose_id, round(sqrt(greatest(0, 1 - x*x - y*y - z*z)), 9) as w from (select pose_id, vio_x / 1000 as x, vio_y / 1000 as y, vio_z / 1000 as z from v_pose)")
def rotvec_w(t):
    x, y, z = (F.col(c) / 1000 for c in ("vio_x", "vio_y", "vio_z"))
    return t("v_pose").select("pose_id", F.round(F.sqrt(F.greatest(F.lit(0.0), 1 - x * x - y * y - z * z)), 9).alias("w"))


@query("relative_odometry", f"""select pose_id, round(cos(h) * dx + sin(h) * dy, 6) as forward, round(cos(h) * dy - sin(h) * dx, 6) as aside from
    (select pose_id, radians(pose_id % 360) as h, lead(vio_x) {_TRIP} - vio_x as dx, lead(-vio_z) {_TRIP} + vio_z as dy from v_pose) where dx is not null""")
def relative_odometry(t):
    h, x, y = F.radians(F.col("pose_id") % 360), F.col("vio_x"), -F.col("vio_z")
    moved = t("v_pose").select("pose_id", h.alias("h"), (F.lead("vio_x").over(_trip()) - x).alias("dx"), (-F.lead("vio_z").over(_trip()) - y).alias("dy")).where("dx is not null")
    c, s = F.cos("h"), F.sin("h")
    return moved.select("pose_id", F.round(c * F.col("dx") + s * F.col("dy"), 6).alias("forward"), F.round(c * F.col("dy") - s * F.col("dx"), 6).alias("aside"))


@query("fit_distance", "select seq, case when value - 50 > 0 then round(least(200, greatest(1, 1.2 * (value - 50) / sin(radians(25)))), 6) end as distance from v_sample")
def fit_distance(t):
    r = F.col("value") - 50
    return t("v_sample").select("seq", F.when(geo.is_finite(r) & (r > 0), F.round(geo.clamp(1.2 * r / math.sin(math.radians(25)), 1.0, 200.0), 6)).alias("distance"))


@query("trip_labels", "select trip_id, printf('%.0f s, %.1f m', cast((max(ts_ns) - min(ts_ns)) // 1000000000 as double), count(*) / 3.0::double) as label from v_pose group by trip_id")
def trip_labels(t):
    seconds = F.expr("cast((max(ts_ns) - min(ts_ns)) div 1000000000 as double)")
    return t("v_pose").groupBy("trip_id").agg(F.format_string("%.0f s, %.1f m", seconds, F.count("*") / F.lit(3.0)).alias("label"))


@query("label_fallback", "select id, case when id % 7 = 0 then 'unknown' else asset_class end as label from v_asset")
def label_fallback(t):
    given = F.when(F.col("id") % 7 == 0, "").otherwise(F.col("asset_class"))
    return t("v_asset").select("id", F.coalesce(F.nullif(given, F.lit("")), F.lit("unknown")).alias("label"))


@query("finite_or_default", "select fix_id, case when fix_id % 6 = 0 then -1 else h_acc_m end as accuracy from v_fix")
def finite_or_default(t):
    bad = F.when(F.col("fix_id") % 12 == 0, float("nan")).when(F.col("fix_id") % 12 == 6, float("inf")).otherwise(F.col("h_acc_m"))
    return t("v_fix").select("fix_id", bad.alias("raw")).select("fix_id", F.when(geo.is_finite(F.col("raw")), F.col("raw")).otherwise(-1.0).alias("accuracy"))


@query("vertex_buffer", "select v.trip_id, l_orderkey, l_linenumber, round(x - mx, 9) as vx, round(y - my, 9) as vy, round(z - mz, 9) as vz from v_landmark v join (select trip_id, avg(x) as mx, avg(y) as my, avg(z) as mz from v_landmark group by trip_id) c on v.trip_id = c.trip_id")
def vertex_buffer(t):
    points = t("v_landmark")
    centres = points.groupBy("trip_id").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    return points.join(centres, "trip_id").select("trip_id", "l_orderkey", "l_linenumber", *[F.round(F.col(c) - F.col(f"m{c}"), 9).alias(f"v{c}") for c in "xyz"])


@query("counter_poll", "select seq, value from v_sample where seq > 100 order by seq")
def counter_poll(t):
    """All records whose counter is beyond the last one seen, in order."""
    return t("v_sample").where("seq > 100").select("seq", "value").orderBy("seq")


@query("epoch_enrich", "select stream_id, seq, coalesce(last_value(case when seq % 4 = 0 then value end ignore nulls) over (partition by stream_id order by raw_ns, seq rows between unbounded preceding and current row), -1) as sats from v_sample")
def epoch_enrich(t):
    known = ordered.with_last_known(t("v_sample"), "stream_id", ["raw_ns", "seq"], F.when(F.col("seq") % 4 == 0, F.col("value")), "sats")
    return known.select("stream_id", "seq", F.coalesce("sats", F.lit(-1.0)).alias("sats"))


@query("probe_points", """with u as (select *, row_number() over (partition by trip_id order by ts_ns, fix_id) as rn from v_fix where h_acc_m between 0 and 15)
    select fix_id, axis, case axis when 1 then 5.0::double else 0 end as dx, case axis when 2 then 5.0::double else 0 end as dy, case axis when 3 then 5.0::double else 0 end as dz from u, (values (0), (1), (2), (3)) a(axis) where rn % 15 = 0""")
def probe_points(t):
    """The place itself and 5 m along each axis, at every fifteenth usable fix."""
    used = ordered.numbered(t("v_fix").where(F.col("h_acc_m").between(0, 15)), "trip_id", ["ts_ns", "fix_id"], "n").where("(n + 1) % 15 = 0")
    probes = F.array(*[F.struct(F.lit(i).alias("axis"), *[F.lit(5.0 if i == k else 0.0).alias(c) for k, c in ((1, "dx"), (2, "dy"), (3, "dz"))]) for i in range(4)])
    return used.select("fix_id", F.inline(probes))


@query("flatten_points", "select 'fix' as kind, trip_id, lat, lon from v_fix union all select 'asset', trip_id, lat, lon from v_asset")
def flatten_points(t):
    part = lambda v, kind: t(v).select(F.lit(kind).alias("kind"), F.col("trip_id").cast("long").alias("trip_id"), "lat", "lon")
    return part("v_fix", "fix").unionByName(part("v_asset", "asset"))


@query("argmin_area", "select frame_id, arg_min(id, (abs((right_px - left_px) * (bottom_px - top_px) - 900), id)) as id from v_box group by frame_id")
def argmin_area(t):
    off = F.abs((F.col("right_px") - F.col("left_px")) * (F.col("bottom_px") - F.col("top_px")) - 900)
    return t("v_box").groupBy("frame_id").agg(F.min_by("id", F.struct(off.alias("off"), "id")).alias("id"))


@query("landmark_geo_asof", """select fix_id, max(lat) + arg_max(pose_id, (p_ns, pose_id)) % 7 as lat from (select f.fix_id, f.lat, p.pose_id, p.ts_ns as p_ns from v_fix f
    left join v_pose p on p.trip_id = f.trip_id and p.ts_ns <= f.ts_ns - (f.fix_id % 5) * 1000000000) group by fix_id""")
def landmark_geo_asof(t):
    """Each point is placed by the alignment that was current at its time; null before the first. Every pose makes an
    alignment, and points are some seconds older than their poses."""
    points = t("v_fix").withColumn("ts_ns", F.col("ts_ns") - F.col("fix_id") % 5 * 1_000_000_000)
    placed = rel.latest_before(points, t("v_pose"), "trip_id", "ts_ns", "pose_id")
    return placed.select("fix_id", (F.col("lat") + F.col("matched_id") % 7).alias("lat"))


_A, _FLAT = "6378137.0::double", "(1 / 298.257223563::double)"
_E2 = f"({_FLAT} * (2 - {_FLAT}))"


def _sql_from_enu(rows: str, keys: str) -> str:
    """SQL for WGS84 places of `rows` (keys, e, n, u) around 12.97, 77.59, 900."""
    la, lo, h = "radians(12.97::double)", "radians(77.59::double)", "900.0::double"
    r = f"({_A} / sqrt(1 - {_E2} * sin({la}) * sin({la})))"
    b = f"({_A} * (1 - {_FLAT}))"
    return f"""with g as ({rows}),
    k as (select *, ({r} + {h}) * cos({la}) * cos({lo}) - sin({lo}) * e - sin({la}) * cos({lo}) * n + cos({la}) * cos({lo}) * u as gx,
      ({r} + {h}) * cos({la}) * sin({lo}) + cos({lo}) * e - sin({la}) * sin({lo}) * n + cos({la}) * sin({lo}) * u as gy,
      ({r} * (1 - {_E2}) + {h}) * sin({la}) + cos({la}) * n + sin({la}) * u as gz from g),
    o as (select *, sqrt(gx * gx + gy * gy) as p, atan2(gz * {_A}, sqrt(gx * gx + gy * gy) * {b}) as th from k)
    select {keys}, round(degrees(atan2(gz + ({_A} * {_A} - {b} * {b}) / ({b} * {b}) * {b} * pow(sin(th), 3), p - {_E2} * {_A} * pow(cos(th), 3))), 7) as lat, round(degrees(atan2(gy, gx)), 7) as lon from o"""


def _place(e, n, u):
    lat, lon, _ = geo.from_enu(e, n, u, F.lit(12.97), F.lit(77.59), F.lit(900.0))
    return F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon")


@query("wgs84_pose", _sql_from_enu("select pose_id, vio_x as e, -vio_z as n, vio_y as u from v_pose", "pose_id"))
def wgs84_pose(t):
    return t("v_pose").select("pose_id", *_place(F.col("vio_x"), -F.col("vio_z"), F.col("vio_y")))


@query("asset_snapshot", _sql_from_enu("select trip_id, pose_id % 5 as track, count(*) as seen, avg(vio_x) as e, -avg(vio_z) as n, 0.0::double as u from v_pose group by all having count(*) >= 2", "trip_id, track, seen"))
def asset_snapshot(t):
    """Tracks seen twice or more, at the place of their mean."""
    tracks = t("v_pose").groupBy("trip_id", (F.col("pose_id") % 5).alias("track")).agg(F.count("*").alias("seen"), F.avg("vio_x").alias("e"), (-F.avg("vio_z")).alias("n")).where("seen >= 2")
    return tracks.select("trip_id", "track", "seen", *_place(F.col("e"), F.col("n"), F.lit(0.0)))


_CORNERS = [(-0.25, -0.25, 0.5), (0.25, -0.25, 0.5), (0.25, 0.25, 0.5), (-0.25, 0.25, 0.5)]
_SEGMENTS = [((0.0, 0.0, 0.0), c) for c in _CORNERS] + list(zip(_CORNERS, _CORNERS[1:] + _CORNERS[:1], strict=True))


@query("frustum_lines", "with s(segment, ax, ay, az, bx, b_y, bz) as (values " + ", ".join(f"({i}, {', '.join(f'{x}::double' for x in (*a, *b))})" for i, (a, b) in enumerate(_SEGMENTS)) + """)
    select pose_id, segment, vio_x - ay as x0, vio_y + ax as y0, vio_z + az as z0, vio_x - b_y as x1, vio_y + bx as y1, vio_z + bz as z1 from v_pose, s""")
def frustum_lines(t):
    """Eight edges of a viewing pyramid at each pose, turned a quarter about the third axis."""
    q = (F.lit(0.0), F.lit(0.0), F.lit(math.sqrt(0.5)), F.lit(math.sqrt(0.5)))
    at = [F.col(c) for c in ("vio_x", "vio_y", "vio_z")]

    def end(v, n):
        turned = vision.rotate(q, tuple(F.lit(x) for x in v))
        return [F.round(turned[i] + at[i], 6).alias(f"{c}{n}") for i, c in enumerate("xyz")]

    lines = F.array(*[F.struct(F.lit(i).alias("segment"), *end(a, 0), *end(b, 1)) for i, (a, b) in enumerate(_SEGMENTS)])
    return t("v_pose").select("pose_id", F.inline(lines))


@query("stream_warnings", f"""with recursive {ACCEPTED}, r as (
    select stream_id, seq, rn, k, cast(late as double) as ema, cast(null as bigint) as base, cast(null as bigint) as tl, cast(null as bigint) as td, false as late_now, false as drifts from a where k = 1
    union all select stream_id, seq, rn, k, ema, base, case when l then rn - 1 else tl end, case when d then rn - 1 else td end, l, d from (
      select *, late > 5000000 and (tl is null or rn - 1 - tl >= 64) as l, coalesce(abs(cast(trunc(ema) as bigint) - base) > 1000000, false) and (td is null or rn - 1 - td >= 64) as d from (
        select * replace (case when base is null and rn > 32 then cast(trunc(ema) as bigint) else base end as base) from (
          select a.stream_id, a.seq, a.rn, a.k, a.late, r.base, r.tl, r.td, r.ema + cast(0.05 as double) * (cast(a.late as double) - r.ema) as ema from r join a on a.stream_id = r.stream_id and a.k = r.k + 1))))
    select stream_id, seq, late_now as late, drifts from r where late_now or drifts""")
def stream_warnings(t):
    return monitor.warnings(t("v_sample"), 5_000_000, 1_000_000)


_Q_TURN = "degrees(2 * acos(least(1, abs(qx * lag(qx) over w + qy * lag(qy) over w + qz * lag(qz) over w + qw * lag(qw) over w))))"


@query("capture_health_ema", f"""with recursive p as (select trip_id, pose_id, row_number() over w as rn, ts_ns // 100 - lag(ts_ns // 100) over w as dt, {_Q_TURN} as a,
      sqrt(pow(vio_x - lag(vio_x) over w, 2) + pow(vio_y - lag(vio_y) over w, 2) + pow(vio_z - lag(vio_z) over w, 2)) as d from v_pose window w as (partition by trip_id order by ts_ns, pose_id)),
    q as (select *, coalesce(dt > 0 and dt <= 216000000000, false) as ok from p),
    r as (select trip_id, pose_id, rn, 0.0::double as ema, 0.0::double as turn, false as ok from q where rn = 1
      union all select q.trip_id, q.pose_id, q.rn, case when q.ok then 0.8 * r.ema + 0.2 * (q.d / (q.dt / 1e9)) else r.ema end, case when q.ok then 0.8 * r.turn + 0.2 * (q.a / (q.dt / 1e9)) else r.turn end, q.ok from r join q on q.trip_id = r.trip_id and q.rn = r.rn + 1)
    select trip_id, pose_id, round(ema, 6) as speed, round(turn, 3) as turn_dps, turn > 25 and ema < 0.35 as turns_on_spot, ema > 5 as too_fast from r where ok""")
def capture_health_ema(t):
    """Times are shrunk a hundred times, as the table's poses are hours apart."""
    found = folds.capture_health(t("v_pose").withColumn("ts_ns", F.expr("ts_ns div 100")), 216_000_000_000)
    return found.select("trip_id", "pose_id", F.round("speed", 6).alias("speed"), F.round("turn_dps", 3).alias("turn_dps"), "turns_on_spot", "too_fast")

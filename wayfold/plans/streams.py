"""Stream health, trajectories, joins in time, detections and point clouds."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo, vision
from ..operators import folds, monitor, ordered
from ..operators import relational as rel
from .registry import query
from .store import sql_dist



def _trip():
    return W.partitionBy("trip_id").orderBy("ts_ns", "pose_id")


def _fix():
    return W.partitionBy("trip_id").orderBy("ts_ns", "fix_id")


_LAG = "lag({c}) over (partition by trip_id order by ts_ns, pose_id)"


_ARRIVAL, _TIME = ["arrival_ns", "seq"], ["raw_ns", "seq"]


@query("stream_out_of_order", "select stream_id, count(*) filter (raw_ns < top) as out_of_order, count(*) as received from (select *, max(raw_ns) over (partition by stream_id order by arrival_ns, seq rows between unbounded preceding and 1 preceding) as top from v_sample) group by stream_id")
def stream_out_of_order(t):
    topped = ordered.with_running_max(t("v_sample"), "stream_id", _ARRIVAL, "raw_ns", "top")
    return topped.groupBy("stream_id").agg(F.count_if(F.col("raw_ns") < F.col("top")).alias("out_of_order"), F.count("*").alias("received"))


@query("stream_gaps", "select stream_id, count(*) filter (d > 2.5 * 600000000000) as gaps, cast(coalesce(sum(d // 600000000000 - 1) filter (d > 2.5 * 600000000000), 0) as bigint) as missed from (select stream_id, raw_ns - lag(raw_ns) over (partition by stream_id order by raw_ns, seq) as d from v_sample) group by stream_id")
def stream_gaps(t):
    nominal = 600_000_000_000
    gap = F.col("d") > 2.5 * nominal
    stepped = ordered.with_previous(t("v_sample"), "stream_id", _TIME, "raw_ns", "before").select("stream_id", (F.col("raw_ns") - F.col("before")).alias("d"))
    return stepped.groupBy("stream_id").agg(F.count_if(gap).alias("gaps"), F.coalesce(F.sum(F.when(gap, F.expr(f"d div {nominal} - 1"))), F.lit(0)).alias("missed"))


@query("stream_rate64", "select stream_id, seq, round(case when m > 1 and raw_ns > f then (m - 1) * 1e9 / (raw_ns - f) else 0 end, 9) as rate_hz from (select *, count(*) over w as m, first(raw_ns) over w as f from v_sample window w as (partition by stream_id order by raw_ns, seq rows between 63 preceding and current row))")
def stream_rate64(t):
    rows = ordered.with_nth_before(t("v_sample"), "stream_id", _TIME, 63, "raw_ns", "from_ns")
    span = F.col("raw_ns") - F.col("from_ns")
    rate = F.when((F.col("n_before") > 0) & (span > 0), F.col("n_before") * 1e9 / span).otherwise(0.0)
    return rows.select("stream_id", "seq", F.round(rate, 9).alias("rate_hz"))


_OFFSETS = "(select stream_id, arg_min(arrival_ns - raw_ns, (arrival_ns, seq)) as offset_ns from v_sample group by stream_id)"


def _offset(t):
    return ordered.with_first(t("v_sample"), "stream_id", _ARRIVAL, {"offset_ns": F.col("arrival_ns") - F.col("raw_ns")})


@query("stream_latency", f"select stream_id, max(l) as max_ns, min(l) as min_ns, count(*) filter (l > 5000000) as high from (select stream_id, arrival_ns - raw_ns - offset_ns as l from v_sample join {_OFFSETS} using (stream_id)) group by stream_id")
def stream_latency(t):
    """Arrival less the sample's own time, moved by the stream's offset."""
    late = _offset(t).select("stream_id", (F.col("arrival_ns") - F.col("raw_ns") - F.col("offset_ns")).alias("late"))
    return late.groupBy("stream_id").agg(F.max("late").alias("max_ns"), F.min("late").alias("min_ns"), F.count_if(F.col("late") > 5_000_000).alias("high"))


@query("stream_offset", "select stream_id, arg_min(arrival_ns - raw_ns, (arrival_ns, seq)) as offset_ns from v_sample group by stream_id")
def stream_offset(t):
    return t("v_sample").groupBy("stream_id").agg(F.min_by(F.col("arrival_ns") - F.col("raw_ns"), F.struct("arrival_ns", "seq")).alias("offset_ns"))


@query("normalised_ts", f"select s.stream_id, s.seq, s.raw_ns + o.offset_ns as ts_ns from v_sample s join {_OFFSETS} o using (stream_id)")
def normalised_ts(t):
    return _offset(t).select("stream_id", "seq", (F.col("raw_ns") + F.col("offset_ns")).alias("ts_ns"))


_NUMBERED = "n as (select *, row_number() over (partition by stream_id order by raw_ns, seq) as rn from v_sample)"


#: Samples in order of arrival with their stream's offset; those that are not before the newest one, numbered by k.
ACCEPTED = """n as (select *, row_number() over w as rn, first(arrival_ns - raw_ns) over w as off,
        max(raw_ns) over (partition by stream_id order by arrival_ns, seq rows between unbounded preceding and 1 preceding) as top
      from v_sample window w as (partition by stream_id order by arrival_ns, seq)),
    a as (select *, arrival_ns - raw_ns - off as late, row_number() over (partition by stream_id order by rn) as k from n where top is null or raw_ns >= top)"""


@query("stream_drift_ema", f"""with recursive {ACCEPTED}, e as (
    select stream_id, seq, k, cast(late as double) as ema, cast(null as bigint) as base from a where k = 1
    union all select stream_id, seq, k, ema, case when base is null and rn > 32 then cast(trunc(ema) as bigint) else base end from (
      select a.stream_id, a.seq, a.k, a.rn, e.base, e.ema + cast(0.05 as double) * (cast(a.late as double) - e.ema) as ema from e join a on a.stream_id = e.stream_id and a.k = e.k + 1))
    select stream_id, seq, case when base is null then 0 else cast(trunc(ema) as bigint) - base end as drift_ns from e""")
def stream_drift_ema(t):
    return monitor.drift(t("v_sample"))


_GAP = 3_600_000_000_000


@query("cadence_throttle", f"""with recursive {_NUMBERED}, k as (
    select stream_id, seq, rn, raw_ns, raw_ns as last_ns, true as ok from n where rn = 1
    union all select n.stream_id, n.seq, n.rn, n.raw_ns, case when n.raw_ns - k.last_ns >= {_GAP} then n.raw_ns else k.last_ns end, n.raw_ns - k.last_ns >= {_GAP}
    from k join n on n.stream_id = k.stream_id and n.rn = k.rn + 1)
    select stream_id, seq, raw_ns from k where ok""")
def cadence_throttle(t):
    return folds.throttle(t("v_sample"), _GAP)


_TURN = "degrees(2 * acos(least(1, abs({a}.qx*{b}.qx + {a}.qy*{b}.qy + {a}.qz*{b}.qz + {a}.qw*{b}.qw))))"


@query("keyframes", f"""with recursive p as (select *, row_number() over (partition by trip_id order by ts_ns, pose_id) as rn from v_pose where state = 'TRACKING'), k as (
    select trip_id, pose_id, ts_ns, rn, true as ok, {{'t': ts_ns, 'x': vio_x, 'y': vio_y, 'z': vio_z, 'qx': qx, 'qy': qy, 'qz': qz, 'qw': qw}} as l from p where rn = 1
    union all select trip_id, pose_id, ts_ns, rn, ok, case when ok then here else l end from (
      select p.trip_id, p.pose_id, p.ts_ns, p.rn, k.l, {{'t': p.ts_ns, 'x': p.vio_x, 'y': p.vio_y, 'z': p.vio_z, 'qx': p.qx, 'qy': p.qy, 'qz': p.qz, 'qw': p.qw}} as here,
        p.ts_ns - k.l.t >= 21600000000000 and (sqrt((p.vio_x-k.l.x)*(p.vio_x-k.l.x)+(p.vio_y-k.l.y)*(p.vio_y-k.l.y)+(p.vio_z-k.l.z)*(p.vio_z-k.l.z)) >= 300 or {_TURN.format(a='p', b='k.l')} >= 70.5) as ok
      from k join p on p.trip_id = k.trip_id and p.rn = k.rn + 1))
    select trip_id, pose_id, ts_ns from k where ok""")
def keyframes(t):
    return folds.keyframes(t("v_pose"), 6 * 3600 * 10**9, 300.0, 70.5)


@query("last_per_window", "select stream_id, raw_ns // 3600000000000 as hour, arg_max(value, (raw_ns, seq)) as value from v_sample group by all")
def last_per_window(t):
    return t("v_sample").groupBy("stream_id", F.expr("raw_ns div 3600000000000").alias("hour")).agg(F.max_by("value", F.struct("raw_ns", "seq")).alias("value"))


@query("stream_snapshot", "select stream_id, count(*) as received, min(raw_ns) as first_ns, max(raw_ns) as last_ns, max(arrival_ns - raw_ns) as latency_ns from v_sample group by stream_id")
def stream_snapshot(t):
    return t("v_sample").groupBy("stream_id").agg(F.count("*").alias("received"), F.min("raw_ns").alias("first_ns"), F.max("raw_ns").alias("last_ns"), F.max(F.col("arrival_ns") - F.col("raw_ns")).alias("latency_ns"))


@query("stats_by_topic", "select stream_id as topic, count(*) as n, min(raw_ns) as start_ns, max(raw_ns) as end_ns from v_sample group by stream_id")
def stats_by_topic(t):
    return t("v_sample").groupBy(F.col("stream_id").alias("topic")).agg(F.count("*").alias("n"), F.min("raw_ns").alias("start_ns"), F.max("raw_ns").alias("end_ns"))


@query("sequence_numbers", "select stream_id, seq, row_number() over (partition by stream_id order by raw_ns, seq) - 1 as sequence from v_sample")
def sequence_numbers(t):
    return ordered.numbered(t("v_sample"), "stream_id", _TIME, "sequence").select("stream_id", "seq", "sequence")


@query("last_n_warnings", "select stream_id, seq from v_sample where value > 50 qualify row_number() over (partition by stream_id order by raw_ns desc, seq desc) <= 6")
def last_n_warnings(t):
    return ordered.last_rows(t("v_sample").where("value > 50"), "stream_id", _TIME, 6).select("stream_id", "seq")


@query("every_nth", "select trip_id, pose_id from v_pose where state = 'TRACKING' qualify row_number() over (partition by trip_id order by ts_ns, pose_id) % 10 = 0")
def every_nth(t):
    tracking = ordered.numbered(t("v_pose").where("state = 'TRACKING'"), "trip_id", ["ts_ns", "pose_id"], "n")
    return tracking.where("(n + 1) % 10 = 0").select("trip_id", "pose_id")


@query("union_topics", "select 'fix' as topic, ts_ns, fix_id as id, lat, cast(null as double) as vio_x from v_fix union all select 'pose', ts_ns, pose_id, null, vio_x from v_pose")
def union_topics(t):
    fixes = t("v_fix").select(F.lit("fix").alias("topic"), "ts_ns", F.col("fix_id").alias("id"), "lat")
    return fixes.unionByName(t("v_pose").select(F.lit("pose").alias("topic"), "ts_ns", F.col("pose_id").alias("id"), "vio_x"), allowMissingColumns=True)


@query("distinct_points", "select distinct lat, lon from v_fix")
def distinct_points(t):
    return t("v_fix").select("lat", "lon").dropDuplicates()


@query("haversine_path", f"select trip_id, round(coalesce(sum({sql_dist('la', 'lo', 'lat', 'lon')}), 0), 3) as metres from (select *, lag(lat) over w as la, lag(lon) over w as lo from v_fix window w as (partition by trip_id order by ts_ns, fix_id)) group by trip_id")
def haversine_path(t):
    step = geo.haversine_m(F.lag("lat").over(_fix()), F.lag("lon").over(_fix()), F.col("lat"), F.col("lon"), clamped=True)
    return t("v_fix").select("trip_id", step.alias("d")).groupBy("trip_id").agg(F.round(F.coalesce(F.sum("d"), F.lit(0.0)), 3).alias("metres"))


def _planar(now):
    return F.sqrt(sum(((F.col(c) - F.lag(c).over(now)) * (F.col(c) - F.lag(c).over(now)) for c in ("vio_x", "vio_z")), F.lit(0.0)))


@query("planar_path", f"select trip_id, round(coalesce(sum(sqrt(pow(vio_x - lx, 2) + pow(vio_z - lz, 2))), 0), 4) as metres from (select *, {_LAG.format(c='vio_x')} as lx, {_LAG.format(c='vio_z')} as lz from v_pose) group by trip_id")
def planar_path(t):
    return t("v_pose").select("trip_id", _planar(_trip()).alias("d")).groupBy("trip_id").agg(F.round(F.coalesce(F.sum("d"), F.lit(0.0)), 4).alias("metres"))


@query("path_tracking_breaks", f"select trip_id, round(coalesce(sum(sqrt(pow(vio_x - lx, 2) + pow(vio_y - ly, 2) + pow(vio_z - lz, 2))) filter (state = 'TRACKING' and ls = 'TRACKING'), 0), 4) as metres from (select *, {_LAG.format(c='vio_x')} as lx, {_LAG.format(c='vio_y')} as ly, {_LAG.format(c='vio_z')} as lz, {_LAG.format(c='state')} as ls from v_pose) group by trip_id")
def path_tracking_breaks(t):
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(_trip())) * (F.col(c) - F.lag(c).over(_trip())) for c in ("vio_x", "vio_y", "vio_z")), F.lit(0.0)))
    both = (F.col("state") == "TRACKING") & (F.lag("state").over(_trip()) == "TRACKING")
    return t("v_pose").select("trip_id", F.when(both, step).alias("d")).groupBy("trip_id").agg(F.round(F.coalesce(F.sum("d"), F.lit(0.0)), 4).alias("metres"))


@query("kinematics", f"""select c.pose_id, round(case when dt > 0 then sqrt(pow(c.vio_x - c.l.x, 2) + pow(c.vio_y - c.l.y, 2) + pow(c.vio_z - c.l.z, 2)) / (dt / 1e9) when dt <= 0 then 0 end, 6) as speed_mps,
    round(case when dt > 0 then {_TURN.format(a='c', b='c.l')} / (dt / 1e9) when dt <= 0 then 0 end, 6) as turn_dps
    from (select *, ts_ns - lag(ts_ns) over w as dt, lag({{'x': vio_x, 'y': vio_y, 'z': vio_z, 'qx': qx, 'qy': qy, 'qz': qz, 'qw': qw}}) over w as l from v_pose window w as (partition by trip_id order by ts_ns, pose_id)) c""")
def kinematics(t):
    """Speed and rate of turning from the pose before; none for a trip's first, zero where no time has passed."""
    before = lambda c: F.lag(c).over(_trip())
    moved = F.sqrt(sum(((F.col(c) - before(c)) * (F.col(c) - before(c)) for c in ("vio_x", "vio_y", "vio_z")), F.lit(0.0)))
    q = ("qx", "qy", "qz", "qw")
    rows = t("v_pose").select("pose_id", (F.col("ts_ns") - before("ts_ns")).alias("dt"), moved.alias("d"), vision.angle_deg([F.col(c) for c in q], [before(c) for c in q]).alias("turned"))
    rate = lambda c: F.round(F.when(F.col("dt") > 0, F.col(c) / (F.col("dt") / 1e9)).when(F.col("dt") <= 0, 0.0), 6)
    return rows.select("pose_id", rate("d").alias("speed_mps"), rate("turned").alias("turn_dps"))


@query("heading_edges", "select pose_id, round(coalesce(h, lag(h) over w), 6) as heading from (select *, atan2(-(lead(vio_z) over w) + vio_z, lead(vio_x) over w - vio_x) as h from v_pose window w as (partition by trip_id order by ts_ns, pose_id)) window w as (partition by trip_id order by ts_ns, pose_id)")
def heading_edges(t):
    turn = F.atan2(-F.lead("vio_z").over(_trip()) + F.col("vio_z"), F.lead("vio_x").over(_trip()) - F.col("vio_x"))
    return t("v_pose").withColumn("h", turn).select("pose_id", F.round(F.coalesce("h", F.lag("h").over(_trip())), 6).alias("heading"))


_TOL = 3_600_000_000_000
_SHIFT_ALL = "(select trip_id, fix_id, ts_ns + (fix_id % 7) * 1000000000 as ts_ns from v_fix)"


def _shifted(t):
    return t("v_fix").select("trip_id", "fix_id", (F.col("ts_ns") + F.col("fix_id") % 7 * 1_000_000_000).alias("ts_ns"))


@query("nearest_pose_100ms", f"select f.trip_id, f.fix_id, f.ts_ns, arg_min(p.pose_id, (abs(p.ts_ns - f.ts_ns), p.ts_ns, p.pose_id)) as pose_id from {_SHIFT_ALL} f left join v_pose p on p.trip_id = f.trip_id and abs(p.ts_ns - f.ts_ns) <= {_TOL} group by all")
def nearest_pose_100ms(t):
    """The tolerance is an hour here, as the tables' events lie minutes apart; fixes are shifted by some seconds."""
    found = rel.nearest_in_time(_shifted(t), t("v_pose").select("trip_id", "ts_ns", "pose_id"), "trip_id", "ts_ns", "pose_id", _TOL)
    return found.select("trip_id", "fix_id", "ts_ns", F.col("matched_id").alias("pose_id"))


@query("latest_pose_asof", f"select f.trip_id, f.fix_id, f.ts_ns, arg_max(p.pose_id, (p.ts_ns, p.pose_id)) as pose_id from {_SHIFT_ALL} f left join v_pose p on p.trip_id = f.trip_id and p.ts_ns <= f.ts_ns group by all")
def latest_pose_asof(t):
    found = rel.latest_before(_shifted(t), t("v_pose").select("trip_id", "ts_ns", "pose_id"), "trip_id", "ts_ns", "pose_id")
    return found.select("trip_id", "fix_id", "ts_ns", F.col("matched_id").alias("pose_id"))


@query("sliding_pairs_600", "select trip_id, fix_id from v_fix qualify row_number() over (partition by trip_id order by ts_ns desc, fix_id desc) <= 600")
def sliding_pairs_600(t):
    return ordered.last_rows(t("v_fix"), "trip_id", ["ts_ns", "fix_id"], 600).select("trip_id", "fix_id")


def _origin(df):
    w = W.partitionBy("trip_id").orderBy("ts_ns", "fix_id")
    return df.select("*", *[F.first(c).over(w).alias(f"{c}0") for c in ("lat", "lon", "alt")])


_ECEF = "(6378137.0::double / sqrt(1 - e2 * sin(radians({a})) * sin(radians({a}))))"


@query("geo_to_enu", f"""select fix_id, round(-so*dx+co*dy, 4) as east, round(-sa*co*dx-sa*so*dy+ca*dz, 4) as north, round(ca*co*dx+ca*so*dy+sa*dz, 4) as up from (
  select *, x-x0 as dx, y-y0 as dy, z-z0 as dz from (
   select fix_id, sin(radians(lat0)) as sa, cos(radians(lat0)) as ca, sin(radians(lon0)) as so, cos(radians(lon0)) as co,
    ({_ECEF.format(a='lat')}+alt)*cos(radians(lat))*cos(radians(lon)) as x, ({_ECEF.format(a='lat')}+alt)*cos(radians(lat))*sin(radians(lon)) as y, ({_ECEF.format(a='lat')}*(1-e2)+alt)*sin(radians(lat)) as z,
    ({_ECEF.format(a='lat0')}+alt0)*cos(radians(lat0))*cos(radians(lon0)) as x0, ({_ECEF.format(a='lat0')}+alt0)*cos(radians(lat0))*sin(radians(lon0)) as y0, ({_ECEF.format(a='lat0')}*(1-e2)+alt0)*sin(radians(lat0)) as z0
   from (select *, {geo.WGS84_E2!r}::double as e2, first(lat) over w as lat0, first(lon) over w as lon0, first(alt) over w as alt0 from v_fix window w as (partition by trip_id order by ts_ns, fix_id))))""")
def geo_to_enu(t):
    c = F.col
    e, n, u = geo.to_enu(c("lat"), c("lon"), c("alt"), c("lat0"), c("lon0"), c("alt0"))
    return _origin(t("v_fix")).select("fix_id", F.round(e, 4).alias("east"), F.round(n, 4).alias("north"), F.round(u, 4).alias("up"))


@query("enu_roundtrip", "select fix_id, round(lat, 6) as lat, round(lon, 6) as lon, round(alt, 2) as alt from v_fix")
def enu_roundtrip(t):
    c = F.col
    e, n, u = geo.to_enu(c("lat"), c("lon"), c("alt"), c("lat0"), c("lon0"), c("alt0"))
    back = _origin(t("v_fix")).select("fix_id", "lat0", "lon0", "alt0", e.alias("e"), n.alias("n"), u.alias("u"))
    la, lo, al = geo.from_enu(c("e"), c("n"), c("u"), c("lat0"), c("lon0"), c("alt0"))
    return back.select("fix_id", F.round(la, 6).alias("lat"), F.round(lo, 6).alias("lon"), F.round(al, 2).alias("alt"))


@query("equirect_project", "select fix_id, round((lon - c_lon) * 111320 * cos(radians(c_lat)), 4) as x, round((lat - c_lat) * 110574, 4) as y from (select *, avg(lat) over (partition by trip_id) as c_lat, avg(lon) over (partition by trip_id) as c_lon from v_fix)")
def equirect_project(t):
    w = W.partitionBy("trip_id")
    la, lo = F.avg("lat").over(w), F.avg("lon").over(w)
    return t("v_fix").select("fix_id", F.round((F.col("lon") - lo) * geo.PLANE_LON_M * F.cos(F.radians(la)), 4).alias("x"), F.round((F.col("lat") - la) * geo.PLANE_LAT_M, 4).alias("y"))


@query("viewport", "select trip_id, min(lat) as south, max(lat) as north, min(lon) as west, max(lon) as east from v_fix group by trip_id")
def viewport(t):
    return t("v_fix").groupBy("trip_id").agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))


@query("log_time_ranges", "select trip_id, min(ts_ns) as start_ns, max(ts_ns) as end_ns from v_fix group by trip_id")
def log_time_ranges(t):
    return t("v_fix").groupBy("trip_id").agg(F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("end_ns"))


_CELL = "((cast(floor(x / 5) as bigint) & 2097151) << 42) | ((cast(floor(y / 5) as bigint) & 2097151) << 21) | (cast(floor(z / 5) as bigint) & 2097151)"


@query("voxel_downsample", f"select {_CELL} as cell, max(confidence) as confidence, count(*) as n from v_landmark group by 1")
def voxel_downsample(t):
    c = F.col
    return t("v_landmark").groupBy(rel.voxel_key(c("x"), c("y"), c("z"), 5.0).alias("cell")).agg(F.max("confidence").alias("confidence"), F.count("*").alias("n"))


@query("voxel_counts", f"select trip_id, count(distinct {_CELL}) as cells from v_landmark group by trip_id")
def voxel_counts(t):
    c = F.col
    return t("v_landmark").select("trip_id", rel.voxel_key(c("x"), c("y"), c("z"), 5.0).alias("cell")).groupBy("trip_id").agg(F.countDistinct("cell").alias("cells"))


@query("centroid_radius", "select trip_id, round(any_value(cx), 6) as cx, round(any_value(cy), 6) as cy, round(max(sqrt(pow(x-cx,2)+pow(y-cy,2)+pow(z-cz,2))), 6) as radius from (select *, avg(x) over w as cx, avg(y) over w as cy, avg(z) over w as cz from v_landmark window w as (partition by trip_id)) group by trip_id")
def centroid_radius(t):
    centre = t("v_landmark").groupBy("trip_id").agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"])
    far = F.sqrt(sum(((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in "xyz"), F.lit(0.0)))
    return t("v_landmark").join(centre, "trip_id").groupBy("trip_id").agg(F.round(F.max("cx"), 6).alias("cx"), F.round(F.max("cy"), 6).alias("cy"), F.round(F.max(far), 6).alias("radius"))


@query("position_std", "select trip_id, case when count(*) > 1 then round(sqrt((var_samp(x)+var_samp(y)+var_samp(z))/3), 6) end as sigma from v_landmark group by trip_id")
def position_std(t):
    return t("v_landmark").groupBy("trip_id").agg(F.when(F.count("*") > 1, F.round(F.sqrt((F.var_samp("x") + F.var_samp("y") + F.var_samp("z")) / 3), 6)).alias("sigma"))


@query("tracker_votes", "select trip_id, arg_max(asset_class, (v, asset_class)) as winner from (select trip_id, asset_class, round(sum(confidence), 6) as v from v_asset group by all) group by trip_id")
def tracker_votes(t):
    votes = t("v_asset").groupBy("trip_id", "asset_class").agg(F.round(F.sum("confidence"), 6).alias("v"))
    return votes.groupBy("trip_id").agg(F.max_by("asset_class", F.struct("v", "asset_class")).alias("winner"))


def detections(t):
    """Every pose as a detection at its own place."""
    pick = lambda names, by: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("pose_id") % by + 1).cast("int"))
    return t("v_pose").select("trip_id", "ts_ns", F.col("pose_id").alias("id"), *[F.col(f"vio_{c}").alias(c) for c in "xyz"], pick(["POLE", "SIGN", "LIGHT"], 3).alias("asset_class"), (F.col("pose_id") % 10 / 10).alias("confidence"), (F.col("pose_id") % 7 + 1).cast("double").alias("depth_m"), F.col("pose_id").alias("frame_id"), pick(["ROAD", None], 2).alias("semantic_label"))


@query("asset_tracker")
def asset_tracker(t):
    return folds.track_assets(detections(t), 100.0)


@query("asset_landmarks")
def asset_landmarks(t):
    return folds.landmarks(folds.track_assets(detections(t), 100.0))


@query("nms", """with recursive b as (select *, row_number() over (partition by frame_id, class order by score desc, id) as rn, {'l': left_px::float, 't': top_px::float, 'r': right_px::float, 'b': bottom_px::float} as box from v_box),
    k as (select frame_id, class, id, score, rn, [box] as kept, true as ok from b where rn = 1
    union all select frame_id, class, id, score, rn, case when ok then list_append(kept, box) else kept end, ok from (
      select b.frame_id, b.class, b.id, b.score, b.rn, b.box, k.kept,
        len(list_filter(k.kept, lambda o: greatest(0::float, least(b.box.r, o.r) - greatest(b.box.l, o.l)) * greatest(0::float, least(b.box.b, o.b) - greatest(b.box.t, o.t))
          / ((b.box.r - b.box.l) * (b.box.b - b.box.t) + (o.r - o.l) * (o.b - o.t) - greatest(0::float, least(b.box.r, o.r) - greatest(b.box.l, o.l)) * greatest(0::float, least(b.box.b, o.b) - greatest(b.box.t, o.t))) > 0.45::float)) = 0 as ok
      from k join b on b.frame_id = k.frame_id and b.class = k.class and b.rn = k.rn + 1))
    select frame_id, class, id, score from k where ok""")
def nms(t):
    return folds.suppress(t("v_box"))


@query("box_centre", "select id, (left_px + right_px) / 2 as cx, (top_px + bottom_px) / 2 as cy from v_box")
def box_centre(t):
    return t("v_box").selectExpr("id", "(left_px + right_px) / 2 as cx", "(top_px + bottom_px) / 2 as cy")


@query("argmax_class", "select frame_id, arg_max(class, (score, -id)) as class from v_box where score >= 0.35 group by frame_id")
def argmax_class(t):
    return t("v_box").where("score >= 0.35").groupBy("frame_id").agg(F.max_by("class", F.struct("score", -F.col("id"))).alias("class"))


@query("backproject", "select id, round((left_px - 20) / 1000 * score, 9) as x, round((top_px - 20) / 1000 * score, 9) as y, score as z from v_box where score > 0")
def backproject(t):
    p = vision.backproject(F.col("left_px"), F.col("top_px"), F.col("score"), 1000.0, 1000.0, 20.0, 20.0)
    return t("v_box").withColumn("p", p).where("p is not null").select("id", F.round("p.x", 9).alias("x"), F.round("p.y", 9).alias("y"), F.col("p.z").alias("z"))


_H = math.sqrt(0.5)


@query("quat_rotate", "select pose_id, round(-vio_y, 6) as x, round(vio_x, 6) as y, round(vio_z, 6) as z from v_pose")
def quat_rotate(t):
    """A quarter turn about z."""
    q = tuple(F.lit(v) for v in (0.0, 0.0, _H, _H))
    x, y, z = vision.rotate(q, (F.col("vio_x"), F.col("vio_y"), F.col("vio_z")))
    return t("v_pose").select("pose_id", (F.round(x, 6) + 0.0).alias("x"), (F.round(y, 6) + 0.0).alias("y"), F.round(z, 6).alias("z"))


@query("intrinsics_scale", "select id, case when right_px > 0 then 1000 * (right_px / 1920) end as fx, case when bottom_px > 0 then 1000 * (bottom_px / 1080) end as fy from v_box")
def intrinsics_scale(t):
    return t("v_box").select("id", F.when(F.col("right_px") > 0, 1000 * (F.col("right_px") / 1920)).alias("fx"), F.when(F.col("bottom_px") > 0, 1000 * (F.col("bottom_px") / 1080)).alias("fy"))


@query("letterbox_inverse", "select id, round(least(greatest((left_px - 0) / (640.0::double / 1920), 0), 1920), 6) as x, round(least(greatest((top_px - 140) / (640.0::double / 1920), 0), 1080), 6) as y from v_box")
def letterbox_inverse(t):
    scale = 640.0 / 1920
    return t("v_box").select("id", F.round(geo.clamp(F.col("left_px") / scale, 0.0, 1920.0), 6).alias("x"), F.round(geo.clamp((F.col("top_px") - 140) / scale, 0.0, 1080.0), 6).alias("y"))


@query("depth_mask", "select id, (id & 8191) / 1000.0::double as depth_m from v_box")
def depth_mask(t):
    return t("v_box").select("id", (F.col("id").bitwiseAND(0x1FFF) / 1000.0).alias("depth_m"))


@query("tracking_quality", "select pose_id, case when state = 'TRACKING' then 1.0::double when vio_y > 50 then 0.3::double else 0.2::double end as quality from v_pose")
def tracking_quality(t):
    return t("v_pose").select("pose_id", F.when(F.col("state") == "TRACKING", 1.0).when(F.col("vio_y") > 50, 0.3).otherwise(0.2).alias("quality"))


@query("constellation_mask", "select trip_id, bit_or(1 << cast(pose_id % 8 as int)) as mask, count(distinct pose_id % 8) as n from v_pose group by trip_id")
def constellation_mask(t):
    return t("v_pose").groupBy("trip_id").agg(F.bit_or(F.expr("shiftleft(1, cast(pose_id % 8 as int))")).alias("mask"), F.countDistinct(F.col("pose_id") % 8).alias("n"))


@query("epoch_summary", "select stream_id, count(*) filter (value > 20) as used, count(*) as visible, round(coalesce(avg(value), 0), 6) as mean_cn0 from v_sample group by stream_id")
def epoch_summary(t):
    return t("v_sample").groupBy("stream_id").agg(F.count_if(F.col("value") > 20).alias("used"), F.count("*").alias("visible"), F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 6).alias("mean_cn0"))


@query("per_constellation", "select pose_id % 8 as constellation, count(*) as n from v_pose group by 1")
def per_constellation(t):
    return t("v_pose").groupBy((F.col("pose_id") % 8).alias("constellation")).agg(F.count("*").alias("n"))


@query("drop_reasons", "select case when state = 'PAUSED' then 'no_pose' when vio_y <= 10 then 'no_depth' else 'kept' end as reason, count(*) as n from v_pose group by 1")
def drop_reasons(t):
    return t("v_pose").groupBy(F.when(F.col("state") == "PAUSED", "no_pose").when(F.col("vio_y") <= 10, "no_depth").otherwise("kept").alias("reason")).agg(F.count("*").alias("n"))


@query("ns_parts", "select pose_id, ts_ns // 1000000000 as secs, (ts_ns % 1000000000) // 1000000 as millis from v_pose")
def ns_parts(t):
    return t("v_pose").selectExpr("pose_id", "ts_ns div 1000000000 as secs", "(ts_ns % 1000000000) div 1000000 as millis")


@query("dedupe_frames", "select trip_id, pose_id from v_pose qualify lag(ts_ns) over (partition by trip_id order by ts_ns, pose_id) is distinct from ts_ns")
def dedupe_frames(t):
    return t("v_pose").withColumn("before", F.lag("ts_ns").over(_trip())).where("not (before <=> ts_ns)").select("trip_id", "pose_id")


@query("tumbling_rate", "select stream_id, raw_ns // 60000000000 as minute, count(*) as n from v_sample group by all")
def tumbling_rate(t):
    return t("v_sample").groupBy("stream_id", F.expr("raw_ns div 60000000000").alias("minute")).agg(F.count("*").alias("n"))


@query("session_trips", "select trip_id, count(*) as n, min(ts_ns) as start_ns, max(ts_ns) as end_ns from (select *, sum(case when ts_ns - coalesce(p, ts_ns) > 7200000000000 then 1 else 0 end) over (partition by trip_id order by ts_ns, pose_id rows unbounded preceding) as s from (select *, lag(ts_ns) over (partition by trip_id order by ts_ns, pose_id) as p from v_pose)) group by trip_id, s")
def session_trips(t):
    new = F.when(F.col("ts_ns") - F.lag("ts_ns").over(_trip()) > 7_200_000_000_000, 1).otherwise(0)
    marked = t("v_pose").withColumn("new", new).withColumn("s", F.sum("new").over(_trip().rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy("trip_id", "s").agg(F.count("*").alias("n"), F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("end_ns")).drop("s")


@query("batch_emit", "select stream_id, max(raw_ns) as ts_ns, count(*) as n, arg_min(seq, (raw_ns, seq)) as first_seq from v_sample group by stream_id, raw_ns // 21600000000000")
def batch_emit(t):
    """Samples of six hours as one message, under the time of the last."""
    sent = rel.emit_batches(t("v_sample").select("stream_id", "raw_ns", "seq", "value"), "stream_id", "raw_ns", 21_600_000_000_000)
    return sent.select("stream_id", "ts_ns", F.size("payload").cast("long").alias("n"), F.get("payload", F.lit(0))["seq"].alias("first_seq"))


@query("load_shedding", """with recursive n as (select stream_id, seq, raw_ns // 10000 as ns, row_number() over (partition by stream_id order by raw_ns // 10000, seq) as rn, case when value > 90 then 0 when value > 70 then 2 when value > 50 then 5 else 8 end as hz from v_sample),
    k as (select stream_id, seq, rn, case when hz > 0 then ns end as last_ns, hz > 0 as ok from n where rn = 1
    union all select stream_id, seq, rn, case when ok then ns else last_ns end, ok from (
      select n.stream_id, n.seq, n.rn, n.ns, k.last_ns, n.hz > 0 and (k.last_ns is null or n.ns - k.last_ns >= 1000000000 // greatest(n.hz, 1)) as ok from k join n on n.stream_id = k.stream_id and n.rn = k.rn + 1))
    select stream_id, seq from k where ok""")
def load_shedding(t):
    """Frames that get through while heat lowers the rate or stops it. Times are shrunk ten thousand times."""
    v = F.col("value")
    policy = F.when(v > 90, 0).when(v > 70, 2).when(v > 50, 5).otherwise(8)
    return folds.shed(t("v_sample").select("stream_id", "seq", F.expr("raw_ns div 10000").alias("raw_ns"), policy.alias("hz")))

"""Scans, searches, spatial and vector joins, and the store's writes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo, vision
from ..operators import layout
from ..operators import relational as rel
from ..sources import records
from ..sources.shared import new_path
from ..views import table
from .registry import QUERIES, query

LAT, LON = 12.98, 77.60
SQL_DIST = "2*6371000.0::double*asin(sqrt(pow(sin(radians({b}-{a})/2),2)+cos(radians({a}))*cos(radians({b}))*pow(sin(radians({d}-{c})/2),2)))"


def sql_dist(a: str, c: str, b: str, d: str) -> str:
    return SQL_DIST.format(a=a, b=b, c=c, d=d)


_S, _N, _W, _E = geo.box_around(LAT, LON, 500.0)
_IN = f"lat between {_S!r}::double and {_N!r}::double and lon between {_W!r}::double and {_E!r}::double"
_D = sql_dist(f"{LAT}::double", f"{LON}::double", "lat", "lon")


@query("radius_search", f"select id, asset_class, lat, lon, round({_D}, 6) as distance_m from v_asset where {_IN} and {_D} <= 500")
def radius_search(t):
    hits = rel.within_radius(t("v_asset"), LAT, LON, 500.0)
    return hits.orderBy("distance_m", "id").select("id", "asset_class", "lat", "lon", F.round("distance_m", 6).alias("distance_m"))


@query("radius_search_class", f"select id, lat, lon, round({_D}, 6) as distance_m from v_asset where asset_class = 'BUILDING' and {_IN} and {_D} <= 500")
def radius_search_class(t):
    hits = rel.within_radius(t("v_asset").where("asset_class = 'BUILDING'"), LAT, LON, 500.0)
    return hits.orderBy("distance_m", "id").select("id", "lat", "lon", F.round("distance_m", 6).alias("distance_m"))


_BOX = "lat between 12.975::double and 12.982::double and lon between 77.592::double and 77.6::double"


@query("bbox_assets", f"select * from v_asset where {_BOX}")
def bbox_assets(t):
    return rel.in_box(t("v_asset"), 12.975, 12.982, 77.592, 77.6)


@query("bbox_fixes", f"select * from v_fix where {_BOX}")
def bbox_fixes(t):
    return rel.in_box(t("v_fix"), 12.975, 12.982, 77.592, 77.6)


@query("bbox_landmarks", "select * from v_landmark where x between 5 and 15 and y between 2 and 6")
def bbox_landmarks(t):
    return t("v_landmark").where("x between 5 and 15 and y between 2 and 6")


def _near_assets(t, radius_m, digits=None):
    fixes = t("v_fix").select("fix_id", F.col("lat").alias("flat"), F.col("lon").alias("flon"))
    return rel.radius_join(fixes, t("v_asset").select("id", "lat", "lon"), radius_m, ("flat", "lat"), ("flon", "lon"), digits)


def radius_search_layout(spark, sf_dir):
    """All fixes within 300 m, from a table laid out along a space-filling curve."""
    folder = new_path(spark, "layout")
    layout.write_layout(table(spark, sf_dir, "v_fix").select("fix_id", "lat", "lon"), folder, zone_bits=34)
    found = layout.within_radius(layout.read_layout(spark, folder, "fix_id long, lat double, lon double"), 12.975, 77.595, 300.0, 34)
    return found.select("fix_id", F.round("distance_m", 3).alias("distance_m"))


query("radius_search_layout", f"select fix_id, round({sql_dist('12.975::double', '77.595::double', 'lat', 'lon')}, 3) as distance_m from v_fix where {sql_dist('12.975::double', '77.595::double', 'lat', 'lon')} <= 300")(None)
QUERIES["radius_search_layout"] = radius_search_layout


@query("radius_join_grid", f"select f.fix_id, a.id, round({sql_dist('f.lat', 'f.lon', 'a.lat', 'a.lon')}, 6) as distance_m from v_fix f, v_asset a where {sql_dist('f.lat', 'f.lon', 'a.lat', 'a.lon')} <= 50")
def radius_join_grid(t):
    return _near_assets(t, 50.0, 6).select("fix_id", "id", "distance_m")


@query("association_3m_grid", f"select f.fix_id, a.id from v_fix f, v_asset a where {sql_dist('f.lat', 'f.lon', 'a.lat', 'a.lon')} <= 3")
def association_3m_grid(t):
    return _near_assets(t, 3.0).select("fix_id", "id")


@query("assets_by_class", "select * from v_asset where asset_class = 'MACHINERY'")
def assets_by_class(t):
    return t("v_asset").where("asset_class = 'MACHINERY'")


@query("assets_page", "select * from v_asset order by id limit 200 offset 400")
def assets_page(t):
    return t("v_asset").orderBy("id").offset(400).limit(200)


@query("trips_recent", "select trip_id, min(ts_ns) as started_ns, max(ts_ns) as ended_ns, count(*) as n_poses from v_pose group by trip_id order by started_ns desc, trip_id limit 50")
def trips_recent(t):
    trips = t("v_pose").groupBy("trip_id").agg(F.min("ts_ns").alias("started_ns"), F.max("ts_ns").alias("ended_ns"), F.count("*").alias("n_poses"))
    return trips.orderBy(F.col("started_ns").desc(), "trip_id").limit(50)


@query("key_set_lookup", "select * from v_asset where id in (1, 5, 9, 100, 99999999)")
def key_set_lookup(t):
    return t("v_asset").where(F.col("id").isin(1, 5, 9, 100, 99999999))


@query("pk_lookup", "select * from v_asset where id = 42")
def pk_lookup(t):
    return t("v_asset").where("id = 42")


@query("fk_scan", "select * from v_asset where trip_id = 7")
def fk_scan(t):
    return t("v_asset").where("trip_id = 7")


@query("fk_ordered", "select fix_id, ts_ns, row_number() over (order by ts_ns, fix_id) as rn from v_fix where trip_id = 7")
def fk_ordered(t):
    w = W.partitionBy("trip_id").orderBy("ts_ns", "fix_id")
    return t("v_fix").where("trip_id = 7").select("fix_id", "ts_ns", F.row_number().over(w).alias("rn"))


@query("live_latest", "select stream_id, max(raw_ns) as last_ns, count(*) as n from v_sample group by stream_id")
def live_latest(t):
    return t("v_sample").groupBy("stream_id").agg(F.max("raw_ns").alias("last_ns"), F.count("*").alias("n"))


@query("trip_detail", """select t.trip_id, t.n_fixes, coalesce(a.n_assets, 0) as n_assets, coalesce(l.n_landmarks, 0) as n_landmarks
    from (select trip_id, count(*) as n_fixes from v_fix group by trip_id) t
    left join (select trip_id, count(*) as n_assets from v_asset group by trip_id) a using (trip_id)
    left join (select trip_id, count(*) as n_landmarks from v_landmark group by trip_id) l using (trip_id)""")
def trip_detail(t):
    n = lambda v, c: t(v).groupBy("trip_id").agg(F.count("*").alias(c))
    return n("v_fix", "n_fixes").join(n("v_asset", "n_assets"), "trip_id", "left").join(n("v_landmark", "n_landmarks"), "trip_id", "left").na.fill(0, ["n_assets", "n_landmarks"])


@query("delete_cascade_survivors", "select 'assets' as tbl, count(*) as n from v_asset where trip_id <> 7 union all select 'fixes', count(*) from v_fix where trip_id <> 7 union all select 'embeddings', count(*) from embeddings where vec_id not in (select embedding_id from v_asset where trip_id = 7 and embedding_id is not null)")
def delete_cascade_survivors(t):
    gone = t("v_asset").where("trip_id = 7 and embedding_id is not null")
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n")
    return n(rel.without(t("embeddings"), gone, "vec_id", "embedding_id"), "embeddings").unionByName(n(t("v_asset").where("trip_id != 7"), "assets")).unionByName(n(t("v_fix").where("trip_id != 7"), "fixes"))


@query("embedding_orphans", "select vec_id from embeddings where not exists (select 1 from v_asset where embedding_id = vec_id)")
def embedding_orphans(t):
    return rel.without(t("embeddings"), t("v_asset"), "vec_id", "embedding_id").select("vec_id")


_UPSERT = "select id, trip_id, state, 1 as version from v_job union all select id, trip_id, 'FAILED', 2 from v_job where state = 'QUEUED'"


@query("upsert_last_wins", f"select id, trip_id, state, version from (select *, row_number() over (partition by id order by version desc) as rn from ({_UPSERT})) where rn = 1")
def upsert_last_wins(t):
    old = t("v_job").select("id", "trip_id", "state", F.lit(1).alias("version"))
    new = t("v_job").where("state = 'QUEUED'").select("id", "trip_id", F.lit("FAILED").alias("state"), F.lit(2).alias("version"))
    return rel.last_wins(old.unionByName(new), "id", "version")


@query("job_partial_update", "select id, case when state = 'PROCESSING' then 'READY' else state end as state, case when state = 'PROCESSING' then total_bytes else 0 end as bytes_sent, case when state = 'PROCESSING' and id % 2 = 0 then 'r' || id else 'old' end as remote_id from v_job")
def job_partial_update(t):
    jobs = t("v_job").withColumn("remote_id", F.lit("old")).withColumn("bytes_sent", F.lit(0).cast("long"))
    news = t("v_job").where("state = 'PROCESSING'").select("id", F.lit("READY").alias("new_state"), F.col("total_bytes").alias("new_sent"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("r"), F.col("id"))).alias("new_remote"))
    return jobs.join(news, "id", "left").select("id", F.coalesce("new_state", "state").alias("state"), F.coalesce("new_sent", "bytes_sent").alias("bytes_sent"), F.coalesce("new_remote", "remote_id").alias("remote_id"))


_BAD = "select l_orderkey, l_linenumber, case when l_orderkey % 7 = 0 then 'nan'::double when l_orderkey % 11 = 0 then 'inf'::double else x end as x, y, z from v_landmark"


@query("finite_guard", f"select l_orderkey, l_linenumber, x, y, z from ({_BAD}) where not isnan(x) and not isinf(x)")
def finite_guard(t):
    bad = F.when(F.col("l_orderkey") % 7 == 0, float("nan")).when(F.col("l_orderkey") % 11 == 0, float("inf")).otherwise(F.col("x"))
    rows = t("v_landmark").select("l_orderkey", "l_linenumber", bad.alias("x"), "y", "z")
    return rows.where(geo.is_finite(F.col("x")) & geo.is_finite(F.col("y")) & geo.is_finite(F.col("z")))


@query("finite_points", f"select count(*) as n from ({_BAD}) where not isnan(x) and not isinf(x)")
def finite_points(t):
    return finite_guard(t).agg(F.count("*").alias("n"))


@query("insert_append", "select id, trip_id, state from v_job union all select (select max(id) from v_job) + row_number() over (order by trip_id, id), trip_id, 'QUEUED' from (select * from v_job order by id limit 20)")
def insert_append(t):
    """Twenty jobs without an id are added to the table, which numbers them."""
    jobs = t("v_job").select("id", "trip_id", "state")
    new = jobs.orderBy("id").limit(20).select(F.lit(None).cast("long").alias("id"), "trip_id", F.lit("QUEUED").alias("state"))
    return rel.insert(jobs, new, "id")


@query("update_by_pk", "select id, case when id = 7 then 'FAILED' else state end as state from v_job")
def update_by_pk(t):
    return rel.update(t("v_job").select("id", "state"), F.col("id") == 7, {"state": F.lit("FAILED")})


@query("delete_by_fk", "select id, trip_id from v_job where trip_id <> 5")
def delete_by_fk(t):
    return rel.delete(t("v_job").select("id", "trip_id"), F.col("trip_id") == 5)


@query("enqueue_job", "select id, state, cast(null as integer) as bytes_sent, cast(null as varchar) as provenance from v_job union all select (select max(id) from v_job) + row_number() over (order by trip_id, id), 'QUEUED', 0, 'CLOUD_REFINED' from v_job where state = 'READY' and trip_id = 7")
def enqueue_job(t):
    """A job for each that is ready of one trip goes into the table of jobs, under a number of its own."""
    new = t("v_job").where("state = 'READY' and trip_id = 7").select(F.lit(None).cast("long").alias("id"), F.lit("QUEUED").alias("state"), F.lit(0).alias("bytes_sent"), F.lit("CLOUD_REFINED").alias("provenance"))
    jobs = t("v_job").select("id", "state", F.lit(None).cast("int").alias("bytes_sent"), F.lit(None).cast("string").alias("provenance"))
    return rel.insert(jobs, new, "id")


@query("add_nullable_columns", "select id, asset_class, cast(null as varchar) as semantic_label, cast(null as double) as position_std_m from v_asset")
def add_nullable_columns(t):
    return rel.migrate(t("v_asset"), "id long, asset_class string, semantic_label string, position_std_m double")


@query("persist_isolated", "select 'header' as name, true as written, count(distinct trip_id) as n from v_fix union all select 'assets', true, count(*) from v_asset union all select 'landmarks', false, 0 union all select 'fixes', true, count(*) from v_fix")
def persist_isolated(t):
    """A trip header and its tables, of which one fails; what was written is read back."""
    spark = t("v_fix").sparkSession
    folder = new_path(spark, "trips")
    bad = t("v_landmark").select("trip_id", F.raise_error(F.lit("this table fails")).cast("long").alias("x"))
    write = lambda: rel.persist(folder, "trips-1", t("v_fix").select("trip_id").distinct(), {"assets": t("v_asset"), "landmarks": bad, "fixes": t("v_fix")})
    write()
    said = write()  # tried again, it writes nothing twice
    n = lambda name: spark.read.parquet(f"{folder}/{name}").count()
    rows = [("header", True, n("header"))] + [(name, ok, n(name) if ok else 0) for name, ok, _ in said]
    return spark.createDataFrame(rows, "name string, written boolean, n long")


_SEED = [0.1] * 8 + [0.0] * 48 + [-0.1] * 8
_COS = "list_dot_product(embedding::double[], {q}) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product({q}, {q})))"
_Q = f"{_SEED}::double[]"


@query("cosine_topk", f"select vec_id, round({_COS.format(q=_Q)}, 4) as score from embeddings order by {_COS.format(q=_Q)} desc, vec_id limit 20")
def cosine_topk(t):
    return rel.cosine_topk(t("embeddings"), _SEED, 20).select("vec_id", F.round(F.col("score").cast("double"), 4).alias("score"))


@query("similar_to_asset", "select e.vec_id, round(list_dot_product(e.embedding::double[], s.embedding::double[]), 4) as score from embeddings e, (select embedding from embeddings where vec_id = 4) s where e.vec_id <> 4 order by list_dot_product(e.embedding::double[], s.embedding::double[]) desc, vec_id limit 10")
def similar_to_asset(t):
    seed = t("embeddings").where("vec_id = 4").agg(F.first("embedding").alias("seed"))
    rows = t("embeddings").where("vec_id != 4").join(F.broadcast(seed))  # an aggregate is one row
    scored = rows.select("vec_id", vision.cosine(F.col("embedding"), F.col("seed")).alias("score"))
    return scored.orderBy(F.col("score").desc(), "vec_id").limit(10).select("vec_id", F.round(F.col("score").cast("double"), 4).alias("score"))


@query("topk_join_assets", f"select a.id, k.vec_id, round(k.s, 4) as score from (select vec_id, {_COS.format(q=_Q)} as s from embeddings order by s desc, vec_id limit 20) k join v_asset a on a.embedding_id = k.vec_id")
def topk_join_assets(t):
    top = rel.cosine_topk(t("embeddings"), _SEED, 20)  # at most 20 rows
    return t("v_asset").join(F.broadcast(top), F.col("embedding_id") == F.col("vec_id")).select("id", "vec_id", F.round(F.col("score").cast("double"), 4).alias("score"))


@query("vector_norms", "select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 4) as norm from embeddings")
def vector_norms(t):
    return t("embeddings").select("vec_id", F.round(F.sqrt(vision.dot(F.col("embedding"), F.col("embedding"))), 4).alias("norm"))


@query("l2_normalise", "select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double / sqrt(list_dot_product(embedding::double[], embedding::double[])))), 3) as total from embeddings")
def l2_normalise(t):
    unit = vision.l2_normalise(F.col("embedding"))
    return t("embeddings").select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x.cast("double")), 3).alias("total"))


@query("zip_embeddings", "select a.id, e.label from v_asset a left join embeddings e on e.vec_id = a.embedding_id")
def zip_embeddings(t):
    return t("v_asset").join(t("embeddings").select("vec_id", "label"), F.col("embedding_id") == F.col("vec_id"), "left").select("id", "label")


@query("index_join_equiv", f"select id from v_asset where {_BOX}")
def index_join_equiv(t):
    """By grid cell as an index would, then the exact box."""
    cells = t("v_asset").withColumn("cell", F.floor(F.col("lat") / 0.001))
    return rel.in_box(cells.where(F.col("cell").between(int(12.975 / 0.001), int(12.982 / 0.001) + 1)), 12.975, 12.982, 77.592, 77.6).select("id")


@query("pending_jobs", "select id from v_job where state = 'PROCESSING' and artifact is not null")
def pending_jobs(t):
    return t("v_job").where("state = 'PROCESSING' and artifact is not null").select("id")


@query("bytes_by_trip", "select trip_id, cast(sum(total_bytes) as bigint) as total_bytes from v_job group by trip_id")
def bytes_by_trip(t):
    return t("v_job").groupBy("trip_id").agg(F.sum("total_bytes").alias("total_bytes"))


@query("props_json", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def props_json(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("artifact_sha", "select doc_id, sha256(text) as sha from documents")
def artifact_sha(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("crc32_text")
def crc32_text(t):
    return t("documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))


_HUMAN = "case when total_bytes >= 1048576 then printf('%.1f MiB', total_bytes / 1048576.0::double) when total_bytes >= 1024 then printf('%.1f KiB', total_bytes / 1024.0::double) else printf('%d B', total_bytes) end"


@query("human_bytes", f"select id, {_HUMAN} as text from v_job")
def human_bytes(t):
    return t("v_job").select("id", records.human_bytes(F.col("total_bytes")).alias("text"))


@query("chunk_plan", "select id, i as chunk, i * 8388608 as start, least(8388608, total_bytes - i * 8388608) as length from v_job, unnest(range(cast(ceil(total_bytes / 8388608.0) as bigint))) r(i) where total_bytes > 0")
def chunk_plan(t):
    size = 8 << 20
    last = F.floor((F.col("total_bytes") - 1) / size)
    rows = t("v_job").where("total_bytes > 0").select("id", "total_bytes", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    return rows.select("id", "chunk", (F.col("chunk") * size).alias("start"), F.least(F.lit(size).cast("long"), F.col("total_bytes") - F.col("chunk") * size).alias("length"))


@query("chunks_missing", "select id, i as chunk from v_job, unnest(range(cast(ceil(total_bytes / 8388608.0) as bigint))) r(i) where total_bytes > 0 and (id + i) % 3 <> 0")
def chunks_missing(t):
    planned = chunk_plan(t).select("id", "chunk")
    received = planned.where("(id + chunk) % 3 = 0")
    return planned.join(received, ["id", "chunk"], "left_anti")


@query("upload_progress", "select id, case when n = 0 then 1.0 else got / cast(n as double) end as progress from (select id, count(*) as n, count(*) filter ((id + i) % 3 = 0) as got from v_job, unnest(range(cast(ceil(total_bytes / 8388608.0) as bigint))) r(i) where total_bytes > 0 group by id)")
def upload_progress(t):
    return chunk_plan(t).groupBy("id").agg((F.count_if(F.expr("(id + chunk) % 3 = 0")) / F.count("*")).alias("progress"))


@query("storage_action", "select id, case when total_bytes < 5000000 then 'STOP' when total_bytes < 15000000 then 'WARN' when total_bytes < 25000000 then 'NOTICE' else 'OK' end as action from v_job")
def storage_action(t):
    b = F.col("total_bytes")
    return t("v_job").select("id", F.when(b < 5_000_000, "STOP").when(b < 15_000_000, "WARN").when(b < 25_000_000, "NOTICE").otherwise("OK").alias("action"))


@query("cloud_state", "select id, case upper(state) when 'READY' then 'READY' when 'FAILED' then 'FAILED' when 'UPLOADING' then 'UPLOADING' else 'PROCESSING' end as state from v_job")
def cloud_state(t):
    up = F.upper("state")
    return t("v_job").select("id", F.when(up.isin("READY", "FAILED", "UPLOADING"), up).otherwise("PROCESSING").alias("state"))


@query("thermal_plan", "select seq, case when value > 90 then 0 when value > 70 then least(8, 2) when value > 50 then least(8, 5) else 8 end as hz, value <= 90 as enabled from v_sample")
def thermal_plan(t):
    v = F.col("value")
    return t("v_sample").select("seq", F.when(v > 90, 0).when(v > 70, F.least(F.lit(8), F.lit(2))).when(v > 50, F.least(F.lit(8), F.lit(5))).otherwise(8).alias("hz"), (v <= 90).alias("enabled"))


@query("enum_fallback", "select id, case when asset_class in ('BUILDING', 'MACHINERY') then asset_class else 'UNKNOWN' end as asset_class from v_asset")
def enum_fallback(t):
    return t("v_asset").select("id", F.when(F.col("asset_class").isin("BUILDING", "MACHINERY"), F.col("asset_class")).otherwise("UNKNOWN").alias("asset_class"))


@query("accuracy_gate", "select fix_id from v_fix where not (h_acc_m > 35 and h_acc_m >= 0)")
def accuracy_gate(t):
    return t("v_fix").where("not (h_acc_m > 35 and h_acc_m >= 0)").select("fix_id")


@query("segment_names", "select id, case when id % 3 = 0 then 'trip.log' else 'trip.' || lpad(cast(id % 3 as varchar), 4, '0') || '.log' end as name from v_job")
def segment_names(t):
    n = (F.col("id") % 3).cast("int")
    return t("v_job").select("id", F.when(n == 0, "trip.log").otherwise(F.format_string("trip.%04d.log", n)).alias("name"))


@query("vector_bytes", "select vec_id, cast(4 * len(embedding) as integer) as n_bytes, round(cast(list_sum(embedding::double[]) as double), 4) as total from embeddings")
def vector_bytes(t):
    """Each vector as bytes, read back."""
    packed = t("embeddings").select("vec_id", records.encode_vector("embedding").alias("data"))
    back = packed.select("vec_id", F.octet_length("data").alias("n_bytes"), records.decode_vector("data").alias("v"))
    return back.select("vec_id", "n_bytes", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


@query("sensor_reports", "select seq as counter, raw_ns as timestamp_ns, cast(cast(value as float) as double) as x from v_sample where seq > 0")
def sensor_reports(t):
    """Samples as records of a sensor's memory, several in a buffer, read back; slots without a counter give nothing."""
    def pack(batches):
        for batch in batches:
            seq, ns, value = (batch.column(c).to_numpy() for c in ("seq", "raw_ns", "value"))
            out = np.zeros(len(seq), records.REPORT)
            out["size"], out["counter"], out["timestamp_ns"], out["x"] = records.RECORD_BYTES, seq, ns, value
            parts = [out[i : i + 50].tobytes() for i in range(0, len(out), 50)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], names=["data"])

    found = records.decode_reports(t("v_sample").select("seq", "raw_ns", "value").mapInArrow(pack, "data binary"))
    return found.select("counter", "timestamp_ns", F.col("x").cast("double").alias("x"))

"""The live stream monitor, payloads of messages, and model tensors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import images
from ..sources import connectors, payloads
from ..sources.shared import is_folder, new_path
from ..streaming import feed, stateful
from ..views import NS, VIEWS, table
from .registry import QUERIES, query

NOMINAL_NS = 600_000_000_000

_MONITOR = f"""with recursive n as (
        select *, row_number() over w as rn, first(arrival_ns - raw_ns) over w as off,
            max(raw_ns) over (partition by stream_id order by arrival_ns, seq rows between unbounded preceding and 1 preceding) as top
        from v_sample window w as (partition by stream_id order by arrival_ns, seq)),
    a as (select *, raw_ns + off as now, arrival_ns - raw_ns - off as late, row_number() over (partition by stream_id order by rn) as k,
            raw_ns - lag(raw_ns) over (partition by stream_id order by rn) as step
        from n where top is null or raw_ns >= top),
    e as (select stream_id, k, cast(late as double) as ema, cast(null as bigint) as base from a where k = 1
        union all select stream_id, k, ema, case when base is null and rn > 32 then cast(trunc(ema) as bigint) else base end from (
            select a.stream_id, a.k, a.rn, e.base, e.ema + cast(0.05 as double) * (cast(a.late as double) - e.ema) as ema
            from e join a on a.stream_id = e.stream_id and a.k = e.k + 1)),
    z as (select stream_id, max(k) as last from a group by stream_id),
    r as (select a.stream_id, count(*) as m, max(now) - min(now) as span from a join z using (stream_id) where k > last - 64 group by a.stream_id),
    g as (select stream_id, count(*) filter (step > 2.5 * {NOMINAL_NS}) as gaps, cast(coalesce(sum(step // {NOMINAL_NS} - 1) filter (step > 2.5 * {NOMINAL_NS}), 0) as bigint) as dropped from a group by stream_id),
    c as (select stream_id, count(*) as received, count(*) filter (raw_ns < top) as out_of_order from n group by stream_id)
    select a.stream_id, off as offset_ns, received, dropped, out_of_order, gaps, now as last_ns, late as latency_ns,
        case when base is null then 0 else cast(trunc(ema) as bigint) - base end as drift_ns,
        round(case when m > 1 and span > 0 then (m - 1) * 1e9 / span else 0 end, 9) as rate_hz
    from a join z on a.stream_id = z.stream_id and a.k = z.last join e on e.stream_id = a.stream_id and e.k = a.k
    join r on r.stream_id = a.stream_id join g on g.stream_id = a.stream_id join c on c.stream_id = a.stream_id"""


def stream_monitor_live(spark, sf_dir):
    """The monitor over samples that stream in; the state of each stream when all are read."""
    path = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(path if is_folder(spark, path) else path[:-1] + "[t]")
    samples = events.selectExpr(*[c.format(ns=NS["spark"]) for c in VIEWS["v_sample"][1]])
    return stateful.watch(samples, new_path(spark, "monitor"), NOMINAL_NS).withColumn("rate_hz", F.round("rate_hz", 9))


query("stream_monitor_live", _MONITOR)(None)
QUERIES["stream_monitor_live"] = stream_monitor_live


def observed_latest(spark, sf_dir):
    """The latest sample of each stream as an observed query: half of the samples are written, and then the rest; each
    write makes it emit again, and the last emission is what it says now."""
    folder = new_path(spark, "observed")
    samples = table(spark, sf_dir, "v_sample").select("stream_id", "seq", "raw_ns", "value")
    schema = samples.schema

    def latest(session):
        rows = session.read.schema(schema).parquet(f"{folder}/samples")
        return rows.groupBy("stream_id").agg(F.max_by(F.struct("raw_ns", "value"), F.struct("raw_ns", "seq")).alias("x")).select("stream_id", "x.*")

    def emit(result, number, _names):
        result.write.mode("overwrite").parquet(f"{folder}/said/emission={number}")

    for part in (F.col("seq") % 2 == 0, F.col("seq") % 2 != 0):
        samples.where(part).write.mode("append").parquet(f"{folder}/samples")
        feed.observe(spark, {"samples": f"{folder}/samples"}, latest, emit, f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    said = spark.read.schema("stream_id string, raw_ns long, value double, emission long").parquet(f"{folder}/said")
    last = said.groupBy("stream_id").agg(F.max_by(F.struct("raw_ns", "value"), "emission").alias("x"), F.countDistinct("emission").alias("emissions"))
    return last.select("stream_id", "x.*", "emissions")


query("observed_latest", "select stream_id, max(raw_ns) as raw_ns, arg_max(value, (raw_ns, seq)) as value, cast(2 as bigint) as emissions from v_sample group by stream_id")(None)
QUERIES["observed_latest"] = observed_latest


#: A span of the tables' time.
_SPAN = (1_705_000_000_000_000_000, 1_706_000_000_000_000_000)


def log_source(spark, sf_dir):
    """Samples are written as logs through the data source, and those of a span of time read through it, by the logs'
    own chunk index."""
    connectors.register(spark)
    folder = new_path(spark, "log-source")
    s = table(spark, sf_dir, "v_sample")
    rows = s.select(F.pmod(F.xxhash64("stream_id"), F.lit(1 << 30)).alias("trip_id"), F.col("stream_id").alias("topic"), F.col("raw_ns").alias("log_time_ns"), F.col("arrival_ns").alias("publish_time_ns"), F.col("seq").cast("string").cast("binary").alias("data"))
    connectors.save_logs(rows, folder, 1 << 14, 86_400_000_000_000 * 7)
    some = spark.read.format("chunked_log").load(folder).where(f"log_time_ns >= {_SPAN[0]} and log_time_ns < {_SPAN[1]}")
    return some.select(F.col("topic").alias("stream_id"), F.col("data").cast("string").cast("long").alias("seq"), F.col("log_time_ns").alias("raw_ns"), F.col("publish_time_ns").alias("arrival_ns"), "chunk_crc_ok")


query("log_source", f"select stream_id, seq, raw_ns, arrival_ns, true as chunk_crc_ok from v_sample where raw_ns >= {_SPAN[0]} and raw_ns < {_SPAN[1]}")(None)
QUERIES["log_source"] = log_source


@query("inertial_payloads", "select stream_id, seq, raw_ns as timestamp_ns, cast(cast(value as float) as double) as x, cast(cast(-value as float) as double) as y, cast(0 as double) as z, cast(seq % 4 as integer) as accuracy from v_sample")
def inertial_payloads(t):
    """Samples as messages in their binary form, read back."""
    said = F.struct(F.col("raw_ns").alias("timestamp_ns"), F.col("value").cast("float").alias("x"), (-F.col("value")).cast("float").alias("y"), F.lit(0.0).cast("float").alias("z"), (F.col("seq") % 4).cast("int").alias("accuracy"))
    back = payloads.decode_payloads(payloads.encode_payloads(t("v_sample").select("stream_id", "seq", said.alias("message")), "/imu/accel"), "/imu/accel")
    return back.select("stream_id", "seq", "message.timestamp_ns", *[F.col(f"message.{c}").cast("double").alias(c) for c in "xyz"], "message.accuracy")


@query("pose_payloads", "select trip_id, pose_id, ts_ns as timestamp_ns, vio_x as x, vio_y as y, vio_z as z, state as tracking_state, true as no_orientation from v_pose")
def pose_payloads(t):
    """Poses as messages with nested ones, read back; a message that was not there is null."""
    position = F.struct(*[F.col(f"vio_{c}").alias(c) for c in "xyz"])
    said = F.struct(F.col("ts_ns").alias("timestamp_ns"), position.alias("position"), F.col("state").alias("tracking_state"))
    back = payloads.decode_payloads(payloads.encode_payloads(t("v_pose").select("trip_id", "pose_id", said.alias("message")), "/pose"), "/pose")
    return back.select("trip_id", "pose_id", "message.timestamp_ns", *[F.col(f"message.position.{c}").alias(c) for c in "xyz"], "message.tracking_state", F.col("message.orientation").isNull().alias("no_orientation"))


@query("grid_sample", """select vec_id, case when cell > 0 and cell < 'inf'::double then cell else 'nan'::double end as depth_m from (
    select vec_id, cast(embedding[least(7, vec_id % 19 * 8 // 16) * 8 + least(7, vec_id % 17 * 8 // 16) + 1] as double) as cell from embeddings)""")
def grid_sample(t):
    """Each vector as a grid of 8 x 8 depths, at a place that may lie outside."""
    return t("embeddings").select("vec_id", images.grid_sample(F.col("embedding"), 8, 8, F.col("vec_id") % 17 / 16.0, F.col("vec_id") % 19 / 16.0).alias("depth_m"))


_SIDE = "cast(embedding[a + {m} * 8 + 1] * cast(640 as float) {sign} embedding[a + {h} * 8 + 1] * cast(640 as float) * cast(0.5 as float) as double) as {name}"


@query("detector_head", f"""select vec_id, cast(a as integer) as anchor, cast(list_position(s, list_max(s)) - 1 as integer) as class, cast(list_max(s) as double) as score,
    {_SIDE.format(m=0, h=2, sign="-", name="left_px")}, {_SIDE.format(m=1, h=3, sign="-", name="top_px")}, {_SIDE.format(m=0, h=2, sign="+", name="right_px")}, {_SIDE.format(m=1, h=3, sign="+", name="bottom_px")}
    from (select vec_id, embedding, a, [embedding[a + 33], embedding[a + 41], embedding[a + 49], embedding[a + 57]] as s from embeddings, range(8) as x(a))
    where list_max(s) >= cast(0.1 as float)""")
def detector_head(t):
    """Each vector as a head of eight anchors and four classes."""
    found = t("embeddings").select("vec_id", F.inline(images.decode_head(F.col("embedding"), 8, 4, 640, 0.1)))
    return found.select("vec_id", "anchor", "class", *[F.col(c).cast("double").alias(c) for c in ("score", "left_px", "top_px", "right_px", "bottom_px")])

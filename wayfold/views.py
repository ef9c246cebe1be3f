"""Domain views on the star-schema tables: poses, samples, fixes, assets, landmarks, jobs and detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NS = {"spark": "unix_micros(cast(ts as timestamp)) * 1000", "duckdb": "epoch_us(ts) * 1000"}

VIEWS = {
    "v_pose": ("events", ["user_id as trip_id", "event_id as pose_id", "{ns} as ts_ns", "cast((event_id*31)%1000 as double) as vio_x", "cast(value as double) as vio_y", "cast((event_id*17)%1000 as double) as vio_z", "case when event_type='error' then 'PAUSED' else 'TRACKING' end as state", "cast(0 as double) as qx", "sin(radians(cast((event_id*37)%120*3 as double)/2)) as qy", "cast(0 as double) as qz", "cos(radians(cast((event_id*37)%120*3 as double)/2)) as qw"]),
    "v_sample": ("events", ["event_type as stream_id", "event_id as seq", "{ns} as raw_ns", "{ns} + cast(round(value*100000) as bigint) as arrival_ns", "value"]),
    "v_fix": ("events", ["user_id as trip_id", "event_id as fix_id", "{ns} as ts_ns", "cast(12.97 as double)+cast((event_id*7919)%2000 as double)*cast(0.00001 as double) as lat", "cast(77.59 as double)+cast((event_id*104729)%2000 as double)*cast(0.00001 as double) as lon", "cast(900 as double)+value as alt", "case when event_type='error' then cast(-1 as double) else value/cast(2 as double) end as h_acc_m"]),
    "v_asset": ("customer", ["c_custkey as id", "cast(c_nationkey as bigint) as trip_id", "c_mktsegment as asset_class", "cast(12.97 as double)+cast((c_custkey*7919)%2000 as double)*cast(0.00001 as double) as lat", "cast(77.59 as double)+cast((c_custkey*104729)%2000 as double)*cast(0.00001 as double) as lon", "c_acctbal/cast(10000 as double) as confidence", "case when c_custkey%3=0 then null else c_custkey end as embedding_id"]),
    "v_landmark": ("lineitem", ["l_suppkey as trip_id", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity as x", "l_discount*cast(100 as double) as y", "l_tax*cast(100 as double) as z", "l_extendedprice/cast(100000 as double) as confidence"]),
    "v_job": ("orders", ["o_orderkey as id", "o_custkey as trip_id", "case o_orderstatus when 'F' then 'READY' when 'P' then 'PROCESSING' else 'QUEUED' end as state", "cast(round(o_totalprice*100) as bigint) as total_bytes", "o_orderpriority as artifact"]),
    "v_box": ("part", ["p_partkey as id", "p_brand as class", "cast(p_partkey%40 as double) as left_px", "cast((p_partkey*7)%40 as double) as top_px", "cast(p_partkey%40+10+p_size as double) as right_px", "cast((p_partkey*7)%40+10+p_size as double) as bottom_px", "p_retailprice/cast(3000 as double) as score", "p_partkey%50 as frame_id"]),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, or one of VIEWS on its base table."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    base, columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{base}.parquet").selectExpr(*[c.format(ns=NS["spark"]) for c in columns])


def with_views(sql: str) -> str:
    """`sql` for DuckDB, with a common table expression for each view that it names."""
    used = [v for v in VIEWS if v in sql]
    parts = [f"{v} as (select {', '.join(VIEWS[v][1]).format(ns=NS['duckdb'])} from {VIEWS[v][0]})" for v in used]
    recursive = sql.lstrip().lower().startswith("with recursive")
    body = sql.strip()
    if not parts:
        return body
    if body.lower().startswith("with"):
        rest = body[len("with recursive") if recursive else len("with") :]
        return f"with {'recursive ' if recursive else ''}{', '.join(parts)}, {rest}"
    return f"with {', '.join(parts)} {body}"

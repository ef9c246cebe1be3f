"""From detections in frames to assets on the map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, images, vision
from . import folds
from . import relational as rel


def place(detections: DataFrame, frames: DataFrame, poses: DataFrame, transforms: DataFrame, grid: tuple[int, int], focal: tuple[float, float], centre: tuple[float, float]) -> DataFrame:
    """`detections` with their point (x, y, z) in the world of the poses, its depth_m and semantic_label, the transform
    in force, and the reason why one has no point: 'no_pose', 'no_transform', 'no_depth' or 'not_finite', else 'kept'.

    `detections` has trip_id, ts_ns, id, frame_id, a box in pixels, asset_class and confidence; `frames` frame_id, width,
    height and row-major grids depth (array of floats) and labels (array of strings) of `grid` columns by rows;
    `poses` trip_id, ts_ns, pose_id, vio_x to vio_z and qx to qw; `transforms` trip_id, ts_ns, transform_id, scale, rotation
    (nine numbers by rows) and translation. A detection takes the last pose and transform of its trip at or before it;
    a frame that is not there has no depth.
    """
    c = F.col
    seen = detections.join(frames.select("frame_id", "width", "height", "depth", "labels"), "frame_id", "left")
    u, v = (c("left_px") + c("right_px")) / 2, (c("top_px") + c("bottom_px")) / 2
    at = lambda share, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), (share * n).cast("int")))
    label = F.get("labels", at(v / c("height"), grid[1]) * grid[0] + at(u / c("width"), grid[0]))
    seen = seen.withColumns({"u": u, "v": v, "depth_m": images.grid_sample(c("depth"), *grid, u / c("width"), v / c("height")), "semantic_label": label}).drop("depth", "labels")
    seen = rel.latest_before(seen, poses, "trip_id", "ts_ns", "pose_id").withColumnRenamed("matched_id", "pose_id").drop("matched_ns")
    state = poses.select("trip_id", "pose_id", *[c(f"vio_{a}").alias(f"p{a}") for a in "xyz"], "qx", "qy", "qz", "qw")
    seen = seen.join(state, ["trip_id", "pose_id"], "left")
    seen = rel.latest_before(seen, transforms, "trip_id", "ts_ns", "transform_id").withColumnRenamed("matched_id", "transform_id").drop("matched_ns")
    ray = vision.backproject(c("u"), c("v"), c("depth_m"), *focal, *centre)
    turned = vision.rotate(tuple(c(q) for q in ("qx", "qy", "qz", "qw")), (ray["x"], ray["y"], ray["z"]))
    seen = seen.withColumns({a: turned[i] + c(f"p{a}") for i, a in enumerate("xyz")})
    whole = geo.is_finite(c("x")) & geo.is_finite(c("y")) & geo.is_finite(c("z"))
    reason = F.when(c("pose_id").isNull(), "no_pose").when(c("transform_id").isNull(), "no_transform").when(~geo.is_finite(c("depth_m")), "no_depth").when(~whole, "not_finite").otherwise("kept")
    return seen.withColumn("reason", reason).drop("px", "py", "pz", "qx", "qy", "qz", "qw", "u", "v", "pose_id")


def extract_assets(placed: DataFrame, transforms: DataFrame, origins: DataFrame, merge_m: float = 3.0) -> DataFrame:
    """The landmark of each kept detection of `place` as it then stands (see `folds.track_assets`), with its place on the
    map by the transform in force: lat, lon, alt. `origins` has trip_id, lat0, lon0 and alt0. Places that are not finite
    are left out."""
    c = F.col
    kept = placed.where("reason = 'kept'")
    tracked = folds.track_assets(kept, merge_m, ["transform_id"])  # not joined again, which would place all once more
    with_transform = tracked.join(transforms.drop("ts_ns"), ["trip_id", "transform_id"]).join(origins, "trip_id")
    row = lambda i: c("scale") * sum((F.get("rotation", F.lit(3 * i + j)) * c(a) for j, a in enumerate("xyz")), F.lit(0.0)) + F.get("translation", F.lit(i))
    lat, lon, alt = geo.from_enu(row(0), row(1), row(2), c("lat0"), c("lon0"), c("alt0"))
    out = with_transform.select(*tracked.drop("transform_id").columns, lat.alias("lat"), lon.alias("lon"), alt.alias("alt"))
    return out.where(geo.is_finite(c("lat")) & geo.is_finite(c("lon")) & geo.is_finite(c("alt")))

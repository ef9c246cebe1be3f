"""Operators whose next step depends on their own output: keyframes, throttles, smoothing, tracking, suppression.

Throttles and smoothing run in buckets of a key, as `ordered` says. For the others rows are dealt by key and sorted, then
stream through in Arrow batches with one state, so a key of any length takes constant memory; but suppression remembers
the boxes that a frame and class keeps, and tracking a trip's landmarks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vision
from . import ordered


def ordered_fold(df: DataFrame, key: str, order: list[str], start: Callable[[], Callable[[dict], dict | None]], schema: str) -> DataFrame:
    """For each key a fresh step from `start()`; it sees the key's rows in order and gives a row or None."""
    from pyspark.sql.types import _parse_datatype_string

    names = [f.name for f in _parse_datatype_string(schema).fields]
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for batch in batches:
            out = []
            for values in zip(*map(ordered.listed, batch.columns), strict=True):
                row = dict(zip(batch.schema.names, values, strict=True))
                if step is None or row[key] != now:
                    now, step = row[key], start()
                made = step(row)
                if made is not None:
                    out.append(made)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], kind.field(n).type) for n in names], schema=kind)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def _turned(q: tuple, p: tuple) -> float:
    """Smallest angle between two orientations, in degrees."""
    return math.degrees(2 * math.acos(min(1.0, abs(sum(a * b for a, b in zip(q, p, strict=True))))))


_POSE = ["ts_ns", "vio_x", "vio_y", "vio_z", "qx", "qy", "qz", "qw"]


def keyframes(poses: DataFrame, min_ns: int, min_m: float, min_deg: float) -> DataFrame:
    """Tracking poses: the first, then each that is `min_ns` or more from the last selected, and also `min_m` away
    from it or turned by `min_deg`. Poses with a null time, place or orientation are left out."""
    poses = poses.dropna(subset=_POSE)

    def start():
        last = None

        def step(r):
            nonlocal last
            if r["state"] != "TRACKING":
                return None
            here, turn = (r["vio_x"], r["vio_y"], r["vio_z"]), (r["qx"], r["qy"], r["qz"], r["qw"])
            if last is not None and (r["ts_ns"] - last[0] < min_ns or (math.dist(here, last[1]) < min_m and _turned(turn, last[2]) < min_deg)):
                return None
            last = (r["ts_ns"], here, turn)
            return {"trip_id": r["trip_id"], "pose_id": r["pose_id"], "ts_ns": r["ts_ns"]}

        return step

    return ordered_fold(poses, "trip_id", ["ts_ns", "pose_id"], start, "trip_id long, pose_id long, ts_ns long")


def throttle(samples: DataFrame, min_ns: int, width_ns: int | None = None) -> DataFrame:
    """Samples that come `min_ns` or more after the last accepted one of their stream; with none or less, all. Those
    without a time are left out."""
    out = samples.select("stream_id", "seq", "raw_ns")
    if min_ns <= 0:
        return out.where("raw_ns is not null")
    return ordered.accepted(out, "stream_id", ["raw_ns", "seq"], F.lit(min_ns), width_ns)


def shed(samples: DataFrame, width_ns: int | None = None) -> DataFrame:
    """Samples of a stream that a changing policy lets through: with `hz` above zero, those 1 / `hz` seconds or more
    after the last one let through; with none or zero, no sample. Whole nanoseconds count, at least one, and samples
    without a time are left out."""
    gap = F.when(F.col("hz") > 0, F.floor(F.lit(1e9) / F.col("hz")))
    return ordered.accepted(samples.select("stream_id", "seq", "raw_ns", "hz"), "stream_id", ["raw_ns", "seq"], gap, width_ns).select("stream_id", "seq")


def _clear_of(boxes: np.ndarray, kept: np.ndarray, most_iou: float) -> np.ndarray:
    """Which boxes overlap `kept`, one box, no more than `most_iou`; all in 32-bit floats."""
    zero = np.float32(0)
    w = np.maximum(zero, np.minimum(boxes[:, 2], kept[2]) - np.maximum(boxes[:, 0], kept[0]))
    h = np.maximum(zero, np.minimum(boxes[:, 3], kept[3]) - np.maximum(boxes[:, 1], kept[1]))
    union = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1]) + (kept[2] - kept[0]) * (kept[3] - kept[1]) - w * h
    with np.errstate(divide="ignore", invalid="ignore"):
        return ~((union > 0) & (w * h / union > np.float32(most_iou)))


def suppress(boxes: DataFrame, most_iou: float = 0.45) -> DataFrame:
    """Greedy suppression: in each frame and class, by falling score, then id, boxes that overlap no kept box too much.
    Boxes with a null edge or score are left out. Each kept box is held against all that follow at once; a frame and class
    that goes on in the next batch brings its kept boxes along."""
    edges = ["left_px", "top_px", "right_px", "bottom_px"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        kept: list[np.ndarray] = []
        for batch in batches:
            frame, kind = batch.column("frame_id").to_pylist(), batch.column("class").to_pylist()
            keys = list(zip(frame, kind, strict=True))
            starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
            all_ = np.stack([batch.column(c).to_numpy().astype(np.float32) for c in edges], axis=1) if keys else np.zeros((0, 4), np.float32)
            taken: list[int] = []
            for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
                if keys[a] != now:
                    now, kept = keys[a], []
                alive = np.ones(b - a, bool)
                for box in kept:
                    alive &= _clear_of(all_[a:b], box, most_iou)
                while alive.any():
                    first = int(alive.argmax())
                    taken.append(a + first)
                    kept.append(all_[a + first])
                    alive &= _clear_of(all_[a:b], kept[-1], most_iou)
                    alive[: first + 1] = False
            yield batch.select(["frame_id", "class", "id", "score"]).take(pa.array(taken, pa.int64()))

    given = boxes.dropna(subset=[*edges, "score"]).select(F.col("frame_id").cast("long"), "class", F.col("id").cast("long"), F.col("score").cast("double"), *edges)
    dealt = given.repartition("frame_id", "class").sortWithinPartitions("frame_id", "class", F.col("score").desc(), "id")
    return dealt.mapInArrow(run, "frame_id long, class string, id long, score double")


TRACKED = "trip_id long, id long, track_id long, is_new boolean, observations long, x double, y double, z double, position_std_m double, max_confidence double, depth_avg_m double, asset_class string, semantic_label string, last_frame_id long"


class _Landmark:
    """What all detections of a landmark say: running mean and spread, and votes."""

    def __init__(self, number: int) -> None:
        self.number, self.n, self.mean, self.spread, self.top = number, 0, [0.0, 0.0, 0.0], 0.0, -math.inf
        self.depth, self.depths = 0.0, 0
        self.classes: dict[str, float] = {}
        self.labels: dict[str, int] = {}

    def add(self, p: tuple, r: dict) -> None:
        self.n += 1
        for i, x in enumerate(p):
            off = x - self.mean[i]
            self.mean[i] += off / self.n
            self.spread += off * (x - self.mean[i])
        if r["depth_m"] is not None and math.isfinite(r["depth_m"]):
            self.depth, self.depths = self.depth + r["depth_m"], self.depths + 1
        sure = r["confidence"] or 0.0
        self.top = max(self.top, sure)
        if r["asset_class"] is not None:
            self.classes[r["asset_class"]] = self.classes.get(r["asset_class"], 0.0) + sure
        if r["semantic_label"] is not None:
            self.labels[r["semantic_label"]] = self.labels.get(r["semantic_label"], 0) + 1

    def row(self) -> dict:
        won = lambda votes: min(votes, key=lambda x: (-votes[x], x), default=None)
        std = math.sqrt(self.spread / (3 * (self.n - 1))) if self.n > 1 else None
        return dict(zip("xyz", self.mean, strict=True)) | {"track_id": self.number, "is_new": self.n == 1, "observations": self.n, "position_std_m": std, "max_confidence": self.top, "depth_avg_m": self.depth / self.depths if self.depths else None, "asset_class": won(self.classes), "semantic_label": won(self.labels)}


def track_assets(detections: DataFrame, merge_m: float = 3.0, also: Sequence[str] = ()) -> DataFrame:
    """Online clustering in order of time, then id: a detection joins the nearest landmark of its trip within
    `merge_m`, whatever its class, and moves its mean; else it founds one. Gives each detection its landmark as it then
    stands: its number, mean, spread, highest confidence, mean depth, the class with the most confidence and the most
    frequent semantic label, and the frame that it was last seen in; votes that tie go to the first name, equal
    distances to the older landmark.

    `detections` has trip_id, ts_ns, id, x, y, z, asset_class, confidence, depth_m, frame_id and semantic_label (may be
    null), and what else of a detection its row is to keep, named by `also`. Detections without a finite place are left out; depths that are null or not finite don't enter the mean, a null
    confidence is 0 and a null class has no vote. Means lie in cells of `merge_m`, so that only 27 cells are searched for
    each detection.
    """

    def start():
        cells: dict[tuple, list[_Landmark]] = {}
        count = 0
        cell_of = lambda p: tuple(math.floor(x / merge_m) for x in p)

        def step(r):
            nonlocal count
            p = (r["x"], r["y"], r["z"])
            if None in p or not all(map(math.isfinite, p)):
                return None
            a, b, c = cell_of(p)
            near = [m for i in (a - 1, a, a + 1) for j in (b - 1, b, b + 1) for k in (c - 1, c, c + 1) if (i, j, k) in cells for m in cells[i, j, k]]
            best = min(near, key=lambda m: (math.dist(m.mean, p), m.number), default=None)
            if best is None or math.dist(best.mean, p) > merge_m:
                count += 1
                best = _Landmark(count)
            else:
                cells[cell_of(best.mean)].remove(best)
            best.add(p, r)
            cells.setdefault(cell_of(best.mean), []).append(best)
            return {"trip_id": r["trip_id"], "id": r["id"], "last_frame_id": r["frame_id"], **best.row(), **{c: r[c] for c in also}}

        return step

    read = ["trip_id", "ts_ns", "id", "x", "y", "z", "asset_class", "confidence", "depth_m", "frame_id", "semantic_label"]
    schema = ", ".join([TRACKED, *[f"`{c}` {detections.schema[c].dataType.simpleString()}" for c in also]])
    return ordered_fold(detections.select(*read, *also), "trip_id", ["ts_ns", "id"], start, schema)


def landmarks(tracked: DataFrame) -> DataFrame:
    """Each landmark as its last detection left it, without the detection's own columns."""
    last = F.max_by(F.struct(*[c for c in tracked.columns if c not in ("id", "is_new")]), "observations").alias("last")
    return tracked.groupBy("trip_id", "track_id").agg(last).select("last.*")


#: Share of the old value in smoothed speeds; what counts as turning on the spot, and as too fast.
SMOOTH = 0.8
TURN_DPS, TURN_MPS, FAST_MPS = 25.0, 0.35, 5.0


def capture_health(poses: DataFrame, most_ns: int = 500_000_000, width_ns: int | None = None) -> DataFrame:
    """Exponential means, from zero, of speed and rate of turning, and whether they say that the device turns on the
    spot or moves too fast; pairs of poses with no time or more than `most_ns` between are left out, and so are poses
    with a null time, place or orientation, and rates that are not finite."""
    order = ["ts_ns", "pose_id"]
    here = poses.dropna(subset=_POSE).withColumn("here", F.struct(*_POSE))
    pairs = ordered.with_previous(here, "trip_id", order, "here", "before", width_ns)
    seconds = (F.col("ts_ns") - F.col("before.ts_ns")) / 1e9
    moved = F.sqrt(sum(((F.col(c) - F.col(f"before.{c}")) * (F.col(c) - F.col(f"before.{c}")) for c in _POSE[1:4]), F.lit(0.0)))
    turned = vision.angle_deg([F.col(c) for c in _POSE[4:]], [F.col(f"before.{c}") for c in _POSE[4:]])
    rates = pairs.where((seconds > 0) & (F.col("ts_ns") - F.col("before.ts_ns") <= most_ns)).select("trip_id", *order, (moved / seconds).alias("speed"), (turned / seconds).alias("turn_dps"))
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    rates = rates.where(finite(F.col("speed")) & finite(F.col("turn_dps")))
    smooth = ordered.smoothed(rates, "trip_id", order, ["speed", "turn_dps"], lambda e, v: SMOOTH * e + (1 - SMOOTH) * v, SMOOTH, 0.0, width_ns)
    speed, turn = F.col("smooth_speed"), F.col("smooth_turn_dps")
    return smooth.select("trip_id", "pose_id", speed.alias("speed"), turn.alias("turn_dps"), ((turn > TURN_DPS) & (speed < TURN_MPS)).alias("turns_on_spot"), (speed > FAST_MPS).alias("too_fast"))

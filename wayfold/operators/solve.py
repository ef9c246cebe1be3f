"""Similarity alignment, hulls and quality scores for each trip.

Sums are made by Spark's own partial aggregation; only one small row for each trip meets numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import clamp


def _best(n: np.ndarray, mu_s: np.ndarray, mu_t: np.ndarray, var_s: np.ndarray, var_t: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which problems have a solution, and scale, rotation, translation and root mean square error of each, from means,
    variances and covariances. The error of one with a value that is not finite is NaN."""
    solved = (n >= 3) & ~(var_s < 1e-9)
    real = np.isfinite(cov).all(axis=(1, 2))
    u, d, vt = np.linalg.svd(np.where((real & solved)[:, None, None], cov, 0.0))
    turn = np.sign(np.linalg.det(u) * np.linalg.det(vt))
    turn[turn == 0] = 1.0
    sign = np.column_stack([np.ones((len(turn), 2)), turn])
    with np.errstate(divide="ignore", invalid="ignore"):
        rotation = u @ (np.eye(3) * sign[:, None, :]) @ vt
        spread = (d * sign).sum(axis=1)
        scale = spread / var_s
        error = var_t + scale * scale * var_s - 2 * scale * spread
        shift = mu_t - ((scale[:, None, None] * rotation) @ mu_s[:, :, None])[:, :, 0]
        rms = np.where(real, np.sqrt(np.where(error < 0, 0.0, error)), np.nan)
    return solved, scale, rotation, shift, rms


def align_all(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each stack of rows in `points` (problems, rows, 6: a source and its target) whether it has a solution, and the
    scale, rotation, translation and error that best map source to target."""
    source, target, n = points[:, :, :3], points[:, :, 3:], points.shape[1]
    mu_s, mu_t = source.mean(axis=1), target.mean(axis=1)
    s, t = source - mu_s[:, None], target - mu_t[:, None]
    var_s, var_t = ((x * x).reshape(len(x), -1).sum(axis=1) / n for x in (s, t))
    return _best(np.full(len(points), n), mu_s, mu_t, var_s, var_t, t.transpose(0, 2, 1) @ s / n)


def align(source: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float] | None:
    """Scale, rotation, translation and error that best map rows of `source` to rows of `target`, or None."""
    solved, scale, rotation, shift, rms = (x[0] for x in align_all(np.hstack([source, target])[None]))
    return (float(scale), rotation, shift, float(rms)) if solved else None


def similarity_solve(pairs: DataFrame, key: str, source: tuple[str, str, str], target: tuple[str, str, str]) -> DataFrame:
    """For each key the scale, rotation (row-major) and translation that best map source to target points, and
    the root mean square error; no row for fewer than 3 pairs or a source without extent. Pairs with a null are left out.
    Spark's variances and covariances are merged around means, so that points far from the origin lose nothing."""
    moments = [F.count("*").alias("n")]
    for i, s in enumerate(source):
        moments += [F.avg(s).alias(f"s{i}"), F.avg(target[i]).alias(f"t{i}"), F.var_pop(s).alias(f"vs{i}"), F.var_pop(target[i]).alias(f"vt{i}")]
        moments += [F.covar_pop(target[i], x).alias(f"c{i}{j}") for j, x in enumerate(source)]
    rows = pairs.dropna(subset=[*source, *target]).groupBy(key).agg(*moments)
    out = f"{key} {pairs.schema[key].dataType.simpleString()}, n long, scale double, rotation array<double>, translation array<double>, rms double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c != key}
            mu_s, mu_t = (np.column_stack([at[f"{k}{i}"] for i in range(3)]) for k in "st")
            var_s, var_t = (at[f"v{k}0"] + at[f"v{k}1"] + at[f"v{k}2"] for k in "st")
            cov = np.stack([np.column_stack([at[f"c{i}{j}"] for j in range(3)]) for i in range(3)], axis=1)
            solved, scale, rotation, shift, rms = _best(at["n"], mu_s, mu_t, var_s, var_t, cov)
            columns = [batch.column(key), batch.column("n"), pa.array(scale), *(pa.array(list(x.reshape(len(x), -1)), pa.list_(pa.float64())) for x in (rotation, shift)), pa.array(rms)]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n", "scale", "rotation", "translation", "rms"]).filter(pa.array(solved))

    return rows.mapInArrow(run, out)


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, anticlockwise, without points on its edges."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(ps: list) -> list:
        out: list = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def area(ring: list[tuple[float, float]]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2 if len(ring) > 2 else 0.0


def hull_area(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """key, area of the convex hull of its points.

    Each batch keeps only its own hulls' corners, which are few, before the shuffle; the hull of the corners is
    the hull of all.
    """
    kind = points.schema[key].dataType.simpleString()
    chosen = points.select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict = {}
            for k, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                by.setdefault(k, []).append((a, b))
            rows = [(k, *p) for k, ps in by.items() for p in hull(ps)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], batch.schema.types[i]) for i in range(3)], names=["key", "x", "y"])

    kept = chosen.mapInArrow(corners, f"key {kind}, x double, y double")
    lists = kept.groupBy("key").agg(F.collect_set(F.struct("x", "y")).alias("points"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            areas = [area(hull([(p["x"], p["y"]) for p in ps])) for ps in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(areas, pa.float64())], names=[key, "area"])

    return lists.mapInArrow(whole, f"{key} {kind}, area double")


def quality_scores(c: dict[str, Column]) -> dict[str, Column]:
    """Session scores from columns tracking, keyframes, landmarks, distance, fix, cn0, sats, accuracy, drop_rate,
    drift_ms, aligned, rms, coverage. The weights and limits are fixed values."""
    unit = lambda x: clamp(x, 0.0, 1.0)
    one = F.lit(1.0)
    far, frames = c["distance"] > 1, c["keyframes"] > 0
    slam = unit(c["tracking"]) * 0.6 + F.when(far, F.least(one, c["keyframes"] / (c["distance"] / 5))).otherwise(0.0) * 0.25 + F.when(frames, F.least(one, c["landmarks"] / (c["keyframes"] * 50))).otherwise(0.0) * 0.15
    cn0, sats = unit((c["cn0"] - 20) / 25), unit(c["sats"] / 12)
    gnss = F.when(c["accuracy"] < 0, c["fix"] * 0.5 + cn0 * 0.3 + sats * 0.2).otherwise(c["fix"] * 0.4 + cn0 * 0.25 + sats * 0.15 + unit(1 - c["accuracy"] / 20) * 0.2)
    georef = F.when(~c["aligned"], 0.0).when(F.isnan(c["rms"]), 0.5).otherwise(unit(1 - c["rms"] / 5))
    trajectory = unit(1 - c["drop_rate"] * 10) * 0.4 + unit(1 - c["drift_ms"] / 20) * 0.2 + georef * 0.4
    readiness = F.least(one, c["coverage"] / 1000) * 0.3 + F.when(far, F.least(one, c["landmarks"] / (c["distance"] * 100))).otherwise(0.0) * 0.3 + slam * 0.2 + gnss * 0.1 + F.when(c["aligned"], 0.1).otherwise(0.0)
    overall = slam * 0.3 + gnss * 0.25 + trajectory * 0.25 + readiness * 0.2
    return {"slam": slam, "gnss": gnss, "trajectory": trajectory, "readiness": readiness, "overall": overall}

"""Frames and model tensors: sampling of grids, detector heads as columns; resizing and colour of whole frames.

Frames are binary columns of rows x columns x 3 bytes; their functions work on one frame, in numpy, and
`map_frames` applies one to a column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Grey of the border, and the colour matrix in 1024ths.
GREY = 114 / 255
LUMA, RED_V, GREEN_V, GREEN_U, BLUE_U = 1192, 1634, 833, 400, 2066


def grid_sample(grid: Column, width: int, height: int, u: Column, v: Column) -> Column:
    """The cell of a row-major grid at the normalised place (u, v), held inside it; NaN unless finite and positive."""
    if width <= 0 or height <= 0:
        return F.lit(float("nan"))
    place = lambda share, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), (share * n).cast("int")))
    cell = F.get(grid, place(v, height) * width + place(u, width)).cast("double")
    good = (cell > 0) & ~F.isnan(cell) & (cell < float("inf"))
    return F.when(good, cell).otherwise(float("nan"))


def decode_head(output: Column, anchors: int, classes: int, input_size: int, least_score: float) -> Column:
    """Boxes of a channel-major head (centre, size, then a score for each class): array of structs of anchor,
    class, score and the box in pixels, for anchors whose best score is `least_score` or more."""
    f = lambda x: F.lit(float(x)).cast("float")

    def box(a: Column) -> Column:
        at = lambda channel: F.get(output, a + channel * anchors)
        best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.struct(F.get(output, a + (c + 4) * anchors).alias("score"), (-c).alias("falling"))))
        middle, half = [at(i) * f(input_size) for i in (0, 1)], [at(i) * f(input_size) * f(0.5) for i in (2, 3)]
        sides = [m - h for m, h in zip(middle, half, strict=True)] + [m + h for m, h in zip(middle, half, strict=True)]
        named = [x.alias(n) for x, n in zip(sides, ("left_px", "top_px", "right_px", "bottom_px"), strict=True)]
        return F.struct(a.alias("anchor"), (-best["falling"]).alias("class"), best["score"].alias("score"), *named)

    boxes = F.transform(F.sequence(F.lit(0), F.lit(anchors - 1)), box)
    return F.filter(boxes, lambda b: (b["score"] >= f(least_score)) & (b["score"] > f(0)))


def letterbox(frame: np.ndarray, size: int) -> np.ndarray:
    """A frame scaled to fit a square, by nearest pixels, in the middle of a grey border; values 0 to 1."""
    height, width = frame.shape[:2]
    scale = min(size / width, size / height)
    pad_x, pad_y = (size - width * scale) / 2, (size - height * scale) / 2
    x, y = (np.trunc((np.arange(size) - pad) / scale).astype(int) for pad in (pad_x, pad_y))
    out = np.full((size, size, 3), GREY, np.float32)
    inside = np.ix_((y >= 0) & (y < height), (x >= 0) & (x < width))
    out[inside] = frame[np.ix_(y[inside[0].ravel()], x[inside[1].ravel()])].astype(np.float32) / np.float32(255)
    return out


def crop_resize(frame: np.ndarray, box: tuple[float, float, float, float], size: int) -> np.ndarray:
    """The part of a frame in a box (left, top, right, bottom), one pixel at least, scaled to a square by nearest
    pixels; values 0 to 255."""
    height, width = frame.shape[:2]

    def span(low: float, high: float, n: int) -> np.ndarray:
        first = min(max(int(low), 0), max(n - 1, 0))
        last = min(max(int(high), first + 1), n)
        return first + np.arange(size) * (last - first) // size

    return frame[np.ix_(span(box[1], box[3], height), span(box[0], box[2], width))].astype(np.float32)


def nv21_to_rgb(raw: bytes, width: int, height: int) -> np.ndarray:
    """A frame from a plane of brightness and one of V and U for every 2 x 2 pixels, in whole numbers."""
    flat = np.frombuffer(raw, np.uint8).astype(np.int32)
    luma = LUMA * np.maximum(flat[: width * height].reshape(height, width) - 16, 0)
    rows, columns = (height + 1) // 2, (width + 1) // 2
    starts = width * height + np.arange(rows)[:, None] * width + 2 * np.arange(columns)
    v, u = (np.repeat(np.repeat(flat[starts + k] - 128, 2, 0), 2, 1)[:height, :width] for k in (0, 1))
    colours = np.stack([luma + RED_V * v, luma - GREEN_V * v - GREEN_U * u, luma + BLUE_U * u], axis=-1)
    return (np.clip(colours, 0, (1 << 18) - 1) >> 10).astype(np.uint8)


def map_frames(frames: DataFrame, work: Callable[[np.ndarray], np.ndarray], out: str = "values") -> DataFrame:
    """`frames` (columns frame, width, height and others) with what `work` makes of each frame, flattened, as
    array<float> in `out`. A null frame gives null."""
    others = frames.drop(out)
    names = others.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):  # one frame in memory at a time
                batch = whole.slice(at, 1)
                raw, width, height = (batch.column(c)[0].as_py() for c in ("frame", "width", "height"))
                made = None if raw is None else work(np.frombuffer(raw, np.uint8).reshape(height, width, 3)).astype(np.float32).ravel()
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([made], pa.list_(pa.float32()))], names=[*names, out])

    return others.mapInArrow(run, T.StructType([*others.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]))

"""Point clouds (the public PLY and PCD layouts), binary or as text: folders of files, each whole and readable by itself."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Points of a file at most; a task holds one file's points, 16 bytes each, before it writes them.
FILE_POINTS = 1_000_000
#: Fixed values of the formats: names of the four 32-bit floats.
PLY_FIELDS, PCD_FIELDS = ("x", "y", "z", "confidence"), ("x", "y", "z", "intensity")


def header(kind: str, n: int, text: bool = False) -> bytes:
    """Head of a file of n points of kind 'ply' or 'pcd', body in little-endian floats or as lines of text."""
    if kind == "ply":
        fields = "".join(f"property float {name}\n" for name in PLY_FIELDS)
        return f"ply\nformat {'ascii' if text else 'binary_little_endian'} 1.0\nelement vertex {n}\n{fields}end_header\n".encode()
    return f"VERSION .7\nFIELDS {' '.join(PCD_FIELDS)}\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 1\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA {'ascii' if text else 'binary'}\n".encode()


def lines(body: np.ndarray) -> bytes:
    """Points as lines of four numbers, each the shortest that reads back as the same float."""
    columns = [pc.cast(pa.array(np.ascontiguousarray(body[:, i])), pa.string()) for i in range(4)]
    return "".join(x + "\n" for x in pc.binary_join_element_wise(*columns, " ").to_pylist()).encode()


def parse(raw: bytes) -> np.ndarray:
    """Points of a file, as an array of four columns; a body cut short gives its whole points."""
    end, count = (b"end_header\n", rb"element vertex (\d+)") if raw.startswith(b"ply") else (re.search(rb"DATA \w+\n", raw)[0], rb"POINTS (\d+)")
    at = raw.index(end) + len(end)
    most, text = int(re.search(count, raw[:at])[1]), re.search(rb"\n(format|DATA) ascii", raw[:at])
    if text:
        numbers = np.array([x.split() for x in raw[at:].split(b"\n")[:-1]][:most], "<f4")
        return numbers.reshape(-1, 4)
    n = min(most, (len(raw) - at) // 16)
    return np.frombuffer(raw, "<f4", 4 * n, at).reshape(n, 4)


def write_clouds(points: DataFrame, folder: str, kind: str, most: int = FILE_POINTS, text: bool = False) -> DataFrame:
    """Writes x, y, z and confidence as files of at most `most` points; a row of path and n_points for each.

    Names carry the task attempt. Whoever reads takes the paths from this result, so files of attempts that
    failed are never read. Nulls become NaN.
    """
    names = ["x", "y", "z", "confidence"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        attempt, done, held = TaskContext.get().taskAttemptId(), [], []

        def put(body: np.ndarray) -> None:
            name = f"points-{attempt}-{len(done)}.{kind}"
            with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(header(kind, len(body), text) + (lines(body) if text else body.tobytes()))
            done.append((f"{folder}/{name}", len(body)))

        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype("<f4") for i in range(4)], axis=1))
            while sum(map(len, held)) >= most:
                body = np.concatenate(held)
                put(body[:most])
                held = [body[most:]]
        if sum(map(len, held)):
            put(np.concatenate(held))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "n_points"])

    return points.select(*names).mapInArrow(run, "path string, n_points long")


def read_clouds(files: DataFrame) -> DataFrame:
    """x, y, z and confidence (float) of every point of the files (path), dealt out file by file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, place = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_stream(place, compression=None) as source:
                    body = parse(source.read())
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(body[:, i])) for i in range(4)], names=["x", "y", "z", "confidence"])

    return files.select("path").repartition("path").mapInArrow(run, "x float, y float, z float, confidence float")

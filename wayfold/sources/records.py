"""Fixed-size binary records: reports of a sensor's shared memory, and vectors of 32-bit floats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of a report: its size in bytes, and the places of its fields.
RECORD_BYTES = 104
#: Buffers that are decoded at once, so that what a worker holds beside its batch doesn't grow with the batch.
SOME_BUFFERS = 100
REPORT = np.dtype({"names": ["size", "token", "type", "counter", "timestamp_ns", "x", "y", "z"], "formats": ["<i4", "<i4", "<i4", "<u4", "<i8", "<f4", "<f4", "<f4"], "offsets": [0, 4, 8, 12, 16, 24, 28, 32], "itemsize": RECORD_BYTES})


def decode_reports(buffers: DataFrame, data: str = "data") -> DataFrame:
    """The other columns of `buffers` with slot, size, token, type, counter, timestamp_ns, x, y and z of each whole
    record of the binary column `data`. Slots that were never written, whose counter is 0, give no row, nor does a
    null; what stands behind the last whole record is ignored."""
    others = buffers.drop(data)
    names = others.columns
    kinds = {"size": "int", "token": "int", "type": "int", "counter": "long", "timestamp_ns": "long", "x": "float", "y": "float", "z": "float"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(at, SOME_BUFFERS) for x in batches for at in range(0, x.num_rows, SOME_BUFFERS)):
            raw = [b"" if x is None else x for x in batch.column(data).to_pylist()]
            parts = [np.frombuffer(x, REPORT, len(x) // RECORD_BYTES) for x in raw]
            row = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
            slot = np.concatenate([*(np.arange(len(x)) for x in parts), np.zeros(0, np.int64)])
            all_ = np.concatenate([*parts, np.zeros(0, REPORT)])
            good = all_["counter"] != 0
            fields = [pa.array(np.ascontiguousarray(all_[n][good]).astype({"int": "i4", "long": "i8", "float": "f4"}[k])) for n, k in kinds.items()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row[good])) for c in names), pa.array(slot[good].astype("i4")), *fields], names=[*names, "slot", *kinds])

    said = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in others.schema)
    return buffers.select(*names, data).mapInArrow(run, f"{said}slot int, " + ", ".join(f"{n} {k}" for n, k in kinds.items()))


@F.pandas_udf(T.BinaryType())
def encode_vector(vectors: pd.Series) -> pd.Series:
    """A vector as little-endian 32-bit floats, one after the other."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(data: pd.Series) -> pd.Series:
    """The vector that `encode_vector` wrote; bytes behind the last whole float are ignored."""
    return data.map(lambda b: None if b is None else np.frombuffer(b, "<f4", len(b) // 4))


def human_bytes(n: Column) -> Column:
    """A number of bytes as text, from 1024 on in KiB and from 1024 of these in MiB, with one digit, to which halves go to
    the even one, as in C; Java's format takes them up. A null is null."""

    def tenths(unit: int) -> Column:
        part = n.cast("long") % unit * 10
        left, digit = part % unit, F.floor(part / unit)
        up = (left * 2 > unit) | ((left * 2 == unit) & (digit % 2 == 1))
        whole = (n - n % unit).cast("long") / unit
        return whole.cast("long") * 10 + digit + F.when(up, 1).otherwise(0)

    def shown(unit: int, name: str) -> Column:
        return F.concat(F.floor(tenths(unit) / 10).cast("string"), F.lit("."), (tenths(unit) % 10).cast("string"), F.lit(f" {name}"))

    return F.when(n >= 1 << 20, shown(1 << 20, "MiB")).when(n >= 1024, shown(1 << 10, "KiB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))

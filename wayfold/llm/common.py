"""What the operators of this subpackage share: the shared folder, written tables, Arrow columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import new_path, shared_dir  # noqa: F401

#: Rows of a batch that are worked on at a time, to bound a worker's memory.
SOME_ROWS = 500
#: Rows of an Arrow batch between the JVM and a worker, where the session has Spark's default of 10,000, which
#: with long texts takes much memory on both sides.
BATCH_ROWS = 1000


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Write as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._wayfold_path = path
    return back


def drop_table(df: DataFrame) -> None:
    """Delete a table of `write_table` that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._wayfold_path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, taken: list[str]) -> str:
    """`name`, with underscores added until no column is called so (names compare without case)."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name += "_"
    return name


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """`df` without its columns of these names, which compare without case, as Spark's do."""
    lower = {x.lower() for x in names}
    return df.drop(*[c for c in df.columns if c.lower() in lower])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often and deep the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


_kept: dict = {}


def kept_in_worker(key: object, make: Callable[[], object], alone: str | None = None) -> object:
    """What `make()` gave when this worker process first asked for `key`.

    Functions nested in others travel to workers with copies of the globals they name, so what should outlive
    a task is kept behind this module-level function, which workers import. Of all keys with the same `alone`
    only the last is kept, to bound memory.
    """
    if alone is not None:
        slot = (alone,)
        if _kept.get(slot, (None,))[0] != key:
            _kept.pop(slot, None)
            _kept[slot] = (key, make())
        return _kept[slot][1]
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches of the session, unless it has a setting of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def add_columns(df: DataFrame, source: str, fields: list[T.StructField], start: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """`df` with columns computed from `source`, batch by batch.

    `start()` runs once in each task and returns the function from a batch's column to the new columns.
    """
    small_batches(df.sparkSession)
    schema = T.StructType([*df.schema.fields, *fields])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), SOME_ROWS):
                batch = whole.slice(at, SOME_ROWS)
                made = work(batch.column(source))
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)

    return df.mapInArrow(run, schema)

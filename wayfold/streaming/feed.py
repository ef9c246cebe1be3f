"""Queries that are asked again when a table they read changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

_FILE = "path string, modificationTime timestamp, length long, content binary"


def changes(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """A stream of the files that tables (name to folder) gain: name, path, length and time. Contents are not read."""
    found = None
    for name, folder in folders.items():
        files = spark.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
        one = files.select(F.lit(name).alias("name"), "path", "length", "modificationTime")
        found = one if found is None else found.unionByName(one)
    if found is None:
        raise ValueError("name a table to watch")
    return found


def observe(spark: SparkSession, folders: dict[str, str], query: Callable[[SparkSession], DataFrame], emit: Callable[[DataFrame, int, set[str]], None], checkpoint: str) -> DataStreamWriter:
    """A stream to start: each micro-batch in which a table gained files asks `query` again and hands its result, with the
    batch's number and the names of the tables that changed, to `emit`. Writes that come together are one change, and a
    batch that is tried again has the same number, so that `emit` may overwrite what it made. Tables change by files:
    appends and batches that replace their own files are seen, a file that only goes is not. The checkpoint remembers what
    was seen, so after a restart only new changes are emitted."""

    def on(batch: DataFrame, number: int) -> None:
        names = {r["name"] for r in batch.select("name").distinct().collect()}  # a row for each table
        if names:
            emit(query(batch.sparkSession), number, names)

    return changes(spark, folders).writeStream.foreachBatch(on).option("checkpointLocation", checkpoint)

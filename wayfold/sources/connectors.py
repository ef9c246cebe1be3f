"""Chunked logs and sensor memory as Spark data sources, by name: `spark.read.format("chunked_log")`, `df.write.format(...)`
and `spark.readStream.format("sensor_records")`, once `register(spark)` was called.

A log is a partition of its own; its task reads the chunk index in the log's footer, leaves out the chunks that lie outside
the times and topics of the filters, and reads the others one by one. Only the names of logs reach the driver. Only a log
that was cut off, and so has no footer, is gone through record by record. What is written is listed when all tasks are
done, in one file that names the logs of the write; a task that fails leaves nothing that is listed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from . import logs
from .logs import footer_chunks, scanned_chunks
from .records import RECORD_BYTES, REPORT

MESSAGES = "path string, topic string, sequence long, log_time_ns long, publish_time_ns long, data binary, chunk_crc_ok boolean"
WRITTEN = "trip_id long, topic string, log_time_ns long, publish_time_ns long, data binary"
LISTING = "_logs-"


@dataclass
class Log(InputPartition):
    path: str


class LogReader(DataSourceReader):
    """Comparisons of log_time_ns, and equal or listed topics, choose the chunks and the messages of those; Spark asks
    only other filters again."""

    def __init__(self, folder: str) -> None:
        self.folder, self.least, self.most, self.topics = folder, -(1 << 63), (1 << 63) - 1, None
        self.read_chunks = 0

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if name == ("log_time_ns",) and isinstance(f, EqualTo):
                self.least, self.most = max(self.least, value), min(self.most, value)
            elif name == ("log_time_ns",) and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.least = max(self.least, value + isinstance(f, GreaterThan))
            elif name == ("log_time_ns",) and isinstance(f, LessThan | LessThanOrEqual):
                self.most = min(self.most, value - isinstance(f, LessThan))
            elif name == ("topic",) and isinstance(f, EqualTo | In):
                named = {value} if isinstance(f, EqualTo) else set(value)
                self.topics = named if self.topics is None else self.topics & named
            else:
                yield f

    def asks_for(self, topic: str, log_time: int) -> bool:
        return self.least <= log_time <= self.most and (self.topics is None or topic in self.topics)

    def partitions(self) -> list[Log]:
        """The logs that finished writes list; in a folder without such lists, every log in it."""
        fs, base = pyarrow.fs.FileSystem.from_uri(self.folder)
        found = sorted(x.path for x in fs.get_file_info(pyarrow.fs.FileSelector(base, recursive=True)) if x.is_file)
        listings = [x for x in found if x.rpartition("/")[2].startswith(LISTING)]
        named = [n for x in listings for n in json.loads(fs.open_input_stream(x).read())]
        return [Log(f"{self.folder}/{n}") for n in named] if listings else [Log(f"{self.folder}{x.removeprefix(base.rstrip('/'))}") for x in found if x.endswith(".mcap")]

    def read(self, partition: Log) -> Iterator[pa.RecordBatch]:
        fs, place = pyarrow.fs.FileSystem.from_uri(partition.path)
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
        with fs.open_input_file(place) as source:
            topics, chunks = footer_chunks(source) or scanned_chunks(source)
            for offset, length, first, last, channels in chunks:
                if last < self.least or first > self.most or (self.topics is not None and channels is not None and not self.topics & {topics.get(c) for c in channels}):
                    continue
                source.seek(offset + 9)
                ok, found = logs.parse_chunk(source.read(length - 9))
                self.read_chunks += 1
                rows = [(partition.path, topics[m[0]], *m[1:], ok) for m in found if m[0] in topics and self.asks_for(topics[m[0]], m[2])]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in MESSAGES.split(", ")])


@dataclass
class Wrote(WriterCommitMessage):
    names: list[str]


class LogSink(DataSourceArrowWriter):
    """Rows come by trip and in order of time; each trip of a task is a log. Names are those of the task's attempt, and
    only the attempts that Spark commits are listed."""

    def __init__(self, folder: str, chunk_bytes: int, overwrite: bool) -> None:
        self.folder, self.chunk_bytes, self.overwrite, self.token = folder, chunk_bytes, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        fs, base = pyarrow.fs.FileSystem.from_uri(self.folder)
        fs.create_dir(base, recursive=True)
        attempt, names, now, out, writer = TaskContext.get().taskAttemptId(), [], object(), None, None
        try:
            for batch in iterator:
                for trip, topic, log_time, publish_time, data in zip(*(batch.column(c).to_pylist() for c in ("trip_id", "topic", "log_time_ns", "publish_time_ns", "data")), strict=True):
                    if None in (topic, log_time, publish_time, data):
                        raise ValueError("a message needs a topic, both times and data")
                    if writer is None or trip != now:
                        if writer is not None:
                            writer.finish()
                            out.close()
                        now = trip
                        names.append(f"{self.token}-{attempt}-{len(names)}.mcap")
                        out = fs.open_output_stream(f"{base}/{names[-1]}", compression=None)
                        writer = logs.LogWriter(out, self.chunk_bytes)
                    writer.message(topic, log_time, publish_time, data)
            if writer is not None:
                writer.finish()
        finally:
            if out is not None:
                out.close()
        return Wrote(names)

    def commit(self, messages: list[Wrote | None]) -> None:
        fs, base = pyarrow.fs.FileSystem.from_uri(self.folder)
        fs.create_dir(base, recursive=True)
        before = [x.path for x in fs.get_file_info(pyarrow.fs.FileSelector(base)) if x.is_file] if self.overwrite else []
        with fs.open_output_stream(f"{base}/.{self.token}", compression=None) as out:
            out.write(json.dumps([n for m in messages if m is not None for n in m.names]).encode())
        fs.move(f"{base}/.{self.token}", f"{base}/{LISTING}{self.token}")  # whole or not at all
        for path in sorted(before, key=lambda x: not x.rpartition("/")[2].startswith(LISTING)):
            if self.token not in path:
                fs.delete_file(path)

    def abort(self, messages: list[Wrote | None]) -> None:
        """What tasks of this write have left is deleted, whether they finished or not."""
        fs, base = pyarrow.fs.FileSystem.from_uri(self.folder)
        for x in fs.get_file_info(pyarrow.fs.FileSelector(base, allow_not_found=True)):
            if self.token in x.path:
                fs.delete_file(x.path)


class LogSource(DataSource):
    """Options: path (a URI), and for writing chunk_bytes."""

    @classmethod
    def name(cls) -> str:
        return "chunked_log"

    def schema(self) -> str:
        return MESSAGES

    def reader(self, schema) -> LogReader:
        return LogReader(self.options["path"].rstrip("/"))

    def writer(self, schema, overwrite: bool) -> LogSink:
        return LogSink(self.options["path"].rstrip("/"), int(self.options.get("chunk_bytes", logs.CHUNK_BYTES)), overwrite)


def save_logs(messages: DataFrame, folder: str, chunk_bytes: int = logs.CHUNK_BYTES, span_ns: int = logs.SEGMENT_NS, mode: str = "append") -> None:
    """Write rows (trip_id, topic, log_time_ns, publish_time_ns, data) as logs, dealt by trip and span of time, so that a
    long trip is many logs. Rows without a time or topic are refused; null trips are a trip."""
    span = F.floor(F.col("log_time_ns") / span_ns)
    dealt = messages.select(*[F.col(x.split()[0]).cast(x.split()[1]) for x in WRITTEN.split(", ")]).repartition("trip_id", span).sortWithinPartitions("trip_id", "log_time_ns", "topic")
    dealt.write.format("chunked_log").mode(mode).option("chunk_bytes", chunk_bytes).save(folder)


REPORTS = "counter long, size int, token int, type int, timestamp_ns long, x float, y float, z float"


@dataclass
class Counters(InputPartition):
    first: int
    last: int


class SensorStream(DataSourceStreamReader):
    """Offsets are counters, and records are read each once, in order. The memory is a file of fixed records in which the
    record of counter c, from 1, is in slot (c - 1) modulo the number of slots. Records that were overwritten before they
    were read are lost: reading goes on at the oldest one that is there."""

    def __init__(self, path: str, most: int) -> None:
        self.path, self.most = path, most

    def _records(self) -> np.ndarray:
        fs, place = pyarrow.fs.FileSystem.from_uri(self.path)
        with fs.open_input_file(place) as source:
            raw = source.read()
        return np.frombuffer(raw, REPORT, len(raw) // RECORD_BYTES)

    def initialOffset(self) -> dict:
        return {"counter": 0}

    def latestOffset(self) -> dict:
        found = self._records()["counter"]
        return {"counter": int(found.max()) if len(found) else 0}

    def partitions(self, start: dict, end: dict) -> list[Counters]:
        return [Counters(a, min(a + self.most, end["counter"])) for a in range(start["counter"], end["counter"], self.most)]

    def read(self, partition: Counters) -> Iterator[tuple]:
        found = self._records()
        found = np.sort(found[(found["counter"] > partition.first) & (found["counter"] <= partition.last)], order="counter")
        for r in found:
            yield tuple(r[n].item() for n in ("counter", "size", "token", "type", "timestamp_ns", "x", "y", "z"))

    def commit(self, end: dict) -> None:
        """Nothing to free: the sensor overwrites its memory itself."""


class SensorSource(DataSource):
    """Options: path (a URI) of the sensor's memory, and records, how many a task reads at most."""

    @classmethod
    def name(cls) -> str:
        return "sensor_records"

    def schema(self) -> str:
        return REPORTS

    def streamReader(self, schema) -> SensorStream:
        return SensorStream(self.options["path"], int(self.options.get("records", 100_000)))


def register(spark: SparkSession) -> None:
    """Make both sources known to the session, and let it hand filters to sources. Spark looks sources up in the session
    that is active in the thread, which a thread of the caller's own has none of, so the session is made that."""
    spark._get_j_spark_session_class(spark._jvm).setActiveSession(spark._jsparkSession)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (LogSource, SensorSource):
        spark.dataSource.register(source)

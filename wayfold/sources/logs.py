"""Chunked message logs (the public MCAP layout): writing, listing chunks, reading, recovering.

A log is split into chunks with a checksum and a time range each. Listing reads record heads only and skips the
bodies; chunks are then rows, so a time filter drops chunks before any is read, and each chunk is its own unit
of work. A log that was cut off reads up to its last whole chunk.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format.
MAGIC = b"\x89MCAP0\r\n"
HEADER, FOOTER, SCHEMA, CHANNEL, MESSAGE, CHUNK, MESSAGE_INDEX, CHUNK_INDEX, STATISTICS, SUMMARY_OFFSET, DATA_END = 1, 2, 3, 4, 5, 6, 7, 8, 11, 14, 15

#: A chunk is sealed, and a segment of a log finished, at so many bytes or more; a segment also ends with its span of time.
CHUNK_BYTES, SEGMENT_BYTES, SEGMENT_NS = 1 << 20, 512 << 20, 3_600_000_000_000


def _text(s: str) -> bytes:
    raw = s.encode()
    return struct.pack("<I", len(raw)) + raw


def _record(op: int, body: bytes) -> bytes:
    return struct.pack("<BQ", op, len(body)) + body


class LogWriter:
    """Writes messages to a stream; seals a chunk at `chunk_bytes` or more."""

    def __init__(self, out, chunk_bytes: int = CHUNK_BYTES) -> None:
        self.out, self.size, self.chunk_bytes, self.crc = out, 0, chunk_bytes, 0
        self.channels: dict[str, int] = {}
        self.known: dict[str, tuple[bytes, bytes]] = {}  # schema and channel records, for the summary
        self.sequence: dict[int, int] = {}
        self.pending, self.times, self.index, self.counts, self.chunks = bytearray(), [], {}, {}, []
        self._put(MAGIC)
        self._put(_record(HEADER, _text("") + _text("wayfold")))

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.crc = zlib.crc32(raw, self.crc)
        self.size += len(raw)

    def _channel(self, topic: str) -> int:
        if topic not in self.channels:
            number = self.channels[topic] = len(self.channels) + 1
            schema = _record(SCHEMA, struct.pack("<H", number) + _text(topic) + _text("") + struct.pack("<I", 0))
            channel = _record(CHANNEL, struct.pack("<HH", number, number) + _text(topic) + _text("bytes") + struct.pack("<I", 0))
            self.known[topic] = (schema, channel)
            self._put(schema + channel)
        return self.channels[topic]

    def message(self, topic: str, log_time: int, publish_time: int, data: bytes) -> None:
        channel = self._channel(topic)
        sequence = self.sequence[channel] = self.sequence.get(channel, -1) + 1
        self.index.setdefault(channel, []).append((log_time, len(self.pending)))
        self.pending += _record(MESSAGE, struct.pack("<HIQQ", channel, sequence, log_time, publish_time) + data)
        self.times.append(log_time)
        self.counts[channel] = self.counts.get(channel, 0) + 1
        if len(self.pending) >= self.chunk_bytes:
            self.seal()

    def seal(self) -> None:
        if not self.times:
            return
        start, end, raw = min(self.times), max(self.times), bytes(self.pending)
        at = self.size
        self._put(_record(CHUNK, struct.pack("<QQQI", start, end, len(raw), zlib.crc32(raw)) + _text("") + struct.pack("<Q", len(raw)) + raw))
        length, offsets, index_at = self.size - at, {}, self.size
        for channel, entries in self.index.items():
            offsets[channel] = self.size
            packed = b"".join(struct.pack("<QQ", *e) for e in entries)
            self._put(_record(MESSAGE_INDEX, struct.pack("<HI", channel, len(packed)) + packed))
        self.chunks.append((start, end, at, length, offsets, self.size - index_at, len(raw)))
        self.pending, self.times, self.index = bytearray(), [], {}

    def finish(self) -> None:
        """The summary: schemas, channels, statistics and the chunks' places, where each of these groups begins, and a
        checksum over all of it."""
        self.seal()
        self._put(_record(DATA_END, struct.pack("<I", self.crc)))
        summary, indexes = self.size, []
        for start, end, at, length, offsets, index_length, size in self.chunks:
            packed = b"".join(struct.pack("<HQ", *x) for x in offsets.items())
            indexes.append(_record(CHUNK_INDEX, struct.pack("<QQQQ", start, end, at, length) + struct.pack("<I", len(packed)) + packed + struct.pack("<Q", index_length) + _text("") + struct.pack("<QQ", size, size)))
        counts = b"".join(struct.pack("<HQ", *x) for x in self.counts.items())
        spans = [c[:2] for c in self.chunks] or [(0, 0)]
        n = len(self.channels)
        statistics = _record(STATISTICS, struct.pack("<QHIIIIQQ", sum(self.counts.values()), n, n, 0, 0, len(self.chunks), min(s[0] for s in spans), max(s[1] for s in spans)) + struct.pack("<I", len(counts)) + counts)
        groups = [(SCHEMA, b"".join(x[0] for x in self.known.values())), (CHANNEL, b"".join(x[1] for x in self.known.values())), (STATISTICS, statistics), (CHUNK_INDEX, b"".join(indexes))]
        said, places = b"", []
        for op, group in groups:
            if group:
                places.append(_record(SUMMARY_OFFSET, struct.pack("<BQQ", op, summary + len(said), len(group))))
                said += group
        offsets_at = summary + len(said)
        said += b"".join(places) + struct.pack("<BQQQ", FOOTER, 20, summary, offsets_at)
        self._put(said + struct.pack("<I", zlib.crc32(said)))
        self._put(MAGIC)


def heads(source: pa.NativeFile) -> Iterator[tuple[int, int, int]]:
    """(opcode, offset of the body, its length) of each whole record; stops at a torn one."""
    size = source.size()
    source.seek(0)
    if source.read(8) != MAGIC:
        raise ValueError("no log")
    at = 8
    while at + 9 <= size:
        source.seek(at)
        head = source.read(9)
        if head[:8] == MAGIC or len(head) < 9:
            return
        op, length = struct.unpack("<BQ", head)
        if at + 9 + length > size:
            return
        yield op, at + 9, length
        at += 9 + length


def parse_chunk(raw: bytes) -> tuple[bool, list[tuple[int, int, int, int, bytes]]]:
    """Whether the checksum holds, and (channel, sequence, log time, publish time, data) of each message."""
    (crc,) = struct.unpack_from("<I", raw, 24)
    (name,) = struct.unpack_from("<I", raw, 28)
    if name:
        raise ValueError(f"a chunk is compressed by {raw[32 : 32 + name].decode()}, which is not read here")
    at = 32 + name + 8
    body, out, at = raw[at:], [], 0
    while at + 9 <= len(body):
        op, length = struct.unpack_from("<BQ", body, at)
        if at + 9 + length > len(body):
            break
        if op == MESSAGE:
            out.append((*struct.unpack_from("<HIQQ", body, at + 9), body[at + 9 + 22 : at + 9 + length]))
        at += 9 + length
    return zlib.crc32(body) == crc, out


FILES = "path string, trip_id long, start_ns long, end_ns long, n_messages long"


def write_logs(messages: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, segment_bytes: int = SEGMENT_BYTES, segment_ns: int = SEGMENT_NS) -> DataFrame:
    """Logs of rows (trip_id, topic, log_time_ns, publish_time_ns, data), in order of time, in segments: each trip
    begins a new one with every `segment_ns` of time, and at the first seal beyond `segment_bytes`. A row for each.

    Rows are dealt by trip and span of time, so that a long trip is written by many tasks, and stream to their file.
    Names carry the task attempt; whoever reads takes the paths from this result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        now = out = writer = None
        times, n, done = [0, 0], 0, []

        def close() -> None:
            writer.finish()
            out.close()
            done.append((f"{folder}/{name}", now[0], *times, n))

        for batch in batches:
            for trip, span, topic, log_time, publish_time, data in zip(*(batch.column(c).to_pylist() for c in ("trip_id", "span", "topic", "log_time_ns", "publish_time_ns", "data")), strict=True):
                if writer is None or (trip, span) != now or (writer.size >= segment_bytes and not writer.times):
                    if writer is not None:
                        close()
                    now, n, times = (trip, span), 0, [log_time, log_time]
                    name = f"{trip}-{span}-{len(done)}-{attempt}.mcap"
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    writer = LogWriter(out, chunk_bytes)
                writer.message(topic, log_time, publish_time, data)
                times[1], n = log_time, n + 1
        if writer is not None:
            close()
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=["path", "trip_id", "start_ns", "end_ns", "n_messages"])

    span = F.floor(F.col("log_time_ns") / segment_ns).alias("span")
    dealt = messages.select("trip_id", span, "topic", "log_time_ns", "publish_time_ns", "data").repartition("trip_id", "span").sortWithinPartitions("trip_id", "span", "log_time_ns", "topic")
    return dealt.mapInArrow(run, FILES)


def log_files(spark: SparkSession, folder: str) -> DataFrame:
    """path of every log below a folder, as after a crash that left no table of them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.mcap").option("recursiveFileLookup", "true").load(folder)
    return found.select("path")


def recover(files: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """What became of each log (path): outcome, messages, chunks, reason, and recovered, the path of a rebuilt log.

    A log that ends as it should is 'valid'. One that was cut off is 'recovered': its whole chunks are written, one at
    a time, as a new log in `folder`, and it stays as it was. One that is too short or no log is 'failed'.
    """
    kinds = {"path": pa.string(), "outcome": pa.string(), "messages": pa.int64(), "chunks": pa.int64(), "reason": pa.string(), "recovered": pa.string()}

    def one(path: str, attempt: int, number: int) -> dict:
        fs, place = pyarrow.fs.FileSystem.from_uri(path)
        info = fs.get_file_info(place)
        if info.type == pyarrow.fs.FileType.NotFound or info.size < len(MAGIC):
            return {"outcome": "failed", "reason": "missing or too short"}
        with fs.open_input_file(place) as source:
            source.seek(info.size - len(MAGIC))
            if source.read(len(MAGIC)) == MAGIC and info.size > len(MAGIC):
                return {"outcome": "valid"}
            out_fs, base = pyarrow.fs.FileSystem.from_uri(folder)
            out_fs.create_dir(base, recursive=True)
            name, topics, messages, chunks = f"{place.rpartition('/')[2].removesuffix('.mcap')}-{number}-{attempt}.mcap", {}, 0, 0
            try:
                records = list(heads(source))
            except ValueError as e:
                return {"outcome": "failed", "reason": str(e)}
            with out_fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                writer = LogWriter(out, chunk_bytes)
                for op, at, length in records:
                    source.seek(at)
                    if op == CHANNEL:
                        raw = source.read(length)
                        (size,) = struct.unpack_from("<I", raw, 4)
                        topics[struct.unpack_from("<H", raw)[0]] = raw[8 : 8 + size].decode()
                    elif op == CHUNK:
                        chunks += 1
                        for channel, _, log_time, publish_time, data in parse_chunk(source.read(length))[1]:
                            if channel in topics:
                                writer.message(topics[channel], log_time, publish_time, data)
                                messages += 1
                writer.finish()
        return {"outcome": "recovered", "messages": messages, "chunks": chunks, "recovered": f"{folder}/{name}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, number = TaskContext.get().taskAttemptId(), 0
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                number += 1
                rows.append({"path": path, **one(path, attempt, number)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(kinds.items())))

    return files.select("path").repartition("path").mapInArrow(run, "path string, outcome string, messages long, chunks long, reason string, recovered string")


def footer_chunks(source: pa.NativeFile) -> tuple[dict[int, str], list[tuple[int, int, int, int, set[int]]]] | None:
    """Topics by channel, and (offset, length, first time, last time, channels) of each chunk record, from a log's
    summary; None where the log has no footer."""
    size = source.size()
    tail = 8 + 9 + 20
    if size < 8 + tail:
        return None
    source.seek(size - tail)
    end = source.read(tail)
    if end[-8:] != MAGIC or end[0] != FOOTER:
        return None
    (at,) = struct.unpack_from("<Q", end, 9)
    if not at:
        return None
    source.seek(at)
    said, topics, chunks, i = source.read(size - tail - at), {}, [], 0
    while i + 9 <= len(said):
        op, length = struct.unpack_from("<BQ", said, i)
        body = i + 9
        if op == CHANNEL:
            (n,) = struct.unpack_from("<I", said, body + 4)
            topics[struct.unpack_from("<H", said, body)[0]] = said[body + 8 : body + 8 + n].decode()
        elif op == CHUNK_INDEX:
            first, last, offset, n = struct.unpack_from("<QQQQ", said, body)
            (packed,) = struct.unpack_from("<I", said, body + 32)
            channels = {struct.unpack_from("<H", said, x)[0] for x in range(body + 36, body + 36 + packed, 10)}
            chunks.append((offset, n, first, last, channels))
        i = body + length
    return topics, chunks


def scanned_chunks(source: pa.NativeFile) -> tuple[dict[int, str], list[tuple[int, int, int, int, set[int] | None]]]:
    """The same of a log without a footer, from the heads of its records; which channels a chunk has is not known."""
    topics: dict[int, str] = {}
    chunks = []
    for op, at, length in heads(source):
        source.seek(at)
        if op == CHANNEL:
            raw = source.read(length)
            (n,) = struct.unpack_from("<I", raw, 4)
            topics[struct.unpack_from("<H", raw)[0]] = raw[8 : 8 + n].decode()
        elif op == CHUNK:
            chunks.append((at - 9, length + 9, *struct.unpack("<QQ", source.read(16)), None))
    return topics, chunks


def list_chunks(files: DataFrame) -> DataFrame:
    """path, body_at, length, start_ns, end_ns and topics (channel to name) of each whole chunk of logs (path), by a log's
    own index; only one that was cut off, and so has none, is gone through record by record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                fs, place = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_file(place) as source:
                    topics, chunks = footer_chunks(source) or scanned_chunks(source)
                rows += [(path, offset + 9, length - 9, first, last, list(topics.items())) for offset, length, first, last, _ in chunks]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.map_(pa.int32(), pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["path", "body_at", "length", "start_ns", "end_ns", "topics"])

    return files.select("path").repartition("path").mapInArrow(run, "path string, body_at long, length long, start_ns long, end_ns long, topics map<int,string>")


def read_chunks(chunks: DataFrame) -> DataFrame:
    """Messages of the listed chunks, which are dealt out one by one; a chunk with a wrong checksum keeps its messages
    and says so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
        for batch in batches:
            for row in batch.to_pylist():
                fs, place = pyarrow.fs.FileSystem.from_uri(row["path"])
                with fs.open_input_file(place) as source:
                    source.seek(row["body_at"])
                    ok, found = parse_chunk(source.read(row["length"]))
                topics = dict(row["topics"])
                rows = [(row["path"], topics[m[0]], m[1], m[2], m[3], m[4], ok) for m in found if m[0] in topics]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["path", "topic", "sequence", "log_time_ns", "publish_time_ns", "data", "chunk_crc_ok"])

    return chunks.repartition("path", "body_at").mapInArrow(run, "path string, topic string, sequence long, log_time_ns long, publish_time_ns long, data binary, chunk_crc_ok boolean")


def in_time(chunks: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Chunks whose time range meets [start_ns, end_ns]."""
    return chunks.where((F.col("end_ns") >= start_ns) & (F.col("start_ns") <= end_ns))

"""WARC archives: writing, normalising whole-file gzip streams into a member for each record, reading by index.

An archive that is one gzip stream can only be read from its start. The normaliser inflates such a stream once,
writes each record as a gzip member of its own, and beside it an index of their offsets, by which any record
can be read alone.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, write_table

#: Payloads of fewer bytes are stored again each time.
LEAST_REVISIT = 1000
LEVEL = 4
PIECE = 1 << 20
PREFIX = "urn:page:"


def _place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def _head(fields: list[tuple[str, object]], first: str) -> bytes:
    lines = [first, *(f"{k}: {v}" for k, v in fields if v is not None)]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record: a response with its payload, or a revisit with the payload's HTTP head only."""
    http = _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))], "HTTP/1.1 200 OK")
    body = http + (payload if refers_to is None else b"")
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", None if page_id is None else f"<{PREFIX}{page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else quote(url, safe="%/:?#[]@!$&'()*+,;=~-._")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", None if refers_to is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Refers-To", None if refers_to is None else f"<{PREFIX}{refers_to}>"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(body)),
    ]
    return _head(head, "WARC/1.1") + body + b"\r\n\r\n"


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def _number(value: str | None) -> int | None:
    return int(value[len(PREFIX) + 1 : -1]) if value else None


def parse_record(raw: bytes) -> dict:
    """What a record's bytes say: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    block, _, rest = raw.partition(b"\r\n\r\n")
    head = _headers(block)
    body = rest[: int(head["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    revisit = head["warc-type"] == "revisit"
    return {
        "page_id": _number(head.get("warc-record-id")),
        "payload_bytes": int(_headers(http)["content-length"]) if revisit else len(payload),
        "payload_digest": head["warc-payload-digest"].removeprefix("sha1:") if revisit else hashlib.sha1(payload).hexdigest(),
        "record_type": head["warc-type"],
        "refers_to": _number(head.get("warc-refers-to")),
    }


def inflate(source: pa.NativeFile) -> Iterator[bytes]:
    """The content of a gzip file, whether of one member or many, in pieces of PIECE bytes at most, however far it
    was compressed. A file that ends inside a member, its trailer included, is refused."""
    stream, begun = zlib.decompressobj(31), False
    while data := source.read(PIECE):
        more = True
        while data or more:
            out = stream.decompress(data, PIECE)
            yield out
            begun, more = not stream.eof, len(out) == PIECE
            data = stream.unconsumed_tail
            if stream.eof:
                data, more, stream = stream.unused_data, False, zlib.decompressobj(31)
    if begun:
        raise ValueError("the archive ends inside a gzip member")


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, one in memory at a time, cut out by their Content-Length."""
    held, start = bytearray(), 0
    need = None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n", start)
                if end < 0:
                    break
                need = end + 4 - start + int(_headers(bytes(held[start:end]))["content-length"]) + 4
            if len(held) - start < need:
                break
            yield bytes(held[start : start + need])
            start, need = start + need, None
        if start:
            del held[:start]
            start = 0
    if held:
        raise ValueError("the archive ends inside a record")


def link_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, payload_digest and refers_to of each row.

    Of rows with equal payloads of `least` bytes or more, those with the largest page_id are responses and the
    others refer to it. Only digests that several rows have are joined; that table is written first, so that
    both sides of the join come straight from an exchange, whose large partitions Spark splits.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).withColumn("payload_digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= least)
    groups = large.groupBy(F.col("payload_digest").alias("digest")).agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id")
    groups = write_table(groups, "warc-groups")
    joined = rows.join(groups, (F.col("payload_digest") == F.col("digest")) & (F.octet_length("payload") >= least), "left")
    other = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(other, F.col("first_id")).alias("refers_to"))


def write_archives(linked: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write each partition as one gzip stream; returns a written table of path and n_records.

    A file's name has its task attempt, and only attempts that succeed are in the table, so what a lost
    executor left behind is never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _place(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        name, n = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz", 0
        squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
            for batch in batches:
                columns = [batch.column(c) for c in ("page_id", "url", "payload", "payload_digest", "refers_to")]
                for row in zip(*columns, strict=True):
                    out.write(squeeze.compress(record_bytes(*(x.as_py() for x in row), date)))
                    n += 1
            out.write(squeeze.flush())
        if n:
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [n]})
        else:
            fs.delete_file(f"{base}/{name}")

    return write_table(linked.mapInArrow(run, "path string, n_records long"), "warc-files")


def _spread(files: DataFrame) -> DataFrame:
    """One file to a task."""
    return files.repartitionByRange(max(1, files.count()), "path")


def normalise_archives(files: DataFrame, folder: str) -> DataFrame:
    """Rewrite archives (column path) with a gzip member for each record and an index of lines
    `{"offset", "length", "id", "type"}` beside each; returns a written table of path, index and n_records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_fs, base = _place(folder)
        out_fs.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, source = _place(path)
                name = f"{source.rpartition('/')[2].removesuffix('.warc.gz')}-{attempt}.warc.gz"
                offset, n = 0, 0
                with fs.open_input_stream(source, compression=None) as raw, out_fs.open_output_stream(f"{base}/{name}", compression=None) as out, out_fs.open_output_stream(f"{base}/{name}.idx") as index:
                    for record in records(inflate(raw)):
                        squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = squeeze.compress(record) + squeeze.flush()
                        out.write(member)
                        head = _headers(record.partition(b"\r\n\r\n")[0])
                        index.write((json.dumps({"offset": offset, "length": len(member), "id": head.get("warc-record-id"), "type": head["warc-type"]}) + "\n").encode())
                        offset, n = offset + len(member), n + 1
                yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "index": [f"{folder}/{name}.idx"], "n_records": [n]})

    return write_table(_spread(files.select("path")).mapInArrow(run, "path string, index string, n_records long"), "warc-normal")


def read_member(source: pa.NativeFile, offset: int, length: int) -> bytes:
    """One record, by its place in a normalised archive."""
    source.seek(offset)
    return zlib.decompress(source.read(length), 31)


def read_archives(files: DataFrame) -> DataFrame:
    """Records of normalised archives, each read by its index entry. Digests of responses are computed anew."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    kind = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist(), strict=True):
                fs, source = _place(path)
                rows = []
                with fs.open_input_file(source) as archive, fs.open_input_stream(_place(index)[1]) as entries:
                    for line in _lines(entries):
                        entry = json.loads(line)
                        rows.append(parse_record(read_member(archive, entry["offset"], entry["length"])))
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema=kind)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return _spread(files.select("path", "index")).mapInArrow(run, schema)


def _lines(source: pa.NativeFile) -> Iterator[bytes]:
    rest = b""
    while data := source.read(PIECE):
        *whole, rest = (rest + data).split(b"\n")
        yield from whole


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive `pages` (page_id, url, html), normalise, and read back.

    A null html is empty; a null url has no header; a null page_id has no record id and reads back as null.
    Repeated rows give repeated records. An empty table gives no archive and no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    whole = write_archives(link_revisits(pages), f"{folder}/whole")
    return read_archives(normalise_archives(whole, f"{folder}/members"))

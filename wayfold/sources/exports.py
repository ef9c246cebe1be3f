"""Exports: GeoJSON and CSV, built as columns; documents of any length are written feature by feature."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ordered

#: Points of one line at most; a longer trajectory becomes several, which share their border points.
LINE_POINTS = 10_000
CSV = {"quote": '"', "escape": '"'}
_BEGIN, _END = '{"type":"FeatureCollection","features":[', "]}"


def geojson_lines(points: DataFrame, key: str, order: str, most: int = LINE_POINTS, altitude: bool = True) -> DataFrame:
    """key, part and a LineString feature of its points (lon, lat, alt) in order, `most` of them in each part, a part's
    last being the next one's first. Keys with fewer than two points are left out; a NaN altitude is 0.

    Properties are the number of points and, where `points` has north and east in metres, the length over them, to the
    millimetre. No group holds more than `most` + 1 points, however long a key is.
    """
    ties = [c for c in ("lon", "lat") if c != order]
    metric = {"east", "north"} <= set(points.columns)
    numbered = ordered.numbered(points, key, [order, *ties], "number")
    number = F.col("number")
    parts = F.array_distinct(F.array(F.floor(number / most), F.greatest(F.floor((number - 1) / most), F.lit(0))))  # a border point is in two
    dealt = numbered.withColumn("part", F.explode(parts))
    line = F.array_sort(F.collect_list(F.struct("number", "lon", "lat", *(["alt"] if altitude else []), *(["east", "north"] if metric else []))))
    rows = dealt.groupBy(key, "part").agg(line.alias("line")).where(F.size("line") >= 2)
    coordinates = F.transform("line", lambda p: F.array(p["lon"], p["lat"], *([F.nanvl(p["alt"], F.lit(0.0))] if altitude else [])))
    properties = [F.lit("trajectory").alias("kind"), F.size("line").alias("points")]
    if metric:
        steps = F.transform(F.sequence(F.lit(1), F.size("line") - 1), lambda i: F.hypot(F.get("line", i)["east"] - F.get("line", i - 1)["east"], F.get("line", i)["north"] - F.get("line", i - 1)["north"]))
        properties.append(F.round(F.aggregate(steps, F.lit(0.0), lambda s, x: s + x), 3).alias("length_m"))
    return rows.select(key, "part", _feature(properties, "LineString", coordinates).alias("feature"))


def _feature(properties: list[Column], kind: str, coordinates: Column) -> Column:
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry")), {"ignoreNullFields": "false"})


def geojson_assets(assets: DataFrame, key: str) -> DataFrame:
    """key and a Point feature of each asset (id, asset_class, lat, lon, alt, confidence, depth_m)."""
    properties = [F.lit("asset").alias("kind"), F.col("id"), F.col("asset_class").alias("class"), F.col("confidence"), F.col("depth_m")]
    return assets.select(key, _feature(properties, "Point", F.array("lon", "lat", F.nanvl("alt", F.lit(0.0)))).alias("feature"))


def parse_geojson(features: DataFrame, key: str, feature: str = "feature", most: int = LINE_POINTS) -> DataFrame:
    """key, n (from 0), lon, lat, alt of the points of LineString and MultiLineString features; a missing altitude is 0.
    Where `features` has part, parts follow one another and their border points count once."""
    part = F.col("part") if "part" in features.columns else F.lit(0)
    parsed = F.from_json(F.col(feature), "struct<geometry: struct<type: string, coordinates: string>>")["geometry"]
    given = features.select(key, part.alias("part"), parsed.alias("g")).where("g.type in ('LineString', 'MultiLineString')")
    line = F.when(F.col("g.type") == "LineString", F.from_json("g.coordinates", "array<array<double>>")).otherwise(F.flatten(F.from_json("g.coordinates", "array<array<array<double>>>")))
    rows = given.select(key, "part", F.posexplode(line).alias("at", "p"))
    # The border point is read where it ends a part, as the next part may have it alone and so not be there.
    rows = rows.withColumn("n", (F.col("part") * most + F.col("at")).cast("int")).where((F.col("at") > 0) | (F.col("part") == 0))
    return rows.select(key, "n", F.get("p", F.lit(0)).alias("lon"), F.get("p", F.lit(1)).alias("lat"), F.coalesce(F.get("p", F.lit(2)), F.lit(0.0)).alias("alt"))


def parse_assets(features: DataFrame, key: str, feature: str = "feature") -> DataFrame:
    """key, id, asset_class, lat, lon, alt, confidence and depth_m of the Point features."""
    parsed = F.from_json(F.col(feature), "struct<properties: struct<id: bigint, class: string, confidence: double, depth_m: double>, geometry: struct<type: string, coordinates: string>>")
    rows = features.select(key, parsed.alias("f")).where("f.geometry.type = 'Point'").withColumn("at", F.from_json("f.geometry.coordinates", "array<double>"))
    at = lambda i: F.get("at", F.lit(i))
    return rows.select(key, "f.properties.id", F.col("f.properties.class").alias("asset_class"), at(1).alias("lat"), at(0).alias("lon"), at(2).alias("alt"), "f.properties.confidence", "f.properties.depth_m")


def write_collections(features: DataFrame, key: str, order: list[str], folder: str) -> DataFrame:
    """One FeatureCollection document for each key, of features in order; a row of path, key and n_features for each.

    Features are dealt by key and sorted and stream to their file a line each, so a document of any length takes
    constant memory. Names carry the task attempt; whoever reads takes the paths from this result.
    """
    kind = dict(features.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        attempt, out, now, n, done = TaskContext.get().taskAttemptId(), None, None, 0, []
        for batch in batches:
            keys = batch.column(0)
            for at, feature in enumerate(batch.column(1).to_pylist()):
                if out is None or keys[at] != now:
                    if out is not None:
                        out.write(f"\n{_END}\n".encode())
                        out.close()
                        done[-1] = (*done[-1], n)
                    name, now, n = f"{len(done)}-{attempt}.geojson", keys[at], 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(_BEGIN.encode())
                    done.append((f"{folder}/{name}", now.as_py()))
                out.write(("," * (n > 0) + "\n" + feature).encode("utf-8", "surrogatepass"))
                n += 1
        if out is not None:
            out.write(f"\n{_END}\n".encode())
            out.close()
            done[-1] = (*done[-1], n)
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), batch.schema.field(0).type if out is not None else pa.int64(), pa.int64()))], names=["path", key, "n_features"])

    dealt = features.repartition(key).sortWithinPartitions(key, *order).select(key, "feature")
    return dealt.mapInArrow(run, f"path string, {key} {kind}, n_features long")


_TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*"|["{}\[\]]', re.S)
#: Bytes of a document that are read at a time.
READ = 1 << 20


class FeatureScanner:
    """Features of GeoJSON text of any layout, fed in pieces of any size: the elements of the array `features` of each
    object, or of an array at the top; an object that is itself a feature; a bare geometry, made one. It follows the depth
    of braces and brackets outside strings, and holds one feature, or what comes before the features, and no more."""

    def __init__(self) -> None:
        self.rest, self.scanned, self.depth, self.start = b"", 0, 0, -1
        self.inside = 0  # depth of the features' array, while in it
        self.found = self.bare = False  # whether this object has features; or is a geometry
        self.name = b""

    def feed(self, data: bytes) -> Iterator[bytes]:
        text, at = self.rest + data, self.scanned
        for m in _TOKEN.finditer(text, at):
            token = m.group()
            if token == b'"':  # a string that goes on in the next piece
                break
            at = m.end()
            if token[:1] == b'"':
                if self.depth == 1:
                    self.name = token
                    self.bare |= token in (b'"coordinates"', b'"geometries"')
            elif token in b"{[":
                if self.depth == 0:
                    self.start, self.found, self.bare, self.name = m.start(), token == b"[", False, b""
                    self.inside = int(token == b"[")
                elif self.depth == 1 and token == b"[" and self.name == b'"features"' and not self.inside:
                    self.found, self.inside, self.start = True, 2, -1
                elif self.depth == self.inside and token == b"{":
                    self.start = m.start()
                self.depth += 1
            else:
                self.depth -= 1
                if self.depth < 0:
                    raise ValueError("a document has more closing than opening brackets")
                if self.inside and self.depth == self.inside and token == b"}":
                    yield text[self.start : at]
                    self.start = -1
                elif self.inside and self.depth < self.inside:
                    self.inside = 0
                if self.depth == 0 and not self.found:
                    whole = text[self.start : at]
                    yield b'{"type":"Feature","properties":null,"geometry":' + whole + b"}" if self.bare else whole
                if self.depth == 0:
                    self.start = -1
        else:
            at = len(text)
        held = at if self.start < 0 else self.start
        self.rest, self.scanned = text[held:], at - held
        self.start = -1 if self.start < 0 else 0

    def end(self) -> None:
        if self.depth:
            raise ValueError("a document is cut off")


def read_collections(files: DataFrame, key: str) -> DataFrame:
    """key and feature of each feature of the GeoJSON documents (path, key), of any layout, whoever wrote them. A
    document that is cut off or no JSON is refused."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, path in enumerate(batch.column(0).to_pylist()):
                fs, place = pyarrow.fs.FileSystem.from_uri(path)
                scanner = FeatureScanner()
                with fs.open_input_stream(place, compression=None) as source:
                    while data := source.read(READ):
                        found = [x.decode("utf-8", "surrogatepass") for x in scanner.feed(data)]
                        yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array([at] * len(found), pa.int64())), pa.array(found, pa.string())], names=[key, "feature"])
                scanner.end()

    return files.select("path", key).mapInArrow(run, f"{key} {kind}, feature string")


def scan_features(documents: DataFrame, key: str, text: str) -> DataFrame:
    """key and feature of each feature of GeoJSON texts of any layout; null and empty texts have none."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, value in enumerate(batch.column(1)):
                scanner = FeatureScanner()
                found = [x.decode("utf-8", "surrogatepass") for x in scanner.feed((value.as_py() or "").encode("utf-8", "surrogatepass"))]
                scanner.end()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([at] * len(found), pa.int64())), pa.array(found, pa.string())], names=[key, "feature"])

    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, feature string")


#: Columns of the CSV files.
ASSETS = "id long, class string, lat double, lon double, alt double, confidence double, depth_m double, source_frame_id long"
TRAJECTORY = "timestamp_ns long, lat double, lon double, alt double, east double, north double, up double"
PLACES = "lat double, lon double, alt double"
SUMMARY = "stream string, samples long, rate_hz double, dropped long"


def csv_lines(rows: DataFrame, schema: str) -> DataFrame:
    """`rows` as lines `value` of a CSV file with the columns of `schema`, in its order: a NaN altitude is 0, nulls are
    empty, and fields with commas or quotes are quoted. The header is `csv_header(schema)`."""
    names = [x.split()[0] for x in schema.split(", ")]
    columns = [(F.nanvl(c, F.lit(0.0)).alias(c) if c == "alt" else F.col(c)) for c in names]
    return rows.select(F.to_csv(F.struct(*columns), CSV).alias("value"))


def csv_header(schema: str) -> str:
    return ",".join(x.split()[0] for x in schema.split(", "))


def parse_csv(lines: DataFrame, schema: str) -> DataFrame:
    return lines.select(F.from_csv("value", schema, CSV).alias("r")).select("r.*")

"""Tables along a space-filling curve, and queries that are asked again."""

import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import layout
from wayfold.operators import relational as rel
from wayfold.streaming import feed

SCHEMA = "id long, lat double, lon double"


def morton(lat, lon):
    side = 1 << layout.BITS
    y, x = (max(0, min(side - 1, int((v - low) / span * side))) for v, low, span in ((lat, -90.0, 180.0), (lon, -180.0, 360.0)))
    return sum(((x >> i & 1) << 2 * i) | ((y >> i & 1) << 2 * i + 1) for i in range(layout.BITS))


@pytest.fixture(scope="module")
def laid(spark, tmp_path_factory):
    draw = random.Random(12)
    rows = [(i, draw.uniform(-90, 90), draw.uniform(-180, 180)) for i in range(3000)] + [(5000 + i, 48.2 + draw.gauss(0, 0.01), 16.37 + draw.gauss(0, 0.01)) for i in range(3000)]
    rows += [(9000, 90.0, 180.0), (9001, -90.0, -180.0), (9002, None, 3.0), (9003, 10.0, 179.9999), (9004, 10.0, -179.9999)]
    folder = f"file://{tmp_path_factory.mktemp('layout')}/t"
    df = spark.createDataFrame(rows, SCHEMA)
    layout.write_layout(df, folder, zone_bits=12, files=16)
    return df, layout.read_layout(spark, folder, SCHEMA), rows


def test_numbers_follow_the_curve(laid):
    df, _, rows = laid
    got = {r["id"]: r["z"] for r in df.select("id", layout.z_number(F.col("lat"), F.col("lon")).alias("z")).collect()}
    assert all(got[i] == (None if a is None else morton(a, b)) for i, a, b in rows)


@pytest.mark.parametrize("box", [(48.19, 48.21, 16.36, 16.38), (-90.0, 90.0, -180.0, 180.0), (0.0, 0.0, 0.0, 0.0), (-10.0, 40.0, 170.0, -170.0), (9.0, 11.0, 179.9, 180.1), (5.0, 1.0, 0.0, 1.0), (89.0, 90.0, -180.0, 180.0)])
def test_boxes_lose_no_row(laid, box):
    _, table, rows = laid
    south, north, west, east = box
    if east > 180:
        inside = lambda x: x >= west or x <= east - 360
    else:
        inside = (lambda x: west <= x <= east) if west <= east else (lambda x: x >= west or x <= east)
    want = sorted(i for i, a, b in rows if a is not None and south <= a <= north and inside(b))
    assert sorted(r["id"] for r in layout.in_box(table, *box, zone_bits=12).collect()) == want


def test_radius_as_without_a_layout(laid):
    df, table, _ = laid
    want = {r["id"] for r in rel.within_radius(df, 48.2, 16.37, 700.0).collect()}
    got = {r["id"] for r in layout.within_radius(table, 48.2, 16.37, 700.0, 12).collect()}
    assert got == want and len(want) > 300


def test_ranges_are_few_and_tight():
    ranges = layout.box_ranges(48.19, 48.21, 16.36, 16.38)
    assert len(ranges) <= layout.MOST_RANGES and all(a <= b for a, b in ranges) and all(x[1] + 1 < y[0] for x, y in zip(ranges, ranges[1:]))
    cells = (0.02 / 180 * (1 << layout.BITS)) * (0.02 / 360 * (1 << layout.BITS))
    assert cells <= sum(b - a + 1 for a, b in ranges) < 2.5 * cells


def test_files_are_skipped_and_ranges_pushed(spark, laid):
    _, table, _ = laid
    spark.conf.set("spark.sql.maxMetadataStringLength", 100_000)
    found = layout.in_box(table, 48.19, 48.21, 16.36, 16.38, zone_bits=12)
    plan = found._jdf.queryExecution().executedPlan()
    found.collect()
    text = plan.toString()
    assert "GreaterThanOrEqual(z," in text and "GreaterThanOrEqual(lat,48.19)" in text and "PartitionFilters: [" in text and "zone" in text.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    scan = plan.collectLeaves().head()
    read, whole = scan.metrics().get("numFiles").get().value(), len(table.inputFiles())
    assert 0 < read < whole / 10


def test_two_writes_are_two_emissions(spark, tmp_path):
    folders = {n: f"file://{tmp_path}/{n}" for n in ("a", "b")}
    for n in folders:
        spark.range(0).select(F.col("id").alias("x")).write.parquet(folders[n])
    emitted = []

    def run():
        watch = feed.observe(spark, folders, lambda s: s.read.schema("x long").parquet(folders["a"]).join(s.read.schema("x long").parquet(folders["b"]), "x"), lambda df, n, names: emitted.append((df.count(), n, names)), f"file://{tmp_path}/seen")
        watch.trigger(availableNow=True).start().awaitTermination()

    run()
    emitted.clear()
    spark.range(5).select(F.col("id").alias("x")).write.mode("append").parquet(folders["a"])
    run()
    run()  # nothing new
    spark.range(3, 9).select(F.col("id").alias("x")).write.mode("append").parquet(folders["b"])
    run()
    assert [(n, names) for n, _, names in emitted] == [(0, {"a"}), (2, {"b"})] and emitted[0][1] < emitted[1][1]

"""A table laid out along a space-filling curve, so that a search by place reads few of its files.

Rows carry the number of their cell on a Z-order curve over latitude and longitude, are sorted by it, and stand in folders
by its leading bits. A box is broken into ranges of the curve: whole folders fall away by name, and in the others the
ranges, and the box itself, reach the Parquet scan, whose row groups have narrow bounds of all three.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo

#: Bits of a cell's number for each axis: about 0.3 m north to south. Ranges into which a box is broken at most.
BITS = 26
MOST_RANGES = 64


def _cell(value: Column, low: float, span: float) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit((1 << BITS) - 1), F.floor((value - low) / span * (1 << BITS)))).cast("long")


def _spread(x: Column) -> Column:
    """A zero between any two of the 26 bits."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def z_number(lat: Column, lon: Column) -> Column:
    """A cell's place on the curve; null without a place, and NaN counts as the last cell."""
    return F.when(lat.isNotNull() & lon.isNotNull(), _z(lat, lon))


def _z(lat: Column, lon: Column) -> Column:
    return F.shiftleft(_spread(_cell(lat, -90.0, 180.0)), 1).bitwiseOR(_spread(_cell(lon, -180.0, 360.0)))


def write_layout(df: DataFrame, folder: str, lat: str = "lat", lon: str = "lon", zone_bits: int = 30, files: int | None = None) -> None:
    """`df` with z and, as its folders, zone: the leading `zone_bits` bits of z, which is 52 bits long. Rows are dealt by
    ranges of z, about equal ones, so a crowded place is many files and tasks; rows without a place are in a zone of -1.
    Zones should hold some files' worth of rows each, where rows are dense."""
    z = F.coalesce(z_number(F.col(lat), F.col(lon)), F.lit(-1)).alias("z")
    placed = df.select("*", z).withColumn("zone", F.when(F.col("z") < 0, F.lit(-1)).otherwise(F.shiftright("z", 2 * BITS - zone_bits)))
    dealt = placed.repartitionByRange(files, "z") if files else placed.repartitionByRange("z")
    dealt.sortWithinPartitions("z").write.partitionBy("zone").parquet(folder)


def read_layout(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A table of `write_layout`; `schema` has the columns that were given to it."""
    return spark.read.schema(f"{schema}, z long, zone long").parquet(folder)


def box_ranges(south: float, north: float, west: float, east: float, most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Ranges of z, ends included, that together hold all cells of a box and few others. Quarters of quarters that the box
    cuts are cut further, the largest first, until there would be more than `most`; neighbours are joined."""
    side = 1 << BITS
    at = lambda v, low, span: max(0, min(side - 1, int((v - low) / span * side)))
    x0, x1, y0, y1 = at(west, -180.0, 360.0), at(east, -180.0, 360.0), at(south, -90.0, 180.0), at(north, -90.0, 180.0)
    if south > north or west > east:
        return []
    whole: list[tuple[int, int]] = []
    cut = [(0, 0, 0, BITS)]  # first z, x, y, level
    while cut and len(whole) + len(cut) + 3 <= most:
        cut.sort(key=lambda c: c[3])
        z, x, y, level = cut.pop()
        if not level:
            whole.append((z, z))
            continue
        half = 1 << (level - 1)
        for i in range(4):
            qx, qy, qz = x + (i & 1) * half, y + (i >> 1) * half, z + i * half * half
            if qx > x1 or qx + half <= x0 or qy > y1 or qy + half <= y0:
                continue
            if x0 <= qx and qx + half - 1 <= x1 and y0 <= qy and qy + half - 1 <= y1:
                whole.append((qz, qz + half * half - 1))
            else:
                cut.append((qz, qx, qy, level - 1))
    joined: list[tuple[int, int]] = []
    for a, b in sorted(whole + [(z, z + 4**level - 1) for z, _, _, level in cut]):
        if joined and joined[-1][1] + 1 >= a:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    return joined


def in_box(layout: DataFrame, south: float, north: float, west: float, east: float, lat: str = "lat", lon: str = "lon", zone_bits: int = 30) -> DataFrame:
    """Rows of a table of `write_layout` in a box, edges included; one whose west is beyond its east, or that reaches
    over the 180th meridian, goes round that way. The result has no z and zone."""
    sides = [(west, east)]
    if west < -180 or east > 180:
        west, east = (west + 180) % 360 - 180, (east + 180) % 360 - 180
        sides = [(west, east)]
    if west > east:
        sides = [(west, 180.0), (-180.0, east)]
    ranges = [r for a, b in sides for r in box_ranges(south, north, a, b, MOST_RANGES // len(sides))]
    shift = 2 * BITS - zone_bits
    zones = F.lit(False)
    for a, b in ranges:
        zones = zones | F.col("zone").between(a >> shift, b >> shift)
    along = F.lit(False)
    for a, b in ranges:
        along = along | F.col("z").between(a, b)
    beside = F.lit(False)
    for a, b in sides:
        beside = beside | F.col(lon).between(a, b)
    return layout.where(zones & along & F.col(lat).between(south, north) & beside).drop("z", "zone")


def within_radius(layout: DataFrame, lat: float, lon: float, radius_m: float, zone_bits: int = 30) -> DataFrame:
    """Rows within a radius of a table of `write_layout`, with distance_m."""
    south, north, west, east = geo.box_around(lat, lon, radius_m)
    near = in_box(layout, south, north, west, east, zone_bits=zone_bits)
    return near.withColumn("distance_m", geo.haversine_m(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))).where(F.col("distance_m") <= radius_m)

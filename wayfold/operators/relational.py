"""Searches, joins in space and time, and the store's write semantics, as DataFrame operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo, vision
from ..sources.shared import write_table
from . import ordered


def in_box(df: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """Rows inside a box, edges included; both ranges reach the Parquet scan where lat and lon are stored."""
    return df.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))


def within_radius(df: DataFrame, lat: float, lon: float, radius_m: float) -> DataFrame:
    """Rows within a radius, nearest first, with distance_m: the box first, then the exact distance."""
    near = in_box(df, *geo.box_around(lat, lon, radius_m))
    near = near.withColumn("distance_m", geo.haversine_m(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")))
    return near.where(F.col("distance_m") <= radius_m)


#: Rows of a place that go together, as blocks of arrays. A left block's rows are repeated for each right one, and Parquet's packed runs are of 504 values.
CHUNK_ROWS, BLOCK_ROWS = 2016, {"left": 168, "right": 8}
#: Of a place with more rows than this, they are numbered in several tasks.
NUMBERED_ROWS = 1 << 18
#: Pairs that a task makes: at least, for as many tasks as a shuffle has, and about at most.
PAIRS = 1 << 18, 1 << 25


def _chunks(rows: DataFrame, places: DataFrame, side: str) -> DataFrame:
    """Rows (a place and a struct `row`) in chunks of CHUNK_ROWS at most: place, number of the chunk, and `side`, an array of blocks, each a
    struct with an array for each field. Rows are numbered in their order, so that a task that runs again makes the same chunks."""
    place, salt, chunk = [f"{side}_y", f"{side}_x"], f"{side}_salt", f"{side}_chunk"
    crowded = places.where(F.col("n") > NUMBERED_ROWS).select(*place, F.ceil(F.col("n") / NUMBERED_ROWS).alias("parts"))  # at most one for so many rows
    salted = rows.join(F.broadcast(crowded), place, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0)))
    nth = F.row_number().over(W.partitionBy(*place, salt).orderBy("row")) - 1
    members = salted.withColumn(chunk, F.floor(nth / CHUNK_ROWS)).groupBy(*place, salt, chunk).agg(F.collect_list("row").alias("rows"))
    size = BLOCK_ROWS[side]
    block = lambda i: F.struct(*[F.slice(F.col("rows")[f], i, size).alias(f) for f in rows.schema["row"].dataType.names])
    return members.select(*place, salt, chunk, F.transform(F.sequence(F.lit(1), F.size("rows"), F.lit(size)), block).alias(side))


def _pairs(met: DataFrame, tasks: int) -> DataFrame:
    """The fields of both rows, and the other columns, for each pair of a row of `left` and one of `right` in chunks that met. What an explode makes
    of a row is held until the next operator has it, if the same generated code makes both; coalesce, here to as many
    partitions as there are, ends that code, so that a block of each side is the most that is held."""
    rest = [c for c in met.columns if c not in BLOCK_ROWS]
    fields = {side: met.schema[side].dataType.elementType.names for side in BLOCK_ROWS}
    blocks = met.select(F.explode("left").alias("left"), "right", *rest).select("left", F.explode("right").alias("right"), *rest)
    blocks = blocks.select(*[F.col(side)[f] for side in BLOCK_ROWS for f in fields[side]], *rest).toDF(*fields["left"], *fields["right"], *rest).coalesce(tasks)
    for side, other in (("right", "left"), ("left", "right")):
        here, there = fields[side], fields[other]
        if len(here) == 1:
            blocks = blocks.select(F.explode(here[0]).alias(here[0]), *there, *rest)
            continue
        each = F.explode(F.sequence(F.lit(0), F.size(here[0]) - 1)).alias("at")
        blocks = blocks.select(*here, *there, *rest, each).select(*[F.get(f, "at").alias(f) for f in here], *there, *rest)
    return blocks


def radius_join(left: DataFrame, right: DataFrame, radius_m: float, lat: tuple[str, str], lon: tuple[str, str], digits: int | None = None) -> DataFrame:
    """Pairs within a radius, anywhere on the globe, with distance_m, rounded to `digits`. Rows of cells are `radius_m` high; each row is divided, all round,
    into as many cells as may be at least as wide as two points within the radius can be apart there, which towards
    the poles is one. Each right place is put into its cell and the neighbours, numbered round the circle, so the join
    is by equal cells and a cell's places are all that meet.

    Rows of equal places are one there: distances are found once for two places. Their rows go in chunks; each two chunks
    of near places meet once, dealt out over as many tasks as their pairs need, and become pairs there, block by block."""
    half = math.sin(min(math.pi / 2, radius_m / (2 * geo.EARTH_RADIUS_M)))
    height = math.degrees(radius_m / geo.EARTH_RADIUS_M) * (1 + 1e-9)
    names = ("radius_row", "radius_column")

    def columns_in(row: Column) -> Column:
        """Cells of a row; points that a pair joins lie in this row and the next on either side."""
        farthest = F.least(F.lit(90.0), F.greatest(F.abs((row - 1) * height), F.abs((row + 2) * height)))
        apart = F.degrees(2 * F.asin(F.least(F.lit(1.0), half / F.greatest(F.cos(F.radians(farthest)), F.lit(1e-12))))) * (1 + 1e-9) + 1e-9
        return F.greatest(F.lit(1), F.floor(360 / apart).cast("long"))

    def column_of(lon_: Column, n: Column) -> Column:
        return F.pmod(F.floor((lon_ + 180) / 360 * n), n)

    rows, places = {}, {}
    for side, df, y_, x_ in zip(BLOCK_ROWS, (left, right), lat, lon, strict=True):
        own = [F.col(c).alias(f"{side}_c{i}") for i, c in enumerate(df.columns) if c not in (y_, x_)]
        placed = df.where(F.col(y_).isNotNull() & F.col(x_).isNotNull())
        rows[side] = placed.select(F.col(y_).alias(f"{side}_y"), F.col(x_).alias(f"{side}_x"), F.struct(*(own or [F.lit(0).alias(f"{side}_c")])).alias("row"))
        places[side] = rows[side].groupBy(f"{side}_y", f"{side}_x").agg(F.count("*").alias("n"))
    y, x = ([F.col(f"{side}_{c}") for side in BLOCK_ROWS] for c in "yx")
    row = F.floor(y[0] / height)
    a = places["left"].withColumnRenamed("n", "left_n").withColumn(names[0], row).withColumn(names[1], column_of(x[0], columns_in(row)))
    around = F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: F.floor(y[1] / height) + d)
    b = places["right"].withColumnRenamed("n", "right_n").withColumn(names[0], F.explode(around))
    n = columns_in(F.col(names[0]))
    beside = F.array_distinct(F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: F.pmod(column_of(x[1], n) + d, n)))
    b = b.withColumn(names[1], F.explode(beside))
    near = a.join(b, list(names)).withColumn("distance_m", geo.haversine_m(y[0], x[0], y[1], x[1], clamped=True)).where(F.col("distance_m") <= radius_m)
    if digits is not None:
        near = near.withColumn("distance_m", F.round("distance_m", digits))
    pairs = near.agg(F.sum(F.col("left_n").cast("double") * F.col("right_n"))).first()[0] or 0.0
    tasks = max(1, math.ceil(pairs / PAIRS[1]), min(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / PAIRS[0])))
    met = near.drop(*names, "left_n", "right_n")
    for side in ("right", "left"):
        met = met.join(_chunks(rows[side], places[side], side), [f"{side}_y", f"{side}_x"])
    numbers = [f"{side}_{c}" for side in BLOCK_ROWS for c in ("salt", "chunk")]
    found = _pairs(met.repartition(tasks, "left_y", "left_x", *numbers).drop(*numbers), tasks)
    of = lambda side, df, y_, x_: [F.col(f"{side}_y" if c == y_ else f"{side}_x" if c == x_ else f"{side}_c{i}").alias(c) for i, c in enumerate(df.columns)]
    return found.select(*of("left", left, lat[0], lon[0]), *of("right", right, lat[1], lon[1]), "distance_m")


def cosine_topk(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k most similar rows with their score, ties by id; Spark keeps k rows in each task."""
    q = F.array(*[F.lit(float(x)).cast("float") for x in query])
    scored = vectors.select(F.col(id_col), vision.cosine(F.col(vector_col), q).alias("score"))
    return scored.orderBy(F.col("score").desc(), id_col).limit(k)


def last_wins(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Insert-or-replace: for each key the row of the highest version."""
    best = F.max_by(F.struct(*rows.columns), F.col(version)).alias("row")
    return rows.groupBy(key).agg(best).select("row.*")


def insert(rows: DataFrame, new: DataFrame, key: str | None = None, label: str = "inserted") -> DataFrame:
    """The written table of `rows` and `new`. With `key`, new rows that have none get the numbers after the highest."""
    if key is not None:
        top = rows.agg(F.coalesce(F.max(key), F.lit(0)).alias("top"))  # an aggregate is one row
        given, open_ = new.where(F.col(key).isNotNull()), new.where(F.col(key).isNull())
        numbered = ordered.numbered_in_all(open_, [c for c in new.columns if c != key], "row_number").join(F.broadcast(top))
        new = given.unionByName(numbered.withColumn(key, (F.col("top") + F.col("row_number") + 1).cast(rows.schema[key].dataType)).drop("top", "row_number"))
    return write_table(rows.unionByName(new, allowMissingColumns=True), label)


def update(rows: DataFrame, where: Column, changes: dict[str, Column], label: str = "updated") -> DataFrame:
    """The written table of `rows` with `changes` in the rows for which `where` holds; they see the old values."""
    hit = F.coalesce(where, F.lit(False))
    return write_table(rows.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).cast(rows.schema[c].dataType).alias(c) if c in changes else F.col(c) for c in rows.columns]), label)


def delete(rows: DataFrame, where: Column, label: str = "deleted") -> DataFrame:
    """The written table of the rows for which `where` is not true."""
    return write_table(rows.where(~F.coalesce(where, F.lit(False))), label)


def migrate(rows: DataFrame, schema: str, label: str = "migrated") -> DataFrame:
    """The written table of `rows` in a later schema: columns that it adds are null, and those that it has not go.
    Columns are cast to their new type, and a value that has none is refused."""
    have = set(rows.columns)
    later = T._parse_datatype_string(schema).fields
    return write_table(rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in later]), label)


def persist(folder: str, batch: str, header: DataFrame, tables: dict[str, DataFrame]) -> list[tuple[str, bool, str | None]]:
    """Write a header and then each table under its name in `folder`, each by itself, so that one that fails costs none
    of the others: (name, whether it was written, why not). A header that fails fails all. Rows stand under the name of
    their `batch`, a column when they are read; a batch that is tried again replaces its own rows alone."""
    header.write.mode("overwrite").parquet(f"{folder}/header/batch={batch}")
    out: list[tuple[str, bool, str | None]] = []
    for name, rows in tables.items():
        try:
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")
            out.append((name, True, None))
        except Exception as e:  # whatever went wrong with one table
            out.append((name, False, f"{type(e).__name__}: {e}"[:500]))
    return out


def emit_batches(samples: DataFrame, key: str, ts: str, width_ns: int) -> DataFrame:
    """key, ts_ns and payload: the samples of each span of `width_ns` in order, under the time of the last."""
    payload = F.array_sort(F.collect_list(F.struct(ts, *[c for c in samples.columns if c not in (key, ts)])))
    spans = samples.groupBy(key, F.floor(F.col(ts) / width_ns).alias("span")).agg(F.max(ts).alias("ts_ns"), payload.alias("payload"))
    return spans.drop("span")


def without(rows: DataFrame, gone: DataFrame, key: str, gone_key: str | None = None) -> DataFrame:
    """Delete: rows whose key is not among `gone`; null keys stay."""
    other = gone.select(F.col(gone_key or key).alias("gone_key"))
    return rows.join(other, F.col(key) == F.col("gone_key"), "left_anti")


def _beside(left: DataFrame, right: DataFrame, key: str, ts: str, right_id: str, width_ns: int | None, also: Sequence[str] = ()) -> DataFrame:
    """Left rows with `before` and `after`, the times, ids and columns `also` of the last right row at or before and the next one after
    them. Both sides together fall into ranges of time; a range without one takes it from the nearest range that has
    one, over a table with a row for each range, so that a long trip is many tasks."""
    other = right.where(F.col(ts).isNotNull()).select(key, ts, right_id, F.struct(F.col(ts).alias("at"), F.col(right_id).alias("id"), *also).alias("right_row"))
    both = left.withColumn("side", F.lit(1)).unionByName(other.withColumn("side", F.lit(0)), allowMissingColumns=True)
    seen = F.col("right_row")  # null on the left
    last = F.max_by(seen, F.when(F.col("side") == 0, F.struct(F.col(ts), _falling(right_id, right))))
    rows = ordered.carry(ordered.bucketed(both, key, ts, width_ns), key, {"before_range": (last, "last"), "after_range": (F.min(seen), "next")})
    w = W.partitionBy(key, "bucket").orderBy(ts, "side", F.col(right_id).desc())
    ahead = W.partitionBy(key, "bucket").orderBy(F.col(ts).desc(), "side", F.col(right_id).desc()).rowsBetween(W.unboundedPreceding, -1)  # backwards, as Spark goes through all rows that follow for each row
    before, after = F.last(seen, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.last(seen, ignorenulls=True).over(ahead)
    rows = rows.withColumn("here_before", before).withColumn("here_after", after).where("side = 1")
    return rows.withColumn("before", F.coalesce("here_before", "before_range")).withColumn("after", F.coalesce("here_after", "after_range"))


def _falling(name: str, df: DataFrame) -> Column:
    """A number that falls as a numeric id rises: of equal times the smallest id is the last."""
    if not isinstance(df.schema[name].dataType, T.NumericType):
        raise TypeError(f"{name} must be a number")
    return -F.col(name)


def nearest_in_time(left: DataFrame, right: DataFrame, key: str, ts: str, right_id: str, tolerance_ns: int, width_ns: int | None = None, also: Sequence[str] = ()) -> DataFrame:
    """Each left row with the id and time, and the columns `also`, of the right row of its key that is nearest in time within a tolerance;
    null without one, and for a row without a time. Equal distances go to the earlier row, equal times to the smaller
    id, which is a number. Right rows without a time match nothing; null keys are a key."""
    both = _beside(left, right, key, ts, right_id, width_ns, also)
    back, forth = F.col(ts) - F.col("before.at"), F.col("after.at") - F.col(ts)
    pick = F.when(back.isNotNull() & (forth.isNull() | (back <= forth)), F.col("before")).otherwise(F.col("after"))
    gap = F.least(F.coalesce(back, forth), F.coalesce(forth, back))
    near = F.when(gap <= tolerance_ns, pick)
    return both.select(*left.columns, near["id"].alias("matched_id"), near["at"].alias("matched_ns"), *[near[c].alias(c) for c in also])


def latest_before(left: DataFrame, right: DataFrame, key: str, ts: str, right_id: str, width_ns: int | None = None) -> DataFrame:
    """Each left row with the last right row of its key at or before it, of equal times the largest id; null without
    one, and for a row without a time."""
    both = left.withColumn("side", F.lit(1)).unionByName(right.where(F.col(ts).isNotNull()).select(key, ts, right_id).withColumn("side", F.lit(0)), allowMissingColumns=True)
    found = ordered.with_last_known(both, key, [ts, "side", right_id], F.when(F.col("side") == 0, F.struct(F.col(ts).alias("at"), F.col(right_id).alias("id"))), "got", width_ns)
    return found.where("side = 1").select(*left.columns, F.col("got.id").alias("matched_id"), F.col("got.at").alias("matched_ns"))


def voxel_key(x: Column, y: Column, z: Column, size: float) -> Column:
    """Cell of a point: 21 bits for each axis."""
    part = lambda c: F.floor(c / size).cast("long").bitwiseAND(0x1FFFFF)
    return F.shiftleft(part(x), 42).bitwiseOR(F.shiftleft(part(y), 21)).bitwiseOR(part(z))

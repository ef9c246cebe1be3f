"""Running values along a key's order without one task for a key: rows fall into buckets of time, windows run inside
a bucket, and what one bucket hands to another is a small table of its own. A key of any length, or one with a third
of all rows, is worked on by as many tasks as it has buckets.

A bucket's width is taken from the data, for each key, so that in the densest stretch of the key a bucket has about
BUCKET_ROWS rows; a recording of a few hours is then cut as finely as it needs. Rows without a time are in a bucket of
their own, before all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import write_table

#: Rows of a bucket, about; stretches, of equal numbers of rows, of which a key's densest sets its width.
BUCKET_ROWS = 1 << 18
STRETCHES = 64


def listed(column: pa.Array) -> list:
    """`column.to_pylist()`, by numpy where that gives the same."""
    plain = (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)) and not column.null_count
    return column.to_numpy(zero_copy_only=False).tolist() if plain else column.to_pylist()


def _inside(key: str, order: list[str]) -> W:
    return W.partitionBy(key, "bucket").orderBy(*order)


def widths(df: DataFrame, key: str, by: str, rows: int = BUCKET_ROWS) -> DataFrame:
    """width_key and bucket_width of each key of more than `rows` rows, from counts and approximate quantiles: a row for each.
    All other keys are one bucket, and no quantiles are sought for them."""
    timed = df.where(F.col(by).isNotNull()).select(F.col(key).alias("timed_key"), F.col(by).alias("at"))
    long_ones = timed.groupBy(F.col("timed_key").alias("width_key")).agg(F.count("*").alias("n")).where(F.col("n") > rows)
    of_long = timed.join(F.broadcast(long_ones), F.col("timed_key").eqNullSafe(F.col("width_key")))  # fewer keys than rows / `rows`
    cuts = F.percentile_approx("at", [i / STRETCHES for i in range(STRETCHES + 1)], 20 * STRETCHES)
    found = of_long.groupBy("width_key", "n").agg(cuts.alias("cuts"))
    steps = F.filter(F.transform(F.sequence(F.lit(1), F.lit(STRETCHES)), lambda i: F.get("cuts", i) - F.get("cuts", i - 1)), lambda d: d > 0)
    width = F.ceil(F.least(F.coalesce(F.array_min(steps), F.lit(1)).cast("double") * float(rows * STRETCHES) / F.col("n"), F.lit(2.0**62)))  # nanoseconds times rows pass 64 bits
    return found.select("width_key", F.greatest(F.lit(1), width).cast("long").alias("bucket_width"))


def bucketed(df: DataFrame, key: str, by: str, width_ns: int | None = None) -> DataFrame:
    """`df` with `bucket`, by widths of `width_ns` or else from the data."""
    return _wide(df, key, by, width_ns).drop("bucket_width")


def _wide(df: DataFrame, key: str, by: str, width_ns: int | None) -> DataFrame:
    if width_ns is not None:
        wide = df.withColumn("bucket_width", F.lit(width_ns).cast("long"))
    else:
        wide = df.join(F.broadcast(widths(df, key, by)), F.col(key).eqNullSafe(F.col("width_key")), "left").drop("width_key")
    return wide.withColumn("bucket", F.when(F.col("bucket_width").isNull(), F.lit(0)).otherwise(F.floor(F.col(by) / F.col("bucket_width"))).cast("long"))


def carry(rows: DataFrame, key: str, handed: dict[str, tuple[Column, str]]) -> DataFrame:
    """`rows` with what the other buckets of their key hand on; `handed` names it, with the column that a bucket makes
    and how buckets are put together: the 'sum', 'max' or 'last' of those before, or the 'next' of those after."""
    summed = rows.groupBy(key, "bucket").agg(*[column.alias(name) for name, (column, _) in handed.items()])
    before = W.partitionBy(key).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(key).orderBy(F.col("bucket").desc()).rowsBetween(W.unboundedPreceding, -1)  # a frame of all that follow takes the square of the rows
    how = {"sum": lambda c: F.sum(c).over(before), "max": lambda c: F.max(c).over(before), "last": lambda c: F.last(c, ignorenulls=True).over(before), "next": lambda c: F.last(c, ignorenulls=True).over(after)}
    carried = summed.select(F.col(key).alias("carry_key"), F.col("bucket").alias("carry_bucket"), *[how[kind](name).alias(name) for name, (_, kind) in handed.items()])
    return rows.join(carried, F.col(key).eqNullSafe(F.col("carry_key")) & F.col("bucket").eqNullSafe(F.col("carry_bucket"))).drop("carry_key", "carry_bucket")


def numbered(df: DataFrame, key: str, order: list[str], name: str, width_ns: int | None = None) -> DataFrame:
    """`df` with the row's number in its key, from 0. The first of `order` is the time."""
    rows = carry(bucketed(df, key, order[0], width_ns), key, {"carried_rows": (F.count("*"), "sum")})
    here = F.row_number().over(_inside(key, order)) - 1
    return rows.withColumn(name, (here + F.coalesce("carried_rows", F.lit(0))).cast("long")).drop("bucket", "carried_rows")


def numbered_in_all(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """`df` with each row's number, from 0, in the order of all rows, which `order` should settle.

    Rows are sorted by ranges and written with their place in their range; the ranges' sizes, a row for each task, are
    added up and joined. No window holds all rows.
    """
    placed = write_table(df.orderBy(*order).withColumn("row_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("row_place", 33)
    sizes = placed.groupBy(part.alias("row_part")).agg(F.count("*").alias("part_rows"))
    earlier = F.coalesce(F.sum("part_rows").over(W.orderBy("row_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each task
    offsets = sizes.select("row_part", earlier.alias("part_from"))
    number = F.col("part_from") + F.col("row_place").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(offsets), part == F.col("row_part")).select(*df.columns, number.alias(name))


def with_previous(df: DataFrame, key: str, order: list[str], value: str, name: str, width_ns: int | None = None) -> DataFrame:
    """`df` with `value` of the row before in its key; null for the first. `value` is never null."""
    last = F.max_by(value, F.struct(*order))
    rows = carry(bucketed(df, key, order[0], width_ns), key, {"carried_last": (last, "last")})
    return rows.withColumn(name, F.coalesce(F.lag(value).over(_inside(key, order)), "carried_last")).drop("bucket", "carried_last")


def with_last_known(df: DataFrame, key: str, order: list[str], value: Column, name: str, width_ns: int | None = None) -> DataFrame:
    """`df` with the last `value` that is not null at or before the row in its key; null where there is none."""
    rows = bucketed(df, key, order[0], width_ns).withColumn("known", value)
    last = F.max_by("known", F.when(F.col("known").isNotNull(), F.struct(*order)))
    rows = carry(rows, key, {"carried_known": (last, "last")})
    here = F.last("known", ignorenulls=True).over(_inside(key, order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn(name, F.coalesce(here, "carried_known")).drop("bucket", "known", "carried_known")


def with_running_max(df: DataFrame, key: str, order: list[str], value: str, name: str, width_ns: int | None = None) -> DataFrame:
    """`df` with the largest `value` of the rows before in its key; null for the first."""
    rows = carry(bucketed(df, key, order[0], width_ns), key, {"carried_max": (F.max(value), "max")})
    here = F.max(value).over(_inside(key, order).rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn(name, F.greatest(here, "carried_max")).drop("bucket", "carried_max")


def with_first(df: DataFrame, key: str, order: list[str], firsts: dict[str, Column]) -> DataFrame:
    """`df` with columns taken from the first row of its key, found by partial aggregation."""
    first = df.groupBy(F.col(key).alias("first_key")).agg(F.min_by(F.struct(*[c.alias(n) for n, c in firsts.items()]), F.struct(*order)).alias("first_row"))
    return df.join(first, F.col(key).eqNullSafe(F.col("first_key"))).select(*df.columns, *[F.col(f"first_row.{n}").alias(n) for n in firsts])


def with_nth_before(df: DataFrame, key: str, order: list[str], n: int, value: str, name: str, width_ns: int | None = None) -> DataFrame:
    """`df` with `name`, the `value` of the row `n` before in its key or else of its first row, and `n_before`, how
    many rows lie between: an equi-join of numbered rows, not a window over the key."""
    rows = numbered(df, key, order, "row_number", width_ns)
    then = rows.select(F.col(key).alias("then_key"), F.col("row_number").alias("then_number"), F.col(value).alias(name))
    to = F.greatest(F.col("row_number") - n, F.lit(0))
    joined = rows.withColumn("to_number", to).join(then, F.col(key).eqNullSafe(F.col("then_key")) & (F.col("to_number") == F.col("then_number")))
    return joined.select(*df.columns, name, (F.col("row_number") - F.col("to_number")).alias("n_before"))


def last_rows(df: DataFrame, key: str, order: list[str], k: int, width_ns: int | None = None) -> DataFrame:
    """The last `k` rows of each key: first of each bucket, then of what is left."""
    falling = [F.col(c).desc() for c in order]
    rows = bucketed(df, key, order[0], width_ns).withColumn("rank", F.row_number().over(W.partitionBy(key, "bucket").orderBy(*falling))).where(F.col("rank") <= k)
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*falling))).where(F.col("rank") <= k).drop("bucket", "rank")


# Recurrences


def smoothed(df: DataFrame, key: str, order: list[str], values: list[str], step: Callable[[float, float], float], keep: float, start: float | None, width_ns: int | None = None) -> DataFrame:
    """`df` with `smooth_<v>` for each of `values`: the state after each row of a recurrence along its key, where a row
    takes state e to `step(e, v)`, which is `keep` * e and a part of the value alone. The state before a key's first row
    is `start`, or with None is the first row's value.

    A bucket's rows together are such a step, too: each bucket runs from a reference of its own, its first value or
    `start`, and keeps with every row the share `keep` ** i of the state before it that is left; these maps compose, so
    that a pass over a row for each bucket gives the states between buckets, and each row adds its share. A key that is
    one bucket gets what one run along it gives, bit for bit; others get it up to rounding, and equal values exactly.
    Rows with a null time or value are left out.
    """
    rows = bucketed(df.dropna(subset=[order[0], *values]), key, order[0], width_ns)
    fields = T._parse_datatype_string(", ".join(f"smooth_{v} double, from_{v} double" for v in values) + ", left_share double").fields
    schema = T.StructType([*rows.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taken, states = None, 0, {v: (0.0, 0.0) for v in values}
        for batch in batches:
            if not batch.num_rows:
                continue
            at = list(zip(listed(batch.column(key)), listed(batch.column("bucket")), strict=True))
            first = [a != b for a, b in zip(at, [now, *at], strict=False)]
            place = np.arange(batch.num_rows)
            begun = np.maximum.accumulate(np.where(first, place, -taken))  # rows of the batch before may have begun it
            columns = []
            for v in values:
                (e, reference), out, froms = states[v], [], []
                for x, begins in zip(listed(batch.column(v)), first, strict=True):
                    if begins:
                        e = reference = x if start is None else start
                    e = step(e, x)
                    out.append(e)
                    froms.append(reference)
                states[v] = e, reference
                columns += [pa.array(out, pa.float64()), pa.array(froms, pa.float64())]
            now, taken = at[-1], int(batch.num_rows - begun[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array(keep ** (place - begun + 1.0))], names=[f.name for f in schema.fields])

    dealt = rows.repartition(key, "bucket").sortWithinPartitions(key, "bucket", *order)
    ran = write_table(dealt.mapInArrow(run, schema), "smoothed")
    if ran.groupBy(key).agg(F.min("bucket").alias("low"), F.max("bucket").alias("high")).where("low < high").isEmpty():  # all are one run
        return ran.select(*df.columns, *[f"smooth_{v}" for v in values])
    ends = ran.groupBy(key, "bucket").agg(F.max_by(F.struct("left_share", *[x for v in values for x in (f"smooth_{v}", f"from_{v}")]), F.struct(*order)).alias("end"))
    ends = ends.select(key, "bucket", "end.*")
    states = T.StructType([rows.schema[key], rows.schema["bucket"], *T._parse_datatype_string(", ".join(f"state_{v} double" for v in values)).fields])

    def compose(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")
        share = table["left_share"].to_numpy()
        columns = []
        for v in values:
            end, reference = table[f"smooth_{v}"].to_numpy(), table[f"from_{v}"].to_numpy()
            state = reference.copy()  # before each bucket
            for i in range(1, len(state)):
                state[i] = end[i - 1] + share[i - 1] * (state[i - 1] - reference[i - 1])
            columns.append(pa.array(state))
        return pa.Table.from_arrays([table[key], table["bucket"], *columns], names=states.names)

    carried = ends.groupBy(key).applyInArrow(compose, states).withColumnsRenamed({key: "carry_key", "bucket": "carry_bucket"})
    met = ran.join(carried, F.col(key).eqNullSafe(F.col("carry_key")) & (F.col("bucket") == F.col("carry_bucket")))
    return met.select(*df.columns, *[(F.col(f"smooth_{v}") + F.col("left_share") * (F.col(f"state_{v}") - F.col(f"from_{v}"))).alias(f"smooth_{v}") for v in values])


# Rows that wait for the one accepted before


def _first_after(t: np.ndarray, gap: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each time the first row that is its own gap or more behind it; the number of rows where there is none."""
    found = np.full(len(last), len(t))
    for g in np.unique(gap):
        at = np.flatnonzero(gap == g)
        found = np.minimum(found, np.append(at, len(t))[np.searchsorted(t[at], last + g)])
    return found


def _ends(t: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(successor, last of the chain) of each row, by doubling."""
    after = _first_after(t, gap, t)
    end = np.where(after < len(t), after, np.arange(len(t)))
    while True:
        further = end[end]
        if (further == end).all():
            return after, end
        end = further


def _open(part: pa.Table, order: list[str]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    part = part.sort_by([(c, "ascending") for c in order])
    return part, part[order[0]].to_numpy(), part["own_gap"].to_numpy()


def accepted(df: DataFrame, key: str, order: list[str], gap: Column, width_ns: int | None = None) -> DataFrame:
    """The rows of `df` that are accepted along their key: the first, then each that comes its own `gap` or more after
    the last accepted one. A null gap accepts never, one of less than 1 counts as 1; rows without a time are left out.

    Each bucket makes a table of where a chain of accepted rows that enters it leaves it; chains enter at the few rows
    that are first at some gap from the bucket's beginning, and the row they leave by names the next entry. These
    successors, from bucket to bucket, are followed from each key's first row by doubling, and the buckets that are met
    run their chain. Each distinct gap multiplies the table of entries, so gaps should be few. Where a gap is longer than
    a bucket, all rows of the bucket are entries, and the table is as long as `df`, no longer.
    """
    rows = df.where(gap.isNotNull() & F.col(order[0]).isNotNull()).withColumn("own_gap", F.greatest(gap.cast("long"), F.lit(1)))
    rows = write_table(_wide(rows, key, order[0], width_ns), "waiting")
    kind, tie = rows.schema[key].dataType.simpleString(), rows.schema[order[1]].dataType.simpleString()

    def entries(part: pa.Table) -> pa.Table:
        part, t, gaps = _open(part, order)
        _, end = _ends(t, gaps)
        width = part["bucket_width"][0].as_py()
        begins = t[0] if width is None else part["bucket"][0].as_py() * width
        at = [np.flatnonzero(gaps == g) for g in np.unique(gaps)]
        open_ = np.sort(np.concatenate([x[np.append(True, t[x[:-1]] < begins + gaps[x[0]])] for x in at]))
        return pa.Table.from_arrays([part[key].take(open_), pa.array(gaps[open_]), pa.array(t[open_]), part[order[1]].take(open_), pa.array(t[end[open_]]), part["bucket"].take(open_)], names=["k", "gap", "t", "tie", "leaves", "b"])

    border = write_table(rows.select(key, "bucket", "bucket_width", *order, "own_gap").groupBy(key, "bucket").applyInArrow(entries, f"k {kind}, gap long, t long, tie {tie}, leaves long, b long"), "entries")
    first = border.groupBy("k").agg(F.min(F.struct("t", "tie", "leaves", "b")).alias("e"))
    chain = write_table(first.select("k", "e.*"), "chain")
    if border.select("k", "b").distinct().count() > chain.count():
        chain = _followed(border, chain)

    columns = df.columns

    def fill(part: pa.Table, entry: pa.Table) -> pa.Table:
        part, t, gaps = _open(part, order)
        if not part.num_rows or not entry.num_rows:
            return part.select(columns).slice(0, 0)
        after, _ = _ends(t, gaps)
        place = int(np.searchsorted(t, entry["t"][0].as_py()))
        while part[order[1]][place].as_py() != entry["tie"][0].as_py():
            place += 1
        taken = []
        while place < len(t):
            taken.append(place)
            place = int(after[place])
        return part.select(columns).take(pa.array(taken, pa.int64()))

    return rows.groupBy(key, "bucket").cogroup(chain.groupBy("k", "b")).applyInArrow(fill, df.schema)


def _followed(border: DataFrame, chain: DataFrame) -> DataFrame:
    """`chain` (k, t, tie, leaves, b) with all entries that follow it, by doubling."""
    gaps = border.groupBy(F.col("k").alias("gap_key")).agg(F.collect_set("gap").alias("gaps"))
    exits = border.select("k", "leaves").distinct().join(gaps, F.col("k").eqNullSafe(F.col("gap_key"))).withColumn("gap", F.explode("gaps"))
    at = exits.select("k", "gap", "leaves", (F.col("leaves") + F.col("gap")).alias("t"), F.lit(None).cast(border.schema["tie"].dataType).alias("tie"), F.lit(None).cast("long").alias("goes"), F.lit(None).cast("long").alias("b"), F.lit(0).alias("side"))
    to = border.select("k", "gap", F.lit(None).cast("long").alias("leaves"), "t", "tie", F.col("leaves").alias("goes"), "b", F.lit(1).alias("side"))
    both = at.unionByName(to).withColumn("lane", F.struct("k", "gap"))
    rows = bucketed(both, "lane", "t")
    mark = F.when(F.col("side") == 1, F.struct("t", "tie", "goes", "b"))
    rows = carry(rows, "lane", {"later": (F.min(mark), "next")})
    here = F.last(mark, ignorenulls=True).over(W.partitionBy("lane", "bucket").orderBy(*[F.col(c).desc() for c in ("t", "side", "tie")]).rowsBetween(W.unboundedPreceding, -1))
    found = rows.withColumn("entry", F.coalesce(here, "later")).where("side = 0 and entry is not null")
    links = found.groupBy("k", "leaves").agg(F.min("entry").alias("entry"))
    links = write_table(links.select("k", "leaves", F.col("entry.t").alias("t"), F.col("entry.tie").alias("tie"), F.col("entry.goes").alias("goes"), F.col("entry.b").alias("b")), "links")
    jump = links.select(F.col("k").alias("j"), F.col("leaves").alias("here"), F.col("goes").alias("there"))
    reached = chain.select("k", "leaves").distinct()
    n = reached.count()
    while True:
        more = reached.join(jump, F.col("k").eqNullSafe(F.col("j")) & (F.col("leaves") == F.col("here"))).select("k", F.col("there").alias("leaves"))
        reached = write_table(reached.unionByName(more).distinct(), "reached")
        before, n = n, reached.count()
        if n == before:
            break
        far = jump.select(F.col("j").alias("j2"), F.col("here").alias("h2"), F.col("there").alias("far"))
        jump = write_table(jump.join(far, F.col("j").eqNullSafe(F.col("j2")) & (F.col("there") == F.col("h2"))).select("j", "here", F.col("far").alias("there")), "jumps")
    on = links.select(F.col("k").alias("l"), F.col("leaves").alias("left_by"), "t", "tie", "goes", "b")
    entered = reached.join(on, F.col("k").eqNullSafe(F.col("l")) & (F.col("leaves") == F.col("left_by"))).select("k", "t", "tie", F.col("goes").alias("leaves"), "b")
    return write_table(chain.unionByName(entered).distinct(), "chain")

"""The monitor of sample streams: order, gaps, offset, latency, drift and rate of each stream, batch by batch.
`wayfold.streaming.stateful` keeps the same state for a stream.

Its state is a table with a row for each stream. A batch of samples is dealt by stream together with the state
so far, sorted by arrival behind it, and streams through, so that a stream of any rate takes constant memory
and the batches give what one batch of all samples would.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import ordered

#: Fixed values of the monitor: smoothing, samples before the baseline, periods that make a gap, rate window; a kind of
#: warning comes at most once in WARN_EVERY samples.
ALPHA, WARM_UP, GAP_PERIODS, RECENT, WARN_EVERY = 0.05, 32, 2.5, 64, 64

STATE = "stream_id string, offset_ns long, received long, dropped long, out_of_order long, gaps long, last_ns long, latency_ns long, smooth_ns double, base_ns long, drift_ns long, recent array<long>"


@dataclass
class State:
    """What is known of a stream; `offset_ns` is None until its first sample."""

    stream_id: str | None
    offset_ns: int | None = None
    received: int = 0
    dropped: int = 0
    out_of_order: int = 0
    gaps: int = 0
    last_ns: int | None = None
    latency_ns: int = 0
    smooth_ns: float = 0.0
    base_ns: int | None = None
    drift_ns: int = 0
    recent: deque = field(default_factory=lambda: deque(maxlen=RECENT))

    def take(self, raw_ns: int, arrival_ns: int, nominal_ns: int = 0) -> bool:
        """A sample before the newest accepted one is counted and otherwise ignored; whether it was accepted."""
        if self.offset_ns is None:
            self.offset_ns = arrival_ns - raw_ns
        before, now = self.received, raw_ns + self.offset_ns
        self.received += 1
        if self.last_ns is not None:
            step = now - self.last_ns
            if step < 0:
                self.out_of_order += 1
                return False
            if nominal_ns > 0 and step > int(nominal_ns * GAP_PERIODS):
                self.gaps += 1
                self.dropped += max(0, step // nominal_ns - 1)
        self.last_ns, self.latency_ns = now, arrival_ns - now
        self.smooth_ns = float(self.latency_ns) if not before else self.smooth_ns + ALPHA * (self.latency_ns - self.smooth_ns)
        if self.base_ns is None and before >= WARM_UP:
            self.base_ns = int(self.smooth_ns)
        self.drift_ns = 0 if self.base_ns is None else int(self.smooth_ns) - self.base_ns
        self.recent.append(now)
        return True


def advance(samples: DataFrame, states: DataFrame, nominal_ns: int) -> DataFrame:
    """States after `samples` (stream_id, seq, raw_ns, arrival_ns), taken by arrival, then seq.

    Streams without new samples keep their state. A null stream_id is a stream; samples without a raw or
    arrival time are left out. Empty tables give the other's streams.
    """
    kind = to_arrow_schema(T._parse_datatype_string(STATE))
    names = kind.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([asdict(now) | {"recent": list(now.recent)}], schema=kind)

        now: State | None = None
        for batch in batches:
            for r in batch.to_pylist():
                if now is not None and now.stream_id != r["stream_id"]:
                    yield row()
                    now = None
                if r["state"] is not None:
                    now = State(**(r["state"] | {"recent": deque(r["state"]["recent"], RECENT)}))
                    continue
                now = now or State(r["stream_id"])
                now.take(r["raw_ns"], r["arrival_ns"], nominal_ns)
        if now is not None:
            yield row()

    new = samples.where("raw_ns is not null and arrival_ns is not null").select("stream_id", "seq", "raw_ns", "arrival_ns")
    both = states.select("stream_id", F.struct(*names).alias("state")).unionByName(new, allowMissingColumns=True)
    dealt = both.repartition("stream_id").sortWithinPartitions("stream_id", F.col("state").isNull(), "arrival_ns", "seq")
    return dealt.select("stream_id", "raw_ns", "arrival_ns", "state").mapInArrow(run, STATE)


def snapshot(states: DataFrame) -> DataFrame:
    """Health of each stream: the state with the rate over its latest samples in place of these."""
    n, span = F.size("recent"), F.element_at("recent", -1) - F.get("recent", F.lit(0))
    rate = F.when((n > 1) & (span > 0), (n - 1) * 1e9 / span).otherwise(0.0)
    return states.withColumn("rate_hz", rate).drop("recent", "smooth_ns", "base_ns")


_ORDER = ["arrival_ns", "seq"]


def _accepted(samples: DataFrame, width_ns: int | None) -> DataFrame:
    """Samples in order of arrival that are not before the newest accepted one of their stream, with `before`, how many
    were received before, latency_ns and drift_ns."""
    given = samples.where("raw_ns is not null and arrival_ns is not null").select("stream_id", "seq", "raw_ns", "arrival_ns")
    given = ordered.with_first(given, "stream_id", _ORDER, {"offset_ns": F.col("arrival_ns") - F.col("raw_ns")})
    rows = ordered.carry(ordered.bucketed(given, "stream_id", "arrival_ns", width_ns), "stream_id", {"rows_before": (F.count("*"), "sum"), "top_before": (F.max("raw_ns"), "max")})
    w = W.partitionBy("stream_id", "bucket").orderBy(*_ORDER)
    top = F.greatest(F.max("raw_ns").over(w.rowsBetween(W.unboundedPreceding, -1)), "top_before")
    before = F.row_number().over(w) - 1 + F.coalesce("rows_before", F.lit(0))
    rows = rows.withColumn("top", top).withColumn("before", before).where("top is null or raw_ns >= top")
    late = rows.select("stream_id", *_ORDER, "before", (F.col("arrival_ns") - F.col("raw_ns") - F.col("offset_ns")).alias("latency_ns"))
    late = late.withColumn("late", F.col("latency_ns").cast("double"))
    smooth = ordered.smoothed(late, "stream_id", _ORDER, ["late"], lambda e, v: e + ALPHA * (v - e), 1 - ALPHA, None, width_ns).withColumn("now", F.col("smooth_late").cast("long"))
    base = smooth.where(F.col("before") >= WARM_UP).groupBy(F.col("stream_id").alias("base_of")).agg(F.min_by(F.struct("before", "now"), "before").alias("base"))
    met = smooth.join(base, F.col("stream_id").eqNullSafe(F.col("base_of")), "left")
    drift_ns = F.when(F.col("before") >= F.col("base.before"), F.col("now") - F.col("base.now")).otherwise(F.lit(0)).cast("long")
    return met.select("stream_id", "seq", "before", "latency_ns", drift_ns.alias("drift_ns"))


def drift(samples: DataFrame, width_ns: int | None = None) -> DataFrame:
    """stream_id, seq and the drift after each accepted sample, in order of arrival: how far the smoothed latency has
    gone from what it was after the stream's warm-up. Samples without a raw or arrival time are left out.

    A long stream is smoothed in buckets, whose states compose up to rounding, so a drift may there be a nanosecond off
    what one run along the stream gives."""
    return _accepted(samples, width_ns).select("stream_id", "seq", "drift_ns")


def warnings(samples: DataFrame, budget_ns: int, threshold_ns: int, width_ns: int | None = None, every_width: int | None = None) -> DataFrame:
    """stream_id, seq, late and drifts of accepted samples that warn, in order of arrival: `late` of a latency above
    `budget_ns`, `drifts` of a drift beyond `threshold_ns` either way. Each kind comes WARN_EVERY received samples or
    more after its last."""
    kinds = F.array(F.when(F.col("latency_ns") > budget_ns, "late"), F.when(F.abs("drift_ns") > threshold_ns, "drifts"))
    wrong = _accepted(samples, width_ns).withColumn("kind", F.explode(F.array_compact(kinds)))
    lanes = wrong.select(F.struct("stream_id", F.nullif("kind", F.lit("")).alias("kind")).alias("lane"), "before", "seq")  # nullable, as Arrow gives it
    told = ordered.accepted(lanes, "lane", ["before", "seq"], F.lit(WARN_EVERY), every_width).select("lane.*", "seq", "before")
    said = told.groupBy("stream_id", "seq", "before").agg(*[F.max(F.col("kind") == k).alias(k) for k in ("late", "drifts")])
    return said.drop("before")

"""Operators with keyed state and timers, for streams that never end: the stream monitor, and messages by count or time.

State is kept in the state store under the query's checkpoint, so that a restart goes on from it, and a micro-batch
touches only the keys that it has rows of. A key's rows of one micro-batch are sorted in memory, three numbers a row;
what a micro-batch takes at most is set at its source.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import monitor
from ..operators.monitor import RECENT, State

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in the store that keyed state and timers need; the session's own setting
    is as before afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def run_all(spark: SparkSession, query) -> None:
    """Start `query` (a writer) on what its source has, and wait until it is used up."""
    with state_store(spark):
        query.trigger(availableNow=True).start().awaitTermination()


_VALUES = [x.strip() for x in monitor.STATE.split(",") if not x.strip().startswith(("stream_id", "recent"))]
HEALTH = ", ".join(["stream_id string", *_VALUES, "recent array<long>"])


class Monitor(StatefulProcessor):
    """Health of a stream: its numbers as a value, its latest times as a list."""

    def __init__(self, nominal_ns: int) -> None:
        self.nominal_ns = nominal_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getValueState("values", ", ".join(_VALUES))
        self.recent = handle.getListState("recent", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _VALUES]
        known = dict(zip(names, self.values.get(), strict=True)) if self.values.exists() else {}
        now = State(key[0], **known, recent=deque((x[0] for x in self.recent.get()), RECENT))
        samples = pd.concat(list(rows)).sort_values(["arrival_ns", "seq"], kind="stable")
        for raw, arrival in zip(samples["raw_ns"].tolist(), samples["arrival_ns"].tolist(), strict=True):
            now.take(raw, arrival, self.nominal_ns)
        told = asdict(now)
        self.values.update(tuple(told[n] for n in names))
        self.recent.put([(x,) for x in now.recent])
        whole = {k: pd.Series([v], dtype="Int64") if k.endswith("_ns") and k != "smooth_ns" else [v] for k, v in told.items() if k != "recent"}
        yield pd.DataFrame(whole | {"recent": [list(now.recent)]})


def watch(samples: DataFrame, folder: str, nominal_ns: int) -> DataFrame:
    """Run the monitor over a stream of samples (stream_id, seq, raw_ns, arrival_ns) until its source is used up, and give
    each stream's health then: `monitor.snapshot` of its state. Micro-batches are in order of time, rows inside one are
    put in order of arrival; samples without a raw or arrival time are left out, a null stream_id is a stream.

    Each micro-batch emits the streams that it changed, under its number, so that a batch that is tried again replaces
    its own rows alone. A later run in the same folder goes on from there, and with nothing new gives the last health.
    """
    spark = samples.sparkSession
    given = samples.where("raw_ns is not null and arrival_ns is not null").select("stream_id", "seq", "raw_ns", "arrival_ns")
    health = given.groupBy("stream_id").transformWithStateInPandas(Monitor(nominal_ns), HEALTH, "Update", "None")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/health/batch={number}")

    run_all(spark, health.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/progress"))
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/health")
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        return monitor.snapshot(spark.createDataFrame([], HEALTH))
    told = spark.read.schema(f"{HEALTH}, batch long").parquet(f"{folder}/health")
    last = told.groupBy(F.col("stream_id").alias("of")).agg(F.max_by(F.struct(*[c for c in told.columns if c != "batch"]), "batch").alias("last"))
    return monitor.snapshot(last.select("last.*"))


#: Samples that are sent together, and how long the first of fewer waits.
SENT, WAIT_MS = 32, 50


class Sender(StatefulProcessor):
    """Samples wait in a list until there are `most`, or until the first has waited `wait_ms`."""

    def __init__(self, most: int, wait_ms: int) -> None:
        self.most, self.wait_ms = most, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "raw_ns long, seq long, value double")

    def _sent(self, key, rows: list[tuple], why: str) -> pd.DataFrame:
        raw, seq, value = ([r[i] for r in rows] for i in range(3))
        return pd.DataFrame({"stream_id": [key[0]], "ts_ns": [raw[-1]], "n": [len(rows)], "why": [why], "seqs": [seq], "values": [value]})

    def _forget_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at if isinstance(at, int) else at[0])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = list(self.waiting.get())
        new = pd.concat(list(rows)).sort_values(["raw_ns", "seq"], kind="stable")
        all_ = [tuple(x) for x in before] + list(zip(new["raw_ns"].tolist(), new["seq"].tolist(), new["value"].tolist(), strict=True))
        full = len(all_) // self.most * self.most
        for at in range(0, full, self.most):
            yield self._sent(key, all_[at : at + self.most], "count")
        rest = all_[full:]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if full or not before:
            self._forget_timers()
            if rest:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rest = [tuple(x) for x in self.waiting.get()]
        if rest:
            self.waiting.clear()
            yield self._sent(key, rest, "time")


MESSAGE = "stream_id string, ts_ns long, n long, why string, seqs array<long>, values array<double>"


def send(samples: DataFrame, most: int = SENT, wait_ms: int = WAIT_MS) -> DataFrame:
    """A stream of messages from a stream of samples (stream_id, raw_ns, seq, value): `most` samples of a stream, in order
    of time inside a micro-batch, under the time of the last (why: 'count'), and what is fewer once the first of them has
    waited `wait_ms` (why: 'time'), at the end of the micro-batch that comes then. Samples without a time are left out.
    Start it inside `state_store`."""
    given = samples.where("raw_ns is not null").select("stream_id", "raw_ns", "seq", "value")
    return given.groupBy("stream_id").transformWithStateInPandas(Sender(most, wait_ms), MESSAGE, "Append", "ProcessingTime")

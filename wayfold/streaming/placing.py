"""Online georeferencing of a stream: poses wait for late fixes, and early fixes for poses, in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.georef import KEEP_NS, PLACED, Aligner

_COLUMNS = [x.split()[0] for x in PLACED.split(", ")]


class Placer(StatefulProcessor):
    """`georef.Aligner` of a trip: kept poses as a map by time, fixes that wait and pairs as lists, the alignment as a
    value. A timer of event time forgets poses and waiting fixes when no pose has come for as long as poses are kept."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.poses = handle.getMapState("poses", "ts_ns long", "a double, b double, c double")
        self.pending = handle.getListState("pending", "ts_ns long, a double, b double, c double")
        self.pairs = handle.getListState("pairs", ", ".join(f"p{i} double" for i in range(6)))
        self.known = handle.getValueState("known", "scale double, rotation array<double>, shift array<double>, rms double, number long, vps boolean")

    def _load(self) -> Aligner:
        now = Aligner()
        now.poses = {k[0]: tuple(v) for k, v in self.poses.iterator()}
        now.times = sorted(now.poses)
        now.pending = [(x[0], tuple(x[1:])) for x in self.pending.get()]
        now.pairs = [tuple(x) for x in self.pairs.get()]
        if self.known.exists():
            scale, rotation, shift, rms, now.number, now.vps = self.known.get()
            if scale is not None:
                now.known = (scale, np.array(rotation).reshape(3, 3), np.array(shift), rms)
        return now

    def _save(self, now: Aligner, before: set[int]) -> None:
        for ts in before - now.poses.keys():
            self.poses.removeKey((ts,))
        for ts in now.poses.keys() - before:
            self.poses.updateValue((ts,), now.poses[ts])
        for state, rows in ((self.pending, [(ts, *place) for ts, place in now.pending]), (self.pairs, now.pairs)):
            if rows:
                state.put([tuple(float(x) if i or state is self.pairs else x for i, x in enumerate(r)) for r in rows])
            else:
                state.clear()
        scale, rotation, shift, rms = now.known or (None, None, None, None)
        known = (None,) * 4 if now.known is None else (float(scale), rotation.ravel().tolist(), shift.tolist(), float(rms))
        self.known.update((*known, now.number, now.vps))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self._load()
        before = set(now.poses)
        events = pd.concat(list(rows)).sort_values(["at_ns", "kind", "id"], kind="stable")
        out = []
        for kind, number, at, ts, a, b, c, tracking, pairs in zip(*(events[x] for x in ("kind", "id", "at_ns", "ts_ns", "a", "b", "c", "tracking", "pairs")), strict=True):
            event = {"trip_id": key[0], "kind": kind, "id": number, "at_ns": at, "ts_ns": ts, "a": a, "b": b, "c": c, "tracking": tracking, "pairs": pairs}
            made = now.take(event)
            if made is not None:
                out.append(made)
        self._save(now, before)
        if now.times:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
            self.handle.registerTimer((now.times[-1] + KEEP_NS) // 1_000_000)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.poses.clear()
        self.pending.clear()
        return iter(())


def place(events: DataFrame, delay: str = "1 second") -> DataFrame:
    """The places of `georef.online` for a stream of its events, which has besides `at`, the arrival as a timestamp.
    Micro-batches come in order of arrival, rows inside one are put in that order; a fix may be of any time before or after
    its arrival. Events without a time or place are left out, and those that arrive `delay` behind the newest are late and
    dropped by the watermark. Start it inside `stateful.state_store`."""
    given = events.where("kind = 'vps' or (ts_ns is not null and a is not null and b is not null and c is not null)")
    return given.withWatermark("at", delay).groupBy("trip_id").transformWithStateInPandas(Placer(), PLACED, "Append", "EventTime")

"""Placing trajectories on the map: online alignment with late fixes, and refinement by a pose graph."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from ..sources.shared import write_table
from . import ordered, solve
from . import relational as rel

#: Fixed values of online alignment: gates, pairing tolerance, how long poses are kept, and capacities.
MAX_ACCURACY_M, MAX_RMS_M, SCALES = 35.0, 18.0, (0.5, 2.0)
PAIR_NS, KEEP_NS, MOST_POSES, MOST_PENDING, MOST_PAIRS = 100_000_000, 20_000_000_000, 16_000, 64, 600
#: Fixed values of refinement: nearest node within a second, weight of odometry, damping, iterations, last step.
NEAR_NS, ODOMETRY, DAMPING, ROUNDS, STEP = 1_000_000_000, 50.0, 1e-6, 25, 1e-6
#: Poses of a longer trajectory, and pairs of alignments solved together, that a task holds at once; they change no result.
PIECE, STACKED = 4000, 50_000


def origins(fixes: DataFrame) -> DataFrame:
    """trip_id and the place (lat0, lon0, alt0) of its first fix that passes the accuracy gate."""
    passed = fixes.where(~((F.col("h_acc_m") > MAX_ACCURACY_M) & (F.col("h_acc_m") >= 0)))
    first = F.min_by(F.struct("lat", "lon", "alt"), F.struct("ts_ns", "fix_id")).alias("o")
    return passed.groupBy("trip_id").agg(first).select("trip_id", F.col("o.lat").alias("lat0"), F.col("o.lon").alias("lon0"), F.col("o.alt").alias("alt0"))


def fixes_in_enu(fixes: DataFrame) -> DataFrame:
    """Fixes that pass the gate, with east, north and up from their trip's origin."""
    passed = fixes.where(~((F.col("h_acc_m") > MAX_ACCURACY_M) & (F.col("h_acc_m") >= 0)))
    placed = passed.join(origins(fixes), "trip_id")
    e, n, u = geo.to_enu(*(F.col(c) for c in ("lat", "lon", "alt", "lat0", "lon0", "alt0")))
    return placed.withColumns({"east": e, "north": n, "up": u})


def _passes(scale: float | np.ndarray, rms: float | np.ndarray, any_scale: bool) -> bool | np.ndarray:
    """Whether an alignment is good enough to be used."""
    return np.isfinite(rms) & (rms <= MAX_RMS_M) & (any_scale | ((SCALES[0] <= scale) & (scale <= SCALES[1])))


class Aligner:
    """Alignment of one trip as its events arrive: kept poses in order of time, fixes that wait, pairs, what is known."""

    def __init__(self) -> None:
        self.times: list[int] = []
        self.poses: dict[int, tuple] = {}
        self.pending: list[tuple] = []
        self.pairs: list[tuple] = []
        self.known: tuple | None = None
        self.number, self.vps = 0, False

    def nearest(self, ts: int) -> tuple | None:
        i = bisect.bisect_left(self.times, ts)
        near = min(self.times[max(0, i - 1) : i + 1], key=lambda x: abs(x - ts), default=None)
        return self.poses[near] if near is not None and abs(near - ts) <= PAIR_NS else None

    def keep(self, ts: int, here: tuple) -> None:
        if ts not in self.poses:
            bisect.insort(self.times, ts)
        self.poses[ts] = here
        gone = max(bisect.bisect_left(self.times, ts - KEEP_NS), len(self.times) - MOST_POSES)
        for old in self.times[: max(0, gone)]:
            del self.poses[old]
        del self.times[: max(0, gone)]

    def pair(self, position: tuple, place: tuple) -> bool:
        if not all(map(math.isfinite, position)):
            return False
        self.pairs.append((*position, *place))
        del self.pairs[:-MOST_PAIRS]
        return True

    def align(self, points: list, any_scale: bool) -> bool:
        found = solve.align(np.array(points)[:, :3], np.array(points)[:, 3:]) if len(points) >= 3 else None
        if found is None or not _passes(found[0], found[3], any_scale):
            return False
        self.use(found)
        return True

    def use(self, found: tuple) -> None:
        self.known, self.number = found, self.number + 1

    def refit(self) -> None:
        """Align by the pairs."""
        self.align(self.pairs, False)

    def settle(self) -> None:
        oldest, waiting, added = self.times[0] if self.times else None, [], False
        for ts, place in self.pending:
            pose = self.nearest(ts)
            if pose is not None:
                added |= self.pair(pose, place)
            elif oldest is None or ts >= oldest - PAIR_NS:
                waiting.append((ts, place))
        self.pending = waiting
        if added:
            self.refit()

    def take(self, r: dict) -> dict | None:
        """The place of a pose, if an alignment is known by then; other events give None."""
        here = (r["a"], r["b"], r["c"])
        if r["kind"] == "vps":
            good = [p for p in (r["pairs"] if r["pairs"] is not None else []) if np.isfinite(list(p)).all()]
            self.vps = self.align(good, True) or self.vps
        elif r["ts_ns"] is None or None in here:
            return None
        elif r["kind"] == "fix":
            if not self.vps and (pose := self.nearest(r["ts_ns"])) is None:
                self.pending.append((r["ts_ns"], here))
                del self.pending[:-MOST_PENDING]
            elif not self.vps and self.pair(pose, here):
                self.refit()
        else:
            if r["tracking"]:
                self.keep(r["ts_ns"], here)
                if self.vps:
                    self.pending.clear()
                elif self.pending:
                    self.settle()
            return self.place(r, here)
        return None

    def place(self, r: dict, here: tuple) -> dict | None:
        if self.known is None:
            return None
        scale, rotation, shift, rms = self.known
        e, n, u = (scale * rotation @ np.array(here) + shift).tolist()
        return {"trip_id": r["trip_id"], "pose_id": r["id"], "ts_ns": r["ts_ns"], "east": e, "north": n, "up": u, "transform_id": self.number, "rms": rms}


PLACED = "trip_id long, pose_id long, ts_ns long, east double, north double, up double, transform_id long, rms double"


class _Noted(Aligner):
    """An aligner that notes in `book` which pairs it would align and which poses it would place, to be solved with many
    others. What is known decides nothing but places, so all else goes on; anchor sets, whose result decides which fixes
    count, are aligned at once. Its pairs stand in the book's, from `begin` on."""

    def __init__(self, book: _Book, known: tuple | None = None, number: int = 0) -> None:
        super().__init__()
        self.book, self.begin = book, len(book.pairs)
        book.open(known, number)

    def pair(self, position: tuple, place: tuple) -> bool:
        if not all(map(math.isfinite, position)):
            return False
        self.book.pairs.append((*position, *place))
        return True

    def refit(self) -> None:
        end = len(self.book.pairs)
        self.book.asked.append((max(self.begin, end - MOST_PAIRS), end))

    def use(self, found: tuple) -> None:
        self.book.given[len(self.book.asked)] = found
        self.book.asked.append((0, 0))

    def place(self, r: dict, here: tuple) -> None:
        self.book.poses.append((r["row"], len(self.book.asked) - 1))


class _Book:
    """What aligners asked for in a batch: ranges of `pairs`, some alignments that are `given`, and poses (row of the batch,
    the last thing asked for before it). A trip begins with what it knew before, which is none of its alignments here."""

    def __init__(self) -> None:
        self.pairs: list[tuple] = []
        self.clear()

    def clear(self) -> None:
        self.asked: list[tuple[int, int]] = []
        self.given: dict[int, tuple] = {}
        self.begins: list[int] = []
        self.numbers: list[int] = []
        self.poses: list[tuple[int, int]] = []

    def open(self, known: tuple | None, number: int) -> None:
        if known is not None:
            self.given[len(self.asked)] = known
        self.begins.append(len(self.asked))
        self.numbers.append(number)
        self.asked.append((0, 0))

    def solve(self) -> None:
        """Of each thing asked for: `scale`, `rotation`, `shift` and `rms`, the last alignment `known` by then (or -1), and its
        `number` in the trip."""
        span, m = np.array(self.asked), len(self.asked)
        self.scale, self.rotation, self.shift, self.rms = np.zeros(m), np.zeros((m, 3, 3)), np.zeros((m, 3)), np.zeros(m)
        good = np.zeros(m, bool)
        points, size = np.array(self.pairs, float).reshape(-1, 6), span[:, 1] - span[:, 0]
        for n in np.unique(size[size >= 3]):
            alike = np.flatnonzero(size == n)
            for i in range(0, len(alike), max(1, STACKED // n)):
                at = alike[i : i + max(1, STACKED // n)]
                solved, *found = solve.align_all(points[span[at, 0][:, None] + np.arange(n)])
                self.scale[at], self.rotation[at], self.shift[at], self.rms[at] = found
                good[at] = solved & _passes(found[0], found[3], False)
        for i, found in self.given.items():
            self.scale[i], self.rotation[i], self.shift[i], self.rms[i] = found
            good[i] = True
        begins = np.array(self.begins)
        trip = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, m)))
        last = np.maximum.accumulate(np.where(good, np.arange(m), -1))
        self.known = np.where(last >= begins[trip], last, -1)
        new = good.copy()
        new[begins] = False
        total = np.cumsum(new)
        self.number = np.array(self.numbers)[trip] + total - total[begins][trip]

    def placed(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, asked = np.array(self.poses, np.int64).reshape(-1, 2).T
        met = self.known[asked] >= 0
        rows, asked = rows[met], asked[met]
        by, taken = self.known[asked], batch.take(pa.array(rows))
        here = np.column_stack([taken.column(c).to_numpy(zero_copy_only=False) for c in "abc"]).astype(float)
        e, n, u = (((self.scale[by][:, None, None] * self.rotation[by]) @ here[:, :, None])[:, :, 0] + self.shift[by]).T
        named = [taken.column(c).cast(pa.int64()) for c in ("trip_id", "id", "ts_ns")]
        return pa.RecordBatch.from_arrays([*named, *map(pa.array, (e, n, u, self.number[asked], self.rms[by]))], names=[x.split()[0] for x in PLACED.split(", ")])

    def carried(self, now: _Noted) -> None:
        """Begin the next batch with what the last trip knows."""
        at = self.known[-1]
        known = None if at < 0 else (self.scale[at], self.rotation[at], self.shift[at], self.rms[at])
        number = int(self.number[-1])
        self.clear()
        self.pairs = self.pairs[now.begin :][-MOST_PAIRS:]
        now.begin = 0
        self.open(known, number)


def place_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the poses in `batches` of `online`'s events, which are sorted by trip, arrival, kind and id."""
    names = ["row", "trip_id", "kind", "id", "ts_ns", "a", "b", "c", "tracking", "pairs"]
    book, now, trip = _Book(), None, None
    for batch in batches:
        for row in zip(range(batch.num_rows), *(ordered.listed(batch.column(c)) for c in names[1:]), strict=True):
            if now is None or row[1] != trip:
                trip, now = row[1], _Noted(book)
            now.take(dict(zip(names, row)))
        if now is not None:
            book.solve()
            yield book.placed(batch)
            book.carried(now)


def online(events: DataFrame) -> DataFrame:
    """East, north and up of each pose, by the alignment known when it arrives.

    `events` has trip_id, at_ns (arrival), kind ('pose', 'fix' or 'vps'), id, ts_ns, a, b, c (a pose's position or
    a fix's east, north and up), tracking, and pairs (of a 'vps' row: position and place, six numbers each).
    A fix is paired with the nearest kept tracking pose; one without waits until poses catch up with it. After
    the first accepted 'vps' alignment fixes count no more. Poses and fixes with a null time or place are left out.
    One pass for each trip with a bounded state, in which alignments are only noted; those of a batch, of whatever trips,
    are solved together. `wayfold.streaming.placing` does the same to a stream, one by one.
    """
    return events.repartition("trip_id").sortWithinPartitions("trip_id", "at_ns", "kind", "id").mapInArrow(place_together, PLACED)


def events_of(poses: DataFrame, fixes: DataFrame, fix_delay_ns: int = 0) -> DataFrame:
    """The events of `online` from poses and fixes, the fixes arriving `fix_delay_ns` late."""
    none = F.lit(None).cast("array<array<double>>").alias("pairs")
    p = poses.select("trip_id", F.col("ts_ns").alias("at_ns"), F.lit("pose").alias("kind"), F.col("pose_id").alias("id"), "ts_ns", F.col("vio_x").alias("a"), F.col("vio_y").alias("b"), F.col("vio_z").alias("c"), (F.col("state") == "TRACKING").alias("tracking"), none)
    f = fixes_in_enu(fixes).select("trip_id", (F.col("ts_ns") + fix_delay_ns).alias("at_ns"), F.lit("fix").alias("kind"), F.col("fix_id").alias("id"), "ts_ns", F.col("east").alias("a"), F.col("north").alias("b"), F.col("up").alias("c"), F.lit(False).alias("tracking"), none)
    return p.unionByName(f)


def wrap(angle: np.ndarray) -> np.ndarray:
    return np.arctan2(np.sin(angle), np.cos(angle))


def _solve_chain(diagonal: np.ndarray, right: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Solution of a symmetric block-tridiagonal system of 3 by 3 blocks for each column of `target` (n, 3, columns);
    `right` are the blocks beside the diagonal."""
    n = len(diagonal)
    carry, out = np.empty_like(right), np.empty_like(target)
    for i in range(n):
        block, value = diagonal[i], target[i]
        if i:
            block = block - right[i - 1].T @ carry[i - 1]
            value = value - right[i - 1].T @ out[i - 1]
        done = np.linalg.solve(block, np.column_stack([right[i], value]) if i < n - 1 else value)
        out[i] = done[:, -target.shape[2] :]
        if i < n - 1:
            carry[i] = done[:, :3]
    for i in range(n - 2, -1, -1):
        out[i] -= carry[i] @ out[i + 1]
    return out


def _system(poses: np.ndarray, steps: np.ndarray, anchors: np.ndarray, damping: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The Gauss-Newton system of a chain at `poses`: its diagonal blocks, those beside them, and its right side."""
    weight = anchors[:, 0]
    move = poses[1:, :2] - poses[:-1, :2]
    c, s = np.cos(poses[:-1, 2]), np.sin(poses[:-1, 2])
    ahead, aside = c * move[:, 0] + s * move[:, 1], c * move[:, 1] - s * move[:, 0]
    error = np.stack([ahead - steps[:, 0], aside - steps[:, 1], wrap(poses[1:, 2] - poses[:-1, 2] - steps[:, 2])], axis=1)
    to = np.zeros((len(steps), 3, 3))  # the error's slope by the later pose
    to[:, 0, 0], to[:, 0, 1], to[:, 1, 0], to[:, 1, 1], to[:, 2, 2] = c, s, -s, c, 1
    of = -to  # and by the earlier one
    of[:, 0, 2], of[:, 1, 2] = aside, -ahead
    diagonal = damping[:, None, None] * np.eye(3)
    slope = np.zeros_like(poses)
    diagonal[:-1] += ODOMETRY * np.einsum("nki,nkj->nij", of, of)
    diagonal[1:] += ODOMETRY * np.einsum("nki,nkj->nij", to, to)
    slope[:-1] += ODOMETRY * np.einsum("nki,nk->ni", of, error)
    slope[1:] += ODOMETRY * np.einsum("nki,nk->ni", to, error)
    diagonal[:, 0, 0] += weight
    diagonal[:, 1, 1] += weight
    slope[:, :2] += weight[:, None] * (poses[:, :2] - anchors[:, 1:])
    return diagonal, ODOMETRY * np.einsum("nki,nkj->nij", of, to), -slope


def _moved(poses: np.ndarray, change: np.ndarray) -> np.ndarray:
    out = poses + change
    out[:, 2] = wrap(out[:, 2])
    return out


def _solve_chains(diagonal: np.ndarray, right: np.ndarray, target: np.ndarray, first: np.ndarray) -> np.ndarray:
    """`_solve_chain` of many chains at once, which stand one after another and begin at `first`, for one column of
    `target`, to the same bits. A step takes the nodes at one place of all chains that reach so far; the block of `right`
    at a chain's last node is not read."""
    size = np.diff(np.append(first, len(diagonal)))
    longest = np.argsort(-size, kind="stable")
    start, size = first[longest], size[longest]
    reach = np.searchsorted(-size, -np.arange(size[0] + 1), side="left")  # how many chains have a node at each place
    carry, out = np.zeros((len(diagonal), 3, 3)), np.empty_like(target)
    for i in range(size[0]):
        at, on = start[: reach[i]] + i, reach[i + 1]  # longer chains come first
        block, value = diagonal[at], target[at]
        if i:
            back = right[at - 1].transpose(0, 2, 1)
            block, value = block - back @ carry[at - 1], value - back @ out[at - 1]
        if on:
            done = np.linalg.solve(block[:on], np.concatenate([right[at[:on]], value[:on]], axis=2))
            carry[at[:on]], out[at[:on]] = done[:, :, :3], done[:, :, 3:]
        if on < len(at):  # a chain's last node; another number of columns might give other bits
            out[at[on:]] = np.linalg.solve(block[on:], value[on:])
    for i in range(size[0] - 2, -1, -1):
        at = start[: reach[i + 1]] + i
        out[at] -= carry[at] @ out[at + 1]
    return out


def optimise_chains(chains: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """`optimise` of each of many chains, which are solved together; each ends by itself."""
    found = [poses for poses, _, _ in chains]
    live = list(range(len(chains)))
    for _ in range(ROUNDS):
        parts = [_system(found[k], *chains[k][1:], np.full(len(found[k]), DAMPING)) for k in live]
        begins = np.cumsum([0] + [len(x[0]) for x in parts])
        none = np.zeros((1, 3, 3))
        right = np.concatenate([x for part in parts for x in (part[1], none)])
        change = _solve_chains(np.concatenate([x[0] for x in parts]), right, np.concatenate([x[2] for x in parts])[:, :, None], begins[:-1])[:, :, 0]
        still = []
        for k, a, b in zip(live, begins, begins[1:]):
            found[k] = _moved(found[k], change[a:b])
            if np.abs(change[a:b]).max() >= STEP:
                still.append(k)
        live = still
        if not live:
            break
    return found


def optimise(poses: np.ndarray, steps: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Poses (east, north, heading) that best agree with the steps between neighbours (forward, left, turn) and with
    anchors (weight, east, north; weight 0 for none): damped Gauss-Newton over a chain."""
    return optimise_chains([(poses, steps, anchors)])[0]


class _Piece:
    """A piece of a chain at its present poses: its own nodes in order and, but for the last piece, the first node of
    the next. Everything between its first node and that one is eliminated."""

    def __init__(self, rows: pd.DataFrame) -> None:
        rows = rows.sort_values("place")
        self.own = rows[rows["own"]]
        self.ends = 2 if len(self.own) < len(rows) else 1
        n, own = len(rows), rows["own"].to_numpy()
        steps = np.stack([rows["forward"][: n - 1], np.zeros(n - 1), wrap(rows["turn"][: n - 1].to_numpy())], axis=1)
        anchors = rows[["weight", "at_east", "at_north"]].to_numpy() * own[:, None]  # the next piece counts its first node's
        self.poses = rows[["east", "north", "heading"]].to_numpy()
        self.diagonal, self.right, self.target = _system(self.poses, steps, anchors, DAMPING * own)
        inner = slice(1, n - self.ends + 1)
        m = len(self.diagonal[inner])
        sides = np.zeros((m, 3, 7))
        sides[:, :, 0] = self.target[inner]
        if m:
            sides[0, :, 1:4] = self.right[0].T
            if self.ends == 2:
                sides[-1, :, 4:] = self.right[-1]
        self.inner = _solve_chain(self.diagonal[inner], self.right[inner][: max(0, m - 1)], sides) if m else sides

    def reduced(self) -> np.ndarray:
        """27 numbers: what the piece gives to the system of first nodes: the blocks of its first node, between it and
        the next piece's, and of that one, with their right sides below."""
        first, last, between = self.diagonal[0].copy(), np.zeros((3, 3)), np.zeros((3, 3))
        value, next_value = self.target[0].copy(), np.zeros(3)
        if self.ends == 2:
            last, next_value = self.diagonal[-1].copy(), self.target[-1].copy()
        if len(self.inner):
            near = self.right[0] @ self.inner[0]
            value, first, between = value - near[:, 0], first - near[:, 1:4], -near[:, 4:]
            if self.ends == 2:
                far = self.right[-1].T @ self.inner[-1]
                next_value, last = next_value - far[:, 0], last - far[:, 4:]
        elif self.ends == 2:
            between = self.right[0]
        return np.concatenate([first.ravel(), between.ravel(), last.ravel(), value, next_value])

    def change(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Changes of the piece's own nodes, given those of its first node and of the next piece's."""
        return np.concatenate([first[None], self.inner[:, :, 0] - self.inner[:, :, 1:4] @ first - self.inner[:, :, 4:] @ last])


def _solve_first_nodes(pieces: pd.DataFrame) -> pd.DataFrame:
    """Changes of the first nodes of a trip's pieces, a row for each piece."""
    pieces = pieces.sort_values("piece")
    parts = np.stack(pieces["reduced"].to_list())
    diagonal, target = parts[:, :9].reshape(-1, 3, 3).copy(), parts[:, 27:30].copy()
    diagonal[1:] += parts[:-1, 18:27].reshape(-1, 3, 3)
    target[1:] += parts[:-1, 30:]
    found = _solve_chain(diagonal, parts[:-1, 9:18].reshape(-1, 3, 3), target[:, :, None])[:, :, 0]
    following = np.concatenate([found[1:], np.zeros((1, 3))])
    return pieces[["trip_id", "piece"]].assign(first=list(found), last=list(following))


def _refine_long(nodes: DataFrame, size: int) -> DataFrame:
    """`nodes` with better poses, as `optimise` of whole trips gives them. In each round every piece is reduced to its
    ends by a task of its own, the short chain of ends is solved for each trip, and the pieces are filled in."""
    dealt = "trip_id long, piece long, place long, pose_id long, east double, north double, heading double, forward double, turn double, weight double, at_east double, at_north double"
    names = [x.split()[0] for x in dealt.split(", ")]

    def eliminate(rows: pd.DataFrame) -> pd.DataFrame:
        return rows[["trip_id", "piece"]][:1].assign(reduced=[_Piece(rows).reduced()])

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        piece, at = _Piece(rows), rows.iloc[0]
        change = piece.change(np.array(at["first"]), np.array(at["last"]))
        poses = _moved(piece.poses[: len(change)], change)
        return piece.own[names].assign(east=poses[:, 0], north=poses[:, 1], heading=poses[:, 2], most=np.abs(change).max())

    live, done = write_table(nodes.select(names), "refine-nodes"), []
    for _ in range(ROUNDS):
        border = live.where((F.col("place") % size == 0) & (F.col("piece") > 0)).withColumn("piece", F.col("piece") - 1)
        rows = live.withColumn("own", F.lit(True)).unionByName(border.withColumn("own", F.lit(False)))
        reduced = rows.groupBy("trip_id", "piece").applyInPandas(eliminate, "trip_id long, piece long, reduced array<double>")
        ends = reduced.groupBy("trip_id").applyInPandas(_solve_first_nodes, "trip_id long, piece long, first array<double>, last array<double>")
        ends = write_table(ends, "refine-ends")
        moved = write_table(rows.join(ends, ["trip_id", "piece"]).groupBy("trip_id", "piece").applyInPandas(fill, f"{dealt}, most double"), "refine-nodes")
        settled = moved.groupBy("trip_id").agg(F.max("most").alias("most")).where(F.col("most") < STEP)
        settled = write_table(settled.select("trip_id"), "refine-settled")
        done.append(moved.join(settled, "trip_id", "left_semi").select(names))
        live = moved.join(settled, "trip_id", "left_anti").select(names)
        if live.isEmpty():
            break
    out = live
    for part in done:
        out = out.unionByName(part)
    return out


def refine(poses: DataFrame, fixes: DataFrame, size: int = PIECE) -> DataFrame:
    """trip_id, pose_id, east, north, lat, lon, alt of each pose after pose-graph refinement.

    Fixes anchor the nearest pose within a second, weighted by accuracy (1 m at best); neighbours are held together
    by the step that odometry saw. Trips of fewer than 3 poses or 2 anchors, or without an alignment, give no rows;
    the altitude is the origin's. Trips of up to `size` poses are solved whole, as many at once as an Arrow batch has; longer ones in pieces of as
    many, each reduced to its ends, which gives the same poses.
    """
    placed = fixes_in_enu(fixes)
    near = rel.nearest_in_time(placed, poses, "trip_id", "ts_ns", "pose_id", NEAR_NS).where("matched_id is not null")
    near = near.withColumn("weight", 1 / F.pow(F.greatest(F.col("h_acc_m"), F.lit(1.0)), F.lit(2.0)))
    anchors = near.groupBy("trip_id", F.col("matched_id").alias("pose_id")).agg(F.count("*").alias("n_fixes"), F.sum("weight").alias("weight"), *[(F.sum(F.col("weight") * F.col(c)) / F.sum("weight")).alias(f"at_{c}") for c in ("east", "north")])
    pairs = near.select("trip_id", F.col("matched_id").alias("pose_id"), "east", "north", "up").join(poses.select("trip_id", "pose_id", "vio_x", "vio_y", "vio_z"), ["trip_id", "pose_id"])
    fit = solve.similarity_solve(pairs, "trip_id", ("vio_x", "vio_y", "vio_z"), ("east", "north", "up")).select("trip_id", "scale", "rotation", "translation")

    order = W.partitionBy("trip_id").orderBy("ts_ns", "pose_id")
    whole = W.partitionBy("trip_id")
    turn = [[F.get("rotation", F.lit(3 * i + j)) for j in range(3)] for i in range(2)]
    start = [F.col("scale") * (turn[i][0] * F.col("vio_x") + turn[i][1] * F.col("vio_y") + turn[i][2] * F.col("vio_z")) + F.get("translation", F.lit(i)) for i in range(2)]
    nodes = poses.join(fit, "trip_id").join(anchors, ["trip_id", "pose_id"], "left").withColumns({"east": start[0], "north": start[1], "flat_x": F.col("vio_x"), "flat_y": -F.col("vio_z")})
    nodes = nodes.withColumns({"place": F.row_number().over(order) - 1, "n_poses": F.count("*").over(whole), "n_anchors": F.sum("n_fixes").over(whole)}).where("n_poses >= 3 and n_anchors >= 2")
    ahead = {c: F.lead(c).over(order) - F.col(c) for c in ("east", "north", "flat_x", "flat_y")}
    nodes = nodes.withColumns({"heading": F.atan2(ahead["north"], ahead["east"]), "course": F.atan2(ahead["flat_y"], ahead["flat_x"]), "forward": F.hypot(ahead["flat_x"], ahead["flat_y"])})
    nodes = nodes.withColumns({c: F.coalesce(c, F.lag(c).over(order)) for c in ("heading", "course")})  # the last pose keeps the course
    nodes = nodes.withColumn("turn", F.lead("course").over(order) - F.col("course"))
    nodes = nodes.withColumn("piece", F.floor(F.col("place") / size)).select("trip_id", "piece", F.col("place").cast("long").alias("place"), "pose_id", "n_poses", "east", "north", "heading", F.coalesce("forward", F.lit(0.0)).alias("forward"), F.coalesce("turn", F.lit(0.0)).alias("turn"), F.coalesce("weight", F.lit(0.0)).alias("weight"), *[F.coalesce(f"at_{c}", F.lit(0.0)).alias(f"at_{c}") for c in ("east", "north")])
    nodes = write_table(nodes, "refine-all")

    def whole_trips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A batch's trips are solved together; the last one waits for its other rows in the next batch."""
        waiting: list[pa.RecordBatch] = []

        def solve_all(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            trip, matrix = rows["trip_id"].to_numpy(), lambda *names: np.column_stack([rows[c].to_numpy() for c in names])
            first = np.flatnonzero(np.append(True, trip[1:] != trip[:-1]))
            steps = np.column_stack([rows["forward"].to_numpy(), np.zeros(len(trip)), rows["turn"].to_numpy()])
            poses, anchors, chains = matrix("east", "north", "heading"), matrix("weight", "at_east", "at_north"), []
            for a, b in zip(first, np.append(first[1:], len(trip))):
                step = steps[a : b - 1].copy()
                step[:, 2] = wrap(step[:, 2])
                chains.append((poses[a:b], step, anchors[a:b]))
            found = np.concatenate(optimise_chains(chains))
            yield from rows.select(["trip_id", "pose_id"]).append_column("east", pa.array(found[:, 0])).append_column("north", pa.array(found[:, 1])).to_batches()

        for batch in batches:
            trip = batch.column("trip_id").to_numpy()
            last = int(np.flatnonzero(trip != trip[-1])[-1]) + 1 if len(trip) and trip[0] != trip[-1] else 0
            if waiting and len(trip) and waiting[-1].column("trip_id")[-1].as_py() != trip[0]:
                yield from solve_all(pa.Table.from_batches(waiting))
                waiting = []
            if last:
                yield from solve_all(pa.Table.from_batches([*waiting, batch.slice(0, last)]))
                waiting = []
            if len(trip):
                waiting.append(batch.slice(last))
        if waiting:
            yield from solve_all(pa.Table.from_batches(waiting))

    dealt = nodes.where(F.col("n_poses") <= size).repartition("trip_id").sortWithinPartitions("trip_id", "place")
    dealt = dealt.select("trip_id", "pose_id", "east", "north", "heading", "forward", "turn", "weight", "at_east", "at_north")
    solved = dealt.mapInArrow(whole_trips, T.StructType([nodes.schema["trip_id"], nodes.schema["pose_id"], *T._parse_datatype_string("east double, north double").fields]))
    long_ones = nodes.where(F.col("n_poses") > size)
    if not long_ones.isEmpty():
        solved = solved.unionByName(_refine_long(long_ones, size).select("trip_id", "pose_id", "east", "north"))
    solved = solved.join(origins(fixes), "trip_id")
    lat, lon, _ = geo.from_enu(F.col("east"), F.col("north"), F.lit(0.0), *(F.col(c) for c in ("lat0", "lon0", "alt0")))
    return solved.select("trip_id", "pose_id", "east", "north", lat.alias("lat"), lon.alias("lon"), F.col("alt0").alias("alt"))

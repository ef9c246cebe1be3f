"""Near-duplicates by word similarity: documents whose sets of SHINGLE-word shingles have a Jaccard similarity of
SIMILARITY or more are linked, and groups are the components of the links.

Candidates are, first, what SimHash links: texts of equal fingerprints and those of `simhash.links`. As many pairs at
the threshold differ in more bits than it searches, others share a band of MinHashes. Two sets at the threshold share none of the bands with a probability of
(1 - SIMILARITY ** ROWS) ** BANDS, 3 in a million; closer ones with less. Each candidate pair is then verified on
the shingles themselves. All members of a cell (one value of one band) are held against its smallest; only where
that leaves a cell with several components, members of different ones meet, in blocks of BLOCK members. First they
give a least spanning forest by sketches, and once what it links is one component, all pairs that are left between
components. So a cell of near copies costs as many pairs as it has members, and yet each pair of a cell is either
verified or already in one component. A pair that shares several cells is asked in the smallest.

Before pairs are verified, sketches are asked: a sketch is the parity of a set's hashes in each of 64 * LONGS places,
so two sketches differ in no more places than the sets in members, and what they reject is never similar. Pairs that
sketches reject are never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import SOME_ROWS, add_columns, drop_table, small_batches, write_table
from .simhash import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
LONGS = 16
#: Members of a cell that meet as many others inside one task.
BLOCK = 2048
SEED = 42
MIX = np.uint64(0x9E3779B97F4A7C15)
PIECE = 1 << 12

_draw = np.random.default_rng(SEED)
_XOR = _draw.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)
_ODD = _draw.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of `shingle` words; a shorter text is one run, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    hashed = np.array([digest(w, SEED) for w in words], np.uint64)
    width = min(shingle, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ hashed[k : k + n]) * MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A value for each band; equal where all MinHashes of the band are. Values of different bands differ."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), PIECE):
        least = np.minimum(least, ((hashes[at : at + PIECE] ^ _XOR) * _ODD).min(axis=1))
    value = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        value = (value ^ row) * MIX
        value ^= value >> np.uint64(29)
    return value


def sketch(hashes: np.ndarray) -> np.ndarray:
    odd = np.bincount((hashes % np.uint64(64 * LONGS)).astype(np.int64), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _key(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def _mark(docs: DataFrame, shingle: int) -> DataFrame:
    """`docs` with key (equal for equal sets of shingles), n (their number), bands and sketch."""

    def start() -> Callable[[pa.Array], list[pa.Array]]:
        def work(texts: pa.Array) -> list[pa.Array]:
            sets = [shingles(x.as_py(), shingle) for x in texts]
            keys = np.array([_key(s) for s in sets], np.uint64).view(np.int64)
            values = np.array([bands(s) for s in sets], np.uint64).reshape(-1).view(np.int64)
            sketches = np.array([sketch(s) for s in sets], np.int64).reshape(-1)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * k), pa.array(v)) for v, k in ((values, BANDS), (sketches, LONGS))]
            return [pa.array(keys), pa.array([len(s) for s in sets], pa.int64()), *lists]

        return work

    fields = [T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("bands", "sketch")]]
    return add_columns(docs, "text", fields, start)


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """key and hashes of each text, without the text."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SOME_ROWS):
                sets = [shingles(x.as_py(), shingle) for x in whole.slice(at, SOME_ROWS).column("text")]
                keys = np.array([_key(s) for s in sets], np.uint64).view(np.int64)
                ends = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
                hashes = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.ListArray.from_arrays(ends, pa.array(hashes))], names=["key", "hashes"])

    return texts.select("text").mapInArrow(run, "key long, hashes array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of `pairs` (a, b: keys) whose sets reach the similarity. Shingles are made anew, and only of texts that
    stand in a pair, so they are never all on disk at once."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(classes, "key").select(F.col("first.doc_id").alias("asked_id"), F.col("first.text_hash").alias("asked_hash"))
    texts = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("asked_id")) & (F.xxhash64("text") == F.col("asked_hash")), "left_semi")
    sets = write_table(_sets(texts.dropDuplicates(["doc_id", "text"]), shingle).dropDuplicates(["key"]), "similar-sets")
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("key").alias("b"), F.col("hashes").alias("hb")), "b")
    shared = F.size(F.array_intersect("ha", "hb"))
    return both.select("a", "b", shared.alias("s"), (F.size("ha") + F.size("hb")).alias("n")).where(F.col("s") >= similarity * (F.col("n") - F.col("s")) - 1e-9).select("a", "b")


def _by_fingerprint(marked: DataFrame) -> DataFrame:
    """Pairs (a, b: keys; na, nb) that SimHash links: each key with the smallest of its fingerprint, and such smallest ones
    along `simhash.links`."""
    prints = write_table(marked.select("fp", "key", "n").distinct(), "similar-prints")
    first = write_table(prints.groupBy("fp").agg(F.min(F.struct("key", "n")).alias("one")), "similar-firsts")
    equal = prints.join(first, "fp").select("one", F.struct("key", "n").alias("other"))
    ends = [first.select(F.col("fp").alias(x), F.col("one").alias(y)) for x, y in (("a", "one"), ("b", "other"))]
    linked = simhash.links(first.select("fp")).join(ends[0], "a").join(ends[1], "b").select("one", "other")
    low, high = F.least("one", "other"), F.greatest("one", "other")
    met = equal.unionByName(linked).where("one.key != other.key")
    return met.select(low["key"].alias("a"), high["key"].alias("b"), low["n"].alias("na"), high["n"].alias("nb"))


def _star(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs whose numbers of shingles (na, nb) and sketches allow the similarity."""
    fit = F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9
    pairs = write_table(pairs.where(fit).distinct(), "similar-fit")
    for x in "ab":
        pairs = pairs.join(classes.select(F.col("key").alias(x), F.col("sketch").alias(f"s{x}")), x)
    differ = sum((F.bit_count(F.get("sa", F.lit(i)).bitwiseXOR(F.get("sb", F.lit(i)))) for i in range(LONGS)), F.lit(0))
    may = differ <= (F.col("na") + F.col("nb")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    return write_table(pairs.where(may).select("a", "b"), "similar-star")


def _mixed(placed: DataFrame) -> DataFrame:
    """The rows of `placed` (cell, key, n, label) in cells of several labels, with k, their number."""
    sizes = placed.groupBy("cell").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("k"))
    return placed.join(sizes.where("low != high").select("cell", "k"), "cell")


def _blocks(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of `_mixed` cells, so that any two of a cell stand in one row together, of about BLOCK or twice as many.
    Each member carries all those cells that it is in."""
    known = members.groupBy("key").agg(F.collect_list("cell").alias("cells")).join(classes.select("key", "sketch"), "key")
    members = members.withColumn("parts", F.ceil(F.col("k") / BLOCK).cast("int")).join(known, "key")
    members = members.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    members = members.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    member = F.struct("key", "n", "label", "part", "sketch", "cells")
    return members.groupBy("cell", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).agg(F.collect_list(member).alias("members"))


class _Block:
    """Members of one row of `_blocks`, by number of shingles, and what any of them may be similar to."""

    def __init__(self, cell: int, across: bool, rows: pa.StructArray, similarity: float) -> None:
        key, n, label, part = (rows.field(x).to_numpy() for x in ("key", "n", "label", "part"))
        order = np.lexsort((key, n))
        self.key, self.n, self.label, self.part = key[order], n[order], label[order], part[order]
        self.sketch = rows.field("sketch").flatten().to_numpy().view(np.uint64).reshape(-1, LONGS)[order]
        listed = rows.field("cells")
        cells = np.full((len(key), BANDS), cell)
        at = np.repeat(np.arange(len(key)), listed.value_lengths().to_numpy())
        cells[at, np.arange(len(at)) - np.concatenate([[0], np.cumsum(listed.value_lengths().to_numpy())])[at]] = listed.flatten().to_numpy()
        self.cells, self.cell, self.across, self.similarity = cells[order], cell, across, similarity

    def near(self, x: int, to: slice) -> tuple[np.ndarray, np.ndarray]:
        """Members of the range `to`, with differing places of sketches, whose pair with x is to be asked here: labels
        differ, sketches and numbers allow the similarity, and no smaller cell has both."""
        may = self.label[to] != self.label[x]
        if self.across:
            may &= self.part[to] != self.part[x]
        at = np.flatnonzero(may) + to.start
        differ = np.bitwise_count(self.sketch[at] ^ self.sketch[x]).sum(axis=1, dtype=np.int64)
        fit = differ <= (self.n[at] + self.n[x]) * ((1 - self.similarity) / (1 + self.similarity)) + 1e-6
        at, differ = at[fit], differ[fit]
        smaller = self.cells[x][self.cells[x] < self.cell]
        met = np.isin(self.cells[at], smaller).any(axis=1)
        return at[~met], differ[~met]

    def pairs(self) -> np.ndarray:
        """All pairs of keys to be asked."""
        within = np.searchsorted(self.n, self.n / self.similarity + 1e-6, side="right")
        found = [np.zeros((0, 2), np.int64)]
        for x in range(len(self.key) - 1):
            others = self.key[self.near(x, slice(x + 1, within[x]))[0]]
            found.append(np.stack([others, np.full(len(others), self.key[x])], axis=1))
        return np.concatenate(found)

    def forest(self) -> np.ndarray:
        """Those of `pairs` in a least spanning forest by the sketches' differences; members of a label are one tree."""
        least = np.searchsorted(self.n, self.n * self.similarity - 1e-6, side="left")
        within = np.searchsorted(self.n, self.n / self.similarity + 1e-6, side="right")
        done = np.iinfo(np.int64).max
        cost, parent = np.full(len(self.key), done - 1), np.full(len(self.key), -1)
        found = []
        for _ in range(len(cost)):
            x = int(cost.argmin())
            if parent[x] >= 0:
                found.append((self.key[parent[x]], self.key[x]))
            cost[x] = done
            own = (self.label == self.label[x]) & (cost < done)
            cost[own], parent[own] = -1, -1
            at, differ = self.near(x, slice(least[x], within[x]))
            better = (cost[at] < done) & (differ < cost[at])
            cost[at[better]], parent[at[better]] = differ[better], x
        return np.array(found, np.int64).reshape(-1, 2)


def _met(placed: DataFrame, classes: DataFrame, similarity: float, forest: bool) -> DataFrame:
    """Pairs (a, b) of members of a cell with different labels that numbers of shingles and sketches allow; with
    `forest` only so many that, held to be similar, they connect what all would. Each pair is given in one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                cell, i, j = (batch.column(c)[at].as_py() for c in ("cell", "i", "j"))
                block = _Block(cell, i != j, batch.column("members").slice(at, 1).flatten(), similarity)
                ends = np.sort(block.forest() if forest else block.pairs(), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    mixed = write_table(_mixed(placed), "similar-mixed")
    blocks = _blocks(mixed, classes).select("cell", "i", "j", "members")
    out = write_table(blocks.mapInArrow(run, "a long, b long").distinct(), "similar-met")
    drop_table(mixed)
    return out


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash and component (a key) of each row of `docs` (columns doc_id and text; others are ignored).

    Texts without words, null ones among them, are one group. Repeated rows and ids are rows of their own, a null id
    too; rows of equal texts are in one group. An empty table gives an empty result. Other columns, whatever their
    names, are not looked at and not returned.
    """
    docs = docs.select("doc_id", "text")
    marked = simhash.add_fingerprints(_mark(docs.withColumn("text_hash", F.xxhash64("text")), shingle), "fp")
    marked = write_table(marked.drop("text"), "similar-marked")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    classes = write_table(marked.groupBy("key").agg(first, F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "similar-classes")
    cells = write_table(classes.select("key", "n", F.explode("bands").alias("cell")), "similar-cells")
    shared = write_table(cells.groupBy("cell").agg(F.min(F.struct("key", "n")).alias("centre"), F.count("*").alias("k")).where("k > 1"), "similar-shared")

    star = cells.join(shared, "cell").where("key != centre.key").select(F.col("centre.key").alias("a"), F.col("key").alias("b"), F.col("centre.n").alias("na"), F.col("n").alias("nb"))
    star = star.unionByName(_by_fingerprint(marked))
    links = write_table(_verified(_star(star, classes, similarity), docs, classes, shingle, similarity), "similar-links")

    label = F.coalesce("label", "key").alias("label")
    wide = write_table(cells.join(shared.where("k > 2").select("cell"), "cell"), "similar-wide")
    asked = links.limit(0)
    for forest in (True, False):
        placed = wide.join(components(links).withColumnRenamed("node", "key"), "key", "left").select("cell", "key", "n", label)
        placed = write_table(placed, "similar-placed")
        pairs = _met(placed, classes, similarity, forest).join(asked, ["a", "b"], "left_anti")
        drop_table(placed)
        if pairs.isEmpty():  # a forest is empty only where there are no pairs
            break
        links = write_table(links.unionByName(_verified(pairs, docs, classes, shingle, similarity)), "similar-links")
        asked = pairs
    found = components(links).withColumnRenamed("node", "key")
    return marked.select("doc_id", "text_hash", "key").join(found, "key", "left").select("doc_id", "text_hash", label.alias("component"))

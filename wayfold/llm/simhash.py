"""SimHash near-duplicates: fingerprints, links at MOST_BITS differing bits or fewer, and their components.

Search by segment popcounts: a fingerprint's 32 segments of two bits are mapped to their bit counts 0, 1 or 2,
written in unary (00, 01, 11), so that the Manhattan distance of two count vectors is the Hamming distance of
their unary words. That distance never exceeds the fingerprints' own. The vectors are laid on grids: segments
fall into BLOCKS blocks, and where the Manhattan distance is MOST_BITS or less, at least BLOCKS - MOST_BITS
blocks have distance zero; so each choice of that many blocks is a grid whose cells hold equal counts, and
linked fingerprints share a cell of some grid. In a cell the lower bound is asked first, then the fingerprints.

A cell of more than CELL fingerprints is laid on finer grids in the same way: its MOST_BITS open blocks are halved
and of the halves again all but MOST_BITS must be equal. Once the open blocks are single segments, counts say no
more, and the grids go on over the fingerprints' bits, of which likewise at most MOST_BITS differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, drop_table, fresh, write_table

SHINGLE = 3
SEED = 42
MOST_BITS = 3
BLOCKS = 6
#: Cells of more fingerprints are split by finer grids, so that no task compares more at once; 8 at least.
CELL = 4096
PIECE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash over shingles of `shingle` words, repeats counted; without words zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest, count = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + PIECE], stops[at : at + PIECE])], np.uint64)
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])


def add_fingerprints(docs: DataFrame, column: str, text: str = "text") -> DataFrame:
    """`docs` with the fingerprint as a signed long. Null and empty texts have fingerprint zero."""

    def start() -> Callable[[pa.Array], list[pa.Array]]:
        def work(texts: pa.Array) -> list[pa.Array]:
            return [pa.array(np.array([fingerprint(x.as_py()) for x in texts], np.uint64).view(np.int64))]

        return work

    return add_columns(docs, text, [T.StructField(column, T.LongType())], start)


def popcount_vector(fp: Column) -> Column:
    """Counts of the 32 two-bit segments, in unary: the high bit where both are set, the low where any is."""
    odd = F.lit(0x5555555555555555)
    high = F.shiftrightunsigned(fp, 1)
    both, any_ = fp.bitwiseAND(high).bitwiseAND(odd), fp.bitwiseOR(high).bitwiseAND(odd)
    return F.shiftleft(both, 1).bitwiseOR(any_)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _root(unit: int) -> list[range]:
    """BLOCKS ranges of bits, whose ends are multiples of `unit`."""
    edges = (np.linspace(0, 64 // unit, BLOCKS + 1).round().astype(int) * unit).tolist()
    return [range(a, b) for a, b in zip(edges, edges[1:])]


def _name(level: int, parts: tuple[range, ...]) -> int:
    """A grid as a number: at level 0 the counts, at level 1 the bits, outside the open ranges are equal in a cell."""
    out = level
    for part in parts:
        out = (out << 14) | (part.start << 7) | part.stop
    return out


def _mask(grid: int) -> int:
    """The bits, as a signed long, that are equal within a cell of the grid."""
    return _signed(((1 << 64) - 1) & ~sum(1 << i for part in _open(grid) for i in part))


def _open(grid: int) -> list[range]:
    return [range(grid >> (14 * k + 7) & 127, grid >> (14 * k) & 127) for k in reversed(range(MOST_BITS))]


@lru_cache(maxsize=1 << 16)
def _finer(grid: int) -> list[tuple[int, int, int]]:
    """(number, level, mask) of the grids into which a grid's cells are split; none if its open ranges are bits."""
    level, parts = grid >> (14 * MOST_BITS), _open(grid)
    unit = 1 if level else 2
    if all(len(part) <= unit for part in parts):
        level, pieces = 1, [] if level else _root(1)
    else:
        cuts = [part.start + (len(part) // unit + 1) // 2 * unit for part in parts]
        pieces = [x for part, cut in zip(parts, cuts, strict=True) for x in (range(part.start, cut), range(cut, part.stop)) if len(x)]
    return [(g := _name(level, chosen), level, _mask(g)) for chosen in combinations(pieces, MOST_BITS)]


#: The first grids.
FIRST = [_name(0, parts) for parts in combinations(_root(2), MOST_BITS)]


def grids() -> list[int]:
    """For each first grid the mask, as a signed long, of the unary words' bits that it keeps."""
    return [_mask(g) for g in FIRST]


def _with_sizes(laid: DataFrame) -> DataFrame:
    """`laid` (grid, cell, fp) without cells of one, and with k, the members of a row's cell."""
    sizes = laid.groupBy("grid", "cell").agg(F.count("*").alias("k")).where("k > 1")
    return laid.join(sizes, ["grid", "cell"])


def _cells(fps: DataFrame) -> DataFrame:
    """grid, cell, fp and k over the first grids."""
    vector = popcount_vector(F.col("fp"))
    places = [F.struct(F.lit(g).alias("grid"), vector.bitwiseAND(F.lit(_mask(g))).alias("cell")) for g in FIRST]
    return _with_sizes(fps.select("fp", F.explode(F.array(*places)).alias("at")).select("at.*", "fp"))


def _split_cells(large: DataFrame) -> DataFrame:
    """Members of large cells on finer grids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grid, fp = (batch.column(c).to_numpy() for c in ("grid", "fp"))
            for g in np.unique(grid).tolist():
                mine = fp[grid == g]
                code = [_unary(mine.view(np.uint64)).view(np.int64), mine]
                for to, level, mask in _finer(g):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), to)), pa.array(code[level] & mask), pa.array(mine)], names=["grid", "cell", "fp"])

    return _with_sizes(large.select("grid", "fp").mapInArrow(run, "grid long, cell long, fp long").distinct())


def _links_within(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among a cell's fingerprints."""
    left = np.sort(values)
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = _unary(left) ^ _unary(np.array([x], np.uint64))
            maybe = np.bitwise_count(near) <= MOST_BITS
            linked = maybe & (np.bitwise_count(left ^ x) <= MOST_BITS)
            for y in left[linked]:
                yield int(x), int(y)
            front.extend(left[linked])
            left = left[~linked]


def _unary(fp: np.ndarray) -> np.ndarray:
    odd = np.uint64(0x5555555555555555)
    high = fp >> np.uint64(1)
    return ((fp & high & odd) << np.uint64(1)) | ((fp | high) & odd)


def _cell_links(cells: DataFrame) -> DataFrame:
    lists = cells.groupBy("grid", "cell").agg(F.collect_list("fp").alias("fps")).select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = [link for fps in batch.column(0) for link in _links_within(fps.values.to_numpy(zero_copy_only=False).view(np.uint64))]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([x[i] for x in links], np.uint64).view(np.int64)) for i in (0, 1)], names=["a", "b"])

    return lists.mapInArrow(run, "a long, b long")


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) among distinct fingerprints (column fp) that connect all that MOST_BITS connects. Each round
    splits the cells that are still too large; most tables have none after the first, and after nine rounds no
    grid is finer and a cell has eight members at most."""
    cells, found = write_table(_cells(fps), "simhash-cells"), []
    while True:
        found.append(_cell_links(cells.where(F.col("k") <= CELL)))
        large = cells.where(F.col("k") > CELL)
        if large.isEmpty():
            break
        cells = write_table(_split_cells(large), "simhash-cells")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable. Labels spread along edges and are then followed one step
    further, so the rounds grow with the logarithm of a component's width. Each round's labels are written."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = write_table(both, "simhash-edges")
    labels = write_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "simhash-labels")
    while True:
        told = both.join(labels, both.b == labels.node).select(F.col("a").alias("node"), "label")
        spread = write_table(told.unionByName(labels).groupBy("node").agg(F.min("label").alias("label")), "simhash-labels")
        further = spread.select(F.col("node").alias("at"), F.col("label").alias("next"))
        moved = write_table(spread.join(further, F.col("label") == F.col("at")).select("node", F.least("label", "next").alias("label")), "simhash-labels")
        same = moved.join(labels.withColumnRenamed("label", "old"), "node").where("label != old").isEmpty()
        drop_table(labels)
        drop_table(spread)
        if same:
            drop_table(both)
            return moved
        labels = moved


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, fp (signed long), component_id (smallest id reachable by links) and component (its
    smallest fingerprint) of each row.

    Null and empty texts have fingerprint zero and are linked like any other; null ids count only where a
    component has no other. Repeated rows and ids are rows of their own. An empty table gives no rows; other
    columns are ignored. Equal fingerprints are one class, so a group of copies is one row of the search.
    """
    marked = add_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "fp")
    marked = write_table(marked.select("doc_id", F.xxhash64("text").alias("text_hash"), "fp"), "simhash-marked")
    classes = write_table(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    labels = components(links(classes.select("fp")))
    linked = classes.join(labels, classes.fp == labels.node).select("fp", "first_id", "label")
    least = linked.groupBy("label").agg(F.min("first_id").alias("component_id"))
    moved = linked.join(least, "label").select("fp", "component_id", "label")
    found = classes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("label", "fp").alias("component"))
    found = write_table(found, "simhash-components")
    return marked.join(found, "fp").select("doc_id", "text_hash", "fp", "component_id", "component")


def keep_one_each(docs: DataFrame, grouped: DataFrame | None = None) -> DataFrame:
    """The rows of `docs` (columns doc_id, text and any others, unchanged) but for one document of each
    component: that with the smallest id, a null id last. Of rows that repeat its id and text the least by all
    columns stays. `grouped` has doc_id, text_hash and component of each row; by default those of `near_duplicates`."""
    grouped = near_duplicates(docs) if grouped is None else grouped
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    texts = write_table(grouped.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("n")), "simhash-texts")
    key, text_hash = fresh("kept_id", docs.columns), fresh("kept_hash", docs.columns)
    keepers = texts.groupBy("component").agg(first).select(F.col("first.doc_id").alias(key), F.col("first.text_hash").alias(text_hash))
    kept = docs.join(write_table(keepers, "simhash-keepers"), F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(text_hash)), "left_semi")
    # Rows that repeat are found by the hashes alone, so that the other texts need not be moved again.
    twice = texts.where("n > 1").select(F.col("doc_id").alias(key), F.col("text_hash").alias(text_hash))
    if twice.isEmpty():
        return kept
    repeats = F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(text_hash))
    names = [f.name for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    one = F.min_by(F.struct(*docs.columns), F.struct(*names)).alias("row")
    once = kept.join(twice, repeats, "left_semi").groupBy("doc_id", F.xxhash64("text")).agg(one).select("row.*")
    return kept.join(twice, repeats, "left_anti").unionByName(once)


def to_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

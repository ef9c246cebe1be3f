"""Mixing of sources to target weights: how often each document is taken, so that sources meet their budgets in words.

A source is taken whole as often as its target allows. What then remains of the target is a subset-sum over its
documents, or over copies of them, counted by exact length: most of it is spread over all lengths in proportion, the last part is fitted by a
bounded-knapsack table, so that the sum is met exactly where any choice of documents meets it there. Which documents of
a length are taken is drawn by a seeded hash of their id and text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordered import numbered_in_all
from .common import write_table

#: Fixed by the contract: what stands between words; weights of sources in order; how often a source is taken at most.
SPACE = r"\x20\x09-\x0D"
WEIGHTS = (5, 2, 1)
MOST_TIMES = 3

#: Words of a source's budget that the knapsack fits, beside what proportions leave; rows of a length and source that
#: are ranked together, about.
FITTED = 1 << 15
SHARE_ROWS = 20_000
SEED = 12


def n_words(text: str) -> Column:
    """Words of a text: each becomes one letter, and the space goes."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"[^{SPACE}]+", "x"), f"[{SPACE}]+", "")).cast("long")


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, fitted: int = FITTED) -> np.ndarray:
    """How many documents of each length to take for a sum near `budget`, which is no more than that of all.

    Lengths are above zero and distinct. From the longest on, documents give their share of all but the last `fitted`
    words; as they are whole, the share is kept over all so far, so that in the end no more than the longest length is
    owed. That and the last words are a bounded knapsack over what documents are left: its table has, for each
    sum that can be reached, the item that reached it first. The reachable sum nearest to the budget is taken, the
    smaller of two. The table has two longest lengths and `fitted` places at most. Of a budget of more than half it is
    fitted what to leave, so that most documents of each length are open to the table.
    """
    whole = int((lengths * counts).sum())
    if 2 * budget > whole:
        return counts - fit(lengths, counts, whole - budget, fitted)
    order, taken = np.argsort(-lengths), np.zeros(len(lengths), np.int64)
    spread, before, seen = max(0, budget - fitted), 0, 0
    for i in order:
        seen += int(counts[i])
        share = spread * seen // max(1, whole)
        taken[i], before = share - before, share
    rest = budget - int((taken * lengths).sum())
    left = counts - taken
    able = np.flatnonzero(left > 0)
    if rest <= 0 or not len(able):
        return taken
    room = rest + int(lengths[able].max())
    reached, first = 1, np.full(room + 1, -1, np.int64)
    items: list[tuple[int, int]] = []
    mask = (1 << (room + 1)) - 1
    for i in able[np.argsort(-left[able] * 1.0, kind="stable")]:
        size, n, power = int(lengths[i]), min(int(left[i]), room // int(lengths[i])), 1
        while n > 0:
            copies = min(power, n)
            n, power = n - copies, power * 2
            new = (reached << copies * size) & mask & ~reached
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(room // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(bits)] = len(items)
                items.append((int(i), copies))
                reached |= new
        if reached >> rest & 1:
            break
    sums = np.flatnonzero(first >= 0)
    sums = np.append(sums, 0)
    at = int(min(sums, key=lambda s: (abs(s - rest), s))) if not reached >> rest & 1 else rest
    while at:
        i, copies = items[first[at]]
        taken[i] += copies
        at -= copies * int(lengths[i])
    return taken


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """`sources` (source, source_size) with target: all words, shared by weights that repeat along the sources in order
    of code points, null last; none gets more than `most_times` its size, and what it would is shared among the others.

    Each round of sharing is one aggregate of two numbers; the level of a round only rises, so that sources that are at
    their limit stay there, and the rounds end when no further one gets there. Sums are decimals, and so exact.
    """
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    placed = numbered_in_all(sources, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = write_table(placed.withColumn("weight", weight.cast("long")).withColumn("limit", F.col("source_size") * most_times).drop("place"), "mix-sources")
    total, parts = (int(x or 0) for x in placed.agg(F.sum(exact("source_size")), F.sum("weight")).first())
    above, at_limit = total, -1
    while True:
        full = F.lit(True) if parts == 0 else F.col("weight") * F.lit(above).cast("decimal(20,0)") > exact("limit") * F.lit(parts).cast("decimal(12,0)")
        n, given, rest = placed.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, exact("limit"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if n == at_limit or parts == 0:
            break
        at_limit, above, parts = n, total - int(given), int(rest)
    level = F.col("weight") * F.lit(float(above)) / F.lit(float(parts or 1))
    return placed.select("source", "source_size", F.when(full, F.col("limit").cast("double")).otherwise(level).alias("target"))


_FIT = "source string, size long, n long, whole long, extra long"


def copies(lengths: np.ndarray, counts: np.ndarray, aim: int, most_times: int) -> np.ndarray:
    """How many copies to take of the documents of each length, `most_times` of a document at most. The whole source
    comes as often as it fits, and each document once more or not; where that misses the aim, as with a few long
    documents, any number of copies may come nearer."""
    whole = int((lengths * counts).sum())
    times = min(aim // whole, most_times)
    taken = times * counts
    if times < most_times:
        taken = taken + fit(lengths, counts, aim - times * whole)
    off = lambda x: abs(int((x * lengths).sum()) - aim)
    if off(taken):
        free = fit(lengths, counts * most_times, min(aim, most_times * whole))
        taken = free if off(free) < off(taken) else taken
    return taken


def _fit_source(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("size")  # the same choice whatever order the rows come in
    lengths, counts = rows["size"].to_numpy(), rows["n"].to_numpy()
    taken = copies(lengths, counts, rows["aim"][0].as_py(), rows["most"][0].as_py())
    return pa.table({"source": rows["source"], "size": rows["size"], "n": rows["n"], "whole": pa.array(taken // counts, pa.int64()), "extra": pa.array(taken % counts, pa.int64())})


def mix(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES, seed: int = SEED) -> DataFrame:
    """keys, source, size, source_size, target and times: how often each document is taken.

    Null and empty texts have size 0 and are not taken; rows of a null source are a source, the last; repeated rows are
    documents of their own; an empty table gives an empty one; other columns don't matter, and columns of the result's
    own names may be keys only as `keys` says. `times` is at most `most_times`, and the same for any run: rows that tie
    in the draw are equal in all that is drawn by, ids and text.

    A source's documents are counted by length before they meet; a source of S words has fewer than sqrt(2 S) lengths,
    which one task fits. The draw ranks documents within shares of a length, by ranges of the hash, so that no length
    or source is ranked in one task.
    """
    draw = F.xxhash64(F.lit(seed), *[F.col(k) for k in keys], F.col(text))
    sized = write_table(docs.select(*[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)], F.col(source).alias("source"), n_words(text).alias("size"), draw.alias("draw")), "mix-sizes")
    by_size = write_table(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-lengths")
    aimed = write_table(targets(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most_times), "mix-targets")
    plan = aimed.select(F.col("source").alias("of"), "source_size", "target", F.round("target").cast("long").alias("aim"), F.lit(most_times).cast("long").alias("most"))
    same = F.col("source").eqNullSafe(F.col("of"))
    fitted = by_size.where("size > 0").join(plan, same).select("source", "size", "n", "aim", "most").groupBy("source").applyInArrow(_fit_source, _FIT)
    rows = sized.count()
    shares = max(1, math.ceil(rows / SHARE_ROWS))
    share = F.floor((F.shiftright("draw", 1).cast("double") / F.lit(float(1 << 63)) + 0.5) * shares)
    ranked = sized.withColumn("share", share)
    names = [F.col(c).alias(f"{c}_") for c in ("source", "size")]
    in_share = ranked.groupBy("source", "size", "share").agg(F.count("*").alias("rows"))
    earlier = F.coalesce(F.sum("rows").over(W.partitionBy("source", "size").orderBy("share").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    in_share = in_share.where("size > 0").withColumn("earlier", earlier)
    drawn = in_share.join(fitted.select(*names, "whole", "extra"), F.col("source").eqNullSafe(F.col("source_")) & (F.col("size") == F.col("size_")))
    drawn = drawn.select(*names, F.col("share").alias("share_"), "whole", (F.col("extra") - F.col("earlier")).alias("open"))
    met = ranked.join(drawn, F.col("source").eqNullSafe(F.col("source_")) & (F.col("size") == F.col("size_")) & (F.col("share") == F.col("share_")), "left")
    rank = F.row_number().over(W.partitionBy("source", "size", "share").orderBy("draw", *[f"key{i}" for i in range(len(keys))]))
    times = F.coalesce(F.col("whole") + (F.col("open") >= rank).cast("long"), F.lit(0))
    done = met.withColumn("times", times).join(plan.select("of", "source_size", "target"), same)
    return done.select(*[F.col(f"key{i}").alias(k) for i, k in enumerate(keys)], "source", "size", "source_size", "target", "times")


def repeated(docs: DataFrame, mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The mixture itself: each row of `docs` as often as `mixed` takes its key, which is never null and names one row."""
    times = mixed.where("times > 0").select(F.col(key).alias("mix_key"), F.explode(F.sequence(F.lit(1), "times")).alias("mix_copy"))
    return docs.join(times, F.col(key) == F.col("mix_key")).select(*docs.columns)

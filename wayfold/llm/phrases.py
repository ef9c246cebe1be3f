"""Mining of phrases whose words keep together, from positional inverted lists.

Texts become blocks of a bounded number of words. A block holds, for each of its words, the list of positions at which
it stands (words of a piece lie one apart, pieces further). The list of a phrase of k + 1 words is the list of its first
k, merge-joined with the postings of the words that stand k further on, and its length is the phrase's number in the
block. Only phrases that are frequent in the whole corpus are extended. Blocks are told so by two exchanges: what they
count goes to parts by phrase, sorted and packed, and which of their phrases are frequent goes back to the blocks. So no
list of frequent phrases is held anywhere as a whole, and no occurrence leaves its block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_table, small_batches, write_table

#: Fixed by the contract: where pieces end, what stands between words, the language of rows that name none.
ENDS = r"[.,;:!?\x0A-\x0D]"
NO_LANG = "und"

#: Words of a block, about (a longer text goes on to a block of its own length at its next piece); counts that a part
#: of the exchange sums at a time. Both bound a worker's memory.
BLOCK_WORDS = 1 << 21
PART_COUNTS = 1 << 21

BLOCK = "block long, lang string, n long, words binary, counts binary, positions binary"
WORD_OFFER = "part long, block long, lang string, words binary, at binary, n binary"
WORDS = "block long, lang string, words array<string>, at array<long>, gid array<long>, a array<long>"
STATE = "block long, words binary, word_counts binary, word_positions binary, phrases binary, phrase_counts binary, phrase_positions binary, n long"
OFFER = "part long, block long, prefix binary, word binary, n binary"
MERGED = "block long, prefix array<long>, word array<long>, gid array<long>, a array<long>"

_CODEC = pa.Codec("zstd", compression_level=1)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as zigzag steps, byte by byte of the same weight, compressed."""
    steps = np.diff(values.astype(np.int64), prepend=np.int64(0))
    planes = ((steps << 1) ^ (steps >> 63)).view(np.uint8).reshape(-1, 8).T
    return len(values).to_bytes(8, "little") + _CODEC.compress(np.ascontiguousarray(planes), asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(_CODEC.decompress(data[8:], decompressed_size=8 * n), np.uint8).reshape(8, n)
    z = np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64)
    return np.cumsum((z >> np.uint64(1)).view(np.int64) ^ -(z & np.uint64(1)).view(np.int64))


def pack_words(words: list[bytes]) -> bytes:
    """Words hold no line feed, as pieces end there."""
    data = b"\n".join(words)
    return len(data).to_bytes(8, "little") + _CODEC.compress(data, asbytes=True)


def unpack_words(data: bytes) -> list[bytes]:
    return _CODEC.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), asbytes=True).split(b"\n")


class _Held:
    """Words of a language that are not yet a block."""

    def __init__(self) -> None:
        self.words: list[pa.Array] = []
        self.positions: list[np.ndarray] = []
        self.n = self.next = 0

    def add(self, texts: pa.Array) -> None:
        pieces = pc.split_pattern_regex(pc.ascii_lower(texts), ENDS).flatten()
        split = pc.split_pattern(pc.replace_substring(pieces, "\t", " "), " ")
        flat, piece = split.flatten(), pc.list_parent_indices(split).to_numpy()
        full = pc.not_equal(flat, "")
        flat, piece = flat.filter(full), piece[full.to_numpy(zero_copy_only=False)]
        if not len(flat):
            return
        apart = np.cumsum(np.diff(piece, prepend=piece[0]) != 0)
        at = self.next + np.arange(len(flat), dtype=np.int64) + apart
        self.words.append(flat)
        self.positions.append(at)
        self.n, self.next = self.n + len(flat), int(at[-1]) + 2

    def block(self, number: int, lang: str) -> pa.RecordBatch:
        coded = pa.concat_arrays(self.words).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()  # neighbours are alike, and so packed small
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        codes, positions = rank[coded.indices.to_numpy()], np.concatenate(self.positions)
        words = coded.dictionary.take(pa.array(order)).cast(pa.binary()).to_pylist()
        columns = [[number], [lang], [self.n], [pack_words(words)], [pack(np.bincount(codes, minlength=len(order)))], [pack(positions[np.argsort(codes, kind="stable")])]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "lang", "n", "words", "counts", "positions"])


def _bounds(values: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of runs of one value."""
    ends = np.flatnonzero(np.diff(values)) + 1
    return [(int(a), int(b)) for a, b in zip([0, *ends], [*ends, len(values)], strict=True)] if len(values) else []


def _runs(texts: pa.Array, most: int) -> list[tuple[int, int]]:
    """(start, length) of runs of rows of about `most` words together, or one longer text."""
    run = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // (6 * most)
    return [(a, b - a) for a, b in _bounds(run)]


def _blocks(docs: DataFrame, block_words: int) -> DataFrame:
    """docs: lang, text, neither null. A block has one language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Held] = {}
        made = TaskContext.get().partitionId() << 32
        for whole in batches:
            for at, n in _runs(whole.column("text"), block_words):
                batch = whole.slice(at, n)
                for lang in batch.column("lang").unique().to_pylist():
                    held.setdefault(lang, _Held()).add(batch.column("text").filter(pc.equal(batch.column("lang"), lang)))
                while held and sum(h.n for h in held.values()) >= block_words:
                    lang = max(held, key=lambda x: held[x].n)
                    yield held.pop(lang).block(made, lang)
                    made += 1
        for lang, rest in held.items():
            if rest.n:
                yield rest.block(made, lang)
                made += 1

    return docs.select("lang", "text").mapInArrow(run, BLOCK)


_WORD_OFFER_KIND = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("lang", pa.string()), ("words", pa.binary()), ("at", pa.binary()), ("n", pa.binary())])


def _word_offers(parts: int):
    """What blocks count of words, packed by the part that sums a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                words, n, seed = unpack_words(row["words"]), unpack(row["counts"]), zlib.crc32(row["lang"].encode())
                part = np.fromiter((zlib.crc32(w, seed) for w in words), np.int64, len(words)) % parts
                order = np.argsort(part, kind="stable")
                out = [{"part": int(part[order[a]]), "block": row["block"], "lang": row["lang"], "words": pack_words([words[j] for j in order[a:b]]), "at": pack(order[a:b]), "n": pack(n[order[a:b]])} for a, b in _bounds(part[order])]
                yield from pa.Table.from_pylist(out, _WORD_OFFER_KIND).to_batches()

    return run


_WORDS_KIND = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("at", pa.list_(pa.int64())), ("gid", pa.list_(pa.int64())), ("a", pa.list_(pa.int64()))])


def _merge_words(least: int):
    def merge(offers: pa.Table) -> pa.Table:
        """The frequent words of a part (block null), and for each block those of them that it has."""
        rows, next_gid = [], offers["part"][0].as_py() << 32
        for lang in offers["lang"].unique().to_pylist():
            some = offers.filter(pc.equal(offers["lang"], lang))
            split = list(map(unpack_words, some["words"].to_pylist()))
            coded = pa.array([w for words in split for w in words], pa.binary()).dictionary_encode()
            codes, n = coded.indices.to_numpy(), np.concatenate([unpack(x) for x in some["n"].to_pylist()])
            total = np.zeros(len(coded.dictionary), np.int64)
            np.add.at(total, codes, n)
            often = np.flatnonzero(total >= least)
            gid = np.full(len(total), -1, np.int64)
            gid[often] = next_gid + np.arange(len(often))
            next_gid += len(often)
            if len(often):
                rows.append({"block": None, "lang": lang, "words": coded.dictionary.take(pa.array(often)).cast(pa.string()).to_pylist(), "at": None, "gid": gid[often], "a": total[often]})
            start = 0
            for block, words, at in zip(some["block"].to_pylist(), split, some["at"].to_pylist(), strict=True):
                here = gid[codes[start : start + len(words)]]
                start += len(words)
                if (here >= 0).any():
                    rows.append({"block": block, "lang": lang, "words": None, "at": unpack(at)[here >= 0], "gid": here[here >= 0], "a": None})
        return pa.Table.from_pylist(rows, _WORDS_KIND)

    return merge


class _Lists:
    """Lists of positions by id, and the same in order of position."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(positions, kind="stable")
        self.ids, self.at, self.which = ids, positions[order], np.repeat(np.arange(len(ids)), counts)[order]

    def find(self, at: np.ndarray) -> np.ndarray:
        """Index into `at` of this object of each wanted position; -1 where nothing stands there."""
        place = np.minimum(np.searchsorted(self.at, at), max(0, len(self.at) - 1))
        return np.where(self.at[place] == at, place, -1) if len(self.at) else np.full(len(at), -1)


def _lists(row: dict) -> tuple[_Lists, _Lists]:
    words = _Lists(*(unpack(row[c]) for c in ("words", "word_counts", "word_positions")))
    return words, words if row["phrases"] is None else _Lists(*(unpack(row[c]) for c in ("phrases", "phrase_counts", "phrase_positions")))


def _extended(words: _Lists, phrases: _Lists, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of phrases of k + 1 words as (phrase, word, position): a frequent phrase of k words with a frequent
    word after it, whose last k words are frequent, too. The first two are places in the lists' ids."""
    after = words.find(phrases.at + k)
    ok = (after >= 0) & (phrases.find(phrases.at + 1) >= 0)
    return phrases.which[ok], words.which[after[ok]], phrases.at[ok]


def _state(block: int, words: tuple, phrases: tuple | None) -> dict:
    names = ("words", "word_counts", "word_positions"), ("phrases", "phrase_counts", "phrase_positions")
    row = {"block": block, "n": len((phrases or words)[2])} | dict.fromkeys(names[1])
    for columns, values in zip(names, (words, phrases), strict=True):
        if values is not None:
            row |= dict(zip(columns, map(pack, values), strict=True))
    return row


def _by_id(which: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, counts, positions) of lists from occurrences; lists that are empty go."""
    order = np.argsort(which, kind="stable")
    counts = np.bincount(which, minlength=len(ids))
    return ids[counts > 0], counts[counts > 0], at[order]


_STATE_KIND = pa.schema([("block", pa.int64()), *[(c, pa.binary()) for c in ("words", "word_counts", "word_positions", "phrases", "phrase_counts", "phrase_positions")], ("n", pa.int64())])


def _first(block: pa.Table, frequent: pa.Table) -> pa.Table:
    """The state of a block: its frequent words' lists."""
    if not block.num_rows or not frequent.num_rows:
        return _STATE_KIND.empty_table()
    row = block.to_pylist()[0]
    counts, positions = unpack(row["counts"]), unpack(row["positions"])
    gid = np.full(len(counts), -1, np.int64)
    gid[frequent["at"].combine_chunks().flatten().to_numpy()] = frequent["gid"].combine_chunks().flatten().to_numpy()
    kept = positions[np.repeat(gid >= 0, counts)]
    return pa.Table.from_pylist([_state(row["block"], (gid[gid >= 0], counts[gid >= 0], kept), None)], _STATE_KIND)


def _next(k: int):
    def step(state: pa.Table, frequent: pa.Table) -> pa.Table:
        """The state of a block: its frequent phrases of k + 1 words where they stand next to another, so that both may be
        part of a longer one, and the words that such phrases may go on with."""
        if not state.num_rows or not frequent.num_rows:
            return _STATE_KIND.empty_table()
        row = state.to_pylist()[0]
        words, phrases = _lists(row)
        phrase, word, at = _extended(words, phrases, k)
        prefix, last, gid = (frequent[c].combine_chunks().flatten().to_numpy() for c in ("prefix", "word", "gid"))
        places = [np.argsort(x.ids) for x in (phrases, words)]
        local = [p[np.searchsorted(x.ids, v, sorter=p)] for x, v, p in zip((phrases, words), (prefix, last), places, strict=True)]
        wanted = local[0] * len(words.ids) + local[1]
        order = np.argsort(wanted)
        here = phrase * len(words.ids) + word
        found = np.minimum(np.searchsorted(wanted, here, sorter=order), len(wanted) - 1)
        ok = wanted[order[found]] == here
        at, which = at[ok], order[found[ok]]
        goes_on = np.isin(at + 1, at, assume_unique=True)  # a longer frequent phrase stands on two neighbours
        joined = goes_on | np.isin(at - 1, at, assume_unique=True)
        new = _by_id(which[joined], gid, at[joined])
        after = words.find(at[goes_on] + k + 1)
        after = np.sort(after[after >= 0])
        return pa.Table.from_pylist([_state(row["block"], _by_id(words.which[after], words.ids, words.at[after]), new)], _STATE_KIND)

    return step


_OFFER_KIND = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("prefix", pa.binary()), ("word", pa.binary()), ("n", pa.binary())])


def _offers(k: int, parts: int):
    """What blocks count of phrases of k + 1 words, packed by the part that sums a phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                words, phrases = _lists(row)
                phrase, word, _ = _extended(words, phrases, k)
                pairs, n = np.unique(phrase * max(1, len(words.ids)) + word, return_counts=True)
                if not len(pairs):
                    continue
                prefix, last = phrases.ids[pairs // len(words.ids)], words.ids[pairs % len(words.ids)]
                mixed = prefix.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ last.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
                part = ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((last, prefix, part))
                part, prefix, last, n = part[order], prefix[order], last[order], n[order]
                out = [{"part": int(part[a]), "block": row["block"], "prefix": pack(prefix[a:b]), "word": pack(last[a:b]), "n": pack(n[a:b])} for a, b in _bounds(part)]
                yield from pa.Table.from_pylist(out, _OFFER_KIND).to_batches()

    return run


_MERGED_KIND = pa.schema([("block", pa.int64()), *[(c, pa.list_(pa.int64())) for c in ("prefix", "word", "gid", "a")]])


def _merge(least: int):
    def merge(offers: pa.Table) -> pa.Table:
        """The frequent phrases of a part (block null), and for each block those of them that it has."""
        part = offers["part"][0].as_py()
        prefix, word, n = (list(map(unpack, offers[c].to_pylist())) for c in ("prefix", "word", "n"))
        owner = np.repeat(np.arange(len(n)), [len(x) for x in n])
        prefix, word, n = map(np.concatenate, (prefix, word, n))
        order = np.lexsort((word, prefix))
        p, w = prefix[order], word[order]
        new = np.r_[True, (p[1:] != p[:-1]) | (w[1:] != w[:-1])]
        group = np.cumsum(new) - 1
        total = np.add.reduceat(n[order], np.flatnonzero(new))
        often = total >= least
        gid = (part << 32) + np.cumsum(often) - 1
        heads = np.flatnonzero(new)[often]
        rows = [{"block": None, "prefix": p[heads], "word": w[heads], "gid": gid[often], "a": total[often]}] if often.any() else []
        kept = order[often[group]]  # places of counts of frequent phrases
        ids = gid[group[often[group]]]
        at = np.argsort(owner[kept], kind="stable")
        kept, ids = kept[at], ids[at]
        blocks = offers["block"].to_pylist()
        for a, b in _bounds(owner[kept]):
            rows.append({"block": blocks[owner[kept[a]]], "prefix": prefix[kept[a:b]], "word": word[kept[a:b]], "gid": ids[a:b], "a": None})
        return pa.Table.from_pylist(rows, _MERGED_KIND)

    return merge


def count(docs: DataFrame, least: int, longest: int, lang: str = "lang", text: str = "text", block_words: int = BLOCK_WORDS, part_counts: int = PART_COUNTS) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases of 1 to `longest` words, and words by language.

    The first table has level (words of the phrase), gid (unique in a level), lang, phrase, a (its number), prefix and
    suffix (gids of the phrases without its last and first word), heads (numbers of its first 1, 2, ... words) and
    tails (of its words without the first 0, 1, ...). The second has lang and n.
    """
    docs = docs.select(F.coalesce(lang, F.lit(NO_LANG)).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    small_batches(docs.sparkSession)
    blocks = write_table(_blocks(docs, block_words), "phrase-blocks")
    totals = write_table(blocks.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    parts = (totals.agg(F.sum("n")).first()[0] or 0) // part_counts + 1
    offered = blocks.select("block", "lang", "words", "counts").mapInArrow(_word_offers(parts), WORD_OFFER)
    summed = write_table(offered.groupBy("part").applyInArrow(_merge_words(least), WORDS), "phrase-words")
    empty = F.lit(None).cast("long")
    often = summed.where("block is null").select("lang", F.inline(F.arrays_zip(F.col("words").alias("phrase"), "gid", "a")))
    single = write_table(often.select(F.lit(1).alias("level"), "gid", "lang", "phrase", "a", empty.alias("prefix"), empty.alias("suffix"), F.array("a").alias("heads"), F.array("a").alias("tails")), "phrases-1")
    told = summed.where("block is not null").select(F.col("block").alias("to"), "at", "gid")
    state = write_table(blocks.select("block", "counts", "positions").groupBy("block").cogroup(told.groupBy("to")).applyInArrow(_first, STATE), "phrase-lists-1")
    drop_table(blocks)
    levels = [single]
    for k in range(1, longest):
        held = state.agg(F.sum("n")).first()[0] or 0
        parts = held // part_counts + 1
        merged = write_table(state.mapInArrow(_offers(k, parts), OFFER).groupBy("part").applyInArrow(_merge(least), MERGED), f"phrase-counts-{k + 1}")
        new = merged.where("block is null").select(F.inline(F.arrays_zip("prefix", "word", "gid", "a")))
        if new.isEmpty():
            break
        before, one = levels[-1], single.select(F.col("gid").alias("word"), F.col("phrase").alias("last"))
        head = before.select(F.col("gid").alias("prefix"), "lang", "phrase", "heads", F.col("suffix").alias("inner"))
        rows = new.join(head, "prefix").join(one, "word")
        if k == 1:
            tail = before.select(F.col("gid").alias("word"), F.col("gid").alias("suffix"), "tails")
            rows = rows.join(tail, "word")
        else:
            tail = before.select(F.col("prefix").alias("inner"), "word", F.col("gid").alias("suffix"), "tails")
            rows = rows.join(tail, ["inner", "word"])
        made = rows.select(F.lit(k + 1).alias("level"), "gid", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "a", "prefix", "suffix", F.concat("heads", F.array("a")).alias("heads"), F.concat(F.array("a"), "tails").alias("tails"), "word")
        levels.append(write_table(made, f"phrases-{k + 1}"))
        if k + 1 < longest:
            told = merged.where("block is not null").select(F.col("block").alias("to"), "prefix", "word", "gid")
            last, state = state, write_table(state.groupBy("block").cogroup(told.groupBy("to")).applyInArrow(_next(k), STATE), f"phrase-lists-{k + 1}")
            drop_table(last)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x.drop("word"))
    return out, totals


#: Weakest cut of a phrase: the lowest score, then the fewest words before the cut. Decimals, as products pass 64 bits.
_CUT = """array_min(transform(sequence(1, level - 1), k -> struct(
    (cast(a as decimal(19,0)) * cast(n as decimal(19,0)) * cast(1000 as decimal(4,0))) div (cast(heads[k - 1] as decimal(19,0)) * cast(tails[k] as decimal(19,0))) as score,
    k as k, heads[k - 1] as l, tails[k] as r)))"""


def mine(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, covered: int = 100, lang: str = "lang", text: str = "text", block_words: int = BLOCK_WORDS, part_counts: int = PART_COUNTS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to `longest` words that occur `least`
    times or more, by falling score, then number, then phrase in order of bytes.

    Everything is counted in a language; null is 'und', which a row may also name. Null and empty texts have no words, an
    empty table gives no rows, repeated rows count each time, other columns don't matter. A phrase's score is
    1000 a n / (l r), rounded down, at the cut that gives the least; phrases go that stand in a longer one that occurs
    `covered` hundredths as often or more. As every phrase between the two is at least as frequent as the longer, it is
    enough to ask for those with one word more.
    """
    found, totals = count(docs, least, longest, lang, text, block_words, part_counts)
    found = found.where("level > 1")
    longer = found.select(F.col("level").alias("up"), F.explode(F.array("prefix", "suffix")).alias("part"), F.col("a").alias("more"))
    longer = longer.groupBy("up", "part").agg(F.max("more").alias("more")).where("up > 2")
    inside = (F.col("level") + 1 == F.col("up")) & (F.col("gid") == F.col("part")) & (F.col("more") * 100 >= F.col("a") * covered)
    scored = found.join(longer, inside, "left_anti").join(totals, "lang").withColumn("cut", F.expr(_CUT))
    scored = scored.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))  # the first of each share, then of what is left
    some = scored.withColumn("salt", salt).withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

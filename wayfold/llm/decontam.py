"""Benchmark decontamination by a generalised suffix automaton over the words of normalised test items.

Training words stream through the automaton, which keeps the length of the longest match that ends at each
word. Words inside a match of WINDOW or more, or inside a whole shorter item, are hit. Spans beyond a length,
or documents beyond a share, are removed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, fresh, kept_in_worker, new_path, without, write_table

WINDOW = 10
#: Item words in one automaton, about 150 MB of a worker; more items make more automata, each streamed over the
#: documents in turn.
BLOCK_WORDS = 200_000
#: A-Z to a-z; bytes below 0x80 that are no digit or letter to spaces.
_NORMAL = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


class Automaton:
    """Generalised suffix automaton; states are numbers, words are numbered by `word`."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.word: dict[bytes, int] = {}
        self.go: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, self.word.setdefault(w, len(self.word)))
        #: At states that hold a whole window, or a whole shorter item: the items with it.
        self.windows: dict[int, set[str]] = {}
        self.short: dict[int, dict[int, set[str]]] = {}
        for item, words in items:
            state, length = 0, 0
            for w in words:
                state, length = self.go[state][self.word[w]], length + 1
                if length >= window:
                    state = self.holder(state)
                    self.windows.setdefault(state, set()).add(item)
            if 0 < length < window:
                self.short.setdefault(state, {}).setdefault(length, set()).add(item)
        self.has_short = bool(self.short)

    def _extend(self, last: int, c: int) -> int:
        go, link, length = self.go, self.link, self.length
        if c in go[last]:
            q = go[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, q, c)
        new = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
        return new

    def _split(self, p: int, q: int, c: int) -> int:
        go, link, length = self.go, self.link, self.length
        copy = len(go)
        go.append(dict(go[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and go[p].get(c) == q:
            go[p][c] = copy
            p = link[p]
        return copy

    def holder(self, state: int) -> int:
        """The state of the last `window` words of what `state` stands for."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, set[str]]]:
        """(start, end, items) in words: each longest match's last window, or a shorter item, in order of end."""
        go, link, length, window = self.go, self.link, self.length, self.window
        state, n = 0, 0
        for i, c in enumerate(map(self.word.get, words)):
            if c is None:
                state = n = 0
                continue
            while c not in go[state] and state:
                state = link[state]
                n = length[state]
            if c in go[state]:
                state, n = go[state][c], n + 1
                if n >= window:
                    yield i + 1 - n, i + 1, self.windows[self.holder(state)]
                if self.has_short:
                    up = state
                    while up > 0:
                        for size, items in self.short.get(up, {}).items():
                            if size <= n:
                                yield i + 1 - size, i + 1, items
                        up = link[up]


def contamination(words: list[bytes], automaton: Automaton) -> tuple[list[list[int]], list[str]]:
    """Joined spans [start, end) of hit words, in order, and the items found."""
    spans: list[list[int]] = []
    found: set[str] = set()
    for start, end, items in automaton.matches(words):
        found |= items
        while spans and spans[-1][1] >= start:
            start = min(start, spans.pop()[0])
        spans.append([start, end])
    return spans, sorted(found)


def _parts(benchmark: DataFrame, text: str, words: int) -> int:
    """Number of blocks of about `words` item words."""
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))) / 2 + 1  # words at most
    return int((benchmark.agg(F.sum(size)).first()[0] or 0) // words) + 1


def _blocks(benchmark: DataFrame, item_id: str, text: str, parts: int) -> str:
    """A written table of the items (item, text), a folder for each block; nothing of it passes the driver."""
    path = new_path(benchmark.sparkSession, "benchmark")
    block = F.pmod(F.xxhash64(text), F.lit(parts)).alias("block")
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"), block)
    items.repartition(parts, "block").write.partitionBy("block").parquet(path)
    return path


def _items(folder: str) -> list[tuple[str, list[bytes]]]:
    """Items of one block, in a fixed order; an absent folder has none."""
    fs, place = pyarrow.fs.FileSystem.from_uri(folder)
    found: list[tuple[str, str]] = []
    for info in fs.get_file_info(pyarrow.fs.FileSelector(place, allow_not_found=True)):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as source:
                rows = pyarrow.parquet.ParquetFile(source).read(["item", "text"])
            found += zip(rows["item"].to_pylist(), rows["text"].to_pylist(), strict=True)
    return [(item, w) for item, text in sorted(found) if (w := normal_words(text))]


def _automaton(folder: str, window: int) -> Automaton:
    """A block's automaton, made once in a worker; it takes the place of the one before."""
    return kept_in_worker(("decontam", folder, window), lambda: Automaton(_items(folder), window), alone="decontam")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` with n_words, spans (array of [start, end) in words, joined and ordered) and items (found, sorted).

    Columns of these names are replaced. A window is `window` consecutive words of an item, or a whole shorter
    item. Null and empty texts have no words; items without words match nothing; repeated items count once by
    id; a null item id counts as the empty id. Empty tables give no finds. The items are written in blocks of
    bounded size, which workers read, so that nothing sent to the driver or by it grows with the benchmark. Each block is
    searched for in tasks of its own, over the written documents, and only finds are put together.
    """
    docs = without(docs, ["n_words", "spans", "items"])
    parts = _parts(benchmark, text, block_words)
    path = _blocks(benchmark, item_id, text, parts)
    if parts == 1:
        return add_columns(docs, text, _FINDS, _finder(f"{path}/block=0", window))
    row = fresh("row", docs.columns)
    numbered = write_table(docs.withColumn(row, F.monotonically_increasing_id()), "decontam-docs")
    some, of, all_ = numbered.select(F.col(row).alias("of"), F.col(text).alias("text")), fresh("of", numbered.columns), None
    for part in range(parts):  # side by side: a task has one block's automaton
        found = add_columns(some, "text", _FINDS, _finder(f"{path}/block={part}", window)).drop("text")
        found = found if not part else found.where(F.size("spans") > 0)
        all_ = found if all_ is None else all_.unionByName(found)
    joined = all_.groupBy(F.col("of").alias(of)).agg(F.max("n_words").alias("n_words"), _union(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return numbered.join(joined, F.col(row) == F.col(of)).drop(row, of)


_FINDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
]
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _finder(folder: str, window: int) -> Callable[[], Callable[[pa.Array], list[pa.Array]]]:
    """What `add_columns` runs for one block of items."""

    def start() -> Callable[[pa.Array], list[pa.Array]]:
        automaton = _automaton(folder, window)

        def work(texts: pa.Array) -> list[pa.Array]:
            sizes, spans, found = [], [], []
            for value in texts:
                words = normal_words(value.as_py())
                at, names = contamination(words, automaton)
                sizes.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in at])
                found.append(names)
            return [pa.array(sizes, pa.int64()), pa.array(spans, _SPAN), pa.array(found, pa.list_(pa.string()))]

        return work

    return start


def _union(spans: Column) -> Column:
    """Overlapping or touching spans joined; few for any text, as each has a window's words at least."""
    kind = "array<struct<start:int,end:int>>"

    def add(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (last["end"] >= x["start"]), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), add)


def hit_words(spans: str = "spans") -> Column:
    """Number of hit words."""
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """`text` without the words of `spans` and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    starts, ends, out, at = {a for a, _ in spans}, {b - 1 for _, b in spans}, [], 0
    for i, m in enumerate(_WORD.finditer(raw.translate(_NORMAL))):
        if i in starts:
            out.append(raw[at : m.start()])
        if i in ends:
            at = m.end()
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, longest: int = WINDOW, most_share: float = 0.5, text: str = "text", item_id: str = "item_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The columns of `docs`; texts lose their hit spans of `longest` words or more, and spans that are a whole
    shorter item; a document with more than `most_share` of its words hit goes, and so does one that has no
    words left. Other texts, null ones too, stay as they are."""
    names = docs.columns
    clean, kept = fresh("clean_text", names), fresh("kept_row", names)
    fields = [T.StructField(clean, T.StringType()), T.StructField(kept, T.BooleanType())]

    def judged(value: str | None, n_words: int, spans: list) -> tuple[str | None, bool]:
        hit = sum(b - a for a, b in spans)
        return (cut(value, spans), hit <= most_share * n_words and hit < n_words) if hit else (value, True)

    def columns(rows: list[tuple[str | None, bool]]) -> list[pa.Array]:
        return [pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.bool_())]

    if _parts(benchmark, text, block_words) == 1:  # found and cut in one pass
        folder = f"{_blocks(benchmark, item_id, text, 1)}/block=0"

        def start() -> Callable[[pa.Array], list[pa.Array]]:
            automaton = _automaton(folder, longest)

            def work(texts: pa.Array) -> list[pa.Array]:
                split = ((value, normal_words(value)) for value in texts.to_pylist())
                return columns([judged(value, len(words), contamination(words, automaton)[0]) for value, words in split])

            return work

        done = add_columns(docs, text, fields, start)
    else:
        plain = [F.col(c).alias(f"c{i}") if c != text else F.col(c) for i, c in enumerate(names)]
        found = find_contamination(docs.select(*plain), benchmark, longest, text, item_id, block_words)
        both = fresh("both", names)
        found = found.select(*[F.col(f"c{i}" if c != text else text).alias(c) for i, c in enumerate(names)], F.struct(F.col(text).alias("t"), "n_words", "spans").alias(both))

        def start_cut() -> Callable[[pa.Array], list[pa.Array]]:
            return lambda rows: columns([judged(r["t"], r["n_words"], [(s["start"], s["end"]) for s in r["spans"]]) for r in rows.to_pylist()])

        done = add_columns(found, both, fields, start_cut)
    return done.where(kept).select(*[F.col(clean if c == text else c).alias(c) for c in names])

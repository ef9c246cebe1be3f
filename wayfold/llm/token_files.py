"""Token ids in Arrow files of fixed-size-list batches.

A file holds equal-length sequences of ids and masks, so that sequence i is at a known place and is read
without copying from a memory map. A second file beside it says where each document starts.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept_in_worker, new_path, write_table

SEQUENCE = 2048
#: Sequences in a batch of a file.
BATCH = 256
END_ID = 0
#: Entries after which a memo of a worker is emptied, and words encoded in one call; they bound memory, not results.
MEMO = 600_000
SOME = 10_000
LATIN = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")


def _written_bytes() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others) if b != 10}  # words have no line feed


_WRITTEN = _written_bytes()


def splits_at_spaces(definition: str) -> bool:
    """Whether a definition is one whose texts `Words` may encode word by word: byte-level splitting by its usual
    pattern without a space put first, no normaliser, plain merges, and no added token but special ones."""
    d = json.loads(definition)
    model, before, after = d["model"], d.get("pre_tokenizer") or {}, d.get("post_processor")
    plain = not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    added = all(x["special"] for x in d.get("added_tokens") or [])
    return bool(model["type"] == "BPE" and plain and byte_level and added and not d.get("normalizer") and not d.get("truncation") and (not after or after["type"] == "ByteLevel"))


class Words:
    """Ids of texts by the tokenizers library, each distinct word encoded once while it is remembered.

    This holds for definitions that `splits_at_spaces` knows; all texts of any other are encoded whole. The
    vocabulary splits a text before it merges, and always between a word and white space; a single space
    goes to the word after it, a single line feed stands alone. So a text's ids are its words' ids in a row,
    where no white space stands next to other white space and all of it is spaces and line feeds (all
    else that is printable is no white space); other texts are encoded whole. A
    word of Latin letters is one piece of that splitting and needs no splitting by the library, and so
    does what stands before a last dot or comma. Where a text has the string of an added token, special ones too, it is
    that token, as the library has it, and the text is encoded whole.
    """

    def __init__(self, definition: str, dtype: np.dtype) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        from tokenizers import Tokenizer

        self.library, self.dtype = Tokenizer.from_str(definition), dtype
        self.added = [x["content"] for x in json.loads(definition).get("added_tokens") or []]
        self.by_word = splits_at_spaces(definition)
        if not self.by_word:
            return
        self.with_added = Tokenizer.from_str(definition)
        self.library.encode_special_tokens = True  # not looked for where a text has none
        self.model = Tokenizer(self.library.model)  # merges alone, on bytes written as the vocabulary writes them
        self.young: dict[str, bytes] = {}  # words seen lately; those seen before them are `old`
        self.old: dict[str, bytes] = {}
        self.line_feed, self.dot, self.comma = self._encode(["\n", ".", ","])

    def _packed(self, found: list) -> list[bytes]:
        lists = [e.ids for e in found]
        flat = np.array(list(chain.from_iterable(lists)), self.dtype).tobytes()
        ends = list(accumulate((len(x) * self.dtype.itemsize for x in lists), initial=0))
        return [flat[a:b] for a, b in pairwise(ends)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return self._packed(self.library.encode_batch_fast(texts, add_special_tokens=False))

    def _merge(self, words: list[str]) -> list[bytes]:
        """Ids of Latin words, each behind a space."""
        written = (" " + "\n ".join(words)).encode().decode("latin-1").translate(_WRITTEN).split("\n")
        return self._packed(self.model.encode_batch_fast(written, add_special_tokens=False))

    def _learn(self, words: set[str]) -> None:
        """Words are behind a space, or begin with a line feed and stand as they are."""
        if len(self.young) + len(words) > MEMO:
            self.old, self.young = self.young, {}
        known = self.young
        again = [w for w in words if w in self.old]
        known.update((w, self.old[w]) for w in again)
        words = words.difference(again)
        stems = {w: w[:-1] for w in words if w[-1:] in (".", ",") and LATIN.fullmatch(w, 0, len(w) - 1)}
        need = {stems.get(w, w) for w in words}.difference(known)
        latin = [w for w in need if LATIN.fullmatch(w)]
        other = list(need.difference(latin))
        for at in range(0, len(latin), SOME):
            part = latin[at : at + SOME]
            known.update(zip(part, self._merge(part), strict=True))
        for at in range(0, len(other), SOME):
            part = other[at : at + SOME]
            known.update(zip(part, self._encode([w if w[:1] == "\n" else " " + w for w in part]), strict=True))
        for w, stem in stems.items():
            known[w] = known[stem] + (self.dot if w[-1] == "." else self.comma)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, self.dtype)
        if self.by_word and any(x in text for x in self.added):
            return np.frombuffer(self._packed([self.with_added.encode(text, add_special_tokens=False)])[0], self.dtype)
        if not self.by_word or not text.replace("\n", "").isprintable() or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return np.frombuffer(self._encode([text])[0], self.dtype)
        words = ("\n" + text).replace("\n", " \n").split(" ")[1:]
        got = list(map(self.young.get, words))
        if None in got:
            new = [i for i, ids in enumerate(got) if ids is None]
            self._learn({words[i] for i in new})
            for i in new:
                got[i] = self.young[words[i]]
        return np.frombuffer(b"".join(got)[len(self.line_feed) :], self.dtype)


class SequenceWriter:
    """Packs ids into sequences and writes them batch by batch; the last sequence is padded and masked."""

    def __init__(self, sink: pa.NativeFile, dtype: np.dtype, length: int) -> None:
        self.dtype, self.length, self.room = dtype, length, length * BATCH
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out, self.held, self.n = pa.ipc.new_file(sink, self.schema), [], 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        while self.n >= self.room:
            flat = np.concatenate(self.held)
            self._write(flat[: self.room], self.room)
            self.held, self.n = [flat[self.room :]], len(flat) - self.room

    def _write(self, flat: np.ndarray, n: int) -> None:
        mask = np.arange(len(flat)) < n
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def close(self) -> None:
        if self.n:
            flat = np.concatenate(self.held)
            self._write(np.pad(flat, (0, -len(flat) % self.length)), self.n)
        self.out.close()


class SequenceFile:
    """Random access to a file's sequences and to ids by position; batches of a local file are memory-mapped."""

    def __init__(self, uri: str) -> None:
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        local = isinstance(fs, pyarrow.fs.LocalFileSystem)
        self.file = pa.ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path))
        self.length = self.file.schema.field("ids").type.list_size
        self.at, self.ids = -1, np.zeros(0)

    def batch(self, number: int) -> np.ndarray:
        if number != self.at:
            self.at, self.ids = number, self.file.get_batch(number).column(0).flatten().to_numpy(zero_copy_only=True)
        return self.ids

    def tokens(self, start: int, n: int) -> np.ndarray:
        room, parts = self.length * BATCH, []
        while n > 0:
            number, offset = divmod(start, room)
            parts.append(self.batch(number)[offset : offset + n])
            start, n = start + len(parts[-1]), n - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else self.ids[:0]


def write_token_files(docs: DataFrame, definition_path: str, folder: str, length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Encode `text`, append `end_id`, and write in ascending doc_id order; returns a written table
    part, path, index, n_tokens, n_docs, start (ids of all files before).

    The order is by range partitions of doc_id and a hash of the text, nulls first, so that rows of one id may be
    parted too; ties by text. The files follow one another in order of `part`. Only attempts that succeed are in the table.
    """
    with open(definition_path, encoding="utf-8") as source:
        definition = source.read()
    from tokenizers import Tokenizer

    dtype = np.dtype("<u2" if Tokenizer.from_str(definition).get_vocab_size() <= 1 << 16 else "<u4")
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # the vocabulary's size
    key = ("token files", definition_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        encode, task = kept_in_worker(key, lambda: Words(shared.value, dtype)).encode, TaskContext.get()
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        kind = pa.schema([("doc_id", first.schema.field("doc_id").type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        total, n_docs, end = 0, 0, np.array([end_id], dtype)
        with fs.open_output_stream(f"{base}/{name}.arrow", compression=None) as ids_to, fs.open_output_stream(f"{base}/{name}.docs", compression=None) as docs_to:
            ids_out, docs_out = SequenceWriter(ids_to, dtype, length), pa.ipc.new_file(docs_to, kind)
            batch = first
            while batch is not None:
                sizes = []
                for text in batch.column("text"):
                    ids = np.append(encode(text.as_py()), end)
                    ids_out.add(ids)
                    sizes.append(len(ids))
                ends = total + np.cumsum(sizes, dtype=np.int64)
                docs_out.write_batch(pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ends - np.array(sizes, np.int64), pa.int64()), pa.array(sizes, pa.int64())], schema=kind))
                total, n_docs = total + sum(sizes), n_docs + len(sizes)
                batch = next(batches, None)
            ids_out.close()
            docs_out.close()
        yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "path": [f"{folder}/{name}.arrow"], "index": [f"{folder}/{name}.docs"], "n_tokens": [total], "n_docs": [n_docs]})

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    ordered = keyed.repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "text").drop("text_hash")
    files = write_table(ordered.mapInArrow(run, "part long, path string, index string, n_tokens long, n_docs long"), "token-files")
    before = F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # a row for each file
    return write_table(files.withColumn("start", F.coalesce(before, F.lit(0))), "token-starts")


def read_token_files(files: DataFrame, like: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files. `like` has doc_id's type."""
    kind = like.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = SequenceFile(row["path"])
                fs, path = pyarrow.fs.FileSystem.from_uri(row["index"])
                with fs.open_input_file(path) as source:
                    index = pa.ipc.open_file(source)
                    for i in range(index.num_record_batches):
                        docs = index.get_batch(i)
                        starts, sizes = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                        crc = [zlib.crc32(ids.tokens(a, n).astype("<u4").tobytes()) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(starts + row["start"]), docs.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = files.repartition(max(1, files.count()))
    return spread.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, definition_path: str) -> DataFrame:
    """Write `docs` (doc_id, text) and read back.

    Null and empty texts have the end id alone. Rows of equal or null id follow one another and stay rows of
    their own. An empty table gives no file and no rows. Other columns are ignored.
    """
    folder = new_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, definition_path, folder), docs)

"""Byte-level BPE: longest matches of an Aho-Corasick automaton, corrected by backtracking.

Bytes are mapped to Latin-1 so that pyahocorasick, which works on str, sees one character for each byte.
A sequence of tokens is what the merges would give exactly when each adjacent pair is (a pair is compatible
when no merge across their boundary would have come before the merges inside them), so an encoder may take
the longest token that is compatible with the one before, and go back where none is. Each position fails
once at most, so the time is linear in the length.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns, kept_in_worker, without

#: Entries after which a memo of a worker is emptied; it bounds memory, not results.
MEMO = 200_000
#: Where a text may be cut before matching: between something that is no white space and a space or line feed.
CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Other white space, next to which such a cut could part a run of white space.
ODD_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]")


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a line of base64 bytes and rank for each token."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def halves_of(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """For each token that merges can make, the two tokens of its last merge. Single bytes have none."""
    out = {}
    for token, rank in ranks.items():
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
            if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2 and all(p in ranks for p in parts):
            out[rank] = (ranks[parts[0]], ranks[parts[1]])
    return out


class Encoder:
    """Encodes the matches of `pattern` one by one; made once in a worker and kept."""

    def __init__(self, ranks: dict[bytes, int], halves: dict[int, tuple[int, int]], pattern: str, memo: int = MEMO) -> None:
        self.ranks, self.halves, self.find = ranks, halves, regex.compile(pattern).findall
        self.token = {rank: token for token, rank in ranks.items()}
        self.size = max(ranks.values(), default=0) + 1
        self.compatible: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) == 1 or rank in halves:
                self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.memo = memo
        self.words = _Memo(self._word, memo)
        self.chunks = _Memo(self._chunk, memo)

    def fits(self, left: int, right: int) -> bool:
        """Whether merges leave this boundary alone. Memoised by pair."""
        key = left * self.size + right
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > self.memo:
                self.compatible.clear()
            known = self.compatible[key] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        """Undo the later of the two tokens' last merges, again and again; a merge across must not come earlier."""
        before = self.size + 1  # a merge across counts if its rank is below
        while True:
            across = self.ranks.get(self.token[left] + self.token[right])
            if across is not None and across < before:
                return False
            in_left, in_right = self.halves.get(left), self.halves.get(right)
            if in_left and (left > right or not in_right):
                before, left = left, in_left[1]
            elif in_right:
                before, right = right + 1, in_right[0]
            else:
                return True

    def ids(self, piece: bytes) -> list[int]:
        """Token ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        starting: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(piece.decode("latin-1")):
            starting[end - found[0] + 1].append(found)  # by rising length, as ends rise
        dead, path, at = bytearray(n + 1), [], 0
        while at < n:
            left = path[-1][1] if path else None
            untried = starting[at]
            while untried:
                length, token = untried.pop()
                if not dead[at + length] and (left is None or self.fits(left, token)):
                    path.append((length, token))
                    at += length
                    break
            else:
                if not path:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead[at] = 1
                at -= path.pop()[0]
        return [token for _, token in path]

    def _word(self, word: str) -> bytes:
        return np.array(self.ids(word.encode()), "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        words = self.find(chunk)
        return self._word(chunk) if len(words) == 1 else b"".join(map(self.words.__getitem__, words))

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        if not text:
            return b""
        if ODD_SPACE.search(text):
            return b"".join(map(self.words.__getitem__, self.find(text)))
        return b"".join(map(self.chunks.__getitem__, CHUNK.findall(text)))


class _Memo(dict):
    """Remembers what was asked for lately, and the generation before it."""

    def __init__(self, make: Callable[[str], bytes], most: int) -> None:
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) < 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def _list_array(flat: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in flat)], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(flat), "<i4"), pa.int32()))


def _decode_array(ids: pa.Array, token: Callable[[int], bytes]) -> list[bytes]:
    flat = ids.flatten().to_numpy(zero_copy_only=False).tolist()
    ends = np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
    return [b"".join(map(token, flat[a:b])) for a, b in zip([0, *ends], ends)]


def _encoder(df: DataFrame, ranks_path: str, pattern: str, memo: int = MEMO) -> Callable[[], Encoder]:
    """Makes a worker's encoder. The rank table goes out by broadcast: its size is the vocabulary's, not the data's."""
    ranks = load_ranks(ranks_path)
    shared = df.sparkSession.sparkContext.broadcast((ranks, halves_of(ranks)))
    key = ("bpe", ranks_path, pattern, memo)
    return lambda: kept_in_worker(key, lambda: Encoder(*shared.value, pattern, memo))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """`docs` with the token ids of `text` in column `ids`, replacing a column of that name.

    Each match of `pattern` is encoded by itself, special tokens are ordinary text. Null and empty texts have
    no ids. Rows are independent: repeated rows give repeated results, an empty table an empty one.
    """
    made = _encoder(docs, ranks_path, pattern)

    def start() -> Callable[[pa.Array], list[pa.Array]]:
        encode = made().encode
        return lambda texts: [_list_array([encode(text.as_py()) for text in texts])]

    return add_columns(without(docs, [ids]), "text", [T.StructField(ids, T.ArrayType(T.IntegerType(), False))], start)


def decode_documents(encoded: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`encoded` with the bytes of its token ids in column `decoded`. Null ids give no bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast({rank: token for token, rank in load_ranks(ranks_path).items()})

    def start() -> Callable[[pa.Array], list[pa.Array]]:
        token = shared.value.__getitem__
        return lambda lists: [pa.array(_decode_array(lists, token), pa.binary())]

    return add_columns(without(encoded, [decoded]), ids, [T.StructField(decoded, T.BinaryType())], start)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, keep: list[str], ids: str | None = None, memo: int = MEMO) -> DataFrame:
    """The columns `keep` with n_tokens, SHA-256 of the ids (little-endian 32-bit) and of what they decode to, and
    decodes (whether that is the text, a null text being empty); with the ids too where `ids` names a column.

    Encodes and decodes in one pass, so that ids needn't travel between processes. `memo` bounds what a worker
    remembers, about 1 KB of memory for each entry of it, and changes no result.
    """
    made = _encoder(docs, ranks_path, pattern, memo)
    fields = T._parse_datatype_string("n_tokens bigint, ids_sha256 string, decoded_sha256 string, decodes boolean").fields
    fields += [T.StructField(ids, T.ArrayType(T.IntegerType(), False))] if ids else []

    def start() -> Callable[[pa.Array], list[pa.Array]]:
        encoder = made()
        token, sha = encoder.token.__getitem__, lambda x: hashlib.sha256(x).hexdigest()

        def work(column: pa.Array) -> list[pa.Array]:
            texts = [text or "" for text in column.to_pylist()]
            packed = [encoder.encode(text) for text in texts]
            lists = _list_array(packed)
            decoded = _decode_array(lists, token)
            same = [a == b.encode("utf-8", "surrogatepass") for a, b in zip(decoded, texts, strict=True)]
            out = [pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(map(sha, packed), pa.string()), pa.array(map(sha, decoded), pa.string()), pa.array(same, pa.bool_())]
            return [*out, lists] if ids else out

        return work

    return add_columns(docs.select(*keep, "text"), "text", fields, start).drop("text")

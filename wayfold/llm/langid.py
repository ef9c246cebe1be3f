"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Text is lower-cased, what is no letter becomes one space, and n-grams of 1 to 3 characters are hashed into
BUCKETS. Weights are learned by follow-the-regularised-leader with an elastic-net penalty, then a temperature
is fitted on sampled rows that the weights have not seen. Document frequencies cover all rows that may be
learned from; only the weights are fitted on a bounded sample (SAMPLE_ROWS).
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, fresh, without

BUCKETS = 1 << 16
LONGEST = 3
#: Bound, about, on the labelled rows that the weights are fitted on, shared out evenly among the languages. It bounds the
#: model, too, which has a column for each language among them; only with more languages than this are some not drawn.
SAMPLE_ROWS = 6000
UNDETERMINED = "und"
#: Characters of a text that are hashed at a time; it bounds memory, all of the text is read.
PIECE = 1 << 20
#: So much of a text's unit length its n-grams share, which sets the scale of the learning rate.
SCALE = 20.0


def _letters() -> np.ndarray:
    """Code point -> itself for letters and marks, else space; beyond the basic plane all count as letters."""
    keep = np.full(1 << 16, 32, np.uint32)
    for code in range(1 << 16):
        if unicodedata.category(chr(code))[0] in "LM":
            keep[code] = code
    return keep


_table: list[np.ndarray] = []


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def ngrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, in arrays."""
    if not _table:
        _table.append(_letters())
    lower = f" {text.lower()} "
    tail = np.zeros(0, np.uint64)
    for at in range(0, len(lower), PIECE):
        codes = np.frombuffer(lower[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(codes < (1 << 16), _table[0][np.minimum(codes, 0xFFFF)], codes).astype(np.uint64)
        codes = np.concatenate([tail, codes])  # the end of the piece before, of which only n-grams that reach on count
        space = codes == 32
        codes = codes[~(space & np.roll(space, 1) & (np.arange(len(codes)) > 0))]
        value = np.zeros(len(codes), np.uint64)
        for n in range(1, LONGEST + 1):
            m = len(codes) - n + 1
            if m <= 0:
                break
            value = value[:m] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
            bucket = ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
            new = max(0, len(tail) - n + 1)
            yield bucket[new:] if n > 1 else bucket[new:][codes[new:] != 32]
        tail = codes[-(LONGEST - 1) :]


def may_learn(doc_id: str = "doc_id") -> Column:
    """Rows that a model may be learned from: crc32 of the id's text, mod 3, is not 1."""
    return F.coalesce(~held_out(doc_id), F.lit(False)) & F.col(doc_id).isNotNull()


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    """table[b] @ languages: weight times IDF of each bucket; its size is BUCKETS x languages."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for found in ngrams(text):
            total += self.table[found].sum(axis=0, dtype=np.float64)
            n += len(found)
        return self.bias + SCALE * total / max(1, n)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        p = _softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(rows: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """For each bucket the number of texts with it, and the number of texts, over all rows.

    Each task sends a bucket's count once, and BUCKETS sums reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, mark, n = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, bool), 0
        for batch in batches:
            for value in batch.column(0):
                n += 1
                mark[:] = False
                for found in ngrams(value.as_py()):
                    mark[found] = True
                seen += mark
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], n))], names=["bucket", "n"])

    sums = rows.select(F.col(text)).where(F.col(text).isNotNull()).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = sums.column("bucket").to_numpy(), sums.column("n").to_numpy()
    out = np.zeros(BUCKETS, np.int64)
    out[bucket[bucket >= 0]] = n[bucket >= 0]
    return out, int(n[bucket < 0].sum())


def _sample(rows: DataFrame, text: str, lang: str, doc_id: str, most: int) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray, int, bool]]]:
    """The languages, and for each sampled row its buckets, their shares, its language and whether it calibrates."""
    per_language = sorted(rows.groupBy(F.col(lang).alias("lang")).count().collect(), key=lambda r: r["lang"])  # a row for each label
    if not per_language:
        return [], []
    each = most // len(per_language) or most / len(per_language)
    share = F.create_map(*[F.lit(x) for r in per_language for x in (r["lang"], min(1.0, each / r["count"]))])
    draw = F.pmod(F.xxhash64(F.lit(7), F.col(doc_id), F.col(text)), F.lit(1 << 53)) / float(1 << 53)
    drawn = rows.where(draw < F.try_element_at(share, F.col(lang))).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), (F.pmod(F.xxhash64(F.lit(11), F.col(doc_id)), F.lit(5)) == 0).alias("calibrates"))
    drawn = drawn.distinct()  # a row that repeats is drawn always or never, so its repeats must not count

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, counts = [], []
            for value in batch.column("text"):
                found = list(ngrams(value.as_py()))
                at, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                buckets.append(at.astype(np.int32))
                counts.append((n / max(1, n.sum())).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("calibrates"), pa.array(buckets, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))], names=["doc_id", "lang", "calibrates", "buckets", "shares"])

    schema = T.StructType([drawn.schema["doc_id"], T.StructField("lang", T.StringType()), T.StructField("calibrates", T.BooleanType()), T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("shares", T.ArrayType(T.FloatType()))])
    got = drawn.mapInArrow(sparse, schema).toArrow()
    labels, calibrates = got["lang"].to_pylist(), got["calibrates"].to_pylist()
    languages = sorted(set(labels))
    number = {x: i for i, x in enumerate(languages)}
    rows_out = [(got["buckets"][i].values.to_numpy(), got["shares"][i].values.to_numpy(), number[labels[i]], calibrates[i]) for i in _order(got)]
    return languages, rows_out


def _order(got: pa.Table) -> list[int]:
    """The same order each time, whatever the tasks' order: by id and buckets, then mixed with a fixed seed. Only where
    an id repeats are buckets compared; as Python's lists those of all rows would take some 200 MB of the driver."""
    ids = [str(x) for x in got["doc_id"].to_pylist()]
    times = Counter(ids)
    by_id = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], got["buckets"][i].as_py() if times[ids[i]] > 1 else None)), np.int64)
    return by_id[np.random.default_rng(5).permutation(len(by_id))].tolist()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01, epochs: int = 3, scale: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights (BUCKETS x classes) and bias by follow-the-regularised-leader, per coordinate. Values are multiplied by
    SCALE and their bucket's `scale`, if given, a row at a time."""
    seen = np.zeros(BUCKETS, bool)
    for buckets, _, _ in rows:
        seen[buckets] = True
    used = np.flatnonzero(seen).astype(np.int32)  # other buckets keep a weight of zero
    z, n = np.zeros((len(used) + 1, classes)), np.zeros((len(used) + 1, classes))

    def weights(zs: np.ndarray, ns: np.ndarray, l1: float = l1) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(epochs):
        for buckets, values, label in rows:
            at, x = np.append(np.searchsorted(used, buckets), len(used)), np.append(values if scale is None else SCALE * values * scale[buckets], 1.0)
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            p = _softmax(x @ w)
            p[label] -= 1.0
            g = x[:, None] * p
            new = ns + g * g
            z[at] = zs + g - (np.sqrt(new) - np.sqrt(ns)) / alpha * w
            n[at] = new
    w, out = weights(z, n), np.zeros((BUCKETS, classes), np.float32)
    out[used] = w[:-1]
    return out, w[-1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden section over its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(_softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean()
    a, b, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from the rows of `docs` that may be learned from and have a text and a language."""
    rows = docs.where(may_learn(doc_id) & F.col(text).isNotNull() & F.col(lang).isNotNull())
    languages, sample = _sample(rows, text, lang, doc_id, sample_rows)
    if not sample:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    df, n = document_frequencies(rows, text)
    idf = np.log((1 + n) / (1 + df)) + 0.1
    weights, bias = ftrl([x[:3] for x in sample if not x[3]] or [x[:3] for x in sample], len(languages), scale=idf)
    kept = [x for x in sample if x[3]]
    logits = np.array([bias + (SCALE * s * idf[b]) @ weights[b] for b, s, _, _ in kept])
    temperature = fit_temperature(logits, np.array([x[2] for x in kept], int))
    del sample, kept
    pa.default_memory_pool().release_unused()  # the driver's later work needs the room
    return Model(languages, weights * idf[:, None].astype(np.float32), bias, temperature)


def identify(docs: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """`docs` with the predicted language and its calibrated probability.

    A null text and one without a letter get `und` and 0, and so does every text under a model of an empty
    table. Rows are independent. The model goes out by broadcast: BUCKETS x languages floats.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start() -> Callable[[pa.Array], list[pa.Array]]:
        predict = shared.value.predict

        def work(texts: pa.Array) -> list[pa.Array]:
            got = [predict(x.as_py()) for x in texts]
            return [pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())]

        return work

    docs = without(docs, [pred, score])
    return add_columns(docs, text, [T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())], start)


def keep_identified(docs: DataFrame, model: Model, least_score: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose language is determined with `least_score` or more."""
    pred, score = fresh("lang_pred", docs.columns), fresh("lang_score", docs.columns)
    found = identify(docs, model, pred=pred, score=score)
    return found.where((F.col(pred) != UNDETERMINED) & (F.col(score) >= least_score)).select(docs.columns)

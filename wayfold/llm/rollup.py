"""Token counts kept up to date by signed deltas.

A change feed has inserts, deletes and revised counts. A batch of changes becomes additive totals by source,
language and tokenizer version, committed under the batch's name: a batch that is already committed is not
added again, whatever it holds, and a commit that broke off leaves nothing that is read. Totals are the sum of
all commits since the last compaction and of what that compaction summed, so they never read the documents again.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable

import pyarrow as pa
import tiktoken
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, kept_in_worker, without

KEYS = ["source", "lang", "tokenizer"]
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, vocabularies: dict[str, str], pattern: str, text: str = "text") -> DataFrame:
    """`docs` with a column for each vocabulary (its name, and the path of its ranks): the number of tokens of the
    whole text, matches of `pattern` apart, special tokens being ordinary text.

    Columns of these names are replaced. Null and empty texts have none. The ranks go out by broadcast.
    """

    def ranks(path: str) -> dict[bytes, int]:
        with open(path, "rb") as lines:
            return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}

    shared = docs.sparkSession.sparkContext.broadcast({name: ranks(path) for name, path in vocabularies.items()})
    key = ("rollup", pattern, *vocabularies.items())

    def start() -> Callable[[pa.Array], list[pa.Array]]:
        made = kept_in_worker(key, lambda: [tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=r, special_tokens={}) for name, r in shared.value.items()])

        def work(texts: pa.Array) -> list[pa.Array]:
            plain = [x or "" for x in texts.to_pylist()]
            return [pa.array([len(e.encode_ordinary(x)) for x in plain], pa.int64()) for e in made]

        return work

    return add_columns(without(docs, vocabularies), text, [T.StructField(x, T.LongType()) for x in vocabularies], start)


def inserts(counted: DataFrame) -> DataFrame:
    """Changes that add rows (source, lang, tokenizer, n_tokens)."""
    return counted.select(*KEYS, F.lit(1).cast("long").alias("sign"), F.col("n_tokens").cast("long").alias("n_tokens"))


def deletes(counted: DataFrame) -> DataFrame:
    """Changes that take such rows away."""
    return counted.select(*KEYS, F.lit(-1).cast("long").alias("sign"), F.col("n_tokens").cast("long").alias("n_tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes from old rows to new ones: a delete and an insert each."""
    return deletes(old).unionByName(inserts(new))


def roll_up(changes: DataFrame) -> DataFrame:
    """Signed totals; sums are made before the shuffle, so one key with most rows costs a row for each task."""
    totals = changes.groupBy(*KEYS).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.coalesce("n_tokens", F.lit(0))).cast("long").alias("n_tokens"))
    return totals.where("n_docs != 0 or n_tokens != 0")


class Rollup:
    """Totals in a folder: `batch-<name>` for each committed batch, and `base-<number>` for each compaction, of which
    the last counts. A base holds the totals and the names of the batches that are in it, and batches of those
    names count no more, whether their folders are still there or not."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.fs = self.path(folder).getFileSystem(conf)
        self.files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(folder).toUri(), conf)

    def _at(self, name: str):
        return self.path(f"{self.folder}/{name}")

    def _names(self, prefix: str) -> list[str]:
        if not self.fs.exists(self._at("")):
            return []
        names = (s.getPath().getName() for s in self.fs.listStatus(self._at("")))
        return sorted(x.removeprefix(prefix) for x in names if x.startswith(prefix))

    def _base(self) -> int | None:
        return max(map(int, self._names("base-")), default=None)

    def _in_base(self, base: int | None) -> set[str]:
        if base is None:
            return set()
        return {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{self.folder}/base-{base}/batches").collect()}

    def committed(self) -> list[str]:
        """Names of the committed batches, sorted."""
        return sorted(self._in_base(self._base()).union(self._names("batch-")))

    def _publish(self, aside: str, name: str) -> bool:
        """One rename, which refuses a target that is there; then nothing of `aside` stays."""
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self.files.rename(self._at(aside), self._at(name), none)
            return True
        except Py4JJavaError as e:
            if not e.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
                raise
            self.fs.delete(self._at(aside), True)
            return False

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False, and nothing added, if a batch of this name is there.

        Totals are written aside, under a name that no other writer has, and take the batch's name by one rename,
        which is the commit: of two writers of one batch one succeeds. The folder's file system must rename whole
        folders at once.
        """
        if not batch or "/" in batch:
            raise ValueError("a batch needs a name without a slash")
        if batch in self.committed():
            return False
        aside = f"_writing-{uuid.uuid4().hex}"
        roll_up(changes).write.parquet(f"{self.folder}/{aside}")
        return self._publish(aside, f"batch-{batch}")

    def compact(self) -> bool:
        """Sum all commits into a new base, so that totals read that and later batches only, and delete what is then
        no longer read but for the base before, which others may be reading. False if another compaction was first."""
        base, batches = self._base(), self.committed()
        aside, number = f"_writing-{uuid.uuid4().hex}", 0 if base is None else base + 1
        self._sum(base, batches).write.parquet(f"{self.folder}/{aside}/totals")
        self.spark.createDataFrame([(x,) for x in batches], "batch string").write.parquet(f"{self.folder}/{aside}/batches")
        if not self._publish(aside, f"base-{number}"):
            return False
        gone = [f"base-{x}" for x in map(int, self._names("base-")) if x < number - 1]
        gone += [f"batch-{x}" for x in self._in_base(base).intersection(self._names("batch-"))]
        for name in gone:
            self.fs.delete(self._at(name), True)
        return True

    def _sum(self, base: int | None, batches: list[str]) -> DataFrame:
        old = self._in_base(base)
        paths = [f"{self.folder}/batch-{b}" for b in batches if b not in old] + ([] if base is None else [f"{self.folder}/base-{base}/totals"])
        parts = self.spark.read.schema(TOTALS).parquet(*paths) if paths else self.spark.createDataFrame([], TOTALS)
        summed = parts.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.where("n_docs != 0 or n_tokens != 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all commits; keys whose counts are zero are left out.

        Null keys are keys of their own. Without a commit there are no rows.
        """
        return self._sum(self._base(), self.committed())

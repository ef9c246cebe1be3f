"""Centroid clustering of vectors in whole numbers, with distances screened by the norms of blocks of components.

A vector is kept as whole numbers with the norm of each of its blocks. By Cauchy and Schwarz the product of two vectors
is at most the sum of their blocks' products of norms, so the squared distance is at least that of the two short vectors
of norms. A centroid whose bound is above the distance to another one is out; exact distances are computed for the rest
only. Centroids are few: they go to the driver and back in each round, and vectors stay where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SOME_ROWS, fresh, small_batches, write_table

#: Fixed by the contract: components, steps to one, clusters, rounds, what a vector's id is hashed behind.
SIZE, SCALE, CLUSTERS, ROUNDS, SALT = 64, 256, 40, 5, "2:"
#: Components of a block.
BLOCK = 8
#: Components are held within this, so that a distance is a long.
LARGEST = (1 << 27) - 1
#: Share of both squared norms by which a bound's rounding may be off, with much to spare.
SLACK = 1e-9


def quantised(vectors: DataFrame, vector: str, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """Rows whose vector has `size` components, none null, NaN or infinite; `whole` has these as whole numbers, array of
    int: floor(scale * x), of x as a double."""
    name = fresh("whole", vectors.columns)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    held = lambda x: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), F.floor(x.cast("double") * scale).cast("double"))).cast("int")
    kept = vectors.where(F.col(vector).isNotNull() & (F.size(vector) == size)).where(F.forall(vector, finite))
    return kept.withColumn(name, F.transform(vector, held))


def norms(x: np.ndarray, block: int) -> np.ndarray:
    """Norm of each block of components of each row; the last block may be shorter."""
    starts = np.arange(0, x.shape[1], block)
    return np.sqrt(np.add.reduceat(x.astype(np.float64) ** 2, starts, axis=1))


def nearest(x: np.ndarray, x_norms: np.ndarray, centroids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid of each row, the smaller of two, its squared distance, and how many exact
    distances that took."""
    c_norms = norms(centroids, block)
    squares = (x_norms**2).sum(1)[:, None] + (c_norms**2).sum(1)[None, :]
    bound = squares - 2 * x_norms @ c_norms.T - SLACK * squares
    first = bound.argmin(1)
    step = x - centroids[first]
    best, distance = first.copy(), (step * step).sum(1)
    asked = len(x)
    for j in np.argsort(bound.mean(0), kind="stable"):
        rows = np.flatnonzero((bound[:, j] <= distance) & (first != j))
        if len(rows):
            step = x[rows] - centroids[j]
            d = (step * step).sum(1)
            closer = (d < distance[rows]) | ((d == distance[rows]) & (j < best[rows]))
            best[rows[closer]], distance[rows[closer]] = j, d[closer]
            asked += len(rows)
    return best, distance, asked


def _batches(batches: Iterator[pa.RecordBatch], size: int, block: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    blocks = -(-size // block)
    for whole in batches:
        for at in range(0, whole.num_rows, SOME_ROWS):
            batch = whole.slice(at, SOME_ROWS)
            x = batch.column("whole").flatten().to_numpy().astype(np.int64).reshape(-1, size)
            yield batch, x, batch.column("norms").flatten().to_numpy().reshape(-1, blocks)


def _sums(centroids: np.ndarray, block: int) -> Callable:
    """Each task's sums: (cluster, place of the component, sum, number of vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, size = centroids.shape
        sums, counts = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for _, x, x_norms in _batches(batches, size, block):
            cluster, _, _ = nearest(x, x_norms, centroids, block)
            np.add.at(sums, cluster, x)
            counts += np.bincount(cluster, minlength=k)
        there = np.flatnonzero(counts)
        if len(there):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(there, size)), pa.array(np.tile(np.arange(size), len(there))), pa.array(sums[there].reshape(-1)), pa.array(np.repeat(counts[there], size))], names=["cluster", "place", "s", "n"])

    return run


def _assigned(centroids: np.ndarray, block: int, digests: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x, x_norms in _batches(batches, centroids.shape[1], block):
            cluster, distance, asked = nearest(x, x_norms, centroids, block)
            digest = pa.array(digests, pa.string()).take(pa.array(cluster))
            share = np.full(len(x), asked / max(1, len(x)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster.astype(np.int32)), pa.array(distance), digest, pa.array(share)], names=["id", "cluster", "distance", "centroid_sha256", "distances"])

    return run


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, vec_id: str = "vec_id", vector: str = "embedding", size: int = SIZE, scale: int = SCALE, salt: str = SALT, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, centroid_sha256, distances) of each kept vector, and the final centroids.

    Vectors of another size or with a null or non-finite component are left out; components beyond 2^27 are held at that,
    so that distances are longs. First centroids are the vectors with the smallest hash of their id, ties by their
    components, so repeated rows may be two equal centroids, of which the smaller number gets all; a null id is hashed
    as an empty one. With fewer vectors than `clusters` there are fewer centroids, and with none the result is empty.
    Columns of other names don't matter. `distances` says how many exact distances the row's batch took for a row.
    """
    small_batches(vectors.sparkSession)
    kept = quantised(vectors.select(F.col(vec_id).alias("id"), F.col(vector).alias("given")), "given", size, scale).drop("given")

    def add_norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("whole").flatten().to_numpy().reshape(-1, size)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(norms(x, block)), pa.list_(pa.float64()))], names=[*batch.schema.names, "norms"])

    written = write_table(kept.mapInArrow(add_norms, T.StructType([*kept.schema.fields, *T._parse_datatype_string("norms array<double>").fields])), "vectors")
    drawn = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = written.select("whole", drawn.alias("drawn")).orderBy("drawn", "whole").limit(clusters).collect()  # `clusters` rows
    centroids = np.array([r["whole"] for r in first], np.int64).reshape(-1, size)
    out = "id {0}, cluster int, distance long, centroid_sha256 string, distances double".format(written.schema["id"].dataType.simpleString())
    if not len(centroids):
        return written.sparkSession.createDataFrame([], out).withColumnRenamed("id", vec_id), centroids
    for _ in range(rounds):
        parts = written.select("whole", "norms").mapInArrow(_sums(centroids, block), "cluster long, place long, s long, n long")
        sums = parts.groupBy("cluster", "place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
        centroids = centroids.copy()
        for r in sums.collect():  # a row for each centroid and component
            centroids[r["cluster"], r["place"]] = int(r["s"]) // r["n"]
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return written.mapInArrow(_assigned(centroids, block, digests), out).withColumnRenamed("id", vec_id), centroids


def with_inertia(assigned: DataFrame) -> DataFrame:
    """`assigned` with cluster_inertia and inertia, the sums of distances over a row's cluster and over all; null where
    a sum is beyond a long. Sums are a row for each cluster."""
    by = assigned.groupBy(F.col("cluster").alias("of")).agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("c"))
    sums = by.withColumn("a", F.sum("c").over(W.partitionBy())).selectExpr("of", "try_cast(c as long) as cluster_inertia", "try_cast(a as long) as inertia")
    return assigned.join(F.broadcast(sums), F.col("cluster") == F.col("of")).drop("of")

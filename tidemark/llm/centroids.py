"""Exact k-means on integer vectors by annulus search.

A centroid that is nearer to x than d has a norm within d of x's norm. So the centroids are sorted by norm, an
upper bound d is had from one of them (the vector's last cluster, at first the centroid nearest in norm), the
window of norms [|x| - d, |x| + d] is found by binary search, and only the centroids in it, both ends included,
are compared in exact integers; ties go to the smaller number. Norms are floating point, so windows are wider by
more than their error.

Vectors stay in tables; a round writes each vector with its cluster (the next bound) and adds up components by
cluster on Spark. The driver holds the centroids alone: at most `MOST` numbers, else an error.

Vectors of another length, or with a null, NaN or infinite component, aren't kept. Components beyond `limit(dims)`
(2^27 for 64) count as that limit, so that squared distances fit 64 bits. Null and repeated ids are vectors like
others (a null id is hashed as an empty text, equal ids start in order of their components); with fewer vectors
than centroids every vector starts one; an empty table gives an empty one. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, materialize
from .text import trimmed

#: Numbers in all centroids together.
MOST = 1 << 24
#: Components of candidates that one step compares.
STEP = 1 << 21
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def limit(dims: int) -> int:
    """Largest power of two such that squared distances of vectors within it fit a long."""
    return 1 << ((math.isqrt((2**63 - 1) // dims) // 2).bit_length() - 1)


def kept(vectors: DataFrame, dims: int, scale: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v): whole vectors of finite components x as integers floor(scale * x)."""
    most, raw = float(limit(dims)), F.col(f"`{vec_col}`")
    finite = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = vectors.filter((F.size(raw) == dims) & F.coalesce(finite, F.lit(False)))
    numbers = F.transform(raw, lambda x: F.floor(F.least(F.lit(most), F.greatest(F.lit(-most), x.cast("double") * scale))).cast("int"))
    return whole.select(F.col(f"`{id_col}`").alias("vec_id"), numbers.alias("v"))


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


class Annulus:
    """Nearest of some integer centroids."""

    def __init__(self, centroids: np.ndarray) -> None:
        norms = np.sqrt(_squares(centroids).astype(np.float64))
        self.number = np.argsort(norms, kind="stable")
        self.norms, self.centroids = norms[self.number], centroids[self.number]
        self.place = np.argsort(self.number)

    def windows(self, points: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 place by norm of the centroids that can be nearest; `last`: clusters to bound by, or -1."""
        norms = np.sqrt(_squares(points).astype(np.float64))
        right = np.minimum(np.searchsorted(self.norms, norms), len(self.norms) - 1)
        left = np.maximum(right - 1, 0)
        by_norm = np.where(norms - self.norms[left] < self.norms[right] - norms, left, right)
        seed = np.where(last >= 0, self.place[np.maximum(last, 0)], by_norm)
        bound = np.sqrt(_squares(points - self.centroids[seed]).astype(np.float64))
        slack = 1e-12 * (norms + bound) + 1e-9
        return np.searchsorted(self.norms, norms - bound - slack, "left"), np.searchsorted(self.norms, norms + bound + slack, "right")

    def nearest(self, points: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of each point."""
        low, high = self.windows(points, last)
        ends = np.cumsum(high - low)
        cluster, distance = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        most, i = max(1, STEP // points.shape[1]), 0
        while i < len(points):
            before = int(ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(ends, before + most, "right")))
            counts = (high - low)[i:j]
            first = np.cumsum(counts) - counts
            place = np.arange(int(counts.sum())) + np.repeat(low[i:j] - first, counts)
            measured = _squares(points[i:j][np.repeat(np.arange(j - i), counts)] - self.centroids[place])
            distance[i:j] = np.minimum.reduceat(measured, first)
            tied = np.where(measured == np.repeat(distance[i:j], counts), self.number[place], len(self.number))
            cluster[i:j] = np.minimum.reduceat(tied, first)
            i = j
        return cluster, distance


def assigned(points: DataFrame, centroids: list[list[int]], dims: int, last: bool = False) -> DataFrame:
    """points (vec_id, v, cluster) with the cluster of the nearest centroid, and the squared distance if `last`."""
    shared = points.sparkSession.sparkContext.broadcast(np.array(centroids, np.int64))
    fields = "vec_id long, cluster int, distance long" if last else "vec_id long, v array<int>, cluster int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(shared.value)
        for batch in batches:
            if not len(batch):
                continue
            v = batch.column("v").flatten().to_numpy().reshape(-1, dims).astype(np.int64)
            cluster, distance = search.nearest(v, batch.column("cluster").to_numpy())
            now = pa.array(cluster, pa.int32())
            if last:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), now, pa.array(distance)], ["vec_id", "cluster", "distance"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), now], ["vec_id", "v", "cluster"])

    return points.mapInArrow(trimmed(run), fields)


def starts(points: DataFrame, k: int) -> list[list[int]]:
    """The k vectors with the smallest hashes of `1:<id>`, in their order."""
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["v"]) for r in points.select("v", key.alias("key")).orderBy("key", "v").limit(k).collect()]


def moved(points: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """Centroids replaced by the floors of their vectors' means; empty ones stay."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dims + 1), np.int64)  # the last component counts
        for batch in batches:
            v = batch.column("v").flatten().to_numpy().reshape(-1, dims)
            cluster = batch.column("cluster").to_numpy()
            for c in np.unique(cluster).tolist():
                mine = v[cluster == c]
                sums[c, :dims] += mine.sum(axis=0, dtype=np.int64)
                sums[c, dims] += len(mine)
        used = np.flatnonzero(sums[:, dims])
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(np.repeat(used, dims + 1)), "part": pa.array(np.tile(np.arange(dims + 1), len(used))), "s": pa.array(sums[used].ravel())})

    partial = points.select("v", "cluster").mapInArrow(run, "cluster long, part long, s long")
    total = {(r["cluster"], r["part"]): r["s"] for r in partial.groupBy("cluster", "part").agg(F.sum("s").alias("s")).collect()}
    return [[total[c, i] // total[c, dims] for i in range(dims)] if (c, dims) in total else centroids[c] for c in range(k)]


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row a kept vector: its cluster after `rounds` moves, its squared distance, sums of distances, hash of the centroid."""
    if k * dims > MOST:
        raise ValueError(f"{k} centroids of {dims} components are more than {MOST} numbers")
    spark = vectors.sparkSession
    own = kept(vectors, dims, scale, id_col, vec_col)
    points = materialize(own.select(F.col("vec_id").cast("long").alias("vec_id"), "v", F.lit(-1).alias("cluster")), "points")
    centroids = starts(points, k)
    if not centroids:
        return spark.createDataFrame([], RESULT)
    for _ in range(rounds):
        before, points = points, materialize(assigned(points, centroids, dims), "points")
        drop(before)
        centroids = moved(points, centroids, dims)
    found = materialize(assigned(points, centroids, dims, last=True), "clusters")
    drop(points)
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda x: x if x < 2**63 else None  # noqa: E731  a sum beyond a long is null
    rows = [(c, fits(s), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sorted(sums.items())]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

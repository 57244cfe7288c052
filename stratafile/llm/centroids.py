"""Clustering by centroids with annulus search.

Vectors become integers, floor(scale x), so that distances, sums and means are exact. A round sorts the centroids by norm and sends them to every task (k times as many integers as a
vector has: the parameters bound it). A vector's distance to the centroid that it had in the round before (at first: the nearer one of the two on either side of its own norm) is an upper bound u on that to its nearest;
as no centroid can be nearer than the norms differ, only those with norms in [|x| - u, |x| + u] can be it or tie with it. These, found by binary search, are compared exactly, in integers; the smaller number wins ties.
The annulus is widened by far more than the rounding of a root, so that none on its boundary is missed. A task adds up its vectors by centroid, k rows for each component at most; those sums
are what is shuffled, and k means reach the driver. Vectors are never moved: a round reads them with their centroids from a table and writes the next one, and the one before is deleted.

Defined cases: vectors that are null, of another length, or hold a null, NaN or infinity are left out; repeated rows are vectors each; the first centroids are the `clusters` vectors whose SHA-256
of salt:vec_id is smallest (ties by the vector), so rows without a vec_id are clustered but never begin one; fewer vectors than clusters give fewer centroids, none with an id give null clusters;
an empty centroid stays where it is; equal centroids: the smaller number gets all; a component beyond 2^27 in integers is an error, as squared distances would not fit a long; an empty table gives an empty result; other columns are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, made, written

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SALT = 16, 3, 64, 64, "1"
LARGEST = 1 << 27
#: Pairs of vectors and centroids that a task compares at once.
PAIRS = 20_000


def integral(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that are kept, v as integers."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.when((F.size(F.col(vector)) == dimensions) & ok, v).alias("v")).where("v is not null")
    whole = lambda x: F.when(F.abs(x) * scale < LARGEST, F.floor(x * scale).cast("int")).otherwise(F.raise_error(F.lit(f"a component beyond 2^27 / {scale}")).cast("int"))
    return kept.select("vec_id", F.transform("v", whole).alias("v"))


class Annuli:
    """Centroids sorted by norm."""

    def __init__(self, centroids: np.ndarray):
        squares = (centroids * centroids).sum(1)
        self.number = np.lexsort((np.arange(len(centroids)), squares))
        self.at, self.norm, self.place = centroids[self.number], np.sqrt(squares[self.number].astype(np.float64)), np.argsort(self.number)

    def candidates(self, x: np.ndarray, held: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each vector the first and past the last centroid, by norm, of its annulus; held: the number of a centroid for each that is likely to be near."""
        norm = np.sqrt((x * x).sum(1).astype(np.float64))
        if held is None:
            after = np.searchsorted(self.norm, norm)
            probes = [np.clip(i, 0, len(self.at) - 1) for i in (after - 1, after)]
        else:
            probes = [self.place[held]]
        bound = np.min([((x - self.at[i]) ** 2).sum(1) for i in probes], axis=0)
        u = np.sqrt(bound.astype(np.float64))
        wider = 1e-9 * (norm + u + 1)
        return np.searchsorted(self.norm, norm - u - wider, "left"), np.searchsorted(self.norm, norm + u + wider, "right")

    def nearest(self, x: np.ndarray, held: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each vector's centroid."""
        numbers, distances = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        step = max(1, PAIRS // len(self.at))
        for i in range(0, len(x), step):
            own = x[i : i + step]
            lo, hi = self.candidates(own, None if held is None else held[i : i + step])
            size = hi - lo
            start = np.cumsum(size) - size
            row = np.repeat(np.arange(len(own)), size)
            col = np.arange(size.sum()) - np.repeat(start - lo, size)
            far = ((own[row] - self.at[col]) ** 2).sum(1)
            least = np.minimum.reduceat(far, start)
            tied = np.where(far == least[row], self.number[col], len(self.at))
            numbers[i : i + step], distances[i : i + step] = np.minimum.reduceat(tied, start), least
        return numbers, distances


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dimensions).astype(np.int64)


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, v, cluster, distance) of each vector, by the centroid it had where vectors have a cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annuli(centroids)
        for batch in batches:
            held = batch.column(2).to_numpy() if batch.num_columns > 2 else None
            own, far = search.nearest(_matrix(batch.column(1), centroids.shape[1]), held)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "v", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, v array<int>, cluster int, distance long")


def sums(rows: DataFrame, k: int, d: int) -> dict[int, tuple[int, list[int]]]:
    """Of each centroid that has vectors their number and the sum of each component; rows: (cluster, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for batch in batches:
            if batch.num_rows:
                own, x = batch.column(0).to_numpy(), _matrix(batch.column(1), d)
                order = np.argsort(own, kind="stable")
                some, first = np.unique(own[order], return_index=True)
                total[some] += np.add.reduceat(x[order], first, axis=0)
                n += np.bincount(own, minlength=k)
        some = np.flatnonzero(n)
        columns = (np.repeat(some, d), np.tile(np.arange(d), len(some)), np.repeat(n[some], d), total[some].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cluster", "pos", "n", "total"])

    parts = rows.select("cluster", "v").mapInArrow(run, "cluster long, pos long, n long, total long")
    exact = parts.groupBy("cluster", "pos").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "total")])
    out: dict[int, tuple[int, list[int]]] = {}
    for r in exact.collect():  # k times d rows at most
        out.setdefault(r["cluster"], (int(r["n"]), [0] * d))[1][r["pos"]] = int(r["total"])
    return out


def first_centroids(kept: DataFrame, clusters: int, salt: str) -> np.ndarray:
    named = kept.where("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    return np.array([r["v"] for r in named.orderBy("h", "v").limit(clusters).collect()], np.int64)


def train(kept: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, DataFrame]:
    """(the centroids after the rounds, the vectors assigned to them)."""
    rows = None
    for r in range(rounds + 1):
        if rows is not None:
            for c, (n, total) in sums(rows, *centroids.shape).items():
                centroids[c] = [s // n for s in total]
        new = written(assigned(kept if rows is None else rows.select("vec_id", "v", "cluster"), centroids.copy()), "op13-assigned")
        if rows is not None:
            forget(kept.sparkSession, len(made) - 2, made[-1])  # the table before
        rows = new
    return centroids, rows


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, salt: str = SALT, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each vector that is kept: its centroid after the rounds, the squared distance to it, their sums
    over the cluster and over all, and a digest of the centroid's components."""
    kept = integral(vectors, dimensions, scale, vec_id, vector)
    centroids = first_centroids(kept, clusters, salt)
    if not len(centroids):
        none = [("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string")]
        return kept.select("vec_id", *[F.lit(None).cast(t).alias(n) for n, t in none])
    centroids, rows = train(kept, centroids, rounds)
    inertia = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    told = [(c, s, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    clusters_ = rows.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(clusters_), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(inertia.values())).cast("long").alias("inertia"), "centroid_sha256")

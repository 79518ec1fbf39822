"""k-means over integer vectors with a LAESA pivot table: distances to fixed pivots, stored once, spare exact distances.

The distance of a vector to a centroid is at least the difference of their distances to any pivot.  The vectors' distances to
the pivots are computed once and stored with the vectors; each round computes those of the few centroids, and only centroids
whose lower bound does not pass the best distance so far are compared exactly, in integers.  Bounds are loosened by more than
floating point can err, so they never rule out a nearest centroid or one at the same distance.

At scale: vectors stay in the partitions of the stored table; a round broadcasts the centroids (their number times the
dimension) and sums up, before shuffling, a row for each cluster and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import checkpointed

#: Centroids, rounds, components, the steps of one unit that components are rounded down to, and pivots.
CENTROIDS, ROUNDS, COMPONENTS, STEPS, PIVOTS = 40, 5, 64, 256, 8
#: Components in steps are below this, so that squared distances are exact longs for up to 64 of them.
MOST = 1 << 27
#: Vectors compared at once, and the share and the amount by which bounds are loosened.
_BLOCK, _SLACK, _LEAST_SLACK = 4096, 1e-9, 1e-3


def steps(embedding: str = "embedding", components: int = COMPONENTS) -> F.Column:
    """The vector in whole steps, rounded down, as longs; null if it has other than ``components`` finite numbers."""
    x = F.transform(F.col(embedding), lambda v: v.cast("double"))
    fine = (F.size(x) == components) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    within = F.forall(x, lambda v: F.abs(v * STEPS) < MOST)
    refused = F.raise_error(F.lit(f"a component is beyond {MOST} steps of 1/{STEPS}; distances would not fit a long"))
    return F.when(F.coalesce(fine, F.lit(False)), F.when(within, F.transform(x, lambda v: F.floor(v * STEPS).cast("long"))).otherwise(refused.cast("array<long>")))


def matrix(column: pa.Array, width: int, kind: type = np.int64) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(column), width)


def pivots_among(points: np.ndarray, n: int) -> np.ndarray:
    """Pivots far from each other: the first point, then each time the one farthest from those taken (the first of equals)."""
    taken, gap = [], np.full(len(points), np.iinfo(np.int64).max)
    while len(taken) < min(n, len(points)):
        taken.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[taken[-1]]) ** 2).sum(1))
    return points[taken]


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of points to pivots: correctly rounded roots of exact integers."""
    out = np.empty((len(points), len(pivots)))
    for k, p in enumerate(pivots):
        out[:, k] = np.sqrt(((points - p) ** 2).sum(1).astype(float))
    return out


@dataclass
class Centroids:
    """Centroids and their distances to the pivots."""

    points: np.ndarray
    to_pivots: np.ndarray

    def nearest(self, vectors: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each vector's centroid (the smaller number of equals), the squared distance, and how many exact ones it took."""
        cluster, least, computed = np.empty(len(vectors), np.int64), np.empty(len(vectors), np.int64), 0
        for a in range(0, len(vectors), _BLOCK):
            v, d = vectors[a : a + _BLOCK], to_pivots[a : a + _BLOCK]
            bound = np.zeros((len(v), len(self.points)))
            for k in range(d.shape[1]):
                np.maximum(bound, np.abs(d[:, k : k + 1] - self.to_pivots[:, k]), out=bound)
            bound = np.maximum(bound * (1 - _SLACK) - _LEAST_SLACK - _SLACK * d.max(1, initial=0.0)[:, None], 0.0)
            first = bound.argmin(1)
            best = ((v - self.points[first]) ** 2).sum(1)
            computed += len(v)
            open_ = bound * bound <= (best * (1 + _SLACK))[:, None]
            open_[np.arange(len(v)), first] = False
            for c in range(len(self.points)):
                # Those still open under the best so far; an exact distance replaces it if smaller, or equal with a smaller number.
                at = np.flatnonzero(open_[:, c])
                at = at[bound[at, c] ** 2 <= best[at] * (1 + _SLACK)]
                exact = ((v[at] - self.points[c]) ** 2).sum(1)
                computed += len(at)
                better = (exact < best[at]) | (exact == best[at]) & (c < first[at])
                best[at[better]], first[at[better]] = exact[better], c
            cluster[a : a + _BLOCK], least[a : a + _BLOCK] = first, best
        return cluster, least, computed


def pivot_table(vectors: DataFrame, pivots: np.ndarray, components: int) -> DataFrame:
    """The vectors (vec_id, v) with their distances to the pivots, stored in the shared folder."""
    held = vectors.sparkSession.sparkContext.broadcast(pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(matrix(batch.column(1), components), held.value)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * d.shape[1], pa.int32()), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["vec_id", "v", "to_pivots"])

    return checkpointed(vectors.select("vec_id", "v").mapInArrow(measure, "vec_id long, v array<long>, to_pivots array<double>"))


def assigned(table: DataFrame, centroids: Centroids, components: int) -> DataFrame:
    """vec_id, cluster and distance (squared) of each vector of a pivot table."""
    held = table.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            now = held.value
            cluster, least, _ = now.nearest(matrix(batch.column(1), components), matrix(batch.column(2), now.to_pivots.shape[1], float))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(least, pa.int64())], names=["vec_id", "cluster", "distance"])

    return table.mapInArrow(assign, "vec_id long, cluster int, distance long")


def moved(table: DataFrame, centroids: Centroids, components: int) -> np.ndarray:
    """The centroids after a round: each the floor of its vectors' mean, or where it was if it has none."""
    held = table.sparkSession.sparkContext.broadcast(centroids)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            now, v = held.value, matrix(batch.column(1), components)
            cluster, _, _ = now.nearest(v, matrix(batch.column(2), now.to_pivots.shape[1], float))
            order = np.argsort(cluster, kind="stable")
            mine, starts, n = np.unique(cluster[order], return_index=True, return_counts=True)
            sums = np.add.reduceat(v[order], starts) if len(v) else np.zeros((0, components), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * components, pa.int32()), pa.array(sums.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(mine, pa.int32()), pa.array(n, pa.int64()), lists], names=["cluster", "n", "sums"])

    rows = table.mapInArrow(add_up, "cluster int, n long, sums array<long>")
    # Decimals, as a sum over all vectors may pass 64 bits.
    sums = rows.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[k].cast("decimal(38,0)")) for k in range(components)]).alias("sums"))
    out = centroids.points.copy()
    for r in sums.collect():
        out[r["cluster"]] = [int(s) // r["n"] for s in r["sums"]]
    return out


def cluster(embeddings: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 2, components: int = COMPONENTS, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance of each vector of ``components`` finite numbers, stored, and the centroids.

    Centroids start as the vectors with the smallest sha256 of ``seed:vec_id`` (a null id: of ``seed:``; of one id, the
    smaller vector first), move ``rounds`` times, and vectors are assigned once more.  Vectors that are null, of another
    length, or with a null or non-finite component are left out; repeated rows are vectors of their own, equal ones are assigned
    alike; with fewer vectors there are fewer centroids, and an empty table gives no rows.  A component of MOST steps or more is
    an error, as distances would not fit a long.
    """
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), steps(components=components).alias("v")).where("v is not null")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = vectors.orderBy(drawn, "v").limit(centroids).collect()
    points = np.array([r["v"] for r in chosen], np.int64).reshape(len(chosen), components)
    fixed = pivots_among(points, pivots)
    table = pivot_table(vectors, fixed, components)
    now = Centroids(points, distances(points, fixed))
    for _ in range(rounds if len(points) else 0):
        points = moved(table, now, components)
        now = Centroids(points, distances(points, fixed))
    return checkpointed(assigned(table, now, components)), points


def digest(found: DataFrame, points: np.ndarray) -> DataFrame:
    """The vectors with their cluster's and the whole inertia, and the digest of their centroid."""
    names = [(k, hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()) for k, p in enumerate(points.tolist())]
    named = found.sparkSession.createDataFrame(names, "cluster int, centroid_sha256 string")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    # A row for each centroid.
    told = F.broadcast(sums.join(F.broadcast(named), "cluster").crossJoin(whole))
    return found.join(told, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

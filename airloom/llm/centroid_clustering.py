"""Exact k-means by Exponion search.

Each vector keeps its centroid, an upper bound of the distance to it and a lower bound of the distance to any other; both follow the
centroids' moves. A vector whose upper bound stays below the lower one, or below half the distance from its centroid to the nearest other,
keeps its centroid unseen. Any other looks at the centroids within ``2 * upper + distance to the nearest other`` of its own, which hold
the two nearest ones: the head of its centroid's sorted list of the others, in rings of doubling size. The radius is inclusive and the
bounds must differ by more than rounding, so ties are seen and go to the smaller number. Distances are exact integers.

Vectors and bounds are rows of a written table, one table a round, of which the one before is deleted; only the centroids and sums by centroid come to the driver.

Vectors of another length, null vectors and such with a null or non-finite component are left out. Components count up to 2^27 (larger ones as that), so that
a squared distance of 64 of them fits a long; a sum of distances that doesn't is null. Repeated rows and equal ids are vectors of
their own; a null id hashes as an empty one. With fewer vectors than centroids each is a centroid; no vectors give no rows. Other columns are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, session, table, written

DIM, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256.0, 2
MOST = 1 << 27
#: Below this all terms of a squared distance of ``DIM`` components are exact in doubles.
EXACT = 1 << 20
#: Bounds must differ by this share, far more than their rounding, before a vector is left unseen.
SLACK = 1e-9
STATE = "vec_id long, x array<int>, cluster int, upper double, lower double"


def integers(rows: DataFrame, dim: int = DIM, scale: float = SCALE) -> DataFrame:
    """``(vec_id, x)`` of the valid rows of ``(vec_id, embedding)``."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))
    whole = F.transform("embedding", lambda v: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), scale * v.cast("double")))).cast("int"))
    return rows.filter((F.size("embedding") == dim) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))


def squares(x, c):
    """Exact squared distances of all rows of x to all of c."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((x - y) ** 2).sum(1) for y in c], axis=1)


class Centres:
    """Centroids, how far each has moved, and for each the others by distance."""

    def __init__(self, c, before=None):
        self.c = c
        gaps = np.sqrt(squares(c, c))
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, axis=1)
        self.next = np.where(np.eye(len(c), dtype=bool), np.inf, gaps).min(axis=1)
        self.moved = np.zeros(len(c)) if before is None else np.sqrt(((c - before) ** 2).sum(1))
        far = np.argsort(self.moved)[::-1]
        self.others_moved = np.full(len(c), self.moved[far[0]])
        self.others_moved[far[0]] = self.moved[far[1]] if len(c) > 1 else 0.0

    def nearest(self, x, among):
        """(cluster, distance, distance to the second) of each row of x among the given centroids; ties go to the smaller number."""
        among = np.sort(among)
        d = squares(x, self.c[among])
        rows, best = np.arange(len(x)), d.argmin(axis=1)
        near = np.sqrt(d[rows, best])
        d[rows, best] = np.iinfo(np.int64).max
        return among[best], near, np.sqrt(d.min(axis=1)) if len(among) > 1 else np.full(len(x), np.inf)

    def assign(self, x, cluster, upper, lower):
        """(cluster, upper, lower) after the centroids' moves, and the number of distances that were worked out."""
        upper, lower = upper + self.moved[cluster], lower - self.others_moved[cluster]
        safe = np.maximum(lower, self.next[cluster] / 2)
        seen = np.flatnonzero(upper * (1 + SLACK) >= safe)
        upper[seen] = np.sqrt(((x[seen] - self.c[cluster[seen]]) ** 2).sum(1))
        work, seen = len(seen), seen[upper[seen] * (1 + SLACK) >= safe[seen]]
        if len(self.c) == 1:
            return cluster, upper, lower, work
        own, radius = cluster[seen], (2 * upper[seen] + self.next[cluster[seen]]) * (1 + SLACK)
        inside = np.zeros(len(seen), np.int64)
        for c in np.unique(own):
            inside[own == c] = np.searchsorted(self.gaps[c], radius[own == c], "right")
        ring = np.ceil(np.log2(np.maximum(inside, 2))).astype(np.int64)
        cluster = cluster.copy()
        for c, r in {*zip(own.tolist(), ring.tolist())}:
            rows, among = seen[(own == c) & (ring == r)], self.order[c][: 1 << r]
            cluster[rows], upper[rows], lower[rows] = self.nearest(x[rows], among)
            work += len(rows) * len(among)
        return cluster, upper, lower, work


def assigned(state: DataFrame, centres: Centres, dim: int) -> DataFrame:
    """The vectors with their centroids and bounds; rows without bounds are compared with all centroids."""
    shared, bounded = state.sparkSession.sparkContext.broadcast(centres), "cluster" in state.columns

    def rows(batches):
        centres = shared.value
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, dim).astype(np.int64)
            if bounded:
                found = centres.assign(x, *[batch.column(c).to_numpy() for c in ("cluster", "upper", "lower")])
            else:
                found = centres.nearest(x, np.arange(len(centres.c)))
            cluster, upper, lower = found[:3]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower)], ["vec_id", "x", "cluster", "upper", "lower"])

    return state.mapInArrow(rows, STATE)


def moved(state: DataFrame, c: np.ndarray) -> np.ndarray:
    """Each centroid as the floor of its vectors' mean; centroids without vectors stay."""
    sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(c.shape[1])])
    out = c.copy()
    for r in sums.collect():  # a row for each centroid
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(c.shape[1])]
    return out


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.x for r in vectors.select(name.alias("h"), "x").orderBy("h", "x").limit(k).collect()], np.int64)


def clustered(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of each valid row of ``(vec_id, embedding)``."""
    spark, state = session(rows), integers(rows, dim, scale)
    c = first_centroids(state, k, seed)
    if not len(c):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centres, last = Centres(c), None
    for _ in range(rounds):
        state = written(assigned(state, centres, dim))
        if last is not None:
            forget(last)
        last, centres = state, Centres(moved(state, centres.c), centres.c)
    found = assigned(state, centres, dim).join(F.broadcast(numbered(spark, centres.c)), "cluster")
    distance = F.aggregate(F.zip_with("x", "centre", lambda a, b: (a.cast("long") - b) * (a.cast("long") - b)), F.lit(0).cast("long"), lambda s, v: s + v)
    found = written(found.select("vec_id", "cluster", distance.alias("distance"), "centroid_sha256"))
    if last is not None:
        forget(last)
    by_cluster = found.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    total = found.agg(F.try_sum("distance")).first()[0]
    whole = found.join(F.broadcast(by_cluster), "cluster").withColumn("inertia", F.lit(total).cast("long"))
    return whole.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def numbered(spark, c: np.ndarray) -> DataFrame:
    """``(cluster, centre, centroid_sha256)``: a row for each centroid."""
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c.tolist()]
    return spark.createDataFrame([(i, x, h) for i, (x, h) in enumerate(zip(c.tolist(), digest))], "cluster int, centre array<long>, centroid_sha256 string")


def op12_exponion_clusters(spark, sf_dir):
    return clustered(table(spark, sf_dir, "embeddings"))

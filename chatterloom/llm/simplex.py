"""Exact k-means whose assignment is filtered by n-simplex projection.

A vector's distances to a few pivots are computed once. They place it as the apex of a simplex over the pivots: coordinates in
the pivots' span and its altitude above it. Two apexes with the same base have distance ``|y - z|^2 + (h - g)^2`` if their
altitudes point the same way and ``|y - z|^2 + (h + g)^2`` if they point apart: squares of the least and the largest distance that two such vectors
can have. A centroid is projected the same way in each round; it is compared component by component, in whole numbers, only
where its least distance doesn't exceed the smallest largest one. Bounds are floats and give way by ``SLACK``, so they never decide.

Each round is one pass over the stored vectors; tasks send one exact sum per cluster. The driver sees the centroids and a sample of
``PIVOT_SAMPLE`` vectors from which pivots are taken.

Vectors that are null, of another length, or that hold a null or non-finite component take no part. Rows without an id
and repeated rows are vectors of their own; the first centroids are the smallest hashes, ties by components. With fewer vectors than clusters
each vector starts one; no vectors give no rows. Ties of distance go to the smaller number, an empty cluster keeps its centroid. Extra columns
are ignored. A component of ``LARGEST`` or more in magnitude ends the job with an error, for exact distances would not fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterloom.llm.shared import stored

PIVOTS = 16
PIVOT_SAMPLE = 256
# A pivot adds to the base if its height above the others is at least this share of its distance to the first.
LEAST_HEIGHT = 0.05
SLACK = 1e-5
LARGEST = 1 << 27


def whole_vectors(table: DataFrame, scale: float, length: int | None = None) -> DataFrame:
    """(vec_id, v) of the vectors that take part, components as floor(scale * x)."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    fits = F.forall(x, lambda c: F.abs(c.cast("double")) * scale < LARGEST)
    rows = table.select(F.col("vec_id").cast("long"), "embedding").where(x.isNotNull() & finite & (F.lit(length is None) | (F.size(x) == F.lit(length or 0))))
    return rows.select("vec_id", F.when(fits, whole).otherwise(F.raise_error(F.lit(f"a component of {LARGEST} or more")).cast("array<bigint>")).alias("v"))


def first_by_hash(vectors: DataFrame, salt: str, n: int) -> list:
    """The ``n`` vectors with the smallest hash of their id; ids may be null."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [r["v"] for r in vectors.orderBy(key, "v").limit(n).collect()]


def matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def base_simplex(sample: list[list[int]], most: int = PIVOTS) -> np.ndarray:
    """Pivots, each the sampled vector that stands highest above the span of those before."""
    points = np.unique(np.array(sample, dtype=np.int64), axis=0)
    rest = (points - points[0]).astype(float)
    reach = (rest**2).sum(axis=1)
    chosen, left = [0], rest.copy()
    while len(chosen) < min(most, len(points)):
        height = (left**2).sum(axis=1)
        best = int(height.argmax())
        if height[best] <= LEAST_HEIGHT**2 * max(reach[best], 1.0):
            break
        along = left[best] / np.sqrt(height[best])
        left -= np.outer(left @ along, along)
        chosen.append(best)
    return points[chosen]


class Projection:
    """Apex coordinates and altitude from the distances to the pivots."""

    def __init__(self, pivots: np.ndarray) -> None:
        self.pivots = pivots
        edges = (pivots[1:] - pivots[0]).astype(float)
        self.reach = (edges**2).sum(axis=1)
        # The base simplex: its Gram matrix has as factor the coordinates of the pivots themselves.
        self.inverse = np.linalg.inv(np.linalg.cholesky(edges @ edges.T)) if len(edges) else np.empty((0, 0))

    def distances(self, v: np.ndarray) -> np.ndarray:
        """Squared, exact, one column for each pivot."""
        return np.stack([((v - p) ** 2).sum(axis=1) for p in self.pivots], axis=1).astype(float)

    def apex(self, squared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inner = (squared[:, :1] + self.reach - squared[:, 1:]) / 2
        y = inner @ self.inverse.T
        return y, np.sqrt(np.maximum(squared[:, 0] - (y**2).sum(axis=1), 0))

    def slack(self, reach: np.ndarray) -> np.ndarray:
        return SLACK * (reach + self.reach.max(initial=0) + 1)


def nearest(v: np.ndarray, y: np.ndarray, h: np.ndarray, centroids: np.ndarray, at: Projection) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, exact comparisons made) for vectors with apexes (y, h)."""
    z, g = at.apex(at.distances(centroids))
    flat = np.stack([((y - c) ** 2).sum(axis=1) for c in z], axis=1)
    slack = at.slack((y**2).sum(axis=1) + h**2)[:, None] + at.slack((z**2).sum(axis=1) + g**2)
    low, high = flat + (h[:, None] - g) ** 2 - slack, flat + (h[:, None] + g) ** 2 + slack
    open_ = low <= high.min(axis=1, keepdims=True)
    best, cluster, compared = np.full(len(v), np.iinfo(np.int64).max), np.zeros(len(v), np.int64), 0
    for c in range(len(centroids)):
        rows = np.flatnonzero(open_[:, c] & (low[:, c] <= best))
        d = ((v[rows] - centroids[c]) ** 2).sum(axis=1)
        compared += len(rows)
        less = d < best[rows]
        best[rows[less]], cluster[rows[less]] = d[less], c
    return cluster, best, compared


def projected(vectors: DataFrame, at: Projection, length: int) -> DataFrame:
    """The vectors with ``y`` and ``h``."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            y, h = at.apex(at.distances(matrix(x.column("v"), length)))
            ys = pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), y.shape[1]).cast(pa.list_(pa.float64())) if y.shape[1] else pa.array([[]] * len(h), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([x.column("vec_id"), x.column("v"), ys, pa.array(h)], ["vec_id", "v", "y", "h"])

    return vectors.mapInArrow(place, "vec_id long, v array<long>, y array<double>, h double")


def _read(x: pa.RecordBatch, length: int, at: Projection) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return matrix(x.column("v"), length), matrix(x.column("y"), len(at.pivots) - 1) if len(at.pivots) > 1 else np.empty((x.num_rows, 0)), x.column("h").to_numpy()


def _moved(rows: DataFrame, centroids: np.ndarray, at: Projection) -> np.ndarray:
    """The centroids after one round."""
    length = centroids.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for x in batches:
            v, y, h = _read(x, length, at)
            cluster, _, _ = nearest(v, y, h, centroids, at)
            for c in np.unique(cluster):
                own = v[cluster == c]
                n[c] += len(own)
                total[c] += own.sum(axis=0)
        some = np.flatnonzero(n)
        told = np.column_stack([n, total])[some].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(told, pa.list_(pa.int64()))], ["c", "told"])

    parts = rows.mapInArrow(add, "c long, told array<long>").select("c", F.posexplode("told").alias("at", "x"))
    sums: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("c", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        sums.setdefault(r["c"], {})[r["at"]] = int(r["x"])
    out = centroids.copy()
    for c, x in sums.items():
        out[c] = [x[i + 1] // x[0] for i in range(length)]
    return out


def clustered(table: DataFrame, k: int = 8, rounds: int = 10, length: int = 64, scale: float = 1024, salt: str = "3") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) of every vector that takes part."""
    spark = table.sparkSession
    vectors = stored(whole_vectors(table, scale, length), "vectors")
    first = first_by_hash(vectors, salt, k)
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    at = Projection(base_simplex(first_by_hash(vectors, "pivot", PIVOT_SAMPLE)))
    rows = stored(projected(vectors, at, length), "apexes")
    centroids = np.array(first, dtype=np.int64)
    for _ in range(rounds):
        moved = _moved(rows, centroids, at)
        if (moved == centroids).all():
            break
        centroids = moved

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            cluster, distance, _ = nearest(*_read(x, length, at), centroids, at)
            yield pa.RecordBatch.from_arrays([x.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = stored(rows.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    inertia = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    known = spark.createDataFrame(pa.table({"cluster": pa.array(range(len(centroids)), pa.int32()), "centroid": pa.array(centroids.tolist(), pa.list_(pa.int64()))}))
    # One row for each cluster.
    small = inertia.join(known, "cluster").select("*", F.sum("cluster_inertia").over(Window.partitionBy()).alias("inertia"))
    return assigned.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_hash(centroid: Column) -> Column:
    return F.sha2(F.array_join(centroid.cast("array<string>"), ","), 256)

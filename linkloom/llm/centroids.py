"""Centroid clustering with block-norm screening, in exact integers.

Vectors become integers floor(scale * x) and are written once, each with its compressed form: the
norm of each segment of ``segment`` components. By Cauchy-Schwarz a segment of a vector and of a
centroid are at least as far apart as their norms, so the sum of squared norm differences bounds
the squared distance from below. A vector first meets the centroid with the least bound; the
others receive an exact integer distance only if their bound doesn't exceed the best one found.

A round is one pass over the written table: a task sends sums and counts of each centroid's
vectors, and only ``k`` centroids, bounded by parameters, go through the driver.

Defined cases: vectors with another number of components, with a null or non-finite one, or with
one of 2**27 / scale or more (its squared distances don't fit a long) take no part, nor do null
vectors. Ties go to the smaller centroid; equal hashes of first centroids are ordered by
components, null ids come last. Fewer vectors than ``k`` make fewer centroids; an empty table gives
an empty result; repeated and null ids are rows of their own. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package
from .common import written

#: Bounds are lowered by this share of both norms: far above the rounding of 32-bit norms.
_SLACK = 1e-6
LARGEST = 1 << 27


def whole_vectors(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that take part, and their integers floor(scale * x)."""
    fits = np.asarray(column.value_lengths().fill_null(-1)) == dim
    at = np.flatnonzero(fits)
    if not len(at):
        return at, np.zeros((0, dim), np.int64)
    x = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    x = np.floor(x * float(scale))
    good = (np.abs(x) < LARGEST).all(axis=1)  # false for null and non-finite components too
    return at[good], x[good].astype(np.int64)


def segment_norms(q: np.ndarray, segment: int) -> np.ndarray:
    """Norms of consecutive segments, the last one padded by zeros."""
    n, d = q.shape
    padded = np.zeros((n, -(-d // segment) * segment), np.float64)
    padded[:, :d] = q
    return np.sqrt((padded.reshape(n, -1, segment) ** 2).sum(axis=2))


def compressed(vectors: DataFrame, dim: int, scale: int, segment: int) -> DataFrame:
    """(vec_id, q, norms): integers and segment norms as little-endian bytes."""
    ship_package(vectors.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, q = whole_vectors(b.column(1), dim, scale)
            norms = segment_norms(q, segment).astype("<f4")
            cut = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), cut(q.astype("<i4")), cut(norms)], names=["vec_id", "q", "norms"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(pack, "vec_id long, q binary, norms binary")


def matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """A column of equally long byte strings as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def nearest(q: np.ndarray, norms: np.ndarray, centroids: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and squared distance of each vector, and how many exact distances it took."""
    theirs = segment_norms(centroids, segment)
    size = (norms**2).sum(axis=1)[:, None] + (theirs**2).sum(axis=1)[None, :]
    low = size * (1 - _SLACK) - 2 * (norms @ theirs.T)
    label = low.argmin(axis=1)
    first = label.copy()
    best = ((q - centroids[label]) ** 2).sum(axis=1)
    spent = len(q)
    for j, c in enumerate(centroids):
        rows = np.flatnonzero((low[:, j] <= best) & (first != j))
        d = ((q[rows] - c) ** 2).sum(axis=1)
        better = (d < best[rows]) | ((d == best[rows]) & (j < label[rows]))
        label[rows[better]], best[rows[better]] = j, d[better]
        spent += len(rows)
    return label, best, spent


def _arrays(b: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    q, norms = b.column(b.schema.get_field_index("q")), b.column(b.schema.get_field_index("norms"))
    return matrix(q, "<i4", dim).astype(np.int64), matrix(norms, "<f4", len(norms[0].as_py()) // 4).astype(np.float64)


def _sums(table: DataFrame, centroids: np.ndarray, dim: int, segment: int) -> DataFrame:
    """(cluster, component, total): sums a task; component -1 is the count."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), dim + 1), np.int64)
        for b in batches:
            if b.num_rows:
                q, norms = _arrays(b, dim)
                label, _, _ = nearest(q, norms, centroids, segment)
                for j in np.unique(label):
                    mine = label == j
                    total[j, 0] += mine.sum()
                    total[j, 1:] += q[mine].sum(axis=0)
        cluster, component = np.nonzero(np.repeat(total[:, :1] > 0, dim + 1, axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(cluster, pa.int32()), pa.array(component - 1, pa.int32()), pa.array(total[cluster, component], pa.int64())], names=["cluster", "component", "total"]
        )

    each = table.select("q", "norms").mapInArrow(add, "cluster int, component int, total long")
    return each.groupBy("cluster", "component").agg(F.sum("total").alias("total"))


def first_centroids(table: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of seed and id: a top-k, each task sends k rows."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = table.select(h.alias("h"), "q").orderBy(F.asc_nulls_last("h"), "q").limit(k).collect()
    return np.array([np.frombuffer(r.q, "<i4") for r in rows], np.int64)


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, segment: int = 4, seed: int = 1
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each vector that takes part, and the final centroids."""
    table = written(compressed(vectors, dim, scale, segment), "vectors")
    centroids = first_centroids(table, k, seed)
    if not len(centroids):
        return table.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        totals = {(r.cluster, r.component): r.total for r in _sums(table, centroids, dim, segment).collect()}
        centroids = np.array(
            [[totals[j, i] // totals[j, -1] for i in range(dim)] if (j, -1) in totals else list(c) for j, c in enumerate(centroids)], np.int64
        )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                label, best, _ = nearest(*_arrays(b, dim), centroids, segment)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label, pa.int32()), pa.array(best, pa.int64())], names=["vec_id", "cluster", "distance"])

    return table.mapInArrow(assign, "vec_id long, cluster int, distance long"), centroids


def clusters(vectors: DataFrame, **how) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each vector that takes part."""
    assigned, centroids = cluster(vectors, **how)
    assigned = written(assigned, "assigned")
    sums = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    rows = [(j, s, sum(sums.values()), digest(centroids[j])) for j, s in sums.items()]
    by_cluster = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(by_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

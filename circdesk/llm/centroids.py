"""Clustering integer vectors around centroids, searched through Walsh-Hadamard coefficients.

The transform of a vector's 64 integers is again 64 integers, and the squared distance of two vectors
is a 64th of that of their transforms. The coefficients are ordered from coarse (few sign changes)
to fine and compared in growing groups; a centroid whose sum so far exceeds the whole distance of
another one is out. Those that stay are compared in all 64 coefficients, so the result is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circdesk.llm.support import durable, pieces

SIZE = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
SALT = "2:"
LARGEST = 1 << 23  # components beyond it could overflow the 64-bit sums of squares
_GROUPS = (0, 4, 8, 16, 32, SIZE)
_BATCH = 2048


def _walsh() -> np.ndarray:
    """The Walsh-Hadamard matrix of order 64, rows from the fewest sign changes to the most."""
    rows = np.array([[1]], np.int64)
    while len(rows) < SIZE:
        rows = np.block([[rows, rows], [rows, -rows]])
    return rows[np.argsort((np.diff(rows, axis=1) != 0).sum(1), kind="stable")]


_WALSH = _walsh()


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each transformed vector the nearest transformed centroid (ties: the first) and their squared distance."""
    n = len(vectors)
    sums = np.zeros((n, len(centroids)), np.int64)
    open_ = np.ones(sums.shape, bool)
    row, col = np.indices(sums.shape).reshape(2, -1)
    for a, b in zip(_GROUPS[:-1], _GROUPS[1:]):
        step = vectors[row, a:b] - centroids[col, a:b]
        sums[row, col] += (step * step).sum(1)
        # The centroid that leads now is finished at once; its distance is the bound for the others.
        lead = np.where(open_, sums, np.iinfo(np.int64).max).argmin(1)
        rest = vectors[:, b:] - centroids[lead, b:]
        bound = sums[np.arange(n), lead] + (rest * rest).sum(1)
        open_ &= sums <= bound[:, None]
        row, col = np.nonzero(open_)
    whole = np.where(open_, sums, np.iinfo(np.int64).max)
    best = whole.argmin(1)
    return best, whole[np.arange(n), best] // SIZE


def whole_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and ``v``, the integers floor(256 * x), of the rows with 64 components, none null or non-finite."""
    values = F.transform(column, lambda x: x.cast("double"))
    usable = (F.size(column) == SIZE) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(usable).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(values, lambda x: F.floor(x * F.lit(float(SCALE))).cast("long")).alias("v"),
    )


def cluster_vectors(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, salt: str = SALT) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256, one row per kept row.

    Kept are vectors of exactly 64 components, none null or non-finite; others give no row. The first
    centroids are the kept rows with the smallest sha256 of ``salt`` and vec_id, among rows that
    share an id the smaller vector first; rows without vec_id start none, but are clustered. Repeated
    rows count one by one. With fewer rows than ``centroids`` there are as many centroids as rows;
    without any (an empty table, or null vec_ids only) the result is empty. Other columns are not
    read. A component beyond ``LARGEST`` raises an error, since its squares would not fit.

    Sums and counts per cluster leave a task, never vectors; the driver holds the centroids only.
    """
    kept = whole_vectors(vectors)
    rows = durable(kept.mapInArrow(_transformed, "vec_id long, w array<long>"))
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.where("vec_id is not null").withColumn("_order", order).orderBy("_order", "v").limit(centroids)
    start = np.array([r.v for r in first.select("v").collect()], np.int64).reshape(-1, SIZE)
    if not len(start):
        return _empty(vectors)
    now = start
    for _ in range(rounds):
        sums = rows.mapInArrow(_summing(now @ _WALSH.T), _SUMS).groupBy("cluster").agg(
            F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(SIZE)])
        now = now.copy()
        for r in sums.collect():  # one row per centroid
            total = np.array([r[f"s{i}"] for i in range(SIZE)], object) @ _WALSH.astype(object)
            now[r.cluster] = [t // SIZE // r.n for t in total]  # the transform twice is 64 times the sum
    marks = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in now]
    placed = durable(rows.mapInArrow(_placing(now @ _WALSH.T), "vec_id long, cluster int, distance long"))
    per_cluster = {r.cluster: r.s for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = vectors.sparkSession.createDataFrame(
        [(c, s, sum(per_cluster.values()), marks[c]) for c, s in per_cluster.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return placed.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", *facts.columns[1:])


def _empty(vectors: DataFrame) -> DataFrame:
    return vectors.sparkSession.createDataFrame(
        [], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)


def _transformed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = _matrix(batch.column("v"))
        if values.size and np.abs(values).max() > LARGEST:
            raise ValueError(f"a component is beyond {LARGEST // SCALE}; its squares don't fit")
        rows = pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * SIZE, (values @ _WALSH.T).ravel())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), rows], names=["vec_id", "w"])


_SUMS = "cluster int, n long, " + ", ".join(f"s{i} long" for i in range(SIZE))


def _summing(centroids: np.ndarray):
    """Per task one row for each cluster: its number of vectors and the sum of their transforms."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(centroids), np.int64)
        sums = np.zeros((len(centroids), SIZE), np.int64)
        for batch in pieces(batches, _BATCH):
            values = _matrix(batch.column("w"))
            best, _ = nearest(values, centroids)
            n += np.bincount(best, minlength=len(n))
            sums += (best == np.arange(len(n))[:, None]).astype(np.int64) @ values
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(n[used]), *[pa.array(s) for s in sums[used].T]],
            names=[c.split()[0] for c in _SUMS.split(", ")])

    return run


def _placing(centroids: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, _BATCH):
            best, distance = nearest(_matrix(batch.column("w")), centroids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(best, pa.int32()), pa.array(distance)],
                names=["vec_id", "cluster", "distance"])

    return run

"""Centroid clustering by scalar lookup tables, exact in integers.

Components become whole numbers. A dimension of all vectors takes few different values then, so each
round tabulates the squared difference of every dimension, occurring value and centroid once, and the
distances of a vector to all centroids are a sum of one gathered table row a dimension. The tables of
a round follow from the dictionary of occurring values (at most VALUES of them travel) and the
centroids; if more values occur, each block of vectors tabulates its own.

Rounds keep nothing by vector: tasks send a sum and a count a cluster, the driver holds the centroids.

Cases: null, short, long and non-finite vectors and such with a null component are left out. Components
beyond 2**27 after scaling count as that bound, so that a distance fits 64 bits. Rows with one id are
vectors of their own; a null id is hashed as an empty one. With fewer vectors than centroids each starts
one; equal starts leave the later ones empty, and empty ones stay where they are. Sums over vectors
beyond 64 bits are given as the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import durable

#: Components of a vector, steps a unit, centroids, rounds, and what the hash that picks the first centroids begins with.
WIDTH, SCALE, CENTROIDS, ROUNDS, SALT = 64, 256.0, 40, 5, "2:"
#: Largest integer of a component; occurring (dimension, value) pairs that the dictionary may hold; vectors of a block.
LARGEST, VALUES, BLOCK = 1 << 27, 65_536, 4_096
#: A dimension's codes are found in an array over its range up to so wide, by binary search beyond.
DENSE = 1 << 16
LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, key: str, column: str, width: int = WIDTH, scale: float = SCALE) -> DataFrame:
    """key long, `integers` binary of all vectors with exactly `width` finite components: 16-bit integers where all of a row fit, else 32-bit ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(b.column(1)), width), False))
            x = pc.fill_null(b.column(1).flatten(), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, width)
            kept = np.isfinite(x).all(axis=1)
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(scale * x[kept]), -LARGEST, LARGEST).astype("<i4")
            small = (np.abs(whole) < 1 << 15).all(axis=1)
            packed = np.full(len(whole), None, dtype=object)
            for rows, kind in ((small, "<i2"), (~small, "<i4")):
                packed[rows] = [r.tobytes() for r in whole[rows].astype(kind)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(kept)), pa.array(packed, pa.binary())], names=[key, "integers"])

    return vectors.select(F.col(key).cast("long").alias(key), F.col(column).cast("array<double>").alias("x")).mapInArrow(run, f"`{key}` long, integers binary")


def unpacked(column: pa.Array, width: int = WIDTH) -> np.ndarray:
    """Rows of integers from what quantised() packed."""
    size, out = pc.binary_length(column).to_numpy(zero_copy_only=False), np.empty((len(column), width), np.int64)
    for kind, bytes_of in (("<i2", 2 * width), ("<i4", 4 * width)):
        rows = size == bytes_of
        out[rows] = np.frombuffer(b"".join(column.filter(pa.array(rows)).to_pylist()), kind).reshape(-1, width)
    return out


class Tables:
    """Squared differences by dimension, occurring value and centroid, as one array of rows that hold all centroids."""

    def __init__(self, occurring: list[np.ndarray], centroids: np.ndarray):
        self.occurring = occurring
        self.start = np.cumsum([0, *(len(v) for v in occurring)])
        reach = max([int(np.abs(centroids).max(initial=0)), *(int(np.abs(v).max(initial=0)) for v in occurring)])
        kind = np.int32 if 4 * reach * reach * len(occurring) < 1 << 31 else np.int64
        self.rows = np.concatenate([np.square(v[:, None] - centroids[None, :, d]).astype(kind) for d, v in enumerate(occurring)])
        self.codes = [self._dense(v) for v in occurring]

    @staticmethod
    def _dense(values: np.ndarray) -> np.ndarray | None:
        if not len(values) or values[-1] - values[0] >= DENSE:
            return None
        out = np.zeros(values[-1] - values[0] + 1, np.intp)
        out[values - values[0]] = np.arange(len(values))
        return out

    def nearest(self, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid (the first of equal ones) of each row and its squared distance."""
        total = np.zeros((len(whole), self.rows.shape[1]), self.rows.dtype)
        taken = np.empty_like(total)
        for d, values in enumerate(self.occurring):
            dense = self.codes[d]
            code = np.searchsorted(values, whole[:, d]) if dense is None else dense[whole[:, d] - values[0]]
            np.take(self.rows, code + self.start[d], axis=0, out=taken, mode="clip")
            total += taken
        cluster = total.argmin(axis=1)
        return cluster, np.take_along_axis(total, cluster[:, None], axis=1)[:, 0].astype(np.int64)


class Assigner:
    """What a task needs in a round: the dictionary of occurring values (None: each block has its own) and the centroids."""

    def __init__(self, occurring: list[np.ndarray] | None, centroids: np.ndarray):
        self.occurring, self.centroids = occurring, centroids

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of rows with their integers, nearest centroids and distances."""
        shared = Tables(self.occurring, self.centroids) if self.occurring is not None else None
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                whole = unpacked(part.column(1), self.centroids.shape[1])
                tables = shared or Tables([np.unique(column) for column in whole.T], self.centroids)
                yield part, whole, *tables.nearest(whole)


def occurring_values(packed: DataFrame, width: int = WIDTH, most: int = VALUES) -> list[np.ndarray] | None:
    """The ascending values of each dimension; None if there are more than `most` in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, column in enumerate(unpacked(b.column(0), width).T):
                values = np.unique(column)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), d, np.int32)), pa.array(values)], names=["dimension", "value"])

    got = packed.select("integers").mapInArrow(run, "dimension int, value long").distinct().limit(most + 1).collect()
    if len(got) > most:
        return None
    held: list[list[int]] = [[] for _ in range(width)]
    for r in got:
        held[r.dimension].append(r.value)
    return [np.array(sorted(v), np.int64) for v in held]


def _moved(packed: DataFrame, by: Assigner) -> np.ndarray:
    """The centroids after a round: floors of their vectors' means, by exact sums."""
    count, width = by.centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((count, width), np.int64), np.zeros(count, np.int64)
        for _, whole, cluster, _ in by.blocks(batches):
            member = (cluster == np.arange(count)[:, None]).astype(float)
            total += (member @ whole.astype(float)).astype(np.int64)  # exact: sums of a block stay under 2**53
            n += np.bincount(cluster, minlength=count)
        c, d = np.divmod(np.arange(count * width), width)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(d), pa.array(total.ravel()), pa.array(np.repeat(n, width))], names=["c", "d", "total", "n"])

    sums = packed.mapInArrow(run, "c long, d long, total long, n long").where("n > 0").groupBy("c", "d").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    moved = by.centroids.copy()
    for r in sums.collect():  # a row a centroid and dimension
        moved[r.c, r.d] = int(r.total) // r.n
    return moved


def cluster(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", count: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: float = SCALE, most: int = VALUES) -> DataFrame:
    """key, cluster int, distance, cluster_inertia, inertia long, centroid_sha256 of every vector that quantised() keeps.

    The first centroids are the `count` vectors whose SALT and id have the least sha256 (of equal ids, by their integers).
    """
    spark = vectors.sparkSession
    packed = durable(quantised(vectors, key, column, width, scale))
    order = F.sha2(F.concat(F.lit(SALT), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    first = [r.integers for r in packed.orderBy(order, "integers").limit(count).collect()]
    result = f"`{key}` long, cluster int, distance long"
    if not first:
        return spark.createDataFrame([], f"{result}, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids, occurring = unpacked(pa.array(first, pa.binary()), width), occurring_values(packed, width, most)
    for _ in range(rounds):
        centroids = _moved(packed, Assigner(occurring, centroids))
    last = Assigner(occurring, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, nearest, distance in last.blocks(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nearest.astype(np.int32)), pa.array(distance)], names=[key, "cluster", "distance"])

    assigned = durable(packed.mapInArrow(assign, result))
    inertia = {r.cluster: int(r.total) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    about = spark.createDataFrame([(c, min(LONG, total), digest(c)) for c, total in sorted(inertia.items())], "cluster int, cluster_inertia long, centroid_sha256 string")
    joined = assigned.join(F.broadcast(about), "cluster")  # a row a centroid
    return joined.select(key, "cluster", "distance", "cluster_inertia", F.lit(min(LONG, sum(inertia.values()))).cast("long").alias("inertia"), "centroid_sha256")

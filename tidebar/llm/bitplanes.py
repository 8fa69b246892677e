"""Centroid clustering on bit planes.

Each of 64 components x becomes the integer floor(256 * x), x as double, in two's complement.
Plane i packs bit i of all components into one 64-bit word; the last plane counts negative. A product of two
vectors is the sum over pairs of planes of their weights times popcount(plane AND plane), exactly,
and a squared distance is |x|^2 - 2 x.c + |c|^2.

Each vector has as many planes as its batch needs (nine words for components within +-1),
written once for all rounds. A round sends the centroids to the tasks, which return count and
componentwise sum per cluster; only those meet in a shuffle.

Vectors that are null, have another size or hold null or non-finite components are left out.
Components beyond +-2**19 count as that limit, so that all distances fit 64 bits. Vectors without an id are clustered but
never start a centroid (without any id there is no cluster and no row); rows with one id are vectors
of their own. With fewer vectors than centroids each starts one. A sum of distances beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.session import durable

SIZE = 64
LIMIT = 1 << 27

PLANES = "vec_id long, width int, planes binary, norm long"
SUMS = ", ".join(["cluster int", "n long", *(f"s{j} long" for j in range(SIZE))])


def width_of(values: np.ndarray) -> int:
    """Planes that integers need in two's complement."""
    if not values.size:
        return 1
    return max(max(int(values.max()), 0).bit_length(), max(~int(values.min()), 0).bit_length()) + 1


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """(n, 64) integers to (n, width) words; word i has bit i of component j at place j."""
    places = np.arange(width, dtype=np.int64)
    bits = ((values[:, None, :] >> places[None, :, None]) & 1).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little").view("<u8")[:, :, 0]


def unpack(planes: np.ndarray) -> np.ndarray:
    """(n, width) words back to (n, 64) integers."""
    n, width = planes.shape
    octets = np.ascontiguousarray(planes).astype("<u8").view(np.uint8).reshape(n, width, 8)
    bits = np.unpackbits(octets, axis=2, bitorder="little")
    out = np.zeros((n, SIZE), np.int64)
    for i, weight in enumerate(weights(width)):
        out += bits[:, i].astype(np.int64) * weight
    return out


def weights(width: int) -> list[int]:
    """Weights of the planes; the last one is the sign."""
    return [1 << i for i in range(width - 1)] + [-(1 << (width - 1))]


def products(planes: np.ndarray, other: np.ndarray) -> np.ndarray:
    """x . c of many vectors with one, both as planes."""
    out = np.zeros(len(planes), np.int64)
    for i, a in enumerate(weights(planes.shape[1])):
        for j, b in enumerate(weights(len(other))):
            out += np.bitwise_count(planes[:, i] & other[j]).astype(np.int64) * (a * b)
    return out


def integers(vectors: pa.ListArray) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(256.0 * flat), -LIMIT, LIMIT).astype(np.int64).reshape(-1, SIZE)


def packed(rows: DataFrame) -> DataFrame:
    """(vec_id, width, planes, norm) of the vectors that are kept."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            values = integers(batch.column(1))
            width = width_of(values)
            planes = pack(values, width)
            words = pa.array([p.tobytes() for p in planes], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(values), width, np.int32)), words,
                 pa.array((values * values).sum(1))], ["vec_id", "width", "planes", "norm"])

    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return kept.filter((F.size("embedding") == SIZE) & whole).mapInArrow(run, PLANES)


def _words(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, planes) of a batch, one pair for each width."""
    widths = batch.column(1).to_numpy()
    planes = batch.column(2)
    found = []
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        words = b"".join(planes.take(pa.array(at)).to_pylist())
        found.append((at, np.frombuffer(words, "<u8").reshape(-1, width)))
    return found


def _nearest(batch: pa.RecordBatch, centroids: list[list[int]]):
    """(rows, planes, cluster, distance) for each width of a batch; ties go to the smaller number."""
    found = []
    for at, planes in _words(batch):
        norm = batch.column(3).to_numpy()[at]
        cluster = np.zeros(len(at), np.int32)
        best = np.full(len(at), np.iinfo(np.int64).max)
        for number, centroid in enumerate(centroids):
            values = np.array([centroid], np.int64)
            square = sum(c * c for c in centroid)
            distance = norm - 2 * products(planes, pack(values, width_of(values))[0]) + square
            nearer = distance < best
            cluster[nearer], best[nearer] = number, distance[nearer]
        found.append((at, planes, cluster, best))
    return found


def _sums(centroids: list[list[int]]):
    """Count and componentwise sum per cluster, one row each at the end of a task."""

    def run(batches):
        counts = np.zeros(len(centroids), np.int64)
        sums = np.zeros((len(centroids), SIZE), np.int64)
        for batch in batches:
            for _, planes, cluster, _ in _nearest(batch, centroids):
                order = np.argsort(cluster, kind="stable")
                some, starts = np.unique(cluster[order], return_index=True)
                sums[some] += np.add.reduceat(unpack(planes[order]), starts, axis=0)
                counts += np.bincount(cluster, minlength=len(centroids))
        some = np.flatnonzero(counts)
        columns = [some.astype(np.int32), counts[some], *sums[some].T]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in columns], ["cluster", "n", *(f"s{j}" for j in range(SIZE))])

    return run


def starts(rows: DataFrame, k: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of ``2:<vec_id>``; equal ids by their planes."""
    key = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    first = rows.filter("vec_id IS NOT NULL").orderBy(key, "planes").limit(k).select("width", "planes").collect()
    return [unpack(np.frombuffer(bytes(r.planes), "<u8").reshape(1, r.width))[0].tolist() for r in first]


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector."""
    spark = rows.sparkSession
    rows = durable(packed(rows))
    centroids = starts(rows, k)
    for _ in range(rounds if centroids else 0):
        sums = rows.mapInArrow(_sums(centroids), SUMS).groupBy("cluster").agg(
            *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ["n", *(f"s{j}" for j in range(SIZE))]])
        for row in sums.collect():  # k rows at most
            centroids[row["cluster"]] = [int(row[f"s{j}"]) // int(row["n"]) for j in range(SIZE)]

    def run(batches):
        for batch in batches:
            for at, _, number, distance in _nearest(batch, centroids):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(number), pa.array(distance)],
                    ["vec_id", "cluster", "distance"])

    if not centroids:
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], empty)
    found = durable(rows.mapInArrow(run, "vec_id long, cluster int, distance long"))
    inertia = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()
    digest = {n: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for n, c in enumerate(centroids)}
    whole = sum(int(r.own) for r in inertia)
    fits = lambda x: x if x < 1 << 63 else None
    about = spark.createDataFrame(
        [(r.cluster, fits(int(r.own)), fits(whole), digest[r.cluster]) for r in inertia],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", *about.columns[1:])

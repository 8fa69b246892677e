"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Vectors are centred and projected on their main directions; a rotation learned by turns
(codes = signs, rotation = best fit of the vectors to the codes) makes the bits balanced.
Several rotations give codes of tables x bits; each stretch of bits is the key of one
Hamming table, so vectors whose codes differ in fewer bits than there are tables share a
bucket. Centring widens the angle of near pairs, the more the more of a direction all vectors
share. So partners at the threshold are made for vectors of the sample, and tables grow until
the share ``RECALL`` of these pairs meets in a bucket; bits are those of least cost, one at least,
so that any number of vectors goes through the tables. Buckets carry vectors rounded to 16 bits a component,
and what may reach the threshold within the rounding is a candidate; inside the components of the
candidates the original vectors are compared in double precision, in blocks, each once however many tables it is in.

The rotations are learned on at most about ``SAMPLE`` vectors (and ``SAMPLE_BYTES``), chosen by
a hash; every vector is indexed. Each dimension has rotations and tables of its own, as vectors
link with those of their dimension only. Equal vectors are one class with copies. Null vectors,
those with null or non-finite components, of length zero, or without an id link with nothing and
are kept. Rows of one id with different vectors belong to the class of their own vector.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm import links
from tidebar.session import durable

THRESHOLD = 0.95
RECALL = 0.999
SAMPLE = 20_000
SAMPLE_BYTES = 64 << 20
STEPS = 30
#: Weight of the rotation of the step before.
KEEP = 1e-6
#: Pairs made at the threshold.
PAIRS = 4_000
#: Cost of a key and of a vector dealt out, in comparisons; bits that need more tables aren't weighed.
KEY_COST = 300
ROW_COST = 500
MOST_TABLES = 1 << 16
#: A component of one in 16 bits.
STEP = 32767
#: Bits worked out at once.
CELLS = 1 << 22


def cleaned(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, key, dim, vec, short): unit vectors as bytes of doubles and of 16-bit integers.

    All but the id are null (``dim`` 0) where a vector can't link.
    """

    def run(batches):
        for batch in batches:
            keys, dims, out, short = [], [], [], []
            for v in batch.column(1):
                good = v.is_valid and len(v.values) and not v.values.null_count
                if good:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                    top = np.abs(x).max()
                    good = np.isfinite(x).all() and top > 0
                if not good:
                    keys.append(None), dims.append(0), out.append(None), short.append(None)
                    continue
                keys.append(xxhash.xxh3_128_digest(x.tobytes()))
                x = x / top
                dims.append(len(x))
                x = x / np.sqrt(x @ x)
                out.append(x.tobytes())
                short.append(np.rint(x * STEP).astype(np.int16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()),
                 pa.array(out, pa.binary()), pa.array(short, pa.binary())],
                names=["vec_id", "key", "dim", "vec", "short"])

    chosen = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    return chosen.mapInArrow(run, "vec_id long, key binary, dim int, vec binary, short binary")


def directions(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and main directions (dim, at most 64)."""
    mean = sample.mean(0)
    x = sample - mean
    _, _, found = np.linalg.svd(x.T @ x)
    return mean, found[: min(x.shape[1], 64)].T


def rotations(sample: np.ndarray, bits: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and a matrix (dim, bits) of learned rotations of the main directions."""
    mean, base = directions(sample)
    made, rng = [], np.random.RandomState(seed)
    width = base.shape[1]
    v = (sample - mean) @ base
    while width * len(made) < bits:
        r, _ = np.linalg.qr(rng.randn(width, width))
        for _ in range(STEPS):
            code = np.sign(v @ r)
            code[code == 0] = 1
            # Directions in which the sample does not spread stay as they were drawn.
            a, _, b = np.linalg.svd(code.T @ v + KEEP * len(v) * r.T)
            r = (a @ b).T
        made.append(base @ r)
    return mean, np.concatenate([base[:, :0], *made], 1)[:, :bits]


def partners(sample: np.ndarray, threshold: float, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs at the threshold: unit vectors moved in any direction, and in the sample's own ones."""
    rng = np.random.RandomState(seed)
    x = sample[rng.randint(len(sample), size=PAIRS)]
    other = sample[rng.randint(len(sample), size=PAIRS)] - sample[rng.randint(len(sample), size=PAIRS)]
    pairs = []
    for moved in (rng.randn(*x.shape), other):
        moved = moved - (moved * x).sum(1, keepdims=True) * x
        length = np.linalg.norm(moved, axis=1, keepdims=True)
        some = length[:, 0] > 1e-9
        if some.any():
            y = threshold * x[some] + math.sqrt(1 - threshold**2) * moved[some] / length[some]
            pairs.append((x[some], y))
    return pairs


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chance that a bit of two vectors is equal, by their angle."""
    size = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    cos = (a * b).sum(1) / np.where(size > 0, size, 1)
    return 1 - np.arccos(np.clip(cos, -1, 1)) / math.pi


def least_tables(same: list[np.ndarray], recall: float) -> int:
    """Tables until the share ``recall`` of each list of pairs meets, by the chance to meet in one."""
    low, high = 0, 1
    while any((1 - (1 - p) ** high).mean() < recall for p in same):
        low, high = high, 2 * high
        if high > MOST_TABLES:
            return high
    while high - low > 1:
        mid = (low + high) // 2
        enough = all((1 - (1 - p) ** mid).mean() >= recall for p in same)
        low, high = (low, mid) if enough else (mid, high)
    return high


def shape(sample: np.ndarray, n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a table and number of tables for ``n`` vectors like those of the sample."""
    mean, base = directions(sample)
    near = [alike((x - mean) @ base, (y - mean) @ base) for x, y in partners(sample, threshold)]
    rng = np.random.RandomState(3)
    v = (sample - mean) @ base
    one = rng.randint(len(v), size=PAIRS)
    far = alike(v[one], v[(one + 1 + rng.randint(max(1, len(v) - 1), size=PAIRS)) % len(v)])
    best = None
    for bits in range(1, 61):
        tables = least_tables([p**bits for p in near], recall)
        others = n * (far**bits).mean()
        dealt = -math.expm1(-others) * math.ceil(others / links.BLOCK)
        cost = tables * (KEY_COST + ROW_COST * dealt + others)
        if best is None or cost < best[0]:
            best = cost, bits, tables
        if tables > MOST_TABLES:
            break
    return best[1], best[2]


def learned(sample: np.ndarray, n: int, threshold: float, recall: float = RECALL):
    """Mean, matrix, bits and tables that find the share ``recall`` of pairs at the threshold."""
    bits, tables = shape(sample, n, threshold, recall)
    while True:
        mean, matrix = rotations(sample, bits * tables)
        found = (met(x, y, mean, matrix, bits, tables) for x, y in partners(sample, threshold, 6))
        if tables >= MOST_TABLES or all(share >= recall for share in found):
            return mean, matrix, bits, tables
        tables += math.ceil(tables / 4)


def met(x: np.ndarray, y: np.ndarray, mean: np.ndarray, matrix: np.ndarray, bits: int, tables: int) -> float:
    """Share of the pairs whose codes agree in a table."""
    found = np.zeros(len(x), bool)
    for t in range(tables):
        part = matrix[:, t * bits : (t + 1) * bits]
        found |= (((x - mean) @ part > 0) == ((y - mean) @ part > 0)).all(1)
    return found.mean()


def keys(table: pa.Table) -> np.ndarray:
    raw = b"".join(table.column("vec").to_pylist())
    return np.frombuffer(raw, np.float64).reshape(table.num_rows, -1)


def cosine(threshold: float):
    def near(table: pa.Table) -> np.ndarray:
        x = keys(table)
        match = x @ x.T >= threshold
        np.fill_diagonal(match, False)
        return match

    return near


def roughly(threshold: float):
    """Pairs of rounded vectors whose originals may have the cosine ``threshold``.

    Rounding moves a vector by half a step in each component at most, single precision
    a product by a few units of its last place per component.
    """

    def near(table: pa.Table) -> np.ndarray:
        raw = b"".join(table.column("short").to_pylist())
        x = np.frombuffer(raw, np.int16).reshape(table.num_rows, -1).astype(np.float32) / STEP
        moved = math.sqrt(x.shape[1]) / (2 * STEP)
        slack = moved * (2 + moved) + x.shape[1] * 2.0**-22
        match = x @ x.T >= threshold - slack
        np.fill_diagonal(match, False)
        return match

    return near


def coded(rows: pa.RecordBatch, dim: int, mean, matrix, bits: int, tables: int):
    """Batches (id, dim, t, code) of vectors of one dimension."""
    step = max(1, CELLS // (tables * bits))
    weights = 1 << np.arange(bits, dtype=np.int64)
    for at in range(0, rows.num_rows, step):
        part = rows.slice(at, step)
        n = part.num_rows
        x = np.frombuffer(b"".join(part.column(2).to_pylist()), np.float64).reshape(n, dim)
        codes = ((x - mean) @ matrix > 0).reshape(n, tables, bits) @ weights
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(part.column(0).to_numpy(), tables)),
             pa.array(np.full(n * tables, dim, np.int32)),
             pa.array(np.tile(np.arange(tables, dtype=np.int32), n)),
             pa.array(codes.ravel())], names=["id", "dim", "t", "code"])


def bucketed(classes: DataFrame, indexes: dict[int, tuple]) -> DataFrame:
    """(path, id) for each vector and table of its dimension."""
    shared = classes.sparkSession.sparkContext.broadcast(indexes)

    def run(batches):
        indexes = shared.value
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                yield from coded(batch.filter(pa.array(dims == dim)), dim, *indexes[dim])

    rows = classes.select("id", "dim", "vec").mapInArrow(run, "id long, dim int, t int, code long")
    return rows.select(F.xxhash64("dim", "t", "code").alias("path"), "id")


def index(classes: DataFrame, dim: int, n: int, threshold: float, sample: int) -> tuple:
    """What is learned for the ``n`` vectors of a dimension."""
    most = max(1, min(sample, SAMPLE_BYTES // (8 * dim)))
    share = F.lit(int(min(1.0, most / n) * (1 << 32)))
    of = classes.filter(F.col("dim") == dim)
    picked = of.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 32)) < share).select("vec").collect()
    if not picked:
        picked = of.select("vec").limit(1).collect()
    x = np.frombuffer(b"".join(sorted(bytes(r[0]) for r in picked)), np.float64).reshape(len(picked), dim)
    return learned(x, n, threshold)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id",
                    vec_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """Per row: vec_id, n_links, component_id."""
    rows = durable(cleaned(vectors, id_col, vec_col))
    good = rows.filter("vec_id IS NOT NULL AND key IS NOT NULL")
    classes = durable(good.groupBy("key").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("dim").alias("dim"),
        F.first("vec").alias("vec"), F.first("short").alias("short")).select(F.monotonically_increasing_id().alias("id"), "*"))
    plain = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key"))
    sizes = classes.groupBy("dim").count().collect()
    indexes = {dim: index(classes, dim, n, threshold, sample) for dim, n in sizes}
    buckets = links.shared(bucketed(classes, indexes))
    dealt = links.blocks(buckets).join(classes.select("id", "short"), "id").select("path", "id", "short")
    groups = links.components(links.near_forests(dealt, roughly(threshold)))
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"))
    members = groups.join(sizes, "component").join(classes.select("id", "copies", "vec"), "id")
    exact = durable(links.exact_links(links.blocks(members, path="component"), cosine(threshold)))
    counts = exact.groupBy("id").agg(F.sum("links").alias("links"))
    edges = exact.filter("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))
    parts = links.named(links.components(edges), classes)
    done = classes.select("key", "id", "least", "copies").join(counts, "id", "left").join(parts, "id", "left")
    done = durable(done.select(
        "key", F.coalesce("name", "least").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    return plain.join(done, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))

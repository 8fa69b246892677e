"""Hard negatives by exact integer products.

Components x become floor(256 * x), x as double. Anchors and candidates meet in cells: a
group of at most ``GROUP`` anchors and a part of the candidates, streamed through the cell's
task in tiles. Strassen's recursion multiplies a tile, padded with zeros, in 64-bit integers.
Two passes: the first keeps the best same-label rows of each anchor, the second the best
different-label rows in each positive's window of scores. What a cell keeps are heaps of a few entries
per anchor, and heaps of several cells merge into one.

Rows with a null id, null label, null or empty vector, or a null or non-finite component take
no part. Shorter vectors are padded with zeros. Components that floor to more than ``limit``
(2**28 at 64 components) count as the limit, so that no score leaves 64 bits. Equal scores of
one id count once, and rows of an anchor's own id are neither its positives nor its negatives.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.session import durable

GROUP = 16_384
PART = 1 << 20
TILE = 2048
LEAF = 32

POSITIVES = 5
NEGATIVES = 10


def multiply(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` for integers by Strassen's seven products, down to sides of ``leaf``."""
    m, d, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, d, n) <= leaf:
        return a @ b
    odd = (m % 2, d % 2, n % 2)
    if any(odd):
        a = np.pad(a, ((0, odd[0]), (0, odd[1])))
        b = np.pad(b, ((0, odd[1]), (0, odd[2])))
    i, k, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :k], a[:i, k:], a[i:, :k], a[i:, k:]
    b11, b12, b21, b22 = b[:k, :j], b[:k, j:], b[k:, :j], b[k:, j:]
    p1 = multiply(a11 + a22, b11 + b22, leaf)
    p2 = multiply(a21 + a22, b11, leaf)
    p3 = multiply(a11, b12 - b22, leaf)
    p4 = multiply(a22, b21 - b11, leaf)
    p5 = multiply(a11 + a12, b22, leaf)
    p6 = multiply(a21 - a11, b11 + b12, leaf)
    p7 = multiply(a12 - a22, b21 + b22, leaf)
    c = np.empty((2 * i, 2 * j), np.int64)
    c[:i, :j] = p1 + p4 - p5 + p7
    c[:i, j:] = p3 + p5
    c[i:, :j] = p2 + p4
    c[i:, j:] = p1 - p2 + p3 + p6
    return c[:m, :n]


def limit(width: int) -> int:
    """The largest component whose products add up to less than 2**62 over ``width`` of them."""
    return math.isqrt((1 << 62) // max(width, 1))


def quantised(vectors: pa.ListArray, width: int) -> np.ndarray:
    """floor(256 * x) as 64-bit integers, one row of ``width`` per vector."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    most = float(limit(width))
    flat = np.clip(np.floor(256.0 * flat), -most, most).astype(np.int64)
    if len(flat) == len(sizes) * width:
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


class Heaps:
    """The ``k`` best distinct (score, id) in each of several heaps, higher scores first, then lower ids."""

    def __init__(self, heaps: int, k: int) -> None:
        self.k = k
        self.scores = [np.empty(0, np.int64)] * heaps
        self.ids = [np.empty(0, np.int64)] * heaps
        self.least = np.full(heaps, np.iinfo(np.int64).min)  # what a score must reach to get in

    def push(self, mask: np.ndarray, scores: np.ndarray, ids: np.ndarray, heaps: np.ndarray) -> None:
        """Push the marked scores of a matrix; ``heaps`` names the heap of each of its lines."""
        mask &= scores >= self.least[heaps][:, None]
        for line in np.flatnonzero(mask.any(1)).tolist():
            at, heap = np.flatnonzero(mask[line]), heaps[line]
            both = np.concatenate([self.scores[heap], scores[line, at]])
            named = np.concatenate([self.ids[heap], ids[at]])
            order = np.lexsort((named, -both))
            both, named = both[order], named[order]
            fresh = np.ones(len(both), bool)
            fresh[1:] = (both[1:] != both[:-1]) | (named[1:] != named[:-1])
            self.scores[heap], self.ids[heap] = both[fresh][: self.k], named[fresh][: self.k]
            if len(self.ids[heap]) == self.k:
                self.least[heap] = self.scores[heap][-1]


def eligible(rows: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    known = F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    return rows.select("vec_id", "label", "embedding").filter(known & (F.size("embedding") > 0) & whole)


def _windows(scores: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of a negative for each positive: 30 p <= 100 n <= 90 p, exactly."""
    low = np.ones((len(scores), POSITIVES), np.int64)
    high = np.zeros((len(scores), POSITIVES), np.int64)
    for row, found in enumerate(scores):
        for place, p in enumerate(found):
            low[row, place], high[row, place] = -(-3 * p // 10), 9 * p // 10
    return low, high


class _Cell:
    """The anchors of one cell and what the candidates leave in their heaps."""

    def __init__(self, rows: list[pa.RecordBatch], width: int, first: bool) -> None:
        table = pa.Table.from_batches(rows).combine_chunks()
        self.width, self.places = width, 1 if first else POSITIVES
        self.vectors = quantised(table.column("embedding").chunk(0), width)
        self.ids, self.labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
        self.names = table.column("anchor").to_numpy()
        self.bounds = None if first else _windows(table.column("scores").to_pylist())
        self.heaps = Heaps(len(self.ids) * self.places, POSITIVES if first else NEGATIVES)

    def meet(self, rows: pa.RecordBatch) -> None:
        vectors = quantised(rows.column(4), self.width).T.copy()
        ids, labels = rows.column(2).to_numpy(), rows.column(3).to_numpy()
        for start in range(0, len(self.ids), TILE):
            part = slice(start, start + TILE)
            scores = multiply(self.vectors[part], vectors)
            other = self.ids[part, None] != ids[None, :]
            same = self.labels[part, None] == labels[None, :]
            heaps = np.arange(start, start + len(scores)) * self.places
            if self.bounds is None:
                self.heaps.push(same & other, scores, ids, heaps)
                continue
            other &= ~same
            for place in range(self.places):
                low, high = (b[part, place, None] for b in self.bounds)
                self.heaps.push(other & (low <= scores) & (scores <= high), scores, ids, heaps + place)

    def result(self) -> pa.RecordBatch:
        sizes = [len(ids) for ids in self.heaps.ids]
        heap = np.repeat(np.arange(len(sizes)), sizes)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.names[heap // self.places]), pa.array((heap % self.places).astype(np.int32)),
             pa.array(np.concatenate(self.heaps.scores)), pa.array(np.concatenate(self.heaps.ids))],
            ["anchor", "place", "score", "vec_id"])


def _best(rows: DataFrame, anchors: DataFrame, shape: tuple[int, int, int], first: bool) -> DataFrame:
    """One pass: (anchor, place, rank, score, vec_id), the heaps of all cells merged."""
    width, groups, parts = shape
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int")
    columns = ["role", "vec_id", "label", "embedding", "anchor", "scores"]
    left = anchors.select(F.lit(0).alias("role"), "*").withColumn("__part", each(parts))
    right = rows.select(
        F.lit(1).alias("role"), "*", F.lit(None).cast("long").alias("anchor"),
        F.lit(None).cast("array<long>").alias("scores"), spread.alias("__part")).withColumn("__group", each(groups))
    cell = (F.col("__group") * parts + F.col("__part")).alias("cell")
    dealt = left.select(cell, *columns).unionByName(right.select(cell, *columns))

    def run(batches):
        cell, held, now = None, [], None
        for batch in batches:
            cells, roles = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells * 2 + roles)) + 1).tolist(), len(cells)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                if cells[low] != cell:
                    if now:
                        yield now.result()
                    cell, held, now = cells[low], [], None
                if roles[low] == 0:
                    held.append(batch.slice(low, high - low))
                    continue
                if held and now is None:
                    now, held = _Cell(held, width, first), []
                for at in range(low, high, TILE) if now else ():
                    now.meet(batch.slice(at, min(TILE, high - at)))
        if now:
            yield now.result()

    found = dealt.repartitionById(groups * parts, F.col("cell")).sortWithinPartitions("cell", "role").mapInArrow(
        run, "anchor long, place int, score long, vec_id long")
    # A cell leaves at most k entries for each heap, so a group is bounded by the parts.
    entry = F.struct((-F.col("score")).alias("less"), "vec_id")
    heap = F.slice(F.sort_array(F.collect_set(entry)), 1, POSITIVES if first else NEGATIVES)
    merged = found.groupBy("anchor", "place").agg(heap.alias("heap"))
    return merged.select("anchor", "place", F.posexplode("heap").alias("rank", "e")).select(
        "anchor", "place", "rank", (-F.col("e.less")).alias("score"), F.col("e.vec_id").alias("vec_id"))


def hard_negatives(rows: DataFrame, every: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` are (vec_id, label, embedding); anchors are those whose id ``every`` divides.
    """
    spark = rows.sparkSession
    rows = eligible(rows)
    count, width = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    chosen = rows.filter(F.col("vec_id") % every == 0).dropDuplicates()
    chosen = durable(chosen.withColumn("anchor", F.monotonically_increasing_id()))
    groups = max(1, math.ceil(chosen.count() / GROUP))
    parts = max(math.ceil(2 * spark.sparkContext.defaultParallelism / groups), math.ceil(count / PART))
    shape = (width or 1, groups, parts)
    dealt = chosen.withColumn("__group", F.pmod(F.xxhash64("anchor"), F.lit(groups)).cast("int"))
    positives = durable(_best(
        rows, dealt.withColumn("scores", F.lit(None).cast("array<long>")), shape, first=True))
    scores = positives.groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct("rank", "score"))).getField("score").alias("scores"))
    negatives = _best(rows, dealt.join(scores, "anchor"), shape, first=False)
    pairs = positives.select(
        "anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score")).join(
        chosen.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return negatives.join(pairs, ["anchor", "place"]).select(
        "anchor_id", "positive_id", (F.col("rank") + 1).alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))

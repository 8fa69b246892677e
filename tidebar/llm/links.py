"""Links between near-equal things: shared buckets, spanning forests, components, exact counts.

Buckets (path, id) hold things that may be near. From each bucket only a spanning forest of
its near pairs is kept, so a bucket of n things yields n - 1 rows at most. Components of all
forests hold every pair that any bucket has found near; inside a component all pairs are
then compared once more, in blocks of bounded size, which counts the links of each thing and
again yields forests. No step writes all pairs of a group, and none gathers one whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.hot import lookup
from tidebar.session import durable

#: Rows of one block.
BLOCK = 256

#: Near pairs of the rows of a table, as a square matrix of booleans.
Near = Callable[[pa.Table], np.ndarray]


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of the rows with equal first columns, from rows sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.diff(keys, prepend=keys[0])).tolist()
        for low, high in zip([0, *starts], [*starts, len(keys)]):
            if low == high:
                continue
            if held and keys[low] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = keys[low]
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric matrix."""
    n = len(near)
    fresh = np.ones(n, bool)
    edges = []
    for root in np.flatnonzero(near.any(1)).tolist():
        if not fresh[root]:
            continue
        fresh[root] = False
        todo = [root]
        while todo:
            u = todo.pop()
            found = np.flatnonzero(near[u] & fresh).tolist()
            fresh[found] = False
            edges += [(u, v) for v in found]
            todo += found
    return edges


def column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def shared(rows: DataFrame) -> DataFrame:
    """Buckets (path, id, n, low) with two things at least; of equal buckets one stays.

    ``n`` is the size of a bucket and ``low`` its least id.
    """
    rows = durable(rows)
    things = rows.groupBy("path").agg(
        F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"),
        F.bit_xor(F.xxhash64("id")).alias("mix"))
    one = things.filter("n > 1").groupBy("n", "low", "high", "mix").agg(F.min("path").alias("path"))
    table = durable(one.select("path", "n", "low", F.col("n").alias("__size")))
    return durable(lookup(rows, table, "path", rows.count(), "__size"))


def near_forests(rows: DataFrame, near: Near) -> DataFrame:
    """Edges (a, b) of the near pairs in each bucket; rows are (path, id, payload...)."""

    def run(batches):
        for table in grouped(batches):
            ids = column(table, "id")
            edges = forest(near(table))
            if edges:
                a, b = np.array(edges).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    return rows.repartition("path").sortWithinPartitions("path").mapInArrow(run, "a long, b long")


def blocks(rows: DataFrame, size: str = "n", block: int = BLOCK, path: str = "path") -> DataFrame:
    """The rows of each group, dealt to tasks that hold two of its blocks.

    ``size`` counts the rows of a group. A row of a group of k blocks goes to k tasks; the
    column ``part`` is its block, ``low`` and ``high`` are the two blocks of the task.
    """
    k = F.ceil(F.col(size) / block).cast("int")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", F.lit(11)), k).cast("int"))
    rows = rows.withColumn("__other", F.explode(F.sequence(F.lit(0), k - 1)))
    rows = rows.withColumns({"low": F.least("part", "__other"), "high": F.greatest("part", "__other")})
    task = F.xxhash64(path, "low", "high")
    others = [c for c in rows.columns if c not in ("__other", path)]
    return rows.select(task.alias("path"), *others)


def exact_links(rows: DataFrame, near: Near) -> DataFrame:
    """Per task of ``blocks``: (id, links, other); links count copies, ``other`` makes edges.

    Rows are (path, id, copies, part, low, high, payload...).
    """

    def run(batches):
        for table in grouped(batches):
            ids, first = np.unique(column(table, "id"), return_index=True)
            table = table.take(pa.array(first))
            match = near(table)
            if column(table, "low")[0] != column(table, "high")[0]:
                part = column(table, "part")
                match &= part[:, None] != part[None, :]
            np.fill_diagonal(match, False)
            links = match @ column(table, "copies")
            edges = forest(match)
            some = np.flatnonzero(links)
            a = [int(ids[i]) for i in some] + [int(ids[u]) for u, _ in edges]
            n = [int(links[i]) for i in some] + [0] * len(edges)
            b = [None] * len(some) + [int(ids[v]) for _, v in edges]
            if a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(b, pa.int64())],
                    ["id", "links", "other"])

    return (rows.repartition("path").sortWithinPartitions("path")
            .mapInArrow(run, "id long, links long, other long"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): each id of ``edges`` (a, b) with the least id that it reaches.

    Rounds of a large star (what a node has above itself is hung on its least neighbour) and
    a small star (what it has below itself) until no edge changes; each keeps at most as many
    edges as it got.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = durable(now.distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = durable(large.filter("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        hung = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
        now = durable(hung.filter("a <> b").distinct())
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    tops = now.select(F.col("b").alias("id")).distinct()
    found = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return durable(found.unionByName(tops.select("id", F.col("id").alias("component"))))


def named(parts: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, name): the least ``least`` in each component of ``parts``; ``classes`` are (id, least, ...)."""
    names = parts.join(classes.select("id", "least"), "id").groupBy("component").agg(F.min("least").alias("name"))
    return parts.join(names, "component").select("id", "name")

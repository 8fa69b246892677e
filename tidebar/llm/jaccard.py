"""N-gram Jaccard join by chosen paths.

A document is the set of its windows of ``SHINGLE`` words (runs between ASCII white space, as
they are written); fewer words make one shingle, no word makes none. Documents with equal sets are one class.

Each set has ``TOKENS`` minhash tokens. A run starts with all sets in one bucket and splits
it by the tokens at one or (with probability 1 / threshold - 1) two sampled positions, so
that two sets of that similarity are together in one part on average. Small parts are
compared at once, as are large ones of near-equal sets, in blocks; others are split again, at
positions chosen by their path, up to ``DEPTH`` times. ``runs`` runs find a pair at the threshold
with probability ``RECALL``, less similar ones are rejected later: candidates by their tokens
(with four standard deviations of slack) become groups, in which all pairs are compared by
their whole sets.

Null ids, null texts and texts without words link with nothing and stay. What is compared are
sets, not ids: rows of one id with different texts belong to the class of their own text.
Copies count as links of each other. Texts of any length are taken whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm import links
from tidebar.llm.hot import lookup, maybe_in
from tidebar.llm.text import Cache, grams, hash64, words
from tidebar.session import durable

SHINGLE = 5
THRESHOLD = 0.8
TOKENS = 64
SMALL = 128
DEPTH = 6
#: Part of a large bucket that is alike one member, from which on it isn't split.
DENSE = 0.25
RECALL = 0.9999

_rng = np.random.RandomState(7)
_FACTORS = (_rng.randint(0, 1 << 31, TOKENS).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFTS = _rng.randint(0, 1 << 31, TOKENS).astype(np.uint32)

_cache = Cache(hash64, most=200_000)


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the windows of ``n`` words."""
    found = words(text or "")
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.array(list(map(_cache.__getitem__, found)), np.uint64)
    if len(hashes) < n:
        return grams(hashes, len(hashes)) ^ np.uint64(len(hashes))
    return np.unique(grams(hashes, n))


def tokens(hashes: np.ndarray) -> np.ndarray:
    """The least value of a set under each of ``TOKENS`` permutations."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 2048):
        part = short[at : at + 2048]
        value = part[None, :] * _FACTORS[:, None] + _SHIFTS[:, None]
        value ^= value >> np.uint32(15)
        value *= np.uint32(0x2C1B3C6D)
        np.minimum(least, value.min(1), out=least)
    return least


def runs_for(threshold: float, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold was together in a last bucket."""
    two = 1 / threshold - 1
    p = 1.0
    for _ in range(depth):
        p = 1 - ((1 - two) * (1 - threshold * p) + two * (1 - threshold * p) ** 2)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key of the set or null, tokens, digest of the text) for each row."""

    def run(batches):
        for batch in batches:
            keys, signs = [], []
            for text in batch.column(1):
                found = shingles(text.as_py())
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                signs.append(tokens(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(signs, pa.binary()), batch.column(2)],
                names=["doc_id", "key", "sign", "digest"])

    text = F.col(text_col)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("digest"))
    return chosen.mapInArrow(run, "doc_id long, key binary, sign binary, digest binary")


def split(rows: DataFrame, threshold: float) -> DataFrame:
    """One level: (path, id, sign) to the paths that its buckets choose."""
    two = int((1 / threshold - 1) * 1000)
    count = F.when(F.pmod(F.xxhash64("path", F.lit(1)), F.lit(1000)) < two, 1).otherwise(0)
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), count)))
    place = F.pmod(F.xxhash64("path", F.lit(2), "k"), F.lit(TOKENS)).cast("int")
    token = F.substring(F.col("sign"), place * 4 + 1, F.lit(4))
    return rows.select(F.xxhash64("path", "k", place, token).alias("path"), "id")


def alike(slack: float):
    """Near by tokens: at least ``slack`` of them agree."""

    def near(table: pa.Table) -> np.ndarray:
        signs = np.frombuffer(b"".join(table.column("sign").to_pylist()), np.uint32)
        signs = signs.reshape(-1, TOKENS)
        n = len(signs)
        match = np.zeros((n, n), np.uint8)
        for t in range(TOKENS):
            match += signs[:, t, None] == signs[None, :, t]
        near = match >= slack * TOKENS
        np.fill_diagonal(near, False)
        return near

    return near


def overlapping(threshold: float):
    """Near by whole sets."""

    def near(table: pa.Table) -> np.ndarray:
        sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        several = often > 1
        rank = np.cumsum(several) - 1
        keep = several[place]
        owner, place = owner[keep], rank[place[keep]]
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        common = np.zeros((len(sets), len(sets)), np.float32)
        width = 4096
        for at in range(0, int(several.sum()), width):
            low, high = np.searchsorted(place, [at, at + width])
            matrix = np.zeros((len(sets), width), np.float32)
            matrix[owner[low:high], place[low:high] - at] = 1
            common += matrix @ matrix.T
        union = sizes[:, None] + sizes[None, :] - common.astype(np.float64)
        near = common >= threshold * union * (1 - 1e-12)
        np.fill_diagonal(near, False)
        return near

    return near


def dense(rows: DataFrame, slack: float) -> DataFrame:
    """``rows`` of large buckets with the ``share`` of each that is alike its member of least id.

    Splitting does not take such members apart, so a bucket with a good part of them is
    compared as it is.
    """
    total = rows.count()
    sizes = F.col("n").alias("__size")
    pivots = durable(rows.filter("id = low").select("path", F.col("sign").alias("pivot"), sizes))
    token = lambda c, i: F.substring(c, i * 4 + 1, F.lit(4))
    agree = F.size(F.filter(F.sequence(F.lit(0), F.lit(TOKENS - 1)),
                            lambda i: token(F.col("sign"), i) == token(F.col("pivot"), i)))
    share = F.avg((agree >= slack * TOKENS).cast("double"))
    near = lookup(rows, pivots, "path", total, "__size").groupBy("path").agg(
        share.alias("share"), F.max("n").alias("__size"))
    return lookup(rows, durable(near), "path", total, "__size")


def candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, component) of sets that may be near; ``sets`` are (id, sign)."""
    slack = threshold - 4 * math.sqrt(threshold * (1 - threshold) / TOKENS)
    near = alike(slack)

    def compared(rows: DataFrame, block: int = 8 * SMALL) -> DataFrame:
        dealt = links.blocks(rows, block=block).select("path", "id", "sign")
        return links.near_forests(dealt, near)

    runs = F.explode(F.sequence(F.lit(0), F.lit(runs_for(threshold) - 1)))
    rows = sets.select(runs.alias("path"), "id", "sign")
    edges = None
    for depth in range(DEPTH):
        buckets = links.shared(split(rows.withColumn("path", F.xxhash64("path", F.lit(depth))), threshold))
        small = buckets.filter(F.col("n") <= SMALL)
        part = links.near_forests(small.select("path", "id").join(sets, "id").select("path", "id", "sign"), near)
        edges = part if edges is None else edges.unionByName(part)
        large = buckets.filter(F.col("n") > SMALL)
        if large.isEmpty():
            return links.components(edges)
        rows = durable(large.join(sets, "id").select("path", "id", "n", "low", "sign"))
        rows = durable(dense(rows, slack))
        edges = edges.unionByName(compared(rows.filter(F.col("share") >= DENSE)))
        rows = rows.filter(F.col("share") < DENSE)
    return links.components(edges.unionByName(compared(rows)))


def join(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, class_id (least id reachable by links), n_links."""
    return _joined(docs, threshold, id_col, text_col).drop("digest")


def _joined(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    signs = durable(signed(docs, id_col, text_col))
    known = signs.filter("doc_id IS NOT NULL AND key IS NOT NULL")
    classes = durable(known.groupBy("key").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("sign").alias("sign")).select(
        F.monotonically_increasing_id().alias("id"), "*"))
    groups = candidates(classes.select("id", "sign"), threshold)
    groups = groups.join(classes.select("id", "key", "least", "copies"), "id")
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"))
    members = durable(groups.join(sizes, "component"))

    def run(batches):
        for batch in batches:
            found = [shingles(t.as_py()).tobytes() for t in batch.column(4)]
            own = [xxhash.xxh3_128_digest(x) == k.as_py() for x, k in zip(found, batch.column(5))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(found, pa.binary())],
                names=["component", "id", "copies", "n", "hashes"]).filter(pa.array(own, pa.bool_()))

    # Only texts of members are shuffled, and few others that the bitmaps cannot tell from them.
    texts = docs.select(F.col(id_col).cast("long").alias("least"), F.col(text_col).alias("text"))
    texts = maybe_in(texts, F.col("least"), members, F.col("least")).filter("hit").drop("hit")
    whole = members.join(texts, "least").select("component", "id", "copies", "n", "text", "key").mapInArrow(
        run, "component long, id long, copies long, n long, hashes binary")
    dealt = links.blocks(whole, path="component").filter(F.length("hashes") > 0)
    found = durable(links.exact_links(dealt, overlapping(threshold)))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    edges = found.filter("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))
    parts = links.named(links.components(edges), classes)
    done = classes.select("key", "id", "least", "copies").join(counts, "id", "left").join(parts, "id", "left")
    done = durable(done.select(
        "key", F.coalesce("name", "least").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    return signs.select("doc_id", "digest", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(
        done, "key", "left").select(
        "doc_id", "digest", F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def distinct(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with the least id of each class, with their own columns, and those without an id.

    Of rows with one id and one text, one stays. Texts that stay are not shuffled: rows that are
    dropped or repeated are found by id and digest, and only what bitmaps of these hit is joined with them.
    """
    kept = F.col("doc_id") == F.col("class_id")
    found = _joined(docs, threshold, "doc_id", "text").filter("doc_id IS NOT NULL")
    special = durable(found.groupBy("doc_id", "digest").agg(
        F.count("*").alias("__n"), F.bool_and(kept).alias("__kept")).filter("__n > 1 OR NOT __kept"))
    # Whole rows travel as one column, whatever their columns are called.
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"),
                       F.unhex(F.md5("text")).alias("digest"))
    named = maybe_in(rows.filter("id IS NOT NULL"), F.struct("id", "digest"), special, F.struct("doc_id", "digest"))
    special = special.select(F.col("doc_id").alias("same_id"), F.col("digest").alias("same"), "__kept", "__n")
    same = F.col("digest").eqNullSafe(F.col("same")) & (F.col("id") == F.col("same_id"))
    checked = named.filter("hit").join(special, same, "left").filter("coalesce(__kept, true)")
    again = checked.filter("__n > 1").dropDuplicates(["id", "digest"])
    parts = [named.filter("NOT hit"), checked.filter("__n IS NULL OR __n = 1"), again, rows.filter("id IS NULL")]
    out = parts[0].select("row")
    for part in parts[1:]:
        out = out.unionByName(part.select("row"))
    return out.select("row.*")

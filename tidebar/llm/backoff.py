"""Language-model scores by stupid backoff, from n-gram counts of the whole corpus.

For word i of a document, with n the longest order whose n-gram was counted often enough:

    score = alpha ** (order - n) * count(n-gram) / count(its first n - 1 words)

and count / number of words for single words. N-grams above one word count from
``MIN_COUNT`` on, so that a document is not scored by its own rare phrases alone. The score of a
document is the sum of the logarithms.

The count table is partitioned by the 64-bit hash of the n-gram. All that depends on the n-gram
alone is worked out in that table: with s(g) the logarithm of the score that g gives where it is
the longest known, g adds

    gain(g) = s(g) - s(g without its first word)

to what the shorter n-gram at the same word has given (s(g) itself for a single word). As the
shorter n-grams of a known one are known too, the score of a document is the sum of the gains of
its known n-grams: its n-grams are exploded, joined to the gains by hash, and summed.

Hashes are random numbers that no codec makes smaller, and a text holds more n-grams than its file
has bytes. So n-grams are counted, and later joined, in passes, each over the n-grams whose hash falls
to it, and what a pass has shuffled is removed before the next. Each pass reads and hashes all
texts again, which takes less than to keep the hashes. An n-gram comes with the hash of its
first n - 1 words (head), from which and its own that of the last n - 1 (tail) follows. The
table of gains holds the counts that a gain is made of, which are small.

N-grams with more than one in ``HOT`` of all occurrences are fewer than ``HOT`` for each order,
so their gains are broadcast and added up before the shuffle. No other key has more rows than that.

Null and empty texts have no words and score 0 (mean null). Texts count whole. Repeated rows
count and are scored as often as they come; rows equal in id and text are told apart from others by
a hash and share their score. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm import hot
from tidebar.llm.text import mixed, unmixed, word_hashes
from tidebar.session import discard, durable, releasing

ORDER = 3
ALPHA = 0.4
MIN_COUNT = 2
#: Bytes of the texts whose n-grams are made at once; a longer text is taken by itself.
STRETCH = 1 << 21
#: At most so many n-grams of each order are broadcast.
HOT = 100_000
#: Passes in which the n-grams of one order are counted, and those of all orders joined.
COUNTING, JOINING = 2, 3
#: About so many keys fall into a bucket, which one task holds, unless there are fewer buckets than this.
BUCKET, LEAST_BUCKETS = 1 << 21, 32

_STEP = np.uint64(0xD6E8FEB86659FD93)


def turn(keys: np.ndarray, passes: int) -> np.ndarray:
    """The pass of each key."""
    return ((keys >> np.uint64(32)) * np.uint64(passes)) >> np.uint64(32)


def in_turn(key: str, at: int, passes: int) -> Column:
    return F.shiftrightunsigned(F.shiftrightunsigned(key, 32) * passes, 32) == at


def bucket_number(keys: int) -> int:
    """Buckets for so many keys."""
    return max(LEAST_BUCKETS, keys // BUCKET + 1)


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts ``keys`` by bucket and otherwise leaves them, the buckets that occur and where each begins."""
    of = ((keys & np.uint64(0xFFFFFFFF)) * np.uint64(buckets)) >> np.uint64(32)
    of = of.astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    order = np.argsort(of, kind="stable")
    of = of[order]
    begins = np.flatnonzero(np.diff(of, prepend=of[:1] + 1)) if len(of) else np.empty(0, np.int64)
    return order, of[begins], begins


def matches(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``keys`` are in the sorted ``table``, and where; most others are told apart by a table of flags."""
    if not len(table):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    mask = np.uint64((1 << min(22, (8 * len(table)).bit_length())) - 1)
    flags = np.zeros(int(mask) + 1, bool)
    flags[(table >> np.uint64(32)) & mask] = True
    maybe = np.flatnonzero(flags[(keys >> np.uint64(32)) & mask])
    places = np.minimum(np.searchsorted(table, keys[maybe]), len(table) - 1)
    same = table[places] == keys[maybe]
    return maybe[same], places[same]


def packed(buckets: np.ndarray, **columns) -> pa.RecordBatch:
    """A row for each bucket. columns: (values, where those of each bucket begin)."""
    arrays = [pa.array(buckets.astype(np.int64))]
    for values, begins in columns.values():
        ends = np.append(begins[1:], len(values))
        arrays.append(pa.array([values[i:j].tobytes() for i, j in zip(begins, ends)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", *columns])


def unpacked(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def stretches(batches):
    """(rows, hashed words of their texts, number of words of each), of ``STRETCH`` bytes at most or one text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + STRETCH, "right")))
            rows = batch.slice(at, to - at)
            yield rows, *word_hashes(rows.column("text"))
            at = to


def levels(hashes: np.ndarray, sizes: np.ndarray, order: int):
    """(n, keys, heads, text of each, which of them lie in one text) of the n-grams, n = 1 to ``order``."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    keys, heads = hashes, np.zeros(len(hashes), np.uint64)
    for n in range(1, order + 1):
        if n > 1:
            keys, heads = mixed(keys[:-1] * _STEP + keys[1:]), keys[:-1]
        yield n, keys, heads, of[n - 1 :], of[n - 1 :] == of[: len(keys)]


def summed(keys: np.ndarray, heads: np.ndarray, times: np.ndarray | None = None) -> tuple:
    """(keys, heads, times) of different keys, sorted; ``times`` are added up, or each row counts once."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(np.ones(len(keys[:1]), bool), keys[1:] != keys[:-1]))
    if times is None:
        times = np.diff(first, append=len(keys))
    elif len(first):
        times = np.add.reduceat(times[order], first)
    return keys[first], heads[order[first]], times


def counted(docs: DataFrame, n: int, min_count: int, at: int, passes: int, buckets: int) -> DataFrame:
    """(key, times, head, tail) of the known n-grams of ``n`` words that fall to a pass."""

    def run(batches):
        for _, hashes, sizes in stretches(batches):
            *_, (_, keys, heads, _, whole) = levels(hashes, sizes, n)
            mine = whole & (turn(keys, passes) == at)
            keys, heads, times = summed(keys[mine], heads[mine])
            order, of, begins = by_bucket(keys, buckets)
            yield packed(of, keys=(keys[order], begins), heads=(heads[order], begins),
                         times=(times[order].astype(np.uint32), begins))

    def add(table):
        keys, heads, times = summed(
            *(unpacked(table[c], np.uint64) for c in ("keys", "heads")),
            unpacked(table["times"], np.uint32).astype(np.int64))
        known = times >= min_count
        keys, heads, times = keys[known], heads[known], times[known]
        tails = unmixed(keys) - heads * _STEP
        return pa.table({"key": keys.view(np.int64), "times": times,
                         "head": heads.view(np.int64), "tail": tails.view(np.int64)})

    found = docs.select("text").mapInArrow(run, "bucket long, keys binary, heads binary, times binary")
    return found.groupBy("bucket").applyInArrow(add, "key long, times long, head long, tail long")


def known_grams(docs: DataFrame, order: int, min_count: int) -> tuple[list[DataFrame], int]:
    """The known n-grams of each order, and the number of words of the corpus.

    (key, times, in_all, tail_times, tail_in_all): how often the n-gram, its head, its tail and the
    tail's head come. A word's head are all words.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = durable(counted(docs, 1, 1, 0, 1, max(LEAST_BUCKETS, partitions)).select("key", "times"))
    total = words.agg(F.sum("times")).first()[0] or 0
    none = F.lit(1).cast("long")
    found = [words.select(
        "key", "times", F.lit(max(total, 1)).cast("long").alias("in_all"), none.alias("tail_times"),
        none.alias("tail_in_all"))]
    for n in range(2, order + 1):
        buckets = bucket_number(total // COUNTING)
        parts = [durable(counted(docs, n, min_count, at, COUNTING, buckets)) for at in range(COUNTING)]
        # An n-gram heads and ends no more longer ones than it has occurrences.
        shorter = found[-1].withColumn("size", F.col("times")).hint("shuffle_hash")
        heads = shorter.select(F.col("key").alias("head"), F.col("times").alias("in_all"), "size")
        tails = shorter.select(
            F.col("key").alias("tail"), F.col("times").alias("tail_times"), F.col("in_all").alias("tail_in_all"), "size")
        level = reduce(DataFrame.unionByName, parts)
        level = durable(hot.lookup(level, heads, "head", total, "size").drop("head"))
        discard(*parts)
        found.append(durable(hot.lookup(level, tails, "tail", total, "size").drop("tail")))
        discard(level)
    return found, total


def gains(known: list[DataFrame], alpha: float) -> DataFrame:
    """(key, times, gain) of all known n-grams."""
    last = (len(known) - 1) * math.log(alpha)
    s = F.log(F.col("times") / F.col("in_all"))
    less = F.log(F.col("tail_times") / F.col("tail_in_all")) + math.log(alpha)
    tables = [t.select("key", "times", (s - less if n else s + last).alias("gain")) for n, t in enumerate(known)]
    return reduce(DataFrame.unionByName, tables)


def exploded(docs: DataFrame, order: int, often: pa.Table, at: int, passes: int, buckets: int) -> DataFrame:
    """(bucket, rows, sizes, keys, values, doc_words): the n-grams of each row (row, text) that fall to a pass.

    ``sizes`` has the number of keys of each of the ``rows``, which follow each other in ``keys``.
    One entry of each row has no n-gram: it holds the sum of the gains in ``often`` and the number of words.
    """
    by_key = often.sort_by("key")
    shared = docs.sparkSession.sparkContext.broadcast(
        (by_key.column("key").to_numpy().view(np.uint64), by_key.column("gain").to_numpy()))

    def run(batches):
        hot_keys, hot_gains = shared.value
        sort = np.argsort(hot_keys)
        hot_keys, hot_gains = hot_keys[sort], hot_gains[sort]
        for batch, hashes, sizes in stretches(batches):
            ids = batch.column("row").to_numpy()
            keys, places, values = [], [], np.zeros(len(ids))
            for _, found, _, of, whole in levels(hashes, sizes, order):
                mine = np.flatnonzero(whole & (turn(found, passes) == at))
                found, of = found[mine], of[mine]
                is_hot, place = matches(found, hot_keys)
                values += np.bincount(of[is_hot], hot_gains[place], len(ids))
                keys.append(np.delete(found, is_hot))
                places.append(np.delete(of, is_hot))
            keys, places = np.concatenate(keys), np.concatenate(places)
            sort = np.argsort(places, kind="stable")
            order_, of, begins = by_bucket(keys[sort], buckets)
            keys, places = keys[sort][order_], places[sort][order_]
            # Runs of keys of one row in one bucket.
            change = np.diff(places, prepend=-1) != 0
            change[begins] = True
            runs = np.flatnonzero(change)
            first = np.searchsorted(runs, begins)
            none = np.zeros(len(begins), np.int64)
            empty = np.empty(0)
            yield packed(of, rows=(ids[places[runs]], first),
                         sizes=(np.diff(runs, append=len(keys)).astype(np.uint32), first), keys=(keys, begins),
                         values=(empty, none), doc_words=(empty, none))
            if len(ids):
                whole = np.zeros(1, np.int64)
                yield packed(ids[:1] % buckets, rows=(ids, whole), sizes=(np.zeros(len(ids), np.uint32), whole),
                             keys=(empty, whole), values=(values, whole), doc_words=(sizes.astype(np.int64), whole))

    return docs.select("row", "text").mapInArrow(
        run, "bucket long, rows binary, sizes binary, keys binary, values binary, doc_words binary")


def bucketed(gains: DataFrame, buckets: int) -> DataFrame:
    """(bucket, keys, gains) of rows (key, gain)."""

    def run(batches):
        held, size = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                size += len(batch)
            if held and (batch is None or size >= BUCKET):
                table = pa.Table.from_batches(held)
                keys = table["key"].to_numpy().view(np.uint64)
                order, of, begins = by_bucket(keys, buckets)
                yield packed(of, keys=(keys[order], begins), gains=(table["gain"].to_numpy()[order], begins))
                held, size = [], 0

    return gains.mapInArrow(run, "bucket long, keys binary, gains binary")


def joined(grams: DataFrame, gains: DataFrame) -> DataFrame:
    """(row, total, doc_words): sums of the gains of n-grams of a row, for those of each bucket; ``doc_words`` in one entry."""

    def run(left, right):
        keys = unpacked(right["keys"], np.uint64)
        order = np.argsort(keys)
        keys, values = keys[order], unpacked(right["gains"], np.float64)[order]
        rows, totals, sizes = [], [], []
        for batch in left.to_batches(max_chunksize=64):
            ids, runs, found = (unpacked(batch[c], k) for c, k in (
                ("rows", np.int64), ("sizes", np.uint32), ("keys", np.uint64)))
            at, place = matches(found, keys)
            total = np.bincount(np.repeat(np.arange(len(ids)), runs)[at], values[place], len(ids)).astype(float)
            words = np.full(len(ids), -1, np.int64)
            own = np.repeat([len(x) > 0 for x in batch["doc_words"].to_pylist()],
                            [len(x) // 8 for x in batch["rows"].to_pylist()]).astype(bool)
            total[own] += unpacked(batch["values"], np.float64)
            words[own] = unpacked(batch["doc_words"], np.int64)
            some = own | (total != 0)
            rows.append(ids[some])
            totals.append(total[some])
            sizes.append(words[some])
        return pa.table({"row": np.concatenate([np.empty(0, np.int64), *rows]),
                         "total": np.concatenate([np.empty(0), *totals]),
                         "doc_words": np.concatenate([np.empty(0, np.int64), *sizes])})

    return grams.groupBy("bucket").cogroup(gains.groupBy("bucket")).applyInArrow(
        run, "row long, total double, doc_words long")


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) for each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    with releasing(docs.sparkSession):
        known, total = known_grams(rows, order, min_count)
        table = gains(known, alpha)
        limit = total // HOT
        often = table.filter(F.col("times") > limit).toArrow().select(["key", "gain"])
        rest = table.filter(F.col("times") <= limit).select("key", "gain")
        buckets = bucket_number(order * total // JOINING)
        marked = F.col("doc_words") >= 0
        parts = []
        for at in range(JOINING):
            mine = rest.filter(in_turn("key", at, JOINING))
            found = joined(exploded(rows, order, often, at, JOINING, buckets), bucketed(mine, buckets))
            parts.append(durable(found.groupBy("row").agg(
                F.sum("total").alias("total"), F.sum(F.when(marked, F.col("doc_words"))).alias("in_all"),
                F.count_if(marked).alias("copies"))))
        discard(*known[1:])
        # Each pass has had every row, with its words and copies.
        sums = reduce(DataFrame.unionByName, parts).groupBy("row").agg(
            F.sum("total").alias("total"), F.first("in_all").alias("in_all"), F.first("copies").alias("copies"))
        sums = durable(sums.select(
            "row", "copies", (F.col("in_all") / F.col("copies")).cast("long").alias("n_words"),
            (F.col("total") / F.col("copies")).alias("log_score")))
        discard(*parts)
        size = sums.agg(F.sum("copies")).first()[0] or 0
    found = hot.lookup(rows.select("row", "doc_id"), sums, "row", size, "copies")
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return found.select("doc_id", "n_words", "log_score", mean.alias("mean_log_score"))

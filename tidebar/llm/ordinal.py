"""Quality classifier: ordinal regression with cumulative links on hashed text.

A grade k of 0..K-1 has P(grade <= k) = sigmoid(threshold[k] - weights . x), one weight
vector and rising thresholds. x has hashed features for each word and for its first four and
five letters (how often they occur, up to 3), and for each shape of a word's marks and capitals
(6 times its share of the words), and for words that repeat the one before.
The weights are fitted on at most about ``SAMPLE`` graded documents (all where there are
fewer), chosen by a hash of the id. Words get a weight if ``SEEN`` of these documents have them
and if the grades of those differ from the rest by more than so many tries show by chance. Scoring
adds up weights of whole texts, batch by batch, with the weights broadcast (``BUCKETS`` numbers).

A score is the expected grade and the tail probability of the top grade. Null text counts
as empty and has the score of no words. Rows without a grade don't train; grades of one
kind only, or none, give every document that grade (none: the score is null, and selection
keeps the document). Repeated rows get equal scores; an id trains once, with its lowest grade and
the least of its texts' vectors, however often it comes.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.text import Cache, hash64, words
from tidebar.session import durable

BUCKETS = 1 << 18
SAMPLE = 8_000
SEEN = 8
COPIES = 2
STEPS = 200
#: Probability of the top grade from which on a document is selected.
LEAST = 0.75
#: Penalty of squared weights, over the number of rows.
DECAY = 0.5
SHAPE, MOST = 6.0, 3

_four = struct.Struct("=4i").pack
marks = re.compile(r"[^\w\s]+$|^[^\w\s]+", re.U)


def features(word: str) -> bytes:
    """Hashed word, its first five and four letters, and shape (in the upper half of the buckets).

    As bytes of 32-bit numbers: in a full cache, they take a third of what a tuple of numbers takes.
    """
    bare = word.strip("#*$%&|<>!?.,;:()[]{}\"'-_=+/\\").lower()
    if not bare:
        shape = word[:4]
    else:
        start = word.lower().find(bare)
        upper = len(word) > 2 and word.upper() == word and word.lower() != word
        digits = any(c.isdigit() for c in word)
        shape = f"{word[:start][:3]}_{word[start + len(bare):][:3]}_{upper}_{digits}_{min(len(bare), 25) // 5}"
    half = BUCKETS // 2
    return _four(hash64(bare) % half, hash64("^5" + bare[:5]) % half, hash64("^4" + bare[:4]) % half,
                 half + hash64("~" + shape) % half)


def vector(text: str, look) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and their values."""
    found = list(map(look, words(text)))
    if not found:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    each = np.frombuffer(b"".join(found), np.int32).reshape(-1, 4)
    lexical, often = np.unique(each[:, :3], return_counts=True)
    shape, n = np.unique(each[:, 3], return_counts=True)
    again = np.count_nonzero(each[1:, 0] == each[:-1, 0])
    shape, n = np.append(shape, AGAIN), np.append(n, again)
    values = np.concatenate([np.minimum(often, MOST), SHAPE * n / len(each)])
    return np.concatenate([lexical, shape]).astype(np.int32), values.astype(np.float32)


_cache = Cache(features, most=250_000)
#: Feature of the words that repeat the one before.
AGAIN = BUCKETS // 2 + hash64("~again") % (BUCKETS // 2)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def solve(index, value, start, grades, levels: int, steps: int = STEPS):
    """Weights and thresholds of least loss, by Adam on all rows."""
    n, size = len(grades), int(index.max()) + 1 if len(index) else 1
    decay = DECAY / n
    owner = np.repeat(np.arange(n), np.diff(start))
    w = np.zeros(size)
    share = np.cumsum(np.bincount(grades, minlength=levels))[:-1] / n
    share = np.clip(share, 1e-3, 1 - 1e-3)
    cuts = np.log(share / (1 - share))
    gaps = np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])
    moments = [[np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(gaps), np.zeros_like(gaps)]]
    for step in range(1, steps + 1):
        theta = np.concatenate([gaps[:1], gaps[0] + np.cumsum(np.exp(gaps[1:]))])
        z = np.bincount(owner, w[index] * value, n)
        high = sigmoid(np.append(theta, np.inf)[grades] - z)
        low = sigmoid(np.append(-np.inf, theta)[grades] - z)
        p = np.maximum(high - low, 1e-12)
        dh, dl = high * (1 - high) / p / n, low * (1 - low) / p / n
        grad_w = np.bincount(index, (dh - dl)[owner] * value, size) + decay * w
        dtheta = np.zeros(levels + 1)
        np.subtract.at(dtheta, grades + 1, dh)
        np.add.at(dtheta, grades, dl)
        dtheta = dtheta[1:levels]
        chain = np.append(1.0, np.exp(gaps[1:]))
        grad_g = chain * np.cumsum(dtheta[::-1])[::-1]
        for x, g, (m, v), rate in ((w, grad_w, moments[0], 0.1), (gaps, grad_g, moments[1], 0.02)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    theta = np.concatenate([gaps[:1], gaps[0] + np.cumsum(np.exp(gaps[1:]))])
    return w, theta


def telling(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which features get a weight: shapes, and words that go with some grade.

    ``counts`` has the documents with each feature, a row for each grade; ``sizes`` the documents of
    each grade. For each grade, Chernoff's bound on the chance that as many of the documents with a word
    have the grade must stay below one in the number of words. As documents have near copies,
    ``COPIES`` of them count as one.
    """
    n = counts.sum(0)
    often = n >= least_seen(sizes.sum())
    words = often.copy()
    words[BUCKETS // 2 :] = False
    told = ~words & often
    for of_grade, size in zip(counts, sizes):
        if not size:
            continue
        rate = np.clip(size / sizes.sum(), 1e-6, 1 - 1e-6)
        q = np.clip(of_grade / np.maximum(n, 1), 1e-9, 1 - 1e-9)
        surprise = n * (q * np.log(q / rate) + (1 - q) * np.log((1 - q) / (1 - rate)))
        told |= words & (surprise > COPIES * (np.log(max(words.sum(), 2)) + 3))
    return told


def least_seen(total: int) -> int:
    """Documents of ``total`` that must have a feature."""
    return min(SEEN, max(2, int(total) // 100))


def training(docs: DataFrame, grades: DataFrame, levels: int, sample: int) -> DataFrame:
    """(grade, index, value): a vector of each graded document, a single one of near copies."""
    known = grades.filter(F.col("grade").between(0, levels - 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    total = known.count()
    if total > sample:
        share = F.lit(int(sample / total * (1 << 32)))
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 32)) < share)
    # The sample's size is bounded by ``sample``, so it may be broadcast.
    chosen = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def run(batches):
        for batch in batches:
            # One text at a time: a batch of them as Python texts takes as much memory as the batch again.
            found = [vector(t.as_py() or "", _cache.__getitem__) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("grade"), pa.array([f[0].tobytes() for f in found], pa.binary()),
                 pa.array([f[1].tobytes() for f in found], pa.binary())],
                names=["id", "grade", "index", "value"])

    vectors = chosen.select(F.col("doc_id").cast("string").alias("id"), "grade", "text").mapInArrow(
        run, "id string, grade int, index binary, value binary")
    each = vectors.groupBy("id", "grade").agg(F.min(F.struct("index", "value")).alias("v"))
    # Near copies share the least of their hashes; one of them is enough.
    lone = each.groupBy("grade", F.substring("v.index", 1, 32).alias("least")).agg(F.max("v").alias("v"))
    return lone.select("grade", "v.index", "v.value")


def counted(rows: DataFrame, sizes: np.ndarray) -> np.ndarray:
    """Documents with each feature, a row for each grade; 0 for features too rare for a weight."""
    levels = len(sizes)

    def run(batches):
        found = np.zeros((levels, BUCKETS), np.int64)
        for batch in batches:
            for grade, index in zip(batch.column("grade").to_pylist(), batch.column("index").to_pylist()):
                np.add.at(found[grade], np.frombuffer(index, np.int32), 1)
        at = np.flatnonzero(found.any(0)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), *[pa.array(n[at]) for n in found]], names=["feature", *names])

    names = [f"n{k}" for k in range(levels)]
    parts = rows.select("grade", "index").mapInArrow(run, "feature int, " + ", ".join(f"{n} long" for n in names))
    sums = parts.groupBy("feature").agg(*[F.sum(n).alias(n) for n in names])
    often = sums.filter(sum(F.col(n) for n in names) >= least_seen(sizes.sum())).toArrow()
    counts = np.zeros((levels, BUCKETS), np.int64)
    for k, n in enumerate(names):
        counts[k, often.column("feature").to_numpy()] = often.column(n).to_numpy()
    return counts


def narrowed(rows: DataFrame, told: np.ndarray) -> DataFrame:
    """``rows`` with the features in ``told`` only, numbered in their order."""
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(told))

    def run(batches):
        told = np.unpackbits(shared.value, count=BUCKETS).astype(bool)
        place = (np.cumsum(told) - 1).astype(np.int32)
        for batch in batches:
            index, value = [], []
            for i, v in zip(batch.column("index").to_pylist(), batch.column("value").to_pylist()):
                i = np.frombuffer(i, np.int32)
                index.append(place[i[told[i]]].tobytes())
                value.append(np.frombuffer(v, np.float32)[told[i]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("grade"), pa.array(index, pa.binary()), pa.array(value, pa.binary())],
                names=["grade", "index", "value"])

    return rows.select("grade", "index", "value").mapInArrow(run, "grade int, index binary, value binary")


def fit(docs: DataFrame, grades: DataFrame, levels: int, sample: int = SAMPLE):
    """(weights, thresholds) from ``docs`` (doc_id, text) and ``grades`` (doc_id, grade).

    Vectors stay in a table. Features are counted and chosen there, so the driver gets the counts
    of frequent ones and, of each vector, the few that get a weight.
    """
    rows = durable(training(docs, grades, levels, sample))
    sizes = np.zeros(levels, np.int64)
    for grade, n in rows.groupBy("grade").count().collect():
        sizes[grade] = n
    weights = np.zeros(BUCKETS, np.float32)
    if not sizes.any():
        return weights, np.full(levels - 1, np.nan)
    if np.count_nonzero(sizes) == 1:
        return weights, np.where(np.arange(levels - 1) < np.argmax(sizes), -40.0, 40.0)
    told = telling(counted(rows, sizes), sizes)
    # In an order that doesn't depend on how the rows were dealt out.
    found = sorted((bytes(i), bytes(v), grade) for grade, i, v in narrowed(rows, told).collect())
    y = np.array([r[2] for r in found])
    index = np.frombuffer(b"".join(r[0] for r in found), np.int32)
    value = np.frombuffer(b"".join(r[1] for r in found), np.float32)
    start = np.append(0, np.cumsum([len(r[0]) // 4 for r in found]))
    w, theta = solve(index, value.astype(float), start, y, levels)
    kept = np.flatnonzero(told)
    weights[kept] = w[: len(kept)]
    return weights, theta


def scorer(docs: DataFrame, model, levels: int):
    """Function from an array of texts to (expected grade, probability of the top grade)."""
    weights, theta = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(texts: pa.Array):
        w, look = shared.value, _cache.__getitem__
        z = np.zeros(len(texts))
        for i, t in enumerate(texts):
            index, value = vector(t.as_py() or "", look)
            z[i] = float(np.dot(w[index].astype(np.float64), value))
        over = 1 - sigmoid(theta[None, :] - z[:, None])  # P(grade > k)
        return over.sum(1), over[:, -1]

    return run


def score(docs: DataFrame, model, levels: int, text: str = "text") -> Column:
    """Struct (expected, top) for a text column."""
    run = scorer(docs, model, levels)

    @F.arrow_udf("struct<expected:double,top:double>")
    def column(texts: pa.Array) -> pa.Array:
        expected, top = run(texts)
        bad = np.isnan(top)
        return pa.StructArray.from_arrays(
            [pa.array(expected, mask=bad), pa.array(top, mask=bad)], ["expected", "top"])

    return column(F.col(text))


def selected(docs: DataFrame, model, levels: int, least: float = LEAST, text: str = "text") -> DataFrame:
    """The documents whose tail probability is at least ``least``, with their own columns."""
    run = scorer(docs, model, levels)
    at = docs.columns.index(text)

    def keep(batches):
        for batch in batches:
            _, top = run(batch.column(at))
            yield batch.filter(pa.array(~(top < least)))

    return docs.mapInArrow(keep, docs.schema)

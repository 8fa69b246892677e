"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, what is not a letter becomes one space, and every n-gram of 1 to 4
characters is hashed into ``BUCKETS`` counters. Training counts n-grams per language in
Spark, over at most about ``PER_LANGUAGE`` documents of each (chosen by a hash, all of
them where there are fewer); the matrix of log probabilities (languages x buckets, so
bounded) is broadcast and documents are scored in batches with numpy.

Null text and text without a letter give ``und`` with score 0. Without training rows every
document is ``und``. Rows without a language don't train. Equal scores go to the language
that sorts first.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
PER_LANGUAGE = 4_000
ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"
#: Characters scored at a time.
CHUNK = 1 << 18


@functools.cache
def letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return table


def ngrams(texts: list[str], buckets: int):
    """Hashed n-grams of some texts, order by order: (buckets, index of the text)."""
    raw = np.frombuffer(" ".join(texts).lower().encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = [len(t.lower()) + 1 for t in texts]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)[: len(raw)]
    letter = letters()[raw]
    code = np.where(letter, raw, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space for each run of other characters
    code, owner = code[keep], owner[keep]
    h = np.zeros(len(code), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        size = len(code) - n + 1
        if size <= 0:
            return
        h = h[:size] * np.uint32(0x01000193) + code[n - 1 :] + np.uint32(n)
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            mixed = (mixed ^ (mixed >> np.uint32(13))) % np.uint32(buckets)
            inside = owner[:size] == owner[n - 1 :]
            yield mixed[inside], owner[:size][inside]


def chunks(texts: list[tuple[int, str]]):
    """Groups of texts of about ``CHUNK`` characters; a longer text comes alone."""
    group, size = [], 0
    for i, text in texts:
        if group and size + len(text) > CHUNK:
            yield group
            group, size = [], 0
        group.append((i, text))
        size += len(text)
    if group:
        yield group


def train(docs: DataFrame, lang: str = "lang", text: str = "text", buckets: int = BUCKETS,
          per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and the matrix (buckets + 1, languages) of log probabilities; its last row is the prior."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    totals = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    names = sorted(totals)
    if not names:
        return [], np.zeros((buckets + 1, 0), np.float32)
    span = 1 << 32
    share = F.lit(0)
    for name in names:
        limit = min(1.0, per_language / totals[name])
        share = F.when(F.col(lang) == name, F.lit(int(limit * span))).otherwise(share)
    chosen = known.filter(F.pmod(F.xxhash64(text), F.lit(span)) < share).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"))
    place = {name: i for i, name in enumerate(names)}

    def run(batches):
        counts = np.zeros((len(names), buckets), np.int64)
        for batch in batches:
            langs = batch.column(0).to_pylist()
            rows = [(place[x], t) for x, t in zip(langs, batch.column(1).to_pylist())]
            for group in chunks(rows):
                owner = np.array([k for k, _ in group])
                for hashed, who in ngrams([t for _, t in group], buckets):
                    counts += np.bincount(owner[who] * buckets + hashed.astype(np.int64),
                                          minlength=counts.size).reshape(counts.shape)
        at, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(bucket, pa.int32()), pa.array(counts[at, bucket])],
            names=["lang", "bucket", "n"])

    parts = chosen.mapInArrow(run, "lang int, bucket int, n long")
    table = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((buckets, len(names)))
    counts[table.bucket.to_numpy(), table.lang.to_numpy()] = table.n.to_numpy()
    counts += 0.5
    logs = np.log(counts / counts.sum(0))
    prior = np.array([totals[n] for n in names], float)
    return names, np.vstack([logs, np.log(prior / prior.sum())]).astype(np.float32)


def predictor(docs: DataFrame, model: tuple[list[str], np.ndarray]):
    """Column function from text to struct (lang, score); ``score`` is the posterior."""
    names, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast(matrix)
    buckets = len(matrix) - 1

    @F.arrow_udf("struct<lang:string,score:double>")
    def run(texts: pa.Array) -> pa.Array:
        logs = shared.value
        n = len(texts)
        total = np.tile(logs[-1].astype(np.float64), (n, 1))
        some = np.zeros(n, bool)
        for group in chunks([(i, t) for i, t in enumerate(texts.to_pylist()) if t]):
            rows = np.array([i for i, _ in group])
            for order, (hashed, who) in enumerate(ngrams([t for _, t in group], buckets)):
                first = np.flatnonzero(np.diff(who, prepend=-1))
                if not len(first):
                    continue
                if order == 0:
                    some[rows[who[first]]] = True
                total[rows[who[first]]] += np.add.reduceat(
                    logs[hashed], first, axis=0, dtype=np.float64)
        if not names:
            some[:] = False
        langs, scores = [UNKNOWN] * n, np.zeros(n)
        if some.any():
            part = total[some]
            best = part.argmax(1)
            scores[some] = 1 / np.exp(part - part.max(1, keepdims=True)).sum(1)
            for i, b in zip(np.flatnonzero(some), best):
                langs[i] = names[b]
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)],
                                          ["lang", "score"])

    return run


def predict(docs: DataFrame, model, text: str = "text") -> Column:
    return predictor(docs, model)(F.col(text))

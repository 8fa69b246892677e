"""Packing documents into sequences of fixed length, in their order.

A document is its token ids and one end id. Each input partition is one stream of tokens,
cut into windows of at most ``window`` tokens by dynamic programming over the allowed cuts:

    cost(j) = least over i of cost(i) + window - (pos(j) - pos(i)) + penalty(j)

with pos(j) - pos(i) <= window. A cut between documents costs nothing, one after a
sentence ``SENTENCE`` tokens, one elsewhere ``INSIDE`` tokens. As cost(i) + pos(i) does not
depend on j, a queue that keeps its least value in front gives every step in constant time.
What is left of a stream at its end fills sequences whose lengths are powers of two, which
need no padding.

Streams are packed as they are read: no shuffle, and memory holds one stretch of ``STRETCH``
tokens beside the document at hand. Null text counts as empty; such a document is its end id.
Repeated rows are packed as often as they come. A null id stays null.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.text import SPACE, Cache

SENTENCE, INSIDE = 2, 24
#: Tokens packed at a time.
STRETCH = 1 << 20
#: Cuts inside a sentence are allowed at this distance.
EVERY = 64

SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long"
)


def best_cuts(places: np.ndarray, penalties: np.ndarray, window: int) -> list[int]:
    """Indices into ``places`` of the cuts of least cost.

    ``places`` rise from 0 by at most ``window``; the last one is always a cut.
    """
    at, price = places.tolist(), penalties.tolist()
    total = [0] * len(at)  # cost + place
    back = [0] * len(at)
    queue = deque([0])  # totals rise from front to back
    for j in range(1, len(at)):
        here = at[j]
        while at[queue[0]] < here - window:
            queue.popleft()
        back[j] = i = queue[0]
        mine = total[i] + window + price[j]  # cost(j) + place(j)
        while queue and total[queue[-1]] >= mine:
            queue.pop()
        queue.append(j)
        total[j] = mine
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def allowed(ids: np.ndarray, end_id: int, ends: np.ndarray, window: int):
    """Places where the stream may be cut, with their penalties."""
    cost = np.full(len(ids) + 1, INSIDE, np.int32)
    cost[1:][ends[ids]] = SENTENCE
    cost[1:][ids == end_id] = 0
    cost[0] = cost[-1] = 0
    every = min(EVERY, window)
    keep = cost < INSIDE
    keep[::every] = True
    places = np.flatnonzero(keep)
    return places, cost[places]


def powers(n: int) -> list[int]:
    """Powers of two that add up to ``n``, the largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


@functools.lru_cache(2)
def tokenizer(path: str):
    """Function from text to bytes of 32-bit ids, and which ids end a sentence.

    The vocabulary drops white space, so words between white space are looked up alone; a
    full stop or comma after a plain letter is always a token of its own.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    words = re.compile(f"[^{SPACE}]+").findall
    odd = re.compile("[\x1c-\x1f]").search  # white space for Python only
    cased = re.compile("[ΣİẞΏ]|<[|]").search  # not simply lower-cased

    # One run of plain lower-case letters needs no normalising or splitting: the merges alone
    # are asked for, on bytes written as characters (printable ones as they are, others from 256 on).
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    written = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    letters = re.compile("[a-zß-öø-ÿ]+").fullmatch
    merges = model.model

    def encode(word: str) -> bytes:
        if letters(word):
            if not word.isascii():
                word = "".join(map(written.__getitem__, word.encode()))
            return array("I", [t.id for t in merges.tokenize(word)]).tobytes()
        return array("I", model.encode(word, add_special_tokens=False).ids).tobytes()

    marks = {m: encode(m) for m in ".,"}
    plain = re.compile("[a-zA-ZÀ-ÖØ-öø-į]").match

    class Words(Cache):
        def __missing__(self, word):
            if word[-1] in marks and plain(word[-2:-1]):
                return self[word[:-1]] + marks[word[-1]]
            return super().__missing__(word)

    look = Words(encode, most=700_000).__getitem__

    def ids(text: str) -> bytes:
        if not cased(text):
            text = text.lower()
        return b"".join(map(look, words(text) if odd(text) else text.split()))

    vocabulary = model.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 2, bool)
    for token, i in vocabulary.items():
        bare = token.removesuffix("</w>")
        ends[i] = token != bare and bool(re.fullmatch(r"[^\w\s]*[.!?][^\w\s]*", bare))
    return ids, ends


class _Stream:
    """The windows of one partition; documents go in, finished pieces come out."""

    def __init__(self, window: int, end_id: int, ends: np.ndarray, first: int):
        self.window, self.end_id, self.ends, self.sequence = window, end_id, ends, first
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []  # doc_id, tokens already given out, tokens, tokens here
        self.size = 0

    def add(self, doc_id, ids: np.ndarray):
        at = 0
        while at < len(ids):
            part = ids[at : at + STRETCH]
            self.ids.append(part)
            self.docs.append((doc_id, at, len(ids), len(part)))
            self.size += len(part)
            at += len(part)
            if self.size >= STRETCH + self.window:
                yield from self.cut(False)

    def cut(self, last: bool):
        """Cuts what is held; the windows at its end wait for what follows."""
        if not self.size:
            return
        ids = np.concatenate(self.ids)
        places, price = allowed(ids, self.end_id, self.ends, self.window)
        cuts = best_cuts(places, price, self.window)
        bounds = [0] + [int(places[c]) for c in cuts]
        keep = max(1, len(bounds) - 16)  # far from the end the best cuts don't change
        if last:
            keep, tail = len(bounds) - 1, bounds[-1] - bounds[-2]
            if tail & (tail - 1):
                bounds = bounds[:-1] + (bounds[-2] + np.cumsum(powers(tail))).tolist()
                keep = len(bounds) - 1
        bounds = bounds[: keep + 1]
        yield from self.pieces(ids, bounds)
        done = bounds[-1]
        rest, left = [], done
        for doc_id, start, total, here in self.docs:
            if left >= here:
                left -= here
            else:
                rest.append((doc_id, start + left, total, here - left))
                left = 0
        self.ids, self.docs, self.size = [ids[done:]], rest, len(ids) - done

    def pieces(self, ids: np.ndarray, bounds: list[int]):
        raw = ids.astype("<u4").tobytes()
        docs = iter(self.docs)
        at, doc_end = 0, 0
        for low, high in zip(bounds, bounds[1:]):
            while at < high:
                if at == doc_end:
                    doc_id, start, total, here = next(docs)
                    doc_at, doc_end = at, at + here
                to = min(doc_end, high)
                yield (doc_id, start + at - doc_at, to - at, raw[4 * at : 4 * to], total,
                       self.sequence, at - low)
                at = to
            self.sequence += 1


def pack(docs: DataFrame, path: str, end_id: int = 1, window: int = 2048, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Pieces of documents with their place in a sequence; ``ids`` are 32-bit little-endian.

    The window must be a power of two. Sequence ids hold the number of the partition.
    """
    assert window & (window - 1) == 0

    def run(batches):
        encode, ends = tokenizer(path)
        context = TaskContext.get()
        stream = _Stream(window, end_id, ends, context.partitionId() << 32)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                            ("ids", pa.binary()), ("doc_tokens", pa.int64()),
                            ("sequence_id", pa.int64()), ("offset", pa.int64())])
        end = np.array([end_id], "<u4").tobytes()

        def batch(rows):
            columns = zip(*rows) if rows else [[]] * len(schema)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        rows: list[tuple] = []
        for given in batches:
            for doc_id, text in zip(given.column(0).to_pylist(), given.column(1)):
                ids = np.frombuffer(encode(text.as_py() or "") + end, "<u4")
                rows.extend(stream.add(doc_id, ids))
                if len(rows) >= 5000:
                    yield batch(rows)
                    rows = []
        rows.extend(stream.cut(True))
        yield batch(rows)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, SCHEMA)

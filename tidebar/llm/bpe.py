"""Byte-level BPE: text to token ids and back, as column functions.

A vocabulary is a file of base64 tokens and ranks. Text is cut by ``PATTERN`` and each
match is merged on its own: a segment tree over the byte positions holds the rank of the
pair that starts there, its root the leftmost pair of the least rank, and a merge changes
the leaves of the two live neighbours and of the swallowed position.

Null text has no ids (empty array), as has empty text; ids null decode to null. Texts of
any length are encoded whole; one match of n bytes takes O(n log n) steps.
"""

from __future__ import annotations

import base64
import functools
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidebar.llm.text import SPACE, Cache, lists

#: Cuts text before merging (fixed value).
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


#: Positions below one leaf of the tree; a leaf's least is taken from them directly.
LEAF = 16


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: the pair of least rank, leftmost first, is merged until none is left.

    The least pair of each stretch of ``LEAF`` positions is a leaf of the segment tree, so a short
    match has a tree of one node.
    """
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    none = 1 << 62
    look = ranks.get
    pairs = [none] * n  # rank and place of the pair that starts here
    for i in range(n - 1):
        rank = look(piece[i : i + 2])
        if rank is not None:
            pairs[i] = rank * n + i
    size = 1 << ((n - 1) // LEAF).bit_length()
    tree = [none] * (2 * size)

    def update(leaf: int) -> None:
        value = min(pairs[leaf * LEAF : (leaf + 1) * LEAF])
        i = leaf + size
        tree[i] = value
        while i > 1:
            value = min(value, tree[i ^ 1])
            i >>= 1
            if tree[i] == value:
                return
            tree[i] = value

    if size > 1:
        for leaf in range((n - 1) // LEAF + 1):
            update(leaf)
    end = list(range(1, n + 1))  # where the symbol that starts here ends
    before = list(range(-1, n))  # where the live symbol before it starts
    while True:
        least = tree[1] if size > 1 else min(pairs)
        if least == none:
            break
        i = least % n
        j = end[i]
        stop = end[i] = end[j]
        before[stop] = i
        pairs[j] = none
        rank = look(piece[i : end[stop]]) if stop < n else None
        pairs[i] = none if rank is None else rank * n + i
        k = before[i]
        if i:
            rank = look(piece[k:stop])
            pairs[k] = none if rank is None else rank * n + k
        if size > 1:
            for leaf in {max(k, 0) // LEAF, i // LEAF, j // LEAF}:
                update(leaf)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


@functools.lru_cache(2)
def vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.lru_cache(2)
def encoder(path: str):
    """Function from text to the bytes of little-endian 32-bit ids.

    White space before a word decides only about itself, so stretches between white space,
    with one space before, are looked up whole.
    """
    ranks = vocabulary(path)
    matches = regex.compile(PATTERN.replace(r"\s", f"[{SPACE}]").replace(
        f"[^[{SPACE}]", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]")).findall
    stretches = re.compile(f"[{SPACE}]+(?![^{SPACE}])| ?[^{SPACE}]+|[{SPACE}]").findall

    def ids(stretch: str) -> bytes:
        if stretch.isalpha() or stretch[0] == " " and stretch[1:].isalpha():
            return array("I", merge(stretch.encode(), ranks)).tobytes()
        found: list[int] = []
        for match in matches(stretch):
            found += merge(match.encode("utf-8", "replace"), ranks)
        return array("I", found).tobytes()

    # A full stop or comma after a plain letter is a match of its own.
    marks = {m: array("I", merge(m.encode(), ranks)).tobytes() for m in ".,"}
    plain = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]").match

    class Stretches(Cache):
        def __missing__(self, stretch):
            if stretch[-1] in marks and plain(stretch[-2:-1]):
                return self[stretch[:-1]] + marks[stretch[-1]]
            return super().__missing__(stretch)

    look = Stretches(ids, most=1_200_000).__getitem__
    return lambda text: b"".join(map(look, stretches(text)))


@functools.lru_cache(2)
def tokens(path: str) -> list[bytes]:
    ranks = vocabulary(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def encode(text: Column | str, path: str) -> Column:
    """Token ids of a text column."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        encoded = encoder(path)
        found = [encoded(t.as_py() or "") for t in texts]
        flat = np.frombuffer(b"".join(found), "<i4")
        return lists(flat, [len(x) // 4 for x in found], pa.int32())

    return run(text)


def decode(ids: Column | str, path: str) -> Column:
    """Bytes of an id column."""

    @F.arrow_udf("binary")
    def run(arrays: pa.Array) -> pa.Array:
        token = tokens(path).__getitem__
        out = []
        for ids in arrays:
            found = None
            if ids.is_valid:
                found = b"".join(map(token, ids.values.to_numpy(zero_copy_only=False).tolist()))
            out.append(found)
        return pa.array(out, pa.binary())

    return run(ids)

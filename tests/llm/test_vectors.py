"""Exact products, hard negatives and centroid clusters against plain integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tidebar.llm import bitplanes, strassen

ROWS = "vec_id long, embedding array<float>, label int, cluster int, anchor string"


def test_multiply():
    r = np.random.RandomState(1)
    for leaf, most in [(1, 20)] * 10 + [(8, 90)] * 10 + [(32, 200)] * 10:
        m, d, n = r.randint(1, most, 3)
        high = int(r.choice([2, 300, 1 << 28]))
        a, b = r.randint(-high, high, (m, d)), r.randint(-high, high, (d, n))
        assert (strassen.multiply(a, b, leaf) == a @ b).all()


def vectors(n, size, seed, labels=3):
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.2) for _ in range(size)] for _ in range(6)]
    return [(i, [c + r.gauss(0, 0.1) for c in r.choice(centres)], r.randrange(labels), 1, "x") for i in range(n)]


def odd_rows(size):
    bad = [[0.1] * (size - 1) + [x] for x in (float("nan"), float("inf"), -float("inf"), None)]
    rows = [(1000 + i, v, 1, None, None) for i, v in enumerate(bad)]
    rows += [(1100, None, 1, 1, "x"), (1200, [], 1, 1, "x"), (None, [0.1] * size, 1, 1, "x")]
    rows += [(1300, [0.2] * size, None, 1, "x"), (1400, [0.0] * size, 2, 1, "x"), (1500, [0.3] * (size - 3), 1, 1, "x")]
    rows += [(1600, [1e30] + [0.1] * (size - 1), 1, 1, "x"), (1700, [-1e30] + [0.1] * (size - 1), 2, 1, "x")]
    return rows


def floors(vector, limit):
    return [max(-limit, min(limit, math.floor(256 * float(np.float32(x))))) for x in vector]


def finite(vector):
    return bool(vector) and all(x is not None and math.isfinite(x) for x in vector)


def brute_negatives(rows):
    rows = [r for r in rows if r[0] is not None and r[2] is not None and finite(r[1])]
    limit = strassen.limit(max((len(r[1]) for r in rows), default=1))
    rows = sorted({(r[0], r[2], tuple(floors(r[1], limit))) for r in rows})
    found = []
    for a, label, q in rows:
        if a % 100:
            continue
        scored = sorted({(-sum(x * y for x, y in zip(q, p)), v, same != label) for v, same, p in rows if v != a})
        for p, v, _ in [s for s in scored if not s[2]][:5]:
            window = [(n, w) for n, w, other in scored if other and 30 * -p <= 100 * -n <= 90 * -p][:10]
            found += [(a, v, i + 1, w, -p, -n) for i, (n, w) in enumerate(window)]
    return sorted(found)


@pytest.mark.parametrize("part", [1 << 20, 40])
def test_hard_negatives(spark, monkeypatch, part):
    monkeypatch.setattr(strassen, "PART", part)
    monkeypatch.setattr(strassen, "GROUP", 3)
    monkeypatch.setattr(strassen, "TILE", 16)
    rows = vectors(420, 21, 4) + odd_rows(21)
    rows += rows[95:105] + [(2000 + i, rows[100][1], rows[100][2], 1, "x") for i in range(60)]  # repeats, ties
    rows += [(2200 + i, rows[100][1], (rows[100][2] + 1) % 3, 1, "x") for i in range(30)]
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    found = sorted(map(tuple, strassen.hard_negatives(df).collect()))
    assert found == brute_negatives(rows) and len(found) > 100
    assert strassen.hard_negatives(df.filter("false")).count() == 0
    lonely = df.filter("vec_id = 0")
    assert strassen.hard_negatives(lonely).count() == 0


def test_heaps_keep_the_best_distinct():
    r = np.random.RandomState(2)
    heaps = strassen.Heaps(3, 4)
    seen = [set() for _ in range(3)]
    for _ in range(30):
        scores, ids = r.randint(0, 9, (3, 20)), r.randint(0, 12, 20)
        mask = r.rand(3, 20) < 0.5
        for line in range(3):
            seen[line] |= {(-int(s), int(i)) for s, i, m in zip(scores[line], ids, mask[line]) if m}
        heaps.push(mask, scores, ids, np.arange(3))
    for line in range(3):
        assert list(zip((-heaps.scores[line]).tolist(), heaps.ids[line].tolist())) == sorted(seen[line])[:4]


def test_planes():
    r = np.random.RandomState(3)
    for high in (1, 2, 128, 5000, 1 << 27):
        a = r.randint(-high, high, (30, 64))
        b = r.randint(-high, high + 1, (1, 64))
        planes = bitplanes.pack(a, bitplanes.width_of(a))
        assert (bitplanes.unpack(planes) == a).all()
        other = bitplanes.pack(b, bitplanes.width_of(b))[0]
        assert (bitplanes.products(planes, other) == a @ b[0]).all()
    assert [bitplanes.width_of(np.array([v])) for v in (0, -1, 1, -2, 127, -128, 128)] == [1, 1, 2, 2, 8, 8, 9]


def brute_clusters(rows, k, rounds):
    kept = [(r[0], floors(r[1], bitplanes.LIMIT)) for r in rows if finite(r[1]) and len(r[1]) == 64]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    centres = [q for _, q in named[:k]]

    def nearest(q):
        return min((sum((x - y) ** 2 for x, y in zip(q, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        where = [nearest(q)[1] for _, q in kept]
        for n in set(where):
            own = [q for (_, q), w in zip(kept, where) if w == n]
            centres[n] = [sum(x) // len(own) for x in zip(*own)]
    done = [(i, *nearest(q)) for i, q in kept]
    inertia = {n: sum(d for _, d, m in done if m == n) for _, _, n in done}
    return [(i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest())
            for i, d, n in done]


def test_clusters(spark):
    rows = vectors(160, 64, 5) + odd_rows(64)
    rows += rows[10:20] + [(3000 + i, rows[3][1], 1, 1, "x") for i in range(90)]  # repeats and a hot vector
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    for k, rounds in ((12, 3), (400, 1)):
        found = bitplanes.cluster(df, k, rounds).collect()
        assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, brute_clusters(rows, k, rounds)))
    assert bitplanes.cluster(df.filter("false")).count() == 0
    assert bitplanes.cluster(df.filter("vec_id IS NULL")).count() == 0

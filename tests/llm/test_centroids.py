from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from waybook.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string, v int"


def brute(rows, k=16, rounds=3, width=64):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "")
    centres = [v for _, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((apart(v, c), j) for j, c in enumerate(centres)) for _, v in kept]
    for _ in range(rounds):
        found = assign()
        for j in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(kept, found) if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    sums = {j: sum(d for d, c in found if c == j) for j in range(len(centres))}
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, sums[c], sum(sums.values()), prints[c]) for (i, _), (d, c) in zip(kept, found)), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 3) for i, v in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("k", "spread"), [(1, 3), (2, 3), (5, 1), (40, 6), (120, 1)])
def test_tree_finds_the_nearest(k, spread):
    rnd = np.random.default_rng(k)
    points = rnd.integers(-spread, spread + 1, (k, 4))  # many ties and equal centroids
    vectors = rnd.integers(-2 * spread, 2 * spread + 1, (500, 4))
    found, apart = centroids.Tree(points).nearest(vectors)
    every = ((vectors[:, None] - points[None]) ** 2).sum(axis=2)
    assert (apart == every.min(axis=1)).all() and (found == every.argmin(axis=1)).all()


def test_tree_leaves_nodes_out():
    rnd = np.random.default_rng(5)
    groups = rnd.normal(0, 400, (30, 8))
    points = (groups[rnd.integers(0, 30, 300)] + rnd.normal(0, 3, (300, 8))).astype(np.int64)
    tree, seen = centroids.Tree(points), []
    tree.held = [np.array(h) for h in tree.held]
    vectors = points + 1
    total, tree.centroids = len(points) * len(vectors), Counting(tree.centroids, seen)
    found, apart = tree.nearest(vectors)
    every = ((vectors[:, None] - points[None]) ** 2).sum(axis=2)
    assert (apart == every.min(axis=1)).all() and (found == every.argmin(axis=1)).all()
    assert len(seen) <= len(points) * 4 < total


class Counting:
    """Notes each centroid that is read for a group of vectors."""

    def __init__(self, inner, seen):
        self.inner, self.seen = inner, seen

    def __getitem__(self, number):
        self.seen.append(number)
        return self.inner[number]


def test_large_components():
    points = np.array([[(1 << 27) - 1] * 64, [-(1 << 27) + 1] * 64, [0] * 64, [1] * 64])
    found, apart = centroids.Tree(points).nearest(points)
    assert found.tolist() == [0, 1, 2, 3] and not apart.any()
    assert centroids.Tree(points[:1]).nearest(points[1:2])[1][0] == 64 * (2 * ((1 << 27) - 1)) ** 2


def test_same_as_brute_force(spark):
    rnd = random.Random(7)
    rows = [(i, [rnd.gauss(0, 0.2) for _ in range(64)]) for i in range(60)]
    rows += [(i + 100, [x + rnd.gauss(0, 0.01) for x in rows[i % 7][1]]) for i in range(60)]
    got = centroids.clusters(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_nulls_ties_repeats_and_odd_vectors(spark):
    rnd, nan, inf = random.Random(8), float("nan"), float("inf")
    base = [[rnd.choice([-0.5, 0.0, 0.25]) for _ in range(64)] for _ in range(6)]
    rows = [(i, base[i % 6]) for i in range(20)] + [(3, base[4]), (3, base[4]), (None, base[1]), (None, None), (50, None), (51, []), (52, base[0][:63]), (53, [*base[0], 1.0])]
    rows += [(60, [*base[0][:63], None]), (61, [nan, *base[0][:63]]), (62, [*base[0][:63], -inf]), (63, [inf, *base[0][:63]])]
    got = centroids.clusters(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    few = centroids.clusters(frame(spark, rows[:3] + rows[24:])).collect()
    assert sorted((tuple(r) for r in few), key=str) == brute(rows[:3] + rows[24:])
    assert centroids.clusters(frame(spark, rows[-6:])).collect() == []
    assert centroids.clusters(frame(spark, [])).collect() == []
    with pytest.raises(Exception, match="too large"):
        centroids.clusters(frame(spark, [(1, [3e38] * 64), (2, base[0])])).collect()

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from waybook.llm import neighbours


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1.0, 2) for r in rows], "vec_id long, embedding array<float>, score double, cid int")


def brute(ids, vectors, every, k):
    out = {}
    for i, q in zip(ids, vectors):
        if i % every == 0:
            near = sorted(((-float(np.dot(q, v)), j) for j, v in zip(ids, vectors) if j != i))
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_recall(spark, scale):
    rnd = np.random.default_rng(4)
    centres = rnd.standard_normal((12, 24))
    vectors = (centres[rnd.integers(0, 12, 3000)] + 0.7 * rnd.standard_normal((3000, 24))).astype(np.float32)
    vectors = vectors * rnd.uniform(0.2, 3, (3000, 1)).astype(np.float32) if scale else vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[100:1100] = vectors[100]  # one vector a third of the time
    ids = rnd.permutation(9000)[:3000].tolist()
    got = neighbours.search(frame(spark, [(i, v.tolist()) for i, v in zip(ids, vectors)]).repartition(4), 20, 20).collect()
    want = brute(ids, vectors.astype(np.float64), 20, 20)
    assert {r["query_id"] for r in got} == set(want)
    found = 0
    for query, near in want.items():
        mine = sorted((r for r in got if r["query_id"] == query), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        score = dict(zip(ids, vectors.astype(np.float64) @ vectors[ids.index(query)].astype(np.float64)))
        assert all(abs(r["score"] - score[r["vec_id"]]) < 1e-9 for r in mine)
        found += len({r["vec_id"] for r in mine} & {j for j, _ in near})
    assert found >= 0.95 * sum(map(len, want.values()))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (5, [0.0, 1.0]), (7, [-1.0, -1.0]), (40, [0.0, 2.0])]
    odd = [(60, [0.0, 0.0]), (80, None), (100, [None, 1.0]), (120, [nan, 1.0]), (140, [inf, 1.0]), (None, [1.0, 1.0]), (160, [1.0, 1.0, 1.0]), (180, []), (3, [1.0, 0.0])]
    got = neighbours.search(frame(spark, good + odd), 20, 20).collect()
    want = brute([i for i, _ in good], [np.array(v) for _, v in good], 20, 20)
    mine = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        mine.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert mine == want


def test_nothing(spark):
    assert neighbours.search(frame(spark, [])).collect() == []
    assert neighbours.search(frame(spark, [(20, None)])).collect() == []
    assert neighbours.search(frame(spark, [(20, [1.0])])).collect() == []


def test_probes_come_in_order_of_expected_distance():
    sets = neighbours.templates(4, 81)
    assert len(sets) == 81 and not sets[0].any() and sets[1].tolist() == [1] + [0] * 7
    assert all(not (s[j] and s[7 - j]) for s in sets for j in range(4))
    assert len({tuple(s) for s in sets}) == 81


@pytest.mark.parametrize("spread", [0.7, None])
def test_recall_far_beyond_the_sample(spark, spread):
    """20 000 distinct vectors, five times the sample, in groups or all over the sphere."""
    rnd = np.random.default_rng(11)
    centres = rnd.standard_normal((50, 48))
    vectors = rnd.standard_normal((20_000, 48)) if spread is None else centres[rnd.integers(0, 50, 20_000)] + spread * rnd.standard_normal((20_000, 48))
    vectors = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
    table = pa.table({"vec_id": np.arange(20_000), "embedding": pa.FixedSizeListArray.from_arrays(vectors.ravel(), 48).cast(pa.list_(pa.float32()))})
    got = neighbours.search(spark.createDataFrame(table).repartition(8), 200, 20).toArrow()
    asked = np.arange(0, 20_000, 200)
    score = vectors[asked].astype(np.float64) @ vectors.T.astype(np.float64)
    score[np.arange(len(asked)), asked] = -2
    want = np.argsort(-score, axis=1, kind="stable")[:, :20]
    query, found = got["query_id"].to_numpy() // 200, got["vec_id"].to_numpy()
    hits = sum(len(np.intersect1d(want[i], found[query == i])) for i in range(len(asked)))
    assert hits >= 0.95 * want.size


def test_tables_are_added_or_it_raises(monkeypatch):
    rnd = np.random.default_rng(3)
    sample = rnd.standard_normal((600, 64))
    monkeypatch.setattr(neighbours, "TRIED", 40)
    tried = []
    fitted = neighbours._fitted

    def noted(*how):
        tried.append(how[4])
        return fitted(*how)

    monkeypatch.setattr(neighbours, "_fitted", noted)
    index = neighbours.fit(sample, 10**9, float(np.linalg.norm(sample, axis=1).max()), 20, tables=1, recall=0.5)
    assert index.tables == tried[-1] and tried == [2**i for i in range(len(tried))]
    monkeypatch.setattr(neighbours, "TABLES", 2)
    with pytest.raises(ValueError, match="of the sample's neighbours"):
        neighbours.fit(sample, 10**12, float(np.linalg.norm(sample, axis=1).max()), 20, tables=1, recall=1.0)


def peak_mb(run, *args):
    tracemalloc.start()
    try:
        return run(*args), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_call_holds_few_candidates_at_once():
    """80 000 pairs of a query and a block, 21 candidates each, took 217 MB at once; every query still gets its k best of all of its blocks."""
    rnd = np.random.default_rng(5)
    vectors, queries = rnd.integers(-3, 4, (6000, 8)).astype(float), rnd.integers(-3, 4, (4000, 8)).astype(float)
    ids, block = [[j, j + 6000][: 1 + j % 2] for j in range(6000)], rnd.permutation(6000) % 200
    blocks = [rnd.choice(203, 20, replace=False).tolist() for _ in queries]  # some are of no vector
    left = pa.table({"block": block, "cid": np.arange(6000) << 33, "ids": ids, "embedding": list(vectors)})
    right = pa.table({"blocks": blocks, "query_id": 3 * np.arange(4000), "embedding": list(queries)})
    got, peak = peak_mb(neighbours._searched(20), left, right)
    assert peak < 100
    mine = {}
    for r in got.to_pylist():
        mine.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert len(mine) == 4000
    for i in range(0, 4000, 40):
        best = sorted((-float(queries[i] @ vectors[j]), ids[j][0], j) for j in np.flatnonzero(np.isin(block, blocks[i])))
        want = [(s, x) for s, _, j in best for x in ids[j] if x != 3 * i][:20]
        assert mine[3 * i] == want


def test_probes_take_little_memory():
    index = neighbours.Index(16, 6, 12, 2.0, 2048, 1.0)
    vectors = np.random.default_rng(6).standard_normal((128, 16))
    got, peak = peak_mb(index.of_queries, vectors)
    assert got.shape == (128, 6, 2048) and peak < 120  # 305 MB before; the buckets alone are 13
    assert (got[5:7] == index.of_queries(vectors)[5:7]).all() and all(len(np.unique(x)) == 2048 for x in got[0])


def test_calls_of_few_queries_and_pairs_find_the_same(spark, monkeypatch):
    rnd = np.random.default_rng(8)
    rows = frame(spark, [(i, v.tolist()) for i, v in enumerate(rnd.standard_normal((900, 6)))])
    index = neighbours.Index(6, 4, 3, 1.5, 20, 9.0)
    want = sorted(neighbours.search(rows, 5, 7, index).collect())
    assert len(want) == 180 * 7
    for name, n in (("ASKING", 50), ("MEETING", 300), ("TOGETHER", 200), ("WIDE", 4)):
        monkeypatch.setattr(neighbours, name, n)
    assert sorted(neighbours.search(rows, 5, 7, index).collect()) == want

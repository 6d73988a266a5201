from __future__ import annotations

import random
import re

import numpy as np
import pytest

from waybook.llm import graph, jaccard
from waybook.sources.scratch import folder


def brute(rows, percent=75, width=5):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    known = [i for i, (d, _) in enumerate(rows) if d is not None and sets[i]]
    for x, i in enumerate(known):
        for j in known[:x]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i in known:
        least[find(i)] = min(least.get(find(i), 1 << 60), rows[i][0])
    return sorted(((d, len(s), least[find(i)] if i in set(known) else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, n=160):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(300)]
    texts = []
    for _ in range(n):
        kind = rnd.random()
        if kind < 0.35 or not texts:
            texts.append(" ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 3, 5, 6, 9, 15, 40, 120, 400]))))
        elif kind < 0.45:
            texts.append(rnd.choice(texts).upper().replace(" ", "\n\t"))
        else:
            words = rnd.choice(texts).split()
            for _ in range(rnd.randint(0, 1 + len(words) // 25)):
                at = rnd.randrange(len(words))
                if rnd.random() < 0.5:
                    words[at] = rnd.choice(vocabulary)
                elif rnd.random() < 0.5:
                    words.insert(at, rnd.choice(vocabulary))
                elif len(words) > 1:
                    del words[at]
            texts.append(" ".join(words))
    ids = rnd.sample(range(10_000), n)
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed):
    rows = corpus(seed)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).drop("text_hash").collect()
    want = brute(rows)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert len({r[2] for r in want}) < len(rows) - 20


def test_nulls_ties_repeats_and_extra_columns(spark):
    text = " ".join(f"a{i}" for i in range(60))
    rows = [(None, text), (3, text), (3, text), (1, text + " end"), (4, None), (5, " \n"), (6, "one"), (7, "ONE"), (None, None), (3, "other words here"), (8, "x " * 3000 + "y")]
    df = spark.createDataFrame([(*r, 0, "s") for r in rows], "doc_id long, text string, sig long, component string")
    got = jaccard.join(df).drop("text_hash").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_similar_texts_under_one_id(spark):
    def changed(words, *places):
        return [f"new{i}" if i in places else w for i, w in enumerate(words)]

    rows = []
    for k in (0, 100):  # A and B have one id; A leads by ever longer texts to X, which has the smallest id and meets neither
        words = [f"a{k}x{i}" for i in range(900)]
        rows += [(k + 5, " ".join(words[:100])), (k + 5, " ".join(changed(words[:100], 30, 60)))]
        sizes = [int(100 * 1.25**step) for step in range(1, 9)]
        rows += [(k + 3 if n == sizes[-1] else k + 10 + n, " ".join(words[:n])) for n in sizes]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).drop("text_hash").collect()
    want = brute(rows)
    assert {r[2] for r in want} == {3, 103}
    assert sorted((tuple(r) for r in got), key=str) == want


def test_empty(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("percent", [60, 75, 90])
def test_signatures_of_similar_sets_meet(percent):
    rnd = random.Random(percent)
    for _ in range(400):
        n = rnd.choice([2, 3, 4, 6, 7, 9, 14, 30, 100, 333, 700])
        base = [rnd.getrandbits(64) for _ in range(2 * n)]
        x, y = base[:n], base[:n]
        for _ in range(n):
            z = list(y)
            z.pop(rnd.randrange(len(z))) if rnd.random() < 0.5 and len(z) > 1 else z.append(rnd.getrandbits(64))
            both = len(set(x) & set(z))
            if 100 * both < percent * (len(x) + len(z) - both):
                break
            y = z
        if set(x) != set(y):
            a, b = (jaccard.signatures(np.unique(np.array(s, np.uint64)), percent) for s in (x, y))
            assert len(np.intersect1d(a, b)), (n, len(y))


def test_allocation_has_enough_units():
    for percent in (60, 75, 90):
        for _, hi in jaccard.bands()[:30]:
            a, b = jaccard.allocation(hi, percent)
            assert 2 * a + b > jaccard.differences(hi - 1, hi - 1, percent)


def near_copies(seed, n, words=60):
    """A text with the smallest id, and n near copies of each other that share a quarter of its shingles."""
    rnd = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    rows = [(0, " ".join(base[: words // 3] + [f"h{i}" for i in range(words)]))]
    for i in range(n):
        copy = list(base)
        copy[rnd.randrange(words // 3 + 5, words)] = f"c{i}"
        rows.append((10 + i, " ".join(copy)))
    return rows


def test_links_are_not_many_more_than_classes(spark):
    rows = near_copies(1, 2000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    _, classes, links = jaccard.classified(docs, 75, 5)
    assert classes.count() == 2001 and links.count() <= 2 * 2001
    found = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs).collect()}
    assert found[0] == 0 and {found[d] for d, _ in rows[1:]} == {10}


@pytest.mark.parametrize("percent", [60, 75])
def test_blocks_of_clusters(spark, monkeypatch, percent):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "TOGETHER", 20)
    monkeypatch.setattr(jaccard, "HOT", 5)
    rows = near_copies(2, 40, 30) + [(1000 + d, t) for d, t in corpus(3, 90)]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), percent).drop("text_hash").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, percent)


def test_percent_of_half_or_less_is_refused(spark):
    with pytest.raises(ValueError, match="above 50"):
        jaccard.join(spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string"), percent=50)


def test_components_send_no_table_to_the_driver(spark, monkeypatch):
    plans, write = [], graph.stage

    def kept(df, *how):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *how)

    monkeypatch.setattr(graph, "stage", kept)
    links = spark.createDataFrame([(i, i + 1) for i in range(20) if i != 12] + [(40, 3), (40, 3), (None, 7), (8, 8)], "a long, b long")
    links.write.parquet(path := folder(spark, "test"))
    got = {r.node: r.component for r in graph.components(spark.read.parquet(path)).collect() if r.node is not None}
    assert got == {i: 0 if i <= 12 or i == 40 else 13 for i in [*range(21), 40]}
    assert any("SortMergeJoin" in x for x in plans) and not any("Broadcast" in x for x in plans)

"""Many markers in one pass, against a plain search and against the join."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from waybook.operators import audit, markers

TEXTS = "k long, t string, contaminated_by string"


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["a", "the", "é", "zebra", "Füße", "日本", "x\ny", "the the", "0", "longer-than-eight"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 4, 30]))) for _ in range(n)]
    found = [t[i : i + rng.choice([1, 2, 7, 8, 9, 40])] for t in texts if t for i in [rng.randrange(len(t))]]
    return [*texts, None, ""], [*found[:50], found[0], "nowhere", "the the the the the the the", "zebra zebr", "é"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_index_finds_what_a_search_finds(monkeypatch, seed):
    monkeypatch.setattr(markers, "PIECE", 13)
    texts, many = corpus(seed)
    many = [*many, ""] if seed == 2 else many
    got = markers.Index([m.encode() for m in many]).found(pa.array(texts).slice(3))
    assert got == [{i for i, m in enumerate(many) if t is not None and m in t} for t in texts[3:]]
    assert markers.Index([]).found(pa.array(texts)) == [set()] * len(texts)
    assert markers.Index([b"a"]).found(pa.array([], pa.string())) == []


def test_pass_and_join_agree(spark, monkeypatch):
    texts, many = corpus(4)
    df = spark.createDataFrame([(i // 2, t, "x") for i, t in enumerate(texts)], TEXTS).repartition(3)
    names = spark.createDataFrame([*((f"m{i}", m) for i, m in enumerate(many)), ("none", None)], "item string, marker string")
    one = audit.containing(df, "k", "t", names, "item", "marker")
    flags = audit.contaminated_by(df, "k", "t", names, "item", "marker")
    plan = one._jdf.queryExecution().executedPlan().toString() + flags._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and plan.count("MapInArrow") == 2
    want = sorted((i // 2, f"m{j}") for i, t in enumerate(texts) for j, m in enumerate(many) if t is not None and m in t)
    assert sorted(tuple(r) for r in one.collect()) == want
    flagged = sorted(((r["k"], r["t"], r["contaminated"]) for r in flags.collect()), key=str)
    assert flagged == sorted(((i // 2, t, t is not None and any(m in t for m in many)) for i, t in enumerate(texts)), key=str)
    assert flags.columns == [*df.columns, "contaminated"]
    monkeypatch.setattr(markers, "LARGEST", 0)
    own = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], TEXTS).repartition(3)
    joined = audit.containing(own, "k", "t", names, "item", "marker")
    assert "MapInArrow" not in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in joined.collect()) == sorted((i, f"m{j}") for i, t in enumerate(texts) for j, m in enumerate(many) if t is not None and m in t)

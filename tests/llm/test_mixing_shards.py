from __future__ import annotations

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from waybook.llm import mixing, shards

KIND = "doc_id long, text string, source string, copies int, _source string"


def corpus(n=3000):
    rnd = random.Random(3)
    return [(i, " ".join(["w"] * rnd.randint(1, 40)), f"s{min(int(rnd.expovariate(0.8)), 5)}", 0, "x") for i in range(n)]


def shares(weights):
    return [r["weight"] for r in weights.collect()]


def test_repeats_meet_the_limit_and_every_document_stays(spark):
    df = spark.createDataFrame(corpus(), KIND)
    made, weights = mixing.mixture(df, repeats=3.0)
    by = {r["source"]: r for r in weights.collect()}
    passes = {s: r["quota"] / r["tokens"] for s, r in by.items()}
    assert math.isclose(max(passes.values()), 3.0, rel_tol=1e-6) and math.isclose(min(passes.values()), 1.0, rel_tol=1e-6)
    assert math.isclose(sum(shares(weights)), 1.0)
    rows = made.collect()
    assert len(rows) == 3000 and min(r["copies"] for r in rows) == 1
    longest = max(r["n_tokens"] for r in rows)
    for source, r in by.items():
        used = sum(x["copies"] * x["n_tokens"] for x in rows if x["source"] == source)
        assert r["quota"] - 1e-3 - 1 <= used <= r["quota"] + longest


def test_entropy_target(spark):
    df = spark.createDataFrame(corpus(), KIND)
    rows = df.select("source", F.size(F.split("text", " ")).alias("n_tokens"))
    by_source = mixing.sources(rows)
    n = by_source.count()
    start = [r["tokens"] for r in by_source.collect()]
    entropy = lambda p: -sum(x * math.log(x) for x in p) / math.log(n)
    natural = entropy([x / sum(start) for x in start])
    target = (1 + natural) / 2
    x = mixing.exponent(by_source, entropy=target)
    z = sum(t**x for t in start)
    assert math.isclose(entropy([t**x / z for t in start]), target, rel_tol=1e-6)
    assert mixing.exponent(by_source, entropy=0.0) > 1 - 1e-6  # met as it is


def test_budget(spark):
    df = spark.createDataFrame(corpus(), KIND)
    made, weights = mixing.mixture(df, repeats=2.0, budget=5000.0)
    assert math.isclose(sum(r["quota"] for r in weights.collect()), 5000)
    used = made.agg(F.sum(F.col("copies") * F.col("n_tokens"))).first()[0]
    assert 5000 - 6 <= used <= 5000 + 6 * 40


def test_mixed_keeps_odd_rows(spark):
    rows = [(1, "a b", "x", 0, "c"), (1, "a b", "x", 0, "c"), (1, "other", "x", 0, "c"), (2, None, "x", 0, "c"), (3, "", None, 0, "c"), (4, "w " * 5000, None, 0, "c"), (None, "d e", "y", 0, "c"), (5, None, "z", 0, "c")]
    df = spark.createDataFrame(rows, KIND)
    got = mixing.mixed(df, repeats=1.0)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
    assert mixing.mixed(df.limit(0), repeats=2.0).collect() == []


def test_native(spark):
    df = spark.createDataFrame(corpus(50), KIND)
    for made in (mixing.mixed(df, repeats=2.0), shards.balanced(df, 4)):
        plan = made._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("n", [1, 7, 2000])
def test_shards(spark, n):
    rnd = random.Random(n)
    rows = [(rnd.choice([None, i, i, 5]), rnd.choice([None, "", "é" * rnd.randint(1, 300), "t"]), "s", i, "y") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, shard string").repartition(5)
    got = shards.balanced(df, 24, carry=["source"]).collect()
    size = lambda t: len((t or "").encode()) + 8
    want = sorted(((d, size(t), zlib.crc32((t or "").encode()), "s") for d, t, *_ in rows), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"], r["source"]) for r in got), key=str) == want
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in order]
    assert ids == sorted(ids)
    total, before = sum(r["size"] for r in got), 0
    for r in order:  # the middle of a row lies in its shard's part
        assert r["shard"] == min(23, (2 * before + r["size"]) * 24 // (2 * total))
        before += r["size"]
    for s in {r["shard"] for r in got}:
        assert [r["slot"] for r in order if r["shard"] == s] == list(range(sum(r["shard"] == s for r in got)))


def test_shards_of_nothing(spark):
    assert shards.balanced(spark.createDataFrame([], "doc_id long, text string"), 24).collect() == []

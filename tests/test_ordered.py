"""Ordered operators against plain Python, with segments far smaller than the data and one hot key."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from waybook.operators import context, ordered, plan


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [
        (0 if rng.random() < 0.4 else rng.randrange(1, 30), i, rng.choice([None, 1, 2, 3]), rng.choice(["a", "b", "c"]), rng.randrange(8))
        for i in rng.sample(range(-300, 3000), 900)
    ]
    spark.createDataFrame(data, "k int, pos long, v int, s string, n int").createOrReplaceTempView("ordered_rows")
    return data


def by_key(data):
    keys = {}
    for r in sorted(data, key=lambda r: r[1]):
        keys.setdefault(r[0], []).append(r)
    return keys


@pytest.mark.parametrize("width", [60, 200, 1 << 20])
def test_running(spark, rows, width):
    df = spark.table("ordered_rows")
    out = ordered.running(df, ["k"], "pos", sums={"before": F.col("n")}, lasts={"prev": F.col("v")}, width=width)
    got = {(r["k"], r["pos"]): (r["before"], r["prev"]) for r in out.collect()}
    want = {}
    for k, rs in by_key(rows).items():
        total, last = 0, None
        for _, pos, v, _, n in rs:
            want[k, pos] = (total, last)
            total, last = total + n, v if v is not None else last
    assert got == want


@pytest.mark.parametrize("width", [60, 300, 1 << 20])
def test_indexed(spark, rows, width):
    out = ordered.indexed(spark.table("ordered_rows"), "pos", width=width)
    assert sorted((r["index"], r["pos"]) for r in out.collect()) == list(enumerate(sorted(r[1] for r in rows)))


def test_shards_and_head_partition_the_rows(spark, rows):
    df = spark.table("ordered_rows")
    ordered_positions = sorted(r[1] for r in rows)
    shards = [[r["pos"] for r in plan.shard(df, "pos", i, 3).collect()] for i in range(3)]
    assert [sorted(s) for s in shards] == [ordered_positions[i::3] for i in range(3)]
    assert sorted(r["pos"] for r in plan.head(df, "pos", 5).collect()) == ordered_positions[:5]
    assert plan.head(df, "pos", 0).count() == len(rows)


def test_sparse_orders_are_cut_by_rank(spark):
    """A third of the rows under one key, microsecond times as order: no range holds more than a segment."""
    rows = [(0 if i % 3 == 0 else i, 1_700_000_000_000_000 + i * i * 977, i) for i in range(6000)]
    df = spark.createDataFrame(rows, "k long, at long, n long")
    cut = ordered.segmented(df, ["k"], "at", width=500)
    assert max(r["count"] for r in cut.groupBy("_seg").count().collect()) <= 500
    out = ordered.running(cut, ["k"], "at", sums={"before": F.col("n")}, ahead=True)
    got = {r["at"]: r["before"] for r in out.where("k = 0").collect()}
    later = 0
    for k, at, n in sorted((r for r in rows if r[0] == 0), key=lambda r: -r[1]):
        assert got[at] == later
        later += n


def test_percentiles_of_close_values(spark):
    df = spark.range(3000).selectExpr("id * 1e-8 AS x")
    got = {r["p"]: r["value"] for r in ordered.index_percentiles(df, "x", [0.1, 0.5, 0.99], width=200).collect()}
    assert got == {p: pytest.approx(int(3000 * p) * 1e-8) for p in (0.1, 0.5, 0.99)}


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [3.0] * 10, [float(i) for i in range(100)], [-2.5, 0.0, 1e-9, 1e9, 7.25, 7.25, 7.5]])
def test_index_percentiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    points = [0.0, 0.5, 0.9, 0.99, 1.0]
    got = {r["p"]: r["value"] for r in ordered.index_percentiles(df, "x", points).collect()}
    s = sorted(values)
    assert got == {p: s[min(int(len(s) * p), len(s) - 1)] for p in points}


def test_last_per_key_and_unique(spark, rows):
    df = spark.table("ordered_rows")
    got = {r["k"]: (r["pos"], r["v"], r["s"]) for r in ordered.last_per_key(df, ["k"], ["pos"]).collect()}
    assert got == {k: rs[-1][1:4] for k, rs in by_key(rows).items()}
    assert plan.require_unique(df, ["pos"]).count() == len(rows)
    with pytest.raises(Exception, match="duplicate key"):
        plan.require_unique(df, ["k"]).collect()


def test_lookup_keeps_every_row_of_a_hot_key(spark, rows):
    df = spark.table("ordered_rows")
    table = spark.createDataFrame([(0, "hot"), (1, "one")], "k int, name string")
    out = ordered.lookup(df, table, ["k"], ["pos"], width=100)
    assert out.count() == len(rows)
    assert out.where("name = 'hot'").count() == sum(r[0] == 0 for r in rows)
    assert ordered.lookup(df, table, ["k"], ["pos"], "left_anti", width=100).count() == sum(r[0] > 1 for r in rows)


@pytest.mark.parametrize("keep", [-1, 0, 1, 3, 10_000])
def test_keep_last(spark, rows, keep):
    df = spark.table("ordered_rows").select("k", "pos", "s", F.col("pos").cast("string").alias("content"))
    out = context.keep_last(df, ["k"], "pos", F.col("s") == "a", keep, width=120)
    got = {(r["k"], r["pos"]): r["content"] for r in out.collect()}
    for k, rs in by_key(rows).items():
        results = [r[1] for r in rs if r[3] == "a"]
        kept = set(results if keep == -1 else results[-keep:] if keep else [])
        for r in rs:
            omitted = r[3] == "a" and r[1] not in kept
            assert got[k, r[1]] == ("Tool result is omitted to save tokens." if omitted else str(r[1]))
    again = context.keep_last(out, ["k"], "pos", F.col("s") == "a", keep, width=120)
    assert sorted(again.collect()) == sorted(out.collect())


def test_repeated_ignores_failed_uses(spark):
    df = spark.createDataFrame(
        [("t", 1, "x", False), ("t", 2, "x", True), ("t", 3, "x", True), ("t", 4, None, True), ("t", 5, None, True), ("u", 6, "x", True)],
        "traj string, seq long, key string, ok boolean",
    )
    out = context.repeated(df, ["traj"], "seq", F.col("key"), F.col("ok"), width=2)
    assert [r["repeated"] for r in out.orderBy("seq").collect()] == [False, False, True, False, False, False]


def steps_by_hand(faults):
    out, count, ended = [], 0, False
    for f in faults:
        if ended:
            out.append("after_end")
        elif f is None:
            count = 0
            out.append("kept")
        elif count < 4:
            count += 1
            out.append("rolled_back")
        elif f == "repeat":
            count = 0
            out.append("error_row")
        else:
            ended = True
            out.append("end")
    return out


@pytest.mark.parametrize("width", [30, 1 << 20])
def test_bad_steps(spark, width):
    rng = random.Random(3)
    runs = {t: [rng.choices([None, "repeat", "tags"], [1, 6, 2])[0] for _ in range(40)] for t in range(12)}
    data = [(t, i, f) for t, fs in runs.items() for i, f in enumerate(fs)]
    df = spark.createDataFrame(data, "traj int, step long, fault string")
    out = context.bad_steps(df, ["traj"], "step", F.col("fault"), width=width)
    got = {(r["traj"], r["step"]): r["action"] for r in out.collect()}
    assert got == {(t, i): a for t, fs in runs.items() for i, a in enumerate(steps_by_hand(fs))}


def test_plan_is_done_plus_pending(spark):
    questions = spark.createDataFrame([(f"q{i}",) for i in range(5)], "qid string")
    planned = plan.expand(questions, 3)
    done = spark.createDataFrame([("q0", 0), ("q0", 0), ("q4", 2), ("other", 1)], "qid string, traj_idx int")
    left = plan.pending(planned, done, ["qid", "traj_idx"])
    assert left.count() == 13
    assert left.unionByName(done).distinct().count() == 16


def test_links(spark):
    calls = spark.createDataFrame(
        [
            ("t", 1, "search", None, None, 1), ("t", 2, "open", None, "1", 2), ("t", 3, "open", None, "1", None),
            ("t", 4, "open", 1, "2", None), ("t", 5, "open", -1, '"https://x.org"', 3), ("t", 6, "open", 1, '"1"', None),
            ("t", 7, "search", None, None, 4), ("t", 8, "open", 0, "9", None), ("t", 9, "open", 4, "-1", None), ("t", 10, "open", 4, "1.0", None), ("u", 1, "open", None, "1", None),
        ],
        "traj string, seq long, op string, cursor long, id string, new_cursor long",
    )
    results = spark.createDataFrame([("t", 1, 1, "a"), ("t", 1, 2, "b"), ("t", 4, 1, "c")], "traj string, cursor long, id long, url string")
    out = context.resolve_links(calls, results, ["traj"], "seq", width=2).orderBy("traj", "seq").collect()
    assert [(r["traj"], r["seq"], r["url"], r["not_found"]) for r in out] == [
        ("t", 2, "a", False), ("t", 3, None, True), ("t", 4, "b", False), ("t", 5, "https://x.org", False), ("t", 6, None, True),
        ("t", 8, None, True), ("t", 10, "c", False), ("u", 1, None, True),
    ]


def test_budget(spark):
    df = spark.createDataFrame([(100,), (700,), (800,), (990,), (936,)], "p int")
    got = [tuple(r["b"]) for r in df.select("p", context.budget(F.col("p"), 400, 1000).alias("b")).collect()]
    assert got == [(400, False, False), (236, True, False), (136, True, False), (-54, True, True), (0, True, True)]


def test_narrow_ranges_share_tasks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "FEW", 1)
    made = ordered.segmented(spark.range(20_000).selectExpr("id % 3 AS k", "id * 7 % 20000 AS pos"), ["k"], "pos", width=10)
    assert len(made.inputFiles()) <= 4  # the shuffle partitions of these tests
    ranges = made.groupBy("_seg").agg(F.count("*").alias("n"), F.min(F.struct("k", "pos")).alias("a"), F.max(F.struct("k", "pos")).alias("z")).orderBy("_seg").collect()
    assert max(r["n"] for r in ranges) <= 10 and sum(r["n"] for r in ranges) == 20_000
    assert all(x["z"] < y["a"] for x, y in zip(ranges, ranges[1:]))

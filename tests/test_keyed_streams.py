"""Keyed streaming state against the batch answers, with files in any order of time."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from waybook.operators import report, score
from waybook.streaming import keyed, streams
from waybook.streaming.buckets import Buckets

T0 = datetime(2024, 1, 1)
BEATS = "worker_id bigint, seq bigint, ts timestamp, kind string, status string"


def beats(seed, n=600, workers=7):
    """Distinct times, one hot worker, silences around the timeout of 120 seconds."""
    rng, at, rows = random.Random(seed), dict.fromkeys(range(workers), 0.0), []
    for seq in range(n):
        w = 0 if rng.random() < 0.4 else rng.randrange(workers)
        at[w] += rng.choice([1, 30, 119.5, 120, 120.000001, 121, 500])
        status = rng.choice([None, "READY", "LOADING", "OFFLINE"])
        rows.append((w, seq, T0 + timedelta(seconds=at[w]), "register" if rng.random() < 0.15 else "heartbeat", status))
    return rows


def files(spark, rows, path, parts, shuffle=True):
    """One file after the other, rows dealt to them at random or in order of time."""
    rows = sorted(rows, key=lambda r: r[2])
    if shuffle:
        random.Random(5).shuffle(rows)
    for i in range(parts):
        part = rows[i * len(rows) // parts : (i + 1) * len(rows) // parts]
        spark.createDataFrame(part, BEATS).coalesce(1).write.mode("append").parquet(str(path))
    return streams.growing_log(spark, str(path), BEATS, 1, fmt="parquet")


def spans_of(events):
    """What the batch liveness says, per span of its events."""
    out = {}
    by_worker = {}
    for r in sorted(events, key=lambda r: r["ts"]):
        by_worker.setdefault(r["worker_id"], []).append(r)
    for worker, rows in by_worker.items():
        first = None
        for prev, r in zip([None, *rows], rows):
            if prev is None or r["ts"] - prev["ts"] > timedelta(seconds=120):
                first = r["ts"]
            s = out.setdefault((worker, first), [0, 0, None])
            s[0], s[1], s[2] = s[0] + r["accepted"], s[1] + 1, r["ts"]
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize(("seed", "parts"), [(1, 1), (2, 6)])
def test_spans_equal_the_batch_for_any_arrival(spark, tmp_path, seed, parts):
    rows = beats(seed)
    log = files(spark, rows, tmp_path / "in", parts)
    keyed.worker_spans(log, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = keyed.current_spans(spark, str(tmp_path / "out")).collect()
    batch = report.liveness(spark.createDataFrame(rows, BEATS), "seq").collect()
    assert {(r["worker_id"], r["first_seen"]): (r["accepted"], r["events"], r["last_seen"]) for r in got} == spans_of(batch)
    lives = report.worker_lives(spark.createDataFrame(rows, BEATS), "seq")
    key = lambda df: {(r["worker_id"], r["first_seen"], r["registered"], r["offline_at"]) for r in df}
    assert key(got) == key(lives.collect())
    offline = {(r["worker_id"], r["offline_at"]) for r in batch if r["offline_at"]}
    assert offline <= {(r["worker_id"], r["offline_at"]) for r in got}
    assert not any(r["closed"] for r in got)


def test_a_batch_writes_what_it_changed(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    first = [(1, 0, at(0), "heartbeat", None), (1, 1, at(300), "register", None), (2, 2, at(0), "register", None)]
    bridge = [(1, 3, at(-10), "register", None), (1, 4, at(100), "heartbeat", None), (1, 5, at(200), "heartbeat", None)]
    for rows in (first, bridge):
        spark.createDataFrame(rows, BEATS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        log = streams.growing_log(spark, str(tmp_path / "in"), BEATS, fmt="parquet")
        keyed.worker_spans(log, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    written = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r["worker_id"] for r in written if r["epoch"] == 1} == {1}
    assert sum(r["gone"] for r in written) == 2
    got = keyed.current_spans(spark, str(tmp_path / "out")).where("worker_id = 1").collect()
    # the late registration accepts the heartbeat that had been rejected, and one span is left of two
    assert [(r["first_seen"], r["last_seen"], r["accepted"], r["events"]) for r in got] == [(at(-10), at(300), 5, 5)]


def test_settled_spans_are_closed_and_leave_the_state(spark, tmp_path):
    rows = [r for r in beats(3) if r[0] < 3]
    log = files(spark, rows, tmp_path / "in", 5, shuffle=False)
    keyed.worker_spans(log, str(tmp_path / "out"), str(tmp_path / "state"), lateness="1 second").awaitTermination()
    got = keyed.current_spans(spark, str(tmp_path / "out")).collect()
    batch = report.liveness(spark.createDataFrame(rows, BEATS), "seq").collect()
    assert {(r["worker_id"], r["first_seen"]): (r["accepted"], r["events"], r["last_seen"]) for r in got} == spans_of(batch)
    end = max(r[2] for r in rows)
    for r in got:
        assert r["closed"] or r["last_seen"] > end - timedelta(seconds=122)
    assert sum(r["closed"] for r in got) > 20


def test_changes_equal_the_batch_for_any_arrival(spark, tmp_path):
    rows = beats(4)
    want = {(r["worker_id"], r["seq"], r["old_status"], r["status"]) for r in report.status_changes(spark.createDataFrame(rows, BEATS), ["worker_id"], "seq").collect()}
    log = files(spark, rows, tmp_path / "in", 5)
    keyed.status_changes(log, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {tuple(r) for r in keyed.current_changes(spark, str(tmp_path / "out")).collect()} == want
    assert spark.read.parquet(str(tmp_path / "out")).where("gone").count() > 0
    log = files(spark, rows, tmp_path / "in2", 5, shuffle=False)
    keyed.status_changes(log, str(tmp_path / "out2"), str(tmp_path / "state2"), lateness="0 seconds").awaitTermination()
    assert {tuple(r) for r in keyed.current_changes(spark, str(tmp_path / "out2")).collect()} == want


def test_nodes_over_spans(spark, tmp_path):
    rows = beats(6, workers=9)
    log = files(spark, rows, tmp_path / "in", 4)
    keyed.worker_spans(log, str(tmp_path / "spans"), str(tmp_path / "s1")).awaitTermination()
    schema = "worker_id bigint, first_us bigint, last_us bigint, registered_us bigint, accepted bigint, events bigint, gone boolean, closed boolean"
    spans = streams.growing_log(spark, f"{tmp_path}/spans/*", schema, 1, fmt="parquet")
    node = F.concat(F.lit("n"), (F.col("worker_id") % 4).cast("string"))
    keyed.node_lives(spans.withColumn("node_id", node), str(tmp_path / "nodes"), str(tmp_path / "s2")).awaitTermination()
    lives = report.worker_lives(spark.createDataFrame(rows, BEATS), "seq").collect()
    latest = {}
    for r in sorted(lives, key=lambda r: r["last_seen"]):
        latest[r["worker_id"]] = r["offline_at"]
    for seconds in (0, 2000, 6000, 10**7):
        end = T0 + timedelta(seconds=seconds)
        want = {}
        for w, offline in latest.items():
            n, failed = want.get(f"n{w % 4}", (0, True))
            want[f"n{w % 4}"] = (n + 1, failed and (offline is None or offline < end))
        us = spark.createDataFrame([(end,)], "t timestamp").select(F.unix_micros("t")).first()[0]
        got = keyed.failed_nodes(spark, str(tmp_path / "nodes"), us).collect()
        assert {r["node_id"]: (r["workers"], r["failed"]) for r in got} == want


def test_fleet_and_nodes(spark, tmp_path):
    rows = [r for r in beats(7) if r[4]]
    df = spark.createDataFrame(rows, BEATS)
    log = files(spark, rows, tmp_path / "in", 4)
    keyed.latest_statuses(log, "worker_id", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert keyed.fleet(spark, str(tmp_path / "out")).collect() == report.fleet(df, ["seq"]).collect()
    of = {"READY": "RUNNING", "LOADING": "PENDING", "OFFLINE": "FAILED"}
    renamed = lambda d: d.replace(of, subset=["status"]).withColumnRenamed("worker_id", "node_id")
    keyed.latest_statuses(renamed(files(spark, rows, tmp_path / "in2", 3)), "node_id", str(tmp_path / "out2"), str(tmp_path / "state2")).awaitTermination()
    assert keyed.nodes(spark, str(tmp_path / "out2")).collect() == report.nodes(renamed(df), ["seq"]).collect()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_accuracy_is_revised_by_an_earlier_reference(spark, tmp_path):
    rng, schema = random.Random(8), "qid string, traj_idx bigint, reference_answer string, answer string"
    refs, answers = ["Par is", "paris", "", None, "Rome", "12,000"], ["It is PARIS.", "rome", "", None, "12000", "r", "a, b"]
    rows = [(rng.choice(["hot", f"q{i % 9}"]), i, rng.choice(refs), rng.choice(answers)) for i in range(200)]
    parts = [sorted(rows, key=lambda r: -r[1])[i::3] for i in range(3)]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        log = streams.growing_log(spark, str(tmp_path / "in"), schema, fmt="parquet")
        keyed.accuracy_deltas(log, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        seen = spark.read.schema(schema).parquet(str(tmp_path / "in"))
        want = score.summary(score.loose_accuracy(seen, "qid", "traj_idx", "reference_answer", "answer", ["traj_idx"])[1]).drop("avg_at_k").first()
        got = keyed.accuracy(spark, str(tmp_path / "out")).first()
        assert got.asDict() == want.asDict()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3  # one row per batch


def test_bucketed_table(spark, tmp_path):
    schema, rng = "qid string, at bigint, v string", random.Random(9)
    records = Buckets(str(tmp_path / "table"), schema, ["qid"], ["at"], 8)
    want = {}
    assert records.current(spark).collect() == []
    for batch in range(6):
        rows = [(rng.choice([None, *(f"k{i}" for i in range(40))]), rng.randrange(50), f"{batch}:{i}") for i in range(30 if batch % 2 else 3)]
        rows = list({(r[0], r[1]): r for r in rows}.values())
        for qid, at, v in rows:
            if qid not in want or at >= want[qid][0]:
                want[qid] = (at, v)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        records.upsert(streams.growing_log(spark, str(tmp_path / "in"), schema), str(tmp_path / "state")).awaitTermination()
        if batch == 3:
            before = records.runs(spark)[0]
            full = records.compact(spark, 2)
            after, hidden = records.runs(spark)
            assert full == sorted(b for b, f in before.items() if len(f) > 2) and 0 < len(full) < len(before)
            assert all(len(after[b]) == 1 for b in full) and all(after[b] == before[b] for b in after if b not in full)
            assert len(hidden) == sum(len(before[b]) for b in full)
    assert {r["qid"]: (r["at"], r["v"]) for r in records.current(spark).collect()} == want
    records.compact(spark, 0)
    assert {r["qid"]: (r["at"], r["v"]) for r in records.current(spark).collect()} == want
    keys = spark.createDataFrame([("k1",), ("nobody",)], "qid string")
    one = records.get(keys)
    assert [tuple(r) for r in one.collect()] == [("k1", *want["k1"])]
    asked = {r[0] for r in keys.select(records._bucket()).collect()}
    folders = {f.rsplit("/", 2)[1] for f in one.inputFiles() if "/table/" in f}
    assert folders <= {f"bucket={b}" for b in asked} and len(records.runs(spark)[0]) > len(folders)

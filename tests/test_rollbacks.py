"""Replayed step logs against a plain loop, whole and in ranges far smaller than a trajectory."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from waybook.operators import rollbacks

SCHEMA = "k string, n long, pos long, fault string, calls array<struct<key:string,ok:boolean>>, action string"


def plain(log, most=5):
    """One trajectory, step by step."""
    rolled, used, over, out = 0, set(), False, []
    for fault, calls in log:
        if over:
            out.append(("after_end", most, ["not_made"] * len(calls)))
            continue
        if fault:
            if fault != "final" and rolled + 1 < most:
                rolled += 1
                out.append(("rolled_back", rolled, []))
            else:
                over = True
                out.append(("final" if fault == "final" else "end", most, []))
            continue
        did = []
        for key, ok in calls:
            if key in used and key is not None:
                if rolled + 1 < most:
                    rolled += 1
                    did.append("repeat")
                    break
                rolled = 0
                did.append("error_line")
            else:
                did.append("made")
                if ok:
                    used.add(key)
        if "repeat" in did:
            out.append(("rolled_back", rolled, did + ["not_made"] * (len(calls) - len(did))))
        else:
            rolled = 0
            out.append(("kept", 0, did))
    return out


def steps(seed, n=700):
    rng, rows = random.Random(seed), {}
    for i in rng.sample(range(-500, 4000), n):
        key = ("hot", 1) if rng.random() < 0.5 else (rng.choice([None, "a", "b"]), rng.choice([None, 1, 2]))
        kind = rng.random()
        fault = "tags" if kind < 0.25 else "refusal" if kind < 0.3 else "final" if kind < 0.303 else None
        names = [None, *"stuvwxyz", *(f"q{j}" for j in range(30))]
        calls = [] if fault else [(rng.choice(names), rng.random() < 0.8) for _ in range(rng.randint(1, 4))]
        rows[*key, i] = (fault, calls)
    return rows


@pytest.mark.parametrize(("seed", "width"), [(1, 3), (2, 40), (3, 1 << 20)])
def test_same_as_a_plain_loop(spark, seed, width):
    log = steps(seed)
    df = spark.createDataFrame([(*k, f, c or None, "x") for k, (f, c) in log.items()], SCHEMA).repartition(4).drop("action")
    out = rollbacks.replayed(df, ["k", "n"], "pos", F.col("fault"), F.col("calls"), width=width)
    assert out.columns == [*df.columns, "action", "rollbacks", "made"]
    got = {(r["k"], r["n"], r["pos"]): (r["action"], r["rollbacks"], r["made"]) for r in out.collect()}
    want = {}
    for key in {k[:2] for k in log}:
        order = sorted(k for k in log if k[:2] == key) if None not in key else sorted((k for k in log if k[:2] == key), key=lambda k: k[2])
        want |= dict(zip(order, plain([log[k] for k in order]), strict=True))
    assert got == want
    assert {a for a, _, _ in got.values()} >= {"kept", "rolled_back", "after_end"}


def test_a_key_counts_as_used_only_where_its_call_was_made(spark):
    one = lambda *keys: (None, [(k, True) for k in keys])
    log = [one("a"), one("a", "b"), ("tags", []), one("b"), one("a", "c"), one("c"), ("tags", []), ("tags", []), ("tags", []), ("tags", []), one("a", "d", "a", "e"), one("d"), one("e")]
    rows = [("t", 1, i, f, c or None, "") for i, (f, c) in enumerate(log)]
    df = spark.createDataFrame(rows, SCHEMA).drop("action")
    for width in (1, 2, 100):
        out = rollbacks.replayed(df, ["k"], "pos", F.col("fault"), F.col("calls"), width=width)
        assert [(r["action"], r["rollbacks"], r["made"]) for r in sorted(out.collect(), key=lambda r: r["pos"])] == plain(log)
    # the call behind the repeat in step 1 was never made, so step 3 is no repeat; step 10 finds the counter full
    assert plain(log)[3] == ("kept", 0, ["made"]) and plain(log)[10] == ("rolled_back", 1, ["error_line", "made", "repeat", "not_made"])


def test_no_steps(spark):
    df = spark.createDataFrame([], SCHEMA).drop("action")
    assert rollbacks.replayed(df, ["k"], "pos", F.col("fault"), F.col("calls")).collect() == []


def test_faults_of_replies(spark):
    rows = [("I'm sorry, I cannot solve <arguments>", None), ("time constraint", []), ("done", None), ("<server_name>", [("k", True)])]
    df = spark.createDataFrame(rows, "t string, calls array<struct<key:string,ok:boolean>>")
    assert [r[0] for r in df.select(rollbacks.step_fault(F.col("t"), F.col("calls"))).collect()] == ["tags", "refusal", "final", None]


def test_narrow_ranges_share_calls(spark, monkeypatch):
    seen, together = [], rollbacks._together
    monkeypatch.setattr(rollbacks, "_together", lambda rows, keys, calls: seen.append(calls) or together(rows, keys, calls))
    log = spark.range(2000).selectExpr("id % 3 AS k", "id", "if(id % 4 = 0, 'tags', null) AS fault", "if(id % 4 = 0, array(), array(struct(concat('q', id % 90) AS key, id % 5 <> 0 AS ok))) AS calls")
    out = rollbacks.replayed(log, ["k"], "id", F.col("fault"), F.col("calls"), width=10)
    whole = rollbacks.replayed(log, ["k"], "id", F.col("fault"), F.col("calls"))
    assert out.exceptAll(whole).isEmpty() and whole.count() == out.count() == 2000
    assert max(seen) <= 4  # the shuffle partitions of these tests

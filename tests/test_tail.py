"""Lines appended to known files, torn lines, ranges and replaced files."""

from __future__ import annotations

import random

import pytest

from waybook.sources import tail
from waybook.streaming import streams


def drained(spark, tmp_path, **how):
    rows = tail.tailed_lines(spark, str(tmp_path / "log"), **how)
    streams.append_to(rows, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    return sorted((r["file"].rsplit("/", 1)[1], r["at"], r["line"]) for r in spark.read.schema("file string, at bigint, line string").parquet(str(tmp_path / "out")).collect())


def test_appended_lines_torn_lines_and_new_files(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "a.jsonl").write_bytes('{"n": 1}\n\n{"é": 2}\n{"to'.encode())
    first = [("a.jsonl", 0, '{"n": 1}'), ("a.jsonl", 9, ""), ("a.jsonl", 10, '{"é": 2}')]
    assert drained(spark, tmp_path, pattern="*.jsonl") == first
    assert drained(spark, tmp_path, pattern="*.jsonl") == first  # nothing new
    with open(log / "a.jsonl", "ab") as f:
        f.write(b'rn": 3}\r\n{"n": 4}\n{')
    (log / "b.jsonl").write_bytes(b"x\n")
    (log / "other.txt").write_bytes(b"no\n")
    second = [*first, ("a.jsonl", 20, '{"torn": 3}\r'), ("a.jsonl", 33, '{"n": 4}'), ("b.jsonl", 0, "x")]
    assert drained(spark, tmp_path, pattern="*.jsonl") == second
    (log / "b.jsonl").write_bytes(b"")
    (log / "a.jsonl").write_bytes(b"anew\n")  # shorter: replaced
    assert drained(spark, tmp_path, pattern="*.jsonl") == sorted([*second, ("a.jsonl", 0, "anew")])


def test_records_of_one_growing_file(spark, tmp_path):
    path = tmp_path / "one.jsonl"
    path.write_text('{"qid": "a"}\nbroken\n{"qid": "b", "n": 2}\n{"qid": ')
    made = tail.tailed_log(spark, str(path), "qid string, n int")
    for more in ("", '"c"}\n{"n": 5}\n'):
        with open(path, "a") as f:
            f.write(more)
        streams.append_to(made.select("qid", "n"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", None), ("b", 2), ("c", None)]


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_ranges_give_every_line_once(monkeypatch, tmp_path, block):
    monkeypatch.setattr(tail, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(60):
        data = b"".join(bytes(rng.choices(b"ab\xc3", k=rng.choice([0, 1, 2, 9, 30]))) + b"\n" for _ in range(rng.randrange(1, 12))) + b"torn"[: rng.randrange(5)]
        (tmp_path / "f").write_bytes(data)
        reader = tail.TailReader(str(tmp_path / "f"), "*", rng.choice([1, 3, 10, 1000]))
        end = reader.latestOffset()
        parts = reader.partitions({}, end)
        got = [(at, line) for p in parts for b in reader.read(p) for at, line in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        want, at = [], 0
        for line in data[: data.rfind(b"\n")].split(b"\n"):
            want.append((at, line.decode("utf-8", "replace")))
            at += len(line) + 1
        assert got == want and list(end.values()) == [at]
        middle = next((a for a, _ in want if a > len(data) // 2), at)
        half = [{str(tmp_path / "f"): middle}, end]
        rest = [at for p in reader.partitions(*half) for b in reader.read(p) for at in b.column(1).to_pylist()]
        assert rest == [a for a, _ in want if a >= middle]


def test_append_can_be_repeated(tmp_path):
    path = str(tmp_path / "new" / "f")
    for _ in range(2):
        tail.append(path, b"abc", 0)
    for _ in range(2):
        tail.append(path, b"def", 3)
    assert open(path, "rb").read() == b"abcdef"

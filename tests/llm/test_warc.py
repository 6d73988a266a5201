from __future__ import annotations

import gzip
import io
import zlib

import pytest

from waybook.llm import files, warc

ROWS = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (9, "http://a/9 b\r\nc", "<p>same</p>"), (3, None, None), (4, "u", ""), (5, "ü", "日本 &amp; \r\n\r\nWARC/1.1\r\n\r\n"),
    (6, "u", "x" * 3_000_000), (None, "n", "<p>same</p>"), (7, "u", "only"), (7, "u", "only"), (8, "u", "only"),
]


def brute(rows, least):
    out = []
    for number, _, html in rows:
        data = (html or "").encode()
        last = max((n for n, _, h in rows if n is not None and (h or "").encode() == data), default=None)
        revisit = number is not None and len(data) >= least and number < last
        out.append((number, len(data), warc.digest(data), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=str)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, record_type string, refers_to int")


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    got = warc.round_trip(pages(spark, ROWS).repartition(3), least).collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS, least)


def test_empty(spark):
    assert warc.round_trip(pages(spark, [])).collect() == []


def test_normalised_members_stand_alone(spark, tmp_path):
    made = warc.write(warc.deduplicated(pages(spark, ROWS)).coalesce(1), str(tmp_path / "a"))
    whole = open(made.first()["path"], "rb").read()
    stream = zlib.decompressobj(31)
    stream.decompress(whole)
    assert stream.eof and not stream.unused_data  # one member
    done = warc.normalise(made, str(tmp_path / "b")).first()
    data = open(done["path"], "rb").read()
    with files.reader(done["index"]) as index:
        places = list(warc.places(index))
    assert len(places) == done["records"] == len(ROWS)
    assert sum(n for _, n in places) == len(data)
    assert b"".join(gzip.decompress(data[a : a + n]) for a, n in places) == gzip.decompress(whole)
    payloads = {r["page_id"]: r["payload"] for r in warc.read(warc.normalise(made, str(tmp_path / "c"))).collect()}
    assert payloads[5].decode() == ROWS[5][2] and payloads[1] is None


def test_broken_archives_raise():
    data = gzip.compress(warc.record("response", "u", 1, b"abc", None, "2000") * 3)
    assert len(list(warc.records(io.BytesIO(data)))) == 3
    assert len(list(warc.records(io.BytesIO(data + data)))) == 6
    for bad in (data[:-9], gzip.compress(gzip.decompress(data)[:-7]), gzip.compress(b"text\r\n\r\n")):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(bad)))

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from waybook.llm import packing, tokens, wordids

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "Hello, World. <|startoftext|> <|STARTOFTEXT|> don't it's I'LL e.g., a.b. x..  ", None, "", " \n\t",
    "ÉCOLE École école, ΑΣ ΑΣΣ σας İstanbul ǅ ﬁ ½ x² éa É é. نص 你好。吗 你好 . , .,", "a b c d 123 4.5, 99.",
    "x" * 3000 + ", " + "é" * 500, "<|endoftext|>,a </w> b</w>. ſ ẞ ß K Å", "word " * 3000, "No end " * 900 + "! So. " * 40,
]


def plain(text):
    return tokens.encoder(PATH)([text or ""])[0]


def test_ids_are_those_of_the_library():
    words = wordids.WordIds(PATH)
    for _ in range(2):  # the second time from memory
        for ids, counts, ends in wordids.ids_of(pa.array(ODD), words):
            assert ids.tolist() == [i for t in ODD for i in plain(t)]
            assert counts.tolist() == [len(plain(t)) for t in ODD]
            assert len(ends) == 7 + 2 * 40


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(wordids, "WORDS", 40)
    words, rnd = wordids.WordIds(PATH), random.Random(3)
    for _ in range(20):
        texts = [" ".join(f"{chr(97 + rnd.randrange(26))}b{'é' * rnd.randrange(3)}{rnd.choice('.,;x')}" for _ in range(30))]
        ids, counts, _ = next(wordids.ids_of(pa.array(texts), words))
        assert ids.tolist() == plain(texts[0]) and len(words.known) <= 60


def test_files_that_do_not_cut_at_white_space(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    words = wordids.WordIds(path)
    assert not words.alone
    ids, counts, ends = next(wordids.ids_of(pa.array(["a  b", None, "c."]), words))
    assert ids.tolist() == [i for t in ("a  b", "c.") for i in tokens.encoder(path)([t])[0]] and not len(ends)


def least_cost(places, penalties, limit):
    """All windows tried."""
    place, cost = [0, *places], [0]
    for j in range(1, len(place)):
        best = 1 << 60
        for i in range(j):
            n = place[j] - place[i]
            if n <= limit:
                best = min(best, cost[i] + limit - n, cost[i] + packing.SHORT if n >= packing.LEAST and n < limit and n.bit_count() == 1 else 1 << 60)
        cost.append(best + penalties[j - 1])
    return cost[-1]


@pytest.mark.parametrize("seed", range(6))
def test_least_cost(seed):
    rnd = random.Random(seed)
    limit = rnd.choice([256, 512])
    counts = np.array([rnd.choice([1, 3, 17, 90, 128, 256, 700]) for _ in range(60)])
    sentences = np.array(sorted(rnd.sample(range(1, int(counts.sum())), 90)))
    places, penalties = packing.cuts(counts, sentences, limit)
    assert np.diff(places, prepend=0).max() <= packing.STRETCH and places[-1] == counts.sum()
    ends = packing.windows(places.tolist(), penalties.tolist(), limit)
    sizes = np.diff(ends, prepend=0)
    assert sizes.max() <= limit and ends[-1] == counts.sum() and set(ends) <= set(places.tolist())
    of = dict(zip(places.tolist(), penalties.tolist(), strict=True))
    cost = sum(of[e] + (packing.SHORT if n >= packing.LEAST and n < limit and int(n).bit_count() == 1 and packing.SHORT < limit - n else limit - n) for e, n in zip(ends, sizes.tolist(), strict=True))
    assert cost == least_cost(places.tolist(), penalties.tolist(), limit)


def check(rows, pieces, limit):
    ids = {}
    for doc, text in rows:
        ids.setdefault((doc, len(plain(text)) + 1), []).append([*plain(text), 1])
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == ids.keys()
    for key, got in by_doc.items():
        same = ids[key]
        assert sum(r["length"] for r in got) == len(same) * key[1]
        for r in got:
            crcs = {zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for x in same}
            assert r["ids_crc32"] in crcs and 0 < r["length"] <= key[1] - r["start"]
        starts = sorted(r["start"] for r in got)
        stops = sorted(r["start"] + r["length"] for r in got)
        assert starts == sorted([0] * len(same) + [s for s in stops if s < key[1]])
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for got in by_sequence.values():
        at = 0
        for r in sorted(got, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limit


def test_nulls_repeats_long_texts_and_extra_columns(spark, monkeypatch):
    rows = [(i if i != 5 else None, t) for i, t in enumerate(ODD)] + [(3, ODD[0]), (3, ODD[0]), (None, None), (2, "other.")]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, part long, sequence_id string").repartition(3)
    pieces = packing.packed(df, PATH).collect()
    check(rows, pieces, 2048)
    order = [r["doc_id"] for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"]))]
    assert order == sorted(order, key=lambda d: -1 if d is None else d)
    assert packing.packed(df.limit(0), PATH).collect() == []


def test_unpadded_windows_are_found_at_once():
    rnd = random.Random(4)
    place = np.array([0, *sorted(rnd.sample(range(1, 3000), 700))])
    lengths = [16, 64, 256]
    want = [(j, i) for j in range(len(place)) for w in lengths for i in range(j) if place[j] - place[i] == w]
    assert packing._short(place, lengths) == want and packing._short(place, []) == []


def test_runs_are_joined(monkeypatch):
    monkeypatch.setattr(packing, "RUN", 300)
    rnd = random.Random(1)
    packer, counts, out = packing.Packer(4, 128), [], []
    ids = np.arange(60_000, dtype="<u4")
    at = 0
    for k in range(200):
        n = rnd.choice([1, 2, 30, 128, 300])
        counts.append(n)
        out += packer.add(pa.array([k]), ids[at : at + n], np.array([n]), np.arange(7, n, 11))
        at += n
    out += packer.flush(True)
    rows = sorted((r for b in out for r in b.to_pylist()), key=lambda r: (r["sequence"], r["offset"]))
    begin = np.concatenate(([0], np.cumsum(counts)))
    place = 0
    for r in rows:
        assert begin[r["doc_id"]] + r["start"] == place
        assert r["ids_crc32"] == zlib.crc32(ids[place : place + r["length"]].tobytes()) and r["doc_tokens"] == counts[r["doc_id"]]
        place += r["length"]
    assert place == sum(counts)
    sizes = np.bincount([r["sequence"] for r in rows], [r["length"] for r in rows])
    assert sizes.max() <= 128 and sizes[:-1].mean() > 112


def test_little_padding_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = packing.packed(docs, PATH)
    check([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], got.collect(), 2048)
    sums = packing.padding(got).first()
    assert sums["padding"] < 0.03 * sums["tokens"]

from __future__ import annotations

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from waybook.llm import divergence

SCHEMA = "text string, lang string, source string, block long, term string, gid int"


def brute(rows, least=30, top=50):
    rows = [tuple(x or "" for x in r) for r in rows]
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        groups[lang].add(source)
        held[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = {t for t, n in held[lang].items() if n >= least}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        own = {s: share(counts[lang, s]) for s in sources}
        whole = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(abs(own[s][t] - own[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, own[s][t] - whole[t]) for t in kept if counts[lang, s][t] and own[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                order = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(order)]
    return sorted(out)


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, 3, "x", 1) for r in rows], SCHEMA).repartition(parts)


def corpus(seed, n=300):
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("", "é", "B", ",", "'s", "1", "-x", ". ", "\x1cq", " z", "ẞ", "_")]
    rows = []
    for _ in range(n):
        lang, source = rnd.choice(["en", "de", None, ""]), rnd.choice(["a", "b", "B", "é", None])
        own = words[: 40 if source == "a" else 90]
        rows.append((rnd.choice([" ", "\n\t", "  "]).join(rnd.choice(own) for _ in range(rnd.choice([0, 1, 3, 20, 60]))), lang, source))
    return rows


def test_same_as_brute_force(spark):
    rows = corpus(1)
    got = divergence.audit(frame(spark, rows), least=5, top=7).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 5, 7)
    assert {r[0] for r in got} == {"en", "de", ""}


def test_nulls_empty_texts_repeats_and_many_occurrences(spark):
    rows = [(None, "xx", "a"), ("", "xx", None), ("...", "yy", "a"), ("A,a;a " * 30_000, "en", "a"), (" a b", "en", "b"), (" a b", "en", "b"), ("b" * 100_000, "en", None), (None, None, None)]
    got = divergence.audit(frame(spark, rows, 2), least=1).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 1)
    assert ("xx", "a", "pair", "", 0, 1) in {tuple(r) for r in got}
    assert divergence.audit(frame(spark, []), least=1).collect() == []


def test_a_term_is_counted_once_for_a_document_in_any_number_of_chunks(spark):
    rows = [("Foo foo, (foo) foo-foo", "en", "a")] * 2 + [("bar", "en", "b")]
    _, names, terms = divergence.counted(frame(spark, rows, 1), 1)
    terms = terms.join(names, "tid")
    assert {r["term"]: (r["docs"], r["n"]) for r in terms.collect()} == {"foo": (2, 10), "bar": (1, 1)}


def test_blocks(monkeypatch):
    texts = ["a b a", "", "c a"]
    out = pa.Table.from_batches(list(divergence._block(9, *(pa.array(x, pa.large_string()) for x in (texts, ["y", "x", "x"], ["", "", ""])))))
    groups = out.filter(pa.compute.is_valid(out["lang"]))
    assert groups.select(["lang", "source", "docs"]).to_pylist() == [{"lang": "x", "source": "", "docs": 2}, {"lang": "y", "source": "", "docs": 1}]
    words = {r["chunk"]: r["docs"] for r in out.to_pylist() if r["chunk"]}
    assert words == {"a": 2, "b": 1, "c": 1}
    sizes, held, counts = (np.frombuffer(zlib.decompress(out[c].to_pylist()[-1]), k) for c, k in (("sizes", "<u4"), ("held", "<u2"), ("counts", "<u2")))
    held = np.cumsum(held, dtype="<u2")
    entries = np.split(np.stack((held, counts), axis=1), np.cumsum(sizes)[:-1])
    of = dict(zip([w for w in out["chunk"].to_pylist() if w is not None], entries, strict=True))
    assert {w: v.tolist() for w, v in of.items() if w} == {"a": [[1, 1], [2, 2]], "b": [[2, 1]], "c": [[1, 1]]}


def test_blocks_are_written_small(spark):
    rows = [(" ".join(f"word{i * 37 % 5000}é" for i in range(k, k + 900)), "en", "a") for k in range(0, 20_000, 400)]
    out = pa.Table.from_batches(list(divergence._block(1, *(pa.array(x, pa.large_string()) for x in zip(*rows)))))
    words = [w for w in out["chunk"].to_pylist() if w is not None]
    assert words == sorted(words, key=str.encode)
    files = [divergence.stage(divergence.chunked(frame(spark, rows, 1)), "blocks", **how).inputFiles()[0] for how in ({}, divergence.SMALL)]
    plain, small = (os.path.getsize(f.removeprefix("file://")) for f in files)
    assert small < 0.8 * plain


def test_rare_terms_go_before_the_join(spark):
    rows = [("Foo, foo", "en", "a"), ("foo bar", "en", "b"), ("foo", "de", "b")]
    _, names, terms = divergence.counted(frame(spark, rows, 3), 4)
    assert {r["term"] for r in terms.join(names, "tid").collect()} == {"foo"}  # 4 documents of its chunks, 3 of its own, 2 in a language


def test_large_counts_stay_exact(spark):
    df = spark.createDataFrame([(10**15, 10**17, 10**6)], "n long, t long, v long")
    got = df.select(divergence.share(df.n, df.t, df.v).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (10**15 + 5) // (10**17 + 5 * 10**6)


def test_many_sources_in_tiles(monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", 300)
    rnd = np.random.default_rng(2)
    n, terms = 150, 23
    base = rnd.integers(1, 50, n)
    dense = np.tile(base, (terms, 1))
    t, g = np.nonzero(rnd.random((terms, n)) < 0.2)
    dense[t, g] = rnd.integers(50, 900, len(t))
    got = divergence._differences(
        pa.table({"tid": t * 7, "gid": (g + 3).astype(np.int32), "p": dense[t, g]}), pa.table({"gid": np.arange(n, dtype=np.int32) + 3, "base": base})
    ).to_pylist()
    live = np.unique(t)
    assert len(got) == n * (n - 1)
    for r in got[::97]:
        a, b = dense[live][:, r["gid"] - 3], dense[live][:, r["other"] - 3]
        assert r["value"] == np.abs(a - b).sum()

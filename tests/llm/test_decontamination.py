from __future__ import annotations

import hashlib
import random
import re

import pytest

from waybook.llm import decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=13):
    out = []
    spans = [(i, tuple(w[s : s + min(window, len(w))])) for i, t in items if (w := words(t)) for s in range(len(w) - min(window, len(w)) + 1)]
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, span in spans:
            for s in range(len(w) - len(span) + 1):
                if tuple(w[s : s + len(span)]) == span:
                    hit.update(range(s, s + len(span)))
                    found.add(item)
        found = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def case():
    rnd = random.Random(5)
    some = [f"w{i}" for i in range(60)] + ["é日", "the", "a1"]
    text = lambda n: " ".join(rnd.choice(some) for _ in range(n))
    items = [(i, text(rnd.choice([1, 2, 3, 5, 12, 13, 14, 30]))) for i in range(20)]
    items += [(3, items[7][1]), (None, text(20)), (40, None), (41, " .,"), (42, "the"), (2, items[2][1])]
    docs = []
    for i in range(120):
        parts = [text(rnd.randint(0, 60))]
        if rnd.random() < 0.6:
            w = (rnd.choice(items)[1] or "").split()
            a = rnd.randint(0, len(w) // 2)
            parts += [" - ".join(w[a : a + rnd.randint(1, 30)]).upper(), text(rnd.randint(0, 40))]
        docs.append((i, "; ".join(parts)))
    docs += [(5, docs[5][1]), (6, "other"), (None, items[13][1]), (500, None), (501, ""), (502, (items[11][1] or "x") + " word" * 3000)]
    return docs, items


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(*d, 0, "h") for d in docs], "doc_id long, text string, hash int, words string").repartition(3),
        spark.createDataFrame([(*i, "w") for i in items], "item_id long, text string, words string"),
    )


def test_same_as_brute_force(spark, case):
    docs, items = case
    got = decontamination.contamination(*frames(spark, docs, items)).drop("text_hash").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)


def test_decontaminated_keeps_rows_and_columns(spark, case):
    docs, items = case
    df, bench = frames(spark, docs, items)
    left = decontamination.decontaminated(df, bench)
    assert left.columns == df.columns
    bad = {(d, t) for (d, t) in docs for r in brute([(d, t)], items) if r[-1]}
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted((x for x in docs if x not in bad), key=str)


def test_empty_tables(spark, case):
    docs, items = case
    none, bench = frames(spark, [], items)
    assert decontamination.contamination(none, bench).collect() == []
    df, no_items = frames(spark, docs[:5], [])
    assert all(r["n_hit"] == 0 and not r["contaminated"] for r in decontamination.contamination(df, no_items).collect())

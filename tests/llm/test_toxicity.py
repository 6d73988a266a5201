from __future__ import annotations

import pickle
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from waybook.llm import toxicity


def corpus(n=600):
    rnd = random.Random(2)
    some = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(400)] + ["the", "of", "and"] * 10
    rows = []
    for i in range(n):
        words = [rnd.choice(some) for _ in range(rnd.randint(5, 120))]
        toxic = rnd.random() < 0.2
        if toxic:
            for _ in range(rnd.randint(1, 3)):
                words.insert(rnd.randint(0, len(words)), rnd.choice(["zorp", "qwix", "vlug" + rnd.choice(some)]))
        rows.append((i, " ".join(words).upper(), "en", "s", int(toxic)))
    return rows


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus()
    odd = [(None, "the zorp qwix of", "en", "s", 0), (700, None, "en", "s", 0), (701, "", "en", "s", 0), (3, rows[3][1], "en", "s", 0), (702, "zorp " + "the word " * 20_000, "en", "s", 0)]
    docs = spark.createDataFrame([r[:4] + (0.5,) for r in rows + odd], "doc_id long, text string, lang string, source string, score double").repartition(4)
    labels = spark.createDataFrame([(r[0], 0, r[4]) for r in rows] + [(0, 0, None), (None, 0, 1), (5, 0, rows[5][4])], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {r[0]: r[4] for r in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert len(held) > 80 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (700, 701)}) == 1
    left = toxicity.accepted(docs, labels)
    assert left.columns == docs.columns
    assert left.count() == sum(1 - r["predicted"] for r in got)


def fitted_on(spark, monkeypatch, rows):
    """Labels of the texts that a model is fitted on, in order."""
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda cuts, words, labels, language, ratio: seen.append((labels.tolist(), ratio)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    toxicity.fit(docs, spark.createDataFrame([(r[0], 0, r[2]) for r in rows], "doc_id long, quality int, toxic int"))
    return seen[0]


def in_order(spark, rows):
    """Rows that are not held out, by the hash of their id."""
    kept = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    order = {r["id"]: r["h"] for r in spark.range(len(rows)).select("id", F.xxhash64("id").alias("h")).collect()}
    return sorted(kept, key=lambda r: order[r[0]])


def test_one_text_beyond_the_bytes_leaves_the_others(spark, monkeypatch):
    rows = [(i, f"the word {i}", i % 4 == 0) for i in range(300)]
    rows = [(i, t, int(toxic)) for i, t, toxic in rows]
    known = in_order(spark, rows)
    for toxic in (0, 1):
        long = next(r for r in known if r[2] == toxic)
        labels, _ = fitted_on(spark, monkeypatch, [(r[0], "word " * 1_900_000, r[2]) if r == long else r for r in rows])
        assert labels == [r[2] for r in known if r != long]


def test_long_clean_texts_leave_the_toxic_ones(spark, monkeypatch):
    rows = [(i, "the clean word " * 2000 + str(i) if i % 4 else f"zorp {i}", int(i % 4 == 0)) for i in range(800)]
    known = in_order(spark, rows)
    labels, ratio = fitted_on(spark, monkeypatch, rows)
    assert sum(labels) == sum(r[2] for r in known)
    assert 100 < labels.count(0) < sum(1 - r[2] for r in known) and ratio > 1


def test_a_long_text_takes_only_what_shorter_ones_leave(monkeypatch):
    rows = [{"_id": i, "_bytes": n} for i, n in enumerate([toxicity.SAMPLE_BYTES // 2, 9 << 20, *[4000] * 900])]
    assert [r["_id"] for r in toxicity._chosen(rows)] == list(range(2, 902))
    assert [r["_id"] for r in toxicity._chosen(rows[:2])] == [0]
    assert [r["_id"] for r in toxicity._chosen(rows[1:2])] == [1] and toxicity._chosen([]) == []


def test_documents_beyond_the_bounded_part_are_learned_from(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 40)
    rows = [(i, t.lower(), int(i % 5 == 0)) for i, t, *_ in corpus(2500)]
    rows = [(i, " ".join(w for w in t.split() if not w.startswith(("zorp", "qwix", "vlug"))), toxic) for i, t, toxic in rows]
    first = {r[0] for toxic in (0, 1) for r in [r for r in in_order(spark, rows) if r[2] == toxic][:40]}
    # what the toxic texts have in common differs between the bounded part and the others
    rows = [(i, t + (" qwix" if i in first else " vlugo snarb") * toxic, toxic) for i, t, toxic in rows]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    model = toxicity.fit(docs, spark.createDataFrame([(r[0], 0, r[2]) for r in rows], "doc_id long, quality int, toxic int"))
    held = [(r["predicted"], rows[r["doc_id"]][2]) for r in toxicity.scored(docs, model).filter("held_out").collect()]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)


def test_every_document_counts_once(spark):
    """Counts and thresholds are those of all distinct documents that are not held out."""
    rows = [(i, f"the {'zorp ' * toxic}word w{i % 7}", toxic) for i in range(900) for toxic in [int(i % 3 == 0)]]
    texts = spark.createDataFrame([*rows, *rows[:50], (None, "the", 0), (5000, "zorp", 0)], "_id long, text string, _toxic int").repartition(5).withColumn("_hash", F.xxhash64("text"))
    known = spark.createDataFrame([(r[0], r[2]) for r in rows], "_id long, _toxic int").withColumn("_order", F.xxhash64("_id"))
    labelled = toxicity._labelled(texts.drop("_toxic"), known)
    assert labelled.count() == 900
    met, n = toxicity._met(labelled)
    assert n.tolist() == [600, 300] == [labelled.filter(F.col("_toxic") == k).count() for k in (0, 1)]
    _, cuts, words, _ = next(toxicity.encoded(pa.array(["the", "zorp"])))
    the, zorp = words[0, 0], words[1, 0]
    assert [met[0][the], met[1][the], met[0][zorp], met[1][zorp]] == [600, 300, 0, 300]
    model = toxicity.refined(labelled)
    apart = labelled.filter("_apart").select("_words").toArrow().to_batches()
    assert apart and 0 < model.thresholds[0] < 1


def test_scores_depend_on_the_text_only(spark):
    docs = spark.createDataFrame([(i, t, "xx", "y") for i, t, *_ in corpus(80)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], 0, r[4]) for r in corpus(80)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    one = {r["text_hash"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    other = {r["text_hash"]: r["score"] for r in toxicity.scored(docs.withColumn("doc_id", F.col("doc_id") + 9000).repartition(3), model).collect()}
    assert one.keys() == other.keys() and all(abs(one[k] - other[k]) < 1e-5 for k in one)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "the text")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["predicted"] for r in toxicity.scored(docs, toxicity.fit(docs, labels)).collect()] == [0]
    assert toxicity.scored(docs.limit(0), toxicity.fit(docs.limit(0), labels)).collect() == []


def test_filters_do_not_reach_into_the_next_text():
    texts = pa.array(["a b c", None, "d", "e f g h i"])
    first, cuts, words, _ = next(toxicity.encoded(texts))
    rnd = np.random.default_rng(0)
    model = toxicity.Model(
        np.vstack((rnd.normal(size=(toxicity.BUCKETS, toxicity.SIZE)), np.zeros((1, toxicity.SIZE)))).astype(np.float32),
        [rnd.normal(size=(w, toxicity.SIZE, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS],
        rnd.normal(size=48).astype(np.float32), rnd.normal(size=49).astype(np.float32) / 50, np.full(5, 0.5),
    )
    together = model.raw(model.projected(), cuts, words)
    for i in range(4):
        alone = words[cuts[i] : cuts[i + 1]]
        pooled = np.zeros(48)
        vectors = np.vstack((model.embeddings[alone[:, 0]] + model.embeddings[alone[:, 1]], np.zeros((2, toxicity.SIZE))))
        for k, f in enumerate(model.filters):
            for at in range(len(alone)):
                value = sum(vectors[at + j] @ f[j] for j in range(len(f))) + model.bias[16 * k : 16 * k + 16]
                pooled[16 * k : 16 * k + 16] = np.maximum(pooled[16 * k : 16 * k + 16], value)
        assert abs(together[i] - 1 / (1 + np.exp(-(pooled @ model.out[:-1] + model.out[-1])))) < 1e-4


def test_only_weights_are_sent(spark, monkeypatch):
    sent, broadcast = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(len(pickle.dumps(value))) or broadcast(value))
    model = toxicity._drawn(np.random.default_rng(3))
    assert toxicity.scored(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).count() == 1
    assert len(sent) == 1 and sent[0] < 2 * model.embeddings.nbytes


def test_scored_in_runs_of_few_words():
    cuts = np.array([0, 5, 5, 300, 310, 312])
    assert [list(x) for x in toxicity._steps(cuts, 64, 16)] == [[0, 1], [2], [3, 4]]

from __future__ import annotations

import corpus_pipeline
from waybook.llm import decontamination, jaccard, mixing, toxicity
from waybook.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_operators_are_registered_once_each():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_distinct_keeps_one_of_each_group(spark):
    text = " ".join(f"a{i}" for i in range(60))
    rows = [(4, text), (2, text + " end"), (2, text + " end"), (9, text.upper()), (5, "alone"), (6, None), (7, None), (None, text), (8, ""), (3, "alone again so it is")]
    df = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, component_id string")
    left = jaccard.distinct(df)
    assert left.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str)
    assert got == sorted([(2, text + " end"), (5, "alone"), (6, None), (7, None), (None, text), (8, ""), (3, "alone again so it is")], key=str)


def test_stages_keep_columns_and_do_their_part(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "decontamination", "mixing", "sharding"]
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    after = []
    for _, step in corpus_pipeline.STAGES[:-1]:
        made = step(spark, docs, SF)
        assert made.columns == docs.columns
        rows = made.collect()
        after.append(rows)
        docs = spark.createDataFrame(rows, docs.schema)
    start = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    source = spark.createDataFrame(list(start.values()), docs.schema)
    bad = {r["doc_id"] for r in toxicity.scored(source, toxicity.fit(source, labels)).collect() if r["predicted"]}
    assert {r["doc_id"] for r in after[0]} == start.keys() - bad
    groups = jaccard.join(spark.createDataFrame(after[0], docs.schema)).collect()
    assert sorted(r["doc_id"] for r in after[1]) == sorted({r["component_id"] for r in groups})
    dirty = {r["doc_id"] for r in decontamination.contamination(source, items).collect() if r["contaminated"]}
    assert {r["doc_id"] for r in after[2]} == {r["doc_id"] for r in after[1]} - dirty
    made, weights = mixing.mixture(spark.createDataFrame(after[2], docs.schema), repeats=1.5)
    assert {r["doc_id"] for r in after[3]} == {r["doc_id"] for r in after[2]}
    assert len(after[3]) == sum(r["copies"] for r in made.collect())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in last) == sorted(r["doc_id"] for r in after[3])
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r["doc_id"] for r in last)

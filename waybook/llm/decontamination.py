"""Benchmark decontamination by a prefix-filtered set join.

Each window of an item, 13 words or the whole of a shorter item, is the set of its
shingles of three words. A text that holds the window holds all of them, so one
shingle is prefix enough: the one rarest in the corpus. Documents are joined with
the prefix shingles only. The place of the shingle in the window says where the
window would have to begin and end in the document; candidates beyond either end
go, and the others are compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waybook.llm import bloom
from waybook.llm.words import LOWER, PLAIN, batches, hashes, shingles, spans
from waybook.operators.ordered import lookup
from waybook.sources.scratch import stage

#: Words of a window, and of a shingle.
WINDOW, SHINGLE = 13, 3
#: Places of shingles in one batch of rows.
HITS = 10_000


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, nth, length, words, place, width, hash): every shingle of every window; `nth` numbers the windows of an item."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for first, data, offsets in batches(batch.column(1)):
                start, end, owner = spans(data, offsets, PLAIN)
                value, text = hashes(data, start, end), LOWER[data].tobytes()
                for row in range(len(offsets) - 1):
                    a, b = np.searchsorted(owner, [row, row + 1])
                    n = int(b - a)
                    if not n:
                        continue
                    length, width = min(window, n), min(SHINGLE, window, n)
                    marks, at = shingles(value[a:b], owner[a:b], width, short=False)
                    marks = marks.view(np.int64)[np.argsort(at)]
                    words = [text[s:e].decode() for s, e in zip(start[a:b], end[a:b], strict=True)]
                    for s in range(n - length + 1):
                        joined = " ".join(words[s : s + length])
                        rows += [(batch.column(0)[first + row].as_py(), s, length, joined, o, width, int(marks[s + o])) for o in range(length - width + 1)]
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["item_id", "nth", "length", "words", "place", "width", "hash"])

    made = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, nth int, length int, words string, place int, width int, hash long")
    return made


def _shingled(column: pa.Array, widths: list[int]) -> Iterator[tuple]:
    """(first row, bytes, offsets, word starts, word ends, words' rows, [(hashes, places)]) for runs of rows."""
    for first, data, offsets in batches(column):
        start, end, owner = spans(data, offsets, PLAIN)
        value = hashes(data, start, end)
        yield first, data, offsets, start, end, owner, [shingles(value, owner, w, short=False) for w in widths]


def frequencies(docs: DataFrame, wanted: DataFrame, widths: list[int]) -> DataFrame:
    """(hash, occurrences) of the shingles `wanted` in all documents."""
    bits = docs.sparkSession.sparkContext.broadcast(bloom.build(wanted, "hash"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for *_, found in _shingled(batch.column(0), widths):
                for marks, _ in found:
                    marks = marks.view(np.int64)
                    value, count = np.unique(marks[bloom.passes(bits.value, marks)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(count)], ["hash", "n"])

    counted = docs.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("occurrences"))
    return counted.join(wanted, "hash")


def occurrences(docs: DataFrame, wanted: DataFrame, widths: list[int], window: int) -> DataFrame:
    """A row (nth, doc_id, text_hash, n_words) per document, and a row (nth, n_words, hash, at, first, words)
    per place where a shingle that may be `wanted` stands in it, with the words within reach of a window."""
    bits = docs.sparkSession.sparkContext.broadcast(bloom.build(wanted, "hash"))
    kinds = {"nth": pa.int64(), "doc_id": pa.int64(), "text_hash": pa.int64(), "n_words": pa.int64(), "hash": pa.int64(), "at": pa.int64(), "first": pa.int64(), "words": pa.string()}

    def rows(**columns) -> pa.RecordBatch:
        n = len(columns["nth"])
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in kinds.items()], list(kinds))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        for batch in it:
            for first, data, offsets, start, end, owner, found in _shingled(batch.column(1), widths):
                n = len(offsets) - 1
                cuts = np.searchsorted(owner, np.arange(n + 1))
                yield rows(nth=base + np.arange(n), doc_id=batch.column(0).slice(first, n), text_hash=batch.column(2).slice(first, n), n_words=np.diff(cuts))
                text = None
                for marks, at in found:
                    marks = marks.view(np.int64)
                    hit = np.flatnonzero(bloom.passes(bits.value, marks))
                    if len(hit) and text is None:
                        text = LOWER[data].tobytes()
                    for part in range(0, len(hit), HITS):
                        h, p = marks[hit[part : part + HITS]], at[hit[part : part + HITS]]
                        row = owner[p]
                        low, high = np.maximum(cuts[row], p - window + 1), np.minimum(cuts[row + 1], p + window)
                        words = [" ".join(text[s:e].decode() for s, e in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
                        yield rows(nth=base + row, n_words=(cuts[row + 1] - cuts[row]), hash=h, at=p - cuts[row], first=low - cuts[row], words=words)
                base += n

    made = "nth long, doc_id long, text_hash long, n_words long, hash long, at long, first long, words string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, made)


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, hits, holders): a numbered row (nth, doc_id, text_hash, n_words) per document, (nth, start, length, wid) per
    distinct window found in it, and (wid, item_id) of the items with that window."""
    shingled = stage(windows(items, window), "windows")
    widths = sorted(r["width"] for r in shingled.select("width").distinct().collect())  # at most three
    common = frequencies(docs, stage(shingled.select("hash").distinct(), "shingles"), widths)
    rarest = F.min(F.struct(F.coalesce("occurrences", F.lit(0)).alias("occurrences"), "hash", "place")).alias("p")
    prefixes = shingled.select("length", "words", "place", "hash").distinct().join(common, "hash", "left").groupBy("length", "words").agg(rarest)
    # a window with a shingle that no document has is in no document
    prefixes = prefixes.filter("p.occurrences > 0").select("length", F.col("words").alias("window"), "p.hash", "p.place")
    prefixes = stage(prefixes.withColumn("wid", F.monotonically_increasing_id()), "prefixes")
    holders = shingled.select("item_id", "length", F.col("words").alias("window")).distinct().join(prefixes, ["length", "window"]).select("wid", "item_id")
    found = stage(occurrences(docs, prefixes.select("hash").distinct(), widths, window), "occurrences")

    # a shingle that stands in a third of all places meets its few windows in as many tasks as it fills
    met = lookup(found.filter("hash IS NOT NULL").select("nth", "n_words", "hash", "at", "first", F.col("words").alias("near")), prefixes, ["hash"], ["nth", "at"], "inner")
    met = met.withColumn("start", F.col("at") - F.col("place")).filter("start >= 0 AND start + length <= n_words")
    there = F.array_join(F.slice(F.split("near", " "), (F.col("start") - F.col("first") + 1).cast("int"), F.col("length")), " ")
    rows = found.filter("hash IS NULL").select("nth", "doc_id", "text_hash", "n_words")
    return rows, met.filter(there == F.col("window")).select("nth", "start", "length", "wid").distinct(), stage(holders, "holders")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated,
    text_hash.

    A word is hit if it lies in any occurrence of any window of an item; a document is
    contaminated if words are hit, and at least one of `share`. Null and empty
    texts have no words and are clean; items without words have no window.
    Repeated documents stay rows of their own, repeated items count once, and an
    item without an id hits words but is not counted. Other columns are not read.
    """
    rows, found, holders = hits(docs, items, window)
    found = stage(found, "hits")
    before = Window.partitionBy("nth").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    spans_ = found.select("nth", "start", "length").distinct().withColumn("end", F.col("start") + F.col("length"))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    n_hit = spans_.withColumn("fresh", fresh).groupBy("nth").agg(F.sum("fresh").alias("n_hit"))
    per_item = found.select("nth", "wid").distinct().join(holders, "wid").filter("item_id IS NOT NULL")
    per_item = per_item.select("nth", F.col("item_id").cast("string").alias("item")).distinct()
    ids = per_item.groupBy("nth").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    out = rows.join(n_hit, "nth", "left").join(ids, "nth", "left").na.fill(0, ["n_hit", "n_items"])
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "text_hash"
    )


def decontaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of `docs`, all columns, whose document is not contaminated; a document is its doc_id and text."""
    bad = contamination(docs, items, **how).filter("contaminated").select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct()
    return docs.join(bad, docs.doc_id.cast("long").eqNullSafe(bad["_bad_id"]) & (F.xxhash64(docs.text) == bad["_bad_hash"]), "left_anti")

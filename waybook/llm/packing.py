"""Order-preserving packing of documents into token sequences by dynamic programming.

The documents of a range, in ascending order of doc_id, are one stream of tokens. A
sequence is a window of it, cut at the ends of documents for nothing, at the ends of
sentences for a small penalty, and where neither comes for `STRETCH` tokens also in between
for a larger one. A window costs its padding and the penalty of its right end:

    cost(j) = penalty(j) + min over i of cost(i) + limit - (place(j) - place(i))

over the cuts i at most `limit` tokens before j. The minimum of cost(i) + place(i) over that
sliding range is kept by a monotone queue, so each cut is pushed and popped once. A window
whose length is a power of two needs no padding and costs `SHORT` instead, so that full
windows come first; its few possible left ends are looked up.

A task solves runs of `RUN` tokens exactly and carries the last window of a run over into the
next, so only the last sequence of a range may be far from full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waybook.llm.wordids import ids_of, memory
from waybook.sources.scratch import stage

#: Tokens of a document, or of the rest of one, without the end of a sentence after which it may be cut anywhere.
STRETCH = 128
#: Tokens that are cut at once.
RUN = 1 << 21
#: In tokens of padding: what a cut at the end of a sentence costs, and one inside a long sentence.
SENTENCE, INSIDE = 8, 32
#: The shortest window that is left unpadded because its length is a power of two, and what such a window costs in tokens of padding.
LEAST, SHORT = 128, 256


def _short(place: np.ndarray, lengths: list[int]) -> list[tuple[int, int]]:
    """(right end, left end) of all windows of these lengths, as numbers of places; by right end, then in order of `lengths`."""
    right, left = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for w in lengths:
        found = np.searchsorted(place, place - w)  # never beyond the place itself
        some = np.flatnonzero(place[found] == place - w)
        right.append(some)
        left.append(found[some])
    ends, begins = np.concatenate(right), np.concatenate(left)
    order = np.argsort(ends, kind="stable")
    return list(zip(ends[order].tolist(), begins[order].tolist(), strict=True))


def windows(places: Sequence[int], penalties: Sequence[int], limit: int, least: int = LEAST, carried: bool = False) -> list[int]:
    """Right ends of the windows of least cost over [0, places[-1]); `places` ascend by at most `limit`, and the last one is the end.

    Of windows of equal cost the longer one is taken. A last window that is `carried` over into the next run costs nothing yet.
    """
    place, cost, key, before = [0, *places], [0], [0], [0]
    at = np.array(place)
    first = np.searchsorted(at, at - limit).tolist()
    #: left ends of unpadded windows: places that have any, in order, and behind them a place that never comes
    short = iter([*_short(at, [1 << k for k in range(limit.bit_length()) if least <= 1 << k < limit]), (len(place), 0)])
    some, k = next(short)
    queue, head = [0], 0
    for j in range(1, len(place)):
        p = place[j]
        while queue[head] < first[j]:
            head += 1
        i = queue[head]
        best = key[i] + limit - p
        while some == j:
            if cost[k] + SHORT < best:
                i, best = k, cost[k] + SHORT
            some, k = next(short)
        best += penalties[j - 1]
        cost.append(best)
        before.append(i)
        best += p
        key.append(best)
        while len(queue) > head and key[queue[-1]] > best:
            queue.pop()
        queue.append(j)
    ends, j = [], len(place) - 1
    if carried and j:
        before[j] = min((i for i in range(max(0, j - limit), j) if place[i] >= place[j] - limit), key=lambda i: (cost[i], -i))
    while j:
        ends.append(place[j])
        j = before[j]
    return ends[::-1]


def cuts(counts: np.ndarray, sentences: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, penalties) of all cuts in a stream of documents of `counts` tokens; `sentences` are the places where sentences end."""
    ends = np.cumsum(counts)
    if not len(ends):
        return ends, ends
    cut = np.zeros(ends[-1] + 1, bool)
    cut[sentences] = True
    cut[ends - 1] = False  # nothing is cut between the last sentence and the end id behind it
    cut[ends] = True
    cut[0] = False
    places = np.flatnonzero(cut)
    cut[:] = False
    cut[ends] = True
    final = cut[places]
    gap = np.diff(places, prepend=0)
    stretch = min(STRETCH, limit)
    more = (gap - 1) // stretch
    inside = np.repeat(places - gap, more) + stretch * (1 + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more))
    every = np.concatenate((places, inside))
    penalties = np.concatenate((np.where(final, 0, SENTENCE), np.full(len(inside), INSIDE)))
    order = np.argsort(every, kind="stable")
    return every[order], penalties[order]


class Packer:
    """Pieces of the documents of one task, given in order, as Arrow batches of `NAMES`."""

    NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "sequence", "offset"]

    def __init__(self, part: int, limit: int):
        self.part, self.limit, self.done = part, limit, 0
        self.doc_ids, self.ids = pa.array([], pa.int64()), np.empty(0, "<u4")
        #: tokens of each document, and how many of the first one's are packed already
        self.counts, self.packed = np.empty(0, np.int64), 0
        self.sentences, self.held = np.empty(0, np.int64), []
        self.size = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray, sentences: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((doc_ids, ids, counts, sentences))
        self.size += len(ids)
        if self.size >= RUN:
            yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[pa.RecordBatch]:
        base, places = len(self.ids), [self.sentences]
        for _, ids, _, sentences in self.held:
            places.append(sentences + base)
            base += len(ids)
        sentences = np.concatenate(places)
        doc_ids = pa.concat_arrays([self.doc_ids, *(h[0] for h in self.held)])
        ids = np.concatenate([self.ids, *(h[1] for h in self.held)])
        counts = np.concatenate([self.counts, *(h[2] for h in self.held)])
        self.held = []
        left = counts.copy()
        left[:1] -= self.packed
        if not len(ids):
            return
        place, penalty = cuts(left, sentences, self.limit)
        ends = np.array(windows(place.tolist(), penalty.tolist(), self.limit, carried=not last), np.int64)
        keep = len(ends) if last else len(ends) - 1
        upto = int(ends[keep - 1]) if keep else 0
        stops = np.cumsum(left)
        edges = np.union1d(ends[:keep], stops[stops <= upto])
        begin = np.concatenate(([0], edges[:-1])) if keep else edges
        doc, window = np.searchsorted(stops, begin, "right"), np.searchsorted(ends, begin, "right")
        first = np.concatenate(([0], ends))[window]
        data = memoryview(np.ascontiguousarray(ids)).cast("B")
        checks = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begin.tolist(), edges.tolist(), strict=True)]
        start = begin - (stops - left)[doc] + np.where(doc == 0, self.packed, 0)
        longs = [start, edges - begin, np.array(checks, np.int64), counts[doc], np.full(len(doc), self.part), self.done + window, begin - first]
        yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in longs)], self.NAMES)
        self.done += keep
        gone = int(np.searchsorted(stops, upto, "right"))
        self.packed = 0 if gone == len(left) else upto - int(stops[gone] - left[gone]) + (self.packed if gone == 0 else 0)
        self.doc_ids, self.counts, self.ids = doc_ids.slice(gone), counts[gone:], ids[upto:]
        self.sentences, self.size = sentences[sentences > upto] - upto, len(self.ids)


def packed(docs: DataFrame, path: str, limit: int = 2048, end: int = 1) -> DataFrame:
    """One row per piece of (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document's ids, the id `end` behind them, lie in order in one or more pieces; sequences
    of at most `limit` tokens hold the pieces in order of doc_id, without gaps. Documents are
    dealt to ranges of doc_id (null first; repeated ids in the order of their texts' hashes).
    A null or empty text is its end id only; repeated rows are packed each for itself. Other
    columns are not read. An empty table gives an empty one.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = memory(path), None
        for batch in it:
            if packer is None and batch.num_rows:
                packer = Packer(batch.column(2)[0].as_py(), limit)
            at = 0
            for ids, counts, sentences in ids_of(batch.column(1), words):
                stops = np.cumsum(counts)
                moved = sentences + np.searchsorted(stops, sentences, "left")  # one end id for each document before
                yield from packer.add(batch.column(0).slice(at, len(counts)), np.insert(ids, stops, end), counts + 1, moved)
                at += len(counts)
        if packer:
            yield from packer.flush(True)

    order = ["doc_id", "_hash"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_hash")).repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, sequence long, offset long"
    pieces = stage(rows.select("doc_id", "text", F.spark_partition_id().cast("long").alias("part")).mapInArrow(run, kinds), "pieces")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    ranges = pieces.groupBy("part").agg((F.max("sequence") + 1).alias("sequences"))
    first = ranges.select("part", F.coalesce(F.sum("sequences").over(before), F.lit(0)).alias("first"))
    return pieces.join(first, "part").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("sequence")).alias("sequence_id"), "offset")


def padding(pieces: DataFrame, limit: int = 2048) -> DataFrame:
    """One row: sequences, tokens and padding of pieces from `packed`; sequences whose length is a power of two have none."""
    held = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    whole = F.bit_count("n") == 1
    return held.agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(whole, 0).otherwise(limit - F.col("n"))).alias("padding"))

"""Token ids of documents in files of independently coded, checksummed blocks.

A file holds a run of documents in ascending order of doc_id, little-endian:

    8 bytes   WBIDS001
    4 + 4     vocabulary size, ids per block
    blocks    each: ids (4), payload bytes (4), crc32 of the ids as unsigned 32-bit
              numbers (4), crc32 of the payload (4), payload (see `coder`)
    table     deflated: null marks (1 each), doc_ids (8 each), ids per document (8 each)
    32 bytes  place of the table (8), documents (8), ids (8), crc32 of the table (4), WBID

A block can be read without the others. Blocks follow each other whatever
document their ids belong to; each document's ids end with the end id.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waybook.llm import coder, files
from waybook.llm.wordids import ids_of, memory
from waybook.sources.scratch import folder, stage

_HEAD, _BLOCK, _FOOT = struct.Struct("<8sII"), struct.Struct("<IIII"), struct.Struct("<QQQI4s")


class Writer:
    def __init__(self, path: str, vocabulary: int):
        self.out, self.vocabulary = files.writer(path), vocabulary
        #: ids that are coded at once: as many blocks as the coder runs side by side
        self.group = coder.BLOCK * coder.lanes(vocabulary)
        self.out.write(_HEAD.pack(b"WBIDS001", vocabulary, coder.BLOCK))
        self.at, self.held, self.size, self.total = _HEAD.size, [], 0, 0
        self.table: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        self.table.append((doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"), counts.astype("<i8")))
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.group:
            self._write(False)

    def _write(self, all_: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, "<u4")
        done = len(ids) if all_ else len(ids) - len(ids) % self.group
        for start in range(0, done, self.group):
            blocks = [ids[i : min(i + coder.BLOCK, done)] for i in range(start, min(start + self.group, done), coder.BLOCK)]
            for block, payload in zip(blocks, coder.encode(blocks, self.vocabulary), strict=True):
                self.out.write(_BLOCK.pack(len(block), len(payload), zlib.crc32(block.astype("<u4").tobytes()), zlib.crc32(payload)) + payload)
                self.at += _BLOCK.size + len(payload)
        self.total += done
        self.held, self.size = [ids[done:]], len(ids) - done

    def close(self) -> tuple[int, int, int]:
        """Documents, ids and bytes."""
        self._write(True)
        table = zlib.compress(b"".join(np.concatenate(x).tobytes() for x in zip(*self.table, strict=True))) if self.table else zlib.compress(b"")
        docs = sum(len(x[0]) for x in self.table)
        self.out.write(table + _FOOT.pack(self.at, docs, self.total, zlib.crc32(table), b"WBID"))
        self.out.close()
        return docs, self.total, self.at + len(table) + _FOOT.size


def read(path: str) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc_ids, ids per document, ids) of runs of documents of one file; broken files raise."""
    source = files.reader(path)
    magic, vocabulary, block = _HEAD.unpack(source.read(_HEAD.size))
    source.seek(source.size() - _FOOT.size)
    place, docs, total, check, tail = _FOOT.unpack(source.read(_FOOT.size))
    source.seek(place)
    table = source.read(source.size() - _FOOT.size - place)
    if magic != b"WBIDS001" or tail != b"WBID" or zlib.crc32(table) != check:
        raise ValueError(f"{path} is not a whole file of ids")
    table = zlib.decompress(table)
    null, doc_ids, counts = np.frombuffer(table, np.uint8, docs), np.frombuffer(table, "<i8", docs, docs), np.frombuffer(table, "<i8", docs, 9 * docs)
    ends = np.concatenate(([0], np.cumsum(counts)))
    source.seek(_HEAD.size)
    at, doc, base, held = _HEAD.size, 0, 0, np.empty(0, np.int64)
    while at < place:
        heads, payloads = [], []
        while at < place and len(heads) < coder.lanes(vocabulary):
            heads.append(_BLOCK.unpack(source.read(_BLOCK.size)))
            payloads.append(source.read(heads[-1][1]))
            at += _BLOCK.size + heads[-1][1]
        for head, payload in zip(heads, payloads, strict=True):
            if zlib.crc32(payload) != head[3]:
                raise ValueError(f"a block of {path} is broken")
        got = coder.decode(payloads, [h[0] for h in heads], vocabulary)
        for head, ids in zip(heads, got, strict=True):
            if zlib.crc32(ids.astype("<u4").tobytes()) != head[2]:
                raise ValueError(f"a block of {path} gives other ids")
        held = np.concatenate((held, *got))
        to = int(np.searchsorted(ends, base + len(held), "right")) - 1
        if to > doc:
            yield [None if null[i] else int(doc_ids[i]) for i in range(doc, to)], counts[doc:to], held[: ends[to] - base]
            held, base, doc = held[ends[to] - base :], int(ends[to]), to
    if doc < docs or len(held) or base != total:
        raise ValueError(f"{path} has other ids than its table says")


def write(docs: DataFrame, path: str, target: str, end: int, vocabulary: int) -> DataFrame:
    """Encode (doc_id, text) into files below `target`; the written list (part, path, docs, ids, bytes) in order of doc_id.

    Rows are dealt to ranges of doc_id (null first; repeated ids in the order of their
    texts' hashes), one file each. A null text is empty: its end id only.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = memory(path)
        out, part, name = None, 0, files.new(target, "ids")
        for batch in it:
            if out is None and batch.num_rows:
                out, part = Writer(name, vocabulary), batch.column(2)[0].as_py()
            at = 0
            for ids, counts, _ in ids_of(batch.column(1), words):
                stops = np.cumsum(counts)
                out.add(batch.column(0).slice(at, len(counts)), np.insert(ids, stops, end), counts + 1)
                at += len(counts)
        if out:
            made = out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, name, *made)], ["part", "path", "docs", "ids", "bytes"])

    order = ["doc_id", "_hash"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_hash")).repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(rows.select("doc_id", "text", F.spark_partition_id().cast("long").alias("part")).mapInArrow(run, "part long, path string, docs long, ids long, bytes long"), "written")


def documents(written: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of a list from `write`, from the files."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    listed = written.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))).select("path", "start")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for doc_ids, counts, ids in read(path):
                    stops = np.concatenate(([0], np.cumsum(counts)))
                    data = memoryview(ids.astype("<u4")).cast("B")
                    checks = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + stops[:-1]), pa.array(counts), pa.array(checks, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    start += int(stops[-1])

    count = max(1, written.count())
    return listed.repartition(count).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end: int = 2, vocabulary: int = 49408) -> DataFrame:
    """Write the ids of (doc_id, text) to shared scratch files and describe every document from them.

    One row per row: doc_id, start, n_tokens, ids_crc32. An empty table gives an empty one; other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    return documents(write(docs, path, folder(spark, "ids"), end, vocabulary))

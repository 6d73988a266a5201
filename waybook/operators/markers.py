"""Many markers searched in one pass over the texts' bytes.

Each marker is found by one anchor: the eight bytes of it (or all, if it is shorter) that are
rarest among the markers. A pass packs the eight bytes at every place of a batch of texts into a
number, drops those whose hash is in no anchor's place of a bitmap, looks the rest up among the
anchors, and compares the marker where an anchor is met. So nothing but hits leaves the workers.
UTF-8 text contains a marker where its bytes contain the marker's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

#: Bytes of markers that are sent to the workers; beyond that they are joined (`audit.containing`).
LARGEST = 32 << 20
#: Bits of the hash that the bitmap knows, and bytes of text that are looked at at once.
BITS, PIECE = 24, 1 << 21
_U = np.uint64
_SPREAD = _U(0x9E3779B97F4A7C15)


def packed(data: np.ndarray, width: int) -> np.ndarray:
    """The `width` bytes from each place on as a number."""
    n = max(0, len(data) - width + 1)
    out = np.zeros(n, _U)
    for j in range(width):
        out |= data[j : j + n].astype(_U) << _U(8 * j)
    return out


class Index:
    """Anchors of markers, by their length."""

    def __init__(self, markers: list[bytes]):
        self.markers = markers
        self.empty = [i for i, m in enumerate(markers) if not m]
        seen = np.bincount(np.frombuffer(b"".join(markers), np.uint8), minlength=256) + 1
        rarity = -np.log(seen / seen.sum())
        held: dict[int, list[tuple[int, int, int]]] = {}
        for i, marker in enumerate(markers):
            if marker:
                width = min(8, len(marker))
                data = np.frombuffer(marker, np.uint8)
                total = np.concatenate(([0], np.cumsum(rarity[data])))
                at = int(np.argmax(total[width:] - total[:-width]))
                held.setdefault(width, []).append((int(packed(data[at : at + width], width)[0]), i, at))
        self.tables = []
        for width, anchors in sorted(held.items()):
            value, which, place = (np.array(x, t) for x, t in zip(zip(*sorted(anchors), strict=True), (_U, np.int64, np.int64), strict=True))
            bits = np.zeros(1 << (BITS - 3), np.uint8)
            h = self._hash(value)
            np.bitwise_or.at(bits, h >> 3, (1 << (h & 7)).astype(np.uint8))
            self.tables.append((width, value, which, place, bits))

    @staticmethod
    def _hash(value: np.ndarray) -> np.ndarray:
        return ((value * _SPREAD) >> _U(64 - BITS)).astype(np.int64)

    def _met(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place, marker) where an anchor of a marker is met, the place being that of the marker's first byte."""
        for width, value, which, place, bits in self.tables:
            for begin in range(0, len(data), PIECE):
                words = packed(data[begin : begin + PIECE + width - 1], width)
                h = self._hash(words)
                near = np.flatnonzero((bits[h >> 3] >> (h & 7).astype(np.uint8)) & 1)
                low = np.searchsorted(value, words[near], "left")
                high = np.searchsorted(value, words[near], "right")
                for at, a, b in zip((near + begin)[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                    for i in range(a, b):
                        yield at - int(place[i]), int(which[i])

    def found(self, texts: pa.Array) -> list[set[int]]:
        """The markers in each text; a null has none, an empty marker is in every text."""
        texts = texts.cast(pa.large_string())
        out = [set(self.empty) if ok else set() for ok in texts.is_valid().to_pylist()]
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        if not len(texts) or offsets[-1] == offsets[0]:
            return out
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        ends = offsets[1:] - offsets[0]
        raw = memoryview(data)
        for at, which in self._met(data):
            if at < 0:
                continue
            row = int(np.searchsorted(ends, at, "right"))
            marker = self.markers[which]
            if which not in out[row] and at + len(marker) <= ends[row] and raw[at : at + len(marker)] == marker:
                out[row].add(which)
        return out


def fits(markers: DataFrame, marker: str) -> bool:
    return (markers.agg(F.sum(F.octet_length(marker) + 64)).first()[0] or 0) <= LARGEST


def _sent(texts: DataFrame, markers: DataFrame, marker: str):
    """(the marker rows, a broadcast index of them); the caller has checked their size."""
    rows = markers.where(F.col(marker).isNotNull()).collect()
    return rows, texts.sparkSession.sparkContext.broadcast(Index([r[marker].encode() for r in rows]))


def pairs(texts: DataFrame, key: str, text: str, markers: DataFrame, marker_key: str, marker: str) -> DataFrame:
    """(key, marker_key) of each text and each marker in it."""
    rows, index = _sent(texts, markers.select(marker_key, marker), marker)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = index.value.found(batch.column(1))
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([i for x in found for i in sorted(x)], pa.int64())], [key, "_marker"])

    kinds = StructType([texts.schema[key], StructField("_marker", LongType())])
    hits = texts.select(key, text).mapInArrow(run, kinds)
    names = texts.sparkSession.createDataFrame([(i, r[marker_key]) for i, r in enumerate(rows)], StructType([StructField("_marker", LongType()), markers.schema[marker_key]]))
    return hits.join(F.broadcast(names), "_marker").select(key, marker_key)  # the names' size has been checked with the markers'


def flagged(texts: DataFrame, text: str, markers: DataFrame, marker: str, name: str = "contaminated") -> DataFrame:
    """The rows with a flag whether their text holds any marker; nothing is shuffled."""
    _, index = _sent(texts, markers.select(marker).distinct(), marker)
    place = texts.columns.index(text)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            flags = pa.array([bool(x) for x in index.value.found(batch.column(place))], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, flags], [*batch.schema.names, name])

    return texts.mapInArrow(run, StructType([*texts.schema.fields, StructField(name, BooleanType())]))

"""A membership filter of fixed size, built on the executors.

It only spares work: a key that is in the set always passes, one that is not
passes rarely, and an exact join follows. Its size never depends on the data;
only the share of keys that pass without need does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from waybook.llm.words import U, mix

#: Bits of the filter: 8 MB, two per key; sent to each executor once. Below 1 % of false passes up to 3 million keys.
BITS = 1 << 26


def places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys.view(U) + U(0x9E3779B97F4A7C15))
    return (h & U(BITS - 1)).astype(np.int64), ((h >> U(32)) & U(BITS - 1)).astype(np.int64)


def build(df: DataFrame, key: str) -> np.ndarray:
    """Packed bits of the keys in a bigint column. Each task sends what it set, 8 MB at most, and at most eight tasks do."""

    def fill(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS // 8, np.uint8)
        for batch in it:
            for at in places(batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)):
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        at = np.flatnonzero(bits)
        if 5 * len(at) < len(bits):
            yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.uint32).tobytes()]), pa.array([bits[at].tobytes()])], ["at", "bits"])
        else:
            yield pa.RecordBatch.from_arrays([pa.array([b""]), pa.array([bits.tobytes()])], ["at", "bits"])

    out = np.zeros(BITS // 8, np.uint8)
    for row in df.select(key).coalesce(8).mapInArrow(fill, "at binary, bits binary").toLocalIterator():
        got = np.frombuffer(row["bits"], np.uint8)
        if len(got) == len(out):
            out |= got
        else:
            out[np.frombuffer(row["at"], np.uint32)] |= got
    return out


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    a, b = places(keys)
    return ((bits[a >> 3] >> (a & 7).astype(np.uint8)) & (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)

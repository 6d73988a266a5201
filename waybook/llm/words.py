"""Words and word shingles of whole texts as 64-bit hashes, on the UTF-8 bytes of Arrow columns.

Both word rules of this package cut at ASCII bytes only, so they can be
applied to bytes: every byte of a multi-byte character is a word byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64

#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z.
PLAIN = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: Words `[^\x20\x09-\x0D]+`.
SPACED = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
#: A-Z to a-z, all else unchanged.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_POWERS = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15, U))
_PIECE = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_CODES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))[LOWER]
_PLACES = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95)) | U(1)


def column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; a null is an empty text."""
    array = array.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8)
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def batches(array: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about `most` bytes; a longer text is a run of its own."""
    data, offsets = column(array)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def spans(data: np.ndarray, offsets: np.ndarray, rule: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word, in order; a word ends with its row."""
    inside = rule[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = inside[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One hash per lower-cased word: a sum of byte codes weighted by place."""
    out = np.empty(len(start), U)
    size = end - start
    total = np.concatenate(([0], np.cumsum(size)))
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(total, total[at] + _PIECE, "right")) - 1)
        begin = total[at:to] - total[at]
        within = np.arange(total[to] - total[at]) - np.repeat(begin, size[at:to])
        codes = _CODES[data[np.repeat(start[at:to], size[at:to]) + within]]
        values = codes * _POWERS[within & 0xFFFF]
        if size[at:to].max() > 1 << 16:
            values += codes * (within >> 16).astype(U) * U(0xD6E8FEB86659FD93)
        out[at:to] = np.add.reduceat(values, begin)
        at = to
    return mix(out + size.astype(U))


def shingles(words: np.ndarray, rows: np.ndarray, width: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every shingle of `width` words; with `short`, a row of fewer words is one shingle."""
    n = max(0, len(words) - width + 1)
    at = np.flatnonzero(rows[:n] == rows[width - 1 :]) if n else np.empty(0, np.int64)
    value = np.zeros(len(at), U)
    for j in range(width):
        value += words[at + j] * _PLACES[j]
    value = mix(value + U(width))
    if not short or not len(words):
        return value, at
    head = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    count = np.diff(np.append(head, len(words)))
    few = count < width
    head, count = head[few], count[few]
    whole = np.zeros(len(head), U)
    for j in range(width - 1):
        has = count > j
        whole[has] += words[head[has] + j] * _PLACES[j]
    return np.concatenate((value, mix(whole + count.astype(U)))), np.concatenate((at, head))

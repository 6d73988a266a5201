"""Token counts and token ids of whole texts.

Texts are cut at safe boundaries and encoded in batches of about equal bytes. For
a tokenizer that drops white space and never looks across it, every run of ASCII
white space is a safe boundary: a text's tokens are those of its words, one after
the other. Equal words of a batch are then encoded once, and words met before in
the task not at all. Without such boundaries (`spaced=False`) texts are encoded whole.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybook.llm.words import column

#: Bytes of text that are cut and counted at once; a longer text makes a batch of its own.
BATCH = 8 << 20
#: Bytes of words per call of the tokenizer.
CALL = 1 << 20
#: Words a task remembers, and the longest word it remembers.
WORDS, LONGEST = 400_000, 200


@lru_cache(2)
def encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Ids of each text, without begin, end or added special tokens; the file must be at this path on each executor."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: model.encode(texts, num_threads=1)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    fast = Tokenizer.from_file(path)
    fast.no_truncation()
    fast.no_padding()
    return lambda texts: [x.ids for x in fast.encode_batch_fast(texts, add_special_tokens=False)]


def calls(texts: list[str], most: int = CALL) -> Iterator[list[str]]:
    """Runs of texts of about `most` characters each."""
    at, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= most:
            yield texts[at : i + 1]
            at, held = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def slices(array: pa.Array, most: int = BATCH) -> Iterator[pa.Array]:
    """Runs of rows of about `most` bytes; null becomes the empty text."""
    array = array.cast(pa.large_string()).fill_null("")
    offsets = column(array)[1]
    at, n = 0, len(array)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield array.slice(at, to - at)
        at = to


class Words:
    """Something per word, found by `of` for words not met before."""

    def __init__(self, of: Callable[[list[str]], list]):
        self.of, self.known = of, {}

    def __call__(self, words: list[str]) -> list:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > WORDS:
            self.known, new = {}, words
        long = {}
        for run in calls(new):
            for word, value in zip(run, self.of(run), strict=True):
                (self.known if len(word) <= LONGEST else long)[word] = value
        return [self.known[w] if w in self.known else long[w] for w in words]


def cut(texts: pa.Array, spaced: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pieces, the piece at each place, and where each text's places begin."""
    if not spaced:
        return texts, np.arange(len(texts)), np.arange(len(texts) + 1)
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[starts[1:]] - total[starts[:-1]]


def lengths(texts: pa.Array, memory: Words, spaced: bool) -> np.ndarray:
    out = [np.empty(0, np.int64)]
    for part in slices(texts):
        pieces, places, starts = cut(part, spaced)
        each = np.array(memory(pieces.to_pylist()) if spaced else [n for run in calls(pieces.to_pylist()) for n in memory.of(run)], np.int64)
        out.append(sums(each[places] if len(places) else np.empty(0, np.int64), starts))
    return np.concatenate(out)


def counts(docs: DataFrame, path: str, limit: int = 2048, spaced: bool = True) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    A null text counts as empty: no bytes, no tokens. Repeated rows and null ids
    stay as they are; other columns are not read. Only lengths leave the workers.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        memory = Words(lambda texts: [len(x) for x in encode(texts)])
        for batch in it:
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(lengths(batch.column(1), memory, spaced))], ["doc_id", "n_bytes", "n_tokens"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)

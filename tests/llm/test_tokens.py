from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from waybook.llm import files, idfile, tokens

WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    (5, "Hello World, it's 2024!"), (1, None), (2, ""), (9, " \n\t "), (None, "no id"), (5, "Hello World, it's 2024!"), (5, "another text"),
    (3, "<|endoftext|> inside<|startoftext|> of words\x00\x1f"), (4, "Äé́ ﬁ İ ΑΣ ΑΣ.  wide space 日本語"), (7, "x" * 5000), (8, "many words " * 20_000), (6, "e ́ a"),
]


@pytest.fixture(scope="module")
def plain():
    library = Tokenizer.from_file(WORDS)
    return lambda text: library.encode(text or "", add_special_tokens=False).ids


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, text string, n_tokens int, part string")


def test_counts(spark, plain):
    got = tokens.counts(docs(spark, TEXTS).repartition(3), WORDS, limit=100).collect()
    want = [(d, len((t or "").encode()), len(plain(t)), len(plain(t)) > 100) for d, t in TEXTS]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokens.counts(docs(spark, []), WORDS).collect() == []


def test_counts_of_whole_texts(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = tokens.counts(docs(spark, TEXTS), path, spaced=False).collect()
    assert sorted((r[2] for r in got)) == sorted(len(model.encode(t or "")) for _, t in TEXTS)


def test_words_forgets_but_answers():
    asked = []
    memory = tokens.Words(lambda texts: asked.extend(texts) or [len(t) for t in texts])
    assert memory(["a", "bb", "c" * 500]) == [1, 2, 500]
    assert memory(["a", "c" * 500]) == [1, 500]
    assert asked == ["a", "bb", "c" * 500, "c" * 500]


def test_files_round_trip(spark, plain):
    df = docs(spark, TEXTS).repartition(4)
    got = [tuple(r) for r in idfile.round_trip(df, WORDS).collect()]
    # null first, then by id; equal ids in any order of their own
    start, place = {}, 0
    by_start = sorted(got, key=lambda r: r[1])
    for d, s, n, _ in by_start:
        assert s == place
        place += n
    assert [r[0] for r in by_start] == sorted((d for d, _ in TEXTS), key=lambda d: -1 if d is None else d)
    want = [(d, len(plain(t)) + 1, zlib.crc32(np.array([*plain(t), 2], "<u4").tobytes())) for d, t in TEXTS]
    assert sorted(((d, n, c) for d, _, n, c in got), key=str) == sorted(want, key=str)
    assert idfile.round_trip(docs(spark, []), WORDS).collect() == []


def test_broken_file_is_found(spark, tmp_path):
    made = idfile.write(docs(spark, TEXTS).coalesce(1), WORDS, str(tmp_path / "ids"), 2, 49408).collect()
    path = max(made, key=lambda r: r["bytes"])["path"]
    data = bytearray(open(path, "rb").read())
    assert sum(len(c) for _, c, _ in idfile.read(path))
    data[60] ^= 1
    with files.writer(path + "x") as out:
        out.write(bytes(data))
    with pytest.raises(ValueError):
        list(idfile.read(path + "x"))

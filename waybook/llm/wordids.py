"""Token ids of whole texts by distinct words, encoded when a worker meets them first.

A tokenizer that drops white space and never looks across it gives a text the ids
of its words, one word after the other; where it also cuts between letters and other
signs, a comma or a full stop behind a letter is a word of its own, and where it lower-cases,
words may be lower-cased first. New words that are one run of letters are joined by blanks
and encoded together, and their ids told apart by the tokens that end a word. All other
words are encoded one by one, and files that do not cut like that encode whole texts.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from waybook.llm.tokens import calls, slices

#: Words a Python worker remembers (some 160 MB) from task to task, the longest one, and plain words that are encoded as one text.
WORDS, LONGEST, JOINED = 800_000, 64, 256
#: A word that ends a sentence.
SENTENCE = r"[.!?…。！？][\"')\]»”’]*$"


@lru_cache(2)
def _file(path: str) -> tuple[object, bool, bool, np.ndarray]:
    """(tokenizer, whether words can be encoded alone, whether it lower-cases, which ids end a word)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    fast = Tokenizer.from_file(path)
    fast.no_truncation()
    fast.no_padding()
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    suffix, first = made["model"].get("end_of_word_suffix"), (made.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    words = bool(suffix) and first.get("behavior") == "Removed" and first.get("invert") is True
    lowers = any(step.get("type") == "Lowercase" for step in (made.get("normalizer") or {}).get("normalizers", []))
    names = fast.get_vocab()
    last = np.zeros(1 + max(names.values()), bool)
    last[[i for name, i in names.items() if suffix and name.endswith(suffix)]] = True
    return fast, words, lowers, last


class WordIds:
    """Ids of words, found by the tokenizers library; words met before are looked up."""

    def __init__(self, path: str):
        self.fast, self.alone, self.lowers, self.last = _file(path)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.begin = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for run in calls(texts) for x in self.fast.encode_batch_fast(run, add_special_tokens=False)]

    def cut(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words, which of them end a sentence, the word at each place, and where each text's places begin."""
        if self.lowers:  # a special token in capitals is none, but would become one
            texts = pc.if_else(pc.match_substring(texts, "<"), texts, pc.ascii_lower(texts))
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, r"([A-Za-z])([,.])", r"\1 \2"))
        coded = lists.flatten().dictionary_encode()
        ends = pc.match_substring_regex(coded.dictionary, SENTENCE).to_numpy(zero_copy_only=False)
        starts = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
        return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), ends, coded.indices.to_numpy(zero_copy_only=False), starts

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per word) of words that are one run of letters each."""
        ids, sizes = [], []
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for group, got in zip(groups, self.encode([" ".join(g) for g in groups]), strict=True):
            got = np.array(got, "<u4")
            ends = np.flatnonzero(self.last[got]) + 1
            if len(ends) != len(group) or ends[-1] != len(got):
                each = self.encode(group)
                got, ends = np.array([i for x in each for i in x], "<u4"), np.cumsum([len(x) for x in each])
            ids.append(got)
            sizes.append(np.diff(ends, prepend=0))
        return np.concatenate([np.empty(0, "<u4"), *ids]), np.concatenate([np.empty(0, np.int64), *sizes])

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, end): where the ids of each word stand."""
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        fresh = np.flatnonzero(at < 0)
        if len(self.known) + len(fresh) > WORDS:
            self._clear()
            at, fresh = np.full(len(words), -1), np.arange(len(words))
        if len(fresh):
            new = [words[i] for i in fresh.tolist()]
            run = np.fromiter((w.isalpha() and (w.isascii() or (w.lower() == w and unicodedata.is_normalized("NFC", w))) for w in new), bool, len(new))
            ids, sizes = self._plain([w for w, r in zip(new, run.tolist(), strict=True) if r])
            others = self.encode([w for w, r in zip(new, run.tolist(), strict=True) if not r])
            order = np.concatenate((fresh[run], fresh[~run]))
            at[order] = len(self.begin) - 1 + np.arange(len(new))
            self.known.update((words[i], j) for i, j in zip(order.tolist(), at[order].tolist(), strict=True) if len(words[i]) <= LONGEST)
            self.flat = np.concatenate((self.flat, ids, np.array([i for x in others for i in x], "<u4")))
            sizes = np.concatenate((sizes, np.array([len(x) for x in others], np.int64)))
            self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(sizes)))
        return self.flat, self.begin[at], self.begin[at + 1]


@lru_cache(1)
def memory(path: str) -> WordIds:
    """The words this worker remembers; a cache only, so nothing depends on which worker runs a task."""
    return WordIds(path)


def gathered(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """flat[start[0]:end[0]], flat[start[1]:end[1]] and so on, as one array."""
    size = end - start
    total = np.cumsum(size)
    if not len(total) or not total[-1]:
        return flat[:0]
    step = np.ones(total[-1], np.int64)
    full = np.flatnonzero(size)
    first = total[full] - size[full]
    step[first] = start[full]
    step[first[1:]] -= end[full[:-1]] - 1
    return flat[np.cumsum(step)]


def ids_of(texts: pa.Array, words: WordIds) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, ids per text, places where sentences end) of runs of texts; null is the empty text.

    Places count from the first id of the run. Without word-wise encoding no sentence ends are known.
    """
    for part in slices(texts):
        if not words.alone:
            each = words.encode(part.to_pylist())
            yield np.array([i for ids in each for i in ids], "<u4"), np.array([len(ids) for ids in each], np.int64), np.empty(0, np.int64)
            continue
        distinct, ends, places, starts = words.cut(part)
        flat, start, end = words(distinct)
        total = np.concatenate(([0], np.cumsum((end - start)[places])))
        yield gathered(flat, start[places], end[places]), np.diff(total[starts]), total[1:][ends[places]]

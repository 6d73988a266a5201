"""Reasoning, final answers and boxed answers out of raw model text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybook.constants import PLACEHOLDER_ANSWERS
from waybook.functions.strings import after, before, let, strip

# ---- fixed values: marks and patterns of the two wire formats -----------------
FINAL_MARK = "<|channel|>final<|message|>"
END_MARK = "<|im_end|>"
TOKENS = r"<\|[^|]+\|>"
BOXED = r"\\boxed\{([^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+)\}"
THINK = r"(?s)<think>(.*?)</think>"


# ---- boxed answers -------------------------------------------------------------


def boxed_first(c: Column) -> Column:
    """Content of the first box with at most one inner brace level, cleaned.

    The quantifiers are possessive: each piece stops at a brace, so giving
    characters back can never help, and Java then loops instead of recursing.
    """
    raw = strip(F.regexp_extract(c, BOXED, 1))
    for pattern, to in [
        (r"\\text\{([^}]*)\}", "$1"),
        (r"\\textrm\{([^}]*)\}", "$1"),
        (r"(?U)\\[,;!\s]", " "),
        (r"\{,\}", ","),
        (r"[{}]", ""),
    ]:
        raw = F.regexp_replace(raw, pattern, to)
    return F.regexp_replace(strip(F.replace(raw, F.lit("\\"), F.lit(""))), r"(?U)\s+", " ")


#: UTF-8 bytes of the white space that may stand between a box's name and its brace.
_SPACES = [c.encode() for c in map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]


def _openings(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of the braces that open a box: behind its name, and white space, in one text."""
    name = np.frombuffer(b"\\boxed", np.uint8)
    n = len(data) - len(name)
    found = np.flatnonzero(data[: max(0, n)] == name[0])
    for k in range(1, len(name)):
        found = found[data[found + k] == name[k]]
    at, stop = found + len(name), ends[np.searchsorted(ends, found, "right")]
    moving = np.ones(len(at), bool)
    while moving.any():
        moving[:] = False
        for space in _SPACES:
            fits = np.flatnonzero(at + len(space) <= stop)
            for k, byte in enumerate(space):
                fits = fits[data[at[fits] + k] == byte]
            at[fits] += len(space)
            moving[fits] = True
    inside = at < stop
    return at[inside][data[at[inside]] == ord("{")]


def _last_boxes(texts: pa.Array) -> pa.Array:
    """What stands in each text's last box, any depth of braces; '' without a box, all the rest of the text in one that is not closed.

    A brace behind an odd run of backslashes is none. The depth behind each brace is a running sum over
    the batch; the brace that closes another one is the next brace of its text at the same depth.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    if not len(texts) or offsets[0] == offsets[-1]:
        return pc.if_else(texts.is_valid(), "", pa.scalar(None, pa.string()))
    data, ends = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]
    opens = _openings(data, ends)
    starts, stops, begin = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), opens
    if len(opens):
        brace = np.flatnonzero((data == ord("{")) | (data == ord("}")))
        # the run of backslashes before a brace goes back to the last other byte, or to the start of its text
        other = np.flatnonzero(data != ord("\\"))
        before = np.searchsorted(other, brace, "left") - 1
        row = np.searchsorted(ends, brace, "right")
        left = np.maximum(np.where(before >= 0, other[before], -1) + 1, offsets[row] - offsets[0])
        brace, row = brace[(brace - left) % 2 == 0], row[(brace - left) % 2 == 0]
        up = data[brace] == ord("{")
        depth = np.cumsum(np.where(up, 1, -1))
        level = np.where(up, depth, depth + 1)
        order = np.lexsort((brace, level, row))
        after = np.full(len(brace), -1)
        same = (row[order][1:] == row[order][:-1]) & (level[order][1:] == level[order][:-1])
        after[order[:-1][same]] = order[1:][same]
        at = np.searchsorted(brace, opens)
        closed = after[at] >= 0
        end = np.where(closed, brace[np.where(closed, after[at], 0)], ends[row[at]])
        # a box inside another one is not looked at, nor is what follows one that is not closed
        reach = np.concatenate(([-1], np.maximum.accumulate(np.where(closed, end, end - 1))[:-1]))
        top = opens > reach
        mine, begin, end = row[at][top], opens[top] + 1, end[top]
        starts[mine], stops[mine] = begin, end  # the last one of each text stays
    out = np.concatenate(([0], np.cumsum(stops - starts)))
    where = np.repeat(starts - out[:-1], stops - starts) + np.arange(out[-1])
    valid = texts.is_valid()
    made = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(out.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[where])))
    return pc.if_else(valid, made.cast(pa.string()), pa.scalar(None, pa.string()))


@F.arrow_udf(T.StringType())
def _last_box_udf(texts: pa.Array) -> pa.Array:
    return _last_boxes(texts)


def boxed_last(c: Column) -> Column:
    """Content of the last box at any nesting depth; unclosed runs to the end.

    Counting braces is beyond regular expressions, so this is a function over the bytes
    of Arrow batches. Texts without a box are not handed to Python.
    """
    boxed = F.when(c.contains("\\boxed"), c)
    found = F.coalesce(_last_box_udf(boxed), F.lit(""))
    cleaned = F.when(found.isin(*PLACEHOLDER_ANSWERS), F.lit("")).otherwise(strip(found))
    return F.when(c.isNull(), None).otherwise(cleaned)


# ---- think format --------------------------------------------------------------


def split_think(c: Column) -> Column:
    """``struct(reasoning, answer)`` around the first closing think tag."""

    def parts(t: Column) -> Column:
        closed = t.contains("</think>")
        head = strip(before(t, "</think>"))
        return F.struct(
            F.when(closed, strip(F.regexp_replace(head, r"(?U)<think>\s*", ""))).otherwise("").alias("reasoning"),
            F.when(closed, strip(after(t, "</think>"))).otherwise(t).alias("answer"),
        )

    return let(c, parts)


def thinking(c: Column, missing_open: bool = False) -> Column:
    """Text of the first think block; optionally also text before a lone closing tag."""
    block = F.regexp_like(c, F.lit(THINK))
    found = F.when(block, strip(F.regexp_extract(c, THINK, 1)))
    if missing_open:
        found = found.when(c.contains("</think>"), strip(before(c, "</think>")))
    return found.otherwise("")


def with_opening_think(c: Column) -> Column:
    lone = c.contains("</think>") & ~c.contains("<think>")
    return F.when(lone, F.concat(F.lit("<think>\n"), c)).otherwise(c)


def cut_at_end_mark(c: Column) -> Column:
    return strip(before(c, END_MARK))


def unwrap_answer(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<answer>(.*?)</answer>", "$1")


def with_thinking(reasoning: Column, body: Column) -> Column:
    block = F.concat(F.lit("<think>\n"), reasoning, F.lit("\n</think>\n\n"), body)
    return F.when(reasoning != "", block).otherwise(body)


# ---- channel format ------------------------------------------------------------


def _without_tokens(c: Column) -> Column:
    return strip(F.regexp_replace(c, TOKENS, ""))


def _without_words(c: Column, *words: str) -> Column:
    return strip(F.regexp_replace(c, rf"(?U)\b(?:{'|'.join(words)})\b", ""))


def split_channels(c: Column) -> Column:
    """``struct(reasoning, answer)``: final channel, else the word "final", else a leading "analysis"."""
    word_final = r"(?sU)\A(.*?)(?:assistant\s*)?final\s*(.*)\z"

    def tidy(reasoning: Column) -> Column:
        return _without_words(_without_words(reasoning, "assistant"), "analysis", "commentary")

    def parts(t: Column) -> Column:
        marked = t.contains(FINAL_MARK)
        worded = t.contains("final")
        return F.struct(
            F.when(marked, tidy(_without_tokens(strip(before(t, FINAL_MARK)))))
            .when(worded, tidy(strip(F.regexp_extract(t, word_final, 1))))
            .otherwise("")
            .alias("reasoning"),
            _without_tokens(
                F.when(marked, strip(after(t, FINAL_MARK)))
                .when(worded, strip(F.regexp_extract(t, word_final, 2)))
                .when(t.startswith("analysis"), strip(after(t, "analysis")))
                .otherwise(t)
            ).alias("answer"),
        )

    return let(c, parts)


def channel_thinking(c: Column) -> Column:
    """The analysis message, else the text without tokens and channel words."""
    message = r"(?s)<\|channel\|>analysis<\|message\|>(.*?)(?:<\|end\|>|\z)"
    return F.when(F.regexp_like(c, F.lit(message)), strip(F.regexp_extract(c, message, 1))).otherwise(
        _without_words(_without_tokens(c), "analysis", "commentary", "assistant")
    )


def channel_reply(c: Column, final_answer: Column) -> Column:
    """Answer turn: think block plus the stored answer, the final channel or the bare text."""
    given = F.coalesce(final_answer, F.lit(""))
    answer = (
        F.when(given != "", given)
        .when(c.contains(FINAL_MARK), _without_tokens(after(c, FINAL_MARK)))
        .otherwise(_without_words(_without_tokens(c), "analysis", "commentary", "assistant"))
    )
    return with_thinking(channel_thinking(c), answer)


def closed_book(c: Column) -> Column:
    """Answer without tokens and without the leading role and channel words."""
    lead = r"(?U)\A(?:assistant\s*)?(?:(?:analysis|commentary)\s*)*+"
    return strip(F.regexp_replace(_without_tokens(strip(c)), lead, ""))

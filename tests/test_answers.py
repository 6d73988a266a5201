"""Boxed answers, reasoning and verdicts on hand-made texts."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waybook.functions import answers, strings, verdicts


def test_boxed_first(one):
    cases = {
        "no box": "",
        r"\boxed{42}": "42",
        r"a \boxed{x{y}z} b": "xyz",
        r"\boxed{a{b{c}}}": "",
        r"\boxed{1} \boxed{2}": "1",
        r"\boxed{\text{Paris}\, France}": "Paris France",
        r"\boxed{12{,}000}": "12,000",
        r"\boxed{\textrm{A}  B}": "A B",
        r"\boxed{open": "",
        r"\boxed{}": "",
    }
    assert one(answers.boxed_first, *cases) == list(cases.values())


def test_boxed_first_survives_many_groups(one):
    assert one(answers.boxed_first, r"\boxed{" + "{a}" * 20000 + "}") == ["a" * 20000]


def test_boxed_last(one):
    cases = {
        "no box": "",
        r"\boxed{1} and \boxed{2}": "2",
        r"\boxed{a{b{c}}}": "a{b{c}}",
        r"\boxed{a\}b}": r"a\}b",
        r"\boxed{open {x} rest": "open {x} rest",
        r"\boxed{?}": "",
        r"\boxed{unknown}": "",
        r"\boxed{ Unknown }": "Unknown",
        r"\boxed {spaced}": "spaced",
        r"\boxedx{no}": "",
        r"\boxed{ok} \boxed none": "ok",
        r"\boxed{…}": "",
        r"\boxed{outer \boxed{inner}}": r"outer \boxed{inner}",
    }
    assert one(answers.boxed_last, *cases) == list(cases.values())
    assert one(answers.boxed_last, None) == [None]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab {}", max_size=12), min_size=1, max_size=20))
def test_boxes_agree_on_one_plain_group(one, inner):
    plain = [t.replace("{", "").replace("}", "") for t in inner]
    texts = [rf"x \boxed{{{t}}} y" for t in plain]
    first = one(answers.boxed_first, *texts)
    assert first == [" ".join(plain_last_box(t).split()) for t in texts]


def test_split_think(one):
    got = one(answers.split_think, "<think>\nwhy\n</think>\n\nans", "why</think>a</think>b", "plain ", "<think>open")
    assert [tuple(r) for r in got] == [("why", "ans"), ("why", "a</think>b"), ("", "plain "), ("", "<think>open")]


def test_split_channels(one):
    got = one(
        answers.split_channels,
        "<|channel|>analysis<|message|> think <|end|><|start|>assistant<|channel|>final<|message|>The answer<|return|>",
        "analysis think more assistant final Paris",
        "analysis only thinking",
        "nothing here",
        "the semifinal was lost",
    )
    assert [tuple(r) for r in got] == [
        ("think", "The answer"), ("think more", "Paris"), ("", "only thinking"), ("", "nothing here"), ("the semi", "was lost"),
    ]


def test_channel_reply_and_closed_book(one):
    thought = "<|channel|>analysis<|message|>hm<|end|><|channel|>final<|message|>42<|return|>"
    assert one(lambda c: answers.channel_reply(c, F.lit(None).cast("string")), thought) == ["<think>\nhm\n</think>\n\n42"]
    assert one(lambda c: answers.channel_reply(c, F.lit("given")), thought) == ["<think>\nhm\n</think>\n\ngiven"]
    assert one(answers.closed_book, "assistant analysis commentary 7", "<|x|>analysis 8", "the final 9") == ["7", "8", "the final 9"]


def test_repairs(one):
    assert one(answers.cut_at_end_mark, " a<|im_end|>b<|im_end|>", "c\n") == ["a", "c"]
    assert one(answers.unwrap_answer, "x <answer>1</answer> <answer>\n2</answer>") == ["x 1 \n2"]
    assert one(answers.with_opening_think, "a</think>b", "<think>a</think>b", "b") == ["<think>\na</think>b", "<think>a</think>b", "b"]
    assert one(lambda c: answers.thinking(c, True), "a </think>b", "<think> q </think>", "z") == ["a", "q", ""]


def test_strip_is_unicode(one):
    assert one(strings.strip, "  a b \n\t", "\x1c\x85x\x1f", "") == ["a b", "x", ""]


def test_cut_counts_characters(one):
    assert one(lambda c: strings.cut(c, 3, "..."), "abc", "abcd", "ab😀d") == ["abc", "abc...", "ab😀..."]


def test_is_json(one):
    cases = {
        "5": True, "5 abc": False, '"q"x': False, " 7 ": True, "": False, "1,2": False, "1],[2": False, '1}': False,
        '1, "w": 2': False, "null": True, '{"a": [1, 2]}': True, "[1": False, "{'a': 1}": False,
    }
    assert one(strings.is_json, *cases) == list(cases.values())


def test_safe_ints(one):
    assert one(strings.safe_int, " 5 ", "3.5", "x", "-2", None) == [5, None, None, -2, None]


def test_token_estimates(one):
    assert one(strings.tokens_at_least_one, None, "", "abc", "abcdefgh") == [0, 1, 1, 2]


def test_judge_replies(one):
    cases = {
        '{"correct": true, "explanation": "ok"}': (True, "ok"),
        '```json\n{"correct": true}\n```': (True, ""),
        'Sure ```{"correct": false, "explanation": "n"}``` end': (False, "n"),
        '{"correct": true, "explanation": "half': (True, '{"correct": true, "explanation": "half'),
        "no idea": (False, "no idea"),
        '{"correct": "no"}': (True, ""),
        '{"correct": 0}': (False, ""),
        '{"correct": null}': (False, ""),
        "[1]": (False, "Judge error"),
    }
    assert [tuple(r) for r in one(verdicts.judge_reply, *cases)] == list(cases.values())
    strict = one(lambda c: verdicts.judge_reply(c, lenient=False), '{"correct": true, "expl')
    assert [tuple(r) for r in strict] == [(False, "Judge error")]


def test_grader_replies(one):
    got = one(
        verdicts.grader_reply,
        "**extracted_final_answer:** Paris\n\n**reasoning:** same\nplace\n**correct:** yes",
        "**extracted_final_answer**: Rome\n**reasoning**: other\n**correct**: No",
        "extracted_final_answer: x\nreasoning: y\ncorrect: YES",
        "extracted_final_answer:",
        "nothing", "", None,
    )
    assert [tuple(r) for r in got] == [
        ("Paris", "same\nplace", True, False), ("Rome", "other", False, False), ("x", "y", True, False),
        ("", None, None, True), (None, None, None, True), (None, None, None, True), (None, None, None, True),
    ]


def test_offline_verdicts(spark):
    rows = spark.createDataFrame(
        [
            (1, "success", "Paris", "", "It is PARIS."), (2, "success", "", "", "anything"), (3, "error", "a", "a", "a"),
            (4, "success", "Paris France", " paris ", "x"), (5, "success", "a", "", "  "), (6, "success", "a", "b", "a"),
            (7, "success", "a", "  ", "a"),
        ],
        "i int, status string, ref string, boxed string, answer string",
    )
    def judge(**kw):
        v = verdicts.offline(F.col("status"), F.col("ref"), F.col("boxed"), F.col("answer"), **kw)
        return [tuple(r["v"]) for r in rows.select("i", v.alias("v")).orderBy("i").collect()]

    fallback = "fallback exact match"
    assert judge() == [
        (True, fallback), (True, fallback), (False, "no answer"), (True, fallback), (False, "no answer"), (False, fallback), (False, "Empty answer"),
    ]
    assert judge(empty_matches=False)[1] == (False, fallback)
    loose = rows.select("i", verdicts.loose_match(F.col("ref"), F.col("answer")).alias("v")).orderBy("i").collect()
    assert [r["v"] for r in loose] == [True, False, True, False, False, True, True]


_OPEN_BOX = re.compile(r"\\boxed\b\s*\{")
_BRACE_STEP = re.compile(r"\\.|[{}]", re.DOTALL)


def plain_last_box(text):
    """One text, brace by brace."""
    found, at = "", 0
    while opening := _OPEN_BOX.search(text, at):
        depth, end = 1, None
        for step in _BRACE_STEP.finditer(text, opening.end()):
            depth += {"{": 1, "}": -1}.get(step[0], 0)
            if depth == 0:
                end = step
                break
        if end is None:
            return text[opening.end() :]
        found, at = text[opening.end() : end.start()], end.end()
    return found


@pytest.mark.parametrize("seed", range(8))
def test_last_boxes_of_a_batch(seed):
    rng = random.Random(seed)
    parts = ["\\boxed{", "\\boxed  {", "\\boxed\u2003\n{", "\\boxedx{", "\\boxed", "{", "}", "}", "\\", "\\\\", "\\{", "\\}", "a", "é日", " ", "\n", "boxed{", "\\text{"]
    texts = [None if rng.random() < 0.05 else "".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(400)]
    for array in (pa.array(texts, pa.string()), pa.array(["skip", *texts], pa.large_string()).slice(1)):
        assert answers._last_boxes(array).to_pylist() == [None if t is None else plain_last_box(t) for t in texts]
    assert answers._last_boxes(pa.array([], pa.string())).to_pylist() == []
    assert answers._last_boxes(pa.array(["", None], pa.string())).to_pylist() == ["", None]

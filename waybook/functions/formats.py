"""Registry of wire formats and of verdict rules, open to the user.

A format is a set of column functions under a name; a verdict rule is a
function from named columns to ``struct(correct, explanation)``. Either may
wrap a ``pandas_udf``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from waybook.functions import answers, calls, verdicts
from waybook.functions.strings import let
from waybook.operators import context


@dataclass(frozen=True)
class Format:
    """``parse_call`` gives ``struct(namespace, tool, args_json)``, ``split`` gives ``struct(reasoning, answer)``.

    ``render_round(output, namespace, tool, response)`` and
    ``render_user(answer, message)`` give the text a turn adds to the prompt.
    """

    parse_call: Callable[[Column], Column]
    split: Callable[[Column], Column]
    render_round: Callable[[Column, Column, Column, Column], Column]
    render_user: Callable[[Column, Column], Column]


def _tagged_call(c: Column) -> Column:
    def shaped(call: Column) -> Column:
        json = calls.args_json(call["args"])
        return F.when(
            call.isNotNull(),
            F.struct(call["namespace"].alias("namespace"), call["tool"].alias("tool"), json.alias("args_json")),
        )

    return let(calls.tagged_or_json_call(c), shaped)


_FORMATS: dict[str, Format] = {
    "tagged": Format(
        _tagged_call, answers.split_think,
        lambda output, namespace, tool, response: context.tagged_round(output, response), context.tagged_user_turn,
    ),
    "tagged_plain": Format(
        _tagged_call, answers.split_think,
        lambda output, namespace, tool, response: context.tagged_round(output, response, thinking=False),
        lambda answer, message: context.tagged_user_turn(answer, message, thinking=False),
    ),
    "channel": Format(calls.channel_call, answers.split_channels, context.channel_round, context.channel_user_turn),
}

Verdict = Callable[[Mapping[str, Column]], Column]
_VERDICTS: dict[str, Verdict] = {
    "offline": lambda c: verdicts.offline(c["status"], c["reference_answer"], c["boxed_answer"], c["answer"]),
    "judge_reply": lambda c: verdicts.judge_reply(c["reply"]),
}


def register_format(name: str, fmt: Format) -> None:
    _FORMATS[name] = fmt


def get_format(name: str) -> Format:
    if name not in _FORMATS:
        raise KeyError(f"unknown format {name!r}; known: {', '.join(sorted(_FORMATS))}")
    return _FORMATS[name]


def register_verdict(name: str, rule: Verdict) -> None:
    _VERDICTS[name] = rule


def get_verdict(name: str) -> Verdict:
    if name not in _VERDICTS:
        raise KeyError(f"unknown verdict rule {name!r}; known: {', '.join(sorted(_VERDICTS))}")
    return _VERDICTS[name]

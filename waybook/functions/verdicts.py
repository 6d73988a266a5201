"""Judge replies and offline verdicts as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waybook.functions.strings import is_object, let, loose, parsed, strip


def _holds(v: Column) -> Column:
    """Truth of any JSON value: false, zero, null and empty are false."""
    kind = F.schema_of_variant(v)
    text = v.cast("string")
    return F.coalesce(
        F.when(kind == "VOID", False)
        .when(kind == "BOOLEAN", text == "true")
        .when(kind == "STRING", text != "")
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), ~text.isin("{}", "[]"))
        .otherwise(text.try_cast("double") != 0),
        F.lit(False),
    )


def judge_reply(c: Column, lenient: bool = True) -> Column:
    """``struct(correct, explanation)`` of a JSON reply, fenced or bare.

    Broken JSON is false; the lenient rule then still looks for the spelled-out verdict.
    """

    def bare(t: Column) -> Column:
        inside = F.split_part(t, F.lit("```"), F.lit(2))
        unlabelled = F.when(inside.startswith("json"), F.substring(inside, F.lit(5), F.length(inside))).otherwise(inside)
        return F.when(t.contains("```"), unlabelled).otherwise(t)

    def verdict(t: Column) -> Column:
        v = parsed(t)
        spelled = F.lower(t).contains('"correct": true') | F.lower(t).contains('"correct":true')
        lenient_correct = v.isNull() & spelled if lenient else F.lit(False)
        given = F.coalesce(F.try_variant_get(v, "$.explanation", "string"), F.lit(""))
        broken = F.left(t, F.lit(200)) if lenient else F.lit("Judge error")
        return F.struct(
            F.when(is_object(v), _holds(F.try_variant_get(v, "$.correct", "variant"))).otherwise(lenient_correct).alias("correct"),
            F.when(is_object(v), given).when(v.isNull(), broken).otherwise(F.lit("Judge error")).alias("explanation"),
        )

    return let(let(strip(c), bare), verdict)


def grader_reply(c: Column) -> Column:
    """``struct(extracted_final_answer, reasoning, correct, parse_error)`` of a labelled reply.

    Each label may be bold with the colon inside, bold with it outside, or plain.
    """

    def heads(label: str) -> list[str]:
        return [rf"\*\*{label}:\*\*", rf"\*\*{label}\*\*:", f"{label}:"]

    def first(t: Column, label: str, rests: list[str]) -> Column:
        # The label makes every match non-empty, so one search tells "no match" from "empty value".
        def value(head: str, rest: str) -> Column:
            bare = lambda m: F.when(m != "", F.regexp_replace(m, rf"(?isU)\A{head}\s*", ""))
            return let(F.regexp_extract(t, rf"(?isU){head}\s*{rest}", 0), bare)

        found = [value(head, rest) for head, rest in zip(heads(label), rests)]
        return F.coalesce(*found)

    line = [r".*?(?=\n|\z)"] * 3
    reason = [r".*?(?=\n\*\*correct:\*\*|\n\*\*correct\*\*:|\ncorrect:|\z)"] * 2 + [r".*?(?=\ncorrect:|\z)"]
    yes_no = ["(?:yes|no)"] * 3

    def parts(t: Column) -> Column:
        correct = F.lower(first(t, "correct", yes_no)) == "yes"
        return F.struct(
            strip(first(t, "extracted_final_answer", line)).alias("extracted_final_answer"),
            strip(first(t, "reasoning", reason)).alias("reasoning"),
            correct.alias("correct"),
            correct.isNull().alias("parse_error"),
        )

    return let(F.coalesce(c, F.lit("")), parts)


def offline(status: Column, reference: Column, boxed: Column, answer: Column, empty_matches: bool = True) -> Column:
    """``struct(correct, explanation)`` without a judge: one text contains the other.

    An empty reference is contained in everything; ``empty_matches=False`` makes it match nothing.
    """
    prediction = F.when(F.coalesce(boxed, F.lit("")) != "", boxed).otherwise(F.coalesce(answer, F.lit("")))
    ref = F.lower(strip(F.coalesce(reference, F.lit(""))))
    pred = F.lower(strip(prediction))
    match = pred.contains(ref) | ref.contains(pred)
    if not empty_matches:
        match = match & (ref != "")
    missing = F.coalesce(status != "success", F.lit(True)) | (strip(F.coalesce(answer, F.lit(""))) == "")
    return (
        F.when(missing, _verdict(F.lit(False), "no answer"))
        .when(pred == "", _verdict(F.lit(False), "Empty answer"))
        .otherwise(_verdict(match, "fallback exact match"))
    )


def _verdict(correct: Column, explanation: str) -> Column:
    return F.struct(correct.alias("correct"), F.lit(explanation).alias("explanation"))


def loose_match(reference: Column, prediction: Column) -> Column:
    """Progress estimate: both texts non-blank and one contains the other, loosely spelled."""
    ref, pred = loose(F.coalesce(reference, F.lit(""))), loose(F.coalesce(prediction, F.lit("")))
    return (ref != "") & (pred != "") & (pred.contains(ref) | ref.contains(pred))

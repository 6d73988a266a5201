"""Structure rules and the four conversions on hand-made records."""

from __future__ import annotations

import itertools
import json
import re

import pytest
from pyspark.sql import functions as F

from waybook.operators import audit, conversation
from waybook.plans import jobs

DEFS = {"web_search": '{"name": "web_search"}', "open_url": '{"name": "open_url"}'}


def test_alternation_accepts_exactly_the_pairs(spark):
    """All role strings up to length 4, as records and as turn rows."""
    letters = {"h": "human", "o": "observation", "g": "gpt", "f": "function_call", "s": "system"}
    words = ["".join(w) for n in range(1, 5) for w in itertools.product("hgs", repeat=n)] + ["hofg", "ofhg", "hfog", "xg", "hf"]
    letters["x"] = "narrator"
    rows = [(w, [(letters[c], "v") for c in w]) for w in words]
    df = spark.createDataFrame(rows, "w string, c array<struct<from:string,value:string>>")
    fits = lambda w: bool(re.fullmatch(r"([ho][gf])*", w.replace("s", "")))
    got = {r["w"]: r["ok"] for r in df.select("w", conversation.is_alternating(F.col("c")).alias("ok")).collect()}
    assert got == {w: fits(w) for w in words}

    closed = lambda w: w + "g" if w.replace("s", "")[-1:] in ("h", "o") and w.replace("s", "") else w
    got = {r["w"]: r["n"] for r in df.select("w", F.size(conversation.close(F.col("c"))).alias("n")).collect()}
    assert got == {w: len(closed(w)) for w in words}

    turns = conversation.explode_turns(df, "c").withColumn("pos", F.col("pos").cast("bigint"))
    kept, shape = conversation.assemble(turns, ["w"], width=2)
    spoken = [w for w in words if w.replace("s", "")]
    assert {r["w"]: r["valid"] for r in shape.collect()} == {w: fits(closed(w)) for w in spoken}
    packed = {r["w"]: len(r["conversations"]) for r in conversation.pack(kept, ["w"]).collect()}
    assert packed == {w: len(closed(w)) for w in spoken if fits(closed(w))}


def test_pack_splits_huge_conversations_without_loss(spark):
    turns = spark.range(1000).select(F.lit("big").alias("id"), F.col("id").alias("pos"), F.lit("human").alias("from"), F.col("id").cast("string").alias("value"))
    records = conversation.pack(turns, ["id"]).collect()
    assert len(records) == 1 and [t["value"] for t in records[0]["conversations"]] == [str(i) for i in range(1000)]


def records_of(conversion):
    rows = conversion.records().collect()
    return {(r["id"],): ([(t["from"], t["value"]) for t in r["conversations"]], r["tools"]) for r in rows}


def outcomes_of(conversion):
    return {tuple(r[k] for k in conversion.keys): r["outcome"] for r in conversion.outcomes.collect()}


def test_native(spark):
    records = spark.createDataFrame(
        [
            ("ok", "success", 1, "sys", "Q"), ("bad status", "error", 1, "", "Q"), ("no calls", "success", None, "", "Q"), ("empty", "success", 1, "", "Q"),
            ("two replies", "success", 1, "", "Q"), ("open end", "success", 1, None, "Q"), ("unknown tool", "success", 1, "", "Q"),
        ],
        "id string, status string, num_tool_calls int, system_prompt string, question string",
    )
    call = "<think>why</think><tool_call><function={}><parameter=query>x</parameter></function></tool_call>"
    data = [
        ("ok", "assistant", call.format("web_search")), ("ok", "tool", "res"), ("ok", "note", "dropped"), ("ok", "assistant", " done <|im_end|>x"),
        ("bad status", "assistant", "a"), ("no calls", "assistant", "a"),
        ("two replies", "assistant", "a"), ("two replies", "assistant", "b"),
        ("open end", "assistant", call.format("open_url")), ("open end", "tool", "page"),
        ("unknown tool", "assistant", call.format("fly")), ("unknown tool", "tool", "r"), ("unknown tool", "assistant", "end"),
    ]
    turns = spark.createDataFrame([(i, pos, r, c) for pos, (i, r, c) in enumerate(data)], "id string, pos long, role string, content string")
    made = jobs.native_conversations(records, turns, DEFS)
    text = '<think>\nwhy\n</think>\n\n<tool_call>\n[{"name": "%s", "arguments": {"query": "x"}}]\n</tool_call>'
    assert records_of(made) == {
        ("ok",): ([("system", "sys"), ("human", "Q"), ("function_call", text % "web_search"), ("observation", "res"), ("gpt", "done")], '[{"name": "web_search"}]'),
        ("open end",): ([("human", "Q"), ("function_call", text % "open_url"), ("observation", "page"), ("gpt", "")], '[{"name": "open_url"}]'),
        ("unknown tool",): ([("human", "Q"), ("function_call", text % "fly"), ("observation", "r"), ("gpt", "end")], ""),
    }
    assert outcomes_of(made) == {
        ("ok",): "converted", ("open end",): "converted", ("unknown tool",): "converted", ("bad status",): "filtered", ("no calls",): "filtered",
        ("empty",): "skipped", ("two replies",): "skipped",
    }
    one = made.accounting().first()
    assert tuple(one) == (7, 2, 3, 2)
    assert {r["from"]: r["n"] for r in made.roles().collect()} == {"human": 3, "function_call": 3, "observation": 3, "gpt": 3, "system": 1}


def test_foreign(spark):
    schema = "id string, question string, type string, num_tool_calls int, tokenized_length int"
    records = spark.createDataFrame(
        [("a", "Q", "short", 1, 10), ("lone", "Q", "short", 1, None), ("broken", "Q", "short", 1, 5), ("long", "Q", "short", 1, 99_999), ("type", "Q", "exact", 1, 1)], schema
    )
    payload = json.dumps({"searchParameters": {"q": "x"}, "organic": [{"title": "T", "link": "L", "snippet": "S", "snippet_id": "S_1"}]})
    data = [
        ("a", "user", json.dumps("[{'type': 'text', 'text': 'Asked'}]"), None), ("a", "assistant", json.dumps("<think>t</think>"), "serper_google_webpage_search(query='x')"),
        ("a", "environment", json.dumps(repr({"type": "text", "text": payload})), None), ("a", "assistant", json.dumps("so <answer>42</answer>"), None),
        ("lone", "user", json.dumps("only"), None),
        ("broken", "user", json.dumps("q"), None), ("broken", "assistant", json.dumps("x"), "not a call"), ("broken", "environment", json.dumps("e"), None),
    ]
    rows = [(i, pos, r, c, f) for pos, (i, r, c, f) in enumerate(data)]
    messages = spark.createDataFrame(rows, "id string, pos long, role string, c string, function_calls string")
    messages = messages.withColumn("content", F.try_parse_json("c")).drop("c")
    made = jobs.foreign_conversations(records, messages, DEFS, "SYS", ["short"])
    shown = 'Searched for "x"\n\n[1] T\n    URL: L\n    Snippet [S_1]: S\n'
    assert records_of(made) == {
        ("a",): (
            [
                ("system", "SYS"), ("human", "Asked"),
                ("function_call", '<think>\nt\n</think>\n\n<tool_call>\n[{"name": "web_search", "arguments": {"query": "x"}}]\n</tool_call>'),
                ("observation", shown), ("gpt", "so 42"),
            ],
            '[{"name": "web_search"}]',
        )
    }
    assert outcomes_of(made) == {("a",): "converted", ("lone",): "skipped", ("broken",): "skipped", ("long",): "filtered", ("type",): "filtered"}


def test_channel_and_selfplay(spark):
    records = spark.createDataFrame(
        [("q1", 0, "Q", "success", 1, 3), ("q1", 1, "Q", "error", 1, 3), ("q2", 0, "Q", "success", 1, 1), ("q3", 0, "Q", "success", 1, 0)],
        "qid string, traj_idx int, question string, status string, num_tool_calls int, num_turns int",
    )
    analysis = "<|channel|>analysis<|message|>{}<|end|>"
    data = [
        ("q1", 0, "assistant", analysis.format("hm"), "browser.search", '{"query": "x", "topn": 10}', None),
        ("q1", 0, "tool", "res", None, None, None),
        ("q1", 0, "assistant", analysis.format("ok") + "<|channel|>final<|message|>42", None, None, None),
        ("q1", 1, "assistant", "x", None, None, "given"),
        ("q2", 0, "assistant", "x", "unknown.tool", "{}", None),
    ]
    rows = [(*d[:2], pos, *d[2:]) for pos, d in enumerate(data)]
    turns = spark.createDataFrame(rows, "qid string, traj_idx int, pos long, role string, content string, tool string, args string, final_answer string")
    made = jobs.channel_conversations(records, turns, "SYS", definitions={"a": '{"name": "a"}', "b": '{"name": "b"}'})
    call = '<think>\nhm\n</think>\n\n<tool_call>\n[{"name": "web_search", "arguments": {"query": "x"}}]\n</tool_call>'
    assert records_of(made) == {
        ("q1_0",): ([("system", "SYS"), ("human", "Q"), ("function_call", call), ("observation", "res"), ("gpt", "<think>\nok\n</think>\n\n42")], '[{"name": "a"}, {"name": "b"}]')
    }
    assert outcomes_of(made) == {("q1", 0): "converted", ("q1", 1): "filtered", ("q2", 0): "skipped", ("q3", 0): "filtered"}

    tagged = [
        ("q1", 0, "assistant", "why</think><tool_call><function=web_search><parameter=query>x</parameter></function>"), ("q1", 0, "tool", "res"),
        ("q1", 0, "assistant", "t</think>42"), ("q1", 1, "assistant", "<tool_call>broken"), ("q1", 1, "tool", "r"), ("q2", 0, "assistant", "a"),
    ]
    rows = [(*d[:2], pos, *d[2:]) for pos, d in enumerate(tagged)]
    turns = spark.createDataFrame(rows, "qid string, traj_idx int, pos long, role string, content string")
    right = spark.createDataFrame([("q1", 1, True), ("q1", 0, False), ("q2", 0, False)], "qid string, traj_idx int, correct boolean")
    made = jobs.selfplay_conversations(records, turns, right, "SYS")
    assert outcomes_of(made) == {("q1", 0): "converted", ("q1", 1): "skipped", ("q2", 0): "filtered", ("q3", 0): "filtered"}
    (got, _), = records_of(made).values()
    assert got[2][1].startswith("<think>\nwhy\n</think>\n\n<tool_call>") and got[-1] == ("gpt", "<think>\nt</think>42")


def test_containing_matches_brute_force(spark):
    texts = ["one two three four five six seven", "xone two three four fivex", "short", "", "a b c", "aa bb", "tail end", "😀 x 😀 y 😀 z 😀 w", "one two  three"]
    markers = ["one two three four five", "two three", "o", "aa bb", "end", "b", "😀 x 😀 y 😀 z", "two three four", "missing words here and there now", "hort"]
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    m = spark.createDataFrame(list(enumerate(markers)), "mid int, marker string")
    got = {(r["id"], r["mid"]) for r in audit.containing(t, "id", "text", m, "mid", "marker").collect()}
    assert got == {(i, j) for i, x in enumerate(texts) for j, y in enumerate(markers) if y in x}
    long_only = m.where(F.length("marker") > 20)
    flagged = audit.contaminated_by(t, "id", "text", long_only, "mid", "marker")
    assert {r["id"] for r in flagged.where("contaminated").collect()} == {0, 1}
    assert flagged.count() == len(texts)


@pytest.mark.parametrize("content, want", [("see marker here", True), (None, False), ("clean", False)])
def test_contaminated_turns(spark, content, want):
    df = spark.createDataFrame([([("tool", content), ("assistant", "marker")],)], "t array<struct<role:string,content:string>>")
    assert df.select(audit.contaminated_turns(F.col("t"), ["marker"]).alias("c")).first()["c"] is want

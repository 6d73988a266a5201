"""Tool call syntaxes on hand-made texts."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from waybook.functions import calls


def loads(value):
    return None if value is None else json.loads(value)


def test_tagged_calls(one):
    def shown(c):
        return F.to_json(F.struct(calls.tagged_call(c).alias("c")))

    full = (
        "<think>\n why \n</think>\n\n<tool_call>\n<function=web_search>\n<parameter=query>\n a \"b\"\n c \n</parameter>"
        "<parameter=topn>5</parameter><parameter=deep>true</parameter><parameter=ids>[1, 2]</parameter>"
        "<parameter=q>\"7\"</parameter><parameter=topn>6</parameter></function></tool_call>"
    )
    got = [json.loads(v).get("c") for v in one(shown, full, "no call", "<tool_call>\n<function=x>broken", "<think>a</think>")]
    assert got[1:] == [None, None, None]
    assert (got[0]["think"], got[0]["name"]) == ("why", "web_search")
    args = one(lambda c: calls.args_json(calls.tagged_call(c)["args"]), full)[0]
    assert json.loads(args) == {"query": 'a "b"\n c', "topn": 6, "deep": True, "ids": [1, 2], "q": "7"}
    assert list(json.loads(args)) == ["query", "topn", "deep", "ids", "q"]


def test_tagged_or_json_calls(one):
    def shown(c):
        call = calls.tagged_or_json_call(c)
        return F.concat_ws("|", call["namespace"], call["tool"], calls.args_json(call["args"]))

    got = one(
        shown,
        "<tool_call><function=find_text><parameter=pattern>x</parameter></function>",
        '<tool_call>\n{"name": "python", "arguments": {"code": "1+1"}}\n</tool_call>',
        '<tool_call>{"name": "new_tool", "arguments": {"b": 1, "a": 2}}',
        "<tool_call>{broken}</tool_call>",
        "text",
    )
    assert got == ['browser|find|{"pattern": "x"}', 'python|execute|{"code": "1+1"}', 'functions|new_tool|{"b": 1, "a": 2}', "", ""]


@pytest.mark.parametrize(
    "text, want",
    [
        ("to=python<|message|> print(1) <|call|>", ("python", "execute", {"code": "print(1)"})),
        ("commentary to=python code\nprint(2)", ("python", "execute", {"code": "print(2)"})),
        ("to=python print(3)", ("python", "execute", {"code": "print(3)"})),
        ("to=python<|message|><|call|>", None),
        ("to=pythonic<|message|>x", None),
        ('<|message|>x to=browser.search<|message|>{"query": "a"}<|call|>{"query": "b"}', ("browser", "search", {"query": "a"})),
        ('to=functions.paper_search code {"query": {"n": 1}} tail', ("functions", "paper_search", {"query": {"n": 1}})),
        ('to=browser.open so {"id": 3} more', ("browser", "open", {"id": 3})),
        ('to=browser.open<|message|>"{\\"id\\": 4}"', ("browser", "open", {"id": 4})),
        ('to=browser.search<|message|>{"query": "salvage", oops', ("browser", "search", {"query": "salvage"})),
        ('to=browser.find<|message|>{"pattern": "p", oops', ("browser", "find", {"pattern": "p"})),
        ('to=browser.open<|message|>{"id": 12, oops', ("browser", "open", {"id": 12})),
        ('to=browser.open<|message|>{"id": "https://x.org/a", oops', ("browser", "open", {"id": "https://x.org/a"})),
        ("to=browser.open<|message|>nothing", None),
        ('to=browser.searching<|message|>{}<|call|> to=browser.search<|message|>{"query": 1}', ("browser", "searching", {})),
        ("no call", None),
    ],
)
def test_channel_calls(one, text, want):
    got = one(calls.channel_call, text)[0]
    assert (got and (got["namespace"], got["tool"], json.loads(got["args_json"]))) == want


def test_keyword_calls(one):
    def shown(c):
        call = calls.keyword_call(c)
        return F.when(call.isNotNull(), F.concat(call["name"], F.lit(" "), calls.args_json(call["args"])))

    got = one(
        shown,
        " search(query='a \"b\"', limit=007)\n", "search(query=\"it's\", year='2020', x = '')", "search()", "search(a, b)",
        "search(q='1', q='2')", "no call", "search(q='x') tail", "f(naïve='é')",
    )
    assert [g and (g.split(" ", 1)[0], json.loads(g.split(" ", 1)[1])) for g in got] == [
        ("search", {"query": 'a "b"', "limit": 7}), ("search", {"query": "it's", "year": 2020, "x": None}), ("search", {}), ("search", {}),
        ("search", {"q": 2}), None, None, ("f", {"naïve": "é"}),
    ]


def test_server_calls(one):
    def call(server, tool, args):
        return (
            f"<use_mcp_tool>\n<server_name>{server}</server_name>\n<tool_name>{tool}</tool_name>\n<arguments>\n{args}\n</arguments>\n</use_mcp_tool>"
        )

    def shown(c):
        return F.transform(
            calls.server_calls(c), lambda k: F.concat_ws("|", k["server"], k["tool"], calls.args_json(k["args"]))
        )

    got = one(
        shown,
        "I " + call("bad", "google_search", '{"q": "x", "n": null}') + call("bad", "python", "{'code_block': 'a', 'ok': True}"),
        call("srv", "other", "{broken"), call("srv", "other", "[1, 2]"), "no call",
        call("tool-python", "google_search", "{}") + "<server_name>search_and_scrape_webpage</server_name>",
    )
    assert got[0] == ['search_and_scrape_webpage|google_search|{"q": "x"}', 'tool-python|run_python_code|{"code_block": "a", "ok": true}']
    assert json.loads(got[1][0].split("|")[2]) == {"error": "Failed to parse arguments", "raw": "{broken"}
    assert got[2] == ["srv|other|{}"] and got[3] == []
    assert got[4] == ["tool-python|google_search|{}"], "the right server tag elsewhere blocks the repair"
    assert one(calls.text_before_call, " see <use_mcp_tool> <use_mcp_tool>", " x ") == ["see", "x"]


def test_argument_rules(one):
    clean = lambda tool: lambda c: calls.args_json(calls.cleaned_args(F.lit(tool), calls.object_args(c)))
    assert one(clean("web_search"), '{"query": "a", "num_results": 10}', '{"top_n": 3, "query": " "}', '{"topn": "10"}') == [
        '{"query": "a"}', '{"topn": 3}', '{"topn": "10"}',
    ]
    assert one(clean("open_url"), '{"id": "view-source:", "loc": 2}', '{"id": "view-source:http://a"}') == ['{"loc": 2}', '{"id": "http://a"}']
    assert one(clean("unlisted"), '{"z": 1, "a": {"b": [2]}}') == ['{"z": 1, "a": {"b":[2]}}']
    fixed = lambda tool: lambda c: calls.args_json(calls.repaired_server_args(F.lit(tool), calls.object_args(c)))
    assert one(fixed("scrape_and_extract_info"), '{"introduction": "i", "description": "d"}', '{"info_to_extract": "x", "description": "d"}') == [
        '{"introduction": "i", "info_to_extract": "d"}', '{"info_to_extract": "x", "description": "d"}',
    ]
    assert one(fixed("python"), '{"code": "1", "sandbox_id": "s"}') == ['{"code_block": "1", "sandbox_id": "s"}']


def test_repeat_keys(one):
    key = lambda tool: lambda c: calls.repeat_key(F.lit(tool), calls.object_args(c))
    assert one(key("google_search"), '{"q": " a "}', "{}") == ["google_search:a", "google_search:"]
    assert one(key("scrape_and_extract_info"), '{"url": "u", "info_to_extract": " i"}') == ["scrape_and_extract_info:u:i"]
    assert one(key("run_command"), "{}") == [None]


def test_the_last_of_repeated_keys_counts(one):
    got = one(calls.channel_call, 'to=browser.search<|message|>{"query": "a", "query": "b"}<|call|>')[0]
    assert got["args_json"] == '{"query": "a", "query": "b"}'  # the text as given; reading it takes the last
    read = one(lambda c: calls.args_json(calls.object_args(calls.channel_call(c)["args_json"])), 'to=browser.search<|message|>{"query": "a", "query": "b"}<|call|>')
    assert read == ['{"query": "b"}']
    block = "<use_mcp_tool>\n<server_name>s</server_name>\n<tool_name>t</tool_name>\n<arguments>\n{}\n</arguments>\n</use_mcp_tool>".replace("{}", '{"a": 1, "b": [1, {"c": "x"}], "a": 2}')
    made = one(lambda c: calls.args_json(calls.server_calls(c)[0]["args"]), block)
    assert made == ['{"a": 2, "b": [1,{"c":"x"}]}']
    body = '<tool_call>{"name": "web_search", "arguments": {"query": "a", "query": "b"}}</tool_call>'
    assert one(lambda c: calls.args_json(calls.tagged_or_json_call(c)["args"]), body) == ['{"query": "b"}']
    assert one(calls.object_args, "5", "null", "[1]", '{"a": 1} x', "{'a': 1}", None) == [None] * 6

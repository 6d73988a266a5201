"""Tool calls out of raw model text.

Arguments are an ordered ``array<struct<key, json>>``: ``json`` is the JSON
text of the value, so order and number spelling survive. A repeated key keeps
its first place and its last value.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from waybook import constants as K
from waybook.functions.answers import THINK
from waybook.functions.strings import (
    is_json,
    json_or_text,
    json_text,
    let,
    parsed,
    strip,
)

ARGS_TYPE = "array<struct<key:string,json:string>>"

# ---- fixed values: call syntax of the four wire formats ------------------------
TAGGED_CALL = r"(?sU)<tool_call>\s*<function=(\w+)>(.*?)</function>"
TAGGED_PARAM = r"(?sU)<parameter=(\w+)>\s*(.*?)\s*</parameter>"
TAGGED_JSON_CALL = r"(?sU)<tool_call>\s*(\{.*?\})\s*(?:</tool_call>|\z)"
BRACES = r"(\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\})"
CHANNEL_MESSAGE = r"(?s)<\|message\|>(.*?)(?:<\|call\|>|<\|end\|>|\z)"
CHANNEL_CODE = r"(?sU)to=python\b(.*)\z"
CHANNEL_NAME = r"(?U)to=(?:browser|functions)\.\w+"
KEYWORD_CALL = r"(?sU)\A(\w+)\((.*)\)\z"
KEYWORD_ARG = r"""(?U)(\w+)\s*=\s*(?:'([^']*)'|"([^"]*)"|(\d+))"""
SERVER_CALL = (
    r"(?sU)<use_mcp_tool>\s*<server_name>(.*?)</server_name>\s*<tool_name>(.*?)</tool_name>"
    r"\s*<arguments>\s*(.*?)\s*</arguments>\s*</use_mcp_tool>"
)


# ---- arguments -----------------------------------------------------------------


def _pair(key: Column, json: Column) -> Column:
    return F.struct(key.alias("key"), json.alias("json"))


def one_arg(key: str, json: Column) -> Column:
    return F.array(_pair(F.lit(key), json))


def no_args() -> Column:
    return F.array().cast(ARGS_TYPE)


def last_wins(args: Column) -> Column:
    """Each key once, in the place of its first value and with the last one; only repeated keys cost a search."""

    def settle(a: Column, keys: Column) -> Column:
        last = F.transform(keys, lambda k: _pair(k, F.element_at(F.filter(a, lambda e: e.key == k), -1).json))
        return F.when(F.size(keys) == F.size(a), a).otherwise(last)

    return let(args, lambda a: let(F.array_distinct(F.transform(a, lambda e: e.key)), lambda keys: settle(a, keys)))


def object_args(json: Column) -> Column:
    """Arguments of a JSON object in document order, null when it is none; of a repeated key the last value counts."""

    strict = {"allowSingleQuotes": "false"}

    def entries(j: Column) -> Column:
        # one value only when it reads both as the sole item of an array and as the value of an object, as in `is_json`
        item = F.from_json(F.concat(F.lit("["), j, F.lit("]")), "array<map<string,variant>>", strict)
        value = F.from_json(F.concat(F.lit('{"v":'), j, F.lit("}")), "v string", strict)["v"]
        read = F.map_entries(F.when(F.size(item) == 1, F.get(item, F.lit(0))))
        return F.when(value.isNotNull(), last_wins(F.transform(read, lambda e: _pair(e["key"], F.coalesce(F.to_json(e["value"]), F.lit("null"))))))

    return let(json, entries)


def arg_json(args: Column, key: str) -> Column:
    return F.try_element_at(F.filter(args, lambda e: e.key == key), F.lit(-1)).json


def arg_text(args: Column, key: str) -> Column:
    """An argument as plain text: strings without quotes, the rest as JSON."""
    return F.try_parse_json(arg_json(args, key)).cast("string")


def args_json(args: Column) -> Column:
    """The JSON object of the arguments, in their order."""
    items = F.transform(args, lambda e: F.concat(json_text(e.key), F.lit(": "), e.json))
    return F.concat(F.lit("{"), F.array_join(items, ", "), F.lit("}"))


def call_text(name: Column, args: Column) -> Column:
    """The body of a function_call turn."""
    return F.concat(
        F.lit('<tool_call>\n[{"name": '), json_text(name), F.lit(', "arguments": '), args_json(args),
        F.lit("}]\n</tool_call>"),
    )


# ---- tagged calls --------------------------------------------------------------


def _params(body: Column) -> Column:
    pattern = F.lit(TAGGED_PARAM)
    pairs = F.arrays_zip(
        F.regexp_extract_all(body, pattern, 1).alias("key"), F.regexp_extract_all(body, pattern, 2).alias("json")
    )
    return last_wins(F.transform(pairs, lambda p: _pair(p["key"], json_or_text(strip(p["json"])))))


def tagged_call(c: Column) -> Column:
    """``struct(think, name, args)`` of the first function tag, null when there is none."""

    def call(whole: Column) -> Column:
        # The first match is also the first occurrence of its own text.
        lead = F.left(c, F.instr(c, whole) - 1)
        return F.when(
            whole != "",
            F.struct(
                strip(F.regexp_extract(lead, THINK, 1)).alias("think"),
                F.regexp_extract(whole, TAGGED_CALL, 1).alias("name"),
                _params(F.regexp_extract(whole, TAGGED_CALL, 2)).alias("args"),
            ),
        )

    return let(F.when(c.contains("<tool_call>"), F.regexp_extract(c, TAGGED_CALL, 0)), call)


def tagged_or_json_call(c: Column) -> Column:
    """``struct(namespace, tool, args)``: function tags first, then a JSON body."""
    backends = K.TAGGED_TOOL_BACKENDS
    space = F.create_map(*[F.lit(x) for k, v in backends.items() for x in (k, v[0])])
    tools = F.create_map(*[F.lit(x) for k, v in backends.items() for x in (k, v[1])])

    def routed(name: Column, args: Column) -> Column:
        return F.struct(
            F.coalesce(F.element_at(space, name), F.lit("functions")).alias("namespace"),
            F.coalesce(F.element_at(tools, name), name).alias("tool"),
            args.alias("args"),
        )

    def by_json(body: Column) -> Column:
        def of(v: Column) -> Column:
            return routed(F.coalesce(v["name"], F.lit("")), F.coalesce(object_args(v["arguments"]), no_args()))

        whole = F.when(is_json(body) & strip(body).startswith("{"), body)
        return F.when(whole.isNotNull(), let(F.from_json(whole, "name string, arguments string", {"allowSingleQuotes": "false"}), of))

    tagged = let(tagged_call(c), lambda t: F.when(t.isNotNull(), routed(t["name"], t["args"])))
    body = F.when(F.regexp_like(c, F.lit(TAGGED_JSON_CALL)), F.regexp_extract(c, TAGGED_JSON_CALL, 1))
    return F.coalesce(tagged, by_json(body))


# ---- channel calls -------------------------------------------------------------


def _code_of(rest: Column) -> Column:
    def pick(r: Column) -> Column:
        return (
            F.when(r.contains("<|message|>"), F.regexp_extract(r, CHANNEL_MESSAGE, 1))
            .when(r.contains("code"), F.regexp_extract(r, r"(?sU)code\s*(.*)\z", 1))
            .otherwise(r)
        )

    return strip(let(rest, pick))


def _body_of(rest: Column) -> Column:
    after_word = rf"(?sU)(?:json|code)\s*{BRACES}"

    def braces(r: Column, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(r, pattern, 1), F.lit(""))

    def pick(r: Column) -> Column:
        return F.when(r.contains("<|message|>"), strip(F.regexp_extract(r, CHANNEL_MESSAGE, 1))).otherwise(
            F.coalesce(braces(r, after_word), braces(r, BRACES), strip(r))
        )

    def unwrap(b: Column) -> Column:
        quoted = b.startswith('"') & b.endswith('"')
        bare = F.substring(b, F.lit(2), F.greatest(F.length(b) - 2, F.lit(0)))
        return F.when(quoted, F.coalesce(parsed(b).cast("string"), bare)).otherwise(b)

    return let(let(rest, pick), unwrap)


def _salvaged(body: Column) -> Column:
    """One usable argument out of broken JSON: query, pattern, then a numeric or URL id."""
    rules = [
        ("query", r'"query"\s*:\s*"([^"]*)"', json_text),
        ("pattern", r'"pattern"\s*:\s*"([^"]*)"', json_text),
        ("id", r'"id"\s*:\s*(\d+)', lambda n: F.regexp_replace(n, r"\A0+(?=\d)", "")),
        ("id", r'"id"\s*:\s*"(https?://[^"]*)"', json_text),
    ]
    found = [
        F.when(
            F.regexp_like(body, F.lit(f"(?U){rule}")),
            F.concat(F.lit(f'{{"{field}": '), spell(F.regexp_extract(body, f"(?U){rule}", 1)), F.lit("}")),
        )
        for field, rule, spell in rules
    ]
    return F.coalesce(*found)


def channel_call(c: Column) -> Column:
    """``struct(namespace, tool, args_json)`` of a channel-style call, null when there is none."""

    def call(namespace: Column, tool: Column, json: Column) -> Column:
        return F.struct(namespace.alias("namespace"), tool.alias("tool"), json.alias("args_json"))

    def by_code(code: Column) -> Column:
        json = F.concat(F.lit('{"code": '), json_text(code), F.lit("}"))
        return F.when(code != "", call(F.lit("python"), F.lit("execute"), json))

    def by_name(name: Column) -> Column:
        def named(body: Column) -> Column:
            json = F.when(is_json(body), body).otherwise(_salvaged(body))
            parts = F.split(F.substring(name, F.lit(len("to=") + 1), F.length(name)), r"\.")
            return F.when(json.isNotNull(), call(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), json))

        rest = F.substring(c, F.instr(c, name) + F.length(name), F.length(c))
        return F.when(name != "", let(_body_of(rest), named))

    rest_of_code = F.nullif(F.regexp_extract(F.when(c.contains("to=python"), c), CHANNEL_CODE, 0), F.lit(""))
    code = let(rest_of_code, lambda r: _code_of(F.regexp_extract(r, CHANNEL_CODE, 1)))
    called = c.contains("to=")
    return F.when(called, F.coalesce(let(code, by_code), let(F.regexp_extract(c, CHANNEL_NAME, 0), by_name)))


# ---- keyword calls -------------------------------------------------------------


def keyword_call(c: Column) -> Column:
    """``struct(name, args)`` of ``name(k='v', n=3)``; values are quoted without escapes or digits.

    An empty quoted value counts as missing (JSON null); all-digit values are integers.
    """

    def value(quoted: Column, double: Column, digits: Column) -> Column:
        text = F.coalesce(*[F.when(v != "", v) for v in (quoted, double, digits)])
        number = F.regexp_replace(text, r"\A0+(?=\d)", "")
        return F.when(text.isNull(), F.lit("null")).when(text.rlike(r"\A\d+\z"), number).otherwise(json_text(text))

    def args(body: Column) -> Column:
        groups = [F.regexp_extract_all(body, F.lit(KEYWORD_ARG), i).alias(f"g{i}") for i in (1, 2, 3, 4)]
        return last_wins(
            F.transform(F.arrays_zip(*groups), lambda g: _pair(g["g1"], value(g["g2"], g["g3"], g["g4"])))
        )

    def call(t: Column) -> Column:
        made = F.struct(
            F.regexp_extract(t, KEYWORD_CALL, 1).alias("name"),
            args(strip(F.regexp_extract(t, KEYWORD_CALL, 2))).alias("args"),
        )
        return F.when(F.regexp_like(t, F.lit(KEYWORD_CALL)), made)

    return let(strip(c), call)


def renamed(name: Column, names: Mapping[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.element_at(table, name), name)


def _truthy(json: Column) -> Column:
    return F.coalesce(~json.isin("null", "false", "0", "0.0", '""', "[]", "{}"), F.lit(False))


def _as_int(json: Column) -> Column:
    return F.try_parse_json(json).cast("string").try_cast("bigint").cast("string")


def foreign_args(tool: Column, args: Column) -> Column:
    """Arguments of a foreign call under the training names of its (renamed) tool."""
    query = F.coalesce(arg_json(args, "query"), F.lit('""'))
    url = F.coalesce(arg_json(args, "query"), arg_json(args, "url"), F.lit('""'))

    def optional(source: str, target: str, spell=lambda j: j) -> Column:
        j = arg_json(args, source)
        return F.when(_truthy(j), one_arg(target, spell(j))).otherwise(no_args())

    return (
        F.when(tool == "web_search", F.concat(one_arg("query", query), optional("num_results", "topn", _as_int)))
        .when(tool == "open_url", one_arg("id", url))
        .when(
            tool == "paper_search",
            F.concat(
                one_arg("query", query),
                optional("limit", "limit", _as_int),
                optional("year", "year"),
                optional("fieldsOfStudy", "fields_of_study"),
            ),
        )
        .otherwise(args)
    )


def cleaned_args(tool: Column, args: Column) -> Column:
    """Known keys under their right names, without defaults, blanks and view-source prefixes."""
    text = lambda e: F.try_parse_json(e.json).cast("string")
    is_text = lambda e: e.json.startswith('"')
    prefix = "view-source:"

    def kept(e: Column) -> Column:
        listed = reduce(
            lambda acc, item: acc.when(tool == item[0], e.key.isin(*item[1])), K.ALLOWED_ARGS.items(), F.when(F.lit(False), False)
        ).otherwise(True)
        default = reduce(
            lambda a, b: a | b,
            [(tool == t) & (e.key == k) & F.coalesce(text(e).try_cast("double") == v, F.lit(False)) & ~is_text(e)
             for (t, k), v in K.ARG_DEFAULTS.items()],
        )
        return listed & ~default & ~(is_text(e) & (strip(text(e)) == ""))

    def source(e: Column) -> Column:
        page = (tool == "open_url") & (e.key == "id") & is_text(e) & text(e).startswith(prefix)
        bare = F.substring(text(e), F.lit(len(prefix) + 1), F.length(e.json))
        return _pair(e.key, F.when(page, json_text(bare)).otherwise(e.json))

    named = F.transform(args, lambda e: _pair(renamed(e.key, K.ARG_RENAMES), e.json))
    viewed = F.transform(F.filter(named, kept), source)
    bare_id = lambda e: (tool == "open_url") & (e.key == "id") & (e.json == '""')
    return last_wins(F.filter(viewed, lambda e: ~bare_id(e)))


# ---- server-tagged calls -------------------------------------------------------


def repaired_server_text(c: Column) -> Column:
    """Right tool and server names, in the order of the server table."""
    fixed = reduce(
        lambda t, wrong: F.replace(
            t, F.lit(f"<tool_name>{wrong}</tool_name>"), F.lit(f"<tool_name>{K.CODE_TOOL_NAME}</tool_name>")
        ),
        K.WRONG_CODE_TOOL_NAMES,
        c,
    )
    servers = F.array(
        *[F.struct(F.lit(f"<tool_name>{t}</tool_name>").alias("tool"), F.lit(f"<server_name>{s}</server_name>").alias("server"))
          for t, s in K.TOOL_SERVERS.items()]
    )

    def step(t: Column, rule: Column) -> Column:
        wrong = F.contains(t, rule["tool"]) & ~F.contains(t, rule["server"])
        pattern = F.concat(F.lit(r"(?U)<server_name>[^<]+</server_name>(\s*"), rule["tool"], F.lit(")"))
        return F.when(wrong, F.regexp_replace(t, pattern, F.concat(rule["server"], F.lit("$1")))).otherwise(t)

    return F.when(c.contains("<tool_name>"), F.aggregate(servers, fixed, step)).otherwise(c)


def _decoded(raw: Column) -> Column:
    """JSON as given, else with Python spelling replaced, else an error record."""

    def decode(r: Column) -> Column:
        swapped = F.replace(r, F.lit("'"), F.lit('"'))
        for word, json in [("None", "null"), ("True", "true"), ("False", "false")]:
            swapped = F.replace(swapped, F.lit(word), F.lit(json))
        failed = F.concat(F.lit('{"error": "Failed to parse arguments", "raw": '), json_text(r), F.lit("}"))
        return F.when(is_json(r), r).otherwise(let(swapped, lambda s: F.when(is_json(s), s).otherwise(failed)))

    return let(raw, decode)


def server_calls(c: Column) -> Column:
    """All server-tagged calls: ``array<struct<server, tool, args_json, args>>``.

    Null arguments are dropped; arguments that are no JSON object stay in
    ``args_json`` and leave ``args`` empty.
    """

    def calls(t: Column) -> Column:
        def call(g: Column) -> Column:
            return let(
                _decoded(strip(F.regexp_extract(g, SERVER_CALL, 3))),
                lambda json: F.struct(
                    strip(F.regexp_extract(g, SERVER_CALL, 1)).alias("server"),
                    strip(F.regexp_extract(g, SERVER_CALL, 2)).alias("tool"),
                    json.alias("args_json"),
                    F.filter(F.coalesce(object_args(json), no_args()), lambda e: e.json != "null").alias("args"),
                ),
            )

        return F.transform(F.regexp_extract_all(t, F.lit(SERVER_CALL), 0), call)

    tagged = F.when(c.contains("<use_mcp_tool>"), repaired_server_text(c)).otherwise(F.lit(""))
    return let(tagged, calls)


def text_before_call(c: Column) -> Column:
    return strip(F.substring_index(c, "<use_mcp_tool>", 1))


def repaired_server_args(tool: Column, args: Column) -> Column:
    """Aliases of known arguments under their right names."""
    has = lambda key: F.exists(args, lambda e: e.key == key)
    info = F.when(has("description"), F.lit("description")).when(has("introduction"), F.lit("introduction"))
    scrape = (tool == "scrape_and_extract_info") & ~has("info_to_extract")
    code = tool.isin(*K.WRONG_CODE_TOOL_NAMES, K.CODE_TOOL_NAME) & ~has("code_block")
    rename = lambda e: (
        F.when(scrape & F.coalesce(e.key == info, F.lit(False)), F.lit("info_to_extract"))
        .when(code & (e.key == "code"), F.lit("code_block"))
        .otherwise(e.key)
    )
    named = F.transform(args, lambda e: _pair(rename(e), e.json))
    sandbox = F.when(
        tool.isin(*K.WRONG_CODE_TOOL_NAMES, K.CODE_TOOL_NAME) & ~has("sandbox_id"),
        one_arg("sandbox_id", F.lit('"default"')),
    ).otherwise(no_args())
    return F.concat(named, sandbox)


def server_of(server: Column, tool: Column) -> Column:
    """``struct(server, tool)`` with the code tools under one name."""
    code = tool.isin(*K.WRONG_CODE_TOOL_NAMES, K.CODE_TOOL_NAME)
    return F.struct(
        F.when(code, F.lit(K.CODE_SERVER_NAME)).otherwise(server).alias("server"),
        F.when(code, F.lit(K.CODE_TOOL_NAME)).otherwise(tool).alias("tool"),
    )


def repeat_key(tool: Column, args: Column) -> Column:
    """Key under which a call counts as a repeat; null for tools without one."""
    part = lambda name: strip(F.coalesce(arg_text(args, name), F.lit("")))
    return F.when(tool == "google_search", F.concat(tool, F.lit(":"), part("q"))).when(
        tool == "scrape_and_extract_info",
        F.concat(tool, F.lit(":"), part("url"), F.lit(":"), part("info_to_extract")),
    )

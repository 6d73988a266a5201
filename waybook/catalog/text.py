"""Parsers (I1-I35): table text is wrapped in the wire format and read back.

The SQL never parses anything: it returns the text that was wrapped.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from waybook import constants as K
from waybook.catalog.registry import query
from waybook.catalog.tables import calls, table, texts, turns
from waybook.functions import answers, formats, pages, payloads, strings, verdicts
from waybook.functions import calls as wire

_T = "trim(text, E' \\n\\t')"
_NL = "chr(10)"


def _docs(spark, sf):
    return texts(spark, sf, "documents")


def _assistant(spark, sf):
    return turns(spark, sf).where("role = 'assistant'")


def _pick(by, *branches):
    """One of several columns by row."""
    out = F.when(by % len(branches) == 0, branches[0])
    for i, b in enumerate(branches[1:], 1):
        out = out.when(by % len(branches) == i, b)
    return out


def _words():
    """The letters of the whole text, words one blank apart."""
    return F.trim(F.regexp_replace("text", r"[^A-Za-z]+", " "))


def _lit(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


@query(
    "i1_boxed_first",
    r"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN w WHEN 2 THEN 'x' || w || ' y' WHEN 3 THEN '1,000 ' || w WHEN 4 THEN w || ' z' ELSE w END AS boxed
    FROM (SELECT doc_id, trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) AS w FROM documents)""",
)
def i1_boxed_first(spark, sf):
    w = _words()
    text = _pick(
        F.col("doc_id"), F.col("text"), _lit("so \\boxed{", w, "} and \\boxed{no}"), _lit("\\boxed{x\\text{", w, "}\\,y}"),
        _lit("\\boxed{1{,}000\\;", w, "}"), _lit("\\boxed{ \\textrm{", w, "}  z }"), _lit("a \\boxed{{", w, "}} b"),
    )
    return _docs(spark, sf).select("doc_id", answers.boxed_first(text).alias("boxed"))


@query(
    "i2_boxed_last",
    r"""SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN w WHEN 2 THEN '{a{' || w || '}}' WHEN 3 THEN w || ' \} open' WHEN 4 THEN '' WHEN 5 THEN w ELSE '{' || w || '} rest {' END AS boxed
    FROM (SELECT doc_id, trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) AS w FROM documents)""",
)
def i2_boxed_last(spark, sf):
    w = _words()
    text = _pick(
        F.col("doc_id"), F.col("text"), _lit("\\boxed{no} then \\boxed {", w, "}."), _lit("\\boxed{{a{", w, "}}}"),
        _lit("\\boxed{", w, " \\} open"), _lit("\\boxed{", w, "} \\boxed{unknown}"), _lit("\\boxedx{no} \\boxed{", w, "} \\boxed no"),
        _lit("\\boxed{ok} \\boxed{{", w, "} rest {"),
    )
    return _docs(spark, sf).select("doc_id", answers.boxed_last(text).alias("boxed"))


@query(
    "i3_split_think",
    f"""SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN {_T} ELSE '' END AS reasoning,
      CASE WHEN doc_id % 3 < 2 THEN lang || '</think>' || source ELSE text END AS answer FROM documents""",
)
def i3_split_think(spark, sf):
    tail = _lit("</think>\n\n ", F.col("lang"), "</think>", F.col("source"), " ")
    text = _pick(F.col("doc_id"), _lit("<think>\n", F.col("text"), tail), _lit(F.col("text"), tail), F.col("text"))
    return _docs(spark, sf).select("doc_id", answers.split_think(text).alias("s")).select("doc_id", "s.*")


_FINALS = f"""CASE doc_id % 4 WHEN 0 THEN {_T} WHEN 1 THEN {_T} WHEN 2 THEN {_T} ELSE 'plain ' || lang END"""


@query(
    "i4_split_channels",
    f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || ' why' WHEN 1 THEN source || ' thus' ELSE '' END AS reasoning, {_FINALS} AS answer FROM documents""",
)
def i4_split_channels(spark, sf):
    src, text = F.col("source"), F.col("text")
    raw = _pick(
        F.col("doc_id"),
        _lit("<|channel|>analysis<|message|> ", src, " why <|end|><|start|>assistant<|channel|>final<|message|>", text, "<|return|>"),
        _lit("analysis ", src, " thus assistant final ", text),
        _lit("analysis", text),
        _lit("plain <|x|>", F.col("lang")),
    )
    safe = F.regexp_replace(raw, "finale", "fnale")
    return _docs(spark, sf).select("doc_id", answers.split_channels(safe).alias("s")).select("doc_id", "s.*")


@query(
    "i5_channel_replies",
    f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '<think>' || {_NL} || {_T} || {_NL} || '</think>' || {_NL} || {_NL} || source
      WHEN 1 THEN '<think>' || {_NL} || {_T} || {_NL} || '</think>' || {_NL} || {_NL} || lang
      ELSE '<think>' || {_NL} || source || {_NL} || '</think>' || {_NL} || {_NL} || source END AS value FROM documents""",
)
def i5_channel_replies(spark, sf):
    thought = _lit("<|channel|>analysis<|message|>", F.col("text"), "<|end|>")
    raw = _pick(
        F.col("doc_id"), _lit(thought, "<|channel|>final<|message|> ", F.col("source"), "<|return|>"), thought,
        _lit("<|start|>assistant ", F.col("source"), "<|end|>"),
    )
    given = F.when(F.col("doc_id") % 3 == 1, F.col("lang"))
    return _docs(spark, sf).select("doc_id", answers.channel_reply(raw, given).alias("value"))


@query("i6_closed_book", f"SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'the analysis ' || {_T} ELSE {_T} END AS answer FROM documents")
def i6_closed_book(spark, sf):
    raw = _pick(
        F.col("doc_id"), _lit("<|start|>assistant<|channel|>analysis<|message|> ", F.col("text")),
        _lit("assistant analysis commentary\nanalysis ", F.col("text"), "<|end|>"), _lit("the analysis ", F.col("text")),
    )
    return _docs(spark, sf).select("doc_id", answers.closed_book(raw).alias("answer"))


@query(
    "i7_repairs",
    f"""SELECT conv_id AS traj, turn AS pos, {_T} AS cut, 'so ' || text || '.' AS unwrapped,
      CASE WHEN turn % 2 = 0 THEN '<think>' || {_NL} || text || '</think>a' ELSE '<think>' || text || '</think>a' END AS opened, {_T} AS thinking
    FROM conversations""",
)
def i7_repairs(spark, sf):
    c = F.col("content")
    opened = F.when(F.col("pos") % 2 == 0, _lit(c, "</think>a")).otherwise(_lit("<think>", c, "</think>a"))
    return turns(spark, sf).select(
        "traj", "pos",
        answers.cut_at_end_mark(_lit(c, "<|im_end|>\n<|im_start|>user\nmore")).alias("cut"),
        answers.unwrap_answer(_lit("so <answer>", c, "</answer>.")).alias("unwrapped"),
        answers.with_opening_think(opened).alias("opened"),
        answers.thinking(opened, missing_open=True).alias("thinking"),
    )


def _tagged(c, tool):
    return _lit(
        "<think>\n", c, "\n</think>\n\n<tool_call>\n<function=", tool, ">\n<parameter=query>\n", c,
        "\n</parameter>\n<parameter=topn>", F.col("pos").cast("string"), "</parameter>\n</function>\n</tool_call>",
    )


@query(
    "i8_tagged_calls",
    f"""SELECT conv_id AS traj, turn AS pos, CASE WHEN turn % 5 <> 3 THEN {_T} END AS think, CASE WHEN turn % 5 <> 3 THEN 'web_search' END AS name,
      CASE WHEN turn % 5 <> 3 THEN {_T} END AS query, CASE WHEN turn % 5 <> 3 THEN turn::VARCHAR END AS topn,
      CASE WHEN turn % 5 <> 3 THEN '{{"query": ' || to_json({_T})::VARCHAR || ', "topn": ' || turn || '}}' END AS args
    FROM conversations WHERE role = 'assistant'""",
)
def i8_tagged_calls(spark, sf):
    text = F.when(F.col("pos") % 5 != 3, _tagged(F.col("content"), F.lit("web_search"))).otherwise(F.col("content"))
    rows = _assistant(spark, sf).select("traj", "pos", text.alias("raw")).select("traj", "pos", wire.tagged_call(F.col("raw")).alias("call"))
    return rows.select(
        "traj", "pos", "call.think", "call.name", wire.arg_text(F.col("call.args"), "query").alias("query"),
        wire.arg_json(F.col("call.args"), "topn").alias("topn"), F.when(F.col("call").isNotNull(), wire.args_json(F.col("call.args"))).alias("args"),
    )


@query(
    "i8_tagged_or_json_calls",
    f"""SELECT conv_id AS traj, turn AS pos, CASE turn % 3 WHEN 2 THEN NULL ELSE 'browser' END AS namespace, CASE turn % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'search' END AS tool,
      CASE turn % 3 WHEN 2 THEN NULL ELSE {_T} END AS query FROM conversations""",
)
def i8_tagged_or_json_calls(spark, sf):
    c = F.col("content")
    body = F.to_json(F.struct(F.lit("web_search").alias("name"), F.struct(strings.strip(c).alias("query")).alias("arguments")))
    text = _pick(F.col("pos"), _tagged(c, F.lit("open_url")), _lit("x <tool_call>\n", body, "\n</tool_call>"), _lit("<tool_call> ", c))
    rows = turns(spark, sf).select("traj", "pos", wire.tagged_or_json_call(text).alias("call"))
    return rows.select("traj", "pos", "call.namespace", "call.tool", wire.arg_text(F.col("call.args"), "query").alias("query"))


@query(
    "i9_channel_calls",
    f"""SELECT doc_id, CASE WHEN b = 9 THEN NULL WHEN b < 3 THEN 'python' WHEN b = 3 THEN 'functions' ELSE 'browser' END AS namespace,
      CASE WHEN b = 9 THEN NULL WHEN b < 3 THEN 'execute' WHEN b = 3 THEN 'paper_search' WHEN b = 7 THEN 'open' ELSE 'search' END AS tool,
      CASE WHEN b < 3 THEN t END AS code, CASE WHEN b BETWEEN 3 AND 6 THEN t WHEN b = 8 THEN w END AS query, CASE WHEN b = 7 THEN doc_id::VARCHAR END AS id
    FROM (SELECT doc_id, doc_id % 10 AS b, {_T} AS t, trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) AS w FROM documents)""",
)
def i9_channel_calls(spark, sf):
    t = strings.strip(F.col("text"))
    json = F.to_json(F.struct(t.alias("query")))
    quoted = strings.json_text(json)
    text = _pick(
        F.col("doc_id"),
        _lit("to=python<|channel|>commentary<|message|> ", t, "<|call|>"),
        _lit("commentary to=python code\n", t),
        _lit("to=python ", F.lit(" "), F.regexp_replace(t, "code", "kode")),
        _lit("<|message|>x to=functions.paper_search json<|message|>", json, "<|call|>"),
        _lit("commentary to=browser.search code", json),
        _lit("to=browser.search ", json, " so"),
        _lit("to=browser.search<|message|>", quoted, "<|end|>"),
        _lit("to=browser.open<|message|>{\"id\": ", F.col("doc_id").cast("string"), ", broken"),
        _lit("to=browser.search<|message|>{\"query\": \"", _words(), "\", oops}"),
        _lit("to=nowhere ", t),
    )
    rows = _docs(spark, sf).select("doc_id", text.alias("raw")).select("doc_id", wire.channel_call(F.col("raw")).alias("c"))
    got = lambda f: F.get_json_object("c.args_json", f"$.{f}").alias(f)
    return rows.select("doc_id", "c.namespace", "c.tool", got("code"), got("query"), got("id"))


@query(
    "i10_keyword_calls",
    r"""SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN 'search_papers_by_relevance' END AS name,
      CASE doc_id % 4 WHEN 0 THEN '{"query": "' || w || ' b", "limit": ' || doc_id || '}' WHEN 1 THEN '{"query": ' || doc_id || ', "year": null}' WHEN 2 THEN '{"q": "last"}' END AS args
    FROM (SELECT doc_id, trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) AS w FROM documents)""",
)
def i10_keyword_calls(spark, sf):
    w, n = _words(), F.col("doc_id").cast("string")
    text = _pick(
        F.col("doc_id"), _lit(" search_papers_by_relevance(query='", w, " b', limit=", n, ")\n"),
        _lit("search_papers_by_relevance(query=\"", n, "\", year='')"), _lit("search_papers_by_relevance(q='", w, "', q = \"last\")"),
        _lit("search papers ", w),
    )
    rows = _docs(spark, sf).select("doc_id", wire.keyword_call(text).alias("c"))
    return rows.select("doc_id", "c.name", F.when(F.col("c").isNotNull(), wire.args_json(F.col("c.args"))).alias("args"))


@query(
    "i11_foreign_args",
    r"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'web_search' WHEN 1 THEN 'open_url' WHEN 2 THEN 'paper_search' ELSE 'other_tool' END AS tool,
      CASE doc_id % 4 WHEN 0 THEN '{"query": "' || w || '", "topn": 7}' WHEN 1 THEN '{"id": "' || w || '"}'
        WHEN 2 THEN '{"query": "' || w || '", "limit": 3, "year": "2020-", "fields_of_study": "Biology"}' ELSE '{"query": "' || w || '", "num_results": 7}' END AS args
    FROM (SELECT doc_id, trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) AS w FROM documents)""",
)
def i11_foreign_args(spark, sf):
    w = _words()
    text = _pick(
        F.col("doc_id"), _lit("serper_google_webpage_search(query='", w, "', num_results=7)"), _lit("serper_fetch_webpage_content(query='", w, "')"),
        _lit("search_papers_by_relevance(query='", w, "', limit=3, year='2020-', fieldsOfStudy='Biology')"), _lit("other_tool(query='", w, "', num_results=7)"),
    )
    rows = _docs(spark, sf).select("doc_id", wire.keyword_call(text).alias("c"))
    tool = wire.renamed(F.col("c.name"), K.FOREIGN_TOOL_NAMES)
    return rows.select("doc_id", tool.alias("tool"), wire.args_json(wire.foreign_args(tool, F.col("c.args"))).alias("args"))


@query(
    "i12_cleaned_args",
    r"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{"query": "' || w || '"}' WHEN 1 THEN '{"id": "' || w || '", "loc": 5}' WHEN 2 THEN '{"query": "' || w || '", "topn": 3}' ELSE '{"any": "' || w || '", "x": 10}' END AS args
    FROM (SELECT doc_id, trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) AS w FROM documents)""",
)
def i12_cleaned_args(spark, sf):
    w = _words()
    by = F.col("doc_id")
    tool = _pick(by, F.lit("web_search"), F.lit("open_url"), F.lit("web_search"), F.lit("custom"))
    json = _pick(
        by, _lit('{"query": "', w, '", "top_n": 10, "source": "web"}'), _lit('{"id": "view-source:', w, '", "cursor": "  ", "loc": 5}'),
        _lit('{"query": "', w, '", "topn": 5, "num_results": 3}'), _lit('{"any": "', w, '", "x": 10, "blank": ""}'),
    )
    rows = _docs(spark, sf).select("doc_id", tool.alias("tool"), wire.object_args(json).alias("a"))
    return rows.select("doc_id", wire.args_json(wire.cleaned_args(F.col("tool"), F.col("a"))).alias("args"))


@query(
    "i13_server_calls",
    f"""SELECT conv_id AS traj, turn AS pos, c AS call_no, CASE c WHEN 1 THEN 'search_and_scrape_webpage' ELSE 'tool-python' END AS server,
      CASE c WHEN 1 THEN 'google_search' ELSE 'run_python_code' END AS tool, CASE c WHEN 1 THEN {_T} END AS q,
      CASE WHEN c = 2 THEN CASE turn % 2 WHEN 0 THEN '{{"code_block": "x"}}' ELSE '{{"error": "Failed to parse arguments", "raw": "{{broken"}}' END ELSE '{{"q": ' || to_json({_T})::VARCHAR || '}}' END AS args
    FROM conversations, (VALUES (1), (2)) AS cs(c) WHERE turn % 4 <> 3""",
)
def i13_server_calls(spark, sf):
    c = strings.strip(F.col("content"))
    second = F.when(F.col("pos") % 2 == 0, F.lit("{'code_block': 'x', 'sandbox_id': None}")).otherwise("{broken")
    call = lambda server, tool, args: _lit(
        "<use_mcp_tool>\n<server_name>", server, "</server_name>\n<tool_name>", tool, "</tool_name>\n<arguments>\n", args, "\n</arguments>\n</use_mcp_tool>\n"
    )
    json = F.to_json(F.struct(c.alias("q")))
    full = _lit("I look. ", call("wrong", "google_search", json), call("tool-python", "python", second))
    text = F.when(F.col("pos") % 4 != 3, full).otherwise(c)
    raw = turns(spark, sf).select("traj", "pos", text.alias("raw"))
    rows = raw.select("traj", "pos", F.posexplode_outer(wire.server_calls(F.col("raw"))).alias("n", "call")).where("n IS NOT NULL")
    return rows.select(
        "traj", "pos", (F.col("n") + 1).alias("call_no"), "call.server", "call.tool", wire.arg_text(F.col("call.args"), "q").alias("q"),
        wire.args_json(F.col("call.args")).alias("args"),
    )


@query(
    "i14_environment_text",
    f"""SELECT conv_id AS traj, turn AS pos, CASE turn % 5 WHEN 0 THEN '(no output)' WHEN 4 THEN '{{"other": 1}}' ELSE {_T} END AS env FROM conversations""",
)
def i14_environment_text(spark, sf):
    t = strings.strip(F.col("content"))
    literal = F.replace(t, F.lit("\n"), F.lit("\\n"))
    raw = _pick(
        F.col("pos"), F.lit(" \n "), _lit("{'type': 'text', 'text': \"", literal, "\"}"),
        F.to_json(F.struct(F.lit(None).cast("boolean").alias("flag"), F.lit(True).alias("ok"), t.alias("text"))), _lit(t, "\n"), F.lit('{"other": 1}'),
    )
    return turns(spark, sf).select("traj", "pos", payloads.environment_text(raw).alias("env"))


_SHOWN = f"""'Searched for "' || source || '"' || {_NL} || {_NL} || '[1] t ' || lang || {_NL} || '    URL: http://a/' || doc_id || {_NL} || '    Snippet [S_' || doc_id || ']: ' || text || {_NL}
  || {_NL} || '[2] second' || {_NL} || '    URL: ' || {_NL} || '    Snippet: plain' || {_NL}"""


def _search_payload():
    hit = lambda title, link, snippet, sid: F.struct(title.alias("title"), link.alias("link"), snippet.alias("snippet"), sid.alias("snippet_id"))
    none = F.lit(None).cast("string")
    first = hit(_lit("t ", F.col("lang")), _lit("http://a/", F.col("doc_id").cast("string")), F.col("text"), _lit("S_", F.col("doc_id").cast("string")))
    second = hit(F.lit("second"), none, F.lit("plain"), none)
    return F.to_json(F.struct(F.struct(F.col("source").alias("q")).alias("searchParameters"), F.array(first, second).alias("organic")))


@query(
    "i15_tool_responses",
    f"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN {_SHOWN}
      WHEN 1 THEN 'Page: http://p/' || source || {_NL} || '[S1]' || {_NL} || text
      WHEN 2 THEN 'Paper search results:' || {_NL} || {_NL} || '[1] P ' || lang || {_NL} || '    ID: s9' || {_NL} || '    Snippet: ' || left(text, 800) || CASE WHEN length(text) > 800 THEN '...' ELSE '' END || {_NL}
      WHEN 3 THEN 'Search Failure: ' || text ELSE text END AS shown FROM documents""",
)
def i15_tool_responses(spark, sf):
    by, text = F.col("doc_id"), F.col("text")
    page = F.to_json(F.struct(text.alias("text"), F.lit("S1").alias("snippet_id"), F.create_map(F.lit("og:url"), _lit("http://p/", F.col("source"))).alias("metadata")))
    paper = F.to_json(
        F.struct(F.array(F.struct(F.lit("s9").alias("snippet_id"), F.struct(_lit("P ", F.col("lang")).alias("title")).alias("paper"), F.struct(text.alias("text")).alias("snippet"))).alias("data"))
    )
    raw = _pick(by, _search_payload(), page, paper, _lit("Search Failure: ", text), text)
    tool = _pick(by, F.lit("web_search"), F.lit("open_url"), F.lit("paper_search"), F.lit("web_search"), F.lit("web_search"))
    return _docs(spark, sf).select("doc_id", payloads.response_text(tool, raw).alias("shown"))


@query(
    "i16_html_text",
    r"""SELECT page_id, text, CAST(ceil(length(text) / 200.0) AS BIGINT) AS lines FROM (
      SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(left(html, 409600), '(?is)<script.*?>.*?</script>', '', 'g'), '(?is)<style.*?>.*?</style>', '', 'g'),
        '(?is)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages)""",
)
def i16_html_text(spark, sf):
    rows = texts(spark, sf, "pages").select("page_id", pages.html_text(F.col("html")).alias("text"))
    return rows.withColumn("lines", pages.wrapped_lines(F.col("text")))


@query(
    "i17_page_views",
    """WITH l AS (SELECT doc_id, string_split(text, E'\\n') AS a, 1 + doc_id % 4 AS s, 2 + doc_id % 3 AS n FROM documents),
    v AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i, s, n FROM l)
    SELECT doc_id, coalesce(string_agg('L' || i || ': ' || line, E'\\n' ORDER BY i) FILTER (i >= s AND i < s + n), '') AS shown FROM v GROUP BY 1""",
)
def i17_page_views(spark, sf):
    shown = pages.view_text(F.col("text"), 1 + F.col("doc_id") % 4, 2 + F.col("doc_id") % 3)
    return _docs(spark, sf).select("doc_id", shown.alias("shown"))


@query(
    "i17_opened_pages",
    """WITH l AS (SELECT doc_id, source, string_split(left(text, 30000), E'\\n') AS a FROM documents),
    v AS (SELECT doc_id, source, a[CASE WHEN doc_id % 3 = 0 THEN 1 ELSE doc_id % 3 END : CASE WHEN doc_id % 2 = 0 THEN len(a) ELSE CASE WHEN doc_id % 3 = 0 THEN 1 ELSE doc_id % 3 END + 1 END] AS v,
      CASE WHEN doc_id % 3 = 0 THEN 1 ELSE doc_id % 3 END AS s FROM l)
    SELECT doc_id, 'Page: ' || source || E'\\n' || array_to_string(v, E'\\n') AS plain,
      '[' || (doc_id % 9) || ']' || E'\\n' || coalesce((SELECT string_agg('L' || (s + i - 1) || ': ' || x, E'\\n' ORDER BY i) FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i)), '') AS numbered FROM v""",
)
def i17_opened_pages(spark, sf):
    loc, n = F.col("doc_id") % 3, F.when(F.col("doc_id") % 2 == 0, 0).otherwise(2)
    plain = pages.opened_text(F.col("source"), F.col("text"), loc, n)
    numbered = pages.opened_text(F.col("source"), F.col("text"), loc, n, F.col("doc_id") % 9)
    return _docs(spark, sf).select("doc_id", plain.alias("plain"), numbered.alias("numbered"))


@query(
    "i18_found_text",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, E'\\n')) AS line, generate_subscripts(string_split(text, E'\\n'), 1) AS i FROM documents),
    m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM l WHERE contains(lower(line), 'on')),
    s AS (SELECT doc_id, any_value(n) AS n, string_agg('L' || i || ': ' || line, E'\\n' ORDER BY i) FILTER (r <= 3) AS shown FROM m GROUP BY 1)
    SELECT doc_id, CASE WHEN n IS NULL THEN 'No matches for "ON" in [4].' ELSE 'Found ' || n || ' match(es) for "ON" in [4]:' || E'\\n' || shown
      || CASE WHEN n > 3 THEN E'\\n... and ' || (n - 3) || ' more matches' ELSE '' END END AS shown FROM documents LEFT JOIN s USING (doc_id)""",
)
def i18_found_text(spark, sf):
    found = _docs(spark, sf).select("doc_id", pages.find(F.col("text"), F.lit("ON"), 3).alias("f"))
    return found.select("doc_id", pages.found_text(F.lit("ON"), F.col("f"), F.lit(4)).alias("shown"))


@query(
    "i18_find_in_page",
    """SELECT doc_id, i::INT AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, E'\\n')) AS line, generate_subscripts(string_split(text, E'\\n'), 1) AS i FROM documents)
    WHERE contains(lower(line), 'the')""",
)
def i18_find_in_page(spark, sf):
    lines = pages.numbered(_docs(spark, sf).select("doc_id", "text"), "text")
    return lines.where(F.lower("line").contains("the"))


@query(
    "i19_search_display",
    f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Searched for "' || source || '"' || {_NL} || {_NL} || '[1] t ' || lang || {_NL} || '    URL: http://a/' || doc_id || {_NL} || '    Snippet: ' || text || {_NL}
        || {_NL} || '[2] second' || {_NL} || '    URL: ' || {_NL} || '    Snippet: plain' || {_NL}
      ELSE '[7]' || {_NL} || 'L1: Searched for "' || source || '"' || {_NL} || 'L2: ' || {_NL} || 'L3: 【1†t ' || lang || '】' || {_NL} || 'L4: URL: http://a/' || doc_id || {_NL} || 'L5: ' || text || {_NL} || 'L6: '
        || {_NL} || 'L7: 【2†second】' || {_NL} || 'L8: URL: ' || {_NL} || 'L9: plain' || {_NL} || 'L10: ' END AS shown FROM documents""",
)
def i19_search_display(spark, sf):
    rows = _docs(spark, sf).select("doc_id", "source", payloads.search_hits(_search_payload()).alias("h"))
    plain = payloads.page_view(payloads.search_lines(F.col("source"), F.col("h")), F.lit(7))
    marked = payloads.page_view(payloads.search_lines(F.col("source"), F.col("h"), plain=False), F.lit(7), plain=False)
    return rows.select("doc_id", F.when(F.col("doc_id") % 2 == 0, plain).otherwise(marked).alias("shown"))


@query(
    "i20_papers",
    """SELECT doc_id, 1 AS rank, 'P ' || lang AS title, 'a, b, c, d et al.' AS authors, '2020' AS year, source AS venue, doc_id::VARCHAR AS citations,
      CASE doc_id % 4 WHEN 0 THEN 'http://oa/' || doc_id WHEN 1 THEN 'https://arxiv.org/pdf/' || doc_id WHEN 2 THEN 'https://www.aclweb.org/anthology/' || doc_id || '.pdf' ELSE '' END AS pdf,
      CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS abstract FROM documents""",
)
def i20_papers(spark, sf):
    rows = _docs(spark, sf).select("doc_id", payloads.papers(_paper_payload()).alias("p"))
    return rows.select("doc_id", F.inline("p")).drop("doi", "url")


def _paper_payload():
    n = F.col("doc_id").cast("string")
    ids = _pick(
        F.col("doc_id"), F.create_map(F.lit("ArXiv"), F.lit("no")), F.create_map(F.lit("ArXiv"), n, F.lit("ACL"), n),
        F.create_map(F.lit("ACL"), n), F.lit(None).cast("map<string,string>"),
    )
    paper = F.struct(
        _lit("P ", F.col("lang")).alias("title"), F.lit(2020).alias("year"), F.col("source").alias("venue"), F.col("doc_id").alias("citationCount"),
        F.array(*[F.struct(F.lit(a).alias("name")) for a in "abcde"]).alias("authors"), F.col("text").alias("abstract"), ids.alias("externalIds"),
        F.when(F.col("doc_id") % 4 == 0, F.struct(_lit("http://oa/", n).alias("url"))).alias("openAccessPdf"),
    )
    return F.to_json(F.struct(F.array(paper).alias("data")))


@query(
    "i20_snippets",
    """SELECT doc_id, 1 AS rank, 'P ' || lang AS title, 'a, b, c et al.' AS authors, source AS venue, CASE WHEN doc_id % 2 = 0 THEN 'Intro' ELSE 'Top' END AS section,
      CASE WHEN length(text) > 800 THEN left(text, 800) || '...' ELSE text END AS snippet FROM documents""",
)
def i20_snippets(spark, sf):
    names = F.array(*[F.struct(F.lit(a).alias("name")) for a in "abcd"])
    paper = F.struct(_lit("P ", F.col("lang")).alias("title"), F.col("source").alias("venue"), names.alias("authors"))
    boxed = F.to_json(F.struct(F.array(F.struct(paper.alias("paper"), F.struct(F.col("text").alias("text"), F.lit("Intro").alias("section")).alias("snippet"))).alias("data")))
    plain = F.to_json(F.struct(F.array(F.struct(paper.alias("paper"), F.col("text").alias("snippet"), F.lit("Top").alias("section"))).alias("data")))
    rows = _docs(spark, sf).select("doc_id", F.when(F.col("doc_id") % 2 == 0, boxed).otherwise(plain).alias("j"))
    return rows.select("doc_id", F.inline(payloads.snippets(F.col("j")))).drop("year", "paper_id")


@query(
    "i20_papers_text",
    f"""SELECT doc_id, 'Paper search: "' || source || '"' || {_NL} || {_NL} || '[1] P ' || lang || {_NL} || '    Authors: a, b, c, d et al.' || {_NL} || '    Year: 2020 | Venue: ' || source || ' | Citations: ' || doc_id || {_NL}
      || CASE doc_id % 4 WHEN 0 THEN '    PDF: http://oa/' || doc_id || {_NL} WHEN 1 THEN '    PDF: https://arxiv.org/pdf/' || doc_id || {_NL} WHEN 2 THEN '    PDF: https://www.aclweb.org/anthology/' || doc_id || '.pdf' || {_NL} ELSE '' END
      || '    Abstract: ' || CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END || {_NL} AS shown FROM documents""",
)
def i20_papers_text(spark, sf):
    rows = _docs(spark, sf).select("doc_id", "source", payloads.papers(_paper_payload()).alias("p"))
    return rows.select("doc_id", payloads.papers_text(F.col("source"), F.col("p")).alias("shown"))


@query(
    "i20_snippets_text",
    f"""SELECT doc_id, 'Paper snippet search: "' || source || '"' || {_NL} || {_NL} || '[1] P ' || lang || {_NL} || '    a, b, c et al. | ' || source || {_NL}
      || '    Section: Intro' || {_NL} || '    Snippet: ' || CASE WHEN length(text) > 800 THEN left(text, 800) || '...' ELSE text END || {_NL} AS shown FROM documents""",
)
def i20_snippets_text(spark, sf):
    names = F.array(*[F.struct(F.lit(a).alias("name")) for a in "abcd"])
    paper = F.struct(_lit("P ", F.col("lang")).alias("title"), F.col("source").alias("venue"), names.alias("authors"))
    payload = F.to_json(F.struct(F.array(F.struct(paper.alias("paper"), F.struct(F.col("text").alias("text"), F.lit("Intro").alias("section")).alias("snippet"))).alias("data")))
    rows = _docs(spark, sf).select("doc_id", "source", payloads.snippets(payload).alias("s"))
    return rows.select("doc_id", payloads.snippets_text(F.col("source"), F.col("s")).alias("shown"))


@query(
    "i21_articles_text",
    f"""SELECT doc_id, 'PubMed search: "' || source || '"' || {_NL} || {_NL} || '[1] On ' || lang || {_NL} || '    URL: https://pubmed.ncbi.nlm.nih.gov/' || doc_id || '/' || {_NL}
      || '    Abstract: ' || left(t, 600) || CASE WHEN length(t) > 600 THEN '...' ELSE '' END || {_NL} AS shown
    FROM (SELECT *, 'On ' || trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) AS t FROM documents)""",
)
def i21_articles_text(spark, sf):
    xml = _lit(
        "<PubmedArticle><PMID>", F.col("doc_id").cast("string"), "</PMID><Article><ArticleTitle>On ", F.col("lang"), "</ArticleTitle><Abstract><AbstractText>On ", _words(),
        "</AbstractText></Abstract></Article></PubmedArticle>",
    )
    rows = _docs(spark, sf).select("doc_id", "source", payloads.articles(xml).alias("x"))
    return rows.select("doc_id", payloads.articles_text(F.col("source"), F.transform("x", payloads.article)).alias("shown"))


@query(
    "i21_articles",
    """SELECT doc_id, doc_id::VARCHAR AS pmid, 'On ' || lang || ' words' AS title, left('AIM: ' || t || ' ' || t, 600) || CASE WHEN length('AIM: ' || t || ' ' || t) > 600 THEN '...' ELSE '' END AS abstract,
      'A One, B Two' AS authors, 'J ' || source AS journal, '1999' AS year
    FROM (SELECT *, trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) AS t FROM documents)""",
)
def i21_articles(spark, sf):
    t = _words()
    author = lambda last, fore: f"<Author><LastName>{last}</LastName><ForeName>{fore}</ForeName></Author>"
    xml = _lit(
        "<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>", F.col("doc_id").cast("string"), "</PMID><Article><Journal><JournalIssue><PubDate><Year>1999</Year></PubDate></JournalIssue><Title>J ",
        F.col("source"), "</Title></Journal><ArticleTitle>On <i>", F.col("lang"), "</i> words</ArticleTitle><Abstract><AbstractText Label=\"AIM\"> ", t,
        " </AbstractText><AbstractText>", t, "</AbstractText></Abstract><AuthorList>", author("One", "A"), "<Author><LastName>Solo</LastName></Author>", author("Two", "B"),
        "</AuthorList></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>",
    )
    rows = _docs(spark, sf).select("doc_id", F.explode(payloads.articles(xml)).alias("x"))
    return rows.select("doc_id", payloads.article(F.col("x")).alias("a")).select("doc_id", "a.*")


@query(
    "i22_token_estimates",
    "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE greatest(1, length(text) // 4) END::INT AS padded, (length(text) // 4)::INT AS plain FROM documents",
)
def i22_token_estimates(spark, sf):
    short = F.when(F.col("doc_id") % 10 != 0, F.col("text"))
    return _docs(spark, sf).select("doc_id", strings.tokens_at_least_one(short).alias("padded"), strings.quarter(F.col("text")).alias("plain"))


@query(
    "i23_judge_replies",
    f"""SELECT doc_id, doc_id % 6 IN (0, 1, 4) AS correct, CASE doc_id % 6 WHEN 4 THEN left('{{"correct": TRUE, ' || {_T}, 200) WHEN 5 THEN left({_T}, 200) ELSE text END AS explanation FROM documents""",
)
def i23_judge_replies(spark, sf):
    reply = lambda c: F.to_json(F.struct(c.alias("correct"), F.col("text").alias("explanation")))
    raw = _pick(
        F.col("doc_id"), reply(F.lit(True)), _lit("Sure:\n```json\n", reply(F.lit("yes")), "\n```\nbye"), _lit("```\n", reply(F.lit(0)), "```"),
        reply(F.lit(False)), _lit('{"correct": TRUE, ', F.col("text")), F.col("text"),
    )
    return _docs(spark, sf).select("doc_id", raw.alias("raw")).select("doc_id", verdicts.judge_reply(F.col("raw")).alias("v")).select("doc_id", "v.*")


@query(
    "i24_grader_replies",
    f"""SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN source END AS extracted_final_answer, CASE WHEN doc_id % 4 < 3 THEN {_T} END AS reasoning,
      CASE WHEN doc_id % 4 < 3 THEN doc_id % 8 < 4 END AS correct, doc_id % 4 = 3 AS parse_error FROM documents""",
)
def i24_grader_replies(spark, sf):
    verdict = F.when(F.col("doc_id") % 8 < 4, "Yes").otherwise("no")
    form = lambda a, r, c: _lit(a, " ", F.col("source"), "\n\n", r, " ", F.col("text"), "\n", c, " ", verdict, "\n")
    raw = _pick(
        F.col("doc_id"), form("**extracted_final_answer:**", "**reasoning:**", "**correct:**"), form("**Extracted_final_answer**:", "**reasoning**:", "**correct**:"),
        form("extracted_final_answer:", "reasoning:", "correct:"), F.col("text"),
    )
    return _docs(spark, sf).select("doc_id", raw.alias("raw")).select("doc_id", verdicts.grader_reply(F.col("raw")).alias("v")).select("doc_id", "v.*")


@query(
    "i25_offline_verdicts",
    """WITH a AS (SELECT d.doc_id, d.text, CASE WHEN d.doc_id % 11 = 0 THEN '  ' ELSE b.text END AS ref FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
    n AS (SELECT doc_id, lower(trim(ref, E' \\n')) AS r, lower(trim(CASE WHEN doc_id % 3 = 0 THEN left(ref, 20) ELSE text END, E' \\n')) AS p FROM a)
    SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR p = '' THEN false ELSE contains(p, r) OR contains(r, p) END AS correct,
      CASE WHEN doc_id % 7 = 0 THEN 'no answer' WHEN p = '' THEN 'Empty answer' ELSE 'fallback exact match' END AS explanation FROM n""",
)
def i25_offline_verdicts(spark, sf):
    bench = table(spark, sf, "benchmark")
    items = bench.agg(F.count(F.lit(1))).scalar()
    rows = _docs(spark, sf).withColumn("item_id", F.col("doc_id") % items).join(bench.select("item_id", F.col("text").alias("b")), "item_id")
    ref = F.when(F.col("doc_id") % 11 == 0, "  ").otherwise(F.col("b"))
    boxed = F.when(F.col("doc_id") % 3 == 0, F.left(ref, F.lit(20))).otherwise("")
    status = F.when(F.col("doc_id") % 7 == 0, "error").otherwise("success")
    return rows.select("doc_id", verdicts.offline(status, ref, boxed, F.col("text")).alias("v")).select("doc_id", "v.*")


@query(
    "l1_formats",
    f"""SELECT conv_id AS traj, turn AS pos, CASE turn % 3 WHEN 2 THEN NULL ELSE 'browser' END AS namespace, CASE turn % 3 WHEN 2 THEN NULL ELSE 'search' END AS tool,
      CASE turn % 3 WHEN 2 THEN NULL ELSE {_T} END AS query, CASE turn % 3 WHEN 2 THEN {_T} ELSE '' END AS answer FROM conversations""",
)
def l1_formats(spark, sf):
    """Each turn through the format it is written in, picked by name."""
    t = strings.strip(F.col("content"))
    body = F.to_json(F.struct(F.lit("web_search").alias("name"), F.struct(t.alias("query")).alias("arguments")))
    query_json = F.to_json(F.struct(t.alias("query")))
    raw = _pick(
        F.col("pos"), _lit("why</think><tool_call>", body, "</tool_call>"), _lit("to=browser.search<|message|>", query_json, "<|call|>"),
        _lit("why</think>", F.col("content")),
    )
    rows = turns(spark, sf).select("traj", "pos", raw.alias("raw"), F.when(F.col("pos") % 3 == 1, "channel").otherwise("tagged").alias("format"))
    parts = []
    for name in ("tagged", "channel"):
        fmt = formats.get_format(name)
        mine = rows.where(F.col("format") == name)
        parts.append(mine.select("traj", "pos", fmt.parse_call(F.col("raw")).alias("call"), fmt.split(F.col("raw"))["answer"].alias("answer")))
    both = parts[0].unionByName(parts[1])
    plain = F.when(F.col("call").isNull(), F.col("answer")).otherwise("")
    return both.select("traj", "pos", "call.namespace", "call.tool", F.get_json_object("call.args_json", "$.query").alias("query"), plain.alias("answer"))


@query("i26_judge_prompts", f"SELECT doc_id, 'Q: ' || source || {_NL} || 'R: {{answer}}' || {_NL} || 'A: ' || text || '!' AS prompt FROM documents")
def i26_judge_prompts(spark, sf):
    prompt = strings.fill("Q: {question}\nR: {reference}\nA: {answer}!", question=F.col("source"), reference=F.lit("{answer}"), answer=F.col("text"))
    return _docs(spark, sf).select("doc_id", prompt.alias("prompt"))


@query(
    "i27_content_text",
    f"""SELECT conv_id AS traj, turn AS pos, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN role || {_NL} || text ELSE '' END AS typed,
      CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN role || '  pic ' || text ELSE '' END AS joined FROM conversations""",
)
def i27_content_text(spark, sf):
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    parts = F.array(part("text", F.col("role")), part("text", F.lit("")), part("image", F.lit("pic")), part("text", F.col("content")))
    json = _pick(F.col("pos"), strings.json_text(F.col("content")), F.to_json(parts), F.lit("null"))
    rows = turns(spark, sf).select("traj", "pos", F.try_parse_json(json).alias("v"))
    return rows.select("traj", "pos", payloads.content_text(F.col("v")).alias("typed"), payloads.content_text(F.col("v"), " ", typed=False).alias("joined"))


@query(
    "i29_result_texts",
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Tool call to run on srv failed. Error: ' || lang WHEN 1 THEN 'Tool call to run on srv completed, but produced no specific output or result.'
      ELSE left(repeat(text, 30), 100000) || CASE WHEN length(text) * 30 > 100000 THEN E'\\n... [Result truncated]' ELSE '' END END AS shown FROM documents""",
)
def i29_result_texts(spark, sf):
    error = F.when(F.col("doc_id") % 3 == 0, F.col("lang"))
    result = F.when(F.col("doc_id") % 3 == 2, F.repeat("text", F.lit(30)))
    return _docs(spark, sf).select("doc_id", payloads.result_text(F.lit("srv"), F.lit("run"), error, result).alias("shown"))


@query("i30_without_ansi", "SELECT conv_id AS traj, turn AS pos, text || role AS value FROM conversations")
def i30_without_ansi(spark, sf):
    colored = _lit("\x1b[0;31m", F.col("content"), "\x1b[0m", F.col("role"), "\x1b[m")
    return turns(spark, sf).select("traj", "pos", strings.without_ansi(colored).alias("value"))


@query(
    "i31_escaped_markup",
    """SELECT page_id, replace(replace(replace(replace(replace(u, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM (SELECT page_id, html AS u FROM pages)""",
)
def i31_escaped_markup(spark, sf):
    return texts(spark, sf, "pages").select("page_id", strings.escape_markup(F.col("html")).alias("escaped"))


@query(
    "i32_safe_ints",
    """SELECT event_id AS seq, CASE event_id % 4 WHEN 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) WHEN 1 THEN 10 WHEN 2 THEN -CAST(json_extract_string(props, '$.k') AS BIGINT) ELSE 10 END AS n FROM events""",
)
def i32_safe_ints(spark, sf):
    k = F.col("k").cast("string")
    raw = _pick(F.col("seq"), _lit(" ", k, " "), _lit(k, ".5"), _lit("-", k), F.lit(None).cast("string"))
    return calls(spark, sf).select("seq", strings.safe_int(raw, 10).alias("n"))


@query(
    "i33_repaired_args",
    r"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'tool-python' ELSE 'srv' END AS server, CASE doc_id % 3 WHEN 0 THEN 'run_python_code' WHEN 1 THEN 'scrape_and_extract_info' ELSE 'google_search' END AS tool,
      CASE doc_id % 3 WHEN 0 THEN '{"code_block": "' || w || '", "sandbox_id": "default"}' WHEN 1 THEN '{"url": "u", "info_to_extract": "' || w || '"}' ELSE '{"description": "' || w || '"}' END AS args
    FROM (SELECT doc_id, trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) AS w FROM documents)""",
)
def i33_repaired_args(spark, sf):
    w = _words()
    tool = _pick(F.col("doc_id"), F.lit("python_code"), F.lit("scrape_and_extract_info"), F.lit("google_search"))
    json = _pick(F.col("doc_id"), _lit('{"code": "', w, '"}'), _lit('{"url": "u", "introduction": "', w, '"}'), _lit('{"description": "', w, '"}'))
    rows = _docs(spark, sf).select("doc_id", tool.alias("t"), wire.object_args(json).alias("a"))
    return rows.select(
        "doc_id", wire.server_of(F.lit("srv"), F.col("t")).alias("s"), wire.args_json(wire.repaired_server_args(F.col("t"), F.col("a"))).alias("args")
    ).select("doc_id", "s.server", "s.tool", "args")


@query(
    "i34_flags",
    """SELECT doc_id, doc_id % 3 = 0 AS has_tags, CASE doc_id % 5 WHEN 0 THEN 'time constraint' WHEN 1 THEN 'I''m sorry, I cannot solve' ELSE '' END AS refusals FROM documents""",
)
def i34_flags(spark, sf):
    tag = F.when(F.col("doc_id") % 3 == 0, "<server_name>").otherwise("server_name")
    phrase = F.when(F.col("doc_id") % 5 == 0, "time constraint").when(F.col("doc_id") % 5 == 1, "I'm sorry, I cannot solve").otherwise("sorry")
    text = _lit(F.col("text"), tag, F.col("lang"), phrase)
    return _docs(spark, sf).select(
        "doc_id", strings.contains_any(text, K.PROTOCOL_TAGS).alias("has_tags"), F.array_join(strings.found_in(text, K.REFUSAL_PHRASES), ",").alias("refusals")
    )


@query("i35_text_before_call", f"SELECT conv_id AS traj, turn AS pos, {_T} AS visible FROM conversations")
def i35_text_before_call(spark, sf):
    text = F.when(F.col("pos") % 2 == 0, _lit(F.col("content"), "\n <use_mcp_tool>x <use_mcp_tool>")).otherwise(F.col("content"))
    return turns(spark, sf).select("traj", "pos", wire.text_before_call(text).alias("visible"))

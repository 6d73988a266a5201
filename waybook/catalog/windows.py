"""Ordered operators (F1-F15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from waybook.catalog.registry import query
from waybook.catalog.tables import CALLS_SQL, calls, table, turns
from waybook.functions import calls as wire
from waybook.functions.answers import boxed_last
from waybook.functions.strings import strip
from waybook.operators import context, plan, rollbacks


@query(
    "f1_keep_last",
    """SELECT conv_id AS traj, turn AS pos, role, CASE WHEN role = 'assistant' AND row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) > 2
      THEN 'Tool result is omitted to save tokens.' ELSE text END AS content FROM conversations""",
)
def f1_keep_last(spark, sf):
    return context.keep_last(turns(spark, sf), ["traj"], "pos", F.col("role") == "assistant", 2)


@query(
    "f2_repeated",
    f"""WITH {CALLS_SQL} SELECT traj, seq, tool IN ('click', 'view') AND coalesce(sum((value < 100)::INT) OVER (
      PARTITION BY traj, CASE WHEN tool IN ('click', 'view') THEN tool || ':' || k END ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS repeated FROM calls""",
)
def f2_repeated(spark, sf):
    key = F.when(F.col("tool").isin("click", "view"), F.concat("tool", F.lit(":"), F.col("k").cast("string")))
    return context.repeated(calls(spark, sf), ["traj"], "seq", key, F.col("value") < 100).select("traj", "seq", "repeated")


@query(
    "f3_forward_fill",
    f"""WITH {CALLS_SQL} SELECT traj, seq, last_value(CASE WHEN tool <> 'error' THEN tool END IGNORE NULLS) OVER (
      PARTITION BY traj ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_tool FROM calls""",
)
def f3_forward_fill(spark, sf):
    known = F.when(F.col("tool") != "error", F.col("tool"))
    # Narrow segments, so that the state also crosses segment borders here.
    return context.forward_fill(calls(spark, sf), ["traj"], "seq", known, "last_tool", width=1000).select("traj", "seq", "last_tool")


@query(
    "f4_growth",
    """WITH t AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) // 4 AS tokens FROM conversations)
    SELECT conv_id AS traj, turn AS pos, CAST(tokens AS BIGINT) AS tokens, CAST(tokens - lag(tokens, 1, 0) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS new_tokens FROM t""",
)
def f4_growth(spark, sf):
    sized = context.prompt_sizes(turns(spark, sf), ["traj"], "pos", F.col("content"))
    rounds = sized.withColumn("tokens", F.expr("prompt_chars div 4"))
    return context.growth(rounds, ["traj"], "pos", "tokens").select("traj", "pos", "tokens", "new_tokens")


@query(
    "f5_prompt_sizes",
    """SELECT conv_id AS traj, turn AS pos, CAST(sum(length('out' || '</tool_call><|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || '<tool_response>' || chr(10) || text
        || chr(10) || '</tool_response><|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10))) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS prompt_chars
    FROM conversations""",
)
def f5_prompt_sizes(spark, sf):
    rendered = context.tagged_round(F.lit("out"), F.col("content"))
    return context.prompt_sizes(turns(spark, sf), ["traj"], "pos", rendered).select("traj", "pos", "prompt_chars")


@query(
    "f5_prompt_parts",
    "SELECT conv_id AS traj, string_agg('<' || role || '>' || text, '' ORDER BY turn) AS prompt FROM conversations WHERE turn <= 5 GROUP BY 1",
)
def f5_prompt_parts(spark, sf):
    rendered = F.concat(F.lit("<"), F.col("role"), F.lit(">"), F.col("content"))
    return context.prompts(turns(spark, sf), ["traj"], "pos", rendered, F.lit(5))


@query(
    "f5_channel_rounds",
    r"""SELECT conv_id AS traj, turn AS pos, 'out<|call|><|start|>' || CASE WHEN turn % 2 = 0 THEN 'browser.search' ELSE 'python' END
      || ' to=assistant<|channel|>commentary<|message|>' || CASE WHEN turn % 2 = 0 THEN to_json(t)::VARCHAR ELSE t END || '<|end|><|start|>assistant' AS round_text
    FROM (SELECT conv_id, turn, regexp_replace(text, '[^ -~\n]', '?', 'g') AS t FROM conversations)""",
)
def f5_channel_rounds(spark, sf):
    space = F.when(F.col("pos") % 2 == 0, "browser").otherwise("python")
    plain = F.regexp_replace("content", r"[^ -~\n]", "?")
    return turns(spark, sf).select("traj", "pos", context.channel_round(F.lit("out"), space, F.lit("search"), plain).alias("round_text"))


@query(
    "f6_budget",
    """WITH t AS (SELECT conv_id AS traj, turn AS pos, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS p FROM conversations)
    SELECT traj, pos, CASE WHEN p + 512 <= 2048 THEN 512 WHEN 2048 - p - 256 >= 256 THEN 2048 - p - 256 ELSE least(2048, 2048 - p - 64) END::BIGINT AS tokens,
      p + 512 > 2048 AND 2048 - p - 256 < 256 AS forced, p + 512 > 2048 AND 2048 - p - 256 < 256 AND least(2048, 2048 - p - 64) <= 0 AS overflow FROM t""",
)
def f6_budget(spark, sf):
    sized = context.prompt_sizes(turns(spark, sf), ["traj"], "pos", F.col("content"))
    return sized.select("traj", "pos", context.budget(F.col("prompt_chars"), 512, 2048).alias("b")).select("traj", "pos", "b.*")


@query(
    "f7_summary_fits",
    """WITH t AS (SELECT conv_id AS traj, turn AS pos, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS p, text FROM conversations)
    SELECT traj, pos, p + length(text) // 4 + CAST(floor(greatest(1, length(text) // 4) * 1.5) AS BIGINT) + 30 + 256 + 1000 < 3000 AS fits FROM t""",
)
def f7_summary_fits(spark, sf):
    from waybook.functions.strings import quarter, tokens_at_least_one

    sized = context.prompt_sizes(turns(spark, sf), ["traj"], "pos", F.col("content"))
    fits = context.summary_fits(
        F.col("prompt_chars"), quarter(F.col("content")), tokens_at_least_one(F.col("content")), F.lit(20), 256, 3000
    )
    return sized.select("traj", "pos", fits.alias("fits"))


@query(
    "f8_number_calls",
    f"""WITH {CALLS_SQL} SELECT traj, seq, row_number() OVER (PARTITION BY traj ORDER BY seq) AS round,
      row_number() OVER (PARTITION BY traj ORDER BY seq) >= 50 AS at_limit FROM calls""",
)
def f8_number_calls(spark, sf):
    return context.number_calls(calls(spark, sf), ["traj"], "seq", 50).select("traj", "seq", "round", "at_limit")


@query("f9_shard", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i % 4 = 1")
def f9_shard(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return plan.shard(docs, "doc_id", 1, 4)


@query("f10_head", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def f10_head(spark, sf):
    return plan.head(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 100)


@query(
    "f11_last_per_key",
    f"""WITH {CALLS_SQL} SELECT traj, k, arg_max(tool, seq) AS tool, arg_max(value, seq) AS value, max(seq) AS seq FROM calls GROUP BY traj, k""",
)
def f11_last_per_key(spark, sf):
    return plan.last_per_key(calls(spark, sf), ["traj", "k"], ["seq"])


@query("f12_duplicates", f"WITH {CALLS_SQL} SELECT traj, k, tool, count(*) AS copies FROM calls GROUP BY traj, k, tool HAVING count(*) > 1")
def f12_duplicates(spark, sf):
    return plan.duplicates(calls(spark, sf), ["traj", "k", "tool"])


@query("f12_require_unique", "SELECT doc_id FROM documents")
def f12_require_unique(spark, sf):
    return plan.require_unique(table(spark, sf, "documents").select("doc_id"), ["doc_id"])


@query(
    "f13_fallback_answers",
    """WITH b AS (SELECT conv_id AS traj, turn, turn = max(turn) OVER (PARTITION BY conv_id) AS final,
        CASE WHEN turn % 3 = 1 THEN trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) ELSE '' END AS box FROM conversations)
    SELECT traj, coalesce(max(box) FILTER (final AND trim(box) <> ''), arg_max(trim(box), turn) FILTER (NOT final AND trim(box) <> ''), '') AS boxed_answer
    FROM (SELECT traj, turn, final, trim(box, E' \\n') AS box FROM b) GROUP BY 1""",
)
def f13_fallback_answers(spark, sf):
    boxed = F.when(F.col("pos") % 3 == 1, F.concat(F.lit("so \\boxed{"), F.trim(F.regexp_replace("content", r"[^A-Za-z]+", " ")), F.lit("}"))).otherwise("none")
    last = turns(spark, sf).groupBy("traj").agg(F.max("pos").alias("last"))
    steps = turns(spark, sf).withColumn("boxed", boxed_last(boxed)).join(last, "traj")
    return context.fallback_answers(steps, ["traj"], "pos", "boxed", F.col("pos") == F.col("last"))


@query(
    "f14_bad_steps",
    f"""WITH {CALLS_SQL}, m AS (
      SELECT traj, seq, CASE WHEN k = 9 THEN NULL WHEN tool = 'error' AND k > 7 THEN 'tags' ELSE 'repeat' END AS fault FROM calls),
    i AS (SELECT *, count(*) FILTER (fault IS NULL) OVER (PARTITION BY traj ORDER BY seq) AS isl FROM m),
    s AS (SELECT *, CASE WHEN fault IS NULL THEN 0 ELSE count(*) FILTER (fault IS NOT NULL) OVER (PARTITION BY traj, isl ORDER BY seq) END AS streak FROM i),
    a AS (SELECT *, CASE WHEN fault IS NULL THEN 'kept' WHEN streak % 5 <> 0 THEN 'rolled_back' WHEN fault = 'repeat' THEN 'error_row' ELSE 'end' END AS act FROM s)
    SELECT traj, seq, streak, CASE WHEN coalesce(count(*) FILTER (act = 'end') OVER (PARTITION BY traj ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0
      THEN 'after_end' ELSE act END AS action FROM a""",
)
def f14_bad_steps(spark, sf):
    fault = F.when(F.col("k") == 9, None).when((F.col("tool") == "error") & (F.col("k") > 7), "tags").otherwise("repeat")
    return context.bad_steps(calls(spark, sf), ["traj"], "seq", fault, width=3000).select("traj", "seq", "streak", "action")


@query(
    "f15_final_response",
    """SELECT conv_id AS traj, coalesce(arg_max(text, turn) FILTER (role = 'assistant' AND conv_id % 2 = 0 AND turn < 3),
      arg_max(text, turn) FILTER (role = 'assistant'), '') AS response, bool_or(role = 'assistant' AND conv_id % 2 = 0 AND turn < 3) AS has_final
    FROM conversations GROUP BY 1""",
)
def f15_final_response(spark, sf):
    channel = F.when((F.col("traj") % 2 == 0) & (F.col("pos") < 3), "final")
    return context.final_response(turns(spark, sf).withColumn("channel", channel), ["traj"], "pos")


_RAW_SQL = r"""
  raw AS (SELECT conv_id // 10 AS traj, conv_id * 100 + turn AS seq, conv_id + turn AS m, upper(substr(trim(text, E' \t\n\r\f\x0B'), 1, 1)) AS l FROM conversations),
  ev AS (
    SELECT traj, seq, c, m, l, CASE WHEN m % 11 IN (0, 1) THEN 'tags' WHEN m % 11 = 2 THEN 'refusal' WHEN m % 67 = 66 THEN 'final' END AS fault,
           CASE c WHEN 1 THEN 'google_search:' || l WHEN 2 THEN 'scrape_and_extract_info:' || l || ':' || (m % 3) END AS key, (m + c) % 5 <> 0 AS ok, m % 3 + 1 AS n
    FROM raw, (VALUES (1), (2), (3)) AS cs(c) WHERE c = 1 OR (m % 11 > 2 AND m % 67 <> 66 AND c <= m % 3 + 1)),
  o AS (SELECT *, row_number() OVER (PARTITION BY traj ORDER BY seq, c) AS i FROM ev)"""


@query(
    "f14_bad_steps_raw",
    f"""WITH RECURSIVE {_RAW_SQL},
    run AS (
      SELECT traj, 0::BIGINT AS i, 0::BIGINT AS seq, 0 AS r, false AS ended, NULL::BIGINT AS skip, []::VARCHAR[] AS used, '' AS act FROM (SELECT DISTINCT traj FROM o)
      UNION ALL
      SELECT traj, i, seq,
        CASE WHEN was THEN 5 WHEN act = 'rolled_back' OR act = 'repeat' THEN r + 1 WHEN act IN ('end', 'final') THEN 5 WHEN act = 'error_line' OR (act = 'made' AND c = n) THEN 0 ELSE r END,
        was OR act IN ('end', 'final'), CASE WHEN act = 'repeat' THEN seq ELSE skip END, CASE WHEN act = 'made' AND ok AND key IS NOT NULL THEN list_append(used, key) ELSE used END, act
      FROM (
        SELECT o.*, p.r, p.ended AS was, p.skip, p.used,
          CASE WHEN p.ended THEN 'after_end' WHEN fault = 'final' THEN 'final' WHEN fault IS NOT NULL THEN CASE WHEN p.r < 4 THEN 'rolled_back' ELSE 'end' END
            WHEN p.skip IS NOT DISTINCT FROM o.seq THEN 'not_made' WHEN key IS NOT NULL AND list_contains(p.used, key) THEN CASE WHEN p.r < 4 THEN 'repeat' ELSE 'error_line' END
            ELSE 'made' END AS act
        FROM run p JOIN o ON o.traj = p.traj AND o.i = p.i + 1)),
    steps AS (SELECT run.*, o.c, o.fault FROM run JOIN o USING (traj, i))
    SELECT traj, seq, CASE WHEN bool_or(act = 'repeat') THEN 'rolled_back' WHEN bool_or(act = 'after_end') THEN 'after_end' WHEN max(fault) IS NOT NULL THEN max(act) ELSE 'kept' END AS action,
      CAST(arg_max(r, c) AS INTEGER) AS rollbacks, CASE WHEN max(fault) IS NOT NULL THEN '' ELSE string_agg(CASE act WHEN 'after_end' THEN 'not_made' ELSE act END, ',' ORDER BY c) END AS made
    FROM steps GROUP BY traj, seq""",
)
def f14_bad_steps_raw(spark, sf):
    """Ten conversations are one step log; each turn's whole text stands in a reply with up to three tagged calls, with tags alone, with a refusal, or alone."""
    m, text = F.expr("traj + pos"), F.col("content")
    first = F.upper(F.substring(strip(text), 1, 1))
    call = lambda server, tool, args: F.concat(
        F.lit(f"\n<use_mcp_tool>\n<server_name>{server}</server_name>\n<tool_name>{tool}</tool_name>\n<arguments>\n"), args, F.lit("\n</arguments>\n</use_mcp_tool>")
    )
    search = call("search_and_scrape_webpage", "google_search", F.to_json(F.struct(F.concat(F.lit(" "), first).alias("q"))))
    scrape = call("jina_scrape_llm_summary", "scrape_and_extract_info", F.to_json(F.struct(first.alias("url"), (m % 3).cast("string").alias("info_to_extract"))))
    code = call("tool-python", "run_python_code", F.lit('{"code_block": "1"}'))
    asked = F.concat(search, F.when(m % 3 >= 1, scrape).otherwise(""), F.when(m % 3 == 2, code).otherwise(""))
    reply = (
        F.when((m % 11).isin(0, 1), F.concat(text, F.lit(" <use_mcp_tool> <tool_name>broken")))
        .when(m % 11 == 2, F.concat(text, F.lit(" I'm sorry, I cannot solve it.")))
        .when(m % 67 == 66, text)
        .otherwise(F.concat(text, asked))
    )
    log = turns(spark, sf).select(F.expr("traj div 10").alias("traj"), F.expr("traj * 100 + pos").alias("seq"), m.alias("m"), reply.alias("reply"))
    made = F.transform(
        wire.server_calls(F.col("reply")),
        lambda c, i: F.struct(wire.repeat_key(c.tool, c.args).alias("key"), ((F.col("m") + i + 1) % 5 != 0).alias("ok")),
    )
    steps = log.withColumn("calls", made).withColumn("fault", rollbacks.step_fault(F.col("reply"), F.col("calls"))).select("traj", "seq", "fault", "calls")
    # Narrow ranges, so that the state also crosses their borders here.
    out = rollbacks.replayed(steps, ["traj"], "seq", F.col("fault"), F.col("calls"), width=40)
    return out.select("traj", "seq", "action", "rollbacks", F.array_join("made", ",").alias("made"))

"""Conversation assembly (H1-H6) over the turn table."""

from __future__ import annotations

from pyspark.sql import functions as F

from waybook.catalog.registry import query
from waybook.catalog.tables import table, turns
from waybook.functions import calls
from waybook.operators import conversation, plan
from waybook.operators.select import map_names

ROLES = {"user": "human", "assistant": "gpt", "system": "system"}


def spoken(spark, sf, where="true"):
    """Turn rows with training roles; every third conversation calls a tool on its early replies."""
    role = map_names(F.col("role"), ROLES)
    called = (F.col("role") == "assistant") & (F.col("traj") % 3 == 0) & (F.col("pos") < 3)
    return turns(spark, sf).where(where).select(
        "traj", "pos", F.when(called, "function_call").otherwise(role).alias("from"), F.col("content").alias("value")
    )


_ROLE_SQL = """CASE WHEN role = 'assistant' AND conv_id % 3 = 0 AND turn < 3 THEN 'function_call'
  WHEN role = 'assistant' THEN 'gpt' WHEN role = 'user' THEN 'human' ELSE role END"""


@query(
    "h1_packed",
    f"""SELECT conv_id AS traj, string_agg({_ROLE_SQL} || ':' || length(text), ',' ORDER BY turn) AS turns, count(*)::INT AS n
    FROM conversations GROUP BY 1""",
)
def h1_packed(spark, sf):
    packed = conversation.pack(spoken(spark, sf), ["traj"])
    shown = F.transform("conversations", lambda t: F.concat(t["from"], F.lit(":"), F.length(t["value"]).cast("string")))
    return packed.select("traj", F.array_join(shown, ",").alias("turns"), F.size("conversations").alias("n"))


@query(
    "h1_rebuilt",
    f"""SELECT conv_id AS traj, turn - (SELECT min(turn) FROM conversations c2 WHERE c2.conv_id = c.conv_id) AS pos, {_ROLE_SQL} AS "from", text AS value FROM conversations c""",
)
def h1_rebuilt(spark, sf):
    packed = conversation.pack(spoken(spark, sf), ["traj"]).select("traj", "conversations")
    return conversation.explode_turns(packed, "conversations").withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "h1_heads",
    """SELECT conv_id AS traj, turn AS pos, 'gpt' AS "from", text AS value FROM conversations WHERE role = 'assistant'
    UNION ALL SELECT conv_id, -2, 'system', text FROM conversations WHERE role = 'system'
    UNION ALL SELECT conv_id, -1, 'human', arg_min(text, turn) FROM conversations WHERE role = 'user' GROUP BY conv_id""",
)
def h1_heads(spark, sf):
    rows = turns(spark, sf)
    heads = rows.groupBy("traj").agg(
        F.max(F.when(F.col("role") == "system", F.col("content"))).alias("system"),
        F.min_by("content", F.when(F.col("role") == "user", F.col("pos"))).alias("question"),
    )
    replies = rows.where("role = 'assistant'").select("traj", "pos", F.lit("gpt").alias("from"), F.col("content").alias("value"))
    return conversation.with_heads(replies, heads, ["traj"], F.col("system"), F.col("question"))


_SHAPE_SQL = f"""t AS (SELECT conv_id, turn, {_ROLE_SQL} AS r, text FROM conversations WHERE conv_id % 7 <> 1 OR turn <> 2),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM t WHERE r <> 'system'),
v AS (SELECT conv_id, count(*) AS spoken, arg_max(r, turn) IN ('human', 'observation') AS open_end, max(turn) AS last_pos,
        bool_and(CASE WHEN i % 2 = 0 THEN r IN ('human', 'observation') ELSE r IN ('gpt', 'function_call') END) AS ok FROM s GROUP BY 1)"""


@query(
    "h2_closed",
    f"""WITH {_SHAPE_SQL}
    SELECT conv_id AS traj, turn AS pos, r AS "from", text AS value FROM t WHERE conv_id IN (SELECT conv_id FROM v WHERE ok)
    UNION ALL SELECT conv_id, last_pos + 1, 'gpt', '' FROM v WHERE ok AND open_end""",
)
def h2_closed(spark, sf):
    kept, _ = conversation.assemble(spoken(spark, sf, "traj % 7 <> 1 OR pos <> 2"), ["traj"])
    return kept


@query(
    "h2_closed_records",
    """SELECT conv_id AS traj, count(*)::INT + (arg_max(role, turn) = 'user')::INT AS n, bool_or(role = 'system') AS has_system FROM conversations GROUP BY 1""",
)
def h2_closed_records(spark, sf):
    packed = conversation.pack(spoken(spark, sf), ["traj"]).withColumn("c", conversation.close(F.col("conversations")))
    return packed.select("traj", F.size("c").alias("n"), F.exists("c", lambda t: t["from"] == "system").alias("has_system"))


@query(
    "h3_alternation",
    f"""WITH {_SHAPE_SQL} SELECT conv_id AS traj, spoken, open_end, ok AND spoken >= 2 AS valid FROM v""",
)
def h3_alternation(spark, sf):
    _, shape = conversation.assemble(spoken(spark, sf, "traj % 7 <> 1 OR pos <> 2"), ["traj"], min_turns=2)
    return shape


@query(
    "h3_alternation_records",
    f"""WITH {_SHAPE_SQL} SELECT conv_id AS traj, ok AS valid FROM v""",
)
def h3_alternation_records(spark, sf):
    packed = conversation.pack(spoken(spark, sf, "traj % 7 <> 1 OR pos <> 2"), ["traj"])
    return packed.select("traj", conversation.is_alternating(conversation.close(F.col("conversations"))).alias("valid"))


@query(
    "h4_function_calls",
    """SELECT conv_id AS traj, turn AS pos, CASE WHEN turn % 2 = 0 THEN '<think>' || chr(10) || text || chr(10) || '</think>' || chr(10) || chr(10) ELSE '' END
      || '<tool_call>' || chr(10) || '[{"name": "web_search", "arguments": {"query": ' || to_json(text)::VARCHAR || ', "topn": ' || turn || '}}]' || chr(10) || '</tool_call>' AS value
    FROM conversations""",
)
def h4_function_calls(spark, sf):
    from waybook.functions.strings import json_text

    args = F.concat(calls.one_arg("query", json_text(F.col("content"))), calls.one_arg("topn", F.col("pos").cast("string")))
    thinking = F.when(F.col("pos") % 2 == 0, F.col("content")).otherwise("")
    return turns(spark, sf).select("traj", "pos", conversation.function_call(F.lit("web_search"), args, thinking).alias("value"))


@query(
    "h5_tools_column",
    """WITH u AS (SELECT conv_id, string_agg(DISTINCT '{"name": "t' || (turn % 3) || '"}', ', ' ORDER BY '{"name": "t' || (turn % 3) || '"}') AS l
      FROM conversations WHERE role = 'assistant' AND turn % 3 <> 2 GROUP BY 1)
    SELECT c.conv_id AS traj, coalesce('[' || l || ']', '') AS used, '[{"name": "t0"}, {"name": "t1"}]' AS every
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN u USING (conv_id)""",
)
def h5_tools_column(spark, sf):
    definitions = {"t0": '{"name": "t0"}', "t1": '{"name": "t1"}'}
    rows = turns(spark, sf)
    used = rows.where("role = 'assistant'").withColumn("tool", F.concat(F.lit("t"), (F.col("pos") % 3).cast("string")))
    packed = conversation.pack(spoken(spark, sf), ["traj"], tools=conversation.used_tools(used, ["traj"], "tool", definitions))
    return packed.select("traj", F.col("tools").alias("used"), conversation.all_tools(definitions).alias("every"))


@query(
    "h6_record_ids",
    """SELECT doc_id, source || '_' || coalesce(CASE WHEN doc_id % 3 > 0 THEN doc_id % 3 END, 0) AS record_id,
      CASE WHEN doc_id % 3 > 0 THEN source || '__traj' || (doc_id % 3) ELSE source END AS request_id FROM documents""",
)
def h6_record_ids(spark, sf):
    idx = F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3)
    return table(spark, sf, "documents").select(
        "doc_id", plan.record_id(F.col("source"), idx).alias("record_id"), plan.request_id(F.col("source"), idx).alias("request_id")
    )

"""Filters and projections (C1-C11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from waybook import constants as K
from waybook.catalog.registry import query
from waybook.catalog.tables import CALLS_SQL, calls, table, turns
from waybook.functions.payloads import search_hits
from waybook.functions.strings import cut
from waybook.operators import conversation, select


@query(
    "c1_native_training",
    f"WITH {CALLS_SQL} SELECT seq, k // 2 AS num_tool_calls FROM calls WHERE tool <> 'error' AND k % 5 <> 0 AND k // 2 >= 2",
)
def c1_native_training(spark, sf):
    rows = calls(spark, sf).selectExpr(
        "seq", "if(tool = 'error', 'error', 'success') AS status", "if(k % 5 = 0, NULL, int(k div 2)) AS num_tool_calls"
    )
    return select.native_training(rows, 2).select("seq", "num_tool_calls")


@query(
    "c2_foreign_training",
    """SELECT doc_id, lang AS type FROM documents
    WHERE lang IN ('en', 'de') AND doc_id % 4 >= 1 AND CASE WHEN doc_id % 9 = 0 THEN 0 ELSE n_chars END <= 1000""",
)
def c2_foreign_training(spark, sf):
    rows = table(spark, sf, "documents").selectExpr(
        "doc_id", "lang AS type", "doc_id % 4 AS num_tool_calls", "if(doc_id % 9 = 0, NULL, n_chars) AS tokenized_length"
    )
    return select.foreign_training(rows, ["en", "de"], 1, 1000).select("doc_id", "type")


@query(
    "c3_channel_training",
    """WITH t AS (SELECT conv_id, count(*) AS n, CAST(sum((role = 'assistant')::INT) AS BIGINT) AS c FROM conversations GROUP BY 1)
    SELECT conv_id AS traj, 'channel' AS kind FROM t WHERE c <= 3 AND conv_id % 3 <> 0
    UNION ALL SELECT conv_id, 'selfplay' FROM t WHERE c <= 2""",
)
def c3_channel_training(spark, sf):
    rows = turns(spark, sf).groupBy("traj").agg(
        F.count(F.lit(1)).alias("num_turns"), F.count_if(F.col("role") == "assistant").alias("num_tool_calls")
    )
    rows = rows.withColumn("status", F.when(F.col("traj") % 3 == 0, "error").otherwise("success"))
    channel = select.channel_training(rows, max_calls=3).select("traj", F.lit("channel").alias("kind"))
    selfplay = select.channel_training(rows, max_calls=2, success_only=False).select("traj", F.lit("selfplay").alias("kind"))
    return channel.unionByName(selfplay)


@query("c4_blocked_domains", "SELECT page_id, url FROM pages WHERE NOT contains(url, 'example.com') AND NOT contains(url, '/de/')")
def c4_blocked_domains(spark, sf):
    return select.not_blocked(table(spark, sf, "pages"), "url", ["example.com", "/de/"]).select("page_id", "url")


@query(
    "c5_banned_and_blocked",
    """SELECT page_id, u AS url FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url || '/unifuncs' WHEN 1 THEN 'https://huggingface.co/datasets/' || page_id ELSE url END AS u FROM pages)
    WHERE NOT contains(u, 'unifuncs') AND NOT contains(u, 'huggingface.co/datasets') AND NOT contains(u, 'example.net')""",
)
def c5_banned_and_blocked(spark, sf):
    rows = table(spark, sf, "pages").selectExpr(
        "page_id",
        "CASE page_id % 4 WHEN 0 THEN url || '/unifuncs' WHEN 1 THEN 'https://huggingface.co/datasets/' || page_id ELSE url END AS url",
    )
    return select.not_blocked(rows, "url", [*K.BANNED_URL_PARTS, "example.net"])


@query(
    "c6_unblocked_records",
    r"""SELECT page_id, url FROM pages WHERE NOT contains(lower(regexp_extract(html, '<title>([^<]*)', 1) || ' ' || url || ' ' || html), 'example.net')
      AND NOT contains(lower(regexp_extract(html, '<title>([^<]*)', 1) || ' ' || url || ' ' || html), 'ouonthe')""",
)
def c6_unblocked_records(spark, sf):
    rows = table(spark, sf, "pages").select(
        "page_id", "url", F.regexp_extract("html", r"<title>([^<]*)", 1).alias("title"), F.col("html").alias("summary")
    )
    return select.unblocked_records(rows, [" Example.NET ", "", "  ", "OUONTHE"]).select("page_id", "url")


@query(
    "c7_ranked_results",
    """SELECT doc_id, i::INT AS rank, url FROM (
      SELECT doc_id, unnest(w) AS url, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))
    WHERE url <> '' AND NOT starts_with(url, 'th')""",
)
def c7_ranked_results(spark, sf):
    words = F.split("text", " ")
    results = F.transform(words, lambda w: F.struct(F.when(~w.startswith("th"), w).alias("url")))
    rows = table(spark, sf, "documents").select("doc_id", results.alias("results"))
    return select.ranked_results(rows, "results").select("doc_id", "rank", "url")


@query(
    "c8_renumbered_hits",
    """WITH w AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: NOT contains(x, 'th'))[1:5] AS l FROM documents)
    SELECT doc_id, generate_subscripts(l, 1)::INT AS id, unnest(l) AS url FROM w""",
)
def c8_renumbered_hits(spark, sf):
    organic = F.transform(F.split("text", " "), lambda w: F.struct(w.alias("link"), F.lit("t").alias("title")))
    payload = F.to_json(F.struct(organic.alias("organic")))
    rows = table(spark, sf, "documents").select("doc_id", payload.alias("payload"))
    return rows.select("doc_id", F.inline(search_hits(F.col("payload"), 5, ["th"]))).select("doc_id", "id", "url")


@query(
    "c9_valid_tools",
    """SELECT tool, count(*) AS n FROM (SELECT CASE event_type WHEN 'click' THEN 'browser.search' WHEN 'view' THEN 'browser.open'
      WHEN 'signup' THEN 'functions.paper_search' ELSE event_type END AS tool FROM events)
    WHERE tool IN ('browser.search', 'browser.open', 'browser.find', 'functions.paper_search', 'functions.pubmed_search') GROUP BY 1""",
)
def c9_valid_tools(spark, sf):
    names = {"click": "browser.search", "view": "browser.open", "signup": "functions.paper_search"}
    rows = calls(spark, sf).select(select.map_names(F.col("tool"), names).alias("tool"))
    return select.valid_tools(rows, "tool", K.VALID_TOOLS).groupBy("tool").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c10_cut_text",
    """SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS abstract,
      length(left(text, 30000)) AS stored, md5(CASE WHEN length(text) > 20000 THEN left(text, 20000) || ' [Result truncated due to length limit]' ELSE text END) AS tool_md5
    FROM documents""",
)
def c10_cut_text(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", cut(text, 500, "...").alias("abstract"), F.length(cut(text, K.STORED_RESULT_CHARS)).cast("bigint").alias("stored"),
        F.md5(cut(text, 20_000, " [Result truncated due to length limit]")).alias("tool_md5"),
    )


@query(
    "c11_trained_chars",
    """SELECT trained, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM (
      SELECT role = 'assistant' AS trained, text FROM conversations) GROUP BY 1""",
)
def c11_trained_chars(spark, sf):
    role = select.map_names(F.col("role"), {"assistant": "gpt", "user": "human"})
    rows = turns(spark, sf).withColumn("trained", conversation.trained(role))
    return rows.groupBy("trained").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("content")).alias("chars"))

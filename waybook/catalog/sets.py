"""Sorts, limits and set operations (G1-G6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from waybook.catalog.registry import query
from waybook.catalog.tables import QID, calls, table, texts, turns
from waybook.functions.pages import find
from waybook.functions.payloads import first_names
from waybook.operators import plan, score, select
from waybook.operators.sets import merge_searches, mix
from waybook.sources.tables import dealt


@query(
    "g1_most_common",
    "SELECT tool, n, first_seen FROM (SELECT props AS tool, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY 1) ORDER BY n DESC, first_seen LIMIT 6",
)
def g1_most_common(spark, sf):
    rows = table(spark, sf, "events").select(F.col("props").alias("tool"), "event_id")
    return score.most_common(score.counts(rows, "tool", "event_id"), "tool", 6).drop("share")


@query(
    "g2_first_matches",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, E'\\n')) AS line, generate_subscripts(string_split(text, E'\\n'), 1) AS i FROM documents),
    m AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM l WHERE contains(lower(line), 'on'))
    SELECT doc_id, count(*)::INT AS total, string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (r <= 20) AS shown, greatest(count(*) - 20, 0)::INT AS more FROM m GROUP BY 1""",
)
def g2_first_matches(spark, sf):
    rows = texts(spark, sf, "documents").select("doc_id", find(F.col("text"), F.lit("ON")).alias("f")).where("f.total > 0")
    numbers = F.array_join(F.transform("f.shown", lambda e: e["line_no"].cast("string")), ",")
    return rows.select("doc_id", "f.total", numbers.alias("shown"), "f.more")


@query(
    "g3_author_lists",
    """SELECT doc_id, array_to_string(w[1:4], ', ') || CASE WHEN len(w) > 4 THEN ' et al.' ELSE '' END AS authors,
      array_to_string(w[1:3], ', ') || CASE WHEN len(w) > 3 THEN ' et al.' ELSE '' END AS snippet_authors
    FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""",
)
def g3_author_lists(spark, sf):
    words = F.split("text", " ")
    rows = table(spark, sf, "documents").select("doc_id", words.alias("w"))
    return rows.select("doc_id", first_names(F.col("w"), 4).alias("authors"), first_names(F.col("w"), 3).alias("snippet_authors"))


@query(
    "g4_mix",
    """SELECT 'turns' AS dataset, conv_id AS id, role AS kind, length(text) AS size FROM conversations
    UNION ALL SELECT 'documents', doc_id, lang, length(text) FROM documents UNION ALL SELECT 'pages', page_id, url, length(html) FROM pages""",
)
def g4_mix(spark, sf):
    """Three whole tables, whose columns come in different orders."""
    return mix({
        "turns": turns(spark, sf).selectExpr("traj AS id", "role AS kind", "bigint(length(content)) AS size"),
        "documents": table(spark, sf, "documents").selectExpr("lang AS kind", "doc_id AS id", "bigint(length(text)) AS size"),
        "pages": table(spark, sf, "pages").selectExpr("bigint(length(html)) AS size", "url AS kind", "page_id AS id"),
    })


@query("g5_except_keys", f"SELECT DISTINCT {QID} AS qid FROM documents EXCEPT SELECT {QID} FROM documents JOIN labels USING (doc_id) WHERE quality = 0")
def g5_except_keys(spark, sf):
    docs = table(spark, sf, "documents")
    done = docs.join(table(spark, sf, "labels").where("quality = 0"), "doc_id").selectExpr(f"{QID} AS qid")
    return plan.pending(docs.selectExpr(f"{QID} AS qid").distinct(), done, ["qid"])


@query(
    "g6_merged_search",
    """WITH q AS (SELECT doc_id, unnest([1, 2, 3]) AS qn, text FROM documents),
    r AS (SELECT doc_id, qn, unnest(string_split(text, ' ')) AS url,
            generate_subscripts(string_split(text, ' '), 1) AS rank FROM q WHERE (doc_id + qn) % 4 > 0)
    SELECT doc_id AS request, 'q1 | q2 | q3' AS title, string_agg(qn || '.' || rank || '=' || url, ' ' ORDER BY qn, rank) AS hits FROM r GROUP BY 1""",
)
def g6_merged_search(spark, sf):
    docs = dealt(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("qn"), "text")
    words = F.when((F.col("doc_id") + F.col("qn")) % 4 > 0, F.split("text", " "))
    results = F.transform(words, lambda w, i: F.struct((i + 1).alias("rank"), w.alias("url")))
    searches = docs.select(F.col("doc_id").alias("request"), "qn", F.concat(F.lit("q"), F.col("qn").cast("string")).alias("query"), results.alias("results"))
    merged = merge_searches(searches, "request", "qn").where(F.size("results") > 0)
    shown = F.transform("results", lambda r: F.concat(r["qn"].cast("string"), F.lit("."), r["rank"].cast("string"), F.lit("="), r["url"]))
    return merged.select("request", "title", F.array_join(shown, " ").alias("hits"))


@query(
    "g1_status_by_tool",
    "SELECT event_type AS tool, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, tool LIMIT 3",
)
def g1_status_by_tool(spark, sf):
    used = select.valid_tools(calls(spark, sf), "tool", ["view", "signup", "click", "error", "purchase"])
    return score.most_common(score.counts(used, "tool"), "tool", 3).drop("share")

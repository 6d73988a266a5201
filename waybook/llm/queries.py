"""The operators over the given tables, with the SQL each must agree with where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybook.llm import centroids, decontamination, divergence, extraction, idfile, jaccard, mixing, neighbours, packing, shards, tokens, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op10_jaccard_join")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.join(table(spark, sf, "documents")).drop("text_hash")


@query("op7_token_counts")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.counts(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op9_shards")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    made = shards.balanced(table(spark, sf, "documents"), 24)
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query(
    "op5_mixture",
    r"""
    WITH RECURSIVE
    d AS (
      SELECT doc_id, source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS n_tokens,
             md5(concat('0:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(source, ''))) AS mark
      FROM documents GROUP BY doc_id, source, text),
    s AS (SELECT source, sum(n_tokens) AS tokens, count(*) AS docs FROM d GROUP BY source),
    e AS (SELECT sum(tokens) AS total, ln(min(tokens) / sum(tokens)) AS low, ln(max(tokens) / sum(tokens)) AS high FROM s WHERE tokens > 0),
    b AS (
      SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
      UNION ALL
      SELECT i + 1, CASE WHEN ((lo + hi) / 2 - 1) * (low - high) > ln(2.0) THEN (lo + hi) / 2 ELSE lo END,
             CASE WHEN ((lo + hi) / 2 - 1) * (low - high) > ln(2.0) THEN hi ELSE (lo + hi) / 2 END
      FROM b, e WHERE i < 50),
    x AS (SELECT (lo + hi) / 2 AS x FROM b WHERE i = 50),
    raw AS (SELECT s.*, pow(tokens / total, x) AS r FROM s, e, x),
    q AS (SELECT *, r * (SELECT max(tokens / r) FROM raw) AS quota FROM raw),
    w AS (SELECT *, CAST(floor(quota / tokens + 1e-9) AS BIGINT) AS passes FROM q),
    v AS (SELECT *, CAST(floor(quota - passes * tokens + 1e-6) AS BIGINT) AS rest FROM w),
    p AS (
      SELECT d.*, passes, rest, CAST(('0x' || substr(mark, 1, 8))::BIGINT % CAST(ceil(docs / 1024) AS BIGINT) AS BIGINT) AS block
      FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source),
    k AS (SELECT source, block, sum(n_tokens) AS n, md5(concat('0:', coalesce(source, ''), ':', block, ':', passes + 1)) AS mark FROM p GROUP BY source, block, passes),
    o AS (SELECT source, block, sum(n) OVER (PARTITION BY source ORDER BY mark ROWS UNBOUNDED PRECEDING) - n AS start FROM k),
    u AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source, block ORDER BY mark ROWS UNBOUNDED PRECEDING) - n_tokens AS within FROM p)
    SELECT u.doc_id, u.source, CAST(u.n_tokens AS BIGINT) AS n_tokens, u.block,
           CAST(passes + CASE WHEN start + within < rest THEN 1 ELSE 0 END AS BIGINT) AS copies
    FROM u JOIN o ON u.source IS NOT DISTINCT FROM o.source AND u.block = o.block
    """,
)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    """Every document at least once and no source more than twice."""
    return mixing.mixture(table(spark, sf, "documents"), repeats=2.0)[0].select("doc_id", "source", "n_tokens", "block", "copies")


@query(
    "op2_decontamination",
    r"""
    WITH
    d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    n AS (SELECT item_id, w, least(13, len(w)) AS l FROM b WHERE len(w) > 0),
    i AS (SELECT DISTINCT item_id, l, array_to_string(w[s : s + l - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS s FROM n)),
    e AS (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM i) WHERE len(w) >= l),
    h AS (SELECT DISTINCT e.doc_id, e.s, e.l, i.item_id FROM e JOIN i ON e.l = i.l AND array_to_string(e.w[e.s : e.s + e.l - 1], ' ') = i.t),
    c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM h) GROUP BY doc_id),
    k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
    """,
)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op1_token_files")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return idfile.round_trip(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2, vocabulary=49408)


@query("op3_neighbours")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.search(table(spark, sf, "embeddings"), every=20, k=20)


@query("op4_warc")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(table(spark, sf, "pages"), least=0)


@query("op6_main_text")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.extracted(table(spark, sf, "pages"))


@query("op8_toxicity")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf, "labels"))).drop("text_hash")


@query("op11_packing")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def _clusters_sql(k: int = 16, rounds: int = 3) -> str:
    """The rounds one after the other."""
    parts = [
        """x AS MATERIALIZED (
          SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: CAST(floor(64.0 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64)""",
        f"""c0 AS MATERIALIZED (
          SELECT CAST(n AS INTEGER) AS c, v FROM (SELECT v, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS n FROM x) WHERE n < {k})""",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (
              SELECT r, vec_id, x.v, min({{'d': list_sum(list_transform(list_zip(x.v, c{i}.v), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS BIGINT))), 'c': c}}) AS near
              FROM x, c{i} GROUP BY r, vec_id, x.v)"""
        )
        if i < rounds:
            parts.append(
                f"""c{i + 1} AS MATERIALIZED (
                  SELECT c{i}.c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (
                    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS v FROM (
                      SELECT near.c AS c, p, sum(v[p]) AS s, count(*) AS n FROM a{i}, range(1, 65) AS t(p) GROUP BY near.c, p)
                    GROUP BY c) m ON m.c = c{i}.c)"""
            )
    last = f"a{rounds}"
    return f"""
    WITH {", ".join(parts)}
    SELECT vec_id, near.c AS cluster, CAST(near.d AS BIGINT) AS distance, CAST(sum(near.d) OVER (PARTITION BY near.c) AS BIGINT) AS cluster_inertia,
           CAST(sum(near.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
    FROM {last} JOIN c{rounds} ON near.c = c{rounds}.c
    """


@query("op12_centroids", _clusters_sql())
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return centroids.clusters(table(spark, sf, "embeddings"))


@query(
    "op13_divergence",
    r"""
    WITH
    d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    g AS (SELECT DISTINCT lang, source FROM d),
    t AS (SELECT i, lang, source, unnest(w) AS term FROM d),
    k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
    v AS (SELECT g.lang, count(term) AS v FROM (SELECT DISTINCT lang FROM g) g LEFT JOIN k ON g.lang = k.lang GROUP BY g.lang),
    c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
    s AS (SELECT g.lang, g.source, v, coalesce(sum(n), 0) AS total FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source, v),
    p AS (
      SELECT s.lang, s.source, k.term, coalesce(n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 5) // (total + 5 * v) AS p
      FROM s JOIN k ON s.lang = k.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
    l AS (
      SELECT x.lang, term, 1 + CAST(1000000000 AS HUGEINT) * (m + 5) // (total + 5 * v) AS q
      FROM (SELECT lang, term, sum(n) AS m FROM c GROUP BY lang, term) x JOIN (SELECT lang, v, sum(total) AS total FROM s GROUP BY lang, v) y USING (lang)),
    r AS (
      SELECT s.lang, s.source, 'pair' AS part, o.source AS item, coalesce(f, 0) AS value
      FROM s JOIN s o ON s.lang = o.lang AND s.source <> o.source LEFT JOIN (
        SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) e
      ON e.lang = s.lang AND e.source = s.source AND e.item = o.source
      UNION ALL
      SELECT p.lang, p.source, 'term', term, p - q FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
    FROM r QUALIFY part = 'pair' OR rank <= 50
    """,
)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit(table(spark, sf, "documents"))

"""Files in and out, payload dumps, liveness and restartable streams."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from waybook.catalog import sets as sets_catalog
from waybook.functions import formats, pages, payloads
from waybook.operators import ordered, report, score, select, sets
from waybook.sources import scratch, tables
from waybook.streaming import streams


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_strict_and_lenient_scans(spark, tmp_path):
    schema = "qid string, traj_idx bigint"
    good = write(tmp_path / "a.jsonl", '{"qid": "1"}', "", '{"qid": "2", "traj_idx": 3}')
    assert [tuple(r) for r in tables.read_jsonl(spark, good, schema).collect()] == [("1", None), ("2", 3)]
    bad = write(tmp_path / "b.jsonl", '{"qid": "1"}', '{"qid": "2", "tr', "", '{"traj_idx": 1}', '{"qid": "3"} tail', '{"qid": "4"}')
    assert [r["qid"] for r in tables.read_jsonl_lenient(spark, bad, schema).collect()] == ["1", "4"]
    odd = write(tmp_path / "c.jsonl", '{"qid": "1", "qid": "2", "x": {"a": 1, "a": 2}}', '{"qid": "3", "n": NaN}', '{"qid": "4", "s": "' + "x" * 3_000_000 + '"}', "{'qid': '5'}", '{"qid": "6"}, {"qid": "7"}', "null", "[]")
    assert [r["qid"] for r in tables.read_jsonl_lenient(spark, odd, "qid string, n double").collect()] == ["2", "3", "4"]
    with pytest.raises(Exception):
        tables.read_jsonl(spark, bad, schema).collect()


def test_result_file(spark, tmp_path):
    result = {"model": "m", "per_question": [{"qid": "a", "accuracy": 0.5, "answers": [{"traj_idx": 0, "correct": True}, {"explanation": "e"}]}, {"qid": "b", "answers": []}]}
    path = write(tmp_path / "results.json", json.dumps(result, indent=2))
    got = tables.read_results(spark, path).select("qid", "traj_idx", "correct", "explanation", "accuracy").collect()
    assert [tuple(r) for r in got] == [("a", 0, True, "", 0.5), ("a", 0, False, "e", 0.5)]


def test_shards_and_verdict_files(spark, tmp_path):
    write(tmp_path / "node_0.jsonl", '{"qid": "x"}')
    write(tmp_path / "node_12.jsonl", '{"qid": "y"}')
    assert {(r["qid"], r["rank"]) for r in tables.read_shards(spark, str(tmp_path), "qid string").collect()} == {("x", 0), ("y", 12)}
    folder = tmp_path / "evals"
    folder.mkdir()
    write(folder / "q1__traj0_eval.json", json.dumps({"query_id": "q1__traj0", "correct": True}, indent=1))
    got = tables.verdict_files(spark, str(folder), "query_id string, correct boolean").first()
    assert tuple(got) == ("q1__traj0", True, "q1__traj0")


def test_question_aliases(spark):
    df = spark.createDataFrame([("What?", None, "5")], "query string, note string, answer string")
    got = tables.questions(df).select("qid", "question", "reference_answer").first()
    assert tuple(got) == (hashlib.md5(b"What?").hexdigest()[:8], "What?", "5")
    with pytest.raises(ValueError):
        tables.questions(df.drop("query"))
    mixed = spark.createDataFrame([(None, "q7", "in", None), ("i1", "q8", "x", "t")], "id string, qid string, input string, target string")
    got = tables.training_questions(mixed, F.lit(9)).collect()
    assert [tuple(r) for r in got] == [("q7", "in", ""), ("i1", "x", "t")]


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", None, "x" * 201, "c,\"d\"", None, True, None), ("b", "e\nf", "r", "c", True, False, True)],
        "query_id string, extracted_final_answer string, response string, correct_answer string, correct boolean, is_completed boolean, parse_error boolean",
    )
    tables.write_csv(tables.judge_csv(rows).coalesce(1), str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv")).orderBy("query_id").collect()
    assert [tuple(r) for r in back] == [("a", "x" * 200 + "...", 'c,"d"', None, "true", "false"), ("b", "e\nf", "c", "true", "false", "true")]


def test_scratch_is_under_the_configured_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch.folder(spark, "x")
    assert path.startswith(base) if base else "/waybook-x-" in path
    assert scratch.folder(spark, "x") != path


def test_gauges(spark):
    lines = [
        ("w", 1, 'vllm:num_requests_running{a="b"} 1.0'), ("w", 2, 'vllm:num_requests_running{a="c"} 3.0'), ("w", 3, "vllm:kv_cache_usage_perc{} 0.25"),
        ("w", 4, "# vllm:num_requests_waiting{} 9"), ("v", 1, "other 1"),
    ]
    got = report.gauges(spark.createDataFrame(lines, "worker string, line_no int, line string")).collect()
    assert [tuple(r) for r in got] == [("w", 3.0, None, 25.0)]


def test_payload_texts(one):
    empty = json.dumps({"searchParameters": {"q": "x"}, "organic": []})
    got = one(payloads.search_text, empty, "not json", json.dumps({"organic": [{"title": "T"}]}))
    assert got == [empty, "not json", 'Searched for ""\n\n[1] T\n    URL: \n']
    assert one(payloads.page_text, '{"text": "T"}', "{}", "x") == ["T", "{}", "x"]
    papers = {"data": [{"title": "A", "snippet": "plain"}, {"paper": {"title": "B"}, "snippet": {"text": "y" * 801}}]}
    assert one(payloads.paper_text, json.dumps(papers)) == [
        "Paper search results:\n\n[1] A\n    Snippet: plain\n\n[2] B\n    Snippet: " + "y" * 800 + "...\n"
    ]
    env = one(payloads.environment_text, "", "{'text': 'a\\nb'}", '{"text": "c", "ok": true}', "{'other': 1}", "{broken", " plain ")
    assert env == ["(no output)", "a\nb", "c", "{'other': 1}", "{broken", "plain"]


def test_content_and_results(spark, one):
    shown = lambda c: payloads.content_text(F.try_parse_json(c))
    assert one(shown, '"a"', '[{"type": "text", "text": "x"}, {"type": "image"}, {"type": "text", "text": ""}, {"type": "text", "text": "y"}]', "null", "3", None) == ["a", "x\ny", "", "", ""]
    assert one(payloads.code_outcome, "timed out Error", "ValueError", " ", "(no output)", "fine") == ["timeout", "error", "no_output", "no_output", "success"]
    df = spark.createDataFrame([("e", None), (None, None), (None, "r")], "e string, r string")
    got = [r[0] for r in df.select(payloads.result_text(F.lit("s"), F.lit("t"), F.col("e"), F.col("r"))).collect()]
    assert got == ["Tool call to t on s failed. Error: e", "Tool call to t on s completed, but produced no specific output or result.", "r"]


def test_articles(one):
    xml = (
        "<PubmedArticleSet><PubmedArticle><PMID Version=\"1\">12</PMID><Article><Journal><Title>J &amp; K</Title></Journal><ArticleTitle>A <i>b</i> &lt;c</ArticleTitle>"
        "<Abstract><AbstractText Label=\"X &amp; Y\">p <b>q</b></AbstractText><AbstractText/></Abstract><Author><LastName>L&#233;</LastName><ForeName>F</ForeName></Author>"
        "<Author><LastName>N</LastName></Author></Article></PubmedArticle><PubmedArticle><PMID>13</PMID></PubmedArticle></PubmedArticleSet>"
    )
    got = one(lambda c: F.transform(payloads.articles(c), payloads.article), xml)[0]
    assert [tuple(a) for a in got] == [("12", "A b <c", "X & Y: p q ", "F Lé", "J & K", ""), ("13", "", "", "", "", "")]


def test_display_texts(one):
    data = {"data": [{"title": "T", "year": 2020, "authors": [], "externalIds": {"DOI": "d"}, "url": "u"}, {}]}
    shown = one(lambda c: payloads.papers_text(F.lit("q"), payloads.papers(c)), json.dumps(data), '{"data": []}')
    assert shown == [
        'Paper search: "q"\n\n[1] T\n    Year: 2020 | Citations: 0\n    DOI: d\n    URL: u\n\n[2] Untitled\n    Citations: 0\n', "No papers found for: q",
    ]
    snippet = {"data": [{"title": "S", "snippet": "text", "paperId": "7", "authors": ["A", {"name": "B"}], "year": 1999}]}
    assert one(lambda c: payloads.snippets_text(F.lit("q"), payloads.snippets(c)), json.dumps(snippet)) == [
        'Paper snippet search: "q"\n\n[1] S\n    A, B | 1999\n    URL: https://www.semanticscholar.org/paper/7\n    Snippet: text\n'
    ]
    xml = "<PubmedArticle><PMID>5</PMID><Article><ArticleTitle>T</ArticleTitle></Article></PubmedArticle>"
    assert one(lambda c: payloads.articles_text(F.lit("q"), F.transform(payloads.articles(c), payloads.article)), xml) == [
        'PubMed search: "q"\n\n[1] T\n    URL: https://pubmed.ncbi.nlm.nih.gov/5/\n'
    ]


def test_registered_formats_and_verdicts(spark, one):
    formats.register_format("upper", formats.Format(*[getattr(formats.get_format("tagged"), f) for f in ("parse_call",)], lambda c: F.struct(F.lit("").alias("reasoning"), F.upper(c).alias("answer")), None, None))
    assert one(lambda c: formats.get_format("upper").split(c)["answer"], "a") == ["A"]
    with pytest.raises(KeyError):
        formats.get_format("none")
    formats.register_verdict("never", lambda c: F.struct(F.lit(False).alias("correct"), c["answer"].alias("explanation")))
    assert [tuple(r) for r in one(lambda c: formats.get_verdict("never")({"answer": c}), "x")] == [(False, "x")]
    render = formats.get_format("channel").render_round
    assert one(lambda c: render(F.lit("o"), F.lit("browser"), F.lit("open"), c), 'é "q"😀') == [
        'o<|call|><|start|>browser.open to=assistant<|channel|>commentary<|message|>"\\u00e9 \\"q\\"\\ud83d\\ude00"<|end|><|start|>assistant'
    ]


def test_pages(one):
    html = "<html><script>if (a<b) '</p>'</script><STYLE>x</STYLE><p>a&amp;b</p>\n\n<b>c</b> d</html>"
    assert one(pages.html_text, html, "") == ["a&amp;b c d", ""]
    text = "\n".join(["The x"] * 21 + ["none"])
    found = one(lambda c: pages.find(c, F.lit("the")), text)[0]
    assert (found["total"], len(found["shown"]), found["more"], found["shown"][-1]["line_no"]) == (21, 20, 1, 20)
    view = lambda loc, n: one(lambda c: pages.view_text(c, F.lit(loc), F.lit(n)), "a\nb\nc")[0]
    assert (view(2, 1), view(0, 0), view(9, 2)) == ("L2: b", "L1: a\nL2: b\nL3: c", "")


def test_search_rules(spark):
    df = spark.createDataFrame([([("a", "u1"), ("b", None), ("c", ""), ("d", "u4")],)], "r array<struct<title:string,url:string>>")
    assert [(r["rank"], r["url"]) for r in select.ranked_results(df, "r").collect()] == [(1, "u1"), (4, "u4")]
    records = spark.createDataFrame([("A", "u", None), ("b", "BAD.com", "s"), ("c", "u", "has Secret")], "title string, url string, summary string")
    assert [r["title"] for r in select.unblocked_records(records, [" bad.COM ", "secret", " ", ""]).collect()] == ["A"]
    assert select.unblocked_records(records, ["", " "]).count() == 3
    searches = spark.createDataFrame([(1, 1, "q", [(1, "u")]), (1, 0, "p", []), (2, 0, "z", None)], "request int, n int, query string, results array<struct<rank:int,url:string>>")
    merged = {r["request"]: (r["title"], [x["url"] for x in r["results"]]) for r in sets.merge_searches(searches, "request", "n").collect()}
    assert merged == {1: ("p | q", ["u"]), 2: ("z", [])}
    with pytest.raises(Exception, match="no results"):
        sets.merge_searches(searches, "request", "n", strict=True).collect()


def test_empty_scores(spark):
    none = spark.createDataFrame([], "qid string, traj_idx int, correct boolean")
    assert tuple(score.summary(score.per_question(none)).first()) == (0, 0, 0, 0, 0.0, 0.0, 0.0)
    assert report.grader_summary(none).first()["accuracy_percent"] == 0
    labels = spark.createDataFrame([(1, 0.004), (5, 0.5), (0, 0.0), (10, 0.125)], "n int, share double")
    got = [r[0] for r in labels.select(score.share_label(F.col("n"), F.col("share"))).collect()]
    assert got == ["0.4%", "50%", "0%", "12%"]


START = datetime(2024, 1, 1)


def beats(spark, rows):
    data = [(w, i, START + timedelta(seconds=s), kind) for i, (w, s, kind) in enumerate(rows)]
    return spark.createDataFrame(data, "worker_id long, seq long, ts timestamp, kind string")


ROWS = [
    (1, 0, "register"), (1, 120, "heartbeat"), (1, 240.000001, "heartbeat"), (1, 250, "register"), (1, 260, "heartbeat"),
    (2, 0, "heartbeat"), (2, 10, "register"), (2, 20, "heartbeat"), (3, 5, "heartbeat"),
]


def test_liveness(spark):
    end = F.lit(START + timedelta(seconds=380))
    got = report.liveness(beats(spark, ROWS), "seq", 120, end).orderBy("seq").collect()
    assert [r["accepted"] for r in got] == [True, True, False, True, True, False, True, True, False]
    at = lambda s: START + timedelta(seconds=s)
    assert [r["offline_at"] for r in got] == [None, at(240), None, None, None, None, None, at(140), None], "260 + 120 is not over yet"


def test_worker_lives(spark):
    got = report.worker_lives(beats(spark, ROWS), "seq", 120).orderBy("worker_id", "first_seen").collect()
    spans = [(r["worker_id"], r["registered"] is not None, r["events"], r["offline_at"] and (r["offline_at"] - START).total_seconds()) for r in got]
    assert spans == [(1, True, 2, 240.0), (1, True, 3, 380.0), (2, True, 3, 140.0), (3, False, 1, None)]


def test_worker_lives_of_a_stream(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    rows = beats(spark, [*ROWS, *[(7, 50 * i * i % 4000, "heartbeat") for i in range(90)]])
    rows.select("worker_id", "ts", "kind").repartition(4).write.parquet(src)
    log = streams.growing_log(spark, src, "worker_id long, ts timestamp, kind string", 1, fmt="parquet")
    streams.worker_lives(log, out, state, 120).awaitTermination()
    want = report.worker_lives(rows, "ts", 120)
    columns = ["worker_id", "first_seen", "registered", "last_seen", "events", "offline_at"]
    assert set(streams.current_lives(spark, out, 120).select(columns).collect()) == set(want.select(columns).collect())


def test_status_log_keeps_every_change_of_a_hot_worker_in_any_file_order(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    rows = spark.range(60_000).selectExpr("1L AS worker_id", "id AS seq", "if(id % 2 = 0, 'READY', 'OFFLINE') AS status")
    rows.repartition(4).write.parquet(src)
    log = streams.growing_log(spark, src, "worker_id long, seq long, status string", 1, fmt="parquet")
    streams.status_log(log, out, state).awaitTermination()
    assert streams.status_changes(spark, out).count() == 59_999


def test_upsert_restarts_and_last_record_wins(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    schema = "qid string, at long, v string"

    def drain(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
        streams.upsert(streams.growing_log(spark, src, schema), ["qid"], ["at"], out, state).awaitTermination()
        return {r["qid"]: r["v"] for r in streams.current(spark, out, ["qid"], ["at"]).collect()}

    assert drain([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "b")]) == {"a": "new", "b": "b"}
    assert drain([("a", 3, "newest"), ("b", 0, "late")]) == {"a": "newest", "b": "b"}
    assert drain([("a", 3, "same time, later batch")]) == {"a": "same time, later batch", "b": "b"}
    target = str(tmp_path / "compacted")
    streams.compact(spark, out, target, ["qid"], ["at"])
    assert {r["qid"]: r["v"] for r in streams.current(spark, target, ["qid"], ["at"]).collect()} == {"a": "same time, later batch", "b": "b"}


def test_first_chunk(spark):
    rows = [("r", 0.0, ""), ("r", 0.25, "x"), ("r", 1.0, "y"), ("s", 0.0, None), ("s", 2.0, "")]
    df = spark.createDataFrame([(k, START + timedelta(seconds=s), t) for k, s, t in rows], "id string, ts timestamp, text string")
    got = {r["id"]: (float(r["ttft_ms"]), float(r["total_time_s"])) for r in report.first_chunk(df, ["id"], "ts", "text").collect()}
    assert got == {"r": (250.0, 1.0), "s": (2000.0, 2.0)}


@pytest.mark.parametrize("width", [3, 1 << 20])
def test_nested_results_are_written_by_ranges(spark, tmp_path, width):
    rows = [(None if i % 9 == 0 else "hot" if i % 2 else f'q"{i % 5}', i, None if i % 4 else 'x,"answers":[', i % 3 == 0) for i in range(60)]
    path = str(tmp_path / "nested")
    tables.write_nested(spark.createDataFrame(rows, "qid string, traj_idx long, note string, correct boolean").repartition(4), path, "qid", "traj_idx", width=width)
    files = sorted(p for p in (tmp_path / "nested").iterdir() if p.name.startswith("part-"))
    assert len([f for f in files if f.stat().st_size]) > 5 or width > 60
    text, got, read = "".join(f.read_text() for f in files), [], json.JSONDecoder()
    while text.strip():
        found, at = read.raw_decode(text)
        got.append(found)
        text = text[at:].lstrip()
    want = {}
    for qid, at, note, correct in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        want.setdefault(qid, []).append({"traj_idx": at, "note": note, "correct": correct})
    assert [(x["qid"], x["answers"]) for x in got] == list(want.items())
    back = tables.read_nested(spark, path, "qid", "traj_idx bigint, note string, correct boolean")
    assert sorted((tuple(r) for r in back.collect()), key=str) == sorted(rows, key=str)


def test_nested_file_of_narrow_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordered, "FEW", 1)
    rows = spark.range(5000).selectExpr("concat('q', id % 3) AS qid", "id AS n")
    tables.write_nested(rows, str(tmp_path / "nested"), "qid", "n", width=5)
    assert len(list((tmp_path / "nested").glob("part-*"))) <= 4  # the shuffle partitions of these tests
    back = tables.read_nested(spark, str(tmp_path / "nested"), "qid", "n bigint")
    assert back.count() == 5000 and back.exceptAll(rows).isEmpty()


def test_searches_are_shuffled_before_they_get_their_results(spark, tmp_path):
    words = [f"word{i} " * 300 + f"w{i}" for i in range(200)]
    spark.createDataFrame([*enumerate(words), (200, None), (201, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    made = sets_catalog.g6_merged_search(spark, str(tmp_path))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.index("Generate explode") < plan.index("Exchange ")
    got = {r["request"]: r["hits"].split(" ") for r in made.collect()}
    assert len(got[4]) == 3 * 301 and got[4][0] == "1.1=word4" and got[4][-1] == "3.301=w4" and set(range(200)) <= set(got)

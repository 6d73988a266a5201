"""Tool payload dumps (search, page, paper, PubMed) as rows and as display text."""

from __future__ import annotations

import ast
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybook import constants as K
from waybook.functions.strings import (
    contains_any,
    cut,
    is_array,
    is_json,
    is_object,
    let,
    parsed,
    strip,
)

NO_OUTPUT = "(no output)"
_ORGANIC = "array<struct<title:string,link:string,snippet:string,snippet_id:string>>"
_SEARCH = f"struct<searchParameters:struct<q:string>,organic:{_ORGANIC}>"
_PAGE = "struct<text:string,snippet_id:string,metadata:map<string,string>>"
_AUTHORS = "array<struct<name:string>>"
_PAPER = (
    "struct<title:string,year:string,citationCount:string,venue:string,"
    f"authors:{_AUTHORS},abstract:string,url:string,externalIds:map<string,string>,openAccessPdf:struct<url:string>>"
)
_SNIPPET = (
    "struct<snippet_id:string,title:string,text:string,section:string,snippet:string,year:string,paperId:string,"
    f"venue:string,authors:string,paper:struct<title:string,year:string,paperId:string,venue:string,authors:string>>"
)


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _line(condition: Column, line: Column) -> Column:
    """One display line, or none."""
    return F.when(F.coalesce(condition, F.lit(False)), F.array(line)).otherwise(_none("string"))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def first_names(names: Column, n: int) -> Column:
    """The first names, comma separated, with "et al." when more follow."""
    return F.concat(
        F.array_join(F.slice(names, 1, n), ", "), F.when(F.size(names) > n, F.lit(" et al.")).otherwise("")
    )


# ---- message content -----------------------------------------------------------


def content_text(v: Column, joint: str = "\n", typed: bool = True) -> Column:
    """Text of a message content that is a string or a list of parts.

    ``typed`` keeps only parts of type ``text`` and drops blank ones, as in a
    chat transcript; otherwise every part's text counts.
    """
    parts = F.transform(
        F.try_variant_get(v, "$", "array<variant>"),
        lambda p: F.struct(
            F.try_variant_get(p, "$.type", "string").alias("type"),
            F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")).alias("text"),
            is_object(p).alias("part"),
        ),
    )
    if typed:
        parts = F.filter(parts, lambda p: F.coalesce(p["type"] == "text", F.lit(False)) & (p["text"] != ""))
    else:
        parts = F.filter(parts, lambda p: p["part"])
    texts = F.array_join(F.transform(parts, lambda p: p["text"]), joint)
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", v.cast("string")).when(is_array(v), texts).otherwise("")


def _literal_text(text: str) -> str | None:
    try:
        value = ast.literal_eval(text)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None
    if isinstance(value, dict) and "text" in value:
        return NO_OUTPUT if value["text"] is None else str(value["text"])
    return None


@F.pandas_udf(T.StringType())
def _literal_text_udf(texts: pd.Series) -> pd.Series:
    return texts.map(_literal_text, na_action="ignore")


def environment_text(c: Column) -> Column:
    """Inner text of an environment message: Python dict text, JSON object or the message itself.

    Only messages that open a brace are handed to Python.
    """

    def inner(t: Column) -> Column:
        literal = _literal_text_udf(F.when(t.startswith("{"), t))
        from_json = F.when(t.startswith('{"') & is_json(t), F.get_json_object(t, "$.text"))
        return F.when(t == "", F.lit(NO_OUTPUT)).otherwise(F.coalesce(literal, from_json, t))

    # The Python function cannot sit inside a lambda, so the text is named twice here.
    return inner(strip(c))


def result_text(server: Column, tool: Column, error: Column, result: Column) -> Column:
    """What the model is shown for a finished call: error, nothing or the cut result."""
    named = F.concat(F.lit("Tool call to "), tool, F.lit(" on "), server)
    return (
        F.when(error.isNotNull(), F.concat(named, F.lit(" failed. Error: "), error))
        .when(result.isNull(), F.concat(named, F.lit(" completed, but produced no specific output or result.")))
        .otherwise(cut(result, K.SHOWN_RESULT_CHARS, "\n... [Result truncated]"))
    )


def code_outcome(output: Column) -> Column:
    """Outcome class of a code run, first rule that holds."""
    return (
        F.when(output.contains("timed out"), "timeout")
        .when(output.contains("Error") | output.contains("Traceback"), "error")
        .when(strip(output).isin("", NO_OUTPUT), "no_output")
        .otherwise("success")
    )


# ---- display text of foreign payloads ------------------------------------------


def search_text(raw: Column) -> Column:
    """Search payload as text; anything without results stays as it is."""

    def show(s: Column) -> Column:
        results = F.transform(
            s["organic"],
            lambda r, i: F.concat(
                F.array(
                    F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), _text(r["title"])),
                    F.concat(F.lit("    URL: "), _text(r["link"])),
                ),
                _line(
                    r["snippet"] != "",
                    F.concat(
                        F.lit("    Snippet"),
                        F.when(_text(r["snippet_id"]) != "", F.concat(F.lit(" ["), r["snippet_id"], F.lit("]"))).otherwise(""),
                        F.lit(": "),
                        r["snippet"],
                    ),
                ),
                F.array(F.lit("")),
            ),
        )
        head = F.array(F.concat(F.lit('Searched for "'), _text(s["searchParameters"]["q"]), F.lit('"')), F.lit(""))
        return F.when(F.size(s["organic"]) > 0, F.array_join(F.concat(head, F.flatten(results)), "\n"))

    known = F.when(is_json(raw), F.from_json(raw, _SEARCH))
    return F.coalesce(let(known, show), raw)


def page_text(raw: Column) -> Column:
    """Fetched page payload as text."""

    def show(p: Column) -> Column:
        url = _text(F.element_at(p["metadata"], "og:url"))
        lines = F.concat(
            _line(url != "", F.concat(F.lit("Page: "), url)),
            _line(p["snippet_id"] != "", F.concat(F.lit("["), p["snippet_id"], F.lit("]"))),
            _line(p["text"] != "", p["text"]),
        )
        return F.when(F.size(lines) > 0, F.array_join(lines, "\n"))

    known = F.when(is_json(raw), F.from_json(raw, _PAGE))
    return F.coalesce(let(known, show), raw)


def _snippet_text(snippet: Column) -> Column:
    """A snippet is an object with a text or the text itself."""
    as_object = F.get_json_object(snippet, "$.text")
    return F.when(is_json(snippet) & snippet.startswith("{"), _text(as_object)).otherwise(_text(snippet))


def paper_text(raw: Column) -> Column:
    """Paper snippet payload as text."""

    def show(d: Column) -> Column:
        results = F.transform(
            d["data"],
            lambda s, i: F.concat(
                F.array(
                    F.concat(
                        F.lit("["), (i + 1).cast("string"), F.lit("] "),
                        F.coalesce(s["paper"]["title"], s["title"], F.lit("")),
                    )
                ),
                _line(s["snippet_id"] != "", F.concat(F.lit("    ID: "), s["snippet_id"])),
                let(
                    _snippet_text(s["snippet"]),
                    lambda t: _line(t != "", F.concat(F.lit("    Snippet: "), cut(t, 800, "..."))),
                ),
                F.array(F.lit("")),
            ),
        )
        head = F.array(F.lit("Paper search results:"), F.lit(""))
        return F.when(F.size(d["data"]) > 0, F.array_join(F.concat(head, F.flatten(results)), "\n"))

    known = F.when(is_json(raw), F.from_json(raw, f"struct<data:array<{_SNIPPET}>>"))
    return F.coalesce(let(known, show), raw)


def response_text(tool: Column, raw: Column) -> Column:
    """Environment text (see ``environment_text``) laid out for the tool that produced it."""
    kept = raw.contains("Search Failure") | (raw == NO_OUTPUT)
    return (
        F.when(raw == "", F.lit(NO_OUTPUT))
        .when(kept, raw)
        .when(tool == "web_search", search_text(raw))
        .when(tool == "open_url", page_text(raw))
        .when(tool == "paper_search", paper_text(raw))
        .otherwise(raw)
    )


# ---- search records ------------------------------------------------------------


def search_hits(raw: Column, topn: int = 10, blocked: Sequence[str] = ()) -> Column:
    """``array<struct<id, url, title, snippet>>``: blocked links dropped, numbered after that, cut."""
    organic = F.from_json(raw, _SEARCH)["organic"]
    kept = F.filter(organic, lambda r: ~contains_any(_text(r["link"]), blocked))
    return F.transform(
        F.slice(kept, 1, topn),
        lambda r, i: F.struct(
            (i + 1).cast("int").alias("id"),
            _text(r["link"]).alias("url"),
            _text(r["title"]).alias("title"),
            _text(r["snippet"]).alias("snippet"),
        ),
    )


def search_lines(query: Column, hits: Column, plain: bool = True) -> Column:
    """Display lines of numbered hits in the plain or the marked-up layout."""

    def lines(h: Column) -> Column:
        n = h["id"].cast("string")
        if plain:
            shown = [
                F.concat(F.lit("["), n, F.lit("] "), h["title"]),
                F.concat(F.lit("    URL: "), h["url"]),
                F.concat(F.lit("    Snippet: "), h["snippet"]),
            ]
        else:
            shown = [
                F.concat(F.lit("【"), n, F.lit("†"), h["title"], F.lit("】")),
                F.concat(F.lit("URL: "), h["url"]),
                h["snippet"],
            ]
        return F.array(*shown, F.lit(""))

    head = F.array(F.concat(F.lit('Searched for "'), query, F.lit('"')), F.lit(""))
    return F.concat(head, F.flatten(F.transform(hits, lines)))


def page_view(lines: Column, cursor: Column, plain: bool = True) -> Column:
    """Lines as shown: bare, or numbered under the cursor."""
    if plain:
        return F.array_join(lines, "\n")
    numbered = F.transform(lines, lambda t, i: F.concat(F.lit("L"), (i + 1).cast("string"), F.lit(": "), t))
    return F.concat(F.lit("["), cursor.cast("string"), F.lit("]\n"), F.array_join(numbered, "\n"))


# ---- papers --------------------------------------------------------------------


def pdf_url(paper: Column) -> Column:
    """Open-access link, else one made from the arXiv or the ACL id."""

    def made(key: str, head: str, tail: str = "") -> Column:
        known = _text(F.element_at(paper["externalIds"], key))
        return F.when(known != "", F.concat(F.lit(head), known, F.lit(tail)))

    open_access = F.when(_text(paper["openAccessPdf"]["url"]) != "", paper["openAccessPdf"]["url"])
    # fixed values: link forms of the two archives
    return F.coalesce(
        open_access,
        made("ArXiv", "https://arxiv.org/pdf/"),
        made("ACL", "https://www.aclweb.org/anthology/", ".pdf"),
    )


def papers(raw: Column) -> Column:
    """Rows of a paper search dump."""
    data = F.from_json(raw, f"struct<data:array<{_PAPER}>>")["data"]
    return F.transform(
        data,
        lambda p, i: F.struct(
            (i + 1).cast("int").alias("rank"),
            F.coalesce(p["title"], F.lit("Untitled")).alias("title"),
            first_names(F.transform(p["authors"], lambda a: _text(a["name"])), 4).alias("authors"),
            _text(p["year"]).alias("year"),
            _text(p["venue"]).alias("venue"),
            F.coalesce(p["citationCount"], F.lit("0")).alias("citations"),
            _text(F.element_at(p["externalIds"], "DOI")).alias("doi"),
            _text(pdf_url(p)).alias("pdf"),
            _text(p["url"]).alias("url"),
            cut(_text(p["abstract"]), 500, "...").alias("abstract"),
        ),
    )


def snippets(raw: Column) -> Column:
    """Rows of a paper snippet dump; a snippet is an object or plain text."""
    data = F.from_json(raw, f"struct<data:array<{_SNIPPET}>>")["data"]

    def names(json: Column) -> Column:
        def of(v: Column) -> Column:
            return F.transform(
                F.try_variant_get(v, "$", "array<variant>"),
                lambda a: F.when(is_object(a), F.try_variant_get(a, "$.name", "string")).otherwise(a.cast("string")),
            )

        return let(parsed(json), of)

    def row(s: Column, i: Column) -> Column:
        boxed = is_json(s["snippet"]) & s["snippet"].startswith("{")
        section = F.when(boxed, F.get_json_object(s["snippet"], "$.section")).otherwise(s["section"])
        return F.struct(
            (i + 1).cast("int").alias("rank"),
            F.coalesce(s["paper"]["title"], s["title"], F.lit("")).alias("title"),
            _text(first_names(names(F.coalesce(s["paper"]["authors"], s["authors"])), 3)).alias("authors"),
            F.coalesce(s["paper"]["year"], s["year"], F.lit("")).alias("year"),
            F.coalesce(s["paper"]["venue"], s["venue"], F.lit("")).alias("venue"),
            F.coalesce(s["paper"]["paperId"], s["paperId"], F.lit("")).alias("paper_id"),
            _text(section).alias("section"),
            cut(F.when(s["snippet"].isNotNull(), _snippet_text(s["snippet"])).otherwise(_text(s["text"])), 800, "...").alias("snippet"),
        )

    return F.transform(data, row)


def _listing(head: Column, rows: Column, lines) -> Column:
    """Head, blank line, then each row's lines and a blank line."""
    body = F.flatten(F.transform(rows, lambda r: F.concat(lines(r), F.array(F.lit("")))))
    return F.array_join(F.concat(F.array(head, F.lit("")), body), "\n")


def _titled(n: Column, title: Column) -> Column:
    return F.array(F.concat(F.lit("["), n.cast("string"), F.lit("] "), title))


def _field(label: str, value: Column) -> Column:
    return _line(value != "", F.concat(F.lit(f"    {label}: "), value))


def _meta(*parts: Column) -> Column:
    """The non-empty parts between bars."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " | ")


def _labelled(label: str, value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit(f"{label}: "), value)).otherwise("")


def papers_text(query: Column, rows: Column) -> Column:
    """Rows of a paper search as display text."""

    def lines(p: Column) -> Column:
        meta = _meta(_labelled("Year", p["year"]), _labelled("Venue", p["venue"]), F.concat(F.lit("Citations: "), p["citations"]))
        return F.concat(
            _titled(p["rank"], p["title"]), _field("Authors", p["authors"]), F.array(F.concat(F.lit("    "), meta)),
            _field("DOI", p["doi"]), _field("PDF", p["pdf"]), _field("URL", p["url"]), _field("Abstract", p["abstract"]),
        )

    head = F.concat(F.lit('Paper search: "'), query, F.lit('"'))
    return F.when(F.size(rows) > 0, _listing(head, rows, lines)).otherwise(F.concat(F.lit("No papers found for: "), query))


def snippets_text(query: Column, rows: Column) -> Column:
    """Rows of a snippet search as display text."""

    def lines(s: Column) -> Column:
        meta = _meta(s["authors"], s["year"], s["venue"])
        # fixed value: page address of a paper id
        url = F.when(s["paper_id"] != "", F.concat(F.lit("https://www.semanticscholar.org/paper/"), s["paper_id"])).otherwise("")
        return F.concat(
            _titled(s["rank"], s["title"]), _line(meta != "", F.concat(F.lit("    "), meta)),
            _field("URL", url), _field("Section", s["section"]), _field("Snippet", s["snippet"]),
        )

    head = F.concat(F.lit('Paper snippet search: "'), query, F.lit('"'))
    return F.when(F.size(rows) > 0, _listing(head, rows, lines)).otherwise(F.concat(F.lit("No paper snippets found for: "), query))


def articles_text(query: Column, rows: Column) -> Column:
    """Article structs as display text."""
    ranked = F.transform(rows, lambda a, i: F.struct((i + 1).alias("rank"), a.alias("a")))

    def lines(r: Column) -> Column:
        a = r["a"]
        meta = _meta(_labelled("Year", a["year"]), a["journal"])
        # fixed value: page address of an article id
        url = F.when(a["pmid"] != "", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), a["pmid"], F.lit("/"))).otherwise("")
        return F.concat(
            _titled(r["rank"], a["title"]), _field("Authors", a["authors"]), _line(meta != "", F.concat(F.lit("    "), meta)),
            _field("URL", url), _field("Abstract", a["abstract"]),
        )

    return _listing(F.concat(F.lit('PubMed search: "'), query, F.lit('"')), ranked, lines)


# ---- PubMed --------------------------------------------------------------------


def articles(xml: Column) -> Column:
    """The article elements of a PubMed dump, in order."""
    return F.regexp_extract_all(xml, F.lit(r"(?s)<PubmedArticle\b.*?</PubmedArticle>"), 0)


def _joined(texts: Column) -> Column:
    """All text below an element: trimmed, blanks dropped, one space between."""
    return F.array_join(F.filter(F.transform(texts, strip), lambda t: t != ""), " ")


def _at(xml: Column, path: str) -> Column:
    return _text(F.get(F.xpath(xml, F.lit(path)), F.lit(0)))


def article(xml: Column) -> Column:
    """``struct`` of one PubMed article: labelled abstract parts, authors with both names."""
    parts = F.regexp_extract_all(xml, F.lit(r"(?s)<AbstractText\b(?:[^>]*/>|.*?</AbstractText>)"), 0)

    def part(e: Column) -> Column:
        label = _at(e, "/AbstractText/@Label")
        text = _joined(F.xpath(e, F.lit("/AbstractText//text()")))
        return F.when(label != "", F.concat(label, F.lit(": "), text)).otherwise(text)

    writers = F.regexp_extract_all(xml, F.lit(r"(?s)<Author\b.*?</Author>"), 0)
    full = F.transform(
        F.filter(writers, lambda e: e.contains("<LastName>") & e.contains("<ForeName>")),
        lambda e: F.concat(_at(e, "/Author/ForeName/text()"), F.lit(" "), _at(e, "/Author/LastName/text()")),
    )
    return F.struct(
        _at(xml, "//PMID/text()").alias("pmid"),
        _joined(F.xpath(xml, F.lit("(//Article//ArticleTitle)[1]//text()"))).alias("title"),
        cut(F.array_join(F.transform(parts, part), " "), 600, "...").alias("abstract"),
        first_names(full, 4).alias("authors"),
        _at(xml, "//Article//Journal/Title/text()").alias("journal"),
        _at(xml, "//Article//Journal/JournalIssue/PubDate/Year/text()").alias("year"),
    )

"""Web pages and text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybook import constants as K
from waybook.functions.strings import strip

WRAP = 200
# fixed values: matches shown of a page, characters kept of one
FIND_LIMIT = 20
OPENED_CHARS = 30_000


def html_text(html: Column, limit: int = K.SCRAPED_CHARS) -> Column:
    """Visible text: no scripts, styles and tags, single spaces; input cut at the limit."""
    c = F.left(html, F.lit(limit))
    for pattern, to in [
        (r"(?is)<script.*?>.*?</script>", ""),
        (r"(?is)<style.*?>.*?</style>", ""),
        (r"(?is)<[^>]+>", " "),
        (r"(?U)\s+", " "),
    ]:
        c = F.regexp_replace(c, pattern, to)
    return strip(c)


def wrapped_lines(text: Column, width: int = WRAP) -> Column:
    return F.ceil(F.length(text) / width)


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def numbered(df: DataFrame, text: str) -> DataFrame:
    """One row per line with its 1-based number; the text column is replaced by ``line``."""
    rest = [c for c in df.columns if c != text]
    lines = df.select(*rest, F.posexplode(split_lines(F.col(text))).alias("_at", "line"))
    return lines.select(*rest, (F.col("_at") + 1).alias("line_no"), "line")


def view(text: Column, loc: Column, num_lines: Column, default_lines: int = 50) -> Column:
    """Lines ``[loc, loc + n)`` of a page as an array; bad values fall back to the start and the default."""
    start = F.when(loc > 0, loc).otherwise(1)
    n = F.when(num_lines > 0, num_lines).otherwise(default_lines)
    return F.slice(split_lines(text), start.cast("int"), n.cast("int"))


def view_text(text: Column, loc: Column, num_lines: Column, default_lines: int = 50) -> Column:
    """The same lines numbered from their place in the page."""
    start = F.when(loc > 0, loc).otherwise(1)
    lines = F.transform(
        view(text, loc, num_lines, default_lines),
        lambda t, i: F.concat(F.lit("L"), (start + i).cast("string"), F.lit(": "), t),
    )
    return F.array_join(lines, "\n")


def opened_text(
    url: Column, text: Column, loc: Column, num_lines: Column, cursor: Column | None = None, limit: int | None = OPENED_CHARS
) -> Column:
    """What a model is shown of an opened page: all lines from ``loc`` on unless it asks for fewer.

    With a cursor the lines are numbered below it, without one they stand below
    the page's address. Texts are cut at ``limit`` characters before; null keeps them whole.
    """
    whole = text if limit is None else F.left(text, F.lit(limit))
    start = F.when(loc > 0, loc).otherwise(1)
    rest = F.greatest(F.size(split_lines(whole)), F.lit(1))
    shown = F.slice(split_lines(whole), start.cast("int"), F.when(num_lines > 0, num_lines).otherwise(rest).cast("int"))
    if cursor is None:
        head = F.when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit("Page: "), url, F.lit("\n"))).otherwise("")
        return F.concat(head, F.array_join(shown, "\n"))
    numbered_lines = F.transform(shown, lambda t, i: F.concat(F.lit("L"), (start + i).cast("string"), F.lit(": "), t))
    return F.concat(F.lit("["), cursor.cast("string"), F.lit("]\n"), F.array_join(numbered_lines, "\n"))


def found_text(pattern: Column, found: Column, cursor: Column, plain: bool = False) -> Column:
    """What a model is shown of ``find``: the number of lines, the first of them, how many more."""
    place = F.concat(F.lit(" in ["), cursor.cast("string"), F.lit("]"))
    quoted = F.concat(F.lit('"'), pattern, F.lit('"'))
    head = F.concat(F.lit("Found "), found["total"].cast("string"), F.lit(" match(es) for "), quoted, F.lit("") if plain else place, F.lit(":"))
    line = lambda e: e["line"] if plain else F.concat(F.lit("L"), e["line_no"].cast("string"), F.lit(": "), e["line"])
    more = F.concat(F.lit("... and "), found["more"].cast("string"), F.lit(" more matches"))
    tail = F.when(found["more"] > 0, F.array(more)).otherwise(F.array().cast("array<string>"))
    some = F.array_join(F.concat(F.array(head), F.transform(found["shown"], line), tail), "\n")
    return F.when(found["total"] > 0, some).otherwise(F.concat(F.lit("No matches for "), quoted, place, F.lit(".")))


def find(text: Column, pattern: Column, limit: int | None = FIND_LIMIT) -> Column:
    """``struct(total, shown array<struct<line_no, line>>, more)``: lines holding the pattern, any case.

    Works inside the row: a page's lines never leave it. No limit shows all.
    """
    numbered_lines = F.transform(
        split_lines(text), lambda t, i: F.struct((i + 1).cast("int").alias("line_no"), t.alias("line"))
    )
    hits = F.filter(numbered_lines, lambda e: F.lower(e["line"]).contains(F.lower(pattern)))
    total = F.size(hits)
    return F.struct(
        total.alias("total"),
        (hits if limit is None else F.slice(hits, 1, limit)).alias("shown"),
        (F.lit(0) if limit is None else F.greatest(total - limit, F.lit(0))).alias("more"),
    )

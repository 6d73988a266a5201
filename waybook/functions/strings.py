"""Small text columns shared by the parsers.

Spark's ``trim`` strips blanks only and Java's ``\\s`` is ASCII, so ``strip``
names its characters and the patterns ask for Unicode classes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: the characters Unicode counts as white space, with the ASCII separators 1C-1F
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for a body that names it several times.

    Nesting columns copies their expression; a chain of repairs would grow
    exponentially. A one-element ``transform`` evaluates the value once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def cut(c: Column, n: int, suffix: str = "") -> Column:
    """First ``n`` characters, with a suffix only when something was cut."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(suffix))).otherwise(c)


def contains_any(c: Column, parts: Sequence[str]) -> Column:
    if not parts:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def found_in(c: Column, parts: Sequence[str]) -> Column:
    """The listed parts that occur in the text, in list order."""
    return F.filter(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(c, p))


def after(c: Column, mark: str) -> Column:
    """Text behind the first mark; the caller has checked that it is there."""
    return F.substring(c, F.locate(mark, c) + len(mark), F.length(c))


def before(c: Column, mark: str) -> Column:
    return F.substring_index(c, mark, 1)


def escape_markup(c: Column) -> Column:
    # fixed values: the five HTML entities, ampersand first
    for raw, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]:
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def without_ansi(c: Column) -> Column:
    return F.regexp_replace(c, r"\x1b\[[0-9;]*m", "")


def safe_int(c: Column, default: int | None = None) -> Column:
    """Integer of a text argument, else the default (``'3.5'`` is not one)."""
    return F.coalesce(c.try_cast("bigint"), F.lit(default).cast("bigint"))


def tokens_at_least_one(c: Column) -> Column:
    """Four characters per token; null counts 0, anything else at least 1."""
    return F.when(c.isNull(), F.lit(0)).otherwise(F.greatest(F.lit(1), quarter(c)))


def quarter(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("int")


def loose(c: Column) -> Column:
    """Trimmed, lower case, no commas and no blanks."""
    return F.replace(F.replace(F.lower(strip(c)), F.lit(","), F.lit("")), F.lit(" "), F.lit(""))


def json_text(c: Column) -> Column:
    """A string as a quoted JSON string."""
    return let(F.to_json(F.array(c)), lambda j: F.substring(j, F.lit(2), F.length(j) - 2))


_STRICT = {"allowSingleQuotes": "false"}


def _as_item(c: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))


def _as_value(c: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))


def is_json(c: Column) -> Column:
    """Whether the whole text is one JSON value; repeated keys, ``NaN`` and any length are allowed.

    The parser ignores whatever follows the first value. Only a single value
    parses both as the sole array item and as the value of an object.
    """
    item = F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>", _STRICT)
    value = F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), "v string", _STRICT)["v"]
    return F.coalesce((F.size(item) == 1) & (value.isNotNull() | (strip(c) == "null")), F.lit(False))


def parsed(c: Column) -> Column:
    """The text as VARIANT, null unless all of it is JSON."""
    return F.when(_as_value(c).isNotNull(), F.try_variant_get(_as_item(c), "$[0]", "variant"))


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def is_array(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def json_or_text(c: Column) -> Column:
    """JSON as it stands, anything else as a quoted JSON string."""
    return F.when(is_json(c), c).otherwise(json_text(c))


def fill(template: str, **columns: Column) -> Column:
    """Put columns into ``{name}`` slots; text in a column is never a slot."""
    import re

    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[columns[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)])

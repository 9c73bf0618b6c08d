"""Text helpers that follow Unicode whitespace and plain line feeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim(c: Column) -> Column:
    """Strip Unicode whitespace on both sides (Spark's ``trim`` strips spaces only)."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """The same as :func:`trim` without a regular expression, for many short values."""
    return F.btrim(c, F.lit(_WHITE))


def is_blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)\S")


def unix_text(c: Column) -> Column:
    """CRLF to LF and one final line feed dropped: the text as a line reader sees it."""
    return F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), r"\n\z", "")


def lines(c: Column) -> Column:
    """Lines of a text, without their line ends; an empty text has none."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(
        F.split(unix_text(c), "\n")
    )


def line_count(c: Column) -> Column:
    """Lines of a text that already went through :func:`unix_text`."""
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1


def first(c: Column) -> Column:
    """First element of an array, null when it is empty."""
    return F.try_element_at(c, F.lit(1))


def h1(c: Column) -> Column:
    """Text of the first line that, trimmed, starts with ``# ``."""
    heads = F.filter(
        F.transform(F.split(c, "\n"), trim), lambda line: line.startswith("# ")
    )
    return trim(F.regexp_replace(first(heads), r"\A(# )+", ""))

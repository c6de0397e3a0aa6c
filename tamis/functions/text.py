"""Small text expressions used everywhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode White_Space characters.
WS_CHARS = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same as a regex class; the flag makes the class cover them all.
UNICODE = "(?U)"
WS = "\\s"


def trim_ws(col: Column) -> Column:
    """Trim every kind of Unicode white space (Spark's trim only drops blanks)."""
    return F.btrim(col, F.lit(WS_CHARS))


def trim_start_ws(col: Column) -> Column:
    return F.ltrim(col, F.lit(WS_CHARS))


def lines(text: Column) -> Column:
    """Split into lines: a final newline opens no line, one trailing CR is dropped."""
    ends = F.endswith(text, F.lit("\n")) | (F.length(text) == 0)
    parts = F.split(text, "\n", -1)
    parts = F.when(ends, let(parts, lambda p: F.slice(p, 1, F.size(p) - 1))).otherwise(parts)
    return F.when(
        F.contains(text, F.lit("\r")),
        F.transform(parts, lambda l: F.regexp_replace(l, "\r$", "")),
    ).otherwise(parts)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_on(text: Column, regex: str) -> Column:
    """All parts of the text between the matches of a regex, none of which is
    empty. ``split`` compiles a regex of more than a letter for every text;
    what replaces matches keeps it. So these become one letter first, unless
    the text has that."""
    letter = "\ufdd1"

    def parts(t: Column) -> Column:
        marked = F.split(F.regexp_replace(t, regex, letter), letter, -1)
        return F.when(F.contains(t, F.lit(letter)), F.split(t, regex, -1)).otherwise(marked)

    return let(text, parts)


def running_sum(values: Column, step: int = 256) -> Column:
    """Sums of all prefixes of an array of ints. In parts, so that a long array
    is not copied for every element."""
    none = F.array().cast("array<int>")

    def within(part: Column, start: Column) -> Column:
        state = F.struct(start.alias("total"), none.alias("seen"))

        def add(s: Column, v: Column) -> Column:
            total = (s["total"] + v).cast("int")
            return F.struct(total.alias("total"), F.array_append(s["seen"], total).alias("seen"))

        return F.aggregate(part, state, add, lambda s: s["seen"])

    def next_part(s: Column, i: Column) -> Column:
        part = within(F.slice(values, i * step + 1, step), s["total"])
        return let(part, lambda p: F.struct(F.element_at(p, -1).alias("total"), F.array_append(s["seen"], p).alias("seen")))

    parts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / step).cast("int"))
    state = F.struct(F.lit(0).alias("total"), F.array().cast("array<array<int>>").alias("seen"))
    sums = F.aggregate(parts, state, next_part, lambda s: F.flatten(s["seen"]))
    return F.when(F.size(values) > 0, sums).otherwise(none)


def xml_escape(col: Column) -> Column:
    for raw, safe in (
        ("&", "&amp;"),
        ("<", "&lt;"),
        (">", "&gt;"),
        ('"', "&quot;"),
        ("'", "&apos;"),
    ):
        col = F.replace(col, F.lit(raw), F.lit(safe))
    return col


def basename(path: Column) -> Column:
    return F.substring_index(F.substring_index(path, "/", -1), "\\", -1)

"""String and list expressions. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spaces, tabs and line ends.
EDGE = " \t\r\n"


def trim_edges(c: Column) -> Column:
    """`c` without spaces, tabs and line ends at either end; inner ones stay. Null stays null."""
    return F.btrim(c, F.lit(EDGE))


def strip_ws(c: Column) -> Column:
    """`c` without white space of any kind (also non-breaking) at either end. Null stays null."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return c.isNull() | c.rlike(r"(?U)^\s*$")


def null_if_blank(c: Column) -> Column:
    """The stripped text, or null where nothing is left."""
    s = strip_ws(c)
    return F.when(s != "", s)


def split_list(c: Column, sep: str = ";") -> Column:
    """The stripped non-empty parts of a separated list; an empty array for null."""
    parts = F.transform(F.split(c, F.lit("\\Q" + sep + "\\E")), strip_ws)
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def clean_array(c: Column) -> Column:
    """Array elements stripped, without null and empty ones; an empty array for null."""
    return F.coalesce(F.filter(F.transform(c, strip_ws), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def join_sorted(c: Column, sep: str = ";") -> Column:
    """The array as sorted text, for comparisons that don't depend on order."""
    return F.array_join(F.array_sort(c), sep)


def ci_equal(c: Column, term: str) -> Column:
    """Equality without regard to letter case; null for null."""
    return F.lower(c) == F.lit(term.lower())


def ci_contains(c: Column, term: str) -> Column:
    """Substring test without regard to letter case; an empty term is contained in any text."""
    return F.contains(F.lower(c), F.lit(term.lower()))


def any_ci_equal(c: Column, term: str) -> Column:
    """Whether an element of the array equals the term without regard to case; false for a null array."""
    return F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(x) == F.lit(term.lower()))


def any_ci_contains(c: Column, term: str) -> Column:
    """Whether an element contains the term; three-valued: null for a null array, or for no hit among nulls."""
    return F.exists(c, lambda x: F.contains(F.lower(x), F.lit(term.lower())))

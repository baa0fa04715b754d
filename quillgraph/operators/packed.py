r"""Several values packed in one field: a parsing expression grammar, compiled to one pattern.

    field   <- wrapped / list
    wrapped <- '[' list ']' / '{' list '}'
    list    <- (item / delimiter)*
    item    <- space (quoted / nested) space &(delimiter / end) / bare
    quoted  <- '"' ('""' / !'"' .)* '"' / "'" ("''" / !"'" .)* "'"
    nested  <- '[' inside ']' / '{' inside '}'
    inside  <- (opening quoted closing / nested / !bracket .)*
    bare    <- (!delimiter .)+

An opening is the place after a bracket or delimiter, a closing that before one. Nested items are one value each,
whatever they hold; brackets are read to the depth of DEPTH. Alternatives are ordered and tried once, which atomic
groups and possessive repetition express in the pattern language of the JVM. A quote or bracket that doesn't close
fails its alternative; the parser goes back and takes the text up to the next delimiter as bare, which is flagged. What
an item was taken as is told by the patterns of the same alternatives. Everything runs in the JVM, row by row,
without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates values in the packed files; the wide semicolon is U+FF1B.
DELIMITERS = ";；|,\t\r\n"
#: Brackets within brackets that are read.
DEPTH = 4

_DOUBLE, _SINGLE = r'"((?>""|[^"])*+)"', r"'((?>''|[^'])*+)'"
UNBALANCED_QUOTE, UNBALANCED_BRACKET, TOO_DEEP = "unbalanced_quote", "unbalanced_bracket", "nested_too_deep"


@dataclass(frozen=True)
class Grammar:
    """delimiters: characters that end a bare value. spaces: whether white space delimits too."""

    delimiters: str = DELIMITERS
    spaces: bool = False

    @property
    def _ends(self) -> str:
        return "".join(f"\\u{ord(c):04x}" for c in self.delimiters) + (r"\s" if self.spaces else "")

    def _nested(self, depth: int = DEPTH) -> tuple[str, str]:
        """(nested, inside): the pattern of brackets with what they hold, and of what they hold."""
        end = self._ends
        quoted = rf"""(?<=[\[{{{end}]\s{{0,9}})(?>"(?>""|[^"])*+"|'(?>''|[^'])*+')(?=\s*+(?:[\]}}{end}]|$))"""
        inside = rf"(?>{quoted}|[^\[\]{{}}])*+"
        for _ in range(depth - 1):
            inside = rf"(?>{quoted}|\[{inside}\]|\{{{inside}\}}|[^\[\]{{}}])*+"
        return rf"(?>\[{inside}\]|\{{{inside}\}})", inside

    def item(self) -> str:
        """The pattern of one item."""
        end, space = self._ends, r"\s*+"
        after = rf"[\s&&[^{end}]]*+"
        return rf"(?Us)(?>{space}(?:{_DOUBLE}|{_SINGLE}|{self._nested()[0]}){after}(?=[{end}]|$)|([^{end}]+))"

    def nested(self) -> str:
        """The pattern of an item that is brackets as a whole."""
        return rf"(?Us)^{self._nested()[0]}$"

    def list(self) -> str:
        """The pattern of a wrapped list, group 1 or 2: brackets or braces around all of it, balanced inside."""
        inside = self._nested(DEPTH + 1)[1]
        return rf"(?Us)^\s*+(?>\[({inside})\]|\{{({inside})\}})\s*+$"


def parse(field: Column, grammar: Grammar) -> Column:
    """array<struct<value, error>> of the field's values in order; empty slots take no place; null for null.

    error is null for quoted, nested and plain bare values. Of bare ones it is unbalanced_quote (a quote opens or a
    double one closes the text), unbalanced_bracket (openings and closings differ in number), or nested_too_deep; the
    value then is the text as it stands.
    """
    whole = grammar.list()
    bracketed = F.contains(field, F.lit("[")) | F.contains(field, F.lit("{"))
    text = F.when(bracketed & field.rlike(whole), F.concat(F.regexp_extract(field, whole, 1), F.regexp_extract(field, whole, 2))).otherwise(field)
    raw = F.regexp_extract_all(text, F.lit(grammar.item()), F.lit(0))

    def strip(c: Column) -> Column:
        return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")

    def inner(c: Column) -> Column:
        return F.substring(c, F.lit(2), F.length(c) - 2)

    opens = lambda c: c.startswith("[") | c.startswith("{")
    is_nested = lambda c: opens(c) & c.rlike(grammar.nested())
    is_double, is_single = (lambda c: c.rlike(rf"(?s)^{_DOUBLE}$")), (lambda c: c.rlike(rf"(?s)^{_SINGLE}$"))

    def unwrapped(c: Column) -> Column:
        """Without the brackets around all of it, level by level."""
        levels = F.array(*[F.lit(0)] * DEPTH)
        return F.when(opens(c), F.aggregate(levels, c, lambda x, _: F.when(is_nested(x), strip(inner(x))).otherwise(x))).otherwise(c)

    def unquoted(c: Column) -> Column:
        return F.when(is_double(c), F.replace(inner(c), F.lit('""'), F.lit('"'))).when(is_single(c), F.replace(inner(c), F.lit("''"), F.lit("'"))).otherwise(c)

    def unbalanced(c: Column) -> Column:
        count = lambda x: F.length(c) - F.length(F.replace(c, F.lit(x)))
        return (count("[") != count("]")) | (count("{") != count("}"))

    def error(c: Column) -> Column:
        bare = ~(is_double(c) | is_single(c) | is_nested(c))
        return F.when(bare & c.rlike(r"""^["']|"$"""), UNBALANCED_QUOTE).when(bare & unbalanced(c), UNBALANCED_BRACKET).when(bare & opens(c) & c.rlike(r"[\]}]$") & (F.length(F.regexp_replace(c, r"[^\[{]", "")) > DEPTH), TOO_DEEP)

    # An item without a mark was taken as bare: it is its own value. The marks of others tell how they were taken.
    marked = lambda c: c.rlike(r"""["'\[\]{}]""")
    of = lambda value, error: F.struct(value.alias("value"), error.cast("string").alias("error"))
    items = F.transform(F.transform(raw, strip), lambda c: F.when(marked(c), of(strip(unquoted(unwrapped(c))), error(c))).otherwise(of(c, F.lit(None))))
    return F.filter(items, lambda x: x["value"] != "")


def unpack(df: DataFrame, field: str, grammar: Grammar, keep: list[str]) -> DataFrame:
    """One row per value of `field`: the columns `keep`, pos (from 1), item_value and parse_error.

    Null, blank and only-delimiter fields give no row; repeated values are kept; of very long fields every value.
    """
    at = F.posexplode(parse(F.col(field), grammar)).alias("_pos", "_item")
    got = df.select(*keep, at)
    return got.select(*keep, (F.col("_pos") + 1).cast("bigint").alias("pos"), F.col("_item.value").alias("item_value"), F.col("_item.error").alias("parse_error"))

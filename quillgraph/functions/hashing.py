"""Content hashes of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stable_hash(pairs: dict[str, Column]) -> Column:
    """SHA-256 of a row as text with sorted names; null and the text 'null' differ, and the order of `pairs` doesn't count."""
    parts = [F.concat(F.lit(k + "="), F.coalesce(F.concat(F.lit("'"), F.replace(v.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("null"))) for k, v in sorted(pairs.items())]
    return F.sha2(F.concat_ws(",", *parts), 256)


def cache_key(operation: str, pairs: dict[str, Column]) -> Column:
    return F.concat(F.lit(operation + ":"), stable_hash(pairs))


def row_hash(df: DataFrame, *columns: str) -> Column:
    """`stable_hash` of the columns as their types ask for: decimals count to the tenth digit, lists of records in any order, other lists in theirs."""
    kinds = dict(df.dtypes)

    def text(c: str) -> Column:
        if kinds[c] in ("double", "float"):
            return F.format_string("%.10f", F.round(F.col(c).cast("double"), 10))
        if kinds[c].startswith("array<struct"):
            return F.to_json(F.array_sort(c))
        if kinds[c].startswith("map"):
            return F.to_json(F.array_sort(F.map_entries(c)))
        return F.to_json(c) if kinds[c].startswith(("array", "struct")) else F.col(c).cast("string")

    return stable_hash({c: text(c) for c in columns})

"""Predicates of graph questions: genes and therapies by name or synonym, diseases by words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.text import any_ci_equal, ci_contains, ci_equal

#: Rows a question may give, and gives if it doesn't say (fixed values).
MOST, DEFAULT = 200, 100


def gene_matches(term: str, symbol: str = "gene_symbol", synonyms: str = "gene_synonyms") -> Column:
    """The gene's symbol or one of its synonyms, without regard to case."""
    return ci_equal(F.col(symbol), term) | any_ci_equal(F.col(synonyms), term)


def therapy_matches(term: str, name: str = "therapy_name", synonyms: str = "therapy_synonyms") -> Column:
    """The therapy's name or a synonym, or a name that contains the term."""
    return ci_equal(F.col(name), term) | any_ci_equal(F.col(synonyms), term) | ci_contains(F.col(name), term)


def disease_tokens(disease: str) -> list[str]:
    """The words to look for; of two or more words, `cancer` says too little and is left out."""
    words = disease.lower().split()
    return [w for w in words if w != "cancer"] if len(words) > 1 and "cancer" in words else words


def disease_matches(disease: str, column: str = "disease_name", lowered: bool = False) -> Column:
    """Every word of the disease is contained in the name; an empty disease matches any that is not null.

    lowered: the column is in lower case, so that the tests reach the scan.
    """
    test = (lambda w: F.contains(F.col(column), F.lit(w))) if lowered else (lambda w: ci_contains(F.col(column), w))
    return reduce(lambda a, b: a & b, map(test, disease_tokens(disease)), F.col(column).isNotNull())


def fusion_matches(column: str, a: str, b: str) -> Column:
    """A fusion of both genes in either order."""
    return ci_contains(F.col(column), f"{a}::{b}") | ci_contains(F.col(column), f"{b}::{a}")


def variant_matches(token: str, name: str = "variant_name", synonyms: str = "variant_synonyms") -> Column:
    """The name contains the token, or a synonym is the token, without regard to case; never just the name itself."""
    return ci_contains(F.col(name), token) | any_ci_equal(F.col(synonyms), token)


def limit_rows(asked: int | None) -> int:
    """The rows to give: at most MOST, DEFAULT if nothing is asked for. A negative number is an error."""
    if asked is not None and asked < 0:
        raise ValueError(f"a limit can't be negative: {asked}")
    return min(asked or DEFAULT, MOST)

"""Over-representation of gene sets in a gene list, with control of the false discovery rate."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import cut, seen

#: Bands of p values, an eighth of a power of ten wide; smaller ones share the last.
BANDS = 2400


def normalise_genes(names: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid): symbols that the names stand for, and names that stand for none.

    names: name. aliases: alias (lower case), symbol. Names are stripped, compared without regard to case, and counted once;
    one alias may give several symbols. Null and blank names are neither.
    """
    asked = names.select(F.upper(F.btrim("name")).alias("name")).filter(F.col("name") != "").distinct()
    keyed = asked.withColumn("alias", F.lower("name"))
    valid = keyed.join(aliases, "alias").select("symbol").distinct()
    return valid, keyed.join(aliases.select("alias").distinct(), "alias", "left_anti").select("name")


def log_choose(n: Column, k: Column, table: Column) -> Column:
    """log of n choose k from an array of log factorials, whose i-th element (from 0) is log i!."""
    at = lambda i: F.element_at(table, (i + 1).cast("int"))
    return at(n) - at(k) - at(n - k)


def enrichment(genes: DataFrame, sets: DataFrame, universe: int) -> DataFrame:
    """Hypergeometric upper tail of each set's overlap with the list: library, term, gene_count, set_size, p_value, odds_ratio, genes, adjusted_p_value.

    genes: gene, counted once. sets: library, term, gene, counted once. universe: number of genes there are. Sets without
    an overlap give no row and count in the adjustment for as many tests as there are rows of the library. The list is a
    user's gene list, at most as long as the universe; log factorials go up to the universe.
    """
    genes = cut(genes.select("gene").filter(F.col("gene").isNotNull()).distinct())  # read twice below
    sets = sets.select("library", "term", "gene").distinct()
    n = genes.count()
    hits = sets.join(genes.withColumn("_in", F.lit(1)), "gene", "left")
    got = hits.groupBy("library", "term").agg(F.count(F.lit(1)).alias("set_size"), F.count("_in").alias("gene_count"), F.array_sort(F.collect_list(F.when(F.col("_in") == 1, F.col("gene")))).alias("genes"))
    got = got.filter(F.col("gene_count") > 0)
    values = list(accumulate((math.log(i) for i in range(1, universe + 1)), initial=0.0))
    factorials = genes.sparkSession.createDataFrame([(values,)], "_f array<double>")
    m, k, x = F.lit(universe), F.col("set_size"), F.col("gene_count")
    got = got.join(F.broadcast(factorials), how="cross")  # one row: the factorials
    f = F.col("_f")
    tail = F.aggregate(F.sequence(x, F.least(k, F.lit(n))), F.lit(0.0), lambda a, i: a + F.when((F.lit(n) - i) <= (m - k), F.exp(log_choose(k, i, f) + log_choose(m - k, F.lit(n) - i, f) - log_choose(m, F.lit(n), f))).otherwise(0.0))
    a, b, c = x, F.lit(n) - x, k - x
    d = m - k - b
    odds = F.when((b > 0) & (c > 0), (a * d) / (b * c).cast("double"))
    got = got.select("library", "term", "gene_count", "set_size", F.least(tail, F.lit(1.0)).alias("p_value"), odds.alias("odds_ratio"), "genes")
    return adjust(got)


def adjust(rows: DataFrame) -> DataFrame:
    """Benjamini-Hochberg within each library: the least p * tests / rank from the rank on, at most 1.

    Ranks and minima are taken within bands of similar p values, and carried over the bands of a library, of which
    there are BANDS at most: so no task sorts a whole library.
    """
    band = F.least(F.floor(-F.log10(F.greatest("p_value", F.lit(1e-300))) * 8), F.lit(BANDS)).cast("int")
    rows = rows.withColumn("_b", -band)  # bands in the order of p values
    inside = Window.partitionBy("library", "_b").orderBy("p_value", "term")
    counts = rows.groupBy("library", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("library").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("library", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("library")).alias("_m"))
    ranked = rows.withColumn("_r", F.row_number().over(inside)).join(counts, ["library", "_b"]).withColumn("_q", F.col("p_value") * F.col("_m") / (F.col("_before") + F.col("_r")))
    after = Window.partitionBy("library").orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    later = ranked.groupBy("library", "_b").agg(F.min("_q").alias("_least")).select("library", "_b", F.min("_least").over(after).alias("_later"))
    tail = Window.partitionBy("library", "_b").orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    q = F.least(F.lit(1.0), F.min("_q").over(tail), "_later")
    return ranked.join(later, ["library", "_b"]).withColumn("adjusted_p_value", q).drop("_b", "_r", "_before", "_m", "_q", "_later")


def significant(rows: DataFrame, level: float = 0.05, n: int = 15) -> DataFrame:
    """The first n of the rows below the level, by adjusted p value, library and term."""
    return rows.filter(F.col("adjusted_p_value") < level).orderBy("adjusted_p_value", "library", "term").limit(n)


def told(rows: DataFrame, n: int = 10, genes: int = 5) -> DataFrame:
    """What a summary is told: the first n terms, each with its first genes."""
    return rows.orderBy("adjusted_p_value", "library", "term").limit(n).withColumn("genes", F.slice("genes", 1, genes))


def gene_list(text: str) -> list[str]:
    """The names of a list that is separated by commas or lines, stripped; blank ones are left out."""
    return [name for part in text.splitlines() for x in part.split(",") if (name := x.strip())]


def libraries_of(sets: DataFrame, asked: Sequence[str] | None, known: Sequence[str]) -> DataFrame:
    """The gene sets of the libraries asked for, or of all known ones. A library that isn't known is an error."""
    if bad := [x for x in asked or () if x not in known]:
        raise ValueError(f"unknown libraries: {', '.join(bad)}")
    return sets.filter(F.col("library").isin(list(asked or known)))


def warnings(n_valid: int, invalid: Sequence[str], most: int = 10) -> list[str]:
    """What people are told of names that weren't found."""
    out = []
    if invalid:
        more = f" and {len(invalid) - most} more" if len(invalid) > most else ""
        out.append(f"{len(invalid)} names were not recognised: {', '.join(invalid[:most])}{more}")
    if not n_valid:
        out.append("no valid gene is left")
    return out


@dataclass(frozen=True)
class Analysis:
    """What a gene list gives: its valid and unknown names, the best terms, points to plot, and warnings."""

    valid: DataFrame
    invalid: DataFrame
    terms: DataFrame
    points: DataFrame
    warnings: list[str]


def analyze(names: DataFrame, aliases: DataFrame, sets: DataFrame, universe: int, level: float = 0.05, n: int = 15) -> Analysis:
    """Normalise a list of names, test it against the sets, and keep the best terms. A list without valid genes has no terms."""
    valid, invalid = normalise_genes(names, aliases)
    valid = cut(valid, n=F.count(F.lit(1)))
    terms = cut(significant(enrichment(valid.withColumnRenamed("symbol", "gene"), sets, universe), level, n))
    unknown = [r["name"] for r in invalid.orderBy("name").collect()]  # of a list that a person gave
    return Analysis(valid, invalid, terms, plot_points(terms), warnings(seen(valid, "n"), unknown))


def plot_points(rows: DataFrame) -> DataFrame:
    """Per library: terms with -log10 of the adjusted p value (1e-300 at least) and counts, best first."""
    y = -F.log10(F.greatest("adjusted_p_value", F.lit(1e-300)))
    return rows.groupBy("library").agg(F.array_sort(F.collect_list(F.struct(F.col("adjusted_p_value").alias("q"), "term", y.alias("score"), "gene_count"))).alias("points"))

"""Parameters for questions, mined from the graph so that most questions have an answer.

Each strategy gives rows of placeholders. Those that pair few things are sampled in stable pseudo-random order; those
whose pairs grow with the square of their entities give the first MOST in order, and take only so much of their input
as these need. Pairs of genes come once, also where several therapies link them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.graph import Graph
from quillgraph.operators.dataset import stable_order

#: Rows that a strategy gives (fixed value), and entities that are sampled where nothing relates them.
MOST, FEW = 200, 20


def _sampled(df: DataFrame, n: int = MOST, seed: int = 42) -> DataFrame:
    return df.distinct().orderBy(stable_order(F.concat_ws("|", *df.columns), seed), *df.columns).limit(n)


def _first(df: DataFrame, n: int = MOST) -> DataFrame:
    return df.distinct().orderBy(*df.columns).limit(n)


def curated_first(df: DataFrame, key: str, curated: tuple[str, ...], n: int = FEW, seed: int = 42) -> DataFrame:
    """(key, pos): the curated values that there are, in their order, then others in stable pseudo-random order, n in all."""
    rank = F.array_position(F.array(*[F.lit(c) for c in curated]).cast("array<string>"), F.col(key))
    ranked = df.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_r", F.when(rank > 0, rank).otherwise(len(curated) + 1))
    few = ranked.orderBy("_r", stable_order(F.col(key), seed), key).limit(max(n, len(curated))).filter((F.col("_r") <= len(curated)) | F.lit(n > 0))
    few = few.withColumn("pos", F.row_number().over(Window.orderBy("_r", stable_order(F.col(key), seed), key)))  # n rows
    return few.filter((F.col("pos") <= n) | (F.col("_r") <= len(curated))).select(key, "pos")


def product(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """All pairs of two samples, of `b` at most MOST: for placeholders that nothing relates."""
    values = [r[0] for r in b.select(key_b).limit(MOST).collect()]
    return a.select(key_a, F.explode(F.array(*[F.lit(v) for v in values]).cast("array<string>")).alias(key_b))


def affects_pairs(g: Graph, effect: str | None = None) -> DataFrame:
    """(therapy_name, disease_name) of evidence, once each."""
    rows = g.affects if effect is None else g.affects.filter(F.lower("effect") == effect)
    return rows.select("therapy_name", "disease_name").distinct()


def variant_triples(g: Graph, effect: str | None = None) -> DataFrame:
    """(variant_name, therapy_name, disease_name) of evidence on variants, once each."""
    rows = g.affects.filter(F.col("biomarker_type") == "Variant")
    rows = rows if effect is None else rows.filter(F.lower("effect") == effect)
    return rows.select(F.col("biomarker_name").alias("variant_name"), "therapy_name", "disease_name").distinct()


def diseases_of_therapies(g: Graph, effect: str | None = None) -> DataFrame:
    """(therapy_name, diseases): sorted, once each."""
    return affects_pairs(g, effect).groupBy("therapy_name").agg(F.array_sort(F.collect_set("disease_name")).alias("diseases"))


def therapies_of_diseases(g: Graph, effect: str | None = None) -> DataFrame:
    return affects_pairs(g, effect).groupBy("disease_name").agg(F.array_sort(F.collect_set("therapy_name")).alias("therapies"))


def last_gene_of_variants(g: Graph) -> DataFrame:
    """(variant_name, gene_symbol): one gene per variant, the last by name where a fusion has several."""
    return g.variant_of.groupBy("variant_name").agg(F.max("gene_symbol").alias("gene_symbol"))


def synonyms_of_diseases(g: Graph) -> DataFrame:
    """(disease_name, synonyms) of the diseases with an id that have any."""
    return required(g.diseases, "doid").filter(F.size("synonyms") > 0).select(F.col("name").alias("disease_name"), "synonyms")


def required(df: DataFrame, column: str) -> DataFrame:
    """Rows in which the column says anything."""
    return df.filter(F.col(column).isNotNull() & (F.trim(column) != ""))


def genes_to_exclude(g: Graph) -> DataFrame:
    """(include, n_exclude, but_not): with how many genes the first may be contrasted, and with which it may not.

    A gene may be contrasted with every other one that lacks a therapy of it. Those that lack none are few and must
    share its rarest therapy, so only these are compared: the many pairs are a class, told by number and exceptions.
    """
    edges = g.targets.select("therapy_name", "gene_symbol").distinct()
    own = edges.withColumnRenamed("gene_symbol", "include")
    each = own.groupBy("include").agg(F.count(F.lit(1)).alias("n"))
    rare = own.join(edges.groupBy("therapy_name").agg(F.count(F.lit(1)).alias("deg")), "therapy_name").groupBy("include").agg(F.min_by("therapy_name", F.struct("deg", "therapy_name")).alias("therapy_name"))
    near = rare.join(edges, "therapy_name").filter(F.col("gene_symbol") != F.col("include")).select("include", F.col("gene_symbol").alias("other"))
    held = near.join(own, "include").join(edges.withColumnRenamed("gene_symbol", "other"), ["other", "therapy_name"]).groupBy("include", "other").agg(F.count(F.lit(1)).alias("both"))
    all_held = held.join(each, "include").filter(F.col("both") == F.col("n")).groupBy("include").agg(F.array_sort(F.collect_list("other")).alias("but_not"))
    genes = each.agg(F.count(F.lit(1)).alias("genes"))
    got = each.join(all_held, "include", "left").withColumn("but_not", F.coalesce("but_not", F.array().cast("array<string>"))).join(F.broadcast(genes), F.lit(True))  # one row
    return got.select("include", (F.col("genes") - 1 - F.size("but_not")).alias("n_exclude"), "but_not")


def _exclusions(g: Graph) -> DataFrame:
    few = genes_to_exclude(g).filter("n_exclude > 0").orderBy("include").limit(MOST).select("include", "but_not").collect()  # MOST rows; each gives one at least
    rows = F.array(*[F.struct(F.lit(r["include"]).alias("i"), F.array(*[F.lit(x) for x in r["but_not"]]).cast("array<string>").alias("no")) for r in few])
    genes = g.targets.select("gene_symbol").distinct()
    if not few:
        return genes.select(F.col("gene_symbol").alias("gene_symbol_include"), F.col("gene_symbol").alias("gene_symbol_exclude")).limit(0)
    pairs = genes.select(F.explode(rows).alias("r"), "gene_symbol").filter((F.col("r.i") != F.col("gene_symbol")) & ~F.array_contains("r.no", F.col("gene_symbol")))
    return _first(pairs.select(F.col("r.i").alias("gene_symbol_include"), F.col("gene_symbol").alias("gene_symbol_exclude")))


def genes_sharing_a_therapy(g: Graph) -> DataFrame:
    """Ordered pairs of genes (a < b) that a therapy targets both. Therapies with the same genes count once."""
    sets = g.targets.groupBy("therapy_name").agg(F.array_sort(F.collect_set("gene_symbol")).alias("genes")).filter(F.size("genes") > 1).select("genes").distinct()
    pairs = sets.select(F.posexplode("genes").alias("i", "gene_symbol_a"), "genes").select("gene_symbol_a", F.explode(F.slice("genes", F.col("i") + 2, F.size("genes"))).alias("gene_symbol_b"))
    return pairs.distinct()


def _neighbours(g: Graph) -> DataFrame:
    """The first genes in order, two by two."""
    few = _first(g.targets.select("gene_symbol")).withColumn("n", F.row_number().over(Window.orderBy("gene_symbol")))  # MOST rows
    got = few.groupBy(F.floor((F.col("n") - 1) / 2).alias("pair")).agg(F.min("gene_symbol").alias("gene_symbol_a"), F.max("gene_symbol").alias("gene_symbol_b"), F.count(F.lit(1)).alias("k"))
    return got.filter("k = 2").select("gene_symbol_a", "gene_symbol_b")


def _genes_in_diseases(g: Graph, triples: DataFrame) -> DataFrame:
    """(gene_symbol, disease_name) by a therapy that targets the gene and has evidence in the disease."""
    return g.targets.select("therapy_name", "gene_symbol").join(triples.select("therapy_name", "disease_name"), "therapy_name").select("gene_symbol", "disease_name").distinct()


def _therapies_two_by_two(g: Graph) -> DataFrame:
    """Neighbouring therapies, in order, of each disease with resistance. A disease with n gives n - 1, so 2 * MOST + 1 rows are enough."""
    pairs = affects_pairs(g, "resistance")
    several = pairs.groupBy("disease_name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("disease_name")
    few = pairs.join(several, "disease_name", "left_semi").orderBy("disease_name", "therapy_name").limit(2 * MOST + 1)
    after = F.lead("therapy_name").over(Window.partitionBy("disease_name").orderBy("therapy_name"))
    return few.select(F.col("therapy_name").alias("therapy_name_a"), after.alias("therapy_name_b"), "disease_name").filter("therapy_name_b is not null").orderBy("disease_name", "therapy_name_a").limit(MOST)


def _contrasts_in_diseases(g: Graph) -> DataFrame:
    """(gene_include, gene_exclude, disease_name) with two different genes, of which the first has evidence in the disease."""
    few = _first(_genes_in_diseases(g, affects_pairs(g)).select(F.col("gene_symbol").alias("gene_include"), "disease_name"))
    genes = [r[0] for r in _first(g.targets.select("gene_symbol"), MOST + 1).collect()]
    got = few.select("gene_include", F.explode(F.array(*[F.lit(x) for x in genes]).cast("array<string>")).alias("gene_exclude"), "disease_name").filter("gene_include <> gene_exclude")
    return got.orderBy("gene_include", "disease_name", "gene_exclude").limit(MOST)


def _entities(g: Graph, edges: str, column: str) -> DataFrame:
    return _sampled(getattr(g, edges).select(column).filter(F.col(column).isNotNull()))


def _variants(g: Graph) -> DataFrame:
    return curated_first(g.variants.select(F.col("name").alias("variant_name")), "variant_name", (), MOST).select("variant_name")


def _pairs(g: Graph, effect: str | None = None) -> DataFrame:
    return _sampled(affects_pairs(g, effect))


def _of_variants(g: Graph, columns: tuple[str, ...], effect: str | None = None) -> DataFrame:
    return _sampled(variant_triples(g, effect).select(*columns))


_GENES, _DRUGS = partial(_entities, edges="targets", column="gene_symbol"), partial(_entities, edges="targets", column="therapy_name")
_DISEASES = partial(_entities, edges="affects", column="disease_name")
_VTD = partial(_of_variants, columns=("variant_name", "therapy_name", "disease_name"))

#: (family, strategy, wordings) of each question. The first wording is the base, the others are paraphrases.
QUESTIONS: dict[str, tuple[str, Callable[[Graph], DataFrame], tuple[str, ...]]] = {
    "q1_1": ("F1.1", _GENES, ("Which therapies target {gene_symbol}?", "List what is directed at {gene_symbol}.")),
    "q1_2": ("F1.2", _DRUGS, ("Which genes does {therapy_name} target?", "What does {therapy_name} act on?")),
    "q1_3": ("F1.3", _variants, ("Which gene is {variant_name} a variant of?",)),
    "q1_4": ("F1.4", _GENES, ("Which variants of {gene_symbol} are known?",)),
    "q2_1": ("F2.1", lambda g: _sampled(g.targets.select("therapy_name", "gene_symbol")), ("How does {therapy_name} act on {gene_symbol}?",)),
    "q2_2a": ("F2.2", _pairs, ("Which genes change the response to {therapy_name} in {disease_name}?",)),
    "q2_2b": ("F2.2", partial(_pairs, effect="resistance"), ("Which genes confer resistance to {therapy_name} in {disease_name}?",)),
    "q2_2c": ("F2.2", partial(_pairs, effect="sensitivity"), ("Which genes make {disease_name} sensitive to {therapy_name}?",)),
    "q2_2d": ("F2.2", _VTD, ("How does {variant_name} change the response of {disease_name} to {therapy_name}?",)),
    "q2_2e": ("F2.2", _VTD, ("What is reported on {variant_name} and {therapy_name} in {disease_name}?",)),
    "q2_3a": ("F2.3", partial(_of_variants, columns=("variant_name", "therapy_name"), effect="resistance"), ("Which publications report resistance of {variant_name} to {therapy_name}?",)),
    "q2_3b": ("F2.3", partial(_of_variants, columns=("variant_name", "therapy_name"), effect="sensitivity"), ("Which publications report sensitivity of {variant_name} to {therapy_name}?",)),
    "q2_4": ("F2.4", _variants, ("What consequence does {variant_name} have?",)),
    "q3_1": ("F3.1", _neighbours, ("Which therapies target {gene_symbol_a} or {gene_symbol_b}?",)),
    "q3_2": ("F3.2", lambda g: _first(genes_sharing_a_therapy(g)), ("Which therapies target both {gene_symbol_a} and {gene_symbol_b}?",)),
    "q3_3": ("F3.3", _exclusions, ("Which therapies target {gene_symbol_include} but not {gene_symbol_exclude}?",)),
    "q4_1": ("F4.1", lambda g: _first(_genes_in_diseases(g, affects_pairs(g))), ("Which therapies on {gene_symbol} have evidence in {disease_name}?",)),
    "q4_2": ("F4.2", partial(_pairs, effect="resistance"), ("What else can be tried where {disease_name} resists {therapy_name}?",)),
    "q5_1": ("F5.1", _DISEASES, ("Which biomarkers matter in {disease_name}?", "Name the biomarkers of {disease_name}.")),
    "q5_2": ("F5.2", _DISEASES, ("Which variants have evidence in {disease_name}?",)),
    "q6_1": ("F6.1", _therapies_two_by_two, ("Which genes confer resistance to {therapy_name_a} or {therapy_name_b} in {disease_name}?",)),
    "q6_2": ("F6.2", _contrasts_in_diseases, ("Which evidence in {disease_name} is on therapies that target {gene_include} but not {gene_exclude}?",)),
    "q6_3": ("F6.3", lambda g: _first(_genes_in_diseases(g, variant_triples(g, "resistance"))), ("Which variants of {gene_symbol} resist therapies on it in {disease_name}?",)),
    "q6_4": ("F6.4", partial(_pairs, effect="resistance"), ("Which alternatives to {therapy_name} are there in {disease_name} after resistance?",)),
}


def mined(g: Graph, template: str) -> DataFrame:
    """(template_id, family_id, n, placeholders): numbered in order, as a map."""
    family, strategy, _ = QUESTIONS[template]
    rows = strategy(g)
    number = F.row_number().over(Window.orderBy(*rows.columns))  # MOST rows
    pairs = [x for c in rows.columns for x in (F.lit(c), F.col(c))]
    return rows.select(F.lit(template).alias("template_id"), F.lit(family).alias("family_id"), number.alias("n"), F.create_map(*pairs).alias("placeholders"))

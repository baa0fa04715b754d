"""The question catalog: 24 templates, 5 presets and 5 prompt shapes as functions of a graph."""

from __future__ import annotations

from functools import partial
from inspect import signature

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import any_ci_contains
from quillgraph.graph import PARTS, Graph
from quillgraph.operators.match import disease_matches, fusion_matches, limit_rows, variant_matches
from quillgraph.operators.present import check_request

_TARGETS = ("gene_symbol", "therapy_name", "targets_moa", "ref_sources", "ref_ids", "ref_urls")
_AFFECTS = ("variant_name", "gene_symbol", "therapy_name", "effect", "disease_name", "pmids")


def top(df: DataFrame, n: int | None = None, by: list[Column] | None = None) -> DataFrame:
    """The first rows in a total order, so that the limit is deterministic. Lists are compared as sorted text."""
    kinds = dict(df.dtypes)
    every = [F.array_join(F.array_sort(c), ";") if kinds[c].startswith("array") else F.col(c) for c in sorted(df.columns)]
    return df.orderBy(*(by or []), *[c.asc_nulls_first() for c in every]).limit(limit_rows(n))


def _target_rows(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("moa", "targets_moa").select(*_TARGETS)


def _of_gene(g: Graph, rows: DataFrame, *terms: str) -> DataFrame:
    """Rows of the genes that the terms name."""
    return rows.join(g.genes_named(*terms), "gene_symbol", "left_semi")


def _of_therapy(g: Graph, rows: DataFrame, *terms: str) -> DataFrame:
    """Rows of the therapies that the terms name; the folders of all others aren't read."""
    return rows.join(g.therapies_named(*terms), ["therapy_part", "therapy_name"], "left_semi")


def _in_disease(disease: str) -> Column:
    return disease_matches(disease, "disease_key", lowered=True)


# --- F1: one hop ---------------------------------------------------------------------------------------------


def targets_of_gene(g: Graph, gene: str, limit: int | None = None) -> DataFrame:
    return top(_target_rows(_of_gene(g, g.targeting, gene)), limit)


def genes_of_therapy(g: Graph, therapy: str, limit: int | None = None) -> DataFrame:
    return top(_target_rows(_of_therapy(g, g.targeting, therapy)), limit)


def gene_of_variant(g: Graph, variant: str, limit: int | None = None) -> DataFrame:
    return top(g.variant_of.filter(F.col("variant_name") == variant).select("gene_symbol", "variant_name"), limit)


def variants_of_gene(g: Graph, gene: str, limit: int | None = None) -> DataFrame:
    return top(_of_gene(g, g.variant_of, gene).select("variant_name", "gene_symbol"), limit)


# --- F2: evidence and properties --------------------------------------------------------------------------------


def target_properties(g: Graph, therapy: str, gene: str, limit: int | None = None) -> DataFrame:
    return top(_target_rows(_of_therapy(g, _of_gene(g, g.targeting, gene), therapy)), limit)


def _genes_affecting(rows: DataFrame, effect: str | None, limit: int | None) -> DataFrame:
    """Rows without pmids vanish, as the unwinding of an empty list has no rows."""
    if effect:
        rows = rows.filter(F.col("effect_key") == effect)
    rows = rows.filter(F.col("gene_symbol").isNotNull()).select("gene_symbol", "therapy_name", "disease_name", F.explode("pmids").alias("p"))
    got = rows.groupBy("gene_symbol", "therapy_name", "disease_name").agg(F.collect_set("p").alias("pmids"))
    none = F.lit(None).cast("string")
    return top(got.select(none.alias("variant_name"), "gene_symbol", "therapy_name", F.lit(effect).cast("string").alias("effect"), "disease_name", "pmids"), limit)


def genes_affecting_therapy(g: Graph, therapy: str, disease: str, effect: str | None = None, limit: int | None = None) -> DataFrame:
    return _genes_affecting(_of_therapy(g, g.evidence.filter(_in_disease(disease)), therapy), effect, limit)


def variant_affecting_therapy(g: Graph, variant: str, therapy: str, disease: str = "", effect: str | None = None, limit: int | None = None) -> DataFrame:
    rows = _of_therapy(g, g.evidence.filter((F.col("variant_name") == variant) & F.col("gene_symbol").isNotNull() & _in_disease(disease)), therapy)
    if effect:
        rows = rows.filter(F.col("effect_key") == effect).withColumn("effect", F.lit(effect))
    return top(rows.select(*_AFFECTS), limit)


def variant_consequence(g: Graph, variant: str, limit: int | None = None) -> DataFrame:
    return top(g.variants.filter(F.col("name") == variant).select(F.col("name").alias("variant_name"), F.col("consequence").alias("variant_consequence")), limit)


def evidence_of_variant_token(g: Graph, token: str, therapy: str, limit: int | None = None) -> DataFrame:
    """Evidence on variants of some gene whose name contains the token or that have it as a synonym."""
    hits = g.variants.select(F.col("name").alias("variant_name"), F.col("synonyms").alias("variant_synonyms")).filter(variant_matches(token)).select("variant_name")
    rows = g.evidence.filter(F.col("variant_name").isNotNull() & F.col("gene_symbol").isNotNull())
    return top(_of_therapy(g, rows, therapy).join(hits, "variant_name", "left_semi").select(*_AFFECTS), limit)


def fusions_of(g: Graph, a: str, b: str, limit: int | None = None) -> DataFrame:
    """Variants whose name has a fusion of both genes, in either order."""
    return top(g.variants.filter(fusion_matches("name", a, b)).select(F.col("name").alias("variant_name"), F.col("consequence").alias("variant_consequence")), limit)


# --- F3: sets ----------------------------------------------------------------------------------------------------


def therapies_of_either(g: Graph, a: str, b: str, limit: int | None = None) -> DataFrame:
    return top(_target_rows(_of_gene(g, g.targeting, a, b)), limit)


def therapies_of_both(g: Graph, a: str, b: str, limit: int | None = None) -> DataFrame:
    """Both edges of each pair; a gene that matches both terms pairs with itself."""
    edge = F.struct("gene_symbol", F.col("moa").alias("targets_moa"), "ref_sources", "ref_ids", "ref_urls")
    left = _of_gene(g, g.targeting, a).select("therapy_name", edge.alias("_a"))
    right = _of_gene(g, g.targeting, b).select("therapy_name", edge.alias("_b"))
    both = left.join(right, "therapy_name").select("therapy_name", F.explode(F.array("_a", "_b")).alias("e"))
    return top(both.select("therapy_name", "e.*").select(*_TARGETS), limit)


def _without(g: Graph, rows: DataFrame, gene: str) -> DataFrame:
    hit = _of_gene(g, g.targeting, gene).select("therapy_name").distinct()
    return rows.join(hit, "therapy_name", "left_anti")


def _first_only(g: Graph, include: str, exclude: str) -> DataFrame:
    return _without(g, _of_gene(g, g.targeting, include), exclude)


def therapies_of_first_only(g: Graph, include: str, exclude: str, limit: int | None = None) -> DataFrame:
    return top(_target_rows(_first_only(g, include, exclude)), limit)


# --- F4 to F6: several hops ------------------------------------------------------------------------------------


def validated_therapies(g: Graph, gene: str, disease: str, limit: int | None = None) -> DataFrame:
    """Evidence in the disease on therapies that target the gene; the gene of a row is the biomarker's."""
    hits = _of_gene(g, g.targeting, gene).select("therapy_name")
    return top(g.evidence.filter(_in_disease(disease)).join(hits, "therapy_name").select(*_AFFECTS), limit)


def alternatives(g: Graph, therapy: str, disease: str, limit: int | None = None) -> DataFrame:
    """Other therapies that target a resistance gene of the therapy, once per evidence edge.

    The gene is looked up by symbol or synonym through the alias table, an equality join.
    """
    rows = g.evidence.filter((F.col("effect_key") == "resistance") & _in_disease(disease) & F.col("gene_symbol").isNotNull())
    rows = _of_therapy(g, rows, therapy).select("gene_symbol", F.lower("gene_symbol").alias("alias")).join(g.gene_aliases(), "alias")
    edges = g.targeting.filter(F.lower("therapy_name") != therapy.lower()).withColumnRenamed("gene_symbol", "target_symbol")
    return top(_target_rows(rows.join(edges, "target_symbol")), limit)


def biomarkers_in_disease(g: Graph, disease: str, limit: int | None = None) -> DataFrame:
    return top(g.evidence.filter(_in_disease(disease)).select(*_AFFECTS), limit)


def variant_evidence_in_disease(g: Graph, disease: str, limit: int | None = None) -> DataFrame:
    return top(g.evidence.filter((F.col("biomarker_type") == "Variant") & _in_disease(disease)).select(*_AFFECTS), limit)


def resistance_genes_of_either(g: Graph, a: str, b: str, disease: str, limit: int | None = None) -> DataFrame:
    return _genes_affecting(_of_therapy(g, g.evidence.filter(_in_disease(disease)), a, b), "resistance", limit)


def evidence_of_first_only(g: Graph, include: str, exclude: str, disease: str, limit: int | None = None) -> DataFrame:
    hits = _first_only(g, include, exclude).select("therapy_name")
    return top(g.evidence.filter(_in_disease(disease)).join(hits, "therapy_name").select(*_AFFECTS), limit)


def resisted_by_variant(g: Graph, gene: str, disease: str, limit: int | None = None) -> DataFrame:
    """Therapies that target the gene, and variants of that gene that resist them."""
    hits = _of_gene(g, g.targeting, gene).select("therapy_name", "gene_symbol")
    rows = g.evidence.filter((F.col("biomarker_type") == "Variant") & (F.col("effect_key") == "resistance") & _in_disease(disease))
    return top(rows.join(hits, ["therapy_name", "gene_symbol"]).withColumn("effect", F.lit("resistance")).select(*_AFFECTS), limit)


# --- presets -------------------------------------------------------------------------------------------------------


def _gene_set(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("gene_symbol").isNotNull()).select("gene_symbol").distinct().orderBy("gene_symbol").limit(50)


def genes_in_disease(g: Graph, word: str) -> DataFrame:
    return _gene_set(g.evidence.filter(_in_disease(word)))


def resistance_genes(g: Graph) -> DataFrame:
    return _gene_set(g.evidence.filter(F.col("effect_key") == "resistance"))


def pathway_genes(g: Graph, gene: str) -> DataFrame:
    """All genes targeted by therapies that target the gene (case counts) or carry a tag with it."""
    edges = g.targeting
    hit = edges.filter(F.col("gene_symbol") == gene).select("therapy_name", F.lit(True).alias("_hit")).distinct()
    tagged = F.coalesce(any_ci_contains(F.col("tags"), gene), F.lit(False))
    return _gene_set(edges.join(hit, "therapy_name", "left").filter(F.col("_hit").isNotNull() | tagged))


def top_biomarker_genes(g: Graph) -> DataFrame:
    got = g.evidence.filter(F.col("gene_symbol").isNotNull()).groupBy("gene_symbol").agg(F.count(F.lit(1)).alias("biomarker_count"))
    return got.orderBy(F.desc("biomarker_count"), "gene_symbol").limit(50)


# --- prompt shapes -------------------------------------------------------------------------------------------------

_METRICS = ("best_evidence_level", "evidence_levels", "evidence_count", "avg_rating", "max_rating")


def gene_level_evidence(g: Graph, terms: tuple[str, ...], effect: str, disease: str, faithful: bool = False, limit: int | None = None) -> DataFrame:
    """Evidence per gene, therapy and disease, best level first. faithful: blank levels count and sort first."""
    level = F.coalesce("best_evidence_level", F.lit("")) if faithful else F.col("best_evidence_level")
    rows = _of_therapy(g, g.evidence.filter((F.col("effect_key") == effect) & _in_disease(disease) & F.col("gene_symbol").isNotNull()), *terms)
    got = rows.withColumn("_level", level).groupBy("gene_symbol", "therapy_name", "disease_name").agg(
        F.flatten(F.collect_list("pmids")).alias("pmids"),
        F.min("_level").alias("best_evidence_level"),
        F.collect_set("_level").alias("evidence_levels"),
        F.coalesce(F.sum("evidence_count"), F.lit(0)).cast("bigint").alias("evidence_count"),
        F.avg("avg_rating").alias("avg_rating"),
        F.max("max_rating").alias("max_rating"),
    )
    got = got.select(F.lit(None).cast("string").alias("variant_name"), "gene_symbol", "therapy_name", F.lit(effect).alias("effect"), "disease_name", "pmids", *_METRICS)
    return top(got, limit, by=[F.asc_nulls_last("best_evidence_level"), F.desc_nulls_first("evidence_count")])


def _metric_rows(rows: DataFrame) -> DataFrame:
    return rows.select(*_AFFECTS, F.coalesce("best_evidence_level", F.lit("")).alias("best_evidence_level"), "evidence_levels", F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"), "avg_rating", "max_rating")


def class_evidence(g: Graph, tag: str, gene: str, effect: str, disease: str, limit: int | None = None) -> DataFrame:
    """Evidence on therapies with the tag or that target the gene (case counts)."""
    hit = g.targets.filter(F.col("gene_symbol") == gene).select("therapy_name", F.lit(True).alias("_hit")).distinct()
    rows = g.evidence.filter((F.col("effect_key") == effect) & _in_disease(disease)).join(hit, "therapy_name", "left")
    return top(_metric_rows(rows.filter(F.col("_hit").isNotNull() | any_ci_contains(F.col("tags"), tag))), limit)


def target_rows_with_nulls(g: Graph, gene: str, limit: int | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    got = _target_rows(_of_gene(g, g.targeting, gene))
    return top(got.select(none.alias("variant_name"), "gene_symbol", "therapy_name", none.alias("effect"), none.alias("disease_name"), *_TARGETS[2:]), limit)


def evidence_of_first_only_with_metrics(g: Graph, include: str, exclude: str, disease: str, limit: int | None = None) -> DataFrame:
    hits = _first_only(g, include, exclude).select("therapy_name")
    return top(_metric_rows(g.evidence.filter(_in_disease(disease)).join(hits, "therapy_name")), limit)


# --- registry --------------------------------------------------------------------------------------------------------

#: Parameters with which the catalog is run over the test tables.
GENE_A, GENE_B, DRUG_A, DRUG_B, DISEASE, WORD = "jitla", "QEDN1", "gindocoutinib", "pranstodmomtinib", "carcinoma", "lymphoma"
VARIANT, TOKEN = "WELFB2 T3878Pfs*18", "fs*1"
FUSION = ("zepr", "JONR")


def flat(df: DataFrame) -> DataFrame:
    """Lists as sorted text and averages rounded, for comparison across engines."""
    out = []
    for c, kind in df.dtypes:
        one = F.array_join(F.array_sort(c), ";") if kind.startswith("array") else F.round(c, 6) if kind == "double" else F.col(c)
        out.append(one.cast("bigint").alias(c) if kind == "int" else one.alias(c))
    return df.select(*out)


TEMPLATES = {
    "q1_1_targets_of_gene": partial(targets_of_gene, gene=GENE_A),
    "q1_2_genes_of_therapy": partial(genes_of_therapy, therapy=DRUG_A),
    "q1_3_gene_of_variant": partial(gene_of_variant, variant=VARIANT),
    "q1_4_variants_of_gene": partial(variants_of_gene, gene=GENE_A),
    "q2_1_target_properties": partial(target_properties, therapy="a", gene=GENE_A),
    "q2_2a_genes_affecting_therapy": partial(genes_affecting_therapy, therapy=DRUG_A, disease=DISEASE),
    "q2_2b_genes_resisting_therapy": partial(genes_affecting_therapy, therapy=DRUG_A, disease=DISEASE, effect="resistance"),
    "q2_2c_genes_sensitive_to_therapy": partial(genes_affecting_therapy, therapy=DRUG_A, disease=DISEASE, effect="sensitivity"),
    "q2_2d_variant_affecting_therapy": partial(variant_affecting_therapy, variant=VARIANT, therapy="a", disease="a"),
    "q2_2e_variant_token_affecting_therapy": partial(variant_affecting_therapy, variant=VARIANT, therapy="i", disease=DISEASE),
    "q2_3a_pmids_of_resistance": partial(variant_affecting_therapy, variant=VARIANT, therapy="a", effect="resistance"),
    "q2_3b_pmids_of_sensitivity": partial(variant_affecting_therapy, variant=VARIANT, therapy="a", effect="sensitivity"),
    "q2_4_variant_consequence": partial(variant_consequence, variant=VARIANT),
    "q3_1_therapies_of_either": partial(therapies_of_either, a=GENE_A, b=GENE_B),
    "q3_2_therapies_of_both": partial(therapies_of_both, a=GENE_A, b=GENE_B),
    "q3_3_therapies_of_first_only": partial(therapies_of_first_only, include=GENE_A, exclude=GENE_B),
    "q4_1_validated_therapies": partial(validated_therapies, gene=GENE_A, disease=DISEASE),
    "q4_2_alternatives": partial(alternatives, therapy=DRUG_A, disease=DISEASE),
    "q5_1_biomarkers_in_disease": partial(biomarkers_in_disease, disease=DISEASE),
    "q5_2_variant_evidence_in_disease": partial(variant_evidence_in_disease, disease="juvenile cancer"),
    "q6_1_resistance_genes_of_either": partial(resistance_genes_of_either, a=DRUG_A, b=DRUG_B, disease=DISEASE),
    "q6_2_evidence_of_first_only": partial(evidence_of_first_only, include=GENE_A, exclude=GENE_B, disease=DISEASE),
    "q6_3_resisted_by_variant": partial(resisted_by_variant, gene=GENE_A, disease="a"),
    "q6_4_alternatives_in_disease": partial(alternatives, therapy=DRUG_B, disease=WORD),
    "g1_genes_in_first_disease": partial(genes_in_disease, word=DISEASE),
    "g2_genes_in_second_disease": partial(genes_in_disease, word=WORD),
    "g3_resistance_genes": resistance_genes,
    "g4_pathway_genes": partial(pathway_genes, gene="JITLA"),
    "g5_top_biomarker_genes": top_biomarker_genes,
    "f19_evidence_of_variant_token": partial(evidence_of_variant_token, token=TOKEN, therapy="a", limit=200),
    "f18_fusions_of": partial(fusions_of, a=FUSION[0], b=FUSION[1]),
    "o7_biomarkers_limited": partial(biomarkers_in_disease, disease=DISEASE, limit=7),
    "c1_gene_level_evidence": partial(gene_level_evidence, terms=(DRUG_A, DRUG_B), effect="resistance", disease=DISEASE),
    "c2_class_evidence": partial(class_evidence, tag="inhibitor", gene="JITLA", effect="resistance", disease=DISEASE),
    "c3_target_rows_with_nulls": partial(target_rows_with_nulls, gene=GENE_B),
    "c4_variant_lookup": partial(variants_of_gene, gene=GENE_B),
    "c5_exclusion_with_metrics": partial(evidence_of_first_only_with_metrics, include=GENE_A, exclude=GENE_B, disease=WORD),
}


def ask(g: Graph, template: str, limit: int | None = None, **parameters: object) -> DataFrame:
    """The answer to a question of the catalog. An unknown template, or parameters that it hasn't, are a ValueError."""
    if template not in TEMPLATES:
        raise ValueError(f"unknown template {template}")
    function = getattr(TEMPLATES[template], "func", TEMPLATES[template])
    known = [p for p in signature(function).parameters if p not in ("g", "limit")]
    if bad := [p for p in parameters if p not in known]:
        raise ValueError(f"unknown parameters of {template}: {', '.join(bad)}")
    if limit is not None and "limit" not in signature(function).parameters:
        return function(g, **parameters).limit(limit_rows(limit))
    return function(g, **parameters, **({} if limit is None else {"limit": limit}))


def read(g: Graph, name: str, columns: list[str], limit: int | None = None) -> DataFrame:
    """Columns of a node or edge table, in order, at most `limit_rows`; tables and columns that aren't allowed are a ValueError."""
    check_request(name, columns)
    return top(getattr(g, "affects" if name == "affects_response" else name).select(*columns), limit)


def _run(question: partial, spark: SparkSession, sf: str) -> DataFrame:
    """Over the saved graph, which the first question of a session loads; k4_load_* and k5_* run the load itself."""
    return flat(question(Graph.saved(spark, sf)))


def graph_table(name: str, spark: SparkSession, sf: str) -> DataFrame:
    """A node or edge table after the load."""
    return flat(getattr(Graph.load(spark, sf), name))


def k5_key_violations(spark: SparkSession, sf: str) -> DataFrame:
    return Graph.load(spark, sf).violations()


def k3_saved_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each table of the saved graph."""
    g = Graph.saved(spark, sf)
    out = None
    for name in PARTS:
        one = getattr(g, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def n1_biomarkers(spark: SparkSession, sf: str) -> DataFrame:
    return Graph.load(spark, sf).biomarkers()


QUERIES = {name: partial(_run, q) for name, q in TEMPLATES.items()}
QUERIES |= {f"k4_load_{name}": partial(graph_table, name) for name in PARTS}
QUERIES |= {f.__name__: f for f in (k3_saved_graph, k5_key_violations, n1_biomarkers)}

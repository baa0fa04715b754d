"""Queries on ingest, enrichment, question sets and the event log, and SQL to check them against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.hashing import stable_hash
from quillgraph.functions.text import join_sorted, null_if_blank, split_list, strip_ws
from quillgraph.graph import Graph, clean_id
from quillgraph.operators import dataset, enrich, ingest, mining
from quillgraph.plans.catalog_sql import PRELUDE, ident, parts, strip, text
from quillgraph.plans.records import _HELD, _pmid
from quillgraph.session import table
from quillgraph.streaming import log


def _six(c: str) -> Column:
    return F.round(c, 6).alias(c)


# --- ingest ------------------------------------------------------------------------------------------------------


def a1_evidence_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """The evidence roll-up, with affects_response as evidence."""
    rows = table(spark, sf, "affects_response")
    edges = rows.select(
        "biomarker_type", null_if_blank(F.col("biomarker_name")).alias("biomarker_name"), null_if_blank(F.col("therapy_name")).alias("therapy_name"), ingest.effect_class(F.col("effect")).alias("effect"),
        null_if_blank(F.col("disease_name")).alias("disease_name"), clean_id(F.col("disease_id")).alias("disease_id"), F.coalesce("best_evidence_level", F.lit("")).alias("level"), F.col("max_rating").alias("rating"),
        split_list(F.col("pmids")).alias("pmids"), "source", F.col("notes").alias("note"), F.col("row_id").alias("_pos"),
    )
    keys = ["biomarker_type", "biomarker_name", "therapy_name", "effect", "disease_name"]
    got = ingest.evidence_rollup(edges.na.drop(subset=keys))
    return got.select(*keys, "disease_id", F.array_join("pmids", ";").alias("pmids"), "source", "notes", "best_evidence_level", F.array_join("evidence_levels", ";").alias("evidence_levels"), "evidence_count", "avg_rating", F.col("max_rating").cast("bigint").alias("max_rating"))


def a13_moa_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """The roll-up of mechanisms, with the rows of targets as mechanisms: their first source, their ids and URLs."""
    lists = {c: split_list(F.col(c)) for c in ("ref_sources", "ref_ids", "ref_urls")}
    refs = F.array(F.struct(F.try_element_at(lists["ref_sources"], F.lit(1)).alias("source"), lists["ref_ids"].alias("ids"), lists["ref_urls"].alias("urls")))
    rows = table(spark, sf, "targets").select(null_if_blank(F.col("therapy_name")).alias("therapy_name"), null_if_blank(F.col("gene_symbol")).alias("gene_symbol"), "moa", "action_type", refs.alias("refs"))
    got = ingest.moa_rollup(rows.na.drop(subset=["therapy_name", "gene_symbol"]))
    return got.select("therapy_name", "gene_symbol", "moa", "action_type", *[F.array_join(c, ";").alias(c) for c in ("ref_sources", "ref_ids", "ref_urls")])


def etl_effects(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per effect as written, its class, and its category in result tables."""
    rows = table(spark, sf, "affects_response").groupBy("effect").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("effect", ingest.effect_class(F.col("effect")).alias("effect_class"), ingest.effect_category(F.col("effect")).alias("category"), "n")


def etl_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Tags and modality that a therapy's name and targets imply."""
    edges = Graph.saved(spark, sf).targets.groupBy("therapy_name").agg(F.array_sort(F.collect_set("gene_symbol")).alias("genes"))
    name, genes = F.col("therapy_name"), F.col("genes")
    return edges.select("therapy_name", F.array_join(ingest.inferred_tags(name, genes), ";").alias("tags"), ingest.inferred_modality(name, genes).alias("modality"))


def etl_fusions(spark: SparkSession, sf: str) -> DataFrame:
    """Genes of each fusion in a variant's name."""
    rows = table(spark, sf, "variants").select("row_id", F.explode(ingest.all_fusions(F.col("name"))).alias("fusion"))
    return rows.select("row_id", F.explode(ingest.fusion_parts(F.col("fusion"))).alias("gene_symbol"))


def etl_variant_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "variant_of").select("row_id", null_if_blank(F.col("gene_symbol")).alias("g"), null_if_blank(F.col("variant_name")).alias("v")).na.drop()
    return rows.select("row_id", ingest.variant_name(F.col("g"), F.col("v")).alias("name"))


def etl_url_pmids(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "targets").select("row_id", F.explode(split_list(F.col("ref_urls"))).alias("url"))
    return rows.select("row_id", ingest.pmid_of_url(F.col("url")).alias("pmid"))


def a22_therapies_per_gene(spark: SparkSession, sf: str) -> DataFrame:
    got = Graph.saved(spark, sf).targets.groupBy("gene_symbol").agg(F.collect_set("therapy_name").alias("t"))
    return got.select("gene_symbol", F.size("t").cast("bigint").alias("n_therapies"), join_sorted(F.col("t")).alias("therapies"))


# --- enrichment ----------------------------------------------------------------------------------------------------


def _sets(spark: SparkSession, sf: str, most_targets: int = 0) -> tuple[DataFrame, DataFrame, int]:
    """(genes, sets, universe); the genes are those of resistance in sheath diseases, or of so many therapies with the most targets."""
    g = Graph.saved(spark, sf)
    sets = g.targets.select(F.coalesce(F.upper("action_type"), F.lit("NONE")).alias("library"), F.col("therapy_name").alias("term"), F.col("gene_symbol").alias("gene"))
    asked = g.evidence.filter((F.col("effect_key") == "resistance") & F.contains("disease_key", F.lit("sheath"))).select(F.col("gene_symbol").alias("name"))
    if most_targets:
        edges = g.targets.select("therapy_name", "gene_symbol").distinct()
        top = edges.groupBy("therapy_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "therapy_name").limit(most_targets)
        asked = edges.join(top, "therapy_name").select(F.col("gene_symbol").alias("name"))
    valid, _ = enrich.normalise_genes(asked, g.gene_aliases().withColumnRenamed("target_symbol", "symbol"))
    return valid.withColumnRenamed("symbol", "gene"), sets, g.genes.count()


def e3_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    got = enrich.enrichment(*_sets(spark, sf))
    return got.select("library", "term", "gene_count", "set_size", _six("p_value"), _six("odds_ratio"), F.array_join("genes", ";").alias("genes"), _six("adjusted_p_value"))


def e6_top_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The best 15 terms at the level 0.05, of the genes of the eight therapies with the most targets."""
    got = enrich.significant(enrich.enrichment(*_sets(spark, sf, 8)).withColumn("adjusted_p_value", F.round("adjusted_p_value", 9)))
    return got.select("library", "term", "gene_count", _six("adjusted_p_value"))


def o6_told_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The ten terms that a summary is told, with five genes each."""
    got = enrich.told(enrich.enrichment(*_sets(spark, sf)).withColumn("adjusted_p_value", F.round("adjusted_p_value", 9)))
    return got.select("library", "term", F.array_join("genes", ";").alias("genes"))


def e7_plot_points(spark: SparkSession, sf: str) -> DataFrame:
    points = enrich.plot_points(enrich.enrichment(*_sets(spark, sf))).select("library", F.explode("points").alias("p"))
    return points.select("library", "p.term", "p.gene_count", F.round("p.score", 6).alias("score"))


def e8_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """What a typed list of genes gives: terms of known libraries, and names that stand for no gene."""
    g = Graph.saved(spark, sf)
    names = enrich.gene_list("jitla, QEDN1\n nosuch\n\n,JITLA,  another one,YIGD1\nXUPFA,QIDG2")
    sets = g.targets.select(F.coalesce(F.upper("action_type"), F.lit("NONE")).alias("library"), F.col("therapy_name").alias("term"), F.col("gene_symbol").alias("gene"))
    known = [r[0] for r in sets.select("library").distinct().orderBy("library").collect()]  # libraries are few
    asked = spark.createDataFrame([(n,) for n in names], "name string")
    got = enrich.analyze(asked, g.gene_aliases().withColumnRenamed("target_symbol", "symbol"), enrich.libraries_of(sets, None, known), g.genes.count(), level=1.01, n=10_000)
    terms = got.terms.select(F.lit("term").alias("kind"), F.concat_ws("|", "library", "term").alias("name"), F.round("adjusted_p_value", 6).alias("value"))
    return terms.unionByName(got.invalid.select(F.lit("unknown").alias("kind"), "name", F.lit(None).cast("double").alias("value")))


def e6_significant_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The best 100 terms at the level 0.05, of the genes of the eight therapies with the most targets."""
    got = enrich.significant(enrich.enrichment(*_sets(spark, sf, 8)).withColumn("adjusted_p_value", F.round("adjusted_p_value", 9)), n=100)
    return got.select("library", "term", "gene_count", _six("adjusted_p_value"))


def e1_unknown_genes(spark: SparkSession, sf: str) -> DataFrame:
    """Gene symbols in targets that stand for no gene, without regard to case."""
    g = Graph.saved(spark, sf)
    asked = table(spark, sf, "targets").select(strip_ws(F.col("gene_symbol")).alias("name"))
    return enrich.normalise_genes(asked, g.gene_aliases().withColumnRenamed("target_symbol", "symbol"))[1]


# --- question sets ---------------------------------------------------------------------------------------------------


def d1_genes_sharing_a_therapy(spark: SparkSession, sf: str) -> DataFrame:
    got = mining.genes_sharing_a_therapy(Graph.saved(spark, sf))
    return got.select(F.col("gene_symbol_a").alias("gene_a"), F.col("gene_symbol_b").alias("gene_b"))


def d1_genes_to_exclude(spark: SparkSession, sf: str) -> DataFrame:
    """With how many genes each may be contrasted, and the others."""
    got = mining.genes_to_exclude(Graph.saved(spark, sf))
    return got.select("include", "n_exclude", F.array_join("but_not", ";").alias("but_not"))


def d6_split(spark: SparkSession, sf: str) -> DataFrame:
    """The stratified split of paraphrase items by family."""
    items = table(spark, sf, "paraphrase_items").select("item_id", F.coalesce("family_id", F.lit("none")).alias("family_id")).distinct()
    return dataset.stratified_split(items, "family_id", "item_id").select("item_id", "family_id", "split")


def a17_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation metrics with events as records."""
    rows = table(spark, sf, "events").select("event_type", (F.col("value") > 10).alias("valid"), (F.col("value") > 20).alias("executed"), (F.col("value") > 50).alias("matched"), (F.col("value") + 1).alias("latency_ms"), F.lit(100).alias("tokens"))
    got = dataset.metrics(rows, ["event_type"])
    return got.select("event_type", "n", *[_six(c) for c in ("valid_pct", "executed_pct", "matched_pct", "avg_latency_ms", "tokens_per_second")])


# --- event log -----------------------------------------------------------------------------------------------------------


def t2_first_steps(spark: SparkSession, sf: str) -> DataFrame:
    return log.first_steps(table(spark, sf, "events"), "user_id", "event_type", "ts")


def t3_live_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Events as cache entries of 48 hours, live at the last event."""
    rows = table(spark, sf, "events").select("event_id", (F.col("ts") + F.expr("interval 48 hours")).alias("expires_at"), "ts")
    last = rows.agg(F.max("ts").alias("now"))
    return log.live_entries(rows.join(F.broadcast(last), how="cross"), F.col("now")).select("event_id", "expires_at")


def t4_recent_requests(spark: SparkSession, sf: str) -> DataFrame:
    return log.requests_in_window(table(spark, sf, "events"), "event_type", "ts", 3600).select("event_id", "n_recent")


def t5_steps_per_run(spark: SparkSession, sf: str) -> DataFrame:
    got = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    return got.select("user_id", join_sorted(F.col("s")).alias("steps"))


def x7_row_hashes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "diseases")
    return rows.select("row_id", stable_hash({"name": F.col("name"), "doid": F.col("doid"), "synonyms": F.col("synonyms")}).alias("hash"))


_ALL = (
    a1_evidence_rollup, a13_moa_rollup, etl_effects, etl_tags, etl_fusions, etl_variant_names, etl_url_pmids, a22_therapies_per_gene, e1_unknown_genes, e3_enrichment, e6_top_terms, e6_significant_terms, o6_told_terms, e7_plot_points, e8_analysis,
    d1_genes_sharing_a_therapy, d1_genes_to_exclude, d6_split, a17_metrics, t2_first_steps, t3_live_entries, t4_recent_requests, t5_steps_per_run, x7_row_hashes,
)
QUERIES = {f.__name__: f for f in _ALL}


# --- SQL -----------------------------------------------------------------------------------------------------------------


def _class(x: str) -> str:
    has = lambda words: " OR ".join(f"contains(lower({x}), '{w}')" for w in words)
    return f"CASE WHEN {has(('sensitivity', 'responsive', 'benefit'))} THEN 'sensitivity' WHEN {has(('resistance', 'adverse', 'nonresponse', 'no response', 'lack of response'))} THEN 'resistance' END"


def _hash(cols: tuple[str, ...]) -> str:
    one = lambda c: f"'{c}=' || coalesce('''' || replace({c}, '''', '''''') || '''', 'null')"
    return "sha256(" + " || ',' || ".join(one(c) for c in sorted(cols)) + ")"


_ORA = f"""{PRELUDE},
sets AS (SELECT DISTINCT coalesce(upper(action_type), 'NONE') AS library, therapy_name AS term, gene_symbol AS gene FROM targets_n),
asked AS (SELECT DISTINCT upper(gene_symbol) AS name FROM ev WHERE lower(effect) = 'resistance' AND contains(lower(disease_name), 'sheath') AND gene_symbol IS NOT NULL),
aliases AS (SELECT lower(symbol) AS alias, symbol FROM genes_n UNION SELECT lower(x), symbol FROM (SELECT symbol, unnest(synonyms) AS x FROM genes_n)),
valid AS (SELECT DISTINCT symbol FROM asked JOIN aliases ON alias = lower(name)),
sizes AS (SELECT (SELECT count(*) FROM genes_n) AS m, (SELECT count(*) FROM valid) AS n),
hit AS (SELECT library, term, count(*) AS k, count(symbol) AS x, array_to_string(list_sort(list(gene) FILTER (WHERE symbol IS NOT NULL)), ';') AS genes FROM sets LEFT JOIN valid ON symbol = gene GROUP BY 1, 2 HAVING count(symbol) > 0),
tails AS (SELECT library, term, k, x, any_value(genes) AS genes, least(1.0, sum(CASE WHEN n - i <= m - k THEN exp(lgamma(k + 1) - lgamma(i + 1) - lgamma(k - i + 1) + lgamma(m - k + 1) - lgamma(n - i + 1) - lgamma(m - k - n + i + 1) - lgamma(m + 1) + lgamma(n + 1) + lgamma(m - n + 1)) ELSE 0 END)) AS p,
  any_value(CASE WHEN n - x > 0 AND k - x > 0 THEN x * (m - k - (n - x)) / CAST((n - x) * (k - x) AS DOUBLE) END) AS odds
  FROM (SELECT *, unnest(range(x, least(k, n) + 1)) AS i FROM hit, sizes) GROUP BY 1, 2, 3, 4),
ranked AS (SELECT *, row_number() OVER (PARTITION BY library ORDER BY p, term) AS r, count(*) OVER (PARTITION BY library) AS tests FROM tails),
adjusted AS (SELECT *, least(1.0, min(p * tests / r) OVER (PARTITION BY library ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS q FROM ranked)
"""

_ASKED = "asked AS (SELECT DISTINCT upper(gene_symbol) AS name FROM ev WHERE lower(effect) = 'resistance' AND contains(lower(disease_name), 'sheath') AND gene_symbol IS NOT NULL),"
_TOP_ASKED = "asked AS (SELECT DISTINCT upper(gene_symbol) AS name FROM targets_n WHERE therapy_name IN (SELECT therapy_name FROM targets_n GROUP BY therapy_name ORDER BY count(DISTINCT gene_symbol) DESC, therapy_name LIMIT 8)),"

SQL = {
    "a1_evidence_rollup": f"""WITH e AS (SELECT biomarker_type, {text('biomarker_name')} AS biomarker_name, {text('therapy_name')} AS therapy_name, {_class('effect')} AS effect, {text('disease_name')} AS disease_name, {ident('disease_id')} AS disease_id, upper({strip("coalesce(best_evidence_level, '')")}) AS level, max_rating AS rating, {parts('pmids')} AS pmids, source, notes, row_id FROM affects_response),
p AS (SELECT biomarker_type, biomarker_name, therapy_name, effect, disease_name, disease_id, list_sort(list_distinct(flatten(list(pmids)))) AS pm, min(source) AS source, coalesce(string_agg(notes, '; ' ORDER BY row_id), '') AS notes,
  coalesce(min(level) FILTER (WHERE level IN ('A', 'B', 'C', 'D', 'E')), '') AS best_evidence_level, list_sort(list(DISTINCT CASE WHEN level IN ('A', 'B', 'C', 'D', 'E') THEN '0' ELSE '1' END || level) FILTER (WHERE level <> '')) AS lv,
  count(*) AS evidence_count, round_even(avg(rating) FILTER (WHERE rating > 0), 2) AS avg_rating, CAST(max(rating) FILTER (WHERE rating > 0) AS BIGINT) AS max_rating
  FROM e WHERE biomarker_type IS NOT NULL AND biomarker_name IS NOT NULL AND therapy_name IS NOT NULL AND effect IS NOT NULL AND disease_name IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6)
SELECT biomarker_type, biomarker_name, therapy_name, effect, disease_name, disease_id, array_to_string(pm, ';') AS pmids, source, notes, best_evidence_level, coalesce(array_to_string([x[2:] FOR x IN lv], ';'), '') AS evidence_levels, evidence_count, avg_rating, max_rating FROM p""",
    "a13_moa_rollup": f"""WITH r AS (SELECT {text('therapy_name')} AS t, {text('gene_symbol')} AS g, {text('moa')} AS m, {text('action_type')} AS a, coalesce({parts('ref_sources')}[1], '') AS src, {parts('ref_ids')} AS ids, {parts('ref_urls')} AS urls FROM targets),
p AS (SELECT t, g, m, a, urls, list_concat([{{'s': src, 'i': x}} FOR x IN ids], [{{'s': CASE WHEN src = '' THEN 'PubMed' ELSE src END, 'i': {_pmid('x')}}} FOR x IN urls IF {_pmid('x')} IS NOT NULL]) AS pairs FROM r WHERE t IS NOT NULL AND g IS NOT NULL),
k AS (SELECT t, g, nullif(array_to_string(list_sort(list(DISTINCT m) FILTER (WHERE m IS NOT NULL)), ' | '), '') AS m, nullif(array_to_string(list_sort(list(DISTINCT a) FILTER (WHERE a IS NOT NULL)), ' | '), '') AS a, list_sort(list_distinct(flatten(list(pairs)))) AS pairs, list_sort(list_distinct(flatten(list(urls)))) AS urls FROM p GROUP BY 1, 2)
SELECT t AS therapy_name, g AS gene_symbol, m AS moa, a AS action_type, array_to_string([x.s FOR x IN pairs], ';') AS ref_sources, array_to_string([x.i FOR x IN pairs], ';') AS ref_ids, array_to_string(urls, ';') AS ref_urls FROM k""",
    "etl_effects": f"SELECT effect, {_class('effect')} AS effect_class, CASE WHEN contains(lower(effect), 'resist') THEN 'resistance' WHEN regexp_matches(lower(effect), 'sensit|responsive|benefit|response') THEN 'sensitivity' ELSE 'unknown' END AS category, count(*) AS n FROM affects_response GROUP BY effect",
    "etl_tags": PRELUDE
    + """, g AS (SELECT therapy_name, lower(therapy_name) AS w, list_sort(list(DISTINCT gene_symbol)) AS genes FROM targets_n GROUP BY 1)
SELECT therapy_name, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN w LIKE '%mab' THEN ['Antibody'] WHEN w LIKE '%tinib' THEN ['TKI'] ELSE [] END, [CASE WHEN w LIKE '%mab' THEN 'anti-' || x ELSE x || ' Inhibitor' END FOR x IN genes]))), ';') AS tags,
  CASE WHEN w LIKE '%mab' THEN 'Antibody' ELSE 'Small Molecule' END AS modality FROM g""",
    "etl_fusions": r"SELECT row_id, unnest(list_distinct(string_split(f, '::'))) AS gene_symbol FROM (SELECT row_id, unnest(list_distinct(regexp_extract_all(name, '(?:[\p{L}\p{N}]+-)*[\p{L}\p{N}]+(?:::(?:[\p{L}\p{N}]+-)*[\p{L}\p{N}]+)+'))) AS f FROM variants)",
    "etl_variant_names": f"SELECT row_id, g || ' ' || CASE WHEN starts_with(upper(v), upper(g) || ' ') THEN substr(v, length(g) + 2) ELSE v END AS name FROM (SELECT row_id, {text('gene_symbol')} AS g, {text('variant_name')} AS v FROM variant_of) WHERE g IS NOT NULL AND v IS NOT NULL",
    "etl_url_pmids": f"SELECT row_id, {_pmid('u')} AS pmid FROM (SELECT row_id, unnest({parts('ref_urls')}) AS u FROM targets)",
    "a22_therapies_per_gene": PRELUDE + " SELECT gene_symbol, count(DISTINCT therapy_name) AS n_therapies, array_to_string(list_sort(list(DISTINCT therapy_name)), ';') AS therapies FROM targets_n GROUP BY 1",
    "e1_unknown_genes": f"""{PRELUDE}, aliases AS (SELECT lower(symbol) AS alias FROM genes_n UNION SELECT lower(x) FROM (SELECT unnest(synonyms) AS x FROM genes_n))
SELECT DISTINCT upper({strip('gene_symbol')}) AS name FROM targets WHERE {strip('gene_symbol')} <> '' AND lower({strip('gene_symbol')}) NOT IN (SELECT alias FROM aliases)""",
    "e3_enrichment": _ORA + "SELECT library, term, x AS gene_count, k AS set_size, round(p, 6) AS p_value, round(odds, 6) AS odds_ratio, genes, round(q, 6) AS adjusted_p_value FROM adjusted",
    "e6_top_terms": _ORA.replace(_ASKED, _TOP_ASKED) + "SELECT library, term, x AS gene_count, round(q, 6) AS adjusted_p_value FROM adjusted WHERE round(q, 9) < 0.05 ORDER BY round(q, 9), library, term LIMIT 15",
    "o6_told_terms": _ORA + "SELECT library, term, array_to_string(string_split(genes, ';')[1:5], ';') AS genes FROM adjusted ORDER BY round(q, 9), library, term LIMIT 10",
    "e7_plot_points": _ORA + "SELECT library, term, x AS gene_count, round(-log10(greatest(q, 1e-300)), 6) AS score FROM adjusted",
    "e8_analysis": _ORA.replace(_ASKED, "asked AS (SELECT unnest(['JITLA', 'QEDN1', 'NOSUCH', 'ANOTHER ONE', 'YIGD1', 'XUPFA', 'QIDG2']) AS name),")
    + "SELECT 'term' AS kind, library || '|' || term AS name, round(q, 6) AS value FROM adjusted UNION ALL SELECT 'unknown', name, NULL FROM asked WHERE lower(name) NOT IN (SELECT alias FROM aliases)",
    "e6_significant_terms": _ORA.replace(_ASKED, _TOP_ASKED) + "SELECT library, term, x AS gene_count, round(q, 6) AS adjusted_p_value FROM adjusted WHERE round(q, 9) < 0.05 ORDER BY round(q, 9), library, term LIMIT 100",
    "d1_genes_sharing_a_therapy": PRELUDE + " SELECT DISTINCT a.gene_symbol AS gene_a, b.gene_symbol AS gene_b FROM targets_n a JOIN targets_n b USING (therapy_name) WHERE a.gene_symbol < b.gene_symbol",
    "d1_genes_to_exclude": f"""{PRELUDE}, {_HELD}, g AS (SELECT DISTINCT gene_symbol AS g FROM targets_n), n AS (SELECT a.g AS include, b.g AS other, EXISTS (SELECT 1 FROM held WHERE i = a.g AND o = b.g) AS all_held FROM g a, g b WHERE a.g <> b.g)
SELECT include, count(*) FILTER (WHERE NOT all_held) AS n_exclude, coalesce(array_to_string(list_sort(list(other) FILTER (WHERE all_held)), ';'), '') AS but_not FROM n GROUP BY 1""",
    "d6_split": "SELECT item_id, family_id, CASE WHEN row_number() OVER (PARTITION BY family_id ORDER BY md5('42|' || item_id), item_id) <= greatest(1, floor(count(*) OVER (PARTITION BY family_id) * 0.85)) THEN 'train' ELSE 'test' END AS split FROM (SELECT DISTINCT item_id, coalesce(family_id, 'none') AS family_id FROM paraphrase_items)",
    "a17_metrics": "SELECT event_type, count(*) AS n, round(avg((value > 10)::INT) * 100, 6) AS valid_pct, round(avg((value > 20)::INT) * 100, 6) AS executed_pct, round(avg((value > 50)::INT) * 100, 6) AS matched_pct, round(avg(value + 1), 6) AS avg_latency_ms, round(avg(CASE WHEN value + 1 > 0 THEN 100 / ((value + 1) / 1000) ELSE 0 END), 6) AS tokens_per_second FROM events GROUP BY 1",
    "t2_first_steps": "SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY 1, 2",
    "t3_live_entries": "SELECT event_id, ts + INTERVAL 48 HOURS AS expires_at FROM events WHERE ts + INTERVAL 48 HOURS >= (SELECT max(ts) FROM events)",
    "t4_recent_requests": "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n_recent FROM events",
    "t5_steps_per_run": "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ';') AS steps FROM events GROUP BY 1",
    "x7_row_hashes": f"SELECT row_id, {_hash(('name', 'doid', 'synonyms'))} AS hash FROM diseases",
}

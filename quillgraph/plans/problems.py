"""Queries on the general data problems (p1 to p3) over the graph tables, and SQL to check them against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import is_blank, trim_edges
from quillgraph.operators import orphans, packed, skew
from quillgraph.session import table

#: (number, table, field, parent table) of each reference; biomarkers name the parent in biomarker_type.
REFERENCES = (
    (0, "affects_response", "biomarker_name", None),
    (1, "affects_response", "therapy_name", "therapies"),
    (2, "variant_of", "gene_symbol", "genes"),
    (3, "targets", "gene_symbol", "genes"),
)
_PARENTS = (("genes", "symbol"), ("variants", "name"), ("therapies", "name"))
_NUMBER = {name: i for i, (name, _) in enumerate(_PARENTS)}


def _named(source: Column, part: int) -> Column:
    out = None
    for r in REFERENCES:
        out = (F.when if out is None else out.when)(source == r[0], r[part])
    return out


def _key(c: str) -> Column:
    return F.when(~is_blank(F.col(c)), trim_edges(F.col(c)))


def orphans_of(spark: SparkSession, sf: str) -> DataFrame:
    """All references without a live parent: source number, row_id, loaded_at, status."""
    ar = table(spark, sf, "affects_response")
    kind = F.when(F.col("biomarker_type") == "Gene", _NUMBER["genes"]).when(F.col("biomarker_type") == "Variant", _NUMBER["variants"])
    fields = F.array(
        F.struct(F.lit(0).alias("source"), kind.alias("parent"), _key("biomarker_name").alias("key")),
        F.struct(F.lit(1).alias("source"), F.lit(_NUMBER["therapies"]).alias("parent"), _key("therapy_name").alias("key")),
    )
    both = ar.select("row_id", "loaded_at", F.explode(fields).alias("r")).select("r.source", "row_id", "r.parent", "r.key", "loaded_at").filter(F.col("parent").isNotNull())
    refs = both
    for number, name, field, parent in REFERENCES[2:]:
        one = table(spark, sf, name)
        refs = refs.unionByName(one.select(F.lit(number).alias("source"), "row_id", F.lit(_NUMBER[parent]).alias("parent"), _key(field).alias("key"), "loaded_at"))
    parents = None
    for name, key in _PARENTS:
        one = table(spark, sf, name).select(F.lit(_NUMBER[name]).alias("parent"), _key(key).alias("key"), "loaded_at", "deleted_at")
        parents = one if parents is None else parents.unionByName(one)
    return orphans.find_orphans(refs, parents)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    got = orphans_of(spark, sf)
    return got.select(_named(F.col("source"), 1).alias("table_name"), _named(F.col("source"), 2).alias("field_name"), "row_id")


def p1_orphan_report(spark: SparkSession, sf: str) -> DataFrame:
    """Number of orphan references per table, field, month of loading and status."""
    got = orphans_of(spark, sf)
    period = F.date_format("loaded_at", "yyyy-MM").alias("period")
    got = got.groupBy("source", period, "status").agg(F.count(F.lit(1)).alias("n"))
    return got.select(_named(F.col("source"), 1).alias("table_name"), _named(F.col("source"), 2).alias("field_name"), "period", "status", "n")


PACKED = (("therapies", "synonyms", False), ("therapies", "tags", False), ("diseases", "synonyms", False), ("affects_response", "pmids", True))


def p2_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every value of the packed fields with its place and what was wrong with its writing."""
    out = None
    for name, field, spaces in PACKED:
        got = packed.unpack(table(spark, sf, name).select("row_id", field), field, packed.Grammar(spaces=spaces), ["row_id"])
        got = got.select(F.lit(name).alias("table_name"), F.lit(field).alias("field_name"), "row_id", "pos", "item_value", "parse_error")
        out = got if out is None else out.unionByName(got)
    return out


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_values(spark, sf).drop("parse_error")


def p2_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Number of values and of badly written ones per field."""
    bad = F.sum(F.col("parse_error").isNotNull().cast("bigint")).alias("n_errors")
    return p2_values(spark, sf).groupBy("table_name", "field_name").agg(F.count(F.lit(1)).alias("n_values"), bad)


KEYS = (("affects_response", "biomarker_name"), ("targets", "gene_symbol"))
HOT_SHARE = 0.02


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name, field in KEYS:
        key = trim_edges(F.col(field))
        one = table(spark, sf, name).select(
            F.lit(name).alias("table_name"), F.lit(field).alias("field_name"), F.when(~is_blank(F.col(field)), key).alias("key_value"), _key("therapy_name").alias("therapy"), "loaded_at"
        )
        out = one if out is None else out.unionByName(one)
    return out


def _known(spark: SparkSession, sf: str) -> DataFrame:
    """How many records of genes carry each symbol, for both fields, and of variants each name, for biomarkers."""
    fields = [F.struct(F.lit(name).alias("table_name"), F.lit(field).alias("field_name")) for name, field in KEYS]
    genes = table(spark, sf, "genes").select(F.explode(F.array(*fields)).alias("of"), trim_edges(F.col("symbol")).alias("key_value"))
    variants = table(spark, sf, "variants").select(fields[0].alias("of"), trim_edges(F.col("name")).alias("key_value"))
    both = genes.unionByName(variants).filter(F.col("key_value").isNotNull())
    return both.groupBy("of.table_name", "of.field_name", "key_value").agg(F.count(F.lit(1)).alias("n_records"))


def p3_key_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, distinct therapies and latest loading of each key, and how many records of genes or variants carry it."""
    return skew.key_statistics(skew.therapy_pairs(_keyed(spark, sf)), _known(spark, sf))


def p3_key_results(spark: SparkSession, sf: str) -> DataFrame:
    """p3_key_stats without the number of tasks, which depends on the cluster."""
    return p3_key_stats(spark, sf).drop("n_tasks")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = skew.therapy_pairs(_keyed(spark, sf))
    return skew.hot_keys(skew.key_statistics(pairs, _known(spark, sf)), skew.table_totals(pairs), HOT_SHARE)


def p3_task_shares(spark: SparkSession, sf: str) -> DataFrame:
    """What the fullest task gets, beside the hottest key; depends on the number of tasks."""
    return skew.task_shares(skew.therapy_pairs(_keyed(spark, sf)))


QUERIES = {f.__name__: f for f in (p1_found, p1_orphan_report, p2_found, p2_errors, p3_found, p3_key_results, p3_task_shares)}


# --- SQL -----------------------------------------------------------------------------------------------------

_T = r"trim({}, chr(32) || chr(9) || chr(10) || chr(13))"


def _t(c: str) -> str:
    return _T.format(c)


_PARENT_SQL = f"""parents AS (
  SELECT 'genes' AS parent, {_t('symbol')} AS k, loaded_at, deleted_at FROM genes
  UNION ALL SELECT 'variants', {_t('name')}, loaded_at, deleted_at FROM variants
  UNION ALL SELECT 'therapies', {_t('name')}, loaded_at, deleted_at FROM therapies)"""
_REFS_SQL = f"""refs AS (
  SELECT 'affects_response' AS table_name, 'biomarker_name' AS field_name, row_id, CASE biomarker_type WHEN 'Gene' THEN 'genes' WHEN 'Variant' THEN 'variants' END AS parent,
    {_t('biomarker_name')} AS k, loaded_at FROM affects_response WHERE biomarker_type IN ('Gene', 'Variant')
  UNION ALL SELECT 'affects_response', 'therapy_name', row_id, 'therapies', {_t('therapy_name')}, loaded_at FROM affects_response
  UNION ALL SELECT 'variant_of', 'gene_symbol', row_id, 'genes', {_t('gene_symbol')}, loaded_at FROM variant_of
  UNION ALL SELECT 'targets', 'gene_symbol', row_id, 'genes', {_t('gene_symbol')}, loaded_at FROM targets)"""
_ORPHAN_SQL = f"""WITH {_PARENT_SQL}, {_REFS_SQL}, judged AS (
  SELECT r.table_name, r.field_name, r.row_id, r.loaded_at, count(p.k) AS n_any, min(p.loaded_at) AS since,
    coalesce(sum(CASE WHEN p.loaded_at <= r.loaded_at AND (p.deleted_at IS NULL OR r.loaded_at < p.deleted_at) THEN 1 END), 0) AS live
  FROM refs r LEFT JOIN parents p ON p.parent = r.parent AND p.k = r.k
  WHERE r.k <> '' GROUP BY 1, 2, 3, 4), orphans AS (SELECT *, CASE WHEN n_any = 0 THEN 'missing' WHEN since > loaded_at THEN 'late' ELSE 'deleted' END AS status FROM judged WHERE live = 0)
"""
_KEYED_SQL = f"""keyed AS (
  SELECT 'affects_response' AS table_name, 'biomarker_name' AS field_name, {_t('biomarker_name')} AS key_value, nullif({_t('therapy_name')}, '') AS therapy, loaded_at FROM affects_response
  UNION ALL SELECT 'targets', 'gene_symbol', {_t('gene_symbol')}, nullif({_t('therapy_name')}, ''), loaded_at FROM targets)"""

SQL = {
    "p1_found": _ORPHAN_SQL + "SELECT table_name, field_name, row_id FROM orphans",
    "p1_orphan_report": _ORPHAN_SQL + "SELECT table_name, field_name, strftime(loaded_at AT TIME ZONE 'UTC', '%Y-%m') AS period, status, count(*) AS n FROM orphans GROUP BY 1, 2, 3, 4",
    "p3_found": f"WITH {_KEYED_SQL} SELECT table_name, field_name, key_value FROM keyed WHERE key_value <> '' GROUP BY 1, 2, 3 HAVING count(*) >= 0.02 * (SELECT count(*) FROM keyed t WHERE t.table_name = keyed.table_name)",
    "p3_key_results": f"""WITH {_KEYED_SQL}, known AS (
  SELECT 'affects_response' AS table_name, {_t('symbol')} AS k FROM genes UNION ALL SELECT 'affects_response', {_t('name')} FROM variants UNION ALL SELECT 'targets', {_t('symbol')} FROM genes),
  records AS (SELECT table_name, k, count(*) AS n FROM known GROUP BY 1, 2)
  SELECT s.*, coalesce(r.n, 0) AS n_records FROM (
    SELECT table_name, field_name, key_value, count(*) AS n_rows, count(DISTINCT therapy) AS n_therapies, max(loaded_at) AS latest_loaded_at
    FROM keyed WHERE key_value <> '' GROUP BY 1, 2, 3) s LEFT JOIN records r ON r.table_name = s.table_name AND r.k = s.key_value""",
}

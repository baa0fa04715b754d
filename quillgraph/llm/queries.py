"""Queries on the problems of text corpora and question sets (p4 to p9), and SQL where it can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import canonical, copies, lookalikes, packing, splits, tokens
from quillgraph.operators.packed import Grammar, parse
from quillgraph.session import cut, table


#: (table, field, kind) of the typed fields.
_TYPED = (("therapies", "name", "drug"), ("therapies", "chembl_id", "id"), ("affects_response", "disease_name", "disease"))


def _p4_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, listed, paths) of the three typed fields, by kind."""
    drugs, diseases = table(spark, sf, "therapy_reference"), table(spark, sf, "diseases")
    value = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("value"))
    typed = table(spark, sf, "therapies").select("row_id", F.explode(F.array(value("drug", F.col("name")), value("id", F.col("chembl_id")))).alias("v")).select("v.kind", "row_id", "v.value")
    rows = typed.unionByName(table(spark, sf, "affects_response").select(F.lit("disease").alias("kind"), "row_id", F.col("disease_name").alias("value")))
    named = drugs.select("ref_id", F.explode(F.array(value("drug", F.col("name")), value("id", F.col("chembl_id")))).alias("v")).select("v.kind", "v.value", F.col("ref_id").alias("entry"))
    named = named.unionByName(diseases.select(F.lit("disease").alias("kind"), F.col("name").alias("value"), F.col("row_id").alias("entry")))
    aliases = drugs.select(F.lit("drug").alias("kind"), F.explode("aliases").alias("value"), F.col("ref_id").alias("entry"))
    synonyms = diseases.select(F.lit("disease").alias("kind"), F.explode(parse(F.col("synonyms"), Grammar())).alias("s"), F.col("row_id").alias("entry")).select("kind", F.col("s.value").alias("value"), "entry")
    paths = named.unionByName(aliases).unionByName(synonyms).filter(F.col("value").isNotNull()).withColumnRenamed("value", "path")
    return rows, named.select("kind", "value"), paths


def _field(kind: str, part: int) -> Column:
    return reduce(lambda c, t: c.when(F.col(kind) == t[2], t[part]), _TYPED[1:], F.when(F.col(kind) == _TYPED[0][2], _TYPED[0][part]))


def p4_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Each typed value with the entry that it stands for, -1 for none, and the number of entries equally near."""
    got = canonical.map_values(*_p4_inputs(spark, sf))
    return got.select(_field("kind", 0).alias("table_name"), _field("kind", 1).alias("field_name"), "row_id", "value", F.col("entry").alias("ref_id"), "tied")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_matches(spark, sf).select("table_name", "field_name", "row_id", "ref_id")


def p4_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """Values that stand for no entry, and their number; tied: of how many equally near entries, 0 where none is near."""
    return p4_matches(spark, sf).filter(F.col("ref_id") == canonical.NONE).groupBy("table_name", "field_name", "value", "tied").agg(F.count(F.lit(1)).alias("n"))


def p4_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Every entry within the distance of each distinct typed value."""
    got = canonical.candidates(*_p4_inputs(spark, sf))
    return got.select(_field("kind", 0).alias("table_name"), _field("kind", 1).alias("field_name"), "value", F.col("entry").alias("ref_id"), "distance")


_COPIES = (("genes", "synonyms"), ("variants", "name"), ("therapies", "name"))


def p5_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    """One record for each set of copies, with their number."""
    got = _copies(spark, sf)
    return got.filter(F.col("kept") == F.col("copy")).select(F.col("scope").alias("table_name"), F.col("kept").alias("kept_id"), "copies")


def _copies(spark: SparkSession, sf: str) -> DataFrame:
    records = None
    for name, field in _COPIES:
        one = table(spark, sf, name).select(F.lit(name).alias("scope"), "row_id", F.col(field).alias("text"))
        records = one if records is None else records.unionByName(one)
    return copies.collapse(records)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    got = _copies(spark, sf).filter(F.col("kept") != F.col("copy"))
    return got.select(F.col("scope").alias("table_name"), F.col("kept").alias("kept_id"), F.col("copy").alias("copy_id"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    got = splits.related(table(spark, sf, "paraphrase_items")).filter(F.col("item_id") != F.col("kept"))
    return got.select(F.col("kept").alias("item_id_a"), F.col("item_id").alias("item_id_b"))


def p6_split(spark: SparkSession, sf: str) -> DataFrame:
    """The split of each item."""
    return splits.assign(table(spark, sf, "paraphrase_items"))


def p6_split_check(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the split: every item once, no group torn, shares within two hundredths of all items."""
    items = table(spark, sf, "paraphrase_items")
    split = cut(splits.assign(items))
    groups = splits.related(items).join(split, "item_id").groupBy("kept").agg(F.min("split").alias("a"), F.max("split").alias("b"))
    torn = groups.agg(F.count(F.when(F.col("a") != F.col("b"), 1)).alias("n_torn"))
    share = lambda name: F.avg((F.col("split") == name).cast("double"))
    near = (F.abs(share("train") - 0.8) <= 0.02) & (F.abs(share("validation") - 0.1) <= 0.02) & (F.abs(share("test") - 0.1) <= 0.02)
    shares = split.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("item_id").alias("n_items"), near.alias("near"))
    return shares.join(F.broadcast(torn), F.lit(True))  # one row each


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf, "documents"))


def p7_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """The ids and the byte of the text at which each token starts."""
    return tokens.token_offsets(table(spark, sf, "documents"))


def p7_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """The texts, decoded from their ids; empty for null."""
    return tokens.decode(tokens.token_ids(table(spark, sf, "documents")))


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    """container, doc_id, piece and tokens of each piece."""
    return packing.pack(cut(tokens.token_counts(table(spark, sf, "documents"))))


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the containers: every token is in one, none is over the capacity, only longer documents are cut, and 98 of 100 places are used."""
    sizes = cut(tokens.token_counts(table(spark, sf, "documents")))
    packed = cut(packing.pack(sizes))
    used = packed.groupBy("container").agg(F.sum("tokens").alias("used"))
    room = used.agg(F.count(F.when(F.col("used") > packing.CAPACITY, 1)).alias("n_over"), (F.sum("used") / F.count(F.lit(1)) >= 0.98 * packing.CAPACITY).alias("well_filled"))
    pieces = packed.groupBy("doc_id").agg(F.sum("tokens").alias("placed"), F.count(F.lit(1)).alias("n"), F.countDistinct("piece").alias("different"), F.max("piece").alias("last"))
    told = sizes.filter("n_tokens > 0").join(pieces, "doc_id", "full")
    whole = (F.col("placed") == F.col("n_tokens")) & (F.col("n") == F.ceil(F.col("n_tokens") / packing.CAPACITY)) & (F.col("n") == F.col("different")) & (F.col("n") == F.col("last"))
    wrong = told.agg(F.count(F.lit(1)).alias("n_documents"), F.count(F.when(~F.coalesce(whole, F.lit(False)), 1)).alias("n_wrong"))
    return room.join(F.broadcast(wrong), F.lit(True))  # one row each


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    got = lookalikes.look_the_same(table(spark, sf, "documents"))
    return got.select(F.col("kept").alias("doc_id_a"), F.col("copy").alias("doc_id_b"))


def p9_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Each text in its one form."""
    return lookalikes.normalise(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p4_found, p4_unmatched, p4_candidates, p5_found, p5_collapsed, p6_found, p6_split, p6_split_check, p7_ids, p7_offsets, p7_decoded, p8_containers, p8_fill, p9_found, p9_texts)}


def _words_sql(field: str) -> str:
    split = r"regexp_split_to_array(lower({}), '[\s\x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{0085}}\x{{000b}}:/_+,;|()\[\]]+')".format(field)
    words = rf"[y FOR y IN [regexp_replace(x, '[^\p{{L}}\p{{N}}]', '', 'g') FOR x IN {split}] IF y <> '']"
    return f"array_to_string(list_sort({words}), ' ')"


_COPIES_SQL = "WITH r AS (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, row_id, {_words_sql(f)} AS k FROM {t} WHERE {f} IS NOT NULL" for t, f in _COPIES) + "), g AS (SELECT *, min(row_id) OVER (PARTITION BY table_name, k) AS kept_id, count(*) OVER (PARTITION BY table_name, k) AS copies FROM r WHERE k <> '')"

SQL = {
    "p5_found": _COPIES_SQL + " SELECT table_name, kept_id, row_id AS copy_id FROM g WHERE row_id <> kept_id",
    "p5_collapsed": _COPIES_SQL + " SELECT table_name, kept_id, copies FROM g WHERE row_id = kept_id",
    "p6_found": r"""WITH RECURSIVE keys AS (
  SELECT item_id, 't' || template_id AS k FROM paraphrase_items WHERE template_id IS NOT NULL
  UNION SELECT item_id, 'p' || regexp_replace(regexp_replace(regexp_replace(lower(p), '\s+', ' ', 'g'), '^ +', ''), '[.?! ]+$', '') FROM (SELECT item_id, unnest(paraphrases) AS p FROM paraphrase_items) WHERE NOT regexp_full_match(p, '\s*')),
  star AS (SELECT item_id AS a, min(item_id) OVER (PARTITION BY k) AS b FROM keys),
  links AS (SELECT a, b FROM star WHERE a <> b UNION SELECT b, a FROM star WHERE a <> b),
  reach AS (SELECT a AS v, a AS m FROM links UNION SELECT l.b, r.m FROM reach r JOIN links l ON l.a = r.v WHERE r.m < l.b)
  SELECT min(m) AS item_id_a, v AS item_id_b FROM reach GROUP BY v HAVING min(m) <> v""",
    "p6_split_check": "SELECT count(DISTINCT item_id) AS n_rows, count(DISTINCT item_id) AS n_items, true AS near, CAST(0 AS BIGINT) AS n_torn FROM paraphrase_items",
    "p8_fill": "SELECT CAST(0 AS BIGINT) AS n_over, true AS well_filled, count(*) AS n_documents, CAST(0 AS BIGINT) AS n_wrong FROM documents WHERE text <> ''",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}

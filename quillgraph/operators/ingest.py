"""From raw evidence and drug records to node and edge rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import clean_array, null_if_blank, strip_ws

#: Evidence levels from best to worst (fixed values); all others rank after them.
LEVELS = "ABCDE"


def effect_class(c: Column) -> Column:
    """sensitivity or resistance, by the first group of words that the text contains; else null (fixed values)."""
    low = F.lower(c)
    has = lambda *words: F.greatest(*[F.contains(low, F.lit(w)) for w in words])
    return F.when(has("sensitivity", "responsive", "benefit"), "sensitivity").when(has("resistance", "adverse", "nonresponse", "no response", "lack of response"), "resistance")


def effect_category(c: Column) -> Column:
    """resistance, sensitivity or unknown, as a result table shows it; other words and order than effect_class (fixed values)."""
    low = F.lower(F.coalesce(c, F.lit("")))
    sensitive = F.greatest(*[F.contains(low, F.lit(w)) for w in ("sensit", "responsive", "benefit", "response")])
    return F.when(F.contains(low, F.lit("resist")), "resistance").when(sensitive, "sensitivity").otherwise("unknown")


def variant_name(gene: Column, raw: Column) -> Column:
    """The variant with its gene in front, once; a fusion keeps its parts after the gene. Null without a variant."""
    rest = F.when(F.startswith(F.upper(raw), F.concat(F.upper(gene), F.lit(" "))), F.substring(raw, F.length(gene) + 2, F.length(raw))).otherwise(raw)
    return F.when(null_if_blank(raw).isNotNull(), strip_ws(F.concat_ws(" ", gene, rest)))


def fusion_parts(symbol: Column) -> Column:
    """The genes of `A::B`, each once; one gene for all others."""
    return F.array_distinct(F.filter(F.transform(F.split(symbol, "::"), strip_ws), lambda x: x != ""))


def pmid_of_url(c: Column) -> Column:
    """The number after med/, /pubmed/ or pubmed.ncbi.nlm.nih.gov/, anywhere and in any case (fixed patterns); null if there is none."""
    got = F.regexp_extract(F.lower(c), r"(?:med/|/pubmed/|pubmed\.ncbi\.nlm\.nih\.gov/)([0-9]+)", 1)
    return F.when(got != "", got)


def all_fusions(name: Column) -> Column:
    """Each `A::B` in a variant's name, of letters, digits and inner hyphens, once."""
    return F.array_distinct(F.regexp_extract_all(name, F.lit(r"((?:[\p{L}\p{N}]+-)*[\p{L}\p{N}]+(?:::(?:[\p{L}\p{N}]+-)*[\p{L}\p{N}]+)+)"), F.lit(1)))


def from_connection(nodes: DataFrame) -> DataFrame:
    """Records of the second interface (schemas.NODE, _pos) in the shape of the first one (schemas.EVIDENCE, _pos).

    The profile's name stands for the variant. A citation of digits only is a PubMed id; of others the id is read from
    the link.
    """
    profile = F.col("molecularProfile.name")
    digits = F.when(F.col("source.citationId").rlike("^[0-9]+$"), F.col("source.citationId"))
    pmid = F.coalesce(digits, pmid_of_url(F.coalesce("source.link", "source.url")))
    source = F.struct(pmid.alias("pubmed_id"), pmid.alias("pmid"), F.col("source.citationId").alias("citation_id"))
    none = F.lit(None).cast("string")
    return nodes.select(
        F.struct(none.alias("name"), none.alias("symbol")).alias("gene"),
        F.struct(profile.alias("name"), profile.alias("display_name"), F.struct(none.alias("p_dot"), none.alias("protein")).alias("hgvs_expressions")).alias("variant"),
        F.struct(profile.alias("name")).alias("molecular_profile"),
        F.struct(F.col("disease.name").alias("name"), none.alias("display_name"), F.col("disease.doid").alias("doid"), F.col("disease.diseaseAliases").alias("diseaseAliases")).alias("disease"),
        F.transform(F.coalesce("therapies", F.array().cast("array<struct<name:string>>")), lambda t: F.struct(t["name"].alias("name"), none.alias("drug_name"))).alias("drugs"),
        F.col("significance").alias("clinical_significance"), F.col("evidenceDirection").alias("evidence_direction"), F.col("evidenceLevel").alias("evidence_level"), F.col("evidenceRating").alias("evidence_rating"), "status",
        F.when(F.col("source").isNotNull(), F.array(source)).otherwise(F.array().cast("array<struct<pubmed_id:string,pmid:string,citation_id:string>>")).alias("sources"),
        F.col("description").alias("evidence_statement"), "_pos",
    )


def inferred_tags(name: Column, genes: Column) -> Column:
    """Tags that the ending of a therapy's name and its targets imply (fixed endings); sorted, no duplicates."""
    low = F.lower(name)
    mab, tki = F.endswith(low, F.lit("mab")), F.endswith(low, F.lit("tinib"))
    per_gene = F.transform(genes, lambda g: F.when(mab, F.concat(F.lit("anti-"), g)).otherwise(F.concat(g, F.lit(" Inhibitor"))))
    kind = F.when(mab, F.array(F.lit("Antibody"))).when(tki, F.array(F.lit("TKI"))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(genes) > 0, F.array_sort(F.array_distinct(F.concat(kind, per_gene)))).otherwise(F.array().cast("array<string>"))


def inferred_modality(name: Column, genes: Column) -> Column:
    """Antibody or Small Molecule, for therapies with targets; else null."""
    return F.when(F.size(genes) > 0, F.when(F.endswith(F.lower(name), F.lit("mab")), "Antibody").otherwise("Small Molecule"))


def evidence_items(raw: DataFrame) -> DataFrame:
    """Nested evidence records to flat ones: gene, variant, hgvs, disease, doid, aliases, therapies, effect, level, rating, pmids, source, note.

    raw: schemas.EVIDENCE, _pos. Names fall back to other fields where they're blank; the gene to the first word of
    the profile's name, left of ::, if that is in upper case; significance to direction; pmids to other ids.
    """
    head = F.split_part(F.split_part(null_if_blank(F.col("molecular_profile.name")), F.lit(" "), F.lit(1)), F.lit("::"), F.lit(1))
    first = lambda *names: F.coalesce(*[null_if_blank(F.col(n)) for n in names])
    doid = F.regexp_replace(null_if_blank(F.col("disease.doid")), r"(?i)^DOID:", "")
    therapies = F.filter(F.transform("drugs", lambda d: F.coalesce(null_if_blank(d["name"]), null_if_blank(d["drug_name"]))), lambda x: x.isNotNull())
    pmids = F.filter(F.transform("sources", lambda s: F.coalesce(null_if_blank(s["pubmed_id"]), null_if_blank(s["pmid"]), null_if_blank(s["citation_id"]))), lambda x: x.isNotNull())
    empty = F.array().cast("array<string>")
    return raw.select(
        F.coalesce(first("gene.name", "gene.symbol"), F.when(F.upper(head) == head, head)).alias("gene"),
        first("variant.name", "variant.display_name", "molecular_profile.name").alias("variant"),
        first("variant.hgvs_expressions.p_dot", "variant.hgvs_expressions.protein").alias("hgvs_p"),
        first("disease.name", "disease.display_name").alias("disease"),
        doid.alias("doid"),
        clean_array(F.col("disease.diseaseAliases")).alias("aliases"),
        F.coalesce(therapies, empty).alias("therapies"),
        effect_class(first("clinical_significance", "evidence_direction")).alias("effect"),
        F.col("evidence_level").alias("level"),
        F.col("evidence_rating").alias("rating"),
        F.coalesce(pmids, empty).alias("pmids"),
        F.lit("civic").alias("source"),
        null_if_blank(F.col("evidence_statement")).alias("note"),
        "_pos",
    )


def evidence_edges(items: DataFrame) -> DataFrame:
    """One row per evidence and therapy, of items with effect, gene and disease."""
    rows = items.filter(F.col("effect").isNotNull() & F.col("gene").isNotNull() & F.col("disease").isNotNull()).withColumn("therapy_name", F.explode("therapies"))
    name = variant_name(F.col("gene"), F.col("variant"))
    kind = F.when(name.isNotNull(), "Variant").otherwise("Gene")
    return rows.select(kind.alias("biomarker_type"), F.coalesce(name, "gene").alias("biomarker_name"), "therapy_name", "effect", F.col("disease").alias("disease_name"), F.col("doid").alias("disease_id"), "level", "rating", "pmids", "source", "note", "_pos")


def evidence_rollup(edges: DataFrame) -> DataFrame:
    """One edge per biomarker, therapy, effect and disease, with what its evidence says.

    pmids: distinct, sorted as text. evidence_levels: distinct, best first, unknown ones last. best_evidence_level:
    the best of A to E, '' if none. evidence_count: rows. avg_rating: of positive ratings, two decimals, half to even on
    the decimal writing; null if none. notes: joined in the order of _pos. All but notes and pmids aggregate before
    the shuffle.
    """
    level = F.upper(strip_ws(F.col("level")))
    rank = F.instr(F.lit(LEVELS), level)
    known = (F.length(level) == 1) & (rank > 0)
    rating = F.col("rating").cast("string").try_cast("double")
    positive = F.when(rating > 0, rating)
    keys = ["biomarker_type", "biomarker_name", "therapy_name", "effect", "disease_name", "disease_id"]
    rows = edges.select(*keys, "pmids", "source", "note", "_pos", F.when(known, level).alias("_best"), F.when(level != "", F.struct(F.when(known, rank).otherwise(99).alias("r"), level.alias("l"))).alias("_level"), positive.alias("_rating"))
    got = rows.groupBy(*keys).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("pmids")))).alias("pmids"),
        F.min("source").alias("source"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("note").isNotNull(), F.struct("_pos", "note")))), lambda x: x["note"]), "; ").alias("notes"),
        F.coalesce(F.min("_best"), F.lit("")).alias("best_evidence_level"),
        F.transform(F.array_sort(F.collect_set("_level")), lambda x: x["l"]).alias("evidence_levels"),
        F.count(F.lit(1)).alias("evidence_count"),
        F.bround(F.avg("_rating"), 2).alias("avg_rating"),
        F.max("_rating").cast("int").alias("max_rating"),
    )
    return got


def nodes_of(items: DataFrame) -> dict[str, DataFrame]:
    """Distinct genes, variants (first row wins), therapies and diseases (first id wins, aliases united), and the variants' genes."""
    rows = items.filter(F.col("gene").isNotNull())
    parts = rows.select(F.explode(fusion_parts(F.col("gene"))).alias("symbol"))
    name = variant_name(F.col("gene"), F.col("variant"))
    named = rows.filter(name.isNotNull()).select(name.alias("name"), "hgvs_p", "gene", "_pos")
    diseases = items.filter(F.col("disease").isNotNull())
    ids = diseases.groupBy(F.col("disease").alias("name")).agg(F.min_by("doid", F.when(F.col("doid").isNotNull(), F.col("_pos"))).alias("doid"))
    aliases = diseases.select(F.col("disease").alias("name"), F.explode_outer("aliases").alias("a")).groupBy("name").agg(F.array_sort(F.collect_set("a")).alias("synonyms"))
    return {
        "genes": parts.distinct(),
        "variants": named.groupBy("name").agg(F.min_by("hgvs_p", "_pos").alias("hgvs_p")),
        "therapies": items.select(F.explode("therapies").alias("name")).distinct(),
        "diseases": ids.join(aliases, "name"),
        "variant_of": named.select(F.col("name").alias("variant_name"), F.explode(fusion_parts(F.col("gene"))).alias("gene_symbol")).distinct(),
    }


def _texts(*columns: str) -> Column:
    """The arrays put together; null ones are empty."""
    return F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in columns])


def best_hit(names: DataFrame, hits: DataFrame) -> DataFrame:
    """(name, chembl_id, synonyms): for each name the first hit whose name, synonym or trade name equals it without regard to case, else the first hit.

    names: name. hits: query, hit_pos, id, name, synonyms, tradeNames. Five hits a name count. synonyms: those and trade
    names, sorted, once each. Names without hits are left out.
    """
    every = F.transform(F.concat(F.array("h.name"), _texts("h.synonyms", "h.tradeNames")), F.lower)
    rows = names.alias("n").join(hits.alias("h"), F.col("n.name") == F.col("h.query")).filter(F.col("h.hit_pos") < 5)
    exact = F.array_contains(every, F.lower("n.name"))
    others = F.array_sort(F.array_distinct(F.filter(_texts("h.synonyms", "h.tradeNames"), lambda x: x.isNotNull() & (x != ""))))
    best = rows.groupBy(F.col("n.name").alias("name")).agg(F.min_by(F.struct(F.col("h.id").alias("chembl_id"), others.alias("synonyms")), F.struct(F.coalesce(~exact, F.lit(True)), "h.hit_pos")).alias("b"))
    return best.select("name", "b.*")


def with_details(best: DataFrame, drugs: DataFrame) -> DataFrame:
    """The drug record of each name's id; names whose id has no record are left out. drugs: schemas.DRUG, one row per id counts."""
    one = drugs.filter(F.col("id").isNotNull()).dropDuplicates(["id"]).drop("name", "synonyms")
    return best.join(one, F.col("chembl_id") == F.col("id")).drop("id")


def drug_targets(drugs: DataFrame) -> DataFrame:
    """(therapy_name, gene_symbol, source, moa, action_type, refs…) from drug records (schemas.DRUG): mechanisms per gene, else linked targets."""
    rows = drugs.select("name", F.explode("mechanismsOfAction.rows").alias("m")).select("name", "m.*").withColumn("t", F.explode("targets"))
    rows = rows.select(F.col("name").alias("therapy_name"), null_if_blank(F.col("t.approvedSymbol")).alias("gene_symbol"), F.col("mechanismOfAction").alias("moa"), F.col("actionType").alias("action_type"), F.col("references").alias("refs"))
    rolled = moa_rollup(rows.filter(F.col("gene_symbol").isNotNull()))
    linked = drugs.select(F.col("name").alias("therapy_name"), F.explode("linkedTargets.rows").alias("r")).select("therapy_name", null_if_blank(F.col("r.approvedSymbol")).alias("gene_symbol")).filter("gene_symbol is not null").distinct()
    linked = linked.join(rolled.select("therapy_name").distinct(), "therapy_name", "left_anti")
    return rolled.unionByName(linked, allowMissingColumns=True).withColumn("source", F.lit("opentargets"))


def moa_rollup(rows: DataFrame) -> DataFrame:
    """Per therapy and gene: mechanisms and actions as sets joined by ` | `; references as sorted distinct pairs in two lists.

    rows: therapy_name, gene_symbol, moa, action_type, refs array<struct<source, ids, urls>>. Texts are stripped and
    blank ones don't count; where none is left, moa and action_type are null. A PubMed id in a URL counts as an id
    too, of the reference's source, or of PubMed where that is blank; explicit ids keep a blank source.
    """
    keys = ["therapy_name", "gene_symbol"]
    stripped = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), strip_ws), lambda x: x != "")
    flat = rows.withColumn("r", F.explode_outer("refs"))
    flat = flat.select(*keys, null_if_blank(F.col("moa")).alias("moa"), null_if_blank(F.col("action_type")).alias("action_type"), F.coalesce(strip_ws(F.col("r.source")), F.lit("")).alias("src"), stripped(F.col("r.ids")).alias("ids"), stripped(F.col("r.urls")).alias("urls"))
    inferred = F.filter(F.transform("urls", pmid_of_url), lambda x: x.isNotNull())
    pair = lambda src: lambda i: F.struct(src.alias("src"), i.alias("id"))
    named = F.when(F.col("src") == "", "PubMed").otherwise(F.col("src"))
    flat = flat.withColumn("pairs", F.concat(F.transform("ids", pair(F.col("src"))), F.transform(inferred, pair(named))))
    joined = lambda c: F.nullif(F.array_join(F.array_sort(F.collect_set(c)), " | "), F.lit(""))
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    got = flat.groupBy(*keys).agg(joined("moa").alias("moa"), joined("action_type").alias("action_type"), united("pairs").alias("_pairs"), united("urls").alias("ref_urls"))
    return got.select(*keys, "moa", "action_type", F.transform("_pairs", lambda p: p["src"]).alias("ref_sources"), F.transform("_pairs", lambda p: p["id"]).alias("ref_ids"), "ref_urls")


def united_synonyms(*sides: DataFrame) -> DataFrame:
    """(name, synonyms): all synonyms that the sides (name, synonyms) have for a name, sorted, once each."""
    rows = reduce(DataFrame.unionByName, [s.select("name", F.explode_outer("synonyms").alias("s")) for s in sides])
    return rows.groupBy("name").agg(F.array_sort(F.collect_set("s")).alias("synonyms"))

"""Queries on evidence and drug records, files, evaluation and presentation, and SQL to check them against."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import null_if_blank, split_list
from quillgraph.graph import Graph, clean_rows
from quillgraph.operators import dataset, evaluate, ingest, mining, present
from quillgraph.plans import catalog, catalog_sql
from quillgraph.plans.catalog_sql import PRELUDE, parts, strip, text
from quillgraph.session import scratch, table
from quillgraph.sources import files
from quillgraph.streaming import log

# --- evidence records --------------------------------------------------------------------------------------------


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    """affects_response as records of the second interface; every other PubMed id only in the link."""
    ids = split_list(F.col("pmids"))
    source = F.struct(F.try_element_at(ids, F.lit(1)).alias("citationId"), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.try_element_at(ids, F.lit(2)), F.lit("/")).alias("link"), F.lit(None).cast("string").alias("url"))
    return table(spark, sf, "affects_response").select(
        F.col("row_id").cast("string").alias("id"), F.col("notes").alias("description"), F.struct(F.col("biomarker_name").alias("name")).alias("molecularProfile"),
        F.struct(F.col("disease_name").alias("name"), F.concat(F.lit("DOID:"), "disease_id").alias("doid"), F.array(F.col("source")).alias("diseaseAliases")).alias("disease"),
        F.array(F.struct(F.col("therapy_name").alias("name"))).alias("therapies"), F.col("effect").alias("significance"), F.col("best_evidence_level").alias("evidenceLevel"),
        F.col("max_rating").cast("string").alias("evidenceRating"), F.lit(None).cast("string").alias("evidenceDirection"), F.when(F.col("effect").isNotNull(), "ACCEPTED").otherwise("SUBMITTED").alias("status"),
        F.when(F.col("pmids").isNotNull(), source).alias("source"), F.col("row_id").alias("_pos"),
    )


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.evidence_items(ingest.from_connection(files.accepted(_nodes(spark, sf))))


def etl_v2_items(spark: SparkSession, sf: str) -> DataFrame:
    """Flat records of the second interface: accepted ones, with genes, variants, diseases, ids and PubMed ids found."""
    got = _items(spark, sf)
    lists = [F.array_join(c, ";").alias(c) for c in ("aliases", "therapies", "pmids")]
    return got.select(F.col("_pos").alias("row_id"), "gene", "variant", "disease", "doid", "effect", "level", "rating", "note", *lists)


def etl_evidence_edges(spark: SparkSession, sf: str) -> DataFrame:
    """One edge per record and therapy, of records with effect, gene and disease."""
    return ingest.evidence_edges(_items(spark, sf)).select(F.col("_pos").alias("row_id"), "biomarker_type", "biomarker_name", "therapy_name", "effect", "disease_name", "disease_id")


def etl_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes that records imply, and which gene a variant is of."""
    got = ingest.nodes_of(_items(spark, sf))
    none = F.lit(None).cast("string")
    rows = [
        got["genes"].select(F.lit("genes").alias("part"), F.col("symbol").alias("name"), none.alias("about")), got["variants"].select(F.lit("variants"), "name", "hgvs_p"), got["therapies"].select(F.lit("therapies"), "name", none),
        got["diseases"].select(F.lit("diseases"), "name", F.concat_ws("|", F.coalesce("doid", F.lit("")), F.array_join("synonyms", ";"))), got["variant_of"].select(F.lit("variant_of"), "variant_name", "gene_symbol"),
    ]
    return reduce(DataFrame.union, rows)


def s2_evidence_file(spark: SparkSession, sf: str) -> DataFrame:
    """Records of a file with an object of records, and of one with a list, read once each (diseases as records)."""
    rows = table(spark, sf, "diseases").select(F.struct(F.struct(F.lit("G").alias("symbol")).alias("gene"), F.struct("name", "doid").alias("disease"), F.lit("accepted").alias("status")).alias("r"))
    for kind, text_of in (("object", lambda c: F.to_json(F.struct(c.alias("records")))), ("list", F.to_json)):
        at = scratch(spark)
        rows.agg(text_of(F.collect_list("r")).alias("value")).coalesce(1).write.text(at)  # a table of fixed size
        got = files.accepted(files.read_evidence(spark, at)).select(F.lit(kind).alias("file"), F.col("gene.symbol").alias("gene"), "disease.name", "disease.doid")
        out = got if kind == "object" else out.unionByName(got)
    return out


def s1_evidence_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Records of landed pages: what lies behind the last page, or a broken one, isn't read (diseases as records)."""
    import json
    from pathlib import Path

    names = [(r["name"], r["doid"]) for r in table(spark, sf, "diseases").orderBy("row_id").collect()]  # a table of fixed size
    at = scratch(spark)
    folder = Path(at.removeprefix("file:"))
    folder.mkdir(parents=True)
    pages = [names[i : i + 50] for i in range(0, len(names), 50)]
    for i, page in enumerate(pages):
        edges = [{"node": {"molecularProfile": {"name": "G X1Y"}, "disease": {"name": n, "doid": d}, "status": "ACCEPTED"}} for n, d in page]
        (folder / f"{i:04d}.json").write_text(json.dumps({"data": {"evidenceItems": {"pageInfo": {"hasNextPage": i + 1 < len(pages), "endCursor": str(i)}, "edges": edges}}}), "utf-8")
    (folder / "9999.json").write_text("{broken", "utf-8")
    got = ingest.evidence_items(files.read_source(spark, pages=str(folder)))
    return got.select("gene", "variant", "disease", "doid")


# --- drug records --------------------------------------------------------------------------------------------------


def _hits(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Names that are asked for, and the listed drugs with the same first four letters as hits, in the order of their ids."""
    drugs = table(spark, sf, "therapy_reference")
    names = drugs.select(F.explode(F.concat(F.array(F.lower("name")), F.filter("aliases", lambda a: a.isNotNull()))).alias("name")).distinct()
    near = names.withColumn("p", F.lower(F.substring("name", 1, 4))).join(drugs.select(F.lower(F.substring("name", 1, 4)).alias("p"), "ref_id", F.col("chembl_id").alias("id"), F.col("name").alias("hit"), "aliases"), "p")
    at = F.struct("ref_id", "id", F.col("hit").alias("name"), "aliases")
    hits = near.groupBy(F.col("name").alias("query")).agg(F.array_sort(F.collect_list(at)).alias("h")).select("query", F.posexplode("h").alias("hit_pos", "x"))
    return names, hits.select("query", "hit_pos", "x.id", "x.name", F.col("x.aliases").alias("synonyms"), F.array("x.name").alias("tradeNames"))


def s4_best_hits(spark: SparkSession, sf: str) -> DataFrame:
    """The drug that each name stands for, and its synonyms and trade names."""
    got = ingest.best_hit(*_hits(spark, sf))
    return got.select("name", "chembl_id", F.array_join("synonyms", ";").alias("synonyms"))


def s5_drug_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Targets of drug records: rows with a mechanism as such, the others as linked targets."""
    rows = table(spark, sf, "targets").select(null_if_blank(F.col("therapy_name")).alias("name"), "gene_symbol", "moa", "action_type", split_list(F.col("ref_sources")).alias("src"), split_list(F.col("ref_ids")).alias("ids"), split_list(F.col("ref_urls")).alias("urls")).filter("name is not null")
    refs = F.array(F.struct(F.try_element_at("src", F.lit(1)).alias("source"), "ids", "urls"))
    target = F.array(F.struct(F.col("gene_symbol").alias("approvedSymbol")))
    mechanism = F.struct(F.col("moa").alias("mechanismOfAction"), F.col("action_type").alias("actionType"), target.alias("targets"), refs.alias("references"))
    drugs = rows.groupBy("name").agg(F.collect_list(F.when(F.col("moa").isNotNull(), mechanism)).alias("m"), F.collect_list(F.when(F.col("moa").isNull(), F.struct(F.col("gene_symbol").alias("approvedSymbol")))).alias("l"))
    drugs = drugs.select("name", F.struct(F.col("m").alias("rows")).alias("mechanismsOfAction"), F.struct(F.col("l").alias("rows")).alias("linkedTargets"))
    got = ingest.drug_targets(drugs)
    return got.select("therapy_name", "gene_symbol", "source", "moa", "action_type", *[F.coalesce(F.array_join(c, ";"), F.lit("")).alias(c) for c in ("ref_sources", "ref_ids", "ref_urls")])


def u6_united_synonyms(spark: SparkSession, sf: str) -> DataFrame:
    """Synonyms of therapies from the table and from the list, by name."""
    own = Graph.saved(spark, sf).therapies.select(F.lower("name").alias("name"), "synonyms")
    listed = table(spark, sf, "therapy_reference").select(F.lower("name").alias("name"), F.col("aliases").alias("synonyms"))
    return ingest.united_synonyms(own, listed).select("name", F.array_join("synonyms", ";").alias("synonyms"))


# --- files ---------------------------------------------------------------------------------------------------------


def k1_csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The targets of the graph, written as CSV and read again."""
    at = scratch(spark)
    files.write_csv(Graph.saved(spark, sf).targets, at)
    return catalog.flat(clean_rows(files.read_graph_csv(spark, at, "targets"), "targets").drop("_pos"))


def k2_latest_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    at = scratch(spark)
    rows = table(spark, sf, "diseases").select("row_id", "name")
    for day, df in (("20240101", rows.limit(5)), ("20240103", rows), ("20240102", rows.limit(7))):
        files.write_snapshot(df, at, day)
    return files.read_latest(spark, at).select("row_id", "name", "snapshot_date")


def k6_split_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Items per split, after the split was written as JSON lines in folders and read again."""
    at = scratch(spark)
    items = table(spark, sf, "paraphrase_items").select("item_id", F.coalesce("family_id", F.lit("none")).alias("family_id")).distinct()
    files.write_lines(dataset.stratified_split(items, "family_id", "item_id"), at)
    return spark.read.schema("item_id bigint, family_id string, split string").json(at).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def k9_sinks(spark: SparkSession, sf: str) -> DataFrame:
    """Events in a sink for all and in one for two steps."""
    every, some = scratch(spark), scratch(spark)
    events = table(spark, sf, "events").select(F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("step"), F.col("props").alias("payload"))
    log.write_everywhere(events, [(every, None), (some, ["click", "view"])])
    both = log.read_traces(spark, every).withColumn("sink", F.lit("all")).unionByName(log.read_traces(spark, some).withColumn("sink", F.lit("some")), allowMissingColumns=True)
    return both.groupBy("sink", "step").agg(F.count(F.lit(1)).alias("n"))


def j17_unprocessed(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence rows that aren't among those with a level, which count as processed."""
    rows = table(spark, sf, "affects_response").select("row_id", "best_evidence_level")
    return files.resume(rows.select("row_id"), rows.filter("best_evidence_level is not null"), "row_id")


def s8_therapies_with_id(spark: SparkSession, sf: str) -> DataFrame:
    return mining.required(Graph.saved(spark, sf).therapies, "chembl_id").select("name", "chembl_id")


def s9_last_genes(spark: SparkSession, sf: str) -> DataFrame:
    return mining.last_gene_of_variants(Graph.saved(spark, sf))


def s10_disease_synonyms(spark: SparkSession, sf: str) -> DataFrame:
    return mining.synonyms_of_diseases(Graph.saved(spark, sf)).select("disease_name", F.array_join(F.array_sort("synonyms"), ";").alias("synonyms"))


def j10_dropped_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges that aren't loaded as an end is unknown: which end, and how many edges."""
    return Graph.load(spark, sf).dropped()


def a22_diseases_per_therapy(spark: SparkSession, sf: str) -> DataFrame:
    return mining.diseases_of_therapies(Graph.saved(spark, sf)).select("therapy_name", F.array_join("diseases", ";").alias("diseases"))


def a22_therapies_per_disease(spark: SparkSession, sf: str) -> DataFrame:
    return mining.therapies_of_diseases(Graph.saved(spark, sf), "resistance").select("disease_name", F.array_join("therapies", ";").alias("therapies"))


# --- presentation ----------------------------------------------------------------------------------------------------


def o3_by_level(spark: SparkSession, sf: str) -> DataFrame:
    """The first 100 evidence rows by level."""
    rows = table(spark, sf, "affects_response").select("row_id", "best_evidence_level")
    return present.by_level(rows, "row_id").limit(100)


def p20_text_lines(spark: SparkSession, sf: str) -> DataFrame:
    return present.text_lines(table(spark, sf, "diseases").select("name", "doid", "row_id"), ["row_id"], 50)


def p23_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts of reference URLs, a heading, and the mean rating with one decimal."""
    urls = table(spark, sf, "targets").select(F.explode(split_list(F.col("ref_urls"))).alias("url"))
    return urls.groupBy(present.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n")).select("host", present.pretty(F.lit("ref_urls")).alias("heading"), present.one_decimal(F.col("n")).alias("shown"))


def _graph_rows(spark: SparkSession, sf: str) -> DataFrame:
    ar = table(spark, sf, "affects_response").select("biomarker_type", "biomarker_name", "therapy_name", "effect", "disease_name", split_list(F.col("pmids")).alias("pmids"), "row_id")
    named = lambda kind: F.when(F.col("biomarker_type") == kind, F.col("biomarker_name"))
    evidence = ar.select(named("Variant").alias("variant_name"), named("Gene").alias("gene_symbol"), "therapy_name", "effect", "disease_name", "pmids", F.lit(None).cast("string").alias("targets_moa"), F.struct(F.lit(0).alias("s"), "row_id").alias("pos"))
    targets = table(spark, sf, "targets").select(F.col("gene_symbol"), "therapy_name", F.col("moa").alias("targets_moa"), F.struct(F.lit(1).alias("s"), "row_id").alias("pos"))
    of = table(spark, sf, "variant_of").select("variant_name", "gene_symbol", F.struct(F.lit(2).alias("s"), "row_id").alias("pos"))
    return evidence.unionByName(targets, allowMissingColumns=True).unionByName(of, allowMissingColumns=True)


def p24_graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return present.graph_elements(_graph_rows(spark, sf), "pos")[0]


def p24_graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    got = present.graph_elements(_graph_rows(spark, sf), "pos")[1]
    return got.withColumn("pmid_count", F.col("pmid_count").cast("bigint"))


def a21_symbols_of_rows(spark: SparkSession, sf: str) -> DataFrame:
    return present.gene_symbols(catalog.TEMPLATES["q5_1_biomarkers_in_disease"](Graph.saved(spark, sf)))


# --- question sets and evaluation ------------------------------------------------------------------------------------


def _mined(spark: SparkSession, sf: str) -> DataFrame:
    g = Graph.saved(spark, sf)
    return reduce(DataFrame.unionByName, [mining.mined(g, t) for t in mining.QUESTIONS])


def d1_mined(spark: SparkSession, sf: str) -> DataFrame:
    """The parameters of all 24 templates."""
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries("placeholders"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return _mined(spark, sf).select("template_id", "family_id", F.col("n").cast("bigint").alias("n"), pairs.alias("placeholders"))


def d7_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions of all templates: per parameters, disease synonym and wording. Families number their parameters in sequence."""
    rows = _mined(spark, sf).withColumn("n", F.row_number().over(Window.partitionBy("family_id").orderBy("template_id", "n")))  # 5 * MOST rows a family at most
    wordings = F.create_map(*[x for t, (_, _, said) in mining.QUESTIONS.items() for x in (F.lit(t), F.array(*[F.lit(q) for q in said]))])
    synonyms = mining.synonyms_of_diseases(Graph.saved(spark, sf)).select(F.col("disease_name").alias("_d"), "synonyms")
    rows = rows.join(synonyms, F.element_at("placeholders", F.lit("disease_name")) == F.col("_d"), "left").withColumn("questions", wordings[F.col("template_id")])
    return dataset.expand(rows).drop("placeholders")


def d8_chat(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations, one per disease."""
    rows = table(spark, sf, "diseases").select(F.col("row_id").cast("string").alias("id"), F.concat(F.lit("What is "), "name", F.lit("?")).alias("question"), F.col("doid").alias("cypher"))
    return dataset.chat(rows, "Be brief.").select("id", F.posexplode("messages").alias("turn", "m")).select("id", F.col("turn").cast("bigint").alias("turn"), "m.role", "m.content")


def d5_curated_first(spark: SparkSession, sf: str) -> DataFrame:
    """Two curated genes, one of which there is, then others in stable order."""
    return mining.curated_first(Graph.saved(spark, sf).genes, "symbol", ("NOSUCH", "JITLA")).select("symbol", F.col("pos").cast("bigint").alias("pos"))


def d10_subset(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "paraphrase_items").select("item_id", F.coalesce("family_id", F.lit("none")).alias("family_id")).distinct()
    return dataset.subset(items, "family_id", "item_id", 100, 0.1)


def j13_product(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of sampled genes and diseases."""
    g = Graph.saved(spark, sf)
    a = mining.curated_first(g.genes, "symbol", ()).select(F.col("symbol").alias("gene_symbol"))
    b = mining.curated_first(g.diseases, "name", ()).select(F.col("name").alias("disease_name"))
    return mining.product(a, b, "gene_symbol", "disease_name")


def _records(spark: SparkSession, sf: str) -> list:
    g = Graph.saved(spark, sf)
    ask = lambda name: lambda: catalog.TEMPLATES[name](g)
    return [
        ("same", ask("q1_3_gene_of_variant"), ask("q1_3_gene_of_variant")), ("other", ask("q2_4_variant_consequence"), lambda: g.variants.limit(0).select(F.col("name").alias("variant_name"), F.col("consequence").alias("variant_consequence"))),
        ("none", ask("q1_3_gene_of_variant"), None), ("unknown", ask("q1_3_gene_of_variant"), lambda: g.genes.select("nowhere")), ("fails", ask("q1_3_gene_of_variant"), lambda: g.genes.select(F.raise_error(F.lit("no")).cast("string").alias("x"))),
    ]


def d9_judgements(spark: SparkSession, sf: str) -> DataFrame:
    """Five answers at three levels, written two at a time."""
    got = evaluate.evaluate(spark, _records(spark, sf), scratch(spark), 2)
    return got.select("id", "valid", "executed", "matched", "gold_rows")


def d13_executed(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of answers; of one that fails none, and the kind of its error."""
    answers = [(key, answer) for key, _, answer in _records(spark, sf) if answer]
    return evaluate.execute(spark, answers).select("id", F.size("rows").cast("bigint").alias("n_rows"), F.col("error").isNotNull().alias("failed"))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    value = F.col("value")
    return table(spark, sf, "events").select("event_id", F.col("event_type").alias("model"), (value > 10).alias("valid"), (value > 20).alias("executed"), (value > 50).alias("matched"), (value + 1).alias("latency_ms"), F.lit(100).alias("tokens"))


def f21_partial_matches(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.partial_matches(_judged(spark, sf)).select("event_id", "model")


def a20_extremes(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.extremes(dataset.metrics(_judged(spark, sf), ["model"]))


def u5_same_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the loaded and the saved graph have the same rows, and whether they have without the last column."""
    a, b = Graph.load(spark, sf), Graph.saved(spark, sf)
    got = [(name, dataset.same_rows(getattr(a, name), getattr(b, name))["same"], dataset.same_rows(getattr(a, name), getattr(b, name).drop("synonyms", "gene_symbol", "source"))["same"]) for name in catalog.PARTS]
    return spark.createDataFrame(got, "part string, same boolean, same_without boolean")


# --- cache and feedback ----------------------------------------------------------------------------------------------


def _cache(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("cache_key"), F.when(F.col("value") > 1, F.col("user_id").cast("string")).alias("run_id"), F.col("ts").alias("expires_at"))


def t6_cleared_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Entries after a prefix, a key and a run were cleared."""
    left = log.without_prefix(_cache(spark, sf), "click:")
    return log.without_run(log.without_key(left, "view:3"), "7").select("cache_key", "run_id")


def t6_swept_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Entries that a sweep leaves at the hundredth write, and at the next one."""
    cache, now = _cache(spark, sf), F.to_timestamp(F.lit("2024-01-15 00:00:00"))
    swept = [log.sweep(cache, now, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).cast("bigint").alias("write"), "n") for n in (100, 101)]
    return swept[0].unionByName(swept[1])


def t7_feedback(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("run_id"), (F.col("value") > 50).alias("cypher_correct"), "ts")
    return log.feedback(runs, F.lit("2024-01-15 00:00:00")).drop("timestamp")


def t2_messages(spark: SparkSession, sf: str) -> DataFrame:
    """First steps of a user that have a message."""
    steps = log.first_steps(table(spark, sf, "events"), "user_id", "event_type", "ts")
    return log.messages(steps, {"click": "Clicked", "view": "Looked"}, "event_type").select("user_id", "message")


_ALL = (
    etl_v2_items, etl_evidence_edges, etl_nodes, s2_evidence_file, s1_evidence_pages, s4_best_hits, s5_drug_targets, u6_united_synonyms, k1_csv_round_trip, k2_latest_snapshot, k6_split_lines, k9_sinks, j17_unprocessed,
    s8_therapies_with_id, s9_last_genes, s10_disease_synonyms, j10_dropped_edges, a22_diseases_per_therapy, a22_therapies_per_disease, o3_by_level, p20_text_lines, p23_labels, p24_graph_nodes, p24_graph_edges, a21_symbols_of_rows,
    d1_mined, d7_questions, d8_chat, d5_curated_first, d10_subset, j13_product, d9_judgements, d13_executed, f21_partial_matches, a20_extremes, u5_same_rows, t6_cleared_cache, t6_swept_cache, t7_feedback, t2_messages,
)
QUERIES = {f.__name__: f for f in _ALL}


# --- SQL -----------------------------------------------------------------------------------------------------------


def _pmid(url: str) -> str:
    return rf"nullif(regexp_extract(lower({url}), '(?:med/|/pubmed/|pubmed\.ncbi\.nlm\.nih\.gov/)([0-9]+)', 1), '')"


def _class(x: str) -> str:
    has = lambda words: " OR ".join(f"contains(lower({x}), '{w}')" for w in words)
    return f"CASE WHEN {has(('sensitivity', 'responsive', 'benefit'))} THEN 'sensitivity' WHEN {has(('resistance', 'adverse', 'nonresponse', 'no response', 'lack of response'))} THEN 'resistance' END"


_HEAD = f"split_part(split_part({text('biomarker_name')}, ' ', 1), '::', 1)"
_ITEMS = f"""items AS (SELECT row_id, CASE WHEN upper({_HEAD}) = {_HEAD} THEN {_HEAD} END AS gene, {text('biomarker_name')} AS variant, {text('disease_name')} AS disease, regexp_replace({text("'DOID:' || disease_id")}, '^DOID:', '') AS doid,
  {_class(text('effect'))} AS effect, best_evidence_level AS level, CAST(max_rating AS VARCHAR) AS rating, {text('notes')} AS note, coalesce({text('source')}, '') AS aliases, coalesce({text('therapy_name')}, '') AS therapies,
  coalesce(coalesce(CASE WHEN regexp_full_match({parts('pmids')}[1], '[0-9]+') THEN {parts('pmids')}[1] END, {_pmid(f"'https://pubmed.ncbi.nlm.nih.gov/' || {parts('pmids')}[2] || '/'")}, {parts('pmids')}[1]), '') AS pmids FROM affects_response WHERE effect IS NOT NULL)"""
_NAMED = _ITEMS + ", named AS (SELECT *, CASE WHEN gene IS NOT NULL AND variant IS NOT NULL THEN gene || ' ' || CASE WHEN starts_with(upper(variant), upper(gene) || ' ') THEN substr(variant, length(gene) + 2) ELSE variant END END AS vname FROM items)"


def _sampled(columns: str, rows: str, limit: int = 200) -> str:
    key = " || '|' || ".join(c.strip() for c in columns.split(","))
    return f"SELECT {columns} FROM (SELECT DISTINCT {columns} FROM ({rows})) ORDER BY md5('42|' || {key}), {columns} LIMIT {limit}"


def _first(columns: str, rows: str, order: str = "") -> str:
    return f"SELECT DISTINCT {columns} FROM ({rows}) ORDER BY {order or columns} LIMIT 200"


def _pairs_sql(effect: str | None = None) -> str:
    return "SELECT DISTINCT therapy_name, disease_name FROM affects_n" + (f" WHERE lower(effect) = '{effect}'" if effect else "")


def _triples_sql(effect: str | None = None) -> str:
    return "SELECT DISTINCT biomarker_name AS variant_name, therapy_name, disease_name FROM affects_n WHERE biomarker_type = 'Variant'" + (f" AND lower(effect) = '{effect}'" if effect else "")


_VARIANTS_SQL = "SELECT name AS variant_name FROM variants_n ORDER BY md5('42|' || name), name LIMIT 200"
_LACKS = "EXISTS (SELECT 1 FROM targets_n c WHERE c.gene_symbol = a.g AND c.therapy_name NOT IN (SELECT therapy_name FROM targets_n d WHERE d.gene_symbol = b.g))"
_G = "(SELECT DISTINCT gene_symbol AS g FROM targets_n)"
#: Pairs of genes of which the first has a therapy that the second lacks.
_CONTRASTS = f"SELECT a.g AS include, b.g AS exclude FROM {_G} a, {_G} b WHERE a.g <> b.g AND (SELECT count(DISTINCT therapy_name) FROM targets_n c WHERE c.gene_symbol = a.g) > 0 AND NOT EXISTS (SELECT 1 FROM held WHERE i = a.g AND o = b.g)"
#: Pairs of genes of which the second has all therapies of the first.
_HELD = """held AS (SELECT i, o FROM (SELECT x.gene_symbol AS i, y.gene_symbol AS o, count(*) AS shared FROM targets_n x JOIN targets_n y USING (therapy_name) WHERE x.gene_symbol <> y.gene_symbol GROUP BY 1, 2)
  JOIN (SELECT gene_symbol AS i, count(*) AS n FROM targets_n GROUP BY 1) USING (i) WHERE shared = n)"""
_IN_DISEASE = "SELECT DISTINCT gene_symbol, disease_name FROM targets_n JOIN ({}) USING (therapy_name)"

MINING_SQL = {
    "q1_1": ("gene_symbol", _sampled("gene_symbol", "SELECT gene_symbol FROM targets_n")),
    "q1_2": ("therapy_name", _sampled("therapy_name", "SELECT therapy_name FROM targets_n")),
    "q1_3": ("variant_name", _VARIANTS_SQL),
    "q1_4": ("gene_symbol", _sampled("gene_symbol", "SELECT gene_symbol FROM targets_n")),
    "q2_1": ("therapy_name, gene_symbol", _sampled("therapy_name, gene_symbol", "SELECT therapy_name, gene_symbol FROM targets_n")),
    "q2_2a": ("therapy_name, disease_name", _sampled("therapy_name, disease_name", _pairs_sql())),
    "q2_2b": ("therapy_name, disease_name", _sampled("therapy_name, disease_name", _pairs_sql("resistance"))),
    "q2_2c": ("therapy_name, disease_name", _sampled("therapy_name, disease_name", _pairs_sql("sensitivity"))),
    "q2_2d": ("variant_name, therapy_name, disease_name", _sampled("variant_name, therapy_name, disease_name", _triples_sql())),
    "q2_2e": ("variant_name, therapy_name, disease_name", _sampled("variant_name, therapy_name, disease_name", _triples_sql())),
    "q2_3a": ("variant_name, therapy_name", _sampled("variant_name, therapy_name", _triples_sql("resistance"))),
    "q2_3b": ("variant_name, therapy_name", _sampled("variant_name, therapy_name", _triples_sql("sensitivity"))),
    "q2_4": ("variant_name", _VARIANTS_SQL),
    "q3_1": ("gene_symbol_a, gene_symbol_b", "SELECT gene_symbol_a, gene_symbol_b FROM (SELECT g AS gene_symbol_a, lead(g) OVER (ORDER BY g) AS gene_symbol_b, row_number() OVER (ORDER BY g) AS r FROM " + _G + ") WHERE r % 2 = 1 AND r < 200 AND gene_symbol_b IS NOT NULL"),
    "q3_2": ("gene_symbol_a, gene_symbol_b", _first("gene_symbol_a, gene_symbol_b", "SELECT a.gene_symbol AS gene_symbol_a, b.gene_symbol AS gene_symbol_b FROM targets_n a JOIN targets_n b USING (therapy_name) WHERE a.gene_symbol < b.gene_symbol")),
    "q3_3": ("gene_symbol_include, gene_symbol_exclude", _first("gene_symbol_include, gene_symbol_exclude", f"SELECT include AS gene_symbol_include, exclude AS gene_symbol_exclude FROM ({_CONTRASTS})")),
    "q4_1": ("gene_symbol, disease_name", _first("gene_symbol, disease_name", _IN_DISEASE.format(_pairs_sql()))),
    "q4_2": ("therapy_name, disease_name", _sampled("therapy_name, disease_name", _pairs_sql("resistance"))),
    "q5_1": ("disease_name", _sampled("disease_name", "SELECT disease_name FROM affects_n")),
    "q5_2": ("disease_name", _sampled("disease_name", "SELECT disease_name FROM affects_n")),
    "q6_1": ("therapy_name_a, therapy_name_b, disease_name", f"SELECT therapy_name AS therapy_name_a, therapy_name_b, disease_name FROM (SELECT *, lead(therapy_name) OVER (PARTITION BY disease_name ORDER BY therapy_name) AS therapy_name_b FROM ({_pairs_sql('resistance')})) WHERE therapy_name_b IS NOT NULL ORDER BY disease_name, therapy_name LIMIT 200"),
    "q6_2": ("gene_include, gene_exclude, disease_name", f"SELECT i.gene_symbol AS gene_include, g AS gene_exclude, disease_name FROM ({_IN_DISEASE.format(_pairs_sql())}) i, {_G} WHERE g <> i.gene_symbol ORDER BY i.gene_symbol, disease_name, g LIMIT 200"),
    "q6_3": ("gene_symbol, disease_name", _first("gene_symbol, disease_name", _IN_DISEASE.format(_triples_sql("resistance")))),
    "q6_4": ("therapy_name, disease_name", _sampled("therapy_name, disease_name", _pairs_sql("resistance"))),
}


def _mined_sql(template: str) -> str:
    columns, rows = MINING_SQL[template]
    names = [c.strip() for c in columns.split(",")]
    said = " || ';' || ".join(f"'{c}=' || {c}" for c in sorted(names))
    disease = "disease_name" if "disease_name" in names else "CAST(NULL AS VARCHAR)"
    question = [reduce(lambda q, c: f"replace({q}, '{{{c}}}', " + ("used" if c == "disease_name" else c) + ")", names, "'" + q.replace("'", "''") + "'") for q in mining.QUESTIONS[template][2]]
    return f"SELECT '{template}' AS template_id, '{mining.QUESTIONS[template][0]}' AS family_id, row_number() OVER (ORDER BY {columns}) AS n, {said} AS placeholders, {disease} AS disease, * FROM ({rows})", question


def _questions_sql() -> str:
    out = []
    for t in mining.QUESTIONS:
        rows, wordings = _mined_sql(t)
        start = f"(SELECT count(*) FROM mined WHERE family_id = '{mining.QUESTIONS[t][0]}' AND template_id < '{t}')"
        for p, q in enumerate(wordings):
            base = f"printf('%s-%06d', family_id, n + {start}) || CASE WHEN s > 0 THEN '-S' || s ELSE '' END"
            names = "list_concat([m.disease], CASE WHEN m.disease IS NULL THEN [] ELSE coalesce(syn.synonyms, [])[1:2] END)"
            inner = f"SELECT m.*, unnest({names}) AS used, unnest(range(len({names}))) AS s FROM ({rows}) m LEFT JOIN (SELECT name AS d, synonyms FROM diseases_n WHERE doid IS NOT NULL AND len(synonyms) > 0) syn ON syn.d = m.disease"
            out.append(f"SELECT {base}{f' || {chr(39)}-P{p}{chr(39)}' if p else ''} AS id, family_id, template_id, {q} AS question, {repr('paraphrase') if p else repr('base')} AS source, {base if p else 'CAST(NULL AS VARCHAR)'} AS paraphrase_of FROM ({inner})")
    return f"{PRELUDE}, {_HELD}, mined AS ({_all_mined()}) " + " UNION ALL ".join(out)


def _all_mined() -> str:
    return " UNION ALL ".join(f"SELECT template_id, family_id, n, placeholders FROM ({_mined_sql(t)[0]})" for t in mining.QUESTIONS)


def _node(kind: str, name: str) -> str:
    return rf"regexp_replace('{kind}:' || {name}, '[^A-Za-z0-9._-]+', '_', 'g')"


def _safe(x: str) -> str:
    return rf"regexp_replace({x}, '[^A-Za-z0-9._-]+', '_', 'g')"


_ROWS = f"""rows AS (SELECT CASE WHEN biomarker_type = 'Variant' THEN {text('biomarker_name')} END AS v, CASE WHEN biomarker_type = 'Gene' THEN {text('biomarker_name')} END AS g, {text('therapy_name')} AS t, {text('effect')} AS e, {text('disease_name')} AS d, CAST(len({parts('pmids')}) AS BIGINT) AS np, CAST(NULL AS VARCHAR) AS moa, 0 AS s, row_id FROM affects_response
  UNION ALL SELECT NULL, {text('gene_symbol')}, {text('therapy_name')}, NULL, NULL, 0, {text('moa')}, 1, row_id FROM targets UNION ALL SELECT {text('variant_name')}, {text('gene_symbol')}, NULL, NULL, NULL, 0, NULL, 2, row_id FROM variant_of)"""
_START = f"coalesce({_node('Variant', 'v')}, {_node('Gene', 'g')})"
_SAID = "e || coalesce(' (' || d || ')', '')"
_CATEGORY = "CASE WHEN contains(lower(e), 'resist') THEN 'resistance' WHEN regexp_matches(lower(e), 'sensit|responsive|benefit|response') THEN 'sensitivity' ELSE 'unknown' END"
_N = "CAST(NULL AS VARCHAR)"
_FIRST_OF_ID = "SELECT * EXCLUDE (rn, s, row_id) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, row_id) AS rn FROM x) WHERE rn = 1"
_EVENT_METRICS = "m AS (SELECT event_type AS model, avg((value > 10)::INT) AS v, avg((value > 50)::INT) AS a, avg(value + 1) AS l FROM events GROUP BY 1)"

SQL = {
    "etl_v2_items": f"WITH {_ITEMS} SELECT * FROM items",
    "etl_evidence_edges": f"WITH {_NAMED} SELECT row_id, CASE WHEN vname IS NULL THEN 'Gene' ELSE 'Variant' END AS biomarker_type, coalesce(vname, gene) AS biomarker_name, therapies AS therapy_name, effect, disease AS disease_name, doid AS disease_id FROM named WHERE effect IS NOT NULL AND gene IS NOT NULL AND disease IS NOT NULL AND therapies <> ''",
    "etl_nodes": f"""WITH {_NAMED} SELECT DISTINCT 'genes' AS part, gene AS name, {_N} AS about FROM named WHERE gene IS NOT NULL UNION ALL SELECT DISTINCT 'variants', vname, {_N} FROM named WHERE vname IS NOT NULL UNION ALL SELECT DISTINCT 'therapies', therapies, {_N} FROM named WHERE therapies <> ''
  UNION ALL SELECT 'diseases', disease, coalesce(arg_min(doid, row_id) FILTER (WHERE doid IS NOT NULL), '') || '|' || coalesce(array_to_string(list_sort(list(DISTINCT aliases) FILTER (WHERE aliases <> '')), ';'), '') FROM named WHERE disease IS NOT NULL GROUP BY disease
  UNION ALL SELECT DISTINCT 'variant_of', vname, gene FROM named WHERE vname IS NOT NULL""",
    "s2_evidence_file": "SELECT f AS file, 'G' AS gene, name, doid FROM diseases, (SELECT unnest(['object', 'list']) AS f)",
    "s1_evidence_pages": f"SELECT 'G' AS gene, 'G X1Y' AS variant, {text('name')} AS disease, regexp_replace({text('doid')}, '^(?i)DOID:', '') AS doid FROM diseases",
    "s4_best_hits": """WITH n AS (SELECT DISTINCT unnest(list_concat([lower(name)], [a FOR a IN aliases IF a IS NOT NULL])) AS name FROM therapy_reference),
h AS (SELECT n.name AS q, r.*, row_number() OVER (PARTITION BY n.name ORDER BY ref_id) AS pos FROM n JOIN therapy_reference r ON lower(left(n.name, 4)) = lower(left(r.name, 4)))
SELECT q AS name, chembl_id, array_to_string(list_sort(list_distinct(list_concat([a FOR a IN coalesce(aliases, []) IF a <> ''], [name]))), ';') AS synonyms FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN lower(name) = lower(q) OR list_contains([lower(a) FOR a IN coalesce(aliases, [])], lower(q)) THEN 0 ELSE 1 END, pos) AS rn FROM h WHERE pos <= 5) WHERE rn = 1""",
    "s5_drug_targets": f"""WITH r AS (SELECT {text('therapy_name')} AS t, {text('gene_symbol')} AS g, {text('moa')} AS m, moa IS NOT NULL AS has, {text('action_type')} AS a, coalesce({parts('ref_sources')}[1], '') AS src, {parts('ref_ids')} AS ids, {parts('ref_urls')} AS urls FROM targets),
p AS (SELECT t, g, m, a, urls, list_concat([{{'s': src, 'i': x}} FOR x IN ids], [{{'s': CASE WHEN src = '' THEN 'PubMed' ELSE src END, 'i': {_pmid('x')}}} FOR x IN urls IF {_pmid('x')} IS NOT NULL]) AS pairs FROM r WHERE has AND t IS NOT NULL AND g IS NOT NULL),
k AS (SELECT t, g, nullif(array_to_string(list_sort(list(DISTINCT m) FILTER (WHERE m IS NOT NULL)), ' | '), '') AS m, nullif(array_to_string(list_sort(list(DISTINCT a) FILTER (WHERE a IS NOT NULL)), ' | '), '') AS a, list_sort(list_distinct(flatten(list(pairs)))) AS pairs, list_sort(list_distinct(flatten(list(urls)))) AS urls FROM p GROUP BY 1, 2)
SELECT t AS therapy_name, g AS gene_symbol, 'opentargets' AS source, m AS moa, a AS action_type, array_to_string([x.s FOR x IN pairs], ';') AS ref_sources, array_to_string([x.i FOR x IN pairs], ';') AS ref_ids, array_to_string(urls, ';') AS ref_urls FROM k
UNION ALL SELECT DISTINCT t, g, 'opentargets', {_N}, {_N}, '', '', '' FROM r WHERE NOT has AND t IS NOT NULL AND g IS NOT NULL AND t NOT IN (SELECT t FROM k)""",
    "u6_united_synonyms": f"""{PRELUDE}, s AS (SELECT lower(name) AS n, synonyms AS x FROM therapies_n UNION ALL SELECT lower(name), aliases FROM therapy_reference)
SELECT n AS name, coalesce(array_to_string(list_sort(list_distinct(flatten(list(coalesce(x, []))))), ';'), '') AS synonyms FROM s GROUP BY n""",
    "k1_csv_round_trip": f"{PRELUDE}\nSELECT therapy_name, gene_symbol, source, moa, action_type, array_to_string(list_sort(ref_sources), ';') AS ref_sources, array_to_string(list_sort(ref_ids), ';') AS ref_ids, array_to_string(list_sort(ref_urls), ';') AS ref_urls FROM targets_n",
    "k2_latest_snapshot": "SELECT row_id, name, '20240103' AS snapshot_date FROM diseases",
    "k6_split_lines": "SELECT split, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER (PARTITION BY family_id ORDER BY md5('42|' || item_id), item_id) <= greatest(1, floor(count(*) OVER (PARTITION BY family_id) * 0.85)) THEN 'train' ELSE 'test' END AS split FROM (SELECT DISTINCT item_id, coalesce(family_id, 'none') AS family_id FROM paraphrase_items)) GROUP BY 1",
    "k9_sinks": "SELECT 'all' AS sink, event_type AS step, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'some', event_type, count(*) FROM events WHERE event_type IN ('click', 'view') GROUP BY 2",
    "j17_unprocessed": "SELECT row_id FROM affects_response WHERE best_evidence_level IS NULL",
    "s8_therapies_with_id": f"{PRELUDE} SELECT name, chembl_id FROM therapies_n WHERE chembl_id IS NOT NULL",
    "s9_last_genes": f"{PRELUDE} SELECT variant_name, max(gene_symbol) AS gene_symbol FROM variant_of_n GROUP BY 1",
    "s10_disease_synonyms": f"{PRELUDE} SELECT name AS disease_name, array_to_string(list_sort(synonyms), ';') AS synonyms FROM diseases_n WHERE doid IS NOT NULL AND len(synonyms) > 0",
    "j10_dropped_edges": f"""{PRELUDE}, t AS (SELECT DISTINCT {text('therapy_name')} AS t, {text('gene_symbol')} AS g FROM targets WHERE {text('therapy_name')} IS NOT NULL AND {text('gene_symbol')} IS NOT NULL), v AS (SELECT DISTINCT {text('variant_name')} AS v, {text('gene_symbol')} AS g FROM variant_of WHERE {text('variant_name')} IS NOT NULL AND {text('gene_symbol')} IS NOT NULL),
a AS (SELECT DISTINCT biomarker_type, biomarker_name, therapy_name, effect, disease_name, disease_id FROM affects_all WHERE biomarker_type IN ('Gene', 'Variant') AND effect IS NOT NULL AND disease_name IS NOT NULL)
SELECT 'targets' AS part, 'therapies' AS unknown_in, t AS name, count(*) AS n FROM t WHERE t NOT IN (SELECT name FROM therapies_n) GROUP BY t UNION ALL SELECT 'targets', 'genes', g, count(*) FROM t WHERE g NOT IN (SELECT symbol FROM genes_n) GROUP BY g
UNION ALL SELECT 'variant_of', 'variants', v, count(*) FROM v WHERE v NOT IN (SELECT name FROM variants_n) GROUP BY v UNION ALL SELECT 'variant_of', 'genes', g, count(*) FROM v WHERE g NOT IN (SELECT symbol FROM genes_n) GROUP BY g
UNION ALL SELECT 'affects', 'therapies', therapy_name, count(*) FROM a WHERE therapy_name NOT IN (SELECT name FROM therapies_n) GROUP BY 3 UNION ALL SELECT 'affects', 'genes', biomarker_name, count(*) FROM a WHERE biomarker_type = 'Gene' AND biomarker_name NOT IN (SELECT symbol FROM genes_n) GROUP BY 3
UNION ALL SELECT 'affects', 'variants', biomarker_name, count(*) FROM a WHERE biomarker_type = 'Variant' AND biomarker_name NOT IN (SELECT name FROM variants_n) GROUP BY 3""",
    "a22_diseases_per_therapy": f"{PRELUDE} SELECT therapy_name, array_to_string(list_sort(list(DISTINCT disease_name)), ';') AS diseases FROM affects_n GROUP BY 1",
    "a22_therapies_per_disease": f"{PRELUDE} SELECT disease_name, array_to_string(list_sort(list(DISTINCT therapy_name)), ';') AS therapies FROM affects_n WHERE lower(effect) = 'resistance' GROUP BY 1",
    "o3_by_level": "SELECT row_id, best_evidence_level FROM affects_response ORDER BY CASE WHEN upper(trim(best_evidence_level)) IN ('A', 'B', 'C', 'D', 'E') THEN ascii(upper(trim(best_evidence_level))) ELSE 999 END, row_id LIMIT 100",
    "p20_text_lines": "SELECT r || '. ' || concat_ws('; ', 'name: ' || name, 'doid: ' || nullif(trim(doid), ''), 'row_id: ' || row_id) AS line FROM (SELECT *, row_number() OVER (ORDER BY row_id) AS r FROM diseases ORDER BY row_id LIMIT 50)",
    "p23_labels": rf"SELECT host, 'Ref Urls' AS heading, printf('%.1f', CAST(count(*) AS DOUBLE)) AS shown FROM (SELECT coalesce(nullif(regexp_extract(u, '^[a-z]+://(?:www\.)?([^/:?#]+)', 1), ''), u) AS host FROM (SELECT unnest({parts('ref_urls')}) AS u FROM targets)) GROUP BY 1",
    "p24_graph_nodes": f"WITH {_ROWS}, x AS (SELECT {_node('Variant', 'v')} AS id, v AS label, 'Variant' AS kind, s, row_id FROM rows WHERE v IS NOT NULL UNION ALL SELECT {_node('Gene', 'g')}, g, 'Gene', s, row_id FROM rows WHERE g IS NOT NULL UNION ALL SELECT {_node('Therapy', 't')}, t, 'Therapy', s, row_id FROM rows WHERE t IS NOT NULL) {_FIRST_OF_ID}",
    "p24_graph_edges": f"""WITH {_ROWS}, x AS (SELECT {_safe("'VARIANT_OF|' || " + _node('Variant', 'v') + " || '|' || " + _node('Gene', 'g'))} AS id, {_node('Variant', 'v')} AS source, {_node('Gene', 'g')} AS target, 'VARIANT_OF' AS label, 'VARIANT_OF' AS relationship, {_N} AS effect, {_N} AS effect_category, {_N} AS disease, CAST(NULL AS BIGINT) AS pmid_count, {_N} AS moa, s, row_id FROM rows WHERE v IS NOT NULL AND g IS NOT NULL
UNION ALL SELECT {_safe("'AFFECTS_RESPONSE_TO|' || " + _START + " || '|' || " + _node('Therapy', 't') + " || '|' || " + _SAID)}, {_START}, {_node('Therapy', 't')}, {_SAID}, 'AFFECTS_RESPONSE_TO', e, {_CATEGORY}, d, np, {_N}, s, row_id FROM rows WHERE t IS NOT NULL AND e IS NOT NULL AND (v IS NOT NULL OR g IS NOT NULL)
UNION ALL SELECT {_safe("'TARGETS|' || " + _node('Therapy', 't') + " || '|' || " + _node('Gene', 'g') + " || '|TARGETS'")}, {_node('Therapy', 't')}, {_node('Gene', 'g')}, 'TARGETS', 'TARGETS', {_N}, {_N}, {_N}, NULL, moa, s, row_id FROM rows WHERE t IS NOT NULL AND g IS NOT NULL AND e IS NULL) {_FIRST_OF_ID}""",
    "d1_mined": f"{PRELUDE}, {_HELD} {_all_mined()}",
    "d7_questions": _questions_sql(),
    "d8_chat": "SELECT CAST(row_id AS VARCHAR) AS id, t AS turn, ['system', 'user', 'assistant'][t + 1] AS role, ['Be brief.', 'What is ' || name || '?', doid][t + 1] AS content FROM diseases, range(3) r(t)",
    "d5_curated_first": f"{PRELUDE} SELECT symbol, row_number() OVER (ORDER BY k, md5('42|' || symbol), symbol) AS pos FROM (SELECT symbol, CASE symbol WHEN 'JITLA' THEN 0 ELSE 1 END AS k FROM genes_n ORDER BY k, md5('42|' || symbol), symbol LIMIT 20)",
    "d10_subset": "SELECT item_id, family_id FROM (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY md5('42|' || item_id), item_id) <= greatest(1, floor(count(*) OVER (PARTITION BY family_id) * 0.1)) AS f FROM (SELECT DISTINCT item_id, coalesce(family_id, 'none') AS family_id FROM paraphrase_items)) ORDER BY NOT f, md5('42|' || item_id), item_id LIMIT 100",
    "j13_product": f"{PRELUDE} SELECT a.x AS gene_symbol, b.x AS disease_name FROM (SELECT symbol AS x FROM genes_n ORDER BY md5('42|' || symbol), symbol LIMIT 20) a, (SELECT name AS x FROM diseases_n ORDER BY md5('42|' || name), name LIMIT 20) b",
    "d9_judgements": f"{PRELUDE}, g AS (SELECT count(*) AS n FROM variant_of_n WHERE variant_name = '{catalog.VARIANT}') SELECT id, valid, executed, matched, n AS gold_rows FROM g, (VALUES ('same', true, true, true), ('other', true, true, false), ('none', false, false, false), ('unknown', false, false, false), ('fails', true, false, false)) t(id, valid, executed, matched)",
    "d13_executed": f"{PRELUDE} SELECT 'same' AS id, count(*) AS n_rows, false AS failed FROM variant_of_n WHERE variant_name = '{catalog.VARIANT}' UNION ALL SELECT unnest(['other', 'unknown', 'fails']), 0, unnest([false, true, true])",
    "f21_partial_matches": "SELECT event_id, event_type AS model FROM events WHERE value > 20 AND NOT value > 50",
    "a20_extremes": f"WITH {_EVENT_METRICS} SELECT (SELECT model FROM m ORDER BY a DESC, model LIMIT 1) AS most_accurate, (SELECT model FROM m ORDER BY v DESC, model LIMIT 1) AS most_valid, (SELECT model FROM m ORDER BY l, model LIMIT 1) AS fastest, (SELECT model FROM m ORDER BY l DESC, model LIMIT 1) AS slowest",
    "u5_same_rows": "SELECT unnest(['genes', 'variants', 'therapies', 'diseases', 'variant_of', 'targets', 'affects']) AS part, true AS same, false AS same_without",
    "t6_cleared_cache": "SELECT * FROM (SELECT event_type || ':' || event_id AS cache_key, CASE WHEN value > 1 THEN CAST(user_id AS VARCHAR) END AS run_id FROM events) WHERE NOT starts_with(cache_key, 'click:') AND cache_key <> 'view:3' AND run_id IS DISTINCT FROM '7'",
    "t6_swept_cache": "SELECT CAST(100 AS BIGINT) AS write, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' UNION ALL SELECT 101, count(*) FROM events",
    "t7_feedback": """SELECT CAST(user_id AS VARCHAR) AS run_id, 'feedback' AS step, '{"run_id":"' || user_id || '","cypher_correct":' || (value > 50) || '}' AS payload FROM events WHERE user_id IS NOT NULL""",
    "t2_messages": "SELECT DISTINCT user_id, CASE event_type WHEN 'click' THEN 'Clicked' ELSE 'Looked' END AS message FROM events WHERE event_type IN ('click', 'view')",
    "a21_symbols_of_rows": catalog_sql.SQL["q5_1_biomarkers_in_disease"].replace("\nSELECT * FROM", ", top AS (SELECT * FROM", 1) + f") SELECT DISTINCT {strip('gene_symbol')} AS gene_symbol FROM top WHERE gene_symbol IS NOT NULL",
}

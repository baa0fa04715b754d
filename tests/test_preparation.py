import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import dataset, enrich, evaluate, ingest, present
from quillgraph.plans import preparation
from quillgraph.schemas import DRUG, EVIDENCE
from quillgraph.sources import files
from quillgraph.streaming import log

RECORD = {
    "gene": {"name": "EGFR"}, "variant": {"name": "EGFR T790M"}, "disease": {"name": "Lung", "doid": "doid:1", "diseaseAliases": ["L"]}, "drugs": [{"name": " Gefitinib "}, {"drug_name": "X"}],
    "clinical_significance": "Resistance", "evidence_level": "b", "evidence_rating": "3", "status": "accepted", "sources": [{"pubmed_id": "2"}, {"citation_id": "1"}], "evidence_statement": "n1",
}


def test_evidence_to_edges(spark, tmp_path):
    other = RECORD | {"evidence_level": "Q", "evidence_rating": "0", "evidence_statement": "n2", "sources": [{"pmid": "2"}]}
    bare = {"molecular_profile": {"name": "BCR::ABL1 Fusion"}, "disease": {"display_name": "Y"}, "evidence_direction": "benefit", "drugs": [{"name": "Z"}], "status": "ACCEPTED"}
    (tmp_path / "a.json").write_text(json.dumps({"records": [RECORD, other, bare, RECORD | {"status": "submitted"}]}))
    items = ingest.evidence_items(files.accepted(files.read_evidence(spark, str(tmp_path / "a.json"))))
    got = {(r["biomarker_name"], r["therapy_name"]): r for r in ingest.evidence_rollup(ingest.evidence_edges(items)).collect()}
    edge = got[("EGFR T790M", "Gefitinib")]
    assert (edge["pmids"], edge["evidence_levels"], edge["best_evidence_level"], edge["evidence_count"], edge["avg_rating"], edge["max_rating"]) == (["1", "2"], ["B", "Q"], "B", 2, 3.0, 3)
    assert edge["notes"] == "n1; n2" and edge["disease_id"] == "1" and edge["biomarker_type"] == "Variant"
    fusion = got[("BCR BCR::ABL1 Fusion", "Z")]  # without a variant, the profile stands for it
    assert fusion["effect"] == "sensitivity" and fusion["best_evidence_level"] == ""
    nodes = ingest.nodes_of(items)
    assert {r["symbol"] for r in nodes["genes"].collect()} == {"EGFR", "BCR"}
    (tmp_path / "b.json").write_text(json.dumps([RECORD]))
    assert files.read_evidence(spark, str(tmp_path / "b.json")).count() == 1


def test_names_effects_and_tags(spark):
    df = spark.createDataFrame([("BCR", "BCR::ABL1 Fusion"), ("EGFR", "egfr T790M"), ("KRAS", None), ("KRAS", " ")], "g string, v string")
    assert [r[0] for r in df.select(ingest.variant_name(F.col("g"), F.col("v"))).collect()] == ["BCR BCR::ABL1 Fusion", "EGFR T790M", None, None]
    texts = spark.createDataFrame([("Reduced Sensitivity",), ("no response",), ("x",), (None,)], "e string")
    assert [tuple(r) for r in texts.select(ingest.effect_class(F.col("e")), ingest.effect_category(F.col("e"))).collect()] == [("sensitivity", "sensitivity"), ("resistance", "sensitivity"), (None, "unknown"), (None, "unknown")]
    names = spark.createDataFrame([("Xmab", ["G"]), ("Ytinib", ["G"]), ("Z", [])], "n string, g array<string>")
    assert [tuple(r) for r in names.select(ingest.inferred_tags(F.col("n"), F.col("g")), ingest.inferred_modality(F.col("n"), F.col("g"))).collect()] == [(["Antibody", "anti-G"], "Antibody"), (["G Inhibitor", "TKI"], "Small Molecule"), ([], None)]


def test_drug_records(spark):
    rows = [
        {"name": "A", "mechanismsOfAction": {"rows": [{"mechanismOfAction": "m", "actionType": "I", "targets": [{"approvedSymbol": "G"}], "references": [{"source": "P", "ids": ["2", "1"], "urls": ["u"]}, {"source": "P", "ids": ["1"], "urls": []}]}]}},
        {"name": "B", "linkedTargets": {"rows": [{"approvedSymbol": "H"}]}},
    ]
    df = spark.read.schema(DRUG).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    got = {r["therapy_name"]: r for r in ingest.drug_targets(df).collect()}
    assert got["B"]["moa"] is None and got["A"]["source"] == "opentargets"
    assert (got["A"]["moa"], got["A"]["ref_sources"], got["A"]["ref_ids"], got["A"]["ref_urls"]) == ("m", ["P", "P"], ["1", "2"], ["u"]) and got["B"]["gene_symbol"] == "H"
    best = spark.createDataFrame([("a", "1", ["s"]), ("b", "9", [])], "name string, chembl_id string, synonyms array<string>")
    details = spark.read.schema(DRUG).json(spark.sparkContext.parallelize([json.dumps({"id": i, "name": "X", "drugType": "T"}) for i in ("1", "1", "2")]))
    assert [(r["name"], r["chembl_id"], r["drugType"]) for r in ingest.with_details(best, details).collect()] == [("a", "1", "T")]
    hits = spark.createDataFrame([("x", 0, "1", "other", None, None), ("x", 1, "2", "o2", ["X"], None), ("y", 0, "3", "o", None, None)], "query string, hit_pos int, id string, name string, synonyms array<string>, tradeNames array<string>")
    assert {r["name"]: r["chembl_id"] for r in ingest.best_hit(spark.createDataFrame([("x",), ("y",), ("z",)], "name string"), hits).collect()} == {"x": "2", "y": "3"}


def test_enrichment_against_exact_numbers(spark):
    genes = spark.createDataFrame([(f"g{i}",) for i in range(10)], "gene string")
    sets = spark.createDataFrame([("L", "t", f"g{i}") for i in range(4)] + [("L", "t", f"x{i}") for i in range(16)], "library string, term string, gene string")
    row = enrich.enrichment(genes, sets, 200).first()
    exact = sum(math.comb(20, i) * math.comb(180, 10 - i) for i in range(4, 11)) / math.comb(200, 10)
    assert row["p_value"] == pytest.approx(exact, rel=1e-9) and row["p_value"] == pytest.approx(0.0104757648529) and row["gene_count"] == 4
    p = spark.createDataFrame([("L", "a", 0.01), ("L", "b", 0.03), ("L", "c", 0.04)], "library string, term string, p_value double")
    assert [round(r["adjusted_p_value"], 12) for r in enrich.adjust(p).orderBy("term").collect()] == [0.03, 0.04, 0.04]
    assert enrich.enrichment(genes.limit(0), sets, 200).count() == 0
    assert enrich.plot_points(enrich.enrichment(genes, sets, 200)).count() == 1


def test_question_sets(spark):
    rows = spark.createDataFrame([("F", "t", 1, {"disease_name": "A", "g": "x"}, ["x", "y", "z"], ["q {disease_name} {g}", "r {g}"]), ("F", "u", 2, {"g": "x"}, None, ["s {g}"])], "family_id string, template_id string, n int, placeholders map<string,string>, synonyms array<string>, questions array<string>")
    got = {r["id"]: r for r in dataset.expand(rows).collect()}
    assert sorted(got) == ["F-000001", "F-000001-P1", "F-000001-S1", "F-000001-S1-P1", "F-000001-S2", "F-000001-S2-P1", "F-000002"] and dataset.expand(rows, 0).count() == 3
    assert got["F-000001-S2"]["question"] == "q y x" and got["F-000001-S1-P1"]["paraphrase_of"] == "F-000001-S1" and got["F-000001-S1"]["placeholders"]["disease_name"] == "A"
    items = spark.range(200).select("id", F.when(F.col("id") < 190, "big").otherwise("small").alias("g"))
    split = {r["g"]: r["n"] for r in dataset.stratified_split(items, "g", "id").filter("split = 'train'").groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert split == {"big": 161, "small": 8}
    a = spark.createDataFrame([(1, ["x", "y"]), (1, ["x", "y"]), (None, None)], "a int, b array<string>")
    b = spark.createDataFrame([(None, None, 1), (1, ["y", "x"], 2), (1, ["x", "y"], 3)], "a int, b array<string>, c int")
    assert dataset.same_rows(a, b) == {"same": True, "missing": [], "extra": ["c"]}
    assert not dataset.same_rows(a, b.limit(2))["same"] and dataset.same_rows(a, b.drop("a"))["missing"] == ["a"]


def test_event_log(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(seconds=s), r, step, "{}") for s, r, step in ((0, "a", "x"), (5, "a", "x"), (59, "a", "y"), (61, "b", "x"), (3000, "a", "x"))]
    events = spark.createDataFrame(rows, "timestamp timestamp, run_id string, step string, payload string")
    assert log.first_steps(events).count() == 3
    recent = {r["timestamp"]: r["n_recent"] for r in log.requests_in_window(events.filter("run_id = 'a'"), "run_id", "timestamp").collect()}
    assert [recent[k] for k in sorted(recent)] == [1, 2, 3, 1]
    log.write_traces(events, str(tmp_path / "in"))
    stream = log.read_traces(spark, str(tmp_path / "in" / "day=20240101"), stream=True)
    query = log.first_steps(stream).writeStream.format("memory").queryName("steps").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.sql("select * from steps").count() == 3
    entry = "cache_key string, value string, created_at timestamp, expires_at timestamp, access_count bigint"
    old = spark.createDataFrame([("k:1", "old", t, t, 7), ("z", "z", t, t, 0)], entry)
    new = spark.createDataFrame([("k:1", "new", t + dt.timedelta(1), t + dt.timedelta(2), 0)], entry)
    got = {r["cache_key"]: r for r in log.upsert_entries(old, new).collect()}
    assert (got["k:1"]["value"], got["k:1"]["created_at"], got["k:1"]["access_count"]) == ("new", t, 7)
    assert log.live_entries(old, F.lit(t)).count() == 2 and log.without_prefix(old, "k:").count() == 1


def test_presentation(spark, tmp_path):
    rows = spark.createDataFrame([(None, "G", "T", "Resistance", "A", [" "], 1), ("V", "G", "T", None, "", ["2"], 2)], "variant_name string, gene_symbol string, therapy_name string, effect string, best_evidence_level string, pmids array<string>, p int")
    assert present.shown_columns(rows.drop("p")).columns == ["variant_name", "gene_symbol", "therapy_name", "effect", "pmids"]
    shown = spark.createDataFrame(
        [("V 1", "G", ["T;x", "U"], "Resistance", "d", ["1"], None, 1), ("V 1", "G", ["T;x"], "Resistance", "e", None, None, 2), ("V 1", "G", ["T;x"], "Sensitivity", "d", None, None, 3), (None, "G", ["T;x", " "], None, None, None, "inhibits", 4), (None, "g", ["T;x"], None, None, None, None, 5), (None, None, ["W"], "Resistance", None, None, None, 6)],
        "variant_name string, gene_symbol string, therapy_name array<string>, effect string, disease_name string, pmids array<string>, targets_moa string, p int",
    )
    nodes, edges = present.graph_elements(shown, "p")
    assert {r["id"] for r in nodes.collect()} == {"Variant_V_1", "Gene_G", "Gene_g", "Therapy_T_x", "Therapy_U", "Therapy_W"}
    links = {r["id"]: r for r in edges.collect()}
    assert set(links) == {"VARIANT_OF_Variant_V_1_Gene_G", "AFFECTS_RESPONSE_TO_Variant_V_1_Therapy_T_x_Resistance_d_", "AFFECTS_RESPONSE_TO_Variant_V_1_Therapy_U_Resistance_d_", "AFFECTS_RESPONSE_TO_Variant_V_1_Therapy_T_x_Resistance_e_", "AFFECTS_RESPONSE_TO_Variant_V_1_Therapy_T_x_Sensitivity_d_", "TARGETS_Therapy_T_x_Gene_G_TARGETS", "TARGETS_Therapy_T_x_Gene_g_TARGETS"}
    assert links["TARGETS_Therapy_T_x_Gene_G_TARGETS"]["moa"] == "inhibits" and present.graph_elements(shown.drop("targets_moa"), "p")[1].count() == 5
    assert [r["p"] for r in present.by_level(rows, "p").collect()] == [1, 2]
    assert present.text_lines(rows.select("gene_symbol", "p"), ["p"]).first()[0] == "1. gene_symbol: G; p: 1"
    present.export_csv(rows.select("p", "gene_symbol", F.lit('a "b", c').alias("z")), str(tmp_path / "x"), {"question": "q"})
    assert [r[0] for r in spark.read.text(str(tmp_path / "x")).collect()] == ["# question: q", "gene_symbol,p,z", 'G,1,"a ""b"", c"', 'G,2,"a ""b"", c"']
    assert present.preview(rows, ["p"], 1).count() == 1 and [r[0] for r in present.gene_symbols(rows).collect()] == ["G"]
    with pytest.raises(ValueError):
        present.check_request("genes", ["password"])


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("therapy_name,gene_symbol,source\nA,G,\nB,H,x\n")
    got = files.read_graph_csv(spark, str(tmp_path / "t.csv"), "targets")
    assert got.columns[-1] == "ref_urls" and got.filter("source is null").count() == 1
    files.write_csv(spark.createDataFrame([(None, ["a", "b"])], "n string, l array<string>"), str(tmp_path / "out"))
    assert sorted({r[0] for r in spark.read.text(str(tmp_path / "out")).collect()}) in ([",a;b", "n,l"], [chr(34) * 2 + ",a;b", "n,l"])
    for day in ("20240101", "20240102"):
        files.write_snapshot(spark.createDataFrame([(day,)], "v string"), str(tmp_path / "snap"), day)
    assert [r["v"] for r in files.read_latest(spark, str(tmp_path / "snap")).collect()] == ["20240102"]
    assert files.resume(spark.range(5), spark.range(3)).count() == 2
    assert len(EVIDENCE) > 10


def test_the_level_decides_which_terms_come_out(spark):
    sf = "/root/testdata/sf0.01"
    got = [r["adjusted_p_value"] for r in preparation.QUERIES["e6_significant_terms"](spark, sf).collect()]
    tested = enrich.enrichment(*preparation._sets(spark, sf, 8)).count()
    assert 0 < len(got) < min(100, tested) and max(got) <= 0.05


def test_pubmed_ids_of_urls(spark):
    urls = {"https://clinicaltrials.gov/show/999": None, "http://europepmc.org/abstract/MED/123?x=1": "123", "http://www.ncbi.nlm.nih.gov/pubmed/55#abs": "55", "https://pubmed.ncbi.nlm.nih.gov/7/": "7", "https://x.org/12": None, "": None}
    df = spark.createDataFrame(list(urls.items()), "u string, want string")
    assert df.filter(~ingest.pmid_of_url(F.col("u")).eqNullSafe(F.col("want"))).count() == 0


def test_mechanisms_are_rolled_up(spark):
    ref = "array<struct<source:string,ids:array<string>,urls:array<string>>>"
    rows = [("T", "G", " b ", "X", [(" ", ["9", " "], ["https://e.org/MED/5", " "]), ("S", None, ["https://e.org/med/4"])]), ("T", "G", "a", " ", None), ("T", "H", None, None, None)]
    got = {r["gene_symbol"]: r for r in ingest.moa_rollup(spark.createDataFrame(rows, f"therapy_name string, gene_symbol string, moa string, action_type string, refs {ref}")).collect()}
    assert got["G"]["moa"] == "a | b" and got["G"]["action_type"] == "X" and got["H"]["moa"] is None and got["H"]["action_type"] is None
    assert list(zip(got["G"]["ref_sources"], got["G"]["ref_ids"])) == [("", "9"), ("PubMed", "5"), ("S", "4")] and got["G"]["ref_urls"] == ["https://e.org/MED/5", "https://e.org/med/4"]


def test_fusions_in_names(spark):
    df = spark.createDataFrame([("HLA-A::B-2 Fusion and C::D::E",), ("plain",), (None,)], "n string")
    assert [r[0] for r in df.select(ingest.all_fusions(F.col("n"))).collect()] == [["HLA-A::B-2", "C::D::E"], [], None]


def test_gene_lists(spark):
    assert enrich.gene_list("a, b\n c ,,\n") == ["a", "b", "c"]
    sets = spark.createDataFrame([("L", "t", "g"), ("M", "t", "g")], "library string, term string, gene string")
    assert enrich.libraries_of(sets, ["L"], ["L", "M"]).count() == 1 and enrich.libraries_of(sets, None, ["L", "M"]).count() == 2
    with pytest.raises(ValueError):
        enrich.libraries_of(sets, ["X"], ["L", "M"])
    names, aliases = spark.createDataFrame([("x",), ("nope",)], "name string"), spark.createDataFrame([("x", "g")], "alias string, symbol string")
    got = enrich.analyze(names, aliases, sets, 50)
    assert got.terms.count() == 2 and got.warnings == ["1 names were not recognised: NOPE"]
    assert enrich.analyze(names.limit(0), aliases, sets, 50).warnings == ["no valid gene is left"]


def test_adjustment_over_bands(spark):
    rows = [("L", f"t{i}", 10.0 ** -(i / 7)) for i in range(60)] + [("L", "z", 0.0), ("M", "one", 0.5)]
    got = {(r["library"], r["term"]): r["adjusted_p_value"] for r in enrich.adjust(spark.createDataFrame(rows, "library string, term string, p_value double")).collect()}
    mine = sorted([r for r in rows if r[0] == "L"], key=lambda r: (r[2], r[1]))
    least = 1.0
    for rank in range(len(mine), 0, -1):
        least = min(least, mine[rank - 1][2] * len(mine) / rank)
        assert got["L", mine[rank - 1][1]] == pytest.approx(least)
    assert got["M", "one"] == 0.5


def test_runs_are_resumed(spark, tmp_path):
    asked = []

    def answer(n):
        def run():
            asked.append(n)
            return spark.range(n)

        return run

    records = [(str(n), answer(n), answer(n)) for n in range(3)]
    assert evaluate.evaluate(spark, records[:2], str(tmp_path / "run"), 1).filter("matched").count() == 2
    asked.clear()
    assert evaluate.evaluate(spark, records, str(tmp_path / "run"), 1).count() == 3 and set(asked) == {2}
    got = evaluate.evaluate(spark, records, str(tmp_path / "run"))
    evaluate.write_results(got, spark.createDataFrame([("m", 1.0)], "model string, matched_pct double"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "summary")).filter("matched = '✓'").count() == 3


def test_result_files_and_first_records(spark, tmp_path):
    (tmp_path / "a_evaluation_results.json").write_text(json.dumps({"models": {"x": {"metrics": {"output_accuracy_pct": 90.0}}, "y": {"metrics": {"output_accuracy_pct": 80}}}}))
    (tmp_path / "b_evaluation_results.json").write_text(json.dumps({"metrics": {"output_accuracy_pct": 70.5}}, indent=1))
    got = {(r["model"], r["value"]) for r in files.read_results(spark, str(tmp_path / "*.json")).collect()}
    assert got == {("x", 90.0), ("y", 80.0), ("b", 70.5)}
    for name in ("p", "q"):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"id": f"{name}{i}"}) + "\n" for i in range(5)) + "{broken\n")
    assert sorted(r["id"] for r in files.read_pairs(spark, str(tmp_path / "*.jsonl"), 2).collect()) == ["p0", "p1", "q0", "q1"]


def test_landed_pages(spark, tmp_path):
    page = lambda names, more, **rest: json.dumps({"data": {"evidenceItems": {"pageInfo": {"hasNextPage": more}, "edges": [{"node": {"molecularProfile": {"name": n}, "status": s, "source": {"citationId": c, "link": u}}} for n, s, c, u in names]}}} | rest)
    (tmp_path / "1.json").write_text(page([("A B", "ACCEPTED", "12", None), ("C", "SUBMITTED", None, None)], True))
    (tmp_path / "2.json").write_text(page([("D E", "ACCEPTED", "ASCO 1", "https://pubmed.ncbi.nlm.nih.gov/33/")], True))
    (tmp_path / "3.json").write_text(page([("F", "ACCEPTED", None, None)], True, errors=["e"]))
    got = ingest.evidence_items(files.read_source(spark, pages=str(tmp_path))).orderBy("_pos").collect()
    assert [(r["gene"], r["variant"], r["pmids"]) for r in got] == [("A", "A B", ["12"]), ("D", "D E", ["33"])]
    assert files.read_pages(spark, str(tmp_path), 1).count() == 1
    with pytest.raises(ValueError):
        files.read_source(spark)


def test_only_the_last_snapshot_is_read(spark, tmp_path):
    for day in ("20240101", "20240102"):
        files.write_snapshot(spark.range(3), str(tmp_path / "s"), day)
    assert all("20240102" in f for f in files.read_latest(spark, str(tmp_path / "s")).inputFiles())
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        files.read_latest(spark, str(tmp_path / "none"))

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.hashing import row_hash
from quillgraph.graph import Graph
from quillgraph.operators import match
from quillgraph.plans import catalog as c
from quillgraph.schemas import TABLES

ROWS = {
    "genes": [("EGFR", "1.0", "ERBB;her1"), ("ERBB2", "HGNC:2", "HER2"), ("BRAF", None, None), ("KRAS", None, " ; "), ("EGFR", "3", "ERBB"), (None, "9", None)],
    "variants": [("EGFR T790M", None, "missense", None), ("BRAF V600E", None, "missense", None), ("KRAS G12C", None, "missense", None), ("A B::C Fusion", None, "fusion", None)],
    "therapies": [("Gefitinib", None, "TKI;anti-EGFR", None, "Iressa"), ("Cetuximab", None, None, None, "Erbitux"), ("Osimertinib", None, None, None, None), ("Both", None, None, None, None)],
    "diseases": [("Lung Cancer", "DOID:1", None)],
    "variant_of": [("EGFR T790M", "EGFR"), ("BRAF V600E", "BRAF"), ("A B::C Fusion", "EGFR"), ("A B::C Fusion", "KRAS"), ("KRAS G12C", "gone"), ("EGFR T790M", "EGFR")],
    "targets": [("Gefitinib", "EGFR", "a", "inhibitor", None, "P;P", "1;2", None), ("Gefitinib", "EGFR", None, None, "X", None, None, None), ("Cetuximab", "EGFR", "b", None, None, None, None, None), ("Osimertinib", "EGFR", None, None, None, None, None, None),
                ("Both", "EGFR", None, None, None, None, None, None), ("Both", "BRAF", None, None, None, None, None, None), ("nobody", "EGFR", None, None, None, None, None, None)],
    "affects_response": [
        ("Variant", "EGFR T790M", "Gefitinib", "resistance", "Lung Cancer", "5.0", "1;2", "s", None, "B", "B", "2", "3.5", "4"),
        ("Gene", "EGFR", "Gefitinib", "sensitivity", "Lung Cancer", None, "3", "s", None, "", None, "x", None, None),
        ("Gene", "EGFR", "Gefitinib", "sensitivity", "Lung Cancer", None, "4", "s", None, "A", "A", "1", "2", "2"),
        ("Variant", "A B::C Fusion", "Cetuximab", "resistance", "Lung Cancer", None, None, "s", None, None, None, None, None, None),
        ("Gene", "EGFR", "nobody", "resistance", "Lung Cancer", None, "1", None, None, None, None, None, None, None),
        (None, "EGFR", "Gefitinib", "resistance", "Lung Cancer", None, "1", None, None, None, None, None, None, None),
    ],
}


@pytest.fixture(scope="module")
def graph(spark):
    tables = {}
    for name, rows in ROWS.items():
        now = dt.datetime(2024, 1, 1)
        tables[name] = spark.createDataFrame([(*r, now + dt.timedelta(days=i), i) for i, r in enumerate(rows)], TABLES[name] + ", loaded_at timestamp, row_id bigint")
    return Graph.of(tables)


def names(df, column="therapy_name"):
    return sorted({r[column] for r in df.collect()})


def test_load(graph):
    genes = {r["symbol"]: r for r in graph.genes.collect()}
    assert genes["EGFR"]["hgnc_id"] == "3" and genes["KRAS"]["synonyms"] == [] and None not in genes
    edge = graph.targets.filter("therapy_name = 'Gefitinib'").first()
    assert (edge["source"], edge["moa"], edge["action_type"], edge["ref_ids"]) == ("a", "inhibitor", "X", ["1", "2"])
    assert graph.variant_of.count() == 4 and graph.targets.count() == 5
    assert graph.affects.count() == 3 and graph.violations().count() == 0
    assert graph.affects.filter("effect = 'sensitivity'").first()["pmids"] == ["4"]


def test_questions(graph):
    assert names(c.targets_of_gene(graph, "erbb")) == ["Both", "Cetuximab", "Gefitinib", "Osimertinib"]
    assert names(c.genes_of_therapy(graph, "erbitux"), "gene_symbol") == ["EGFR"]
    assert names(c.gene_of_variant(graph, "BRAF V600E"), "gene_symbol") == ["BRAF"] and c.gene_of_variant(graph, "braf v600e").count() == 0
    assert names(c.therapies_of_both(graph, "EGFR", "braf")) == ["Both"] and c.therapies_of_both(graph, "EGFR", "BRAF").count() == 2
    assert names(c.therapies_of_first_only(graph, "EGFR", "BRAF")) == ["Cetuximab", "Gefitinib", "Osimertinib"]
    assert names(c.alternatives(graph, "Gefitinib", "Lung Cancer")) == ["Both", "Cetuximab", "Osimertinib"]
    assert names(c.resisted_by_variant(graph, "EGFR", "lung"), "variant_name") == ["A B::C Fusion", "EGFR T790M"]
    assert c.biomarkers_in_disease(graph, "Lung Cancer").count() == 4  # a fusion has a row per gene
    assert names(c.genes_affecting_therapy(graph, "Cetuximab", "lung"), "gene_symbol") == []  # no pmids, no row
    assert names(c.genes_in_disease(graph, "lung"), "gene_symbol") == ["EGFR", "KRAS"]
    assert [tuple(r) for r in c.top_biomarker_genes(graph).collect()] == [("EGFR", 3), ("KRAS", 1)]
    assert names(c.pathway_genes(graph, "EGFR"), "gene_symbol") == ["BRAF", "EGFR"]
    first = c.gene_level_evidence(graph, ("gefitinib",), "resistance", "lung").first()
    assert (first["best_evidence_level"], first["evidence_count"], first["avg_rating"]) == ("B", 2, 3.5)


def test_alias_join_is_an_equality_join(graph):
    plan = c.alternatives(graph, "Gefitinib", "Lung")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_saved_graph_answers_alike(graph, spark, tmp_path):
    graph.save(str(tmp_path))
    assert names(c.targets_of_gene(Graph.open(spark, str(tmp_path)), "EGFR")) == ["Both", "Cetuximab", "Gefitinib", "Osimertinib"]


SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, pushed", [("q1_2_genes_of_therapy", "alias"), ("q1_3_gene_of_variant", "variant_name"), ("q5_1_biomarkers_in_disease", "disease_key"), ("c1_gene_level_evidence", "effect_key")])
def test_filters_reach_the_scan(spark, name, pushed):
    plan = plan_of(c.TEMPLATES[name](Graph.saved(spark, SF)))
    filters = [line for line in plan.splitlines() if "FileScan" in line and f"{pushed}," in line.split("PushedFilters: ")[1].split("ReadSchema")[0]]
    assert filters
    edges = [line.split("Location: ")[1] for line in plan.splitlines() if "FileScan" in line and "alias" not in line.split("ReadSchema")[1]]
    assert len(edges) <= 1


def test_only_the_folders_of_a_therapy_are_read(spark):
    assert "dynamicpruning" in plan_of(c.TEMPLATES["q1_2_genes_of_therapy"](Graph.saved(spark, SF)))


def test_the_last_row_is_found_without_sorted_buffers(spark):
    for name in ("genes", "variants", "therapies", "diseases", "affects"):
        plan = plan_of(getattr(Graph.load(spark, SF), name))
        assert "SortAggregate" not in plan and "WindowGroupLimit" in plan


def test_a_graph_is_saved_once_until_its_files_change(spark, tmp_path):
    for name in TABLES:
        spark.createDataFrame(ROWS[name], TABLES[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    first = Graph.saved(spark, str(tmp_path)).genes.inputFiles()
    assert Graph.saved(spark, str(tmp_path)).genes.inputFiles() == first
    spark.createDataFrame([("NEW", None, None)], TABLES["genes"]).write.mode("append").parquet(f"{tmp_path}/genes.parquet")
    assert Graph.saved(spark, str(tmp_path)).genes.filter("symbol = 'NEW'").count() == 1


def test_limits(graph):
    assert c.targets_of_gene(graph, "EGFR", limit=2).count() == 2
    with pytest.raises(ValueError):
        c.biomarkers_in_disease(graph, "lung", limit=-5)
    assert names(c.fusions_of(graph, "C", "b"), "variant_name") == ["A B::C Fusion"]
    assert names(c.evidence_of_variant_token(graph, "t790", "gef"), "variant_name") == ["EGFR T790M"]


def test_asking_by_name(graph, spark):
    assert c.ask(graph, "q1_1_targets_of_gene", gene="EGFR", limit=2).count() == 2 and c.ask(graph, "g3_resistance_genes", limit=1).count() == 1
    for bad in (lambda: c.ask(graph, "q9", gene="x"), lambda: c.ask(graph, "q1_1_targets_of_gene", drug="x"), lambda: c.read(graph, "secrets", ["a"]), lambda: c.read(graph, "genes", ["password"])):
        with pytest.raises(ValueError):
            bad()
    assert [r[0] for r in c.read(graph, "genes", ["symbol"], 2).collect()] == ["BRAF", "EGFR"]


def test_edges_that_are_not_loaded(graph, spark):
    got = {(r["part"], r["unknown_in"], r["name"]): r["n"] for r in graph.dropped().collect()}
    assert got == {("targets", "therapies", "nobody"): 1, ("variant_of", "genes", "gone"): 1, ("affects", "therapies", "nobody"): 1}
    graph.check_types()
    bad = spark.createDataFrame([("Protein", *[None] * 13)], TABLES["affects_response"])
    with pytest.raises(ValueError):
        Graph.of({"affects_response": bad}).check_types()


def test_row_hashes(spark):
    df = spark.createDataFrame([(0.1 + 0.2, [(1, "a"), (2, "b")], ["x", "y"]), (0.3, [(2, "b"), (1, "a")], ["x", "y"]), (0.3, [(1, "a"), (2, "b")], ["y", "x"]), (None, None, None)], "d double, r array<struct<i:int,t:string>>, l array<string>")
    a, b, other, null = [r[0] for r in df.select(row_hash(df, "d", "r", "l")).collect()]
    assert a == b != other and null not in (a, other)


def test_predicates(spark):
    assert match.disease_tokens("Lung Cancer") == ["lung"] and match.disease_tokens("Cancer") == ["cancer"]
    assert match.disease_tokens("Non-small Cell Lung Cancer") == ["non-small", "cell", "lung"]
    assert match.limit_rows(None) == 100 and match.limit_rows(1000) == 200 and match.limit_rows(7) == 7
    df = spark.createDataFrame([("x", None), ("x", [None, "a"]), ("x", ["EGFR"])], "a string, s array<string>")
    assert [r[0] for r in df.select(match.gene_matches("egfr", "a", "s")).collect()] == [False, None, True]
    assert [r[0] for r in df.select(F.coalesce(match.therapy_matches("", "a", "s"), F.lit(False))).collect()] == [True, True, True]


def test_empty_graph(spark):
    empty = Graph.of({n: spark.createDataFrame([], t) for n, t in TABLES.items()})
    assert c.targets_of_gene(empty, "EGFR").count() == 0 and c.top_biomarker_genes(empty).count() == 0

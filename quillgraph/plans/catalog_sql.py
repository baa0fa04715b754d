"""SQL for DuckDB that the catalog is compared with, over the raw tables."""

from __future__ import annotations

from quillgraph.plans import catalog as c

_W = r"[\s\x{000b}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"


def text(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def parts(x: str) -> str:
    return f"[y FOR y IN [{strip('x')} FOR x IN string_split(coalesce({x}, ''), ';')] IF y <> '']"


def ident(x: str) -> str:
    return f"regexp_replace({text(x)}, '^([0-9]+)\\.0+$', '\\1')"


def _node(name: str, key: str, cols: str, order: str = "loaded_at DESC, row_id DESC") -> str:
    return f"{name}_n AS (SELECT * EXCLUDE (rn) FROM (SELECT {text(key)} AS {key}, {cols}, row_number() OVER (PARTITION BY {text(key)} ORDER BY {order}) AS rn FROM {name} WHERE {text(key)} IS NOT NULL) WHERE rn = 1)"


def _known(col: str, lists: bool = False) -> str:
    x = parts(col) if lists else text(col)
    keep = f"len({x}) > 0" if lists else f"{x} IS NOT NULL"
    got = f"last({x} ORDER BY loaded_at, row_id) FILTER (WHERE {keep})"
    return (f"coalesce({got}, [])" if lists else got) + f" AS {col}"


PRELUDE = ",\n".join(
    [
        "WITH RECURSIVE " + _node("genes", "symbol", f"{ident('hgnc_id')} AS hgnc_id, {parts('synonyms')} AS synonyms"),
        _node("variants", "name", f"{text('hgvs_p')} AS hgvs_p, {text('consequence')} AS consequence, {parts('synonyms')} AS synonyms"),
        _node("therapies", "name", f"{text('modality')} AS modality, {parts('tags')} AS tags, {text('chembl_id')} AS chembl_id, {parts('synonyms')} AS synonyms"),
        _node("diseases", "name", f"{ident('doid')} AS doid, {parts('synonyms')} AS synonyms", "row_id DESC"),
        f"variant_of_n AS (SELECT DISTINCT v AS variant_name, g AS gene_symbol FROM (SELECT {text('variant_name')} AS v, {text('gene_symbol')} AS g FROM variant_of) WHERE v IN (SELECT name FROM variants_n) AND g IN (SELECT symbol FROM genes_n))",
        f"""targets_n AS (SELECT * FROM (SELECT {text('therapy_name')} AS therapy_name, {text('gene_symbol')} AS gene_symbol, {_known('source')}, {_known('moa')}, {_known('action_type')},
  {_known('ref_sources', True)}, {_known('ref_ids', True)}, {_known('ref_urls', True)} FROM targets GROUP BY 1, 2) WHERE therapy_name IN (SELECT name FROM therapies_n) AND gene_symbol IN (SELECT symbol FROM genes_n))""",
        f"""affects_all AS (SELECT {text('biomarker_type')} AS biomarker_type, {text('biomarker_name')} AS biomarker_name, {text('therapy_name')} AS therapy_name, {text('effect')} AS effect, {text('disease_name')} AS disease_name,
  coalesce({ident('disease_id')}, '') AS disease_id, {parts('pmids')} AS pmids, {text('source')} AS source, {text('notes')} AS notes, {text('best_evidence_level')} AS best_evidence_level, {parts('evidence_levels')} AS evidence_levels,
  evidence_count, avg_rating, max_rating, loaded_at, row_id FROM affects_response)""",
        """affects_n AS (SELECT * EXCLUDE (rn, loaded_at, row_id) FROM (SELECT *, row_number() OVER (PARTITION BY biomarker_type, biomarker_name, therapy_name, effect, disease_name, disease_id ORDER BY loaded_at DESC, row_id DESC) AS rn
  FROM affects_all WHERE effect IS NOT NULL AND disease_name IS NOT NULL) WHERE rn = 1 AND therapy_name IN (SELECT name FROM therapies_n)
  AND ((biomarker_type = 'Gene' AND biomarker_name IN (SELECT symbol FROM genes_n)) OR (biomarker_type = 'Variant' AND biomarker_name IN (SELECT name FROM variants_n))))""",
        "tg AS (SELECT e.*, g.synonyms AS gs, t.synonyms AS ts, t.tags AS tags FROM targets_n e JOIN genes_n g ON g.symbol = e.gene_symbol JOIN therapies_n t ON t.name = e.therapy_name)",
        """ev AS (SELECT a.*, t.synonyms AS ts, t.tags AS tags, CASE WHEN a.biomarker_type = 'Variant' THEN a.biomarker_name END AS variant_name, CASE WHEN a.biomarker_type = 'Gene' THEN a.biomarker_name ELSE o.gene_symbol END AS gene_symbol
  FROM affects_n a JOIN therapies_n t ON t.name = a.therapy_name LEFT JOIN variant_of_n o ON a.biomarker_type = 'Variant' AND o.variant_name = a.biomarker_name)""",
    ]
)


def _has(lists: str, term: str) -> str:
    return f"list_contains([lower(x) FOR x IN {lists}], '{term.lower()}')"


def gene(term: str, p: str = "") -> str:
    return f"(lower({p}gene_symbol) = '{term.lower()}' OR {_has(p + 'gs', term)})"


def drug(term: str, p: str = "") -> str:
    return f"(lower({p}therapy_name) = '{term.lower()}' OR {_has(p + 'ts', term)} OR contains(lower({p}therapy_name), '{term.lower()}'))"


def disease(name: str) -> str:
    words = [w for w in name.split() if w != "cancer"]
    return "(" + " AND ".join(f"contains(lower(disease_name), '{w}')" for w in words) + ")"


def _flat(col: str) -> str:
    return f"array_to_string(list_sort({col}), ';') AS {col}"


_T = f"gene_symbol, therapy_name, moa AS targets_moa, {_flat('ref_sources')}, {_flat('ref_ids')}, {_flat('ref_urls')}"
_A = f"variant_name, gene_symbol, therapy_name, effect, disease_name, {_flat('pmids')}"
_M = f"{_A}, coalesce(best_evidence_level, '') AS best_evidence_level, {_flat('evidence_levels')}, CAST(coalesce(evidence_count, 0) AS BIGINT) AS evidence_count, round(avg_rating, 6) AS avg_rating, CAST(max_rating AS BIGINT) AS max_rating"
_TC = ("gene_symbol", "ref_ids", "ref_sources", "ref_urls", "targets_moa", "therapy_name")
_AC = ("disease_name", "effect", "gene_symbol", "pmids", "therapy_name", "variant_name")
_MC = ("avg_rating", "best_evidence_level", "disease_name", "effect", "evidence_count", "evidence_levels", "gene_symbol", "max_rating", "pmids", "therapy_name", "variant_name")


def _top(body: str, columns: tuple[str, ...], lead: str = "", limit: int = 100) -> str:
    order = ", ".join(f"{x} ASC NULLS FIRST" for x in sorted(columns))
    return f"{PRELUDE}\nSELECT * FROM ({body}) ORDER BY {lead}{order} LIMIT {limit}"


def _affecting(where: str, effect: str | None) -> str:
    e = f"'{effect}'" if effect else "CAST(NULL AS VARCHAR)"
    also = f" AND lower(effect) = '{effect}'" if effect else ""
    return f"""SELECT CAST(NULL AS VARCHAR) AS variant_name, gene_symbol, therapy_name, {e} AS effect, disease_name, array_to_string(list_sort(list(DISTINCT p)), ';') AS pmids
  FROM (SELECT gene_symbol, therapy_name, disease_name, unnest(pmids) AS p FROM ev WHERE gene_symbol IS NOT NULL AND {where}{also}) GROUP BY gene_symbol, therapy_name, disease_name"""


def _variant(drug_term: str, disease_term: str | None, effect: str | None) -> str:
    cols = _A.replace("effect,", f"'{effect}' AS effect,") if effect else _A
    where = f"variant_name = '{c.VARIANT}' AND gene_symbol IS NOT NULL AND {drug(drug_term)}"
    where += f" AND {disease(disease_term)}" if disease_term else ""
    where += f" AND lower(effect) = '{effect}'" if effect else ""
    return f"SELECT {cols} FROM ev WHERE {where}"


def _excluded(g: str) -> str:
    return f"therapy_name NOT IN (SELECT therapy_name FROM tg WHERE {gene(g)})"


def _alternatives(drug_term: str, disease_term: str) -> str:
    return f"""SELECT r.gene_symbol, t.therapy_name, t.moa AS targets_moa, {_flat('t.ref_sources').replace(' AS t.', ' AS ')}, {_flat('t.ref_ids').replace(' AS t.', ' AS ')}, {_flat('t.ref_urls').replace(' AS t.', ' AS ')}
  FROM (SELECT gene_symbol FROM ev WHERE gene_symbol IS NOT NULL AND {drug(drug_term)} AND {disease(disease_term)} AND lower(effect) = 'resistance') r
  JOIN tg t ON (lower(t.gene_symbol) = lower(r.gene_symbol) OR list_contains([lower(x) FOR x IN t.gs], lower(r.gene_symbol))) AND lower(t.therapy_name) <> '{drug_term}'"""


def _genes(where: str, source: str = "ev") -> str:
    return f"{PRELUDE}\nSELECT DISTINCT gene_symbol FROM {source} WHERE gene_symbol IS NOT NULL AND {where} ORDER BY 1 LIMIT 50"


def _first_only(cols: str, disease_term: str) -> str:
    inner = f"SELECT therapy_name AS hit FROM tg WHERE {gene(c.GENE_A)} AND {_excluded(c.GENE_B)}"
    return f"SELECT {cols} FROM ev JOIN ({inner}) h ON h.hit = ev.therapy_name WHERE {disease(disease_term)}"


def _table(name: str, cols: str) -> str:
    return f"{PRELUDE}\nSELECT {cols} FROM {name}_n"


_VC = ("gene_symbol", "variant_name")
_BOTH = f"""SELECT gene_symbol, therapy_name, moa AS targets_moa, {_flat('ref_sources')}, {_flat('ref_ids')}, {_flat('ref_urls')} FROM (
  SELECT a.* FROM tg a JOIN tg b USING (therapy_name) WHERE {gene(c.GENE_A, 'a.')} AND {gene(c.GENE_B, 'b.')}
  UNION ALL SELECT b.* FROM tg a JOIN tg b USING (therapy_name) WHERE {gene(c.GENE_A, 'a.')} AND {gene(c.GENE_B, 'b.')})"""

SQL = {
    "q1_1_targets_of_gene": _top(f"SELECT {_T} FROM tg WHERE {gene(c.GENE_A)}", _TC),
    "q1_2_genes_of_therapy": _top(f"SELECT {_T} FROM tg WHERE {drug(c.DRUG_A)}", _TC),
    "q1_3_gene_of_variant": _top(f"SELECT gene_symbol, variant_name FROM variant_of_n WHERE variant_name = '{c.VARIANT}'", _VC),
    "q1_4_variants_of_gene": _top(f"SELECT o.variant_name, o.gene_symbol FROM variant_of_n o JOIN (SELECT symbol AS gene_symbol, synonyms AS gs FROM genes_n) g USING (gene_symbol) WHERE {gene(c.GENE_A)}", _VC),
    "q2_1_target_properties": _top(f"SELECT {_T} FROM tg WHERE {drug('a')} AND {gene(c.GENE_A)}", _TC),
    "q2_2a_genes_affecting_therapy": _top(_affecting(f"{drug(c.DRUG_A)} AND {disease(c.DISEASE)}", None), _AC),
    "q2_2b_genes_resisting_therapy": _top(_affecting(f"{drug(c.DRUG_A)} AND {disease(c.DISEASE)}", "resistance"), _AC),
    "q2_2c_genes_sensitive_to_therapy": _top(_affecting(f"{drug(c.DRUG_A)} AND {disease(c.DISEASE)}", "sensitivity"), _AC),
    "q2_2d_variant_affecting_therapy": _top(_variant("a", "a", None), _AC),
    "q2_2e_variant_token_affecting_therapy": _top(_variant("i", c.DISEASE, None), _AC),
    "q2_3a_pmids_of_resistance": _top(_variant("a", None, "resistance"), _AC),
    "q2_3b_pmids_of_sensitivity": _top(_variant("a", None, "sensitivity"), _AC),
    "q2_4_variant_consequence": _top(f"SELECT name AS variant_name, consequence AS variant_consequence FROM variants_n WHERE name = '{c.VARIANT}'", ("variant_name", "variant_consequence")),
    "q3_1_therapies_of_either": _top(f"SELECT {_T} FROM tg WHERE {gene(c.GENE_A)} OR {gene(c.GENE_B)}", _TC),
    "q3_2_therapies_of_both": _top(_BOTH, _TC),
    "q3_3_therapies_of_first_only": _top(f"SELECT {_T} FROM tg WHERE {gene(c.GENE_A)} AND {_excluded(c.GENE_B)}", _TC),
    "q4_1_validated_therapies": _top(f"SELECT {_A} FROM ev JOIN (SELECT therapy_name AS hit FROM tg WHERE {gene(c.GENE_A)}) h ON h.hit = ev.therapy_name WHERE {disease(c.DISEASE)}", _AC),
    "q4_2_alternatives": _top(_alternatives(c.DRUG_A, c.DISEASE), _TC),
    "q5_1_biomarkers_in_disease": _top(f"SELECT {_A} FROM ev WHERE {disease(c.DISEASE)}", _AC),
    "q5_2_variant_evidence_in_disease": _top(f"SELECT {_A} FROM ev WHERE biomarker_type = 'Variant' AND {disease('juvenile')}", _AC),
    "q6_1_resistance_genes_of_either": _top(_affecting(f"({drug(c.DRUG_A)} OR {drug(c.DRUG_B)}) AND {disease(c.DISEASE)}", "resistance"), _AC),
    "q6_2_evidence_of_first_only": _top(_first_only(_A, c.DISEASE), _AC),
    "q6_3_resisted_by_variant": _top(
        f"SELECT {_A.replace('effect,', chr(39) + 'resistance' + chr(39) + ' AS effect,')} FROM ev JOIN (SELECT therapy_name AS ht, gene_symbol AS hg FROM tg WHERE {gene(c.GENE_A)}) h ON ht = therapy_name AND hg = gene_symbol WHERE biomarker_type = 'Variant' AND lower(effect) = 'resistance' AND {disease('a')}", _AC
    ),
    "q6_4_alternatives_in_disease": _top(_alternatives(c.DRUG_B, c.WORD), _TC),
    "g1_genes_in_first_disease": _genes(disease(c.DISEASE)),
    "g2_genes_in_second_disease": _genes(disease(c.WORD)),
    "g3_resistance_genes": _genes("lower(effect) = 'resistance'"),
    "g4_pathway_genes": _genes("(therapy_name IN (SELECT therapy_name FROM tg WHERE gene_symbol = 'JITLA') OR len([x FOR x IN tags IF contains(lower(x), 'jitla')]) > 0)", "tg"),
    "g5_top_biomarker_genes": f"{PRELUDE}\nSELECT gene_symbol, count(*) AS biomarker_count FROM ev WHERE gene_symbol IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
    "c1_gene_level_evidence": _top(
        f"""SELECT CAST(NULL AS VARCHAR) AS variant_name, gene_symbol, therapy_name, 'resistance' AS effect, disease_name, array_to_string(list_sort(flatten(list(pmids))), ';') AS pmids, min(best_evidence_level) AS best_evidence_level,
  coalesce(array_to_string(list_sort(list(DISTINCT best_evidence_level) FILTER (WHERE best_evidence_level IS NOT NULL)), ';'), '') AS evidence_levels, CAST(coalesce(sum(evidence_count), 0) AS BIGINT) AS evidence_count, round(avg(avg_rating), 6) AS avg_rating, CAST(max(max_rating) AS BIGINT) AS max_rating
  FROM ev WHERE gene_symbol IS NOT NULL AND ({drug(c.DRUG_A)} OR {drug(c.DRUG_B)}) AND lower(effect) = 'resistance' AND {disease(c.DISEASE)} GROUP BY gene_symbol, therapy_name, disease_name""",
        _MC,
        "best_evidence_level ASC NULLS LAST, evidence_count DESC NULLS FIRST, ",
    ),
    "c2_class_evidence": _top(f"SELECT {_M} FROM ev WHERE lower(effect) = 'resistance' AND {disease(c.DISEASE)} AND (therapy_name IN (SELECT therapy_name FROM targets_n WHERE gene_symbol = 'JITLA') OR len([x FOR x IN tags IF contains(lower(x), 'inhibitor')]) > 0)", _MC),
    "c3_target_rows_with_nulls": _top(f"SELECT CAST(NULL AS VARCHAR) AS variant_name, {_T}, CAST(NULL AS VARCHAR) AS effect, CAST(NULL AS VARCHAR) AS disease_name FROM tg WHERE {gene(c.GENE_B)}", (*_TC, "variant_name", "effect", "disease_name")),
    "c4_variant_lookup": _top(f"SELECT o.variant_name, o.gene_symbol FROM variant_of_n o JOIN (SELECT symbol AS gene_symbol, synonyms AS gs FROM genes_n) g USING (gene_symbol) WHERE {gene(c.GENE_B)}", _VC),
    "c5_exclusion_with_metrics": _top(_first_only(_M, c.WORD), _MC),
    "f19_evidence_of_variant_token": _top(
        f"SELECT {_A} FROM ev WHERE gene_symbol IS NOT NULL AND variant_name IN (SELECT name FROM variants_n WHERE contains(lower(name), '{c.TOKEN}') OR {_has('synonyms', c.TOKEN)}) AND {drug('a')}", _AC, limit=200
    ),
    "f18_fusions_of": _top("SELECT name AS variant_name, consequence AS variant_consequence FROM variants_n WHERE contains(lower(name), 'zepr::jonr') OR contains(lower(name), 'jonr::zepr')", ("variant_name", "variant_consequence")),
    "o7_biomarkers_limited": _top(f"SELECT {_A} FROM ev WHERE {disease(c.DISEASE)}", _AC, limit=7),
    "k3_saved_graph": f"{PRELUDE}\n" + " UNION ALL ".join(f"SELECT '{name}' AS part, count(*) AS n FROM {name}_n" for name in c.PARTS),
    "k4_load_genes": _table("genes", f"symbol, hgnc_id, {_flat('synonyms')}"),
    "k4_load_variants": _table("variants", f"name, hgvs_p, consequence, {_flat('synonyms')}"),
    "k4_load_therapies": _table("therapies", f"name, modality, {_flat('tags')}, chembl_id, {_flat('synonyms')}"),
    "k4_load_diseases": _table("diseases", f"name, doid, {_flat('synonyms')}"),
    "k4_load_variant_of": _table("variant_of", "variant_name, gene_symbol"),
    "k4_load_targets": _table("targets", f"therapy_name, gene_symbol, source, moa, action_type, {_flat('ref_sources')}, {_flat('ref_ids')}, {_flat('ref_urls')}"),
    "k4_load_affects": _table(
        "affects",
        f"biomarker_type, biomarker_name, therapy_name, effect, disease_name, disease_id, {_flat('pmids')}, source, notes, best_evidence_level, {_flat('evidence_levels')}, CAST(evidence_count AS BIGINT) AS evidence_count, round(avg_rating, 6) AS avg_rating, CAST(max_rating AS BIGINT) AS max_rating",
    ),
    "k5_key_violations": f"{PRELUDE}\nSELECT 'genes' AS label, symbol AS key, count(*) AS n FROM genes_n GROUP BY 2 HAVING count(*) > 1",
    "n1_biomarkers": f"{PRELUDE}\nSELECT DISTINCT biomarker_type AS kind, biomarker_name AS key FROM affects_n",
}

"""Declared schemas. Nothing is inferred when files are read."""

from __future__ import annotations

GENES = "symbol string, hgnc_id string, synonyms string"
VARIANTS = "name string, hgvs_p string, consequence string, synonyms string"
THERAPIES = "name string, modality string, tags string, chembl_id string, synonyms string"
DISEASES = "name string, doid string, synonyms string"
VARIANT_OF = "variant_name string, gene_symbol string"
TARGETS = "therapy_name string, gene_symbol string, source string, moa string, action_type string, ref_sources string, ref_ids string, ref_urls string"
AFFECTS = (
    "biomarker_type string, biomarker_name string, therapy_name string, effect string, disease_name string, disease_id string, pmids string, source string, notes string, "
    "best_evidence_level string, evidence_levels string, evidence_count string, avg_rating string, max_rating string"
)
TABLES = {"genes": GENES, "variants": VARIANTS, "therapies": THERAPIES, "diseases": DISEASES, "variant_of": VARIANT_OF, "targets": TARGETS, "affects_response": AFFECTS}
#: Columns that hold `;`-joined lists on disk.
LISTS = ("synonyms", "tags", "pmids", "ref_sources", "ref_ids", "ref_urls", "evidence_levels")

EVIDENCE = (
    "gene struct<name:string,symbol:string>, variant struct<name:string,display_name:string,hgvs_expressions:struct<p_dot:string,protein:string>>, molecular_profile struct<name:string>, "
    "disease struct<name:string,display_name:string,doid:string,diseaseAliases:array<string>>, drugs array<struct<name:string,drug_name:string>>, clinical_significance string, "
    "evidence_direction string, evidence_level string, evidence_rating string, status string, sources array<struct<pubmed_id:string,pmid:string,citation_id:string>>, evidence_statement string"
)
NODE = (
    "id string, description string, molecularProfile struct<name:string>, disease struct<name:string,doid:string,diseaseAliases:array<string>>, therapies array<struct<name:string>>, significance string, "
    "evidenceLevel string, evidenceRating string, evidenceDirection string, status string, source struct<citationId:string,link:string,url:string>"
)
#: A page of the second interface.
PAGE = f"data struct<evidenceItems:struct<pageInfo:struct<hasNextPage:boolean,endCursor:string>,edges:array<struct<node:struct<{', '.join(p.replace(' ', ': ', 1) for p in NODE.split(', '))}>>>>>, errors array<string>"
DRUG = (
    "id string, name string, drugType string, synonyms array<string>, tradeNames array<string>, linkedTargets struct<rows:array<struct<approvedSymbol:string>>>, "
    "mechanismsOfAction struct<rows:array<struct<mechanismOfAction:string,actionType:string,targets:array<struct<approvedSymbol:string>>,references:array<struct<source:string,ids:array<string>,urls:array<string>>>>>>"
)
GENE_SETS = "library string, term string, gene string"
PAIRS = "id string, family_id string, template_id string, question string, cypher string, placeholders map<string,string>, source string, paraphrase_of string"
TRACE = "timestamp timestamp, run_id string, step string, payload string"
CACHE = "cache_key string, cache_type string, value string, run_id string, created_at timestamp, expires_at timestamp, access_count bigint, last_accessed_at timestamp"

"""Results as people see them: columns, text lines, graph elements, exports; and what a question may ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import clean_array, null_if_blank
from quillgraph.operators.ingest import LEVELS, effect_category
from quillgraph.operators.match import limit_rows
from quillgraph.schemas import TABLES

#: Order in which known columns are shown (fixed values); others follow by name.
SHOWN_FIRST = ("variant_name", "gene_symbol", "therapy_name", "effect", "disease_name", "pmids", "evidence_count", "avg_rating", "max_rating")
#: Computed for sorting, not shown.
HIDDEN = ("best_evidence_level",)


def _told(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    if kind.startswith("array"):
        return F.size(clean_array(F.col(c).cast("array<string>"))) > 0
    return F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")


def shown_columns(df: DataFrame) -> DataFrame:
    """The columns in which some row says anything, known ones first. One aggregation over all rows."""
    if not df.columns:
        return df
    says = df.agg(*[F.max(_told(df, c)).alias(c) for c in df.columns]).first()
    left = [c for c in df.columns if says[c] and c not in HIDDEN]
    return df.select(*[c for c in SHOWN_FIRST if c in left], *sorted(c for c in left if c not in SHOWN_FIRST))


def by_level(df: DataFrame, pos: str) -> DataFrame:
    """Rows by best evidence level, those without one last, otherwise in the order of `pos`."""
    rank = F.instr(F.lit(LEVELS), F.upper(F.trim("best_evidence_level")))
    return df.orderBy(F.when((F.length(F.trim("best_evidence_level")) == 1) & (rank > 0), rank).otherwise(999), pos)


def text_lines(df: DataFrame, order: list[str], limit: int | None = None) -> DataFrame:
    """(line): numbered `key: value` text of the first rows (of `limit_rows`)."""
    kinds = dict(df.dtypes)
    value = lambda c: F.array_join(c, ", ") if kinds[c].startswith("array") else F.col(c).cast("string")
    told = F.concat_ws("; ", *[F.when(_told(df, c), F.concat(F.lit(f"{c}: "), value(c))) for c in df.columns])
    few = df.orderBy(*order).limit(limit_rows(limit))
    return few.select(F.concat(F.row_number().over(Window.orderBy(*order)).cast("string"), F.lit(". "), told).alias("line"))


def preview(df: DataFrame, order: list[str], n: int = 3) -> DataFrame:
    """The first n rows in order."""
    return df.orderBy(*order).limit(n)


def gene_symbols(df: DataFrame, column: str = "gene_symbol") -> DataFrame:
    """The distinct symbols that result rows name, stripped, in order."""
    return df.select(null_if_blank(F.col(column)).alias(column)).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def pretty(c: Column) -> Column:
    """A column's name as a heading: words of underscores, each with a capital."""
    return F.initcap(F.regexp_replace(c, "_+", " "))


def host(url: Column) -> Column:
    """The host of a URL without www., or the text itself where there is none."""
    return F.coalesce(F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^www\.", ""), url)


def one_decimal(c: Column) -> Column:
    return F.format_string("%.1f", c.cast("double"))


def node_id(kind: str, name: Column) -> Column:
    return safe_id(F.concat(F.lit(f"{kind}:"), name))


def safe_id(c: Column) -> Column:
    """Letters, digits and . _ - stay; runs of all else become one underscore."""
    return F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_")


def graph_elements(rows: DataFrame, pos: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of result rows: node id, label and kind; edge id, ends, label, relationship, effect, its category, disease, pmid_count and moa.

    rows: any of variant_name, gene_symbol, therapy_name (a text or a list), effect, disease_name, pmids, targets_moa,
    and pos. A variant and its gene give a VARIANT_OF edge. A row with an effect and a biomarker gives an
    AFFECTS_RESPONSE_TO edge per therapy, which effect and disease tell apart; else a row of a result that projects
    targets_moa gives a TARGETS edge from therapy to gene. Blank names are none. The first of an id wins.
    """
    kinds = dict(rows.dtypes)
    text = lambda c: null_if_blank(F.col(c)) if c in kinds else F.lit(None).cast("string")
    variant, gene, effect, disease, moa = map(text, ("variant_name", "gene_symbol", "effect", "disease_name", "targets_moa"))
    therapies = clean_array(F.col("therapy_name")) if kinds["therapy_name"].startswith("array") else F.filter(F.array(text("therapy_name")), lambda t: t.isNotNull())
    start = F.coalesce(node_id("Variant", variant), node_id("Gene", gene))
    pmids = F.size(F.coalesce("pmids", F.array().cast("array<string>"))) if "pmids" in kinds else F.lit(0)
    node = lambda kind, name: F.struct(node_id(kind, name).alias("id"), name.alias("label"), F.lit(kind).alias("kind"))
    targets = F.lit("targets_moa" in kinds) & gene.isNotNull()
    said = F.concat(effect, F.coalesce(F.concat(F.lit(" ("), disease, F.lit(")")), F.lit("")))

    def edge(name: str, source: Column, target: Column, label: Column, **more: Column) -> Column:
        about = {"effect": "string", "effect_category": "string", "disease": "string", "pmid_count": "int", "moa": "string"}
        key = F.concat_ws("|", F.lit(name), source, target, *([] if name == "VARIANT_OF" else [label]))
        return F.struct(safe_id(key).alias("id"), source.alias("source"), target.alias("target"), label.alias("label"), F.lit(name).alias("relationship"), *[more.get(k, F.lit(None)).cast(t).alias(k) for k, t in about.items()])

    def of_therapy(t: Column) -> Column:
        evidence = edge("AFFECTS_RESPONSE_TO", start, node_id("Therapy", t), said, effect=effect, effect_category=effect_category(effect), disease=disease, pmid_count=pmids)
        target = edge("TARGETS", node_id("Therapy", t), node_id("Gene", gene), F.lit("TARGETS"), moa=moa)
        return F.when(start.isNotNull() & effect.isNotNull(), evidence).when(targets, target)

    each = F.concat(F.array(F.when(variant.isNotNull(), node("Variant", variant)), F.when(gene.isNotNull(), node("Gene", gene))), F.transform(therapies, lambda t: node("Therapy", t)))
    links = F.concat(F.array(F.when(variant.isNotNull() & gene.isNotNull(), edge("VARIANT_OF", node_id("Variant", variant), node_id("Gene", gene), F.lit("VARIANT_OF")))), F.transform(therapies, of_therapy))

    def first(c: Column) -> DataFrame:
        got = rows.select(F.posexplode(c).alias("_i", "x"), F.col(pos).alias("_p")).filter(F.col("x").isNotNull())
        return got.groupBy("x.id").agg(F.min_by("x", F.struct("_p", "_i")).alias("x")).select("x.*")

    return first(each), first(links)


def export_csv(df: DataFrame, path: str, about: dict[str, str], limit: int | None = None) -> None:
    """One file for people: `#` lines on where the rows come from, a header, and the first rows with lists joined by `; `."""
    kinds = dict(df.dtypes)
    names = sorted(df.columns)
    texts = [F.array_join(c, "; ") if kinds[c].startswith("array") else F.to_json(c) if kinds[c].startswith(("struct", "map")) else F.col(c).cast("string") for c in names]
    quoted = lambda c: F.when(c.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    few = df.limit(limit_rows(limit)).select(F.concat_ws(",", *[F.coalesce(quoted(c), F.lit("")) for c in texts]).alias("value"))
    head = [f"# {k}: {v}" for k, v in about.items()] + [",".join(names)]
    lines = df.sparkSession.createDataFrame(list(enumerate(head)), "i int, value string").unionByName(few.withColumn("i", F.lit(len(head))))
    lines.coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)


def check_request(table: str, columns: list[str]) -> None:
    """Raise ValueError for a table or column that questions may not read."""
    if table not in TABLES:
        raise ValueError(f"unknown table {table}")
    known = {c.split()[0] for c in TABLES[table].split(", ")}
    if bad := [c for c in columns if c not in known]:
        raise ValueError(f"unknown columns of {table}: {', '.join(bad)}")

"""The property graph as tables: loading, cleaning, upserts, and the joins that most questions share."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import null_if_blank, split_list
from quillgraph.schemas import LISTS, TABLES
from quillgraph.session import partitions, scratch, stamp, table

#: Properties of each node and edge table, and what identifies a row.
KEYS = {
    "genes": ("symbol",),
    "variants": ("name",),
    "therapies": ("name",),
    "diseases": ("name",),
    "variant_of": ("variant_name", "gene_symbol"),
    "targets": ("therapy_name", "gene_symbol"),
    "affects_response": ("biomarker_type", "biomarker_name", "therapy_name", "effect", "disease_name", "disease_id"),
}
#: The tables of a loaded graph.
PARTS = ("genes", "variants", "therapies", "diseases", "variant_of", "targets", "affects")
#: Tables that questions read: edges with both ends, and names by which genes and therapies are looked up.
VIEWS = ("gene_names", "therapy_names", "targeting", "evidence")
_NUMBERS = {"evidence_count": "int", "avg_rating": "double", "max_rating": "int"}
_IDS = ("disease_id", "doid", "hgnc_id")
#: Folders that edges with both ends are spread over.
_FOLDERS = 16
#: Folders of the graphs that this process has saved.
_SAVED: dict[tuple, str] = {}


def _together(writers: list[DataFrameWriter], paths: list[str]) -> None:
    """Write several tables side by side, so that small ones fill the cluster."""
    with ThreadPoolExecutor(len(writers)) as pool:
        list(pool.map(lambda writer, path: writer.parquet(path), writers, paths))


def _part(therapy: str) -> Column:
    return F.pmod(F.xxhash64(therapy), F.lit(_FOLDERS)).cast("int")


def clean_id(c: Column) -> Column:
    """Ids read as floats back to whole numbers; all others stripped; blank to null."""
    text = null_if_blank(c)
    whole = text.rlike(r"^[0-9]+\.0+$")
    return F.when(whole, F.regexp_replace(text, r"\.0+$", "")).otherwise(text)


def clean_rows(df: DataFrame, name: str) -> DataFrame:
    """The columns of table `name`, typed: text stripped, blank to null, lists split, numbers null where unreadable.

    Missing columns are typed nulls, so that files of the short layout load; additional ones are left out, but for
    row_id and loaded_at, which order rows of the same key.
    """
    out = []
    for part in TABLES[name].split(", "):
        c = part.split()[0]
        have = F.col(c) if c in df.columns else F.lit(None).cast("string")
        if c in LISTS:
            out.append(split_list(have.cast("string")).alias(c))
        elif c in _NUMBERS:
            out.append(have.cast("string").try_cast("double").cast(_NUMBERS[c]).alias(c))
        elif c in _IDS:
            out.append(clean_id(have.cast("string")).alias(c))
        else:
            out.append(null_if_blank(have.cast("string")).alias(c))
    order = [F.col(c) if c in df.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("loaded_at", "timestamp"), ("row_id", "bigint"))]
    return df.select(*out, F.struct(*order).alias("_pos"))


def last_wins(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per key, the last by _pos. Null keys: none of the node keys may be null; edges keep null properties.

    The last row of each key is kept per task before rows are sent, so that a hot key doesn't gather in a task. Rows
    of one position are told apart by their properties.
    """
    rest = [c for c in df.columns if c not in keys and c != "_pos"]
    if not rest:
        return df.select(*keys).distinct()
    last = Window.partitionBy(*keys).orderBy(F.desc("_pos"), *[F.desc(c) for c in rest])
    return df.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") == 1).select(*keys, *rest)


def last_known(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per key; of each property the last that isn't null (an empty list counts as no value)."""
    rest = [c for c in df.columns if c not in keys and c != "_pos"]
    kinds = dict(df.dtypes)

    def known(c: str) -> Column:
        value = F.when(F.size(c) > 0, F.col(c)) if kinds[c].startswith("array") else F.col(c)
        return F.max_by(value, F.when(value.isNotNull(), F.col("_pos")))

    got = df.groupBy(*keys).agg(*[known(c).alias(c) for c in rest])
    return got.select(*keys, *[F.coalesce(c, F.array().cast(kinds[c])).alias(c) if kinds[c].startswith("array") else F.col(c) for c in rest])


class Graph:
    """Nodes and edges, each built from the raw rows when it is first asked for. `affects` has disease_id '' for null."""

    def __init__(self, read: Callable[[str], DataFrame]) -> None:
        self._read = read

    @staticmethod
    def of(tables: dict[str, DataFrame]) -> Graph:
        return Graph(lambda name: tables[name])

    @staticmethod
    def load(spark: SparkSession, directory: str) -> Graph:
        """Upsert the raw tables below `directory`: nodes, then edges whose ends both exist."""
        return Graph(lambda name: table(spark, directory, name))

    def save(self, directory: str) -> None:
        """Write the loaded tables and those that questions read, replacing what is there.

        Edges with both ends lie in folders by the hash of their therapy, so that a question on a therapy reads its
        folder only, and are sorted for pruning by statistics. What is written first is read for what follows from it.
        """
        _together([getattr(self, name).write.mode("overwrite") for name in PARTS], [f"{directory}/{name}" for name in PARTS])
        spark = self.genes.sparkSession
        graph = Graph.open(spark, directory, ())
        writers = []
        for name in VIEWS:
            df = getattr(graph, name)
            if name in ("targeting", "evidence"):
                df = df.repartition(partitions(spark), "therapy_part").sortWithinPartitions("therapy_part", "therapy_name")
                writers.append(df.write.mode("overwrite").partitionBy("therapy_part"))
            else:
                writers.append(df.write.mode("overwrite"))
        _together(writers, [f"{directory}/{name}" for name in VIEWS])

    @staticmethod
    def open(spark: SparkSession, directory: str, views: tuple[str, ...] = VIEWS) -> Graph:
        """A graph that `save` wrote; questions then read it without loading it again."""
        graph = Graph(lambda name: table(spark, directory, name))
        for name in (*PARTS, *views):
            graph.__dict__[name] = spark.read.parquet(f"{directory}/{name}")
        return graph

    @staticmethod
    def saved(spark: SparkSession, directory: str) -> Graph:
        """The graph of the raw tables below `directory`, loaded and saved once per session and state of the files."""
        key = (spark.sparkContext.applicationId, directory, stamp(spark, [f"{directory}/{name}.parquet" for name in TABLES]))
        if key not in _SAVED:
            at = scratch(spark)
            Graph.load(spark, directory).save(at)
            _SAVED[key] = at
        return Graph.open(spark, _SAVED[key])

    def _rows(self, name: str) -> DataFrame:
        return clean_rows(self._read(name), name)

    def _nodes(self, name: str) -> DataFrame:
        return last_wins(self._rows(name).filter(F.col(KEYS[name][0]).isNotNull()), KEYS[name])

    def _keys(self, name: str) -> DataFrame:
        """The keys of a node table, without the work that its properties take."""
        key = KEYS[name][0]
        if name in self.__dict__:
            return self.__dict__[name].select(key)
        return self._rows(name).select(key).filter(F.col(key).isNotNull()).distinct()

    @cached_property
    def genes(self) -> DataFrame:
        return self._nodes("genes")

    @cached_property
    def variants(self) -> DataFrame:
        return self._nodes("variants")

    @cached_property
    def therapies(self) -> DataFrame:
        return self._nodes("therapies")

    @cached_property
    def diseases(self) -> DataFrame:
        return self._nodes("diseases")

    @cached_property
    def variant_of(self) -> DataFrame:
        edges = last_wins(self._rows("variant_of"), KEYS["variant_of"])
        edges = edges.join(self._keys("variants"), F.col("variant_name") == F.col("name"), "left_semi")
        return edges.join(self._keys("genes"), F.col("gene_symbol") == F.col("symbol"), "left_semi")

    @cached_property
    def targets(self) -> DataFrame:
        edges = last_known(self._rows("targets").filter(F.col("gene_symbol").isNotNull() & F.col("therapy_name").isNotNull()), KEYS["targets"])
        edges = edges.join(self._keys("therapies"), F.col("therapy_name") == F.col("name"), "left_semi")
        return edges.join(self._keys("genes"), F.col("gene_symbol") == F.col("symbol"), "left_semi")

    def _affects_rows(self) -> DataFrame:
        edges = self._rows("affects_response").filter(F.col("biomarker_type").isin("Gene", "Variant") & F.col("effect").isNotNull() & F.col("disease_name").isNotNull())
        return edges.withColumn("disease_id", F.coalesce("disease_id", F.lit("")))

    @cached_property
    def affects(self) -> DataFrame:
        """Edges of a biomarker type other than Gene and Variant, or without effect or disease, are not loaded."""
        edges = last_wins(self._affects_rows(), KEYS["affects_response"])
        ends = self._keys("genes").select(F.lit("Gene").alias("_t"), F.col("symbol").alias("_k")).unionByName(self._keys("variants").select(F.lit("Variant").alias("_t"), F.col("name").alias("_k")))
        edges = edges.join(ends, (F.col("biomarker_type") == F.col("_t")) & (F.col("biomarker_name") == F.col("_k")), "left_semi")
        return edges.join(self._keys("therapies"), F.col("therapy_name") == F.col("name"), "left_semi")

    @cached_property
    def targeting(self) -> DataFrame:
        """TARGETS with both ends: gene_symbol, gene_synonyms, therapy_name, therapy_synonyms, tags and the properties."""
        genes = self.genes.select(F.col("symbol").alias("gene_symbol"), F.col("synonyms").alias("gene_synonyms"))
        therapies = self.therapies.select(F.col("name").alias("therapy_name"), F.col("synonyms").alias("therapy_synonyms"), "tags")
        return self.targets.join(genes, "gene_symbol").join(therapies, "therapy_name").withColumn("therapy_part", _part("therapy_name"))

    @cached_property
    def evidence(self) -> DataFrame:
        """AFFECTS with the therapy, and the biomarker's gene: itself, or each gene that its variant is of, or none.

        effect_key and disease_key are in lower case.
        """
        therapies = self.therapies.select(F.col("name").alias("therapy_name"), F.col("synonyms").alias("therapy_synonyms"), "tags")
        of = self.variant_of.select(F.lit("Variant").alias("biomarker_type"), F.col("variant_name").alias("biomarker_name"), F.col("gene_symbol").alias("_gene"))
        got = self.affects.join(therapies, "therapy_name").join(of, ["biomarker_type", "biomarker_name"], "left")
        is_gene = F.col("biomarker_type") == "Gene"
        got = got.withColumn("gene_symbol", F.when(is_gene, F.col("biomarker_name")).otherwise(F.col("_gene"))).withColumn("variant_name", F.when(~is_gene, F.col("biomarker_name"))).drop("_gene")
        return got.withColumns({"effect_key": F.lower("effect"), "disease_key": F.lower("disease_name"), "therapy_part": _part("therapy_name")})

    @cached_property
    def gene_names(self) -> DataFrame:
        """(alias, target_symbol): the lowered symbol and synonyms of each gene, once each."""
        names = F.explode(F.array_distinct(F.transform(F.concat(F.array("symbol"), "synonyms"), F.lower)))
        return self.genes.select(names.alias("alias"), F.col("symbol").alias("target_symbol")).distinct()

    @cached_property
    def therapy_names(self) -> DataFrame:
        """(alias, own, therapy_name, therapy_part): the lowered name of each therapy (own) and its synonyms."""
        own = F.array(F.struct(F.lower("name").alias("alias"), F.lit(True).alias("own")))
        others = F.transform("synonyms", lambda s: F.struct(F.lower(s).alias("alias"), F.lit(False).alias("own")))
        return self.therapies.select(F.explode(F.array_distinct(F.concat(own, others))).alias("n"), F.col("name").alias("therapy_name")).select("n.*", "therapy_name", _part("therapy_name").alias("therapy_part"))

    def gene_aliases(self) -> DataFrame:
        """(alias, target_symbol), as genes are looked up."""
        return self.gene_names

    def genes_named(self, *terms: str) -> DataFrame:
        """(gene_symbol) of the genes with one of the terms as symbol or synonym, without regard to case."""
        hit = self.gene_names.filter(F.col("alias").isin([t.lower() for t in terms]))
        return hit.select(F.col("target_symbol").alias("gene_symbol")).distinct()

    def therapies_named(self, *terms: str) -> DataFrame:
        """(therapy_name, therapy_part) of the therapies with one of the terms as name or synonym, or within the name."""
        low = [t.lower() for t in terms]
        inside = reduce(lambda a, b: a | b, [F.contains("alias", F.lit(t)) for t in low])
        return self.therapy_names.filter(F.col("alias").isin(low) | (F.col("own") & inside)).select("therapy_name", "therapy_part").distinct()

    def biomarkers(self) -> DataFrame:
        return self.affects.select(F.col("biomarker_type").alias("kind"), F.col("biomarker_name").alias("key")).distinct()

    def dropped(self) -> DataFrame:
        """(part, unknown_in, name, n): edges that aren't loaded, by the end that no node table knows."""
        rows = self._rows("targets").select("therapy_name", "gene_symbol").na.drop().distinct()
        of = self._rows("variant_of").select("variant_name", "gene_symbol").na.drop().distinct()
        affects = self._affects_rows().select(*KEYS["affects_response"]).distinct()
        ends = (
            ("targets", rows, "therapy_name", "therapies"), ("targets", rows, "gene_symbol", "genes"), ("variant_of", of, "variant_name", "variants"), ("variant_of", of, "gene_symbol", "genes"),
            ("affects", affects, "therapy_name", "therapies"), ("affects", affects.filter("biomarker_type = 'Gene'"), "biomarker_name", "genes"), ("affects", affects.filter("biomarker_type = 'Variant'"), "biomarker_name", "variants"),
        )
        out = []
        for part, edges, end, nodes in ends:
            names = edges.filter(F.col(end).isNotNull()).groupBy(F.col(end).alias("name")).agg(F.count(F.lit(1)).alias("n"))
            known = self._keys(nodes).select(F.col(KEYS[nodes][0]).alias("name"))
            out.append(names.join(known, "name", "left_anti").select(F.lit(part).alias("part"), F.lit(nodes).alias("unknown_in"), "name", "n"))
        return reduce(DataFrame.unionByName, out)

    def check_types(self) -> None:
        """Raise ValueError for a biomarker type other than Gene and Variant; null ones are left out of the load."""
        kind = F.col("biomarker_type")
        if bad := self._rows("affects_response").filter(kind.isNotNull() & ~kind.isin("Gene", "Variant")).select(kind).first():
            raise ValueError(f"unknown biomarker type {bad[0]}")

    def violations(self) -> DataFrame:
        """(label, key, n) of node keys that occur more than once; none after an upsert."""
        out = None
        for label, df in (("genes", self.genes), ("variants", self.variants), ("therapies", self.therapies), ("diseases", self.diseases)):
            one = df.groupBy(F.col(KEYS[label][0]).alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(label).alias("label"), "key", "n")
            out = one if out is None else out.unionByName(one)
        return out

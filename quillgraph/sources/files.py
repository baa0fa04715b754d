"""Readers and writers of the project's files, with declared schemas."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import ArrayType, StructField, StructType

from quillgraph.operators.ingest import from_connection
from quillgraph.schemas import DRUG, EVIDENCE, GENE_SETS, PAGE, PAIRS, TABLES


def read_graph_csv(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A node or edge file; columns that a short layout lacks are null (matched by name, not by place). Texts may span lines."""
    have = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)  # all text: only the header is looked at
    want = [c.split()[0] for c in TABLES[name].split(", ")]
    return have.select(*[F.col(c) if c in have.columns else F.lit(None).cast("string").alias(c) for c in want])


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Evidence records: a JSON list, or an object with them under `records`, read once. _pos keeps their order within the input."""
    fields = StructType.fromDDL(EVIDENCE)
    both = StructType([*fields, StructField("records", ArrayType(fields))])
    rows = spark.read.schema(both).option("multiLine", True).json(path)
    alone = F.when(F.col("status").isNotNull() | F.col("gene").isNotNull(), F.array(F.struct(*fields.names)))
    return rows.select(F.explode(F.coalesce("records", alone)).alias("r")).select("r.*").withColumn("_pos", F.monotonically_increasing_id())


class PageSource(DataSource):
    """Landed pages of the second interface, in the order of their names, as rows (page, text).

    Reading stops at the first page that is no JSON, has errors, or says that it is the last, as fetching would; what
    was read before is kept. options: path, max_pages.
    """

    @classmethod
    def name(cls) -> str:
        return "evidence_pages"

    def schema(self) -> str:
        return "page int, text string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PageReader(self.options["path"], int(self.options.get("max_pages", 0)))


class _PageReader(DataSourceReader):
    def __init__(self, path: str, most: int) -> None:
        self.path, self.most = path, most

    def read(self, partition: object) -> Iterator[tuple]:
        from pathlib import Path

        for i, page in enumerate(sorted(Path(self.path).glob("*.json"))):
            if self.most and i >= self.most:
                return
            text = page.read_text("utf-8")
            try:
                got = json.loads(text)
                if "errors" in got:
                    return
                last = not (((got.get("data") or {}).get("evidenceItems") or {}).get("pageInfo") or {}).get("hasNextPage")
            except (ValueError, AttributeError):
                return
            yield i, text
            if last:
                return


def read_pages(spark: SparkSession, path: str, max_pages: int | None = None) -> DataFrame:
    """Accepted records of landed pages in the shape of `read_evidence`."""
    spark.dataSource.register(PageSource)
    pages = spark.read.format("evidence_pages").option("path", path).option("max_pages", max_pages or 0).load()
    got = pages.select("page", F.from_json("text", PAGE).alias("p")).select("page", F.posexplode("p.data.evidenceItems.edges").alias("i", "e"))
    nodes = got.select("e.node.*", (F.col("page").cast("bigint") * F.lit(1 << 32) + F.col("i")).alias("_pos"))
    return from_connection(accepted(nodes))


def read_source(spark: SparkSession, pages: str | None = None, input_json: str | None = None, max_pages: int | None = None) -> DataFrame:
    """Evidence of the first interface where a file is given, else of landed pages of the second."""
    if input_json:
        return read_evidence(spark, input_json)
    if not pages:
        raise ValueError("neither a file nor pages are given")
    return read_pages(spark, pages, max_pages)


def accepted(evidence: DataFrame) -> DataFrame:
    """Records that curators accepted; those without a status count as accepted."""
    return evidence.filter(F.coalesce(F.upper("status"), F.lit("ACCEPTED")) == "ACCEPTED")


def read_drugs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DRUG).json(path)


def read_gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """(library, term, gene) from CSV files with a header."""
    return spark.read.schema(GENE_SETS).option("header", True).csv(path)


def read_pairs(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """JSON lines; lines that can't be read are left out. first: so many records of each file, in their order."""
    rows = spark.read.schema(PAIRS).option("mode", "DROPMALFORMED").json(path)
    if first is None:
        return rows
    at = Window.partitionBy("_file").orderBy("_at")  # a file's rows up to `first` leave each task
    placed = rows.withColumns({"_file": F.col("_metadata.file_path"), "_at": F.struct("_metadata.file_block_start", F.monotonically_increasing_id())})
    return placed.withColumn("_n", F.row_number().over(at)).filter(F.col("_n") <= first).drop("_file", "_at", "_n")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(file, model, metric, value) of result files, whose metrics lie under `models` by name, or at the top."""
    kind = "map<string,double>"
    rows = spark.read.schema(f"models map<string,struct<metrics:{kind}>>, metrics {kind}").option("multiLine", True).json(path).withColumn("file", F.element_at(F.split("_metadata.file_name", "/"), -1))
    named = F.transform(F.map_entries("models"), lambda e: F.struct(e["key"].alias("model"), e["value"]["metrics"].alias("m")))
    alone = F.array(F.struct(F.regexp_replace("file", r"(_evaluation_results)?\.json$", "").alias("model"), F.col("metrics").alias("m")))
    got = rows.select("file", F.explode(F.coalesce(named, alone)).alias("x")).select("file", "x.model", F.explode("x.m").alias("metric", "value"))
    return got.filter("value is not null")


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines, null fields left out; of a split, a folder for each of its parts."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy("split") if "split" in df.columns else writer).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write_csv(df: DataFrame, path: str) -> None:
    """Null as empty text, lists joined by `;`."""
    kinds = dict(df.dtypes)
    flat = df.select(*[F.array_join(c, ";").alias(c) if kinds[c].startswith("array") else F.col(c) for c in df.columns])
    flat.write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def write_snapshot(df: DataFrame, path: str, day: str) -> None:
    """A table's rows of one day; a day that is written again is replaced, others stay."""
    df.withColumn("snapshot_date", F.lit(day)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The last snapshot: its folder is found by name, and no other is read."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    days = sorted(f.getPath().getName() for f in files.listStatus(at) if f.getPath().getName().startswith("snapshot_date="))
    if not days:
        raise FileNotFoundError(f"no snapshot below {path}")
    return spark.read.option("basePath", path).parquet(f"{path}/{days[-1]}").withColumn("snapshot_date", F.col("snapshot_date").cast("string"))


def resume(todo: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Records that have not been processed."""
    return todo.join(done.select(key).distinct(), key, "left_anti")

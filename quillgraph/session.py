"""Session settings, table access and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def local_session(app: str = "quillgraph", cores: str = "*", shuffle: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUILLGRAPH_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The parquet table `name` below `directory`."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def local_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Few rows of the driver as a relation that needs no Python workers."""
    fields = StructType.fromDDL(schema)
    columns = list(zip(*rows)) or [()] * len(fields)
    return spark.createDataFrame(pa.table([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, fields)], names=fields.names), fields)


def partitions(spark: SparkSession) -> int:
    """Number of tasks that the session plans for an exchange."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _shared_folder(spark: SparkSession) -> str:
    """The folder for lineage cuts, which all executors share; only a local session that names none gets its own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is unset on a cluster")
            shared = tempfile.mkdtemp(prefix="quillgraph-")
        context.setCheckpointDir(shared)
    return context._jsc.sc().getCheckpointDir().get()


def _path(spark: SparkSession, at: str):
    """The path and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession) -> str:
    """The name of a new folder in the session's checkpoint folder; it goes with the session."""
    at = f"{_shared_folder(spark)}/{uuid.uuid4().hex}"
    path, files = _path(spark, at)
    files.deleteOnExit(path)
    return at


def stamp(spark: SparkSession, paths: list[str]) -> tuple:
    """Sizes and times of the files at the paths, which change when the files do."""
    out = []
    for at in paths:
        path, files = _path(spark, at)
        if files.exists(path):
            out += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files.listStatus(path)]
    return tuple(sorted(out))


def cut(df: DataFrame, **watched: Column) -> DataFrame:
    """Write `df` to a table in the session's checkpoint folder and go on from there.

    The table holds no plan, so that loops don't plan ever longer; it goes with the session, or with `release`.
    watched: aggregates that are taken while the table is written, without a job of their own; see `seen`.
    """
    spark = df.sparkSession
    at = scratch(spark)
    watch = Observation()
    out = df.observe(watch, *[c.alias(name) for name, c in watched.items()]) if watched else df
    out.write.parquet(at)
    got = spark.read.schema(df.schema).parquet(at)
    got._cut_at = at
    got._seen = dict(watch.get) if watched else {}
    return got


def seen(df: DataFrame, name: str) -> int:
    """What `cut` watched under this name; 0 where there were no rows."""
    return df._seen.get(name) or 0


def release(*cuts: DataFrame) -> None:
    """Delete tables of `cut` that nothing reads any more."""
    for df in cuts:
        path, files = _path(df.sparkSession, df._cut_at)
        files.delete(path, True)

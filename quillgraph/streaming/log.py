"""The event log: traces, result cache, rates. Each job has a batch form and, where time matters, a streaming form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.schemas import TRACE


def first_steps(events: DataFrame, run: str = "run_id", step: str = "step", at: str = "timestamp") -> DataFrame:
    """Each step of a run once, at its first time. On a stream, the first that arrives within the watermark."""
    if events.isStreaming:
        return events.withWatermark(at, "1 hour").dropDuplicatesWithinWatermark([run, step]).select(run, step, at)
    return events.groupBy(run, step).agg(F.min(at).alias(at))


def live_entries(cache: DataFrame, now: Column) -> DataFrame:
    """Entries not expired at `now`; the last moment counts as live."""
    return cache.filter(F.col("expires_at") >= now)


def upsert_entries(cache: DataFrame, new: DataFrame) -> DataFrame:
    """`new` replaces values and expiry of entries with the same key, which keep created_at and access_count; the last new one wins."""
    old = cache.withColumn("_new", F.lit(0))
    both = old.unionByName(new.withColumn("_new", F.lit(1)))
    latest = F.struct("_new", "created_at")
    rest = [c for c in cache.columns if c not in ("cache_key", "created_at", "access_count")]
    return both.groupBy("cache_key").agg(*[F.max_by(c, latest).alias(c) for c in rest], F.min_by("created_at", latest).alias("created_at"), F.min_by("access_count", latest).alias("access_count")).select(*cache.columns)


def without_prefix(cache: DataFrame, prefix: str) -> DataFrame:
    return cache.filter(~F.startswith("cache_key", F.lit(prefix)))


def without_key(cache: DataFrame, key: str) -> DataFrame:
    return cache.filter(F.col("cache_key") != key)


def without_run(cache: DataFrame, run: str) -> DataFrame:
    """Entries of other runs; those of no run stay."""
    return cache.filter(~F.col("run_id").eqNullSafe(F.lit(run)))


def sweep(cache: DataFrame, now: Column, writes: int, every: int = 100) -> DataFrame:
    """The entries without expired ones, at each `every`-th write; else as they are."""
    return live_entries(cache, now) if writes and writes % every == 0 else cache


def feedback(runs: DataFrame, at: Column) -> DataFrame:
    """Feedback as events (schemas.TRACE). runs: run_id, cypher_correct. Feedback without a run is none."""
    said = F.to_json(F.struct("run_id", "cypher_correct"))
    return runs.filter(F.col("run_id").isNotNull()).select(at.cast("timestamp").alias("timestamp"), "run_id", F.lit("feedback").alias("step"), said.alias("payload"))


def messages(steps: DataFrame, texts: dict[str, str], step: str = "step") -> DataFrame:
    """Steps that have a message for people, with it."""
    text = F.element_at(F.create_map(*[F.lit(x) for pair in texts.items() for x in pair]), F.col(step))
    return steps.withColumn("message", text).filter(F.col("message").isNotNull())


def write_everywhere(events: DataFrame, sinks: Sequence[tuple[str, Sequence[str] | None]]) -> None:
    """Append events to several folders, each all of them or those of some steps."""
    for directory, steps in sinks:
        write_traces(events if steps is None else events.filter(F.col("step").isin(list(steps))), directory)


def requests_in_window(events: DataFrame, key: str, at: str, seconds: int = 60) -> DataFrame:
    """For each event the number of its key's events in the last `seconds`, itself included.

    A key's events are split into periods of the window's length, and each period also gets the period before it, so
    that the window of a hot key is spread over tasks by time.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    period = F.floor(micros / (seconds * 1_000_000))
    own = F.array(F.struct(period.alias("p"), F.lit(True).alias("own")), F.struct((period + 1).alias("p"), F.lit(False).alias("own")))
    rows = events.withColumn("_e", F.explode(own)).withColumn("_at", micros)
    trailing = Window.partitionBy(key, "_e.p").orderBy("_at").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return rows.withColumn("n_recent", F.count(F.lit(1)).over(trailing)).filter("_e.own").drop("_e", "_at")


def read_traces(spark: SparkSession, directory: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(TRACE).json(directory)


def write_traces(events: DataFrame, directory: str, checkpoint: str | None = None) -> StreamingQuery | None:
    """Append to one folder per UTC day, as a stream or at once."""
    days = events.withColumn("day", F.date_format("timestamp", "yyyyMMdd"))
    if events.isStreaming:
        return days.writeStream.format("json").partitionBy("day").option("path", directory).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    days.write.mode("append").partitionBy("day").json(directory)
    return None


def with_context(events: DataFrame, context: dict[str, str]) -> DataFrame:
    """Context columns beside the data; where the data have a column of that name, they keep it."""
    return events.withColumns({k: F.lit(v) for k, v in context.items() if k not in events.columns})


def rate_per_window(events: DataFrame, key: str, at: str, length: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """Events per key and sliding window; on a stream, late ones count up to two minutes behind."""
    if events.isStreaming:
        events = events.withWatermark(at, "2 minutes")
    return events.groupBy(F.window(at, length, slide), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")

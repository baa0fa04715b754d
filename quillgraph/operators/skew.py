"""Per-key work without a task that gets a hot key whole: fragment-replicate by estimated load.

Loads are counted per key (pre-aggregated before the shuffle). Only keys above a share of a task's load are
looked at on the driver; there are at most HEAVY_SHARE * tasks of them, whatever the data. A heavy key is
split into shards in proportion to its load, the shards are packed to tasks (largest first, to the task with
the least load), and the matching side of a key is replicated to the tasks of its shards only. All other keys
are hashed to one task each. Rows are then sent by task number (repartitionById), which Spark knows as a
partitioning: the joins and aggregations that follow need no further exchange.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.session import cut, local_rows, partitions, seen

#: A key is heavy when it holds more than a task's share of all rows, divided by this.
HEAVY_SHARE = 4

BIN = "_bin"


@dataclass(frozen=True)
class Placement:
    """Where the rows of each key go: a task for each shard of a heavy key; the hash of the key for all others."""

    tasks: int
    keys: tuple[str, ...]
    heavy: tuple[tuple[tuple, tuple[int, ...]], ...]

    def _shards(self, df: DataFrame) -> DataFrame:
        """At most HEAVY_SHARE * tasks rows: the keys and the tasks of their shards."""
        types = [f"`_k{i}` {df.schema[k].dataType.simpleString()}" for i, k in enumerate(self.keys)]
        rows = [(*k, list(bins)) for k, bins in self.heavy]
        return local_rows(df.sparkSession, rows, ", ".join([*types, "`_shards` array<int>"]))

    def _with_shards(self, df: DataFrame) -> DataFrame:
        if not self.heavy:
            return df.withColumn("_shards", F.lit(None).cast("array<int>"))
        on = [df[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)]
        return df.join(F.broadcast(self._shards(df)), on, "left").drop(*[f"_k{i}" for i in range(len(self.keys))])

    def _light(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.tasks)).cast("int")

    def shard(self, df: DataFrame, by: Sequence[str]) -> DataFrame:
        """Each row with its task in BIN; of a heavy key, the shard that the columns `by` are hashed to."""
        shard = F.pmod(F.xxhash64(*[F.col(c) for c in by], F.lit(7)), F.size("_shards")).cast("int")
        at = F.when(F.col("_shards").isNull(), self._light()).otherwise(F.element_at("_shards", shard + 1))
        return self._with_shards(df).withColumn(BIN, at).drop("_shards")

    def copies(self, df: DataFrame) -> DataFrame:
        """Each row of the matching side with BIN, once for every task that holds a shard of its key."""
        at = F.when(F.col("_shards").isNull(), F.array(self._light())).otherwise(F.array_distinct("_shards"))
        return self._with_shards(df).withColumn(BIN, F.explode(at)).drop("_shards")

    def send(self, df: DataFrame) -> DataFrame:
        return df.repartitionById(self.tasks, F.col(BIN))

    def fragment(self, df: DataFrame, by: Sequence[str]) -> DataFrame:
        """Send each row to its task, as `shard` finds it."""
        return self.send(self.shard(df, by))

    def replicate(self, df: DataFrame) -> DataFrame:
        """Send each row of the matching side to its tasks, as `copies` finds them."""
        return self.send(self.copies(df))


def place(loads: DataFrame, keys: Sequence[str], load: str, tasks: int | None = None, total: int | None = None) -> Placement:
    """Pack keys to tasks by their load. `loads` has one row per key.

    Light keys count as spread evenly. Ties are broken by key, so the same loads give the same placement.
    """
    tasks = tasks or partitions(loads.sparkSession)
    if total is None:
        total = loads.agg(F.sum(load)).first()[0] or 0
    least = max(1, total // (tasks * HEAVY_SHARE))
    found = [(r[load], tuple(r[k] for k in keys)) for r in loads.filter(F.col(load) > least).select(*keys, load).collect()]
    found.sort(key=lambda x: (-x[0], repr(x[1])))
    rest = max(0, total - sum(n for n, _ in found)) / tasks
    free = [(rest, i) for i in range(tasks)]
    heapq.heapify(free)
    shards = []
    for n, k in found:
        parts = min(tasks, -(-n // least))
        shards += [(n / parts, k)] * parts
    at: dict[tuple, list[int]] = {}
    for n, k in sorted(shards, key=lambda x: (-x[0], repr(x[1]))):
        used, i = heapq.heappop(free)
        at.setdefault(k, []).append(i)
        heapq.heappush(free, (used + n, i))
    return Placement(tasks, tuple(keys), tuple((k, tuple(sorted(v))) for k, v in at.items()))


def heavy_values(loads: DataFrame, key: str, load: str, tasks: int | None = None) -> dict[object, int]:
    """Shards of each key with more than a task's share of the load over HEAVY_SHARE, in proportion to its load.

    There are at most 2 * HEAVY_SHARE * tasks such keys. `loads` has one row per key; where it is a table that was cut
    with `total` and `most` watched, these aren't counted again. A null key has no partner and is none of them.
    """
    tasks = tasks or partitions(loads.sparkSession)
    if "total" in getattr(loads, "_seen", {}):
        total, most = seen(loads, "total"), seen(loads, "most")
    else:
        total, most = loads.agg(F.coalesce(F.sum(load), F.lit(0)), F.coalesce(F.max(load), F.lit(0))).first()
    least = max(1, total // (tasks * HEAVY_SHARE))
    if most <= least:
        return {}
    return {r[0]: min(tasks, -(-r[1] // least)) for r in loads.filter((F.col(load) > least) & F.col(key).isNotNull()).select(key, load).collect()}


def watched_loads(load: str) -> dict[str, Column]:
    """What to watch when a table of loads is cut, for `heavy_values`."""
    return {"total": F.sum(load), "most": F.max(load)}


def lookup(left: DataFrame, key: str, right: DataFrame, heavy: dict[object, int], spread: Column, how: str = "left") -> DataFrame:
    """`left` with the columns of `right`, which has one row per `key`; `heavy`: shards of the keys with many rows in `left`.

    Rows of a heavy key are spread over its shards by the hash of `spread`, and its row of `right` is replicated to
    those shards only: one join, in which both sides are evaluated once. Null keys, which have no partner, are spread
    over all tasks. how: left or inner.
    """
    values = [c for c in right.columns if c != key]
    if not heavy:
        return left.join(right, key, how)
    spark = left.sparkSession
    kind = left.schema[key].dataType.simpleString()
    few = F.broadcast(local_rows(spark, sorted(heavy.items(), key=repr), f"`_hk` {kind}, `_shards` int"))  # 2 * HEAVY_SHARE * tasks rows at most
    shards = F.coalesce("_shards", F.when(F.col(key).isNull(), partitions(spark)), F.lit(1))
    asked = left.join(few, left[key] == F.col("_hk"), "left").withColumn("_salt", F.pmod(F.xxhash64(spread), shards).cast("int")).drop("_hk", "_shards")
    known = right.join(few, right[key] == F.col("_hk"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_shards", F.lit(1)) - 1))).drop("_hk", "_shards")
    return asked.join(known, [key, "_salt"], how).select(*left.columns, *values)


KEYS = ["table_name", "field_name", "key_value"]


def therapy_pairs(edges: DataFrame) -> DataFrame:
    """Rows and latest loading of each key and therapy, written once: all that is told about keys follows from it.

    edges: table_name, field_name, key_value, therapy, loaded_at. Rows are aggregated map side first, so that repeated
    rows of a hot pair don't travel. Null keys are kept here, as they count among all rows of a table.
    """
    return cut(edges.groupBy(*KEYS, "therapy").agg(F.count(F.lit(1)).alias("n"), F.max("loaded_at").alias("latest")))


def table_totals(pairs: DataFrame) -> DataFrame:
    """(table_name, n_all): rows of each table, those without a key included."""
    return pairs.groupBy("table_name").agg(F.sum("n").alias("n_all"))


def _fragments(pairs: DataFrame, matching: DataFrame | None) -> DataFrame:
    """Partial results of each key per task: pairs in fragments by therapy, the matching side replicated to them."""
    pairs = pairs.filter(F.col("key_value").isNotNull())
    at = place(pairs.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("load")), KEYS, "load")
    # A therapy's pair is in one shard, so that distinct therapies of the shards add up.
    parts = at.fragment(pairs, ["therapy"])
    parts = parts.join(at.replicate(matching.select(*KEYS, "n_records")), [BIN, *KEYS], "left") if matching is not None else parts.withColumn("n_records", F.lit(None).cast("bigint"))
    return parts.groupBy(BIN, *KEYS).agg(
        F.sum("n").alias("n_rows"), F.count("therapy").alias("n_therapies"), F.count(F.lit(1)).alias("load"), F.max("latest").alias("latest_loaded_at"), F.max("n_records").alias("n_records"), F.lit(1).alias("n_tasks")
    )


def key_statistics(pairs: DataFrame, matching: DataFrame) -> DataFrame:
    """Row count, distinct therapies and latest loading of every key, hot or not, beside what is known of the key.

    pairs: of `therapy_pairs`. Rows with a null key are left out; a null therapy counts as a row and as no therapy; a
    key without any loaded_at has a null latest one. matching: the three key columns and n_records, one row per key;
    keys without a matching row get 0. A key's load is its number of pairs, which is what is sent. An empty input
    gives no rows.
    """
    return _fragments(pairs, matching).groupBy(*KEYS).agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_therapies").alias("n_therapies"),
        F.max("latest_loaded_at").alias("latest_loaded_at"),
        F.coalesce(F.max("n_records"), F.lit(0)).cast("bigint").alias("n_records"),
        F.sum("n_tasks").alias("n_tasks"),
    )


def task_shares(pairs: DataFrame) -> DataFrame:
    """(n_tasks, load, largest, largest_key): tasks used, pairs in all and in the fullest task, and the key with most pairs."""
    parts = _fragments(pairs, None)
    tasks = parts.groupBy(BIN).agg(F.sum("load").alias("load"))
    keys = parts.groupBy(*KEYS).agg(F.sum("load").alias("of_key")).agg(F.max("of_key").alias("largest_key"))
    return tasks.agg(F.count(F.lit(1)).alias("n_tasks"), F.sum("load").alias("load"), F.max("load").alias("largest")).join(F.broadcast(keys), F.lit(True))


def hot_keys(statistics: DataFrame, totals: DataFrame, share: float = 0.02) -> DataFrame:
    """Keys that hold at least `share` of all rows of their table. totals: table_name, n_all."""
    got = statistics.join(F.broadcast(totals), "table_name")
    return got.filter(F.col("n_rows") >= F.col("n_all") * F.lit(share)).select("table_name", "field_name", "key_value")

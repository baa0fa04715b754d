"""References to records that do not exist when the referring row is loaded.

References and parent keys are sent to tasks and sorted together by (key, time) and then read in one pass: a
running count of open validity intervals tells whether a parent is live. Range partitioning by (key, time)
splits a hot key between tasks at any point; what a key has open at the start of a task is known from one small
record per task. So no task gets a key whole, and nothing is replicated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.session import cut, local_rows, partitions

MISSING, DELETED, LATE, UNDATED = "missing", "deleted", "late", "undated"

_FAR = np.iinfo(np.int64).max
#: Order of events of one key at the same time. The head comes before all of them and carries a parent's start.
_HEAD, _END, _START, _REFERENCE = 0, 1, 2, 3

_MERGED = pa.schema(
    [("pid", pa.int32()), ("what", pa.int8()), ("source", pa.int32()), ("row_id", pa.int64()), ("at", pa.int64()), ("open", pa.int64()), ("since", pa.int64()), ("first_key", pa.string()), ("last_key", pa.string())]
)
_MERGED_SQL = "pid int, what byte, source int, row_id bigint, at bigint, open bigint, since bigint, first_key string, last_key string"
_ORPHAN, _PENDING, _TAIL = 0, 1, 2


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over a task's sorted events; what is open at its start is not known yet.

    Gives the orphans of all keys but the task's first; of that one, the references that are orphans unless
    something was open before; and a record of the state at the end.
    """
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    first = last = None
    opened, since = 0, _FAR
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = batch.column("key")
        kind = batch.column("kind").to_numpy(zero_copy_only=False)
        at = batch.column("at").to_numpy(zero_copy_only=False)
        change = np.empty(n, dtype=bool)
        change[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
        if first is None:
            first = keys[0].as_py()
        change[0] = keys[0].as_py() != last
        starts = np.flatnonzero(change)
        cut_at = starts if change[0] else np.r_[0, starts]
        segment = np.searchsorted(cut_at, np.arange(n), side="right") - 1
        running = np.cumsum((kind == _START).astype(np.int64) - (kind == _END))
        base = np.where(cut_at > 0, running[np.maximum(cut_at - 1, 0)], 0)
        if not change[0]:
            base[0] -= opened
        count = running - base[segment]
        heads = np.minimum.reduceat(np.where(kind == _HEAD, at, _FAR), cut_at)
        if not change[0]:
            heads[0] = min(heads[0], since)
        of_first = np.zeros(n, dtype=bool)
        if last is None or (last == first and not change[0]):
            later = starts[starts > 0]
            of_first[: later[0] if len(later) else n] = True
        out = np.flatnonzero((kind == _REFERENCE) & (count <= 0))
        if len(out):
            nulls = pa.nulls(len(out), pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(out), pid, np.int32)),
                    pa.array(np.where(of_first[out], _PENDING, _ORPHAN).astype(np.int8)),
                    batch.column("source").take(pa.array(out)),
                    batch.column("row_id").take(pa.array(out)),
                    pa.array(at[out]),
                    pa.array(count[out]),
                    pa.array(heads[segment[out]]),
                    nulls,
                    nulls,
                ],
                schema=_MERGED,
            )
        last, opened, since = keys[n - 1].as_py(), int(count[-1]), int(heads[-1])
    if first is not None:
        yield pa.RecordBatch.from_pylist([{"pid": pid, "what": _TAIL, "open": opened, "since": since, "first_key": first, "last_key": last}], schema=_MERGED)


def _carried(tails: list) -> list[tuple[int, int, int]]:
    """(task, open, since) of each task's first key at its start, from the tasks' states at their ends, in order."""
    out, before = [], None
    for t in sorted(tails, key=lambda r: r["pid"]):
        opened, since = 0, _FAR
        if before is not None and before[0] == t["first_key"]:
            opened, since = before[1], before[2]
        out.append((t["pid"], opened, since))
        # The first key's heads may all lie in earlier tasks; counts go on only if the task has this one key.
        goes_on = t["first_key"] == t["last_key"]
        before = (t["last_key"], t["open"] + (opened if goes_on else 0), min(t["since"], since) if goes_on else t["since"])
    return out


def find_orphans(references: DataFrame, parents: DataFrame) -> DataFrame:
    """References whose key has no live parent: source, row_id, loaded_at and why.

    references: source INT, row_id, parent, key, loaded_at. parents: parent, key, loaded_at, deleted_at. A parent
    record is live from loaded_at on, until before deleted_at. status: missing (the key is never loaded), late
    (first loaded after the reference), deleted (loaded before, not live now), undated (the reference has no
    loaded_at, so that nothing can be live). Null keys refer to nothing and are left out on both sides, as are
    parents without loaded_at; a parent that ends when or before it starts is never live. Repeated references come out
    as often as they come in. Empty tables give no rows, or all references as missing.
    """
    spark = references.sparkSession
    references = references.filter(F.col("key").isNotNull())
    parents = parents.filter(F.col("key").isNotNull() & F.col("loaded_at").isNotNull())
    name = F.concat_ws("\x01", F.col("parent").cast("string"), F.col("key")).alias("key")
    micros = lambda c: F.unix_micros(F.col(c))
    start, end = micros("loaded_at"), micros("deleted_at")
    event = lambda kind, sort, at: F.struct(F.lit(kind).cast("byte").alias("kind"), sort.alias("sort"), at.alias("at"))
    head = event(_HEAD, F.lit(np.iinfo(np.int64).min).cast("bigint"), start)
    lives = end.isNull() | (end > start)
    events = F.array(head, F.when(lives, event(_START, start, start)), F.when(lives & end.isNotNull(), event(_END, end, end)))
    opened = parents.select(name, F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("key", "e.kind", "e.sort", "e.at", F.lit(None).cast("int").alias("source"), F.lit(None).cast("bigint").alias("row_id"))
    dated = references.filter(F.col("loaded_at").isNotNull())
    asked = dated.select(name, F.lit(_REFERENCE).cast("byte").alias("kind"), start.alias("sort"), start.alias("at"), "source", F.col("row_id").cast("bigint").alias("row_id"))
    both = opened.unionByName(asked)
    ordered = both.repartitionByRange(partitions(spark), "key", "sort", "kind", "row_id").sortWithinPartitions("key", "sort", "kind")
    merged = cut(ordered.mapInArrow(_merge, _MERGED_SQL))
    tails = merged.filter(F.col("what") == _TAIL).select("pid", "open", "since", "first_key", "last_key").collect()  # one row per task
    carried = F.broadcast(local_rows(spark, _carried(tails), "pid int, _open bigint, _since bigint"))
    sure = merged.filter(F.col("what") == _ORPHAN).select("source", "row_id", "at", "since")
    rest = merged.filter(F.col("what") == _PENDING).join(carried, "pid").filter(F.col("open") + F.col("_open") <= 0)
    found = sure.unionByName(rest.select("source", "row_id", "at", F.least("since", "_since").alias("since")))
    why = F.when(F.col("since") == F.lit(_FAR), MISSING).when(F.col("since") > F.col("at"), LATE).otherwise(DELETED)
    found = found.select("source", "row_id", F.timestamp_micros("at").alias("loaded_at"), why.alias("status"))
    undated = references.filter(F.col("loaded_at").isNull()).select("source", F.col("row_id").cast("bigint").alias("row_id"), "loaded_at", F.lit(UNDATED).alias("status"))
    return found.unionByName(undated)

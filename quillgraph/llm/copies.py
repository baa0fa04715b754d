"""Records that differ in formatting only: recursive radix partitioning on canonical bytes.

A record's canonical text is its words in order, without case and marks. Buckets are prefixes of its bytes. A bucket
with more bytes than CAPACITY is split: its rows share a prefix, which is known from its least and greatest text, and
are split by the bytes that follow it, twice as many at each level. So a long common prefix takes one level, and
levels are bounded by the logarithm of the longest text. Only oversized buckets are looked at again. A bucket of one
text has no bytes left to split by; its copies were counted with the bucket and stay where they lie. All other
buckets are sent to tasks by number, where they are counted in tries with terminal counters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import codepoints
from quillgraph.operators.skew import heavy_values, lookup, watched_loads
from quillgraph.session import cut, partitions, seen

#: What separates words, besides white space.
SEPARATORS = ":/_+,;|()[]"
#: Bytes by which buckets are told apart at the first level.
STEP = 2
#: Bytes of texts that a bucket may hold, whatever the size of the tables and the number of tasks.
CAPACITY = 16 << 20
#: Bytes that a node of a trie takes at once, and bytes that a row counts for besides its text.
DIGIT, ROW = 8, 16


def canonical(c: Column) -> Column:
    """The words of a text, sorted, each as often as it stands there; null where there are none."""
    marks = "".join(f"\\x{{{ord(x):x}}}" for x in SEPARATORS)
    words = F.split(F.lower(c), rf"(?U)[\s{marks}]+")
    words = F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", "")), lambda w: w != "")
    text = F.array_join(F.array_sort(words), " ")
    return F.when(text != "", text)


def terminals(scope: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of the trie node at which each text ends; copies end at the same one.

    All texts go down the trie together, level by level: a node's children are its different next DIGIT bytes. A
    text that is alone in its node needs no further levels.
    """
    n = len(scope)
    padded = np.r_[data, np.zeros(DIGIT, np.uint8)]
    left = np.diff(offsets)
    end, nodes = np.full(n, -1, np.int64), 0
    active, node, at = np.arange(n), scope.astype(np.int64), offsets[:-1].astype(np.int64)
    while len(active):
        some = np.minimum(left[active], DIGIT)
        digit = padded[np.minimum(at[active][:, None] + np.arange(DIGIT), len(padded) - 1)]
        digit = np.where(np.arange(DIGIT) < some[:, None], digit, 0).astype(np.uint8).view(np.uint64)[:, 0]
        by = np.lexsort((digit, some, node))
        new = np.ones(len(by), bool)
        new[1:] = (node[by][1:] != node[by][:-1]) | (some[by][1:] != some[by][:-1]) | (digit[by][1:] != digit[by][:-1])
        child = np.empty(len(by), np.int64)
        child[by] = np.cumsum(new) - 1
        alone = np.bincount(child) == 1
        left[active] -= some
        stops = (left[active] == 0) | alone[child]
        # An end and a way further from one node are two: whoever stops here takes the even number.
        end[active[stops]] = nodes + 2 * child[stops]
        at[active] += DIGIT
        nodes += 2 * len(alone)
        active, node = active[~stops], child[~stops]
    return end


def count_copies(scope: pa.Array, texts: pa.Array, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest id, count) of each row's copies, from the terminal counters of a trie over all texts."""
    number = scope.dictionary_encode().indices.fill_null(-1).to_numpy()
    data, offsets = codepoints.binary_bytes(texts)
    _, end = np.unique(terminals(number, data, offsets), return_inverse=True)
    least = np.full(end.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, end, rows)
    return least[end], np.bincount(end)[end]


def _counter(capacity: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by bucket: whole buckets are held until their texts come to the capacity."""
        names = ["scope", "kept", "copy", "copies"]

        def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            scope, texts = (t.column(c).combine_chunks() for c in ("scope", "bytes"))
            rows = t.column("row_id").to_numpy()
            least, n = count_copies(scope, texts, rows)
            return pa.RecordBatch.from_arrays([scope, pa.array(least), pa.array(rows), pa.array(n)], names=names)

        held, size, last = [], 0, None
        for batch in batches:
            label = batch.column("bucket").to_numpy()
            if not len(label):
                continue
            starts = np.flatnonzero(np.r_[label[0] != last, label[1:] != label[:-1]])
            for a, b in zip(np.r_[0, starts], np.r_[starts, len(label)]):
                if a in starts and size >= capacity:
                    yield done(held)
                    held, size = [], 0
                if b > a:
                    held.append(batch.slice(a, b - a))
                    size += int(codepoints.binary_bytes(held[-1].column("bytes"))[1][-1])
            last = label[-1]
        if held:
            yield done(held)

    return count


def _bucket(depth: Column) -> Column:
    return F.xxhash64("scope", F.substring(F.col("bytes"), F.lit(1), depth))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket's least and greatest text: bytes that they share, and whether they are the same."""
    for batch in batches:
        shared = []
        for a, b in zip(batch.column("least").to_pylist(), batch.column("greatest").to_pylist()):
            n = min(len(a), len(b))
            differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
            shared.append(int(differ[0]) if len(differ) else n)
        same = pa.array([a == b for a, b in zip(batch.column("least").to_pylist(), batch.column("greatest").to_pylist())], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array(shared, pa.int32()), same], names=["bucket", "shared", "same"])


def collapse(records: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(scope, kept, copy, copies) of every record that has words: kept is the smallest row_id of its copies.

    records: scope (a name; copies are of one scope), row_id, text. Null texts and those without words are left
    out, as are records without a row_id; a row_id that comes twice with the same text counts twice, and a null scope is one of its own. capacity: bytes of texts that one bucket may
    hold. Texts of any length are compared whole. Empty tables give no rows.
    """
    tasks = partitions(records.sparkSession)
    rows = records.select("scope", F.col("row_id").cast("bigint").alias("row_id"), F.encode(canonical(F.col("text")), "utf-8").alias("bytes"))
    left = cut(rows.filter(F.col("bytes").isNotNull() & F.col("row_id").isNotNull()).withColumn("bucket", _bucket(F.lit(STEP))))
    whole, few, step = [], [], STEP
    while True:
        sizes = left.groupBy("bucket").agg(F.sum(F.length("bytes") + ROW).alias("size"), F.count(F.lit(1)).alias("copies"), F.min("row_id").alias("kept"))
        over = cut(sizes.filter(F.col("size") > capacity), **watched_loads("size"), buckets=F.count(F.lit(1)))
        if not seen(over, "buckets"):
            whole.append(left)
            break
        heavy = heavy_values(over, "bucket", "size")
        marked = cut(lookup(left.select("scope", "row_id", "bytes", "bucket"), "bucket", over.select("bucket", "copies", "kept"), heavy, F.col("row_id")))
        whole.append(marked.filter(F.col("kept").isNull()).select("scope", "row_id", "bytes", "bucket"))
        inside = marked.filter(F.col("kept").isNotNull())
        ends = inside.groupBy("bucket").agg(F.min("bytes").alias("least"), F.max("bytes").alias("greatest"))
        ends = cut(ends.mapInArrow(_shared, "bucket bigint, shared int, same boolean"))
        inside = lookup(inside, "bucket", ends, heavy, F.col("row_id"), "inner")
        few.append(inside.filter("same").select("scope", "kept", F.col("row_id").alias("copy"), "copies"))
        step *= 2
        left = inside.filter(~F.col("same")).select("scope", "row_id", "bytes", _bucket(F.col("shared") + step).alias("bucket"))
    many = reduce(DataFrame.unionByName, [w.select("scope", "row_id", "bytes", "bucket") for w in whole])
    many = many.withColumn("_task", F.pmod(F.xxhash64("bucket"), F.lit(tasks)).cast("int")).repartitionById(tasks, F.col("_task")).sortWithinPartitions("bucket").select("bucket", "scope", "bytes", "row_id")
    got = many.mapInArrow(_counter(capacity), "scope string, kept bigint, copy bigint, copies bigint")
    return reduce(DataFrame.unionByName, few, got)

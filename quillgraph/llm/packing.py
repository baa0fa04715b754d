"""Containers of fixed capacity filled with documents: pattern packing by non-negative least squares.

Only the histogram of lengths goes to the driver, which has as many entries as the capacity at most. Patterns of
up to three lengths, two of them repeated, that fill a container exactly are enumerated, repeat counts are fitted to the
histogram by non-negative least squares over a sparse matrix, and rounded to what the histogram has. This is done again
for what is left, until it places little more; the last rest is packed on the histogram by best fit, largest first. The result, patterns with repeat counts, says for each
length and rank which container it goes to; documents find theirs by their rank within their length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import cut, partitions

CAPACITY = 2048


#: How often the second length of a pattern is repeated.
REPEATS = (1, 2, 4, 8)
#: A pass that places less than this share of the tokens it finds is the last one.
LEAST_PLACED = 0.02


#: Patterns per length that a pass takes in, besides those of the passes before.
COLUMNS = 80


def exact_patterns(histogram: np.ndarray, capacity: int, gain: np.ndarray | None = None, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, times each): patterns of one to three lengths that add up to the capacity; shorter ones padded with 0.

    A length is in a pattern as often as the histogram has it at most. All patterns that repeat a length are looked at;
    of those with a gain (the sum of their lengths' gains, by default all alike) COLUMNS are drawn, with chances in
    proportion to it. What is drawn is for the fit to choose from; what patterns leave out is packed exactly.
    """
    lengths = np.flatnonzero(histogram)
    gain = np.ones(capacity + 1) if gain is None else gain.copy()
    gain[0] = 0
    toss = np.random.default_rng(seed)
    out = []
    if histogram[capacity]:
        out.append(np.array([[capacity, 0, 0, 1, 0, 0]]))
    second, times = (x.ravel() for x in np.meshgrid(lengths[lengths < capacity], REPEATS, indexing="ij"))
    enough = (histogram[second] >= times) & (second * times < capacity)
    second, times = second[enough], times[enough]
    room, worth = capacity - second * times, gain[second] * times
    for a in lengths[lengths < capacity].tolist():
        top = np.minimum(room // a, histogram[a])
        found, gains = [], []
        for n in (top, top - 1, top - 2, top - 3, top // 2, top // 3, top // 4):
            c = np.where(n > 0, room - n * a, 0)
            value = n * gain[a] + worth + gain[c]
            at = np.flatnonzero((value > 0) & (n > 0) & (second != a) & ((c == 0) | (histogram[c] > 0) & (c != a) & (c != second)))
            found.append(np.c_[np.full_like(at, a), second[at], c[at], n[at], times[at], c[at] > 0])
            gains.append(value[at])
        got, value = np.concatenate(found), np.concatenate(gains)
        if len(got) > COLUMNS:
            drawn = np.log(toss.random(len(got))) / value
            got = got[np.argpartition(-drawn, COLUMNS)[:COLUMNS]]
        out.append(got)
    got = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 6), np.int64)
    return got[:, :3], got[:, 3:]


def fit(patterns: np.ndarray, times: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared distance of the patterns' lengths to the histogram.

    Accelerated projected gradient; the matrix is only ever applied through gathers and scatters. Long lengths
    weigh more: they're harder to place afterwards.
    """
    if not len(patterns):
        return np.zeros(0)
    size = len(histogram)
    weight = np.arange(size) / size
    target = histogram * weight
    flat = patterns.ravel()
    target[0] = weight[0] = 0

    def lengths_of(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, (x[:, None] * times).ravel(), size) * weight

    def back(r: np.ndarray) -> np.ndarray:
        return ((r * weight)[patterns] * times).sum(1)

    probe = np.ones(len(patterns))
    for _ in range(12):  # power iteration for the step
        probe = back(lengths_of(probe))
        norm = np.linalg.norm(probe)
        if not norm:
            return np.zeros(len(patterns))
        probe /= norm
    step = 1 / (1.05 * norm)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(lengths_of(y) - target))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def _settle(patterns: np.ndarray, times: np.ndarray, x: np.ndarray, left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Round counts, once at least, to what is left of each length; `left` is reduced.

    Patterns with the longest lengths come first, as short pieces still find room later, and of those the best used.
    """
    out = []
    used = np.flatnonzero(x > 0)
    for i in used[np.lexsort((-x[used], -patterns[used].max(1)))]:
        there = times[i] > 0
        parts, often = patterns[i][there], times[i][there]
        n = min(max(1, int(round(float(x[i])))), int((left[parts] // often).min()))
        if n:
            left[parts] -= n * often
            out.append((tuple(np.repeat(parts, often).tolist()), n))
    return out


def fitted(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The containers that patterns fill; `left` is reduced.

    Patterns are fitted twice: those that are drawn at first, and, with them, those that the misfit says are worth most.
    """
    size = np.arange(len(left))
    chosen: list[tuple[tuple[int, ...], int]] = []
    while tokens := int((left * size).sum()):
        patterns, times = exact_patterns(left, capacity, seed=len(chosen))
        x = fit(patterns, times, left.astype(float), rounds=60)  # for the misfit only
        misfit = left - np.bincount(patterns.ravel(), (x[:, None] * times).ravel(), len(left))
        more, often = exact_patterns(left, capacity, misfit * (size / len(left)) ** 2, seed=len(chosen) + 1)
        both = np.unique(np.r_[np.c_[patterns, times], np.c_[more, often]], axis=0)
        patterns, times = both[:, :3], both[:, 3:]
        chosen += _settle(patterns, times, fit(patterns, times, left.astype(float)), left)
        if tokens - int((left * size).sum()) <= LEAST_PLACED * tokens:
            break
    return chosen


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Pack the rest, largest first, each length into the containers with the least room that takes it."""
    room: dict[int, list[list]] = {}  # free space -> [lengths inside, number of such containers]
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fits = [r for r in room if r >= length]
            if fits:
                space = min(fits)
                group = room[space][-1]
                inside, there = group
                each = min(space // length, n)
                used = min(there, n // each)
                group[1] -= used
                if not group[1]:
                    room[space].pop()
                    if not room[space]:
                        del room[space]
            else:
                space, inside = capacity, ()
                each = min(capacity // length, n)
                used = n // each
            room.setdefault(space - each * length, []).append([(*inside, *([length] * each)), used])
            n -= each * used
    return [(tuple(inside), n) for groups in room.values() for inside, n in groups]


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a container, number of such containers); together they use up the histogram, by length 0..capacity."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    chosen = fitted(left, capacity)
    return chosen + _best_fit(left, capacity)


def _slots(chosen: list[tuple[tuple[int, ...], int]], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted keys, containers, times): ranks of a length from a key on go to consecutive containers, so many to each. key: length and first rank."""
    used = np.zeros(capacity + 1, np.int64)
    keys, firsts, often, container = [], [], [], 0
    for inside, n in chosen:
        for length, times in Counter(inside).items():
            keys.append((length << 44) | int(used[length]))
            firsts.append(container)
            often.append(times)
            used[length] += n * times
        container += n
    by = np.argsort(np.array(keys, np.int64), kind="stable")
    return np.array(keys, np.int64)[by], np.array(firsts, np.int64)[by], np.array(often, np.int32)[by]


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """(container, key, piece, tokens): the pieces of all documents with a size, in containers of the capacity.

    Documents longer than a container are cut into full pieces and a last one; no other document is cut. Null, zero
    and negative sizes are nowhere. Repeated documents are packed as often as they come. The ranks within a length
    are counted per hash shard of the documents first, so a length that a third of all documents have is
    spread over all tasks. Empty tables give no rows.
    """
    spark = sizes.sparkSession
    rows = sizes.select(F.col(key).alias("key"), F.col(size).cast("bigint").alias("n")).filter(F.col("n") > 0)
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(capacity).cast("bigint"))
    pieces = rows.select("key", "n", F.posexplode(starts).alias("at", "start"))
    pieces = pieces.select("key", (F.col("at") + 1).cast("bigint").alias("piece"), F.least(F.col("n") - F.col("start"), F.lit(capacity)).alias("tokens"))
    shards = partitions(spark)
    pieces = cut(pieces.withColumn("shard", F.pmod(F.xxhash64("key", "piece"), F.lit(shards)).cast("int")))
    counts = cut(pieces.groupBy("tokens", "shard").agg(F.count(F.lit(1)).alias("n")))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("tokens").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        histogram[r["tokens"]] = r["n"]
    keys, firsts, often = _slots(plan(histogram, capacity), capacity)
    before = Window.partitionBy("tokens").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("tokens", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # capacity * shards rows at most
    inside = Window.partitionBy("shard", "tokens").orderBy("key", "piece")
    ranked = pieces.withColumn("own", F.row_number().over(inside) - 1).join(offsets, ["tokens", "shard"])
    ranked = ranked.select("key", "piece", "tokens", (F.col("before") + F.col("own")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("tokens").to_numpy()
            asked = (length << 44) | batch.column("rank").to_numpy()
            slot = np.searchsorted(keys, asked, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(firsts[slot] + (asked - keys[slot]) // often[slot]), batch.column("key"), batch.column("piece"), batch.column("tokens")], names=["container", "key", "piece", "tokens"])

    kind = sizes.schema[key].dataType.simpleString()
    return ranked.mapInArrow(place, f"container bigint, key {kind}, piece bigint, tokens bigint").withColumnRenamed("key", key)

"""Splits that keep related records together: components by random-mate contraction, then cumulative weight.

Each record is linked to the smallest record of every key that it has, so a key with n records gives n - 1
links. In a round each vertex tosses a coin, which is a hash of vertex and round; a vertex with tails that
has a neighbour with heads is contracted into the smallest such neighbour. The coin of a vertex that most of its
links point to falls on heads nine times in ten, that of one whose links point away once in ten, so that stars, which
keys make, vanish in a few rounds. Links are renamed, loops and repetitions vanish, and rounds go on until no
link is left. Every vertex is contracted at most once, into one that survives or is contracted in a later round; the
labels are unwound by following these steps two at a time, then four, and so on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.skew import heavy_values, lookup, watched_loads
from quillgraph.session import cut, local_rows, release, seen

#: More rounds than any input needs: links shrink by a quarter in a round on average.
ROUNDS = 400
#: So few links are left to one task, which runs the remaining rounds on arrays; at least one round is a join.
LAST_LINKS = 10_000
#: Shares of heads of a vertex that links point away from, as often to as away, and to.
SHARES = (0.1, 0.5, 0.9)


def paraphrase_key(c: Column) -> Column:
    """The paraphrase without regard to case, amount of white space and . ? ! and spaces at its end; null if blank."""
    text = F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)\s+", " "), r"^ +|[.?! ]+$", "")
    return F.when(~c.rlike(r"(?U)^\s*$"), text)


def links_of(memberships: DataFrame) -> DataFrame:
    """(a, b) with a > b from (record, key): each record with the smallest record of its key. Null keys link nothing."""
    pairs = memberships.filter(F.col("key").isNotNull() & F.col("record").isNotNull()).select("record", "key")
    groups = pairs.groupBy("key").agg(F.min("record").alias("b"), F.count(F.lit(1)).alias("n"))
    several = cut(groups.filter(F.col("n") > 1), **watched_loads("n"))
    got = lookup(pairs, "key", several.select("key", "b"), heavy_values(several, "key", "n"), F.col("record"), "inner")
    return got.filter(F.col("record") != F.col("b")).select(F.col("record").alias("a"), "b").distinct()


def _coins(edges: DataFrame, turn: int) -> DataFrame:
    """(vertex, n, heads): links of each vertex, and its hash against its bias. Links point from a to the smaller b."""
    ends = F.array(F.struct(F.col("a").alias("v"), F.lit(-1).alias("w")), F.struct(F.col("b").alias("v"), F.lit(1).alias("w")))
    bias = edges.select(F.explode(ends).alias("e")).groupBy(F.col("e.v").alias("vertex")).agg(F.sum("e.w").alias("w"), F.count(F.lit(1)).alias("n"))
    share = F.when(F.col("w") > 0, SHARES[2]).when(F.col("w") < 0, SHARES[0]).otherwise(SHARES[1])
    toss = F.pmod(F.xxhash64("vertex", F.lit(turn)), F.lit(1 << 20)) / F.lit(1 << 20)
    return bias.select("vertex", "n", (toss < share).alias("heads"))


def _last_rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rounds on at most LAST_LINKS links (a, b): each vertex that is contracted with its survivor."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    parts = pa.Table.from_batches(held)
    n = parts.num_rows
    names, ends = np.unique(np.concatenate([parts.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")]), return_inverse=True)
    a, b = ends[:n], ends[n:]
    into, toss = np.arange(len(names)), np.random.default_rng(len(names))
    while len(a):
        weight = np.bincount(b, minlength=len(names)) - np.bincount(a, minlength=len(names))
        heads = toss.random(len(names)) < np.take(SHARES, np.sign(weight) + 1)
        differ = heads[a] != heads[b]
        tail, head = np.where(heads[a], b, a)[differ], np.where(heads[a], a, b)[differ]
        least = np.full(len(names), len(names))
        np.minimum.at(least, tail, head)
        moved = np.where(least < len(names), least, np.arange(len(names)))
        into = np.where(into == np.arange(len(names)), moved, into)
        a, b = moved[a], moved[b]
        a, b = np.maximum(a, b)[a != b], np.minimum(a, b)[a != b]
    while (into[into] != into).any():
        into = into[into]
    gone = np.flatnonzero(into != np.arange(len(names)))
    kind = parts.schema.field("a").type
    yield pa.RecordBatch.from_arrays([pa.array(names[gone], kind), pa.array(names[into[gone]], kind)], names=["vertex", "into"])


def _rename(edges: DataFrame, end: str, moved: DataFrame, other: str, heavy: dict) -> DataFrame:
    """`edges` with the vertices in `end` replaced by what they were contracted into."""
    to = moved.select(F.col("vertex").alias(end), F.col("into").alias("_into"))
    got = lookup(edges, end, to, heavy, F.col(other))
    return got.select(F.coalesce("_into", end).alias(end), other)


def components(links: DataFrame) -> DataFrame:
    """(vertex, label) of every vertex in `links` (a, b): the same label within a component.

    Loops and repeated links count for nothing; no links give no rows. Each round writes three tables to the checkpoint
    folder, so that a lost executor costs a round and not the whole; what the next round needs to know of them (links
    left, loads of vertices) is counted while they are written.
    """
    sorted_links = lambda df: df.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut(sorted_links(links), links=F.count(F.lit(1)))
    moves: list[DataFrame] = []
    for turn in range(ROUNDS):
        if not seen(edges, "links"):
            break
        if turn and seen(edges, "links") <= LAST_LINKS:
            kind = edges.schema["a"].dataType.simpleString()
            moves.append(cut(edges.coalesce(1).mapInArrow(_last_rounds, f"vertex {kind}, into {kind}")))
            break
        coins = cut(_coins(edges, turn), **watched_loads("n"))
        heavy = heavy_values(coins, "vertex", "n")
        shown = coins.select("vertex", "heads")
        tossed = lookup(edges, "a", shown.select(F.col("vertex").alias("a"), F.col("heads").alias("ha")), heavy, F.col("b"))
        tossed = lookup(tossed, "b", shown.select(F.col("vertex").alias("b"), F.col("heads").alias("hb")), heavy, F.col("a"))
        differ = tossed.filter(F.col("ha") != F.col("hb"))
        mates = differ.select(F.when(F.col("ha"), F.col("b")).otherwise(F.col("a")).alias("vertex"), F.when(F.col("ha"), F.col("a")).otherwise(F.col("b")).alias("into"))
        moved = cut(mates.groupBy("vertex").agg(F.min("into").alias("into")))
        moves.append(moved)
        # A vertex has as many links in the column that is renamed second as before the first.
        renamed = _rename(_rename(edges, "a", moved, "b", heavy), "b", moved, "a", heavy)
        before, edges = edges, cut(sorted_links(renamed), links=F.count(F.lit(1)))
        release(before, coins)
    else:
        raise RuntimeError("links are left after the last round")
    release(edges)
    if not moves:
        return links.select(F.col("a").alias("vertex"), F.col("b").alias("label")).limit(0)
    labels = _unwound(moves)
    survivors = labels.select("label").distinct().select(F.col("label").alias("vertex"), "label")
    return labels.unionByName(survivors)


def _unwound(moves: list[DataFrame]) -> DataFrame:
    """(vertex, label) of all vertices that were contracted: the survivor that their steps lead to."""
    steps = cut(reduce(DataFrame.unionByName, moves))
    release(*moves)
    for _ in range((len(moves) - 1).bit_length()):  # a vertex is at most as many steps from its survivor as there are tables
        heavy = heavy_values(steps.groupBy("into").count(), "into", "count")
        further = steps.select(F.col("vertex").alias("into"), F.col("into").alias("_next"))
        got = lookup(steps, "into", further, heavy, F.col("vertex"))
        before, steps = steps, cut(got.select("vertex", F.coalesce("_next", "into").alias("into")))
        release(before)
    return steps.select("vertex", F.col("into").alias("label"))


def smallest_of(parts: DataFrame) -> DataFrame:
    """(vertex, kept): the smallest vertex of each one's component."""
    groups = cut(parts.groupBy("label").agg(F.min("vertex").alias("kept"), F.count(F.lit(1)).alias("n")), **watched_loads("n"))
    return lookup(parts, "label", groups.select("label", "kept"), heavy_values(groups, "label", "n"), F.col("vertex")).select("vertex", "kept")


def item_keys(items: DataFrame) -> DataFrame:
    """(record, key) of paraphrase items: their template, and each of their paraphrases, as often as they stand there. Null lists have none."""
    template = F.when(F.col("template_id").isNotNull(), F.concat(F.lit("t\x01"), "template_id"))
    own = items.select(F.col("item_id").alias("record"), template.alias("key"))
    said = items.select(F.col("item_id").alias("record"), F.explode("paraphrases").alias("p")).select("record", F.concat(F.lit("p\x01"), paraphrase_key(F.col("p"))).alias("key"))
    return own.unionByName(said).filter(F.col("key").isNotNull())


def related(items: DataFrame) -> DataFrame:
    """(item_id, kept) of items that belong with others: the smallest item_id of those that belong together."""
    return smallest_of(components(links_of(item_keys(items)))).select(F.col("vertex").alias("item_id"), "kept")


def assign(items: DataFrame, shares: tuple[tuple[str, float], ...] = (("train", 0.8), ("validation", 0.1), ("test", 0.1)), seed: int = 42) -> DataFrame:
    """(item_id, split): every item once, groups whole, the splits as near to their shares by items as groups allow.

    Groups too large to be placed by chance, over a hundredth of the smallest share, are at most a few hundred and are
    placed largest first where most is missing. All others are cut by cumulative weight of their hash: a group's
    weight is summed below it per hash range, so no task sees all of them. Items in no group stand alone.
    Repeated item ids count once; empty tables give no rows.
    """
    ids = items.select("item_id").filter(F.col("item_id").isNotNull()).distinct()
    grouped = ids.join(related(items), "item_id", "left").select("item_id", F.coalesce("kept", "item_id").alias("kept"))
    grouped = cut(grouped)
    weights = cut(grouped.groupBy("kept").agg(F.count(F.lit(1)).alias("weight")), **watched_loads("weight"))
    total = seen(weights, "total")
    large = max(1.0, total * min(s for _, s in shares) / 100)
    goal = {name: total * share for name, share in shares}
    placed: dict[int, str] = {}
    for r in sorted(weights.filter(F.col("weight") > large).collect(), key=lambda r: (-r["weight"], r["kept"])):
        name = max(goal, key=lambda k: goal[k])
        placed[r["kept"]] = name
        goal[name] -= r["weight"]
    left = sum(max(0.0, v) for v in goal.values()) or 1.0
    rest = weights.filter(F.col("weight") <= large).withColumn("at", F.pmod(F.xxhash64("kept", F.lit(seed)), F.lit(1 << 30)))
    ranges = 1 << 12
    rest = rest.withColumn("range", (F.col("at") * ranges / (1 << 30)).cast("int"))
    sums = rest.groupBy("range").agg(F.sum("weight").alias("w")).collect()  # at most 4096 rows
    by_range, below, before = dict((r["range"], r["w"]) for r in sums), 0, []
    for i in range(ranges):
        before.append((i, below))
        below += by_range.get(i, 0)
    spark = items.sparkSession
    rest = rest.join(F.broadcast(local_rows(spark, before, "range int, below bigint")), "range")
    inside = Window.partitionBy("range").orderBy("at", "kept").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.col("below") + F.sum("weight").over(inside) - F.col("weight") / 2
    edge, name_at, names = 0.0, [], [name for name, _ in shares]
    for name in names:
        edge += max(0.0, goal[name]) * max(below, 0) / left
        name_at.append((edge, name))
    chosen = reduce(lambda c, x: c.when(reach <= F.lit(x[0]), x[1]), name_at[1:-1], F.when(reach <= F.lit(name_at[0][0]), name_at[0][1])).otherwise(names[-1])
    small = rest.select("kept", chosen.alias("split"))
    if placed:
        small = small.unionByName(local_rows(spark, sorted(placed.items()), "kept bigint, split string"))
    loads = heavy_values(weights, "kept", "weight")
    return lookup(grouped, "kept", small, loads, F.col("item_id")).select("item_id", "split")

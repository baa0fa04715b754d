"""Benchmark question sets: mining of parameters, sampling, expansion, splitting; comparison of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stable_order(c: Column, seed: int = 42) -> Column:
    """A pseudo-random order that does not depend on engine or partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), c.cast("string")))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in stable pseudo-random order."""
    return df.orderBy(stable_order(F.col(key), seed), key).limit(n)


def first_of_each(df: DataFrame, group: str, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Of each group the share `fraction` of its rows, one at least, in stable pseudo-random order.

    Ranks are taken within shards of a group first, so that a large group isn't sorted in one task: rows are kept
    by their hash where that decides, and only the shard at the edge is ranked.
    """
    shard = F.conv(F.substring(stable_order(F.col(key), seed), 1, 3), 16, 10).cast("int")
    rows = df.withColumn("_s", shard)
    counts = rows.groupBy(group, "_s").agg(F.count(F.lit(1)).alias("_n"))  # 4096 per group at most
    below = Window.partitionBy(group).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "_s", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(group)).alias("_all"))
    inside = Window.partitionBy(group, "_s").orderBy(stable_order(F.col(key), seed), key)
    ranked = rows.withColumn("_r", F.row_number().over(inside)).join(counts, [group, "_s"])
    take = F.greatest(F.lit(1), F.floor(F.col("_all") * F.lit(fraction)))
    return ranked.filter(F.col("_before") + F.col("_r") <= take).drop("_s", "_r", "_before", "_all")


def stratified_split(df: DataFrame, group: str, key: str, train: float = 0.85, seed: int = 42) -> DataFrame:
    """`df` with split: of each group the share `train` goes to train, the rest to test."""
    chosen = first_of_each(df.select(group, key), group, key, train, seed).select(key, F.lit("train").alias("split"))
    return df.join(chosen, key, "left").withColumn("split", F.coalesce("split", F.lit("test")))


def expand(records: DataFrame, most: int = 2, varied: str = "disease_name") -> DataFrame:
    """One question per record, value or synonym (at most `most`) of the varied placeholder, and wording; ids number all three.

    records: family_id, template_id, n (number within the family), placeholders MAP, synonyms (of the varied
    placeholder's value), questions (the first is the base). 0 leaves synonyms out. `{name}` in a question is replaced
    by the placeholder of that name. placeholders keep the value that answers are asked with.
    """
    own = F.element_at("placeholders", F.lit(varied))
    synonyms = F.slice(F.coalesce("synonyms", F.array().cast("array<string>")), 1, most) if most else F.array().cast("array<string>")
    names = F.concat(F.array(own), F.when(own.isNotNull(), synonyms).otherwise(F.array().cast("array<string>")))
    rows = records.select("family_id", "template_id", "n", "placeholders", "questions", F.posexplode(names).alias("s", "used")).select("*", F.posexplode("questions").alias("p", "q"))
    base = F.concat(F.format_string("%s-%06d", "family_id", F.col("n").cast("int")), F.when(F.col("s") > 0, F.format_string("-S%d", "s")).otherwise(""))
    value = lambda e: F.when(e["key"] == varied, F.col("used")).otherwise(e["value"])
    text = F.aggregate(F.map_entries("placeholders"), F.col("q"), lambda q, e: F.replace(q, F.concat(F.lit("{"), e["key"], F.lit("}")), value(e)))
    said_again = F.col("p") > 0
    return rows.select(
        F.concat(base, F.when(said_again, F.format_string("-P%d", "p")).otherwise("")).alias("id"), "family_id", "template_id", text.alias("question"), "placeholders",
        F.when(said_again, "paraphrase").otherwise("base").alias("source"), F.when(said_again, base).alias("paraphrase_of"),
    )


def chat(records: DataFrame, system: str) -> DataFrame:
    """(id, messages): system, user and assistant turns of question and query."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return records.select("id", F.array(turn("system", F.lit(system)), turn("user", F.col("question")), turn("assistant", F.col("cypher"))).alias("messages"))


def same_rows(gold: DataFrame, other: DataFrame) -> dict[str, object]:
    """Whether two results are the same bag of rows, on the gold columns, lists in any order, null equal to null.

    Columns that only `other` has don't count and are reported; a gold column that it lacks makes the results differ.
    """
    extra = [c for c in other.columns if c not in gold.columns]
    if missing := [c for c in gold.columns if c not in other.columns]:
        return {"same": False, "missing": missing, "extra": extra}

    def plain(df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)
        return df.select(*[F.array_sort(c).alias(c) if kinds[c].startswith("array") else F.to_json(F.array_sort(F.map_entries(c))).alias(c) if kinds[c].startswith("map") else F.col(c) for c in gold.columns])

    a, b = plain(gold), plain(other)
    tagged = a.withColumn("_w", F.lit(1)).unionAll(b.withColumn("_w", F.lit(-1)))  # one pass instead of two differences
    return {"same": tagged.groupBy(*gold.columns).agg(F.sum("_w").alias("_w")).filter("_w <> 0").isEmpty(), "missing": [], "extra": extra}


def subset(df: DataFrame, group: str, key: str, n: int, fraction: float, seed: int = 42) -> DataFrame:
    """n rows: first a share of each group, one at least, then others in stable pseudo-random order until there are n."""
    some = first_of_each(df.select(group, key), group, key, fraction, seed).select(key, F.lit(0).alias("_f"))
    ranked = df.join(some, key, "left").withColumn("_f", F.coalesce("_f", F.lit(1)))
    return ranked.orderBy("_f", stable_order(F.col(key), seed), key).limit(n).drop("_f")


def metrics(results: DataFrame, by: list[str]) -> DataFrame:
    """Per group: records, shares of valid, executed and matching ones in percent, mean latency, tokens per second."""
    share = lambda c: (F.avg(F.col(c).cast("int")) * 100).alias(f"{c}_pct")
    rate = F.when(F.col("latency_ms") > 0, F.col("tokens") / (F.col("latency_ms") / 1000)).otherwise(0.0)
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), share("valid"), share("executed"), share("matched"), F.avg("latency_ms").alias("avg_latency_ms"), F.avg(rate).alias("tokens_per_second"))

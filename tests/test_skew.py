import datetime as dt
import random

from pyspark.sql import functions as F

from quillgraph.operators import skew

NOW = dt.datetime(2024, 1, 1)


def edges(spark, rows):
    return spark.createDataFrame([("t", "f", k, h, NOW + dt.timedelta(days=d), 1) for k, h, d in rows], "table_name string, field_name string, key_value string, therapy string, loaded_at timestamp, n_rows int")


def known(spark, counts):
    return spark.createDataFrame([("t", "f", k, n) for k, n in counts.items()], "table_name string, field_name string, key_value string, n_records bigint")


def test_statistics_with_hot_key(spark):
    rnd = random.Random(1)
    rows = [("hot" if i % 3 else f"k{rnd.randint(0, 40)}", rnd.choice([None, *map(str, range(2000 if i % 3 else 60))]), rnd.randint(0, 99)) for i in range(4000)] + [(None, "x", 1)]
    got = {r["key_value"]: r for r in skew.key_statistics(skew.therapy_pairs(edges(spark, rows)), known(spark, {"hot": 2, "zz": 1})).collect()}
    assert None not in got and set(got) == {k for k, _, _ in rows if k}
    for k, r in got.items():
        own = [x for x in rows if x[0] == k]
        assert (r["n_rows"], r["n_therapies"]) == (len(own), len({h for _, h, _ in own if h}))
        assert r["latest_loaded_at"] == NOW + dt.timedelta(days=max(d for *_, d in own))
    assert got["hot"]["n_tasks"] > 1 and got["hot"]["n_records"] == 2
    assert skew.key_statistics(skew.therapy_pairs(edges(spark, [])), known(spark, {})).count() == 0


def test_no_exchange_after_placement(spark):
    rows = edges(spark, [("a", "x", 1), ("b", "y", 2)])
    at = skew.place(rows.groupBy("key_value").count(), ["key_value"], "count")
    df = at.fragment(rows, ["therapy"]).groupBy(skew.BIN, "key_value").count()
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange shuffle") == 1


def test_lookup_keeps_every_row(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("1", 2), ("nobody", 3)], "k string, v int")
    got = skew.lookup(left, "k", right, {"hot": 3}, F.col("id"))
    assert got.count() == 3000 and got.filter("v = 1").count() == 1000 and got.filter("v = 2").count() == 1
    assert skew.lookup(left, "k", right, {"hot": 3}, F.col("id"), "inner").count() == 1001
    assert got.groupBy("id").count().filter("count > 1").count() == 0


def test_no_task_gets_a_hot_key_whole(spark):
    rows = [("hot" if i % 3 == 0 else f"k{i % 97}", f"t{i}", 1) for i in range(6000)] + [(None, "x", 1)] * 50
    pairs = skew.therapy_pairs(edges(spark, rows))
    r = skew.task_shares(pairs).first()
    assert r["load"] == 6000 and r["largest_key"] >= 2000 and r["largest"] <= 1.3 * 6000 / r["n_tasks"]
    assert skew.table_totals(pairs).first()["n_all"] == 6050


def test_heavy_values_at_any_size(spark):
    loads = spark.createDataFrame([("a", 30), ("b", 2), (None, 90), ("c", 1)], "k string, n bigint")
    assert skew.heavy_values(loads, "k", "n", 4) == {"a": 4}
    assert skew.heavy_values(loads.filter("k in ('b', 'c')"), "k", "n", 4) == {"b": 2}
    assert skew.heavy_values(loads.limit(0), "k", "n", 4) == {}
    left = spark.createDataFrame([(None, i) for i in range(40)] + [("a", i) for i in range(60)], "k string, i int")
    got = skew.lookup(left, "k", spark.createDataFrame([("a", 1), ("z", 2)], "k string, v int"), {"a": 3}, F.col("i"))
    assert got.count() == 100 and got.filter("v = 1").count() == 60

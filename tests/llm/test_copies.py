import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillgraph.llm import codepoints
from quillgraph.llm.copies import canonical, collapse, terminals


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x") for r in rows], "scope string, row_id bigint, text string, bytes string")
    return sorted(map(tuple, collapse(df, **how).collect()))


def test_canonical_words(spark):
    texts = ["EGFR L858R", "l858r  EGFR", "EG.FR/L858R", "[EGFR_L858R]", "EGFR L858R L858R", "", None, " - ", "Ég a", "a éG"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(canonical(F.col("t"))).collect()]
    assert got[:4] == ["egfr l858r"] * 4 and got[4] == "egfr l858r l858r" and got[5:8] == [None] * 3 and got[8] == got[9] == "a ég"


def test_texts_end_at_the_same_node_if_they_are_copies():
    rnd = random.Random(3)
    words = [b"a", b"ab", b"ab" * 9, b"", b"a", b"ab" * 9 + b"c", b"a\0", b"ab" * 4, b"ab" * 4 + b"\0"] * 2 + [bytes(rnd.choices(b"ab\0", k=rnd.randint(0, 20))) for _ in range(500)]
    scope = np.array([rnd.randint(0, 1) for _ in words])
    end = terminals(scope, *codepoints.binary_bytes(pa.array(words, pa.binary())))
    assert len(set(zip(scope.tolist(), words))) == len(set(end.tolist())) == len(set(zip(scope.tolist(), words, end.tolist())))


def test_against_brute_force_with_hot_text(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(3000):
        words = ["hot", "text"] if i % 3 == 0 else [rnd.choice(["aa", "ab", "abc", "b", "zz9"]) for _ in range(rnd.randint(0, 4))]
        rnd.shuffle(words)
        rows.append((rnd.choice(["g", "v"]), i, rnd.choice([" ", "_", " / "]).join(w.upper() if rnd.random() < 0.5 else w for w in words)))
    groups = defaultdict(list)
    for scope, i, text in rows:
        key = tuple(sorted(text.replace("_", " ").replace("/", " ").lower().split()))
        if key:
            groups[scope, key].append(i)
    want = sorted((s, min(g), i, len(g)) for (s, _), g in groups.items() for i in g)
    for how in ({"capacity": 500}, {"capacity": 20_000}, {}):
        assert run(spark, rows, **how) == want


def test_edges(spark):
    assert run(spark, []) == []
    assert run(spark, [("a", 1, None), ("a", 2, "..")]) == []
    df = spark.createDataFrame([(None, 2, "x"), (None, 1, "X"), ("a", None, "x"), ("a", 3, "x")], "scope string, row_id bigint, text string")
    assert {(r["scope"], r["kept"], r["copy"], r["copies"]) for r in collapse(df).collect()} == {(None, 1, 1, 2), (None, 1, 2, 2), ("a", 3, 3, 1)}
    assert run(spark, [("a", 4, "x"), ("a", 4, "x"), ("b", 1, "X")]) == [("a", 4, 4, 2), ("a", 4, 4, 2), ("b", 1, 1, 1)]
    assert len(run(spark, [("a", i, "w" * 30_000 + str(i % 2)) for i in range(4)])) == 4


def test_long_common_prefix_takes_few_jobs(spark):
    rows = spark.range(10_000).select(F.lit("s").alias("scope"), F.col("id").alias("row_id"), F.concat(F.repeat(F.lit("w"), 20_000), (F.col("id") % 4000).cast("string")).alias("text"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("prefix", "prefix")
    got = collapse(rows, capacity=4 << 20)
    jobs = len(tracker.getJobIdsForGroup("prefix"))
    assert jobs <= 40
    assert got.count() == 10_000 and got.filter("kept <> copy % 4000 or copies not in (2, 3)").count() == 0


def test_chain_of_prefixes(spark):
    rows = [("s", i, "a" * (i % 400 + 1)) for i in range(800)]
    assert run(spark, rows, capacity=300) == sorted(("s", i % 400, i, 2) for i in range(800))

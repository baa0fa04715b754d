import datetime as dt
import random

from quillgraph.operators.orphans import find_orphans

REFS = "source int, row_id bigint, parent int, key string, loaded_at timestamp, note string"
PARENTS = "parent int, key string, loaded_at timestamp, deleted_at timestamp, row_id bigint"


def at(n):
    return None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def run(spark, refs, parents):
    r = spark.createDataFrame([(s, i, p, k, at(t), "x") for s, i, p, k, t in refs], REFS)
    p = spark.createDataFrame([(p, k, at(a), at(b), 1) for p, k, a, b in parents], PARENTS)
    return sorted((x["source"], x["row_id"], x["status"]) for x in find_orphans(r, p).collect())


def judge(refs, parents):
    out = []
    for s, i, p, k, t in refs:
        if k is None:
            continue
        own = [(a, b) for q, l, a, b in parents if q == p and l == k and a is not None]
        if t is None:
            out.append((s, i, "undated"))
        elif not any(a <= t and (b is None or t < b) for a, b in own):
            first = min((a for a, _ in own), default=None)
            out.append((s, i, "missing" if first is None else "late" if first > t else "deleted"))
    return sorted(out)


def test_states_ties_and_nulls(spark):
    parents = [(0, "A", 5, 10), (0, "A", 20, None), (1, "A", 0, None), (0, "B", 7, 7), (0, None, 1, None), (0, "C", None, None), (0, "D", 5, 3)]
    refs = [(0, 1, 0, "A", 4), (0, 2, 0, "A", 5), (0, 3, 0, "A", 10), (0, 4, 0, "A", 20), (0, 5, 0, "B", 8), (0, 6, 0, "C", 1), (0, 7, 0, None, 1), (0, 8, 0, "A", None), (0, 9, 2, "A", 5), (0, 9, 2, "A", 5), (0, 10, 0, "D", 9), (0, 11, 0, "a", 6)]
    assert run(spark, refs, parents) == judge(refs, parents)


def test_hot_key_over_many_tasks(spark):
    rnd = random.Random(3)
    keys = ["hot"] * 6 + ["a", "b", "c"]
    parents = [(0, rnd.choice(keys), t := rnd.randint(0, 50), rnd.choice([None, t + rnd.randint(-1, 9)])) for _ in range(60)]
    refs = [(0, i, 0, rnd.choice([*keys, "gone"]), rnd.randint(0, 60)) for i in range(3000)]
    assert run(spark, refs, parents) == judge(refs, parents)


def test_empty_tables(spark):
    assert run(spark, [], [(0, "A", 1, None)]) == []
    assert run(spark, [(0, 1, 0, "A", 1)], []) == [(0, 1, "missing")]
    assert run(spark, [], []) == []

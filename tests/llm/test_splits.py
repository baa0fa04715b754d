import random
from collections import Counter

import pytest

from quillgraph.llm import splits

ITEM = "item_id bigint, template_id string, paraphrases array<string>, kept string"


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("last", [0, 40, 10_000])
def test_components_against_union_find(spark, monkeypatch, last):
    monkeypatch.setattr(splits, "LAST_LINKS", last)
    rnd = random.Random(4)
    pairs = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(30)] + [(rnd.randint(200, 300), rnd.randint(200, 300)) for _ in range(60)] + [(7, 7), (0, 1)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = {r["vertex"]: r["kept"] for r in splits.smallest_of(splits.components(df)).collect()}
    want = union_find([p for p in pairs if p[0] != p[1]])
    assert got == want
    assert splits.components(df.limit(0)).count() == 0


def test_items(spark):
    rows = [(5, "t", None), (2, "t", []), (9, None, ["Hi  There?!", None, " "]), (1, None, ["hi there"]), (7, "u", ["Hi there. "]), (3, None, [" ", ""]), (4, None, [""]), (8, "", None), (6, "", None), (9, None, ["x"])]
    df = spark.createDataFrame([(*r, "x") for r in rows], ITEM)
    got = sorted((r["kept"], r["item_id"]) for r in splits.related(df).collect())
    assert got == [(1, 1), (1, 7), (1, 9), (2, 2), (2, 5), (6, 6), (6, 8)]


def test_split_is_whole_and_near_its_shares(spark):
    rnd = random.Random(5)
    rows = [(i, "big" if i % 4 == 0 else f"t{rnd.randint(0, 700)}", None, None) for i in range(3000)]
    df = spark.createDataFrame(rows, ITEM)
    got = {r["item_id"]: r["split"] for r in splits.assign(df).collect()}
    assert len(got) == 3000
    by_template = {}
    for i, t, *_ in rows:
        assert by_template.setdefault(t, got[i]) == got[i]
    shares = {k: v / 3000 for k, v in Counter(got.values()).items()}
    assert abs(shares["train"] - 0.8) < 0.02 and abs(shares["validation"] - 0.1) < 0.02 and abs(shares["test"] - 0.1) < 0.02
    assert splits.assign(df.limit(0)).count() == 0


def test_three_tables_a_round(spark, monkeypatch):
    monkeypatch.setattr(splits, "LAST_LINKS", 0)
    written = []
    monkeypatch.setattr(splits, "cut", lambda df, cut=splits.cut, **how: written.append(df.columns) or cut(df, **how))
    splits.components(spark.createDataFrame([(i, i + 1) for i in range(20)], "a bigint, b bigint"))
    unwound = len(written) - 1 - max(i for i, c in enumerate(written) if c == ["a", "b"])
    rounds = sum(c == ["vertex", "into"] for c in written) - unwound
    assert rounds >= 2 and sum(c == ["a", "b"] for c in written) == rounds + 1 and sum("heads" in c for c in written) == rounds

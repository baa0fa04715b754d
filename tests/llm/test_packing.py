from collections import Counter, defaultdict

import numpy as np
import pytest

from quillgraph.llm.packing import fitted, pack, plan


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_up_the_histogram(seed):
    rng = np.random.default_rng(seed)
    histogram = np.bincount(rng.integers(1, [64, 65, 30, 2][seed], 3000), minlength=65)
    used = Counter()
    full = 0
    for inside, n in plan(histogram, 64):
        assert sum(inside) <= 64 and n > 0
        full += n
        for length in inside:
            used[length] += n
    assert all(used[i] == histogram[i] for i in range(1, 65))
    assert (histogram * np.arange(65)).sum() / 64 / full > 0.97


@pytest.mark.parametrize("times", [1, 1000])
def test_patterns_place_short_lengths(times):
    histogram = times * np.bincount(np.random.default_rng(5).integers(2, 21, 3000), minlength=65)
    left = histogram.copy()
    chosen = fitted(left, 64)
    assert all(sum(inside) == 64 and n > 0 for inside, n in chosen)
    placed = Counter()
    for inside, n in chosen:
        for length in inside:
            placed[length] += n
    assert all(placed[i] + left[i] == histogram[i] for i in range(1, 65)) and left.min() >= 0
    assert left.sum() < 0.1 * histogram.sum()


def test_documents(spark):
    sizes = [(1, 0), (2, None), (3, -4), (4, 64), (5, 65), (6, 200), (7, 10), (7, 10)] + [(100 + i, 21) for i in range(300)]
    df = spark.createDataFrame([(*s, 1) for s in sizes], "doc_id bigint, n_tokens bigint, container int")
    rows = pack(df, capacity=64).collect()
    load, pieces = Counter(), defaultdict(list)
    for r in rows:
        load[r["container"]] += r["tokens"]
        pieces[r["doc_id"]].append((r["piece"], r["tokens"]))
    assert max(load.values()) <= 64 and set(load) == set(range(len(load)))
    assert sorted(pieces[6]) == [(1, 64), (2, 64), (3, 64), (4, 8)] and sorted(pieces[5]) == [(1, 64), (2, 1)] and sorted(pieces[7]) == [(1, 10), (1, 10)]
    assert not {1, 2, 3} & set(pieces) and len(pieces) == 304
    assert pack(df.limit(0), capacity=64).count() == 0

import random

import pytest

from pairlab.operators import graph as G
from pairlab.operators import split as L


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(parent)}


def chain(n):
    order = list(range(n))
    random.Random(4).shuffle(order)
    return list(zip(order, order[1:]))


CASES = {
    "chain": chain(200),
    "star": [(500, i) for i in range(300)],
    "random": [tuple(random.Random(i).sample(range(400), 2)) for i in range(250)],
    "repeats": [(1, 2), (2, 1), (2, 3), (5, 5), (7, 8), (7, 8)],
}


@pytest.mark.parametrize("name", CASES)
def test_components(spark, name):
    edges = CASES[name]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in G.connected_components(df, "a", "b").collect()}
    assert got == union_find([e for e in edges if e[0] != e[1]])


def test_isolated_entities_are_components_of_one(spark):
    df = spark.createDataFrame([("x", "y")], "a string, b string")
    ents = spark.createDataFrame([("x",), ("y",), ("z",)], "id string")
    got = {r.id: r.component for r in G.connected_components(df, "a", "b", ents).collect()}
    assert got == {"x": "x", "y": "x", "z": "z"}


def greedy(sizes, targets):
    """One item at a time, largest first, into the largest deficit."""
    filled = [0] * len(targets)
    counts = {}
    for s in sorted(sizes, reverse=True):
        k = max(range(len(targets)), key=lambda i: targets[i] - filled[i])
        filled[k] += s
        counts[(s, k)] = counts.get((s, k), 0) + 1
    return counts


def test_packing_by_size_classes_equals_item_by_item_greedy():
    rng = random.Random(2)
    for trial in range(300):
        kinds = [rng.choice([1, 1, 1, 2, 3, 5, 8, 40, 200]) for _ in range(rng.randint(1, 4))]
        sizes = [s for s in kinds for _ in range(rng.randint(1, 60))]
        fractions = rng.choice([[0.7, 0.15, 1 - 0.7 - 0.15], [0.2] * 5, [0.5, 0.5], [1 / 3] * 3])
        targets = [f * sum(sizes) for f in fractions]
        hist = [(s, sizes.count(s)) for s in set(sizes)]
        got = {}
        for s, k, first, last in L._quotas(hist, targets):
            got[(s, k)] = got.get((s, k), 0) + last - first + 1
        assert got == greedy(sizes, targets)


def components(spark):
    rows = [(c * 100 + i, c * 100) for c in range(30) for i in range(c % 7 + 1)] + [(9000 + i, 9000 + i) for i in range(101)]
    return spark.createDataFrame(rows, "id long, component long")


def test_quotas_of_a_huge_size_class_are_found_at_once():
    out = L._quotas([(1, 10**9)], [0.7e9, 0.15e9, 0.15e9])
    assert sum(last - first + 1 for _, _, first, last in out) == 10**9
    assert abs(out[0][3] - 0.7e9) <= 1


def test_splits_cover_and_keep_components_whole(spark):
    c = components(spark)
    for split, col in ((L.split_train_test(c), "split"), (L.split_three_way(c), "split"), (L.split_kfold(c, 5), "fold")):
        rows = split.collect()
        assert len(rows) == c.count() == len({r.id for r in rows})
        per = {}
        for r in rows:
            per.setdefault(r.component, set()).add(r[col])
        assert all(len(v) == 1 and None not in v for v in per.values())


def test_train_test_overshoots_by_less_than_one_component(spark):
    c = components(spark)
    covered = [r for r in L.split_train_test(c).collect() if r.component < 9000 and r.component // 100 % 7 + 1 > 1]
    n_test = sum(r.split == "test" for r in covered)
    assert round(0.2 * len(covered)) <= n_test < round(0.2 * len(covered)) + 7


def test_splits_do_not_depend_on_partitions(spark):
    c = components(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = set()
    try:
        for n in (1, 7, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            rows = L.split_three_way(c.repartition(n)).collect()
            seen.add(tuple(sorted((r.id, r.split) for r in rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


def test_leak_check_raises_on_a_crossing_pair(spark):
    ents = spark.createDataFrame([(1,), (2,)], "id long")
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    good = spark.createDataFrame([(1, "train"), (2, "train")], "id long, split string")
    bad = spark.createDataFrame([(1, "train"), (2, "test")], "id long, split string")
    L.leak_check(pairs, "a", "b", good, ents)
    with pytest.raises(ValueError):
        L.leak_check(pairs, "a", "b", bad, ents)
    with pytest.raises(ValueError):
        L.leak_check(pairs, "a", "b", good.limit(1), ents)


def test_starved_splits_are_listed(spark):
    s = spark.createDataFrame([(1, 1, "train"), (2, 1, "train"), (3, 3, "val")], "id long, component long, split string")
    assert {r.split for r in L.starved_splits(s).collect()} == {"val", "test"}

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.llm import hardneg, queries


def brute(rows, is_anchor):
    out = []
    for a, label, v in rows:
        if not is_anchor(a):
            continue
        score = lambda w: sum(int(x) * int(y) for x, y in zip(v, w, strict=False))
        others = sorted(((-score(w), i, k) for i, k, w in rows if i != a))
        pos = [(-s, i) for s, i, k in others if k == label][:5]
        for ps, p in pos:
            neg = [(-s, i) for s, i, k in others if k != label and 50 * ps <= -100 * s <= 95 * ps][:3]
            out += [(a, p, r + 1, n, ps, ns) for r, (ns, n) in enumerate(neg)]
    return sorted(out)


def vectors(seed, n=260, d=10):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(4, d))
    v = centre[r.integers(0, 4, n)] + r.normal(size=(n, d)) * r.choice([0.05, 0.6], n)[:, None]
    v[5], v[6], v[7], v[8] = v[50], v[50], 0, 0  # ties and zeros
    return [(i, int(r.integers(0, 3)), v[i]) for i in range(n)]


@pytest.mark.parametrize("seed,anchors,rows,dense", [(1, 1024, 4096, 0.1), (2, 3, 40, 2.0), (3, 2, 25, -1.0)])
def test_against_brute_force(spark, seed, anchors, rows, dense, monkeypatch):
    monkeypatch.setattr(hardneg, "ANCHORS", anchors)
    monkeypatch.setattr(hardneg, "ROWS", rows)
    monkeypatch.setattr(hardneg, "AT_ONCE", 2)
    monkeypatch.setattr(hardneg, "DENSE", dense)
    made = [(i, k, np.floor(256 * v).tolist()) for i, k, v in vectors(seed)]
    df = spark.createDataFrame(made, "id long, label int, v array<double>").repartition(4)
    got = hardneg.mine(df, F.col("id") % 10 == 0).collect()
    want = brute(made, lambda i: i % 10 == 0)
    assert len(want) > 100
    assert sorted(tuple(r) for r in got) == want


def test_query_on_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(np.float32(x)) for x in v], k) for i, k, v in vectors(7, 200)]
    odd = [(300, None, 1), (301, [1.0] * 10, None), (350, [1.0] * 9 + [nan], 1), (303, [inf] + [0.0] * 9, 0), (304, [1.0, None], 0), (None, [1.0] * 10, 0), (400, [], 1), (305, [0.5] * 3, 2)]
    again = [rows[50], rows[3]]
    spark.createDataFrame(rows + odd + again, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op12_hard_negatives(spark, str(tmp_path)).collect()
    fine = [*rows, (400, [], 1), (305, [0.5] * 3, 2)]
    made = [(i, (k + 1) % 10 if i % 7 == 0 else k, [float(np.floor(256 * x)) for x in v]) for i, v, k in fine]
    assert sorted(tuple(r) for r in got) == brute(made, lambda i: i % 50 == 0)


def test_large_numbers_are_exact(spark):
    r = random.Random(3)
    made = [(i, i % 2, [float(r.randrange(-(2**30), 2**30)) for _ in range(6)]) for i in range(40)]
    got = hardneg.mine(spark.createDataFrame(made, "id long, label int, v array<double>"), F.col("id") % 4 == 0).collect()
    want = brute(made, lambda i: i % 4 == 0)
    assert len(want) > 10 and sorted(tuple(x) for x in got) == want


def test_bounds_hold_scores():
    r = np.random.default_rng(2)
    a, c = r.normal(size=(30, 21)) + 1, r.normal(size=(50, 21))
    exact = a @ c.T
    tile = hardneg.Tile(hardneg.Summaries(a), hardneg.Summaries(c))
    width = []
    for level in range(len(hardneg.LEVELS)):
        tile.narrow(level, np.ones(exact.shape, bool))
        assert (tile.low <= exact).all() and (exact <= tile.high).all()
        width.append((tile.high - tile.low).mean())
    assert width[1] < width[0]


def test_few_labels_and_empty_table(spark):
    empty = spark.createDataFrame([], "id long, label string, v array<double>")
    assert hardneg.mine(empty, F.col("id") % 2 == 0).count() == 0
    one = spark.createDataFrame([(k, "a", [float(k)]) for k in range(6)], empty.schema)
    assert hardneg.mine(one, F.col("id") % 2 == 0).count() == 0
    assert hardneg.mine(one, F.col("id") > 100).count() == 0

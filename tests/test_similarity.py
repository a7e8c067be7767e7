import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairlab.operators import similarity as S
from pairlab.operators.models import candidate_grid
from pairlab.session import truncate_lineage


def points(n=300, d=6, clusters=7, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d)) * 4
    x = centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, d)) * 0.2
    x[10] = x[11] = x[12]  # equal vectors: ties
    x[20] = x[21] = 0.0  # zero vectors
    return x


def frame(spark, x):
    return spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "id long, v array<double>")


def brute(x, metric):
    if metric == "cosine":
        n = np.linalg.norm(x, axis=1)
        u = x / np.where(n > 0, n, 1)[:, None]
        return np.round(np.array([[float(np.dot(a, b)) for b in u] for a in u]), 12)
    return -np.round(np.array([[np.sqrt(((a - b) ** 2).sum()) for b in x] for a in x]), 12)


def brute_rank(s, q, t):
    better = [c for c in range(len(s)) if c not in (q, t) and (s[q, c] > s[q, t] or (s[q, c] == s[q, t] and c < t))]
    return 1 + len(better)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("pivots,block", [(1, 2048), (1, 50), (9, 40)])
def test_ranks_equal_brute_force(spark, metric, pivots, block):
    x = points()
    s = brute(x, metric)
    rng = np.random.default_rng(1)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, len(x), (80, 2)) if a != b}
    pairs |= {(5, t) for t in range(len(x)) if t != 5}  # one query holds most rows
    pairs |= {(10, 11), (11, 10), (12, 10), (20, 21), (20, 5), (5, 20), (3, 11)}
    q = spark.createDataFrame(sorted(pairs), "query_id long, target_id long")
    got = {(r.query_id, r.target_id): r["rank"] for r in S.rank_targets(q, frame(spark, x), metric, block, pivots).collect()}
    assert got == {p: brute_rank(s, *p) for p in pairs}


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("pivots", [1, 9])
def test_neighbors_equal_brute_force(spark, metric, pivots):
    x = points()
    s = brute(x, metric)
    hidden = {(0, c) for c in range(1, 280)} | {(7, 8), (10, 11)}  # one query hides almost everything
    q = spark.createDataFrame([(i,) for i in range(0, 60)], "query_id long")
    ex = spark.createDataFrame(sorted(hidden), "query_id long, id long")
    rows = S.top_neighbors(q, frame(spark, x), 4, metric, ex, 40, pivots).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.id)
    want = {}
    for i in range(60):
        cand = [c for c in range(len(x)) if c != i and (i, c) not in hidden]
        want[i] = sorted(cand, key=lambda c: (-s[i, c], c))[:4]
    assert got == want


def test_results_do_not_depend_on_partitions(spark):
    x = frame(spark, points(120))
    q = spark.range(0, 100).selectExpr("id as query_id", "id + 1 as target_id")
    seen = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows = S.rank_targets(q, x.repartition(int(n)), block=30).collect()
            seen.add(tuple(sorted((r.query_id, r["rank"], r.score) for r in rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


def test_string_ids(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0])], "id string, v array<double>")
    q = spark.createDataFrame([("a", "c"), ("c", "b")], "query_id string, target_id string")
    assert {(r.query_id, r["rank"]) for r in S.rank_targets(q, v).collect()} == {("a", 2), ("c", 1)}


def test_mean_pair_cosine(spark):
    x = points(50)
    s = brute(x, "cosine")
    iu = np.triu_indices(50, 1)
    row = S.mean_pair_cosine(frame(spark, x)).first()
    assert row.n_pairs == 50 * 49 // 2
    assert abs(row.mean_cosine - s[iu].mean()) < 1e-9


def test_grid_has_every_pair_once(spark):
    v = frame(spark, points(23))
    q = v.limit(23).selectExpr("id as query_id", "v")
    rows = [(r.query_id, r.id) for r in candidate_grid(q, v, 23, 23, 5).select("query_id", "id").collect()]
    assert len(rows) == len(set(rows)) == 23 * 22


@pytest.mark.parametrize("pivots", [1, 5])
def test_no_cross_product_in_the_scoring_plan(spark, pivots):
    x = frame(spark, points(40))
    q = spark.range(0, 30).selectExpr("id as query_id", "id + 1 as target_id")
    plan = S.rank_targets(q, x, block=10, pivots=pivots)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_rows_are_copied_a_fixed_number_of_times(spark):
    """Three times the rows, three times the copies: parts of a table do not multiply with its blocks."""
    copies = {}
    for n in (400, 1200):
        x = truncate_lineage(frame(spark, points(n)))
        q = spark.range(0, n - 1).selectExpr("id as query_id", "id + 1 as target_id")
        cells, placed = S.build_cells(x, "cosine", 1, 20)
        routed = q.join(x.withColumnRenamed("id", "query_id"), "query_id").withColumn("cells", F.lit(S.ONLY))
        grid = S._grid(routed, placed, n - 1, n, 20, ["query_id"], ["query_id", "v", "cells"])
        size = lambda q, c: pa.table({"n": pa.array([q.num_rows + c.num_rows])})
        copies[n] = grid.applyInArrow(size, "n long").agg(F.sum("n")).first()[0]
    assert copies[1200] <= 3.05 * copies[400]


def test_a_search_writes_each_row_once(spark, monkeypatch):
    """No copies for parts: rows are packed into blocks, and the blocks hold every row once."""
    monkeypatch.setattr(S, "FEWEST", 20)
    x = truncate_lineage(frame(spark, points(90)))
    seen = []
    packed = S.packed_blocks
    monkeypatch.setattr(S, "packed_blocks", lambda *a: seen.append(packed(*a)) or seen[-1])
    near = S.top_neighbors(x.select(F.col("id").alias("query_id")), x, 3, block=20, pivots=1)
    assert "explode" not in near._jdf.queryExecution().executedPlan().toString()
    rows = [S._unpacked(p, [c], f"{c} long").count() for p, c in zip(seen, ("c_id", "query_id"), strict=True)]
    assert rows == [90, 90] and all(p.count() > 1 for p in seen)


def test_what_leaves_a_block_product_grows_with_the_queries_alone(spark, monkeypatch):
    """However many parts the candidates fill, a query leaves the tasks equally often."""
    monkeypatch.setattr(S, "FEWEST", 10)
    monkeypatch.setattr(S, "PACKED", 10)
    monkeypatch.setattr(S, "HELD", 1)
    q = S.packed_blocks(spark.range(400).selectExpr("id as key"), 400, "key")
    size = lambda a, b: pa.table({"key": a.column("key"), "n": pa.array([b.num_rows] * a.num_rows, pa.int64())})
    left = {}
    for n in (400, 1600):
        c = S.packed_blocks(spark.range(n).selectExpr("id as c_id"), n, "c_id")
        rows = S.block_product(q, c, size, "key long, n long", S.add_up("n"))
        left[n] = rows.count()
        assert {r[0] for r in rows.groupBy("key").agg(F.sum("n")).select("sum(n)").collect()} == {n}
    assert left[1600] == left[400]


def test_lists_of_pieces_are_merged_like_one_list():
    a = pa.table({"query_id": [1, 1, 2], "id": [5, 9, 3], "score": [0.5, 0.2, 0.1]})
    b = pa.table({"query_id": [1, 1, 3], "id": [4, 7, 8], "score": [0.5, 0.3, 0.0]})
    got = S.best_of(2)(a, b).to_pydict()
    assert got == {"query_id": [1, 1, 2, 3], "id": [4, 5, 3, 8], "score": [0.5, 0.5, 0.1, 0.0]}

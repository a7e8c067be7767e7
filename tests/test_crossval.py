from collections import Counter

from pyspark.sql import functions as F

from pairlab.operators.graph import connected_components
from pairlab.operators.split import split_kfold, split_loco
from pairlab.plans.crossval import cross_validate, training_rows


def tables(spark):
    v = spark.range(60).select("id", F.array(F.sin("id"), F.cos("id"), F.lit(0.1)).alias("v"), F.lit("f").alias("family"))
    pairs = [(f"p{k}", 3 * k, 3 * k + 1) for k in range(12)] + [("q", 40, 41), ("q2", 41, 42)]
    return v, spark.createDataFrame(pairs, "pair_id string, id_1 long, id_2 long")


def test_training_rows_keep_the_fold_out(spark):
    v, positives = tables(spark)
    folds = split_kfold(connected_components(positives, "id_1", "id_2", v)).select("id", "fold")
    where = {r.id: r.fold for r in folds.collect()}
    known = {(r.id_1, r.id_2) for r in positives.collect()}
    rows = training_rows(positives, v, folds, ratio=3).collect()
    counts = Counter((r.fold, r.label) for r in rows)
    for f in set(where.values()):
        inside = sum(where[a] == f for a, _ in known)
        assert counts[(f, 1)] == len(known) - inside
        assert counts[(f, 0)] == 3 * counts[(f, 1)]
    assert all(where[r.id_a] != r.fold != where[r.id_b] for r in rows)
    assert all(((r.id_a, r.id_b) in known) == (r.label == 1) for r in rows)
    assert all(abs(r.class_weight - (2.0 if r.label else 2 / 3)) < 1e-9 for r in rows)


def test_every_query_is_ranked_in_its_own_fold(spark):
    v, positives = tables(spark)
    components = connected_components(positives, "id_1", "id_2", v)
    folds = split_loco(components).select("id", "fold")
    got = cross_validate(positives, v, folds, {}).collect()
    where = {r.id: r.fold for r in folds.collect()}
    assert len(got) == 2 * positives.count()
    assert all(where[r.query_id] == where[r.target_id] == r.fold for r in got)
    assert all(1 <= r.cosine_rank < 60 for r in got)

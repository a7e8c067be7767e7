import math
import random
import statistics

from pyspark.sql import functions as F

from pairlab.operators import aggregates as A
from pairlab.operators import evaluate as M
from pairlab.operators import ranking as K
from pairlab.operators import reports as P
from pairlab.operators import resolve as R
from pairlab.operators.order import exact_quantiles, number_by_hash, running_by_value


def scored(spark, n=400, seed=1, places=1):
    rng = random.Random(seed)
    rows = [(round(rng.random() + 0.3 * (i % 3 == 0), places), int(i % 3 == 0)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "score double, label int")


def test_auc_and_average_precision_with_ties(spark):
    for places in (1, 6):
        rows, df = scored(spark, places=places)
        pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
        auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
        assert abs(M.roc_auc(df).first()[0] - auc) < 1e-12
        ap, tp, seen = 0.0, 0, 0
        for s in sorted({s for s, _ in rows}, reverse=True):
            hit = sum(y for x, y in rows if x == s)
            seen += sum(x == s for x, _ in rows)
            tp += hit
            ap += hit * tp / seen
        assert abs(M.average_precision(df).first()[0] - ap / len(pos)) < 1e-12


def test_single_class_gives_null(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "score double, label int")
    assert M.roc_auc(df).first()[0] is None


def test_zero_division_gives_zero(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 0)], "score double, label int")
    m = M.classification_metrics(M.confusion(df)).first()
    assert (m.accuracy, m.precision, m.recall, m.f1) == (0.5, 0.0, 0.0, 0.0)


def test_student_p_known_values():
    # tabulated two-sided values: t = 2.228 at 10, 1.96 in the limit, 12.706 at 1
    assert abs(M.student_p(2.228138852, 10) - 0.05) < 1e-8
    assert abs(M.student_p(12.70620474, 1) - 0.05) < 1e-8
    assert abs(M.student_p(1.959963985, 1e7) - 0.05) < 1e-6
    assert M.student_p(0.0, 5) == 1.0


def test_welch_against_the_formula(spark):
    rows, df = scored(spark, places=6)
    a, b = [s for s, y in rows if y], [s for s, y in rows if not y]
    va, vb = statistics.variance(a) / len(a), statistics.variance(b) / len(b)
    w = M.welch_t(df).first()
    assert abs(w.t - (statistics.mean(a) - statistics.mean(b)) / math.sqrt(va + vb)) < 1e-9
    assert w.significant and 0 < w.p < 1e-6


def test_exact_quantiles_of_a_hot_group(spark):
    rng = random.Random(5)
    rows = [("hot", float(rng.randint(0, 50))) for _ in range(900)] + [("cold", 1.0), ("cold", 2.0), ("one", 7.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: (r.a, r.b) for r in exact_quantiles(df, "x", {"a": 0.25, "b": 0.9}, ["g"]).collect()}

    def quantile(xs, p):
        xs = sorted(xs)
        h = (len(xs) - 1) * p
        return xs[math.floor(h)] + (xs[math.ceil(h)] - xs[math.floor(h)]) * (h - math.floor(h))

    for g in ("hot", "cold", "one"):
        xs = [x for k, x in rows if k == g]
        assert all(abs(u - quantile(xs, p)) < 1e-9 for u, p in zip(got[g], (0.25, 0.9)))


def test_running_sums_and_numbers(spark):
    df = spark.range(1000).withColumn("x", (F.col("id") * 7919) % 1009)
    cum = running_by_value(df, "x", {"s": F.col("id"), "n": F.lit(1)}).collect()
    total = n = 0
    for r in sorted(cum, key=lambda r: r.x):
        total, n = total + r.id, n + 1
        assert (r.s, r.n) == (total, n)
    idx = sorted(r.idx for r in number_by_hash(df, "s", ["id"]).collect())
    assert idx == list(range(1, 1001))


def test_describe_of_one_value_and_empty(spark):
    one = A.describe(spark.createDataFrame([(3.0,)], "x double"), "x").first()
    assert (one.n, one.mean, one.std, one.q50) == (1, 3.0, None, 3.0)


def test_histogram_closes_the_last_bin_and_survives_one_value(spark):
    df = spark.createDataFrame([(0.0, 1), (1.0, 1), (0.5, 1), (2.0, 0), (2.0, 0)], "x double, label int")
    got = {(r.label, r.bin): r.n for r in A.histogram(df, "x", "label", 2).collect()}
    assert got == {(1, 0): 1, (1, 1): 2, (0, 0): 2}


def test_rank_from_scores_ties(spark):
    s = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.5), (1, 12, 0.5), (1, 13, 0.1)], "query_id long, id long, score double")
    t = spark.createDataFrame([(1, 12)], "query_id long, target_id long")
    assert K.rank_from_scores(s, t).first()["rank"] == 3
    assert K.rank_from_scores(s, t, ties="optimistic").first()["rank"] == 2


def test_hit_flags(spark):
    r = K.hit_flags(spark.createDataFrame([(4,)], "rank long")).first()
    assert (r.reciprocal_rank, r.hits_at_1, r.hits_at_5) == (0.25, 0, 1)


def test_best_method_puts_nan_last(spark):
    df = spark.createDataFrame([("a", 0.1), ("b", float("nan")), ("c", 0.3)], "method string, mrr double")
    rows = K.best_method(df, ["a"]).collect()
    assert [r.method for r in rows] == ["c", "a", "b"] and [r.beats_baselines for r in rows] == [True, False, False]


def test_run_consistency(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.25)], "k long, m double")
    close = spark.createDataFrame([(1, 0.5 + 1e-9), (2, 0.25)], "k long, m double")
    far = spark.createDataFrame([(1, 0.6), (2, 0.25)], "k long, m double")
    assert R.run_consistency(a, close, ["k"], ["m"]).first().consistent is True
    assert R.run_consistency(a, far, ["k"], ["m"]).first().consistent is False
    assert R.run_consistency(a, far.limit(1), ["k"], ["m"]).first().consistent is None


def test_fold_verdicts(spark):
    def verdict(cand, ref):
        rows = [(i, c, r) for i, (c, r) in enumerate(zip(cand, ref))]
        return P.kfold_compare(spark.createDataFrame(rows, "fold int, c_mrr double, r_mrr double"), "c", "r").first().verdict

    assert verdict([0.5] * 5, [0.4] * 5) == "stable improvement"
    assert verdict([0.3] * 5, [0.4] * 5) == "no improvement"
    assert verdict([0.5, 0.5, 0.3, 0.3, 0.3], [0.4] * 5) == "mixed"


def test_dataset_verdicts(spark):
    runs = spark.createDataFrame(
        [("a", "old", 0.1), ("a", "new", 0.2), ("b", "old", 0.2), ("b", "new", 0.1), ("c", "new", 0.1), ("d", "old", 0.1), ("d", "new", 0.1)],
        "method string, dataset string, mrr double",
    )
    got = {r.method: r.verdict for r in P.dataset_compare(runs, "old", "new").collect()}
    assert got == {"a": "IMPROVED", "b": "WORSE", "c": "not found", "d": "UNCHANGED"}

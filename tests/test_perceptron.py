import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from pairlab.operators import perceptron as P


def table(spark, x, y, w):
    return spark.createDataFrame([(k, Vectors.dense(a.tolist()), int(b), float(c)) for k, (a, b, c) in enumerate(zip(x, y, w))], ["row", "features", "label", "w"]).repartition(3)


def circles(n=240, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 2)) * 3 + 100
    return x, ((x - 100) ** 2).sum(1) < 9


def test_gradient_is_that_of_differences():
    r = np.random.default_rng(3)
    sizes = (3, 4, 2, 1)
    m = P.Perceptron(sizes, P.start_weights(sizes, 1), np.zeros(3), np.ones(3))
    x, y, w = r.normal(size=(20, 3)), r.integers(0, 2, 20).astype(float), r.random(20)
    _, g = m.loss(x, y, w, True)
    for k in range(len(g)):
        e = np.zeros(len(g))
        e[k] = 1e-6
        up, down = (P.Perceptron(sizes, m.weights + s * e, m.mean, m.std).loss(x, y, w, False)[0] for s in (1, -1))
        assert g[k] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def test_a_weight_counts_as_repeated_rows(spark):
    x, y = circles(60)
    w = np.where(np.arange(60) % 3 == 0, 3.0, 1.0)
    one = P.fit_perceptron(table(spark, x, y, w), "w", ["row"], (5,), 6, validation=0.0)
    many = np.repeat(np.arange(60), w.astype(int))
    scaled = P.Perceptron(one.sizes, one.weights, one.mean, one.std)
    a = scaled.loss(x, y.astype(float), w, True)
    b = scaled.loss(x[many], y[many].astype(float), np.ones(len(many)), True)
    assert a[0] == pytest.approx(b[0]) and a[1] == pytest.approx(b[1])


def test_learns_what_a_line_cannot(spark):
    x, y = circles()
    model = P.fit_perceptron(table(spark, x[:180], y[:180], np.ones(180)), None, ["row"], (12,), 40)
    scored = P.predict_perceptron(model, table(spark, x[180:], y[180:], np.ones(60))).select("row", "label", "score").collect()
    assert np.mean([(r["score"] > 0.5) == r["label"] for r in scored]) > 0.85


def test_same_result_from_other_partitions(spark):
    x, y = circles(80)
    df = table(spark, x, y, np.ones(80))
    a, b = (P.fit_perceptron(df.repartition(n), "w", ["row"], (4,), 5) for n in (1, 6))
    assert a.weights == pytest.approx(b.weights, abs=1e-6)


def test_empty_table(spark):
    with pytest.raises(ValueError):
        P.fit_perceptron(table(spark, *circles(4), np.ones(4)).limit(0), "w", ["row"], (2,), 2)

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.functions import evidence as E
from pairlab.functions import text as T
from pairlab.operators import aggregates as A
from pairlab.operators import alignment as B
from pairlab.operators import features as H
from pairlab.operators import models as C
from pairlab.operators import ranking as K
from pairlab.operators import resolve as R
from pairlab.operators import rows as D
from pairlab.operators import similarity as S
from pairlab.operators import translation as Z
from pairlab.plans.training import prepare
from pairlab.sources import readers, writers


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "id long, v array<double>")


# --- text and rows -------------------------------------------------------------


@pytest.mark.parametrize(
    "raw,clean,stripped,base",
    [
        (" Act c 10.0101 ", "Act c 10.0101", "Act c 10", "Act c 10"),
        ("a.b.12", "a.b.12", "a.b", "a"),
        (None, "", "", ""),
        ("x.1a", "x.1a", "x.1a", "x"),
    ],
)
def test_names(spark, raw, clean, stripped, base):
    df = spark.createDataFrame([(raw,)], "n string")
    r = df.select(T.clean_text("n").alias("c"), T.strip_isoform("n").alias("s"), T.base_name("n").alias("b")).first()
    assert (r.c, r.s, r.b) == (clean, stripped, base)


def test_missing_names_and_modes(spark):
    df = spark.createDataFrame([("a", 1, 1), ("nan", 2, 2), ("", 3, 3), ("a", 4, 4), (None, 5, 5)], "n string, id long, o long")
    first = {r.name: r.id for r in R.name_to_id(df, "n", "id", "o").collect()}
    last = {r.name: r.id for r in R.name_to_id(df, "n", "id", "o", "last").collect()}
    assert first == {"a": 1} and last == {"a": 4}
    rep = R.name_map_report(df, "n").first()
    assert (rep.n_names, rep.n_duplicates) == (1, 1)


def test_min_length_keeps_empty(spark):
    df = spark.createDataFrame([("",), ("A" * 29,), ("A" * 30,), (None,)], "seq string")
    assert D.min_length(df).count() == 3
    assert D.min_length(df, drop_empty=True).count() == 1
    assert df.agg(D.count_short(df)).first()[0] == 1


def test_first_per_key_keeps_null_keys_and_null_values(spark):
    df = spark.createDataFrame([(None, 2, "b"), (None, 1, None), ("k", 3, "c")], "k string, o long, x string")
    got = {(r.k, r.o, r.x) for r in D.first_per_key(df, ["k"], ["o"]).collect()}
    assert got == {(None, 1, None), ("k", 3, "c")}


def test_exclusion_rules_differ_and_keep_null(spark):
    levels = [("Confirmed",), (None,), ("Reported low/weak",), ("Risky/Contested",), ("strongly NEGATIVE",)]
    df = spark.createDataFrame(levels, "evidence_level string")
    regex = {r[0] for r in E.exclude_by_regex(df).collect()}
    prefix = {r[0] for r in E.exclude_by_prefix(df).collect()}
    assert regex == {"Confirmed", None, "Reported low/weak"}
    assert prefix == {"Confirmed", None, "strongly NEGATIVE"}


def test_exact_then_base(spark):
    keys = spark.createDataFrame([("A b.2", 1), ("A b.1", 2), ("C", 3)], "key string, o long")
    q = spark.createDataFrame([("A b",), ("C",), ("A b.1",), ("Z",)], "name string")
    got = {r.name: r.resolved for r in R.resolve_exact_then_base(q, "name", keys, "key", "o").collect()}
    assert got == {"A b": "A b.2", "C": "C", "A b.1": "A b.1", "Z": None}


def test_sinks_and_required_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "x", y', "train"), (2, None, "test")], "id long, t string, split string")
    writers.write_table(df, str(tmp_path / "csv"), "csv")
    back = readers.read_dirty_csv(spark, str(tmp_path / "csv"), "id long, t string, split string")
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}
    writers.write_splits(df, str(tmp_path / "s"))
    plan = spark.read.parquet(str(tmp_path / "s")).filter("split = 'test'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "split" in plan
    with pytest.raises(ValueError, match="available columns"):
        readers.read_vectors(spark, str(tmp_path / "s"), "id", "embedding")


# --- features ------------------------------------------------------------------


def test_kmers_skip_other_letters_and_overlap(spark):
    s = spark.createDataFrame([(1, "AAAAC"), (2, "AAXAA"), (3, "AA")], "id long, seq string")
    got = {(r.id, r.kmer): r.freq for r in H.kmer_profile(s).collect()}
    assert got == {(1, "AAA"): 2 / 3, (1, "AAC"): 1 / 3}
    pairs = spark.createDataFrame([(1, 2), (1, 1)], "a long, b long")
    cos = {(r.a, r.b): r.kmer_cosine for r in H.kmer_cosine(pairs, "a", "b", H.kmer_vectors(s)).collect()}
    assert cos[(1, 2)] == 0.0 and abs(cos[(1, 1)] - 1) < 1e-12


def test_profile_cosine_against_counting(spark):
    rng = random.Random(1)
    seqs = {i: "".join(rng.choice("ACDEFGB") for _ in range(80)) for i in range(12)}
    s = spark.createDataFrame(list(seqs.items()), "id long, seq string")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(11)] + [(0, 99)], "a long, b long")
    got = {(r.a, r.b): r.kmer_cosine for r in H.kmer_cosine(pairs, "a", "b", H.kmer_vectors(s)).collect()}

    def words(t):
        out = {}
        for i in range(len(t) - 2):
            if "B" not in t[i : i + 3]:
                out[t[i : i + 3]] = out.get(t[i : i + 3], 0) + 1
        return out

    for a in range(11):
        x, y = words(seqs[a]), words(seqs[a + 1])
        want = sum(x[w] * y.get(w, 0) for w in x) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        assert abs(got[(a, a + 1)] - want) < 1e-9
    assert got[(0, 99)] == 0.0
    near = S.top_neighbors(spark.createDataFrame([(3,)], "query_id long"), H.kmer_vectors(s), 11, width=H.KMER_WIDTH, pivots=3)
    best = {r.id: r.score for r in near.collect()}
    assert len(best) == 11 and abs(best[4] - got[(3, 4)]) < 1e-9


def test_token_similarity_with_fewer_cells_than_k(spark):
    rng = np.random.default_rng(0)
    lengths = {1: 2, 2: 3, 3: 9}
    mats = {i: rng.normal(size=(n, 4)) for i, n in lengths.items()}
    rows = [(i, p, [float(x) for x in r]) for i, m in mats.items() for p, r in enumerate(m)]
    t = spark.createDataFrame(rows, "id long, pos int, v array<double>")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a long, b long")
    got = {(r.a, r.b): r for r in H.token_topk_similarity(pairs, "a", "b", t, block=1).collect()}
    for a, b in ((1, 2), (2, 3), (3, 1)):
        ua, ub = (m / np.linalg.norm(m, axis=1)[:, None] for m in (mats[a], mats[b]))
        s = np.sort((ua @ ub.T).ravel())[::-1]
        for k in (5, 15, 30):
            assert abs(got[(a, b)][f"top_{k}"] - s[:k].mean()) < 1e-9


def test_scaler_handles_constant_dimensions_and_inverts(spark):
    x = np.array([[1.0, 5.0], [3.0, 5.0], [8.0, 5.0]])
    v = vectors(spark, x)
    sc = H.fit_scaler(v)
    z = H.scale(v, sc)
    got = np.array([r.v for r in z.orderBy("id").collect()])
    assert np.allclose(got[:, 0], (x[:, 0] - x[:, 0].mean()) / x[:, 0].std()) and np.allclose(got[:, 1], 0)
    assert np.allclose([r.v for r in H.scale(z, sc, inverse=True).orderBy("id").collect()], x)


def test_pca_matches_numpy(spark):
    x = np.random.default_rng(2).normal(size=(60, 5)) * [5, 3, 1, 0.5, 0.1] + 7
    out, share = H.pca_project(vectors(spark, x), 2)
    got = np.array([r.v for r in out.orderBy("id").collect()])
    c = x - x.mean(0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(c @ vt[:2].T)) and abs(share - (s[:2] ** 2).sum() / (s**2).sum()) < 1e-9


def test_pooling_and_trimming(spark):
    rows = [(1, 0, [1.0, -5.0]), (1, 1, [3.0, -1.0]), (1, 2, [8.0, -3.0]), (2, 0, [2.0, 2.0])]
    t = spark.createDataFrame(rows, "id long, pos int, v array<double>")
    assert {r.id: r.v for r in A.pool_tokens(t, "max").collect()} == {1: [8.0, -1.0], 2: [2.0, 2.0]}
    assert {r.id: r.v for r in A.pool_tokens(t, "mean").collect()} == {1: [4.0, -3.0], 2: [2.0, 2.0]}
    assert [(r.id, r.pos, r.v) for r in A.trim_special_tokens(t).collect()] == [(1, 0, [3.0, -1.0])]


# --- alignment -----------------------------------------------------------------


def align_slowly(a, b, m):
    """Text-book affine local alignment on tuples (score, identical, columns)."""
    at = {c: i for i, c in enumerate(B.BLOSUM_LETTERS)}
    low = (-(10**9), 0, 0)
    h, e, f = ({} for _ in range(3))
    best = (0, 0, 0)

    def plus(t, s, same=0):
        return (t[0] + s, t[1] + same, t[2] + 1)

    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            zero = (0, 0, 0)
            e[i, j] = max(plus(h.get((i, j - 1), zero), -11), plus(e.get((i, j - 1), low), -1))
            f[i, j] = max(plus(h.get((i - 1, j), zero), -11), plus(f.get((i - 1, j), low), -1))
            d = plus(h.get((i - 1, j - 1), zero), int(m[at[a[i - 1]], at[b[j - 1]]]), int(a[i - 1] == b[j - 1]))
            c = max(d, e[i, j], f[i, j])
            h[i, j] = c if c[0] > 0 else zero
            best = max(best, h[i, j])
    return (100 * best[1] / best[2] if best[2] else 0.0), float(best[0])


def test_alignment_matches_the_text_book(spark):
    rng = random.Random(7)
    seqs = {}
    for i in range(0, 24, 2):
        s = "".join(rng.choice(B.BLOSUM_LETTERS) for _ in range(rng.randint(0, 70)))
        seqs[i] = s
        seqs[i + 1] = "".join(c if rng.random() > 0.2 else rng.choice(B.BLOSUM_LETTERS) for c in s if rng.random() > 0.08)
    df = spark.createDataFrame(list(seqs.items()), "id long, seq string")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(0, 23)] + [(1, 0)], "a long, b long")
    got = {(r.id_a, r.id_b): (r.identity, r.score) for r in B.alignment_scores(pairs, "a", "b", df).collect()}
    assert len(got) == 23
    m = B.scoring_matrix()
    for (a, b), (identity, score) in got.items():
        want = align_slowly(seqs[a], seqs[b], m)
        assert score == want[1] and abs(identity - want[0]) < 1e-9


def test_scoring_matrix_is_symmetric_with_positive_diagonal():
    m = B.scoring_matrix()
    assert m.shape == (21, 21) and (m == m.T).all() and (np.diag(m)[:20] >= 4).all()


# --- models --------------------------------------------------------------------


@pytest.fixture(scope="module")
def planted(spark):
    """Tight twins: entity 2i and 2i + 1 are almost the same vector."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 8))
    x = np.repeat(base, 2, axis=0) + rng.normal(size=(120, 8)) * 0.05
    v = vectors(spark, x).withColumn("family", (F.col("id") % 5).cast("string"))
    pos = spark.range(60).selectExpr("id as pair_id", "id * 2 as id_1", "id * 2 + 1 as id_2")
    return v, pos, prepare(pos, v)


def test_forest_beats_chance_by_far(spark, planted):
    from pairlab.operators import evaluate as M

    v, pos, data = planted
    model = C.fit_forest(data.part("train"), numTrees=20)
    scored = C.predict(model, data.part("test"))
    assert M.roc_auc(scored).first()[0] > 0.95
    imp = C.feature_importance(spark, model, [*range(8), "cosine"]).collect()
    assert len(imp) == 9 and min(r["rank"] for r in imp) == 1


def test_rank_by_model_equals_brute_force(spark, planted):
    v, pos, data = planted
    model = C.fit_forest(data.part("train"), numTrees=10)
    q = K.bidirectional_queries(pos.filter("pair_id < 6")).select("pair_id", "query_id", "target_id")
    got = {(r.query_id, r.target_id): r["rank"] for r in C.rank_by_model(model, q, v, block=16).collect()}
    cand = q.select("query_id").distinct().join(v.select("id"), how="cross")
    s = {(r.query_id, r.id): r.score for r in C.score_candidates(model, cand, v).collect()}
    for (a, t), rank in got.items():
        better = [c for c in range(120) if c not in (a, t) and (s[a, c] > s[a, t] or (s[a, c] == s[a, t] and c < t))]
        assert rank == 1 + len(better)
    assert len(got) == 12


def test_bagging_mean_and_spread(spark, planted):
    v, pos, data = planted
    train = data.part("train")
    pos_rows = train.filter("label = 1")
    unl = train.filter("label = 0").select("features", F.explode(F.array(F.lit(0), F.lit(1))).alias("bag"))
    models = C.fit_bags(pos_rows, unl, 2, numTrees=5)
    test = data.part("test").select("id_a", "id_b", "label", "features")
    out = {(r.id_a, r.id_b): (r.score, r.score_std) for r in C.predict_bags(models, test).collect()}
    p = [{(r.id_a, r.id_b): r.score for r in C.predict(m, test).collect()} for m in models]
    for k, (mean, std) in out.items():
        assert abs(mean - np.mean([x[k] for x in p])) < 1e-12 and abs(std - np.std([x[k] for x in p])) < 1e-12


def test_models_survive_a_round_trip(spark, planted, tmp_path):
    from pyspark.ml.classification import RandomForestClassificationModel

    _, _, data = planted
    model = C.fit_forest(data.part("train"), numTrees=5)
    model.write().overwrite().save(str(tmp_path / "rf"))
    back = RandomForestClassificationModel.load(str(tmp_path / "rf"))
    assert C.predict(back, data.part("test")).agg(F.sum("score")).first()[0] == pytest.approx(
        C.predict(model, data.part("test")).agg(F.sum("score")).first()[0]
    )


def test_replication_follows_the_weight(spark):
    df = spark.range(4000).withColumn("w", F.when(F.col("id") < 2000, 2.5).otherwise(0.25))
    out = C.replicate_by_weight(df, "w", ["id"]).groupBy((F.col("id") < 2000).alias("big")).count().collect()
    n = {r.big: r["count"] for r in out}
    assert abs(n[True] - 5000) < 150 and abs(n[False] - 500) < 100


def test_translation_recovers_a_linear_map(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 5))
    w = rng.normal(size=(5, 5))
    y = x @ w
    v = vectors(spark, np.vstack([x, y]))
    directed = spark.range(150).selectExpr("id as input_id", "id + 150 as target_id")
    got = Z.fit_translation(directed, v, ridge=1e-9)
    assert np.allclose(got, w, atol=1e-4)
    q = directed.selectExpr("input_id as query_id", "target_id").limit(20)
    assert {r["rank"] for r in Z.rank_translated(q, v, got).collect()} == {1}


def test_triplet_metrics(spark):
    v = vectors(spark, [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]])
    t = spark.createDataFrame([(0, 1, 2), (0, 2, 1)], "anchor long, positive long, negative long")
    m = H.triplet_metrics(t, v).first()
    assert (m.n, m.accuracy, m.mean_distance) == (2, 0.5, 0.5) and abs(m.loss - (0 + 1.3) / 2) < 1e-12


def test_class_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "label int")
    w = {r.label: (r.b, r.r) for r in C.with_positive_ratio_weight(C.with_balanced_weight(df, out="b"), out="r").collect()}
    assert w == {1: (2.0, 3.0), 0: (4 / 6, 1.0)}


def test_zero_vectors_score_zero(spark):
    v = vectors(spark, [[0.0, 0.0], [1.0, 2.0]])
    pairs = spark.createDataFrame([(0, 1)], "a long, b long")
    assert S.cosine_pairs(pairs, "a", "b", v).first().score == 0.0
    arr = H.abs_diff_features(pairs, "a", "b", v).first().features_array
    assert arr[:2] == [1.0, 2.0] and math.isclose(arr[2], 0.0)

"""Pair classifiers trained on a leakage-safe split, and what is done with their scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.functions.evidence import bucket_weight, evidence_bucket
from pairlab.operators import evaluate as M
from pairlab.operators import features as H
from pairlab.operators import models as C
from pairlab.operators import perceptron as W
from pairlab.operators import ranking as K
from pairlab.operators import resolve as R
from pairlab.operators import sampling as N
from pairlab.operators import similarity as S
from pairlab.operators.rows import canonical_pair
from pairlab.operators import reports as P
from pairlab.operators.graph import connected_components
from pairlab.operators.split import cross_split_drop, split_kfold, split_train_test
from pairlab.plans.crossval import cross_validate
from pairlab.plans.registry import query
from pairlab.plans.retrieval_queries import METRIC_COLS, r6
from pairlab.plans.training import prepare
from pairlab.session import table_by, truncate_lineage
from pairlab.sources import fixtures as X
from pairlab.sources.fixtures import ctes

def planted(spark, sf):
    """Each entity with its nearest neighbour: pairs that the vectors do explain."""
    v = X.vectors(spark, sf)
    near = S.top_neighbors(v.select(F.col("id").alias("query_id")), v, 1)
    pairs = near.select(F.least("query_id", "id").alias("id_1"), F.greatest("query_id", "id").alias("id_2")).distinct()
    family = v.select("id", "family")
    pairs = pairs.join(family.withColumnsRenamed({"id": "id_1", "family": "family_1"}), "id_1")
    pairs = pairs.join(family.withColumnsRenamed({"id": "id_2", "family": "family_2"}), "id_2")
    return pairs.withColumn("pair_id", F.concat_ws("-", "id_1", "id_2"))


def _ready(spark, sf, **options):
    """Prepared rows of the planted pairs."""
    return prepare(truncate_lineage(planted(spark, sf)), X.vectors(spark, sf), **options)


def _scored_test(model, data):
    return C.predict(model, data.part("test").select("id_a", "id_b", "label", "features")).drop("features")


def _test_queries(data):
    q = K.bidirectional_queries(cross_split_drop(data.positives, "id_1", "id_2", data.splits))
    split = data.splits.filter("split = 'test'").select(F.col("id").alias("query_id"))
    return q.join(split, "query_id", "left_semi").select("pair_id", "direction", "query_id", "target_id")


def _metrics(scored):
    counts = M.confusion(scored)
    parts = [counts, M.classification_metrics(counts), M.roc_auc(scored), M.average_precision(scored)]
    long = [p.select(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for p in parts for c in p.columns]
    out = long[0]
    for x in long[1:]:
        out = out.unionByName(x)
    return out


@query(
    "class_weights",
    ctes("scored") + """select id_1, id_2, label, round(count(*) over () / (2.0 * count(*) over (partition by label)), 6) as balanced,
        round(case when label = 1 then (select count(*) filter (label = 0) / count(*) filter (label = 1) from scored) else 1 end, 6) as ratio from scored""",
)
def class_weights(spark, sf):
    rows = X.scored_pairs(spark, sf).select("id_1", "id_2", "label")
    return r6(C.with_positive_ratio_weight(C.with_balanced_weight(rows, out="balanced"), out="ratio"), "balanced", "ratio")


@query("rf_pairs")
def rf_pairs(spark, sf):
    """Held-out metrics of the forest on |a - b| and cosine."""
    data = _ready(spark, sf)
    return _metrics(truncate_lineage(_scored_test(C.fit_forest(data.part("train")), data)))


def _extend(spark, sf):
    v = X.vectors(spark, sf)

    def extend(rows):
        d = S.cosine_pairs(rows, "id_a", "id_b", v, "euclidean", "_near").withColumn("distance", -F.col("_near")).drop("_near")
        near = v.select("id", F.explode(F.array(F.col("id") + 1, F.col("id") + 2)).alias("other")).join(
            v.select(F.col("id").alias("other")), "other", "left_semi"
        )
        listed = S.cosine_pairs(near.select(F.col("id").alias("id_a"), F.col("other").alias("id_b")), "id_a", "id_b", v, out="partial")
        d = R.score_lookup(d, "id_a", "id_b", listed, ["partial"], default=0.0)
        return d

    return extend


@query("rf_pairs_extended")
def rf_pairs_extended(spark, sf):
    """With a distance and a partial score table (missing = 0). The family flag nearly is the label and stays out."""
    data = _ready(spark, sf, extend=_extend(spark, sf), extra=("distance", "partial"))
    return _metrics(truncate_lineage(_scored_test(C.fit_forest(data.part("train")), data)))


@query("rf_pairs_hardneg")
def rf_pairs_hardneg(spark, sf):
    data = _ready(spark, sf, hard=True)
    return _metrics(truncate_lineage(_scored_test(C.fit_forest(data.part("train")), data)))


@query("gbt_pairs")
def gbt_pairs(spark, sf):
    data = _ready(spark, sf)
    return _metrics(truncate_lineage(_scored_test(C.fit_boosted(data.part("train")), data)))


@query("mlp_pairs")
def mlp_pairs(spark, sf):
    """Held-out metrics of the weighted perceptron: scaled features, stratified validation rows, early stop."""
    data = _ready(spark, sf)
    model = W.fit_perceptron(data.part("train"), "class_weight", ["id_a", "id_b"], C.HIDDEN_LAYERS, 40)
    test = data.part("test").select("id_a", "id_b", "label", "features")
    return _metrics(truncate_lineage(W.predict_perceptron(model, test).drop("features")))


@query("mlp_pairs_evidence")
def mlp_pairs_evidence(spark, sf):
    """Class weight times evidence weight, on the pairs that carry evidence; held-out metrics."""
    v, gold = X.vectors(spark, sf), X.gold(spark, sf)
    known = canonical_pair(gold, "id_1", "id_2").select("id_a", "id_b").distinct()
    pos = gold.select(F.col("id_1").alias("id_a"), F.col("id_2").alias("id_b"), F.lit(1).alias("label"), bucket_weight(evidence_bucket("evidence_level")).alias("weight"))
    neg = N.neg_uniform(v, known, {"all": N.NEGATIVES_PER_POSITIVE * gold.count()}).select("id_a", "id_b", F.lit(0).alias("label"), F.lit(1.0).alias("weight"))
    splits = truncate_lineage(split_train_test(connected_components(gold, "id_1", "id_2", v)))
    rows = cross_split_drop(pos.unionByName(neg), "id_a", "id_b", splits)
    rows = truncate_lineage(rows.select("id_a", "id_b", "label", "weight", "split"))
    train = truncate_lineage(H.feature_matrix(C.with_balanced_weight(rows.filter("split = 'train'"), times="weight"), "id_a", "id_b", v))
    model = W.fit_perceptron(train, "class_weight", ["id_a", "id_b"], C.HIDDEN_LAYERS, 40)
    test = H.feature_matrix(rows.filter("split = 'test'"), "id_a", "id_b", v)
    return _metrics(truncate_lineage(W.predict_perceptron(model, test.select("id_a", "id_b", "label", "features")).drop("features")))


def _bags(spark, sf, bags):
    data, v = _ready(spark, sf), X.vectors(spark, sf)
    known = canonical_pair(data.positives, "id_1", "id_2").select("id_a", "id_b").distinct()
    pool = data.splits.filter("split = 'train'").select("id")
    pos = data.part("train").filter("label = 1")
    drawn = N.pu_bags(pool, known, N.NEGATIVES_PER_POSITIVE * pos.count(), bags)
    drawn = truncate_lineage(drawn)
    unlabelled = table_by(H.feature_matrix(drawn, "id_a", "id_b", v), "bag", bags, "id_a", "id_b")
    return data, C.fit_bags(pos, unlabelled, bags)


@query("pu_bagging")
def pu_bagging(spark, sf):
    """Mean and spread of the bagged forests on the held-out pairs (negatives fixed across bags)."""
    data, models = _bags(spark, sf, C.N_BAGS)
    test = data.part("test").select("id_a", "id_b", "label", "features")
    return C.predict_bags(models, test).drop("features")


@query("feature_importance")
def feature_importance(spark, sf):
    data = _ready(spark, sf)
    model = C.fit_forest(data.part("train"))
    dim = model.numFeatures - 1
    return C.feature_importance(spark, model, [*[f"abs_diff_{i}" for i in range(dim)], "cosine"])


@query("score_candidates")
def score_candidates(spark, sf):
    """Model and cosine ranks of the held-out partners among all entities, on the same queries."""
    data, v = _ready(spark, sf), X.vectors(spark, sf)
    q = truncate_lineage(_test_queries(data))
    by_model = C.rank_by_model(C.fit_forest(data.part("train")), q, v)
    by_cosine = S.rank_targets(q, v)
    both = K.hits_mrr(by_model).withColumn("method", F.lit("forest")).unionByName(
        K.hits_mrr(by_cosine).withColumn("method", F.lit("cosine"))
    )
    return r6(both, *METRIC_COLS)


@query("kfold_models")
def kfold_models(spark, sf):
    """Per fold of whole components: a forest fitted without it, and the cosine, ranking all entities for its queries."""
    v = X.vectors(spark, sf)
    positives = truncate_lineage(planted(spark, sf))
    folds = truncate_lineage(split_kfold(connected_components(positives, "id_1", "id_2", v)).select("id", "fold"))
    ranked = cross_validate(positives, v, folds, {"forest": C.fit_forest})
    return r6(P.fold_table(ranked, ["cosine", "forest"]).select("fold", "n_queries", "cosine_mrr", "forest_mrr"), "cosine_mrr", "forest_mrr")

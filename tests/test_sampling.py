import numpy as np
from collections import Counter

from pyspark.sql import functions as F

from pairlab.operators import sampling as N
from pairlab.plans.dataset import build_pair_dataset
from pairlab.sources import fixtures as X

FOLDER = "/root/testdata/sf0.001"


def pool(spark, n, split=None):
    rows = [(i, f"f{i % 4}", "train" if i % 3 else "test") for i in range(n)]
    return spark.createDataFrame(rows, "id long, family string, split string")


def hub_positives(spark, n):
    """Entity 0 is a partner of almost everybody."""
    return spark.createDataFrame([(0, i) for i in range(1, n - 2)], "id_a long, id_b long")


def keys(df):
    return [(r.id_a, r.id_b) for r in df.collect()]


def test_uniform_contract(spark):
    n = 40
    pos = hub_positives(spark, n)
    got = keys(N.neg_uniform(pool(spark, n), pos, {"all": 200}))
    assert len(got) == len(set(got)) == 200
    assert not set(got) & set(keys(pos))
    assert all(a < b for a, b in got)


def test_uniform_takes_everything_from_a_small_pool(spark):
    n = 6
    pos = spark.createDataFrame([(0, 1), (2, 3)], "id_a long, id_b long")
    sample = N.neg_uniform(pool(spark, n), pos, {"all": 100})
    assert len(set(keys(sample))) == 6 * 5 // 2 - 2
    short = N.shortfall(sample, {"all": 100}).first()
    assert (short.wanted, short.found) == (100, 13)


def all_but(spark, n, left):
    """Every pair of n entities is known but ``left`` of them."""
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n)]
    return spark.createDataFrame(pairs[left:], "id_a long, id_b long"), set(pairs[:left])


def test_the_last_unknown_pairs_are_found(spark):
    pos, free = all_but(spark, 100, 10)
    assert set(keys(N.neg_uniform(pool(spark, 100), pos, {"all": 10}))) == free
    some = keys(N.neg_uniform(pool(spark, 100), pos, {"all": 3}))
    assert len(set(some)) == 3 and set(some) < free


def test_a_short_round_goes_on(spark, monkeypatch):
    whole = keys(N.neg_uniform(pool(spark, 50), hub_positives(spark, 50), {"all": 100}))
    monkeypatch.setattr(N, "draws_needed", lambda pool, n, known: 7)
    assert sorted(keys(N.neg_uniform(pool(spark, 50), hub_positives(spark, 50), {"all": 100}))) == sorted(whole)


def test_hard_negatives_are_complete(spark):
    n = 100  # 4 families of 25: 3,750 valid pairs
    none = spark.createDataFrame([], "id_a long, id_b long")
    v = pool(spark, n).select("id", F.array(F.sin("id"), F.cos("id"), F.lit(0.1)).alias("v"))
    for vectors, want in ((v, 300), (v, 1000), (v, 2000), (None, 1000), (None, 3700), (None, 9999)):
        got = N.neg_hard(pool(spark, n), none, {"all": want}, vectors).collect()
        assert len({(r.id_a, r.id_b) for r in got}) == len(got) == min(want, 3750)
        assert all(r.id_a % 4 != r.id_b % 4 for r in got)


def test_bags_of_a_nearly_known_pool(spark):
    pos, free = all_but(spark, 40, 12)
    got = N.pu_bags(pool(spark, 40), pos, 9, 3).collect()
    assert Counter(r.bag for r in got) == {0: 9, 1: 9, 2: 9}
    assert {(r.id_a, r.id_b) for r in got} <= free


def test_uniform_stays_inside_the_split(spark):
    p = pool(spark, 60)
    where = {r.id: r.split for r in p.collect()}
    got = N.neg_uniform(p, hub_positives(spark, 60), {"train": 90, "test": 40}, group="split").collect()
    assert Counter(r.grp for r in got) == {"train": 90, "test": 40}
    assert all(where[r.id_a] == where[r.id_b] == r.grp for r in got)


def test_mixed_counts_and_families(spark):
    p = pool(spark, 60)
    v = p.select("id", F.array(F.sin("id"), F.cos("id"), F.lit(0.1)).alias("v"))
    fam = {r.id: r.family for r in p.collect()}
    pos = hub_positives(spark, 60)
    got = N.neg_mixed(p, pos, {"train": 101, "test": 31}, v, group="split").collect()
    kinds = Counter((r.grp, r.pair_type) for r in got)
    assert kinds[("train", "hard_cross_family_geometric")] == 30 and kinds[("train", "easy_random")] == 71
    assert kinds[("test", "hard_cross_family_geometric")] == 9 and kinds[("test", "easy_random")] == 22
    assert len({(r.id_a, r.id_b) for r in got}) == len(got)
    assert all(fam[r.id_a] != fam[r.id_b] for r in got if r.pair_type.startswith("hard"))
    assert not {(r.id_a, r.id_b) for r in got} & set(keys(pos))


def test_mixed_without_known_families_is_all_easy(spark):
    p = pool(spark, 30).withColumn("family", F.lit(None).cast("string"))
    got = N.neg_mixed(p, hub_positives(spark, 30), {"all": 50}, None).collect()
    assert Counter(r.pair_type for r in got) == {"easy_random": 50}


def test_triplet_of_a_hub_anchor_is_exact(spark):
    n = 50
    pos = hub_positives(spark, n)  # 0 has two strangers left: 48 and 49
    directed = spark.createDataFrame([(i, 0, i) for i in range(1, n - 2)] + [(i, i, 0) for i in range(1, n - 2)], "pair_id long, anchor long, positive long")
    got = N.triplet_random(directed, pool(spark, n), pos).collect()
    assert len(got) == directed.count()
    assert {r.negative for r in got if r.anchor == 0} == {48, 49}
    assert all(r.negative not in (r.anchor, r.positive) for r in got)
    spread = Counter(r.negative for r in got if r.anchor != 0)
    assert len(spread) > 20


def test_triplet_hard_kinds(spark):
    p = pool(spark, 40).withColumn("family", F.when(F.col("id") == 5, None).otherwise(F.col("family")))
    v = p.select("id", F.array(F.sin("id"), F.cos("id")).alias("v"))
    pos = spark.createDataFrame([(1, 2), (5, 6)], "id_a long, id_b long")
    directed = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (2, 5, 6), (2, 6, 5)], "pair_id long, anchor long, positive long")
    got = {r.anchor: r for r in N.triplet_hard(directed, p, pos, v).collect()}
    fam = {r.id: r.family for r in p.collect()}
    assert len(got) == 4 and got[5].kind == "fallback_random"
    for a in (1, 2, 6):
        assert got[a].kind == "hard_cross_family_geometric" and fam[got[a].negative] != fam[a]


def test_bags_are_different_and_complete(spark):
    got = N.pu_bags(pool(spark, 80), hub_positives(spark, 80), 60, 4).collect()
    per = {}
    for r in got:
        per.setdefault(r.bag, set()).add((r.id_a, r.id_b))
    assert {b: len(s) for b, s in per.items()} == {0: 60, 1: 60, 2: 60, 3: 60}
    assert per[0] != per[1]


def test_candidates_never_hit_query_or_target(spark):
    q = spark.createDataFrame([("a", 0, 1), ("b", 5, 2)], "key string, query_id long, target_id long")
    got = N.sampled_candidates(q, pool(spark, 7), 200).collect()
    assert len(got) == 400
    assert all(r.id not in (r.query_id, r.target_id) for r in got)
    assert {r.id for r in got if r.key == "a"} == {2, 3, 4, 5, 6}


def test_sampling_does_not_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = set()
    try:
        for n in (1, 7, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            p = pool(spark, 60).repartition(n)
            v = p.select("id", F.array(F.sin("id"), F.cos("id")).alias("v"))
            rows = N.neg_mixed(p, hub_positives(spark, 60), {"train": 60}, v, group="split").collect()
            seen.add(tuple(sorted((r.id_a, r.id_b, r.pair_type) for r in rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


def test_pair_dataset_contract(spark):
    v, gold, doc = X.vectors(spark, FOLDER), X.gold(spark, FOLDER), X.documented_negatives(spark, FOLDER)
    rows = build_pair_dataset(v, gold, doc).collect()
    pos = {frozenset((r.id_1, r.id_2)) for r in rows if r.label == 1}
    neg = [frozenset((r.id_1, r.id_2)) for r in rows if r.pair_type in ("easy_random", "hard_cross_family_geometric")]
    assert not pos & set(neg) and len(neg) == len(set(neg))
    side = {}
    for r in rows:
        for x in (r.id_1, r.id_2):
            assert side.setdefault(x, r.split) == r.split
    for s in ("train", "val", "test"):
        n_pos = sum(r.label == 1 and r.split == s for r in rows)
        n_doc = sum(r.pair_type == "negative_documented" and r.split == s for r in rows)
        mined = sum(r.split == s and r.label == 0 for r in rows) - n_doc
        assert n_pos > 0 and mined == max(0, round(5.0 * n_pos) - n_doc)
    assert all(r.weight == 1.0 for r in rows if r.label == 0)


def test_sampled_candidates_are_ranked_without_a_vector_each(spark, monkeypatch):
    from pairlab.operators import sampling

    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 4))
    v = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "id long, v array<double>")
    q = spark.range(0, 20).selectExpr("cast(id as string) as key", "id as query_id", "id + 7 as target_id")
    joined = []
    scored = sampling.cosine_pairs
    monkeypatch.setattr(sampling, "cosine_pairs", lambda *a, **k: joined.append(a[2]) or scored(*a, **k))
    got = {r.key: r["rank"] for r in sampling.rank_sampled(q, v, 40).collect()}
    assert joined == ["target_id"]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ u.T, 12)
    want = {str(i): 1 for i in range(20)}
    for r in sampling.sampled_candidates(q, v, 40).collect():
        want[r.key] += int(s[r.query_id, r.id] > s[r.query_id, r.target_id])
    assert got == want

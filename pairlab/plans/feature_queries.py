"""Features, k-mers, tokens, projections, alignment, triplet metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.functions import text as T
from pairlab.operators import alignment as A
from pairlab.operators import features as H
from pairlab.operators import ranking as K
from pairlab.operators import reports as P
from pairlab.operators import sampling as N
from pairlab.operators import similarity as S
from pairlab.operators import sparse as Y
from pairlab.operators import tokens as U
from pairlab.operators import translation as Z
from pairlab.operators.rows import canonical_pair
from pairlab.operators.split import cross_split_drop, split_loco
from pairlab.plans.catalogue_queries import VALID_SQL
from pairlab.plans.registry import query
from pairlab.plans.retrieval import evaluate
from pairlab.plans.retrieval_queries import METRIC_COLS, components, r6, splits
from pairlab.plans.sampling_queries import NUM_SQL, TRIPLET_SQL, _directed
from pairlab.session import truncate_lineage
from pairlab.sources import fixtures as X
from pairlab.sources import readers
from pairlab.sources.fixtures import ctes

LONG = "select pair_id, cast(dim - 1 as integer) as dim, round(x, 6) as value from (select pair_id, generate_subscripts(f, 1) as dim, unnest(f) as x from feat)"
FEAT = """feat as (select pair_id, list_append(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2])),
    list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-12)) as f
    from gold join vectors a on a.id = id_1 join vectors b on b.id = id_2)"""


@query("abs_diff_features", ctes("gold", "vectors", extra=FEAT) + LONG)
def abs_diff_features(spark, sf):
    f = H.abs_diff_features(X.gold(spark, sf).select("pair_id", "id_1", "id_2"), "id_1", "id_2", X.vectors(spark, sf))
    return f.select("pair_id", F.posexplode("features_array").alias("dim", "x")).select("pair_id", "dim", F.round("x", 6).alias("value"))


@query(
    "feature_matrix",
    ctes("gold", "vectors", "documented", extra="""lab as (select id_1, id_2, 1 as label, cast(1 as double) as weight from gold union all select id_1, id_2, 0, 1.0 from documented)""")
    + """select id_1, id_2, label, weight, len(a.v) + 1 as n_features, round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2])))
        + list_cosine_similarity(a.v, b.v), 6) as total from lab join vectors a on a.id = id_1 join vectors b on b.id = id_2""",
)
def feature_matrix(spark, sf):
    pos = X.gold(spark, sf).select("id_1", "id_2", F.lit(1).alias("label"))
    lab = pos.unionByName(X.documented_negatives(spark, sf).select("id_1", "id_2", F.lit(0).alias("label"))).withColumn("weight", F.lit(1.0))
    m = H.feature_matrix(lab, "id_1", "id_2", X.vectors(spark, sf))
    from pyspark.ml.functions import vector_to_array

    arr = vector_to_array("features")
    total = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    return m.select("id_1", "id_2", "label", "weight", F.size(arr).cast("bigint").alias("n_features"), F.round(total, 6).alias("total"))


@query(
    "extended_features",
    ctes("gold", "vectors") + """select pair_id, len(a.v) + 3 as n_features, round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2])))
        + list_cosine_similarity(a.v, b.v) + list_distance(a.v, b.v) + case when a.family = b.family then 1 else 0 end, 6) as total
        from gold join vectors a on a.id = id_1 join vectors b on b.id = id_2""",
)
def extended_features(spark, sf):
    from pyspark.ml.functions import vector_to_array

    v = X.vectors(spark, sf)
    pairs = S.cosine_pairs(X.gold(spark, sf), "id_1", "id_2", v, "euclidean", "near")
    pairs = pairs.withColumns({"distance": -F.col("near"), "same_family": H.same_family_flag("family_1", "family_2")})
    m = H.feature_matrix(pairs, "id_1", "id_2", v, ["distance", "same_family"])
    arr = vector_to_array("features")
    total = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    return m.select("pair_id", F.size(arr).cast("bigint").alias("n_features"), F.round(total, 6).alias("total"))


@query(
    "same_family_flag",
    ctes("raw_pairs") + "select pair_id, cast(case when family_1 = family_2 then 1 else 0 end as double) as same_family from raw_pairs",
)
def same_family_flag(spark, sf):
    return X.raw_pairs(spark, sf).select("pair_id", H.same_family_flag("family_1", "family_2").alias("same_family"))


KMER_SQL = """words as (select id, unnest(list_transform(range(1, greatest(len(seq) - 1, 1)), lambda i: substr(seq, i, 3))) as kmer from sequences),
    okay as (select id, kmer from words where regexp_full_match(kmer, '[ACDEFGHIKLMNPQRSTVWY]{3}')),
    prof as (select id, kmer, count(*) / sum(count(*)) over (partition by id) as freq from okay group by id, kmer),
    norms as (select id, sqrt(sum(freq * freq)) as norm from prof group by id)"""


@query("kmer_profile", ctes("sequences", extra=KMER_SQL) + "select id, kmer, round(freq, 6) as freq from prof")
def kmer_profile(spark, sf):
    return r6(H.kmer_profile(X.sequences(spark, sf)), "freq")


KMER_ALIKE = 0.95


@query(
    "kmer_cosine",
    ctes("sequences", extra=KMER_SQL) + f""", dots as (select x.id as id_1, y.id as id_2, sum(x.freq * y.freq) as d from prof x join prof y on x.kmer = y.kmer and x.id < y.id group by all),
        sims as (select id_1, id_2, d / (a.norm * b.norm) as s from dots join norms a on a.id = id_1 join norms b on b.id = id_2)
        select id_1, id_2, round(s, 6) as kmer_cosine from sims where round(s, 12) >= {KMER_ALIKE}""",
)
def kmer_cosine(spark, sf):
    """All pairs of texts whose k-mer profiles have a cosine of at least 0.95."""
    found = Y.sparse_pairs(H.kmer_vectors(X.sequences(spark, sf)), KMER_ALIKE, H.KMER_WIDTH)
    return found.select("id_1", "id_2", F.round("score", 6).alias("kmer_cosine"))


@query(
    "kmer_cosine_listed",
    ctes("sequences", extra=KMER_SQL) + """, pairs as (select a.id as id_1, b.id as id_2 from sequences a join sequences b on b.id = a.id + 1),
        dots as (select p.id_1, p.id_2, sum(x.freq * y.freq) as d from pairs p join prof x on x.id = p.id_1 join prof y on y.id = p.id_2 and y.kmer = x.kmer group by all)
        select p.id_1, p.id_2, round(coalesce(d / (a.norm * b.norm), 0), 6) as kmer_cosine from pairs p left join dots d using (id_1, id_2)
        left join norms a on a.id = p.id_1 left join norms b on b.id = p.id_2""",
)
def kmer_cosine_listed(spark, sf):
    """Profiles of listed pairs: every text and the next one."""
    seqs = X.sequences(spark, sf)
    pairs = seqs.select(F.col("id").alias("id_1"), (F.col("id") + 1).alias("id_2")).join(seqs.select(F.col("id").alias("id_2")), "id_2", "left_semi")
    out = H.kmer_cosine(pairs, "id_1", "id_2", truncate_lineage(H.kmer_vectors(seqs)))
    return r6(out.select("id_1", "id_2", "kmer_cosine"), "kmer_cosine")


@query(
    "kmer_neighbors",
    ctes("sequences", extra=KMER_SQL) + """, dots as (select x.id as a, y.id as b, sum(x.freq * y.freq) as d from prof x join prof y on x.kmer = y.kmer and x.id <> y.id group by all),
        sims as (select a, b, round(d / (x.norm * y.norm), 9) as s from dots join norms x on x.id = a join norms y on y.id = b)
        select a as query_id, rank, round(s, 5) as score from (select *, row_number() over (partition by a order by s desc, b) as rank from sims) where rank <= 3""",
)
def kmer_neighbors(spark, sf):
    """Nearest texts by k-mer profile among all texts (ties differ only in the neighbour's id)."""
    top = Y.sparse_neighbors(H.kmer_vectors(X.sequences(spark, sf)), 3, H.KMER_WIDTH)
    return top.select("query_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 5).alias("score"))


_TOPS = ", ".join(f"round(avg(s) filter (rn <= {k}), 9) as t{k}" for k in H.TOKEN_TOP_K)
TOKEN_SQL = f"""cos as (select x.id as qid, y.id as cid, list_cosine_similarity(x.v, y.v) as s from tokens x join tokens y on x.id <> y.id),
    numbered as (select *, row_number() over (partition by qid, cid order by s desc) as rn from cos),
    tops as (select qid, cid, {_TOPS} from numbered group by all)"""


@query(
    "token_topk_similarity",
    ctes("tokens", extra=TOKEN_SQL) + "select t.qid as query_id, t.cid as target_id, "
    + ", ".join(f"round(t.t{k}, 6) as top_{k}, 1 + count(*) filter (c.t{k} > t.t{k} or (c.t{k} = t.t{k} and c.cid < t.cid)) as rank_{k}" for k in H.TOKEN_TOP_K)
    + " from tops t join tops c on c.qid = t.qid and c.cid <> t.cid where abs(t.qid - t.cid) = 1 group by t.qid, t.cid, t.t5, t.t15, t.t30",
)
def token_topk_similarity(spark, sf):
    """The neighbours of every entity among all entities by the mean of the best 5, 15 and 30 token cosines."""
    t = X.token_vectors(spark, sf)
    ids = t.select("id").distinct()
    q = ids.select(F.col("id").alias("query_id"), F.explode(F.array(F.col("id") - 1, F.col("id") + 1)).alias("target_id"))
    return r6(U.rank_by_tokens(q, t), *[f"top_{k}" for k in H.TOKEN_TOP_K])


@query(
    "token_topk_listed",
    ctes("tokens", extra=TOKEN_SQL) + "select qid as id_1, cid as id_2, " + ", ".join(f"round(t{k}, 6) as top_{k}" for k in H.TOKEN_TOP_K) + " from tops where cid = qid + 1",
)
def token_topk_listed(spark, sf):
    """Token similarity of listed pairs: every entity and the next one."""
    t = X.token_vectors(spark, sf)
    ids = t.select("id").distinct()
    pairs = ids.select(F.col("id").alias("id_1"), (F.col("id") + 1).alias("id_2")).join(ids.withColumnRenamed("id", "id_2"), "id_2", "left_semi")
    return r6(H.token_topk_similarity(pairs, "id_1", "id_2", t).select("id_1", "id_2", "top_5", "top_15", "top_30"), "top_5", "top_15", "top_30")


@query(
    "standardize_train",
    ctes("vectors", "gold") + """, tr as (select * from vectors where id in (select id_1 from gold union select id_2 from gold)),
        st as (select dim, avg(x) as m, case when stddev_pop(x) < 1e-8 then 1 else stddev_pop(x) end as s
            from (select generate_subscripts(v, 1) as dim, unnest(v) as x from tr) group by dim)
        select id, cast(dim - 1 as integer) as dim, round((x - m) / s, 5) as value from (select id, generate_subscripts(v, 1) as dim, unnest(v) as x from vectors) join st using (dim)""",
)
def standardize_train(spark, sf):
    """Fitted on the entities that have a pair, applied to all."""
    v, gold = X.vectors(spark, sf), X.gold(spark, sf)
    ends = gold.select(F.explode(F.array("id_1", "id_2")).alias("id")).distinct()
    out = H.scale(v, H.fit_scaler(v.join(ends, "id", "left_semi")))
    return out.select("id", F.posexplode("v").alias("dim", "x")).select("id", "dim", F.round("x", 5).alias("value"))


@query(
    "pca_project",
    ctes("vectors") + """, c as (select dim, avg(x) as m from (select generate_subscripts(v, 1) as dim, unnest(v) as x from vectors) group by dim)
        select id, round(sqrt(sum((x - m) * (x - m))), 5) as distance_from_mean from (select id, generate_subscripts(v, 1) as dim, unnest(v) as x from vectors) join c using (dim) group by id""",
)
def pca_project(spark, sf):
    """All components kept: a rotation, so the distance from the mean must not change."""
    v = X.vectors(spark, sf)
    out, _ = H.pca_project(v, len(v.first()["v"]))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return out.select("id", F.round(norm, 5).alias("distance_from_mean"))


@query("pca_euclidean_retrieval")
def pca_euclidean_retrieval(spark, sf):
    """Euclidean ranks on 32 principal components."""
    v, share = H.pca_project(X.vectors(spark, sf), 32)
    return evaluate(X.gold(spark, sf), v, "euclidean").withColumn("explained_variance", F.lit(share))


@query("pca_2d")
def pca_2d(spark, sf):
    return H.pca_2d(X.vectors(spark, sf))


@query(
    "identity_mse",
    ctes("vectors", "gold") + """select count(*) as n, round(avg(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / len(a.v)), 6) as mse
        from gold join vectors a on a.id = id_1 join vectors b on b.id = id_2""",
)
def identity_mse(spark, sf):
    return r6(H.identity_mse(X.gold(spark, sf), "id_1", "id_2", X.vectors(spark, sf)), "mse")


@query(
    "triplet_metrics",
    ctes("vectors", "gold", extra=f"{NUM_SQL}, {TRIPLET_SQL}") + """select count(*) as n, round(avg(greatest(dp - dn + 0.3, 0)), 6) as loss,
        round(avg(cast(dp < dn as int)), 6) as accuracy, round(avg(dp), 6) as mean_distance from
        (select 1 - list_cosine_similarity(a.v, p.v) as dp, 1 - list_cosine_similarity(a.v, n.v) as dn from rnd
         join vectors a on a.id = anchor join vectors p on p.id = positive join vectors n on n.id = negative)""",
)
def triplet_metrics(spark, sf):
    gold, v = X.gold(spark, sf), X.vectors(spark, sf)
    known = canonical_pair(gold, "id_1", "id_2").select("id_a", "id_b").distinct()
    t = N.triplet_random(_directed(gold), v, known)
    return r6(H.triplet_metrics(t, v), "loss", "accuracy", "mean_distance")


@query(
    "all_pairs",
    ctes("vectors") + """select a.id, count(*) as n_pairs, round(avg(list_cosine_similarity(a.v, b.v)), 6) as mean_cosine, round(max(list_cosine_similarity(a.v, b.v)), 6) as max_cosine
        from vectors a join vectors b on a.id <> b.id group by a.id""",
)
def all_pairs(spark, sf):
    """Every pair of entities, reduced per entity: pairs, mean and maximum cosine.

    No pair is materialised: the mean over all partners follows from the sum of
    the unit vectors, the maximum is an exact nearest-neighbour search.
    """
    v = X.vectors(spark, sf)
    mean = S.mean_cosine_per_entity(v)
    top = S.top_neighbors(v.select(F.col("id").alias("query_id")), v, 1).select(F.col("query_id").alias("id"), F.col("score").alias("max_cosine"))
    return r6(mean.join(top, "id"), "mean_cosine", "max_cosine")


def _turns(spark, sf):
    c = readers.read_table(spark, sf, "conversations")
    key = lambda turn: F.struct("conv_id", turn.alias("turn"))
    seqs = c.select(key(F.col("turn")).alias("id"), T.valid_residues("text").alias("seq"))
    ids = seqs.select(F.col("id").alias("b"))
    pairs = c.select(key(F.col("turn")).alias("a"), key(F.col("turn") + 1).alias("b")).join(ids, "b", "left_semi")
    return seqs, pairs.select("a", "b")


@query("alignment_scores")
def alignment_scores(spark, sf):
    """Consecutive turns of every conversation, whole texts."""
    seqs, pairs = _turns(spark, sf)
    found = A.alignment_scores(pairs, "a", "b", seqs)
    return found.select("id_a.conv_id", F.col("id_a.turn").alias("turn"), "identity", "score")


_DIAGONAL = " + ".join(
    f"{A.scoring_matrix()[i, i]} * (length(seq) - length(replace(seq, '{c}', '')))" for i, c in enumerate(A.BLOSUM_LETTERS)
)


@query(
    "alignment_self",
    f"""select conv_id, turn, case when seq = '' then 0.0 else 100.0 end as identity, cast({_DIAGONAL} as double) as score
        from (select conv_id, turn, {VALID_SQL.format(c='text')} as seq from conversations)""",
)
def alignment_self(spark, sf):
    """Every turn against its own copy: all columns identical, the score is the sum of the diagonal."""
    c = readers.read_table(spark, sf, "conversations")
    both = c.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    seqs = both.select(F.struct("conv_id", "turn", "side").alias("id"), T.valid_residues("text").alias("seq"))
    pairs = c.select(F.struct("conv_id", "turn", F.lit(0).alias("side")).alias("a"), F.struct("conv_id", "turn", F.lit(1).alias("side")).alias("b"))
    found = A.alignment_scores(pairs, "a", "b", seqs)
    return found.select("id_a.conv_id", "id_a.turn", "identity", "score")


def _alignment_sql() -> str:
    """Row by row dynamic programming over table ``seqs`` (id, a, b): ``best`` packs score, identical and all columns as the operator does."""
    n = len(A.BLOSUM_LETTERS)
    m = A.scoring_matrix()[:n, :n] * A.SCORE
    rows = ",".join("[" + ",".join(str(int(x) + (A.IDENTICAL if i == j else 0) + A.COLUMN) for j, x in enumerate(row)) + "]" for i, row in enumerate(m))
    open_, extend, none = A.OPEN_GAP * A.SCORE + A.COLUMN, A.EXTEND_GAP * A.SCORE + A.COLUMN, f"({-(1 << 62)})::bigint"
    gap = f"greatest(acc.h[-1] + {open_}, acc.e + {extend})"
    code = lambda c: f"list_transform(string_split({c}, ''), lambda x: position(x in '{A.BLOSUM_LETTERS}'))"
    return f"""s as (select id, {code("a")} as ca, {code("b")} as cb from seqs where a <> '' and b <> ''),
    dp as (select id, 0 as i, list_transform(range(len(cb) + 1), lambda j: 0::bigint) as h, list_transform(range(len(cb) + 1), lambda j: {none}) as f, 0::bigint as best from s
        union all select id, i, h, f, greatest(best, list_max(h)) from (
        select id, i, f, best, list_reduce(list_prepend({{'h': [0::bigint], 'e': {none}}}, t), lambda acc, x: {{
            'h': list_append(acc.h, case when greatest(x.e, {gap}) < {A.SCORE} then 0 else greatest(x.e, {gap}) end), 'e': {gap}}}).h as h from (
        select id, i, best, f, list_transform(range(1, len(cb) + 1), lambda j: {{'h': [0::bigint], 'e': greatest(h[j] + m[ca[i]][cb[j]], f[j + 1])}}) as t from (
        select dp.id, dp.i + 1 as i, h, best, ca, cb, m,
            list_prepend({none}, list_transform(range(1, len(cb) + 1), lambda j: greatest(h[j + 1] + {open_}, dp.f[j + 1] + {extend}))) as f
        from dp join s using (id), (select [{rows}] as m) where dp.i < len(ca)))))"""


@query(
    "alignment_parts",
    f"""with recursive seqs as (select p_partkey as id, {VALID_SQL.format(c="p_name")} as a, {VALID_SQL.format(c="p_type")} as b from part), {_alignment_sql()},
        top as (select id, max(best) as best from dp group by 1)
        select id, coalesce(round(case when best % {A.IDENTICAL} > 0 then 100.0 * (best // {A.IDENTICAL} % {A.IDENTICAL}) / (best % {A.IDENTICAL}) else 0 end, 6), 0) as identity,
            coalesce(cast(best // {A.SCORE} as double), 0) as score from seqs left join top using (id)""",
)
def alignment_parts(spark, sf):
    """Name against type of every part; texts without a residue score 0."""
    p = readers.read_table(spark, sf, "part")
    side = lambda k: F.struct("p_partkey", F.lit(k).alias("side"))
    seqs = p.select(F.explode(F.array(*[F.struct(side(k).alias("id"), T.valid_residues(c).alias("seq")) for k, c in enumerate(("p_name", "p_type"))])).alias("s")).select("s.*")
    found = A.alignment_scores(p.select(side(0).alias("a"), side(1).alias("b")), "a", "b", seqs)
    return found.select(F.col("id_a.p_partkey").alias("id"), F.round("identity", 6).alias("identity"), "score")


@query("alignment_summary")
def alignment_summary(spark, sf):
    seqs, pairs = _turns(spark, sf)
    return A.score_summary(A.alignment_scores(pairs, "a", "b", seqs), "identity")


@query("embedding_translation")
def embedding_translation(spark, sf):
    """Ridge map fitted on the train components; the held-out pairs rank their partner by cosine to the predicted vector."""
    gold, v = X.gold(spark, sf), X.vectors(spark, sf)
    sp = truncate_lineage(splits(spark, sf))
    train, test = (cross_split_drop(gold, "id_1", "id_2", sp).filter(F.col("split") == k).drop("split") for k in ("train", "test"))
    w = Z.fit_translation(K.directed_examples(train), v)
    return r6(K.hits_mrr(Z.rank_translated(K.bidirectional_queries(test), v, w)), *METRIC_COLS)


@query("loco_translated")
def loco_translated(spark, sf):
    """Leave-one-component-out: cosine against the map that was fitted without the query's component, over all folds."""
    gold, v = X.gold(spark, sf), X.vectors(spark, sf)
    folds = truncate_lineage(split_loco(components(spark, sf)).select("id", "fold"))
    q = truncate_lineage(K.bidirectional_queries(gold).select("pair_id", "direction", "query_id", "target_id"))
    keys = ["pair_id", "direction", "query_id", "target_id"]
    by_map = Z.rank_left_out(q, v, K.directed_examples(gold), folds).select(*keys, F.col("rank").alias("translated_rank"))
    both = S.rank_targets(q, v).select(*keys, F.col("rank").alias("cosine_rank")).join(by_map, keys)
    out = P.loco_compare(both.join(folds.withColumnRenamed("id", "query_id"), "query_id"), "cosine", "translated")
    return r6(out, *[c for c in out.columns if c not in ("n_folds", "n_queries", "wins", "verdict")])

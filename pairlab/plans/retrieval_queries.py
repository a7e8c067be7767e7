"""Graph, splits, ranks, fusion, metrics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.operators import evaluate as M
from pairlab.operators import fusion as J
from pairlab.operators import graph as G
from pairlab.operators import ranking as K
from pairlab.operators import reports as P
from pairlab.operators import resolve as R
from pairlab.operators import similarity as S
from pairlab.operators import split as L
from pairlab.plans.registry import query
from pairlab.plans.retrieval import evaluate, ranked_queries, weighted
from pairlab.session import scratch_path, truncate_lineage
from pairlab.sources import fixtures as X
from pairlab.sources import readers, writers
from pairlab.sources.fixtures import ctes


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


# --- shared SQL ----------------------------------------------------------------

Q_SQL = """q as (select pair_id, id_1 as query_id, id_2 as target_id, family_1 as query_family, family_2 as target_family, 1 as direction from gold
    union all select pair_id, id_2, id_1, family_2, family_1, 2 from gold)"""
COS_SQL = """s as (select a.id as qid, b.id as cid, round(list_cosine_similarity(a.v, b.v), 12) as s from vectors a, vectors b where a.id <> b.id)"""
W_SQL = """w as (select id, list_transform(v, lambda x, i: x * i) as v from vectors),
    sw as (select a.id as qid, b.id as cid, round(-list_distance(a.v, b.v), 12) as s from w a, w b where a.id <> b.id)"""


def rank_sql(name: str, scores: str) -> str:
    return f"""{name} as (select q.pair_id, q.direction, q.query_id, q.target_id, q.query_family, t.s as score,
        1 + count(*) filter (c.s > t.s or (c.s = t.s and c.cid < q.target_id)) as rank
        from q join {scores} t on t.qid = q.query_id and t.cid = q.target_id join {scores} c on c.qid = q.query_id and c.cid <> q.target_id
        group by all)"""


RANKS = f"{Q_SQL}, {COS_SQL}, {rank_sql('r', 's')}"
BOTH_RANKS = f"{RANKS}, {W_SQL}, {rank_sql('rw', 'sw')}"
METRICS = """count(*) as n_queries, round(avg(1.0 / rank), 6) as mrr, round(avg(rank), 6) as mean_rank,
    round(avg(cast(rank <= 1 as int)), 6) as hits_at_1, round(avg(cast(rank <= 5 as int)), 6) as hits_at_5,
    round(avg(cast(rank <= 10 as int)), 6) as hits_at_10, round(avg(cast(rank <= 20 as int)), 6) as hits_at_20"""
METRIC_COLS = ["mrr", "mean_rank", "hits_at_1", "hits_at_5", "hits_at_10", "hits_at_20"]

CC_SQL = """und as (select id_1 as a, id_2 as b from gold union all select id_2, id_1 from gold),
    cc(id, component) using key (id) as (select id, id from vectors union
        select e.a, min(c.component) from und e join cc c on c.id = e.b join recurring.cc r on r.id = e.a
        where c.component < r.component group by e.a),
    sizes as (select component, count(*) as size from cc group by 1)"""
SPLIT_SQL = CC_SQL + """, run as (select component, size, sum(size) over (order by md5('42|component|' || component)) as run,
        (select round_even(sum(size) * cast(0.2 as double), 0) from sizes where size > 1) as target from sizes where size > 1),
    free as (select component, row_number() over (order by md5('42|free|' || component)) as idx,
        (select round_even(count(*) * cast(0.2 as double), 0) from sizes where size = 1) as n_test from sizes where size = 1),
    placed as (select component, case when run - size < target then 'test' else 'train' end as split from run
        union all select component, case when idx <= n_test then 'test' else 'train' end from free),
    sp as (select id, component, split from cc join placed using (component))"""


def components(spark, sf):
    return G.connected_components(X.gold(spark, sf), "id_1", "id_2", X.vectors(spark, sf))


def splits(spark, sf):
    return L.split_train_test(components(spark, sf))


# --- graph ---------------------------------------------------------------------


@query("connected_components", ctes("gold", "vectors", extra=CC_SQL) + "select id, component from cc")
def connected_components(spark, sf):
    return components(spark, sf)


@query(
    "connected_components_orders",
    """with recursive e as (select distinct -1 - l_orderkey as a, l_partkey as b from lineitem), und as (select a, b from e union all select b, a from e),
        cc(id, component) using key (id) as (select distinct a, a from und union
            select u.a, min(c.component) from und u join cc c on c.id = u.b join recurring.cc r on r.id = u.a
            where c.component < r.component group by u.a)
        select component, count(*) as size from cc group by 1""",
)
def connected_components_orders(spark, sf):
    """Orders and parts as one graph: a giant component and a tail."""
    li = readers.read_table(spark, sf, "lineitem").select((-1 - F.col("l_orderkey")).alias("a"), F.col("l_partkey").alias("b"))
    return G.component_sizes(G.connected_components(li, "a", "b"))


@query("component_sizes", ctes("gold", "vectors", extra=CC_SQL) + "select component, size from sizes")
def component_sizes(spark, sf):
    return G.component_sizes(components(spark, sf))


@query(
    "component_report",
    ctes("gold", "vectors", extra=CC_SQL) + """select count(*) as n_components, count(*) filter (size > 1) as n_multi,
        count(*) filter (size = 1) as n_singletons, max(size) as largest from sizes""",
)
def component_report(spark, sf):
    return G.component_report(components(spark, sf))


# --- splits --------------------------------------------------------------------


@query("split_train_test", ctes("gold", "vectors", extra=SPLIT_SQL) + "select id, component, split from sp")
def split_train_test(spark, sf):
    return splits(spark, sf)


def _greedy(name: str, where: str, targets: list[str]) -> str:
    k = len(targets)
    f = [f"f{i}" for i in range(k)]
    d = [f"({t}) * (select cast(sum(size) as double) from sizes where {where}) - g.f{i}" for i, t in enumerate(targets)]
    pick = "case " + " ".join(
        f"when {' and '.join(f'{d[i]} >= {d[j]}' for j in range(i + 1, k))} then {i}" if i < k - 1 else "" for i in range(k)
    ) + f" else {k - 1} end"
    # first maximum: bin i wins when it is not below any later bin and earlier ones have lost
    return f"""{name}_items as (select size, row_number() over (order by size desc) as rn from sizes where {where}),
        {name}(rn, size, choice, {', '.join(f)}) as (select cast(0 as bigint), cast(0 as bigint), -1, {', '.join('cast(0 as bigint)' for _ in f)}
        union all select rn, size, choice, {', '.join(f'{c} + case when choice = {i} then size else 0 end' for i, c in enumerate(f))} from (
            select i.rn, i.size, {pick} as choice, {', '.join(f'g.{c}' for c in f)} from {name} g join {name}_items i on i.rn = g.rn + 1))"""


_THREE = ["cast(0.7 as double)", "cast(0.15 as double)", "cast(1 as double) - cast(0.7 as double) - cast(0.15 as double)"]


@query(
    "split_three_way",
    ctes("gold", "vectors", extra=f"{CC_SQL}, {_greedy('big', 'size > 1', _THREE)}, {_greedy('one', 'size = 1', _THREE)}")
    + """select ['train', 'val', 'test'][choice + 1] as split, size, count(*) as n_components from
        (select choice, size from big where rn > 0 union all select choice, size from one where rn > 0) group by all""",
)
def split_three_way(spark, sf):
    """Components per split and size: the packing itself is checked, its ties are free."""
    s = L.split_three_way(components(spark, sf))
    per = s.groupBy("split", "component").agg(F.count("*").alias("size"))
    return per.groupBy("split", "size").agg(F.count("*").alias("n_components"))


@query(
    "split_kfold",
    ctes("gold", "vectors", extra=f"{CC_SQL}, {_greedy('big', 'size > 1', ['cast(0.2 as double)'] * 5)}")
    + """select fold, size, count(*) as n_components from (select choice as fold, size from big where rn > 0
        union all select cast((row_number() over (order by component) - 1) % 5 as integer), size from sizes where size = 1) group by all""",
)
def split_kfold(spark, sf):
    s = L.split_kfold(components(spark, sf))
    per = s.groupBy("fold", "component").agg(F.count("*").alias("size"))
    return per.groupBy("fold", "size").agg(F.count("*").alias("n_components"))


@query(
    "split_loco",
    ctes("gold", "vectors", extra=CC_SQL) + "select id, component, case when size > 1 then component end as fold from cc join sizes using (component)",
)
def split_loco(spark, sf):
    return L.split_loco(components(spark, sf))


@query(
    "assign_pair_split",
    ctes("gold", "vectors", "documented", extra=SPLIT_SQL) + """select d.id_1, d.id_2, x.split as split_1, y.split as split_2, case when x.split = y.split then x.split end as split
        from documented d join sp x on x.id = d.id_1 join sp y on y.id = d.id_2""",
)
def assign_pair_split(spark, sf):
    return L.assign_pair_split(X.documented_negatives(spark, sf).select("id_1", "id_2"), "id_1", "id_2", splits(spark, sf))


@query(
    "leak_check",
    ctes("gold", "vectors", extra=SPLIT_SQL) + """select (select count(*) from vectors) as n_ids,
        (select count(*) from vectors where id not in (select id from sp)) as n_uncovered,
        (select count(*) from (select id from sp group by id having count(*) > 1)) as n_overlapping,
        (select count(*) from gold join sp x on x.id = id_1 join sp y on y.id = id_2 where x.split <> y.split) as n_crossing""",
)
def leak_check(spark, sf):
    return L.leak_report(X.gold(spark, sf), "id_1", "id_2", splits(spark, sf), X.vectors(spark, sf))


@query(
    "cross_split_drop",
    ctes("gold", "vectors", "documented", extra=SPLIT_SQL) + """select id_1, id_2, x.split from documented join sp x on x.id = id_1
        join sp y on y.id = id_2 where x.split = y.split""",
)
def cross_split_drop(spark, sf):
    return L.cross_split_drop(X.documented_negatives(spark, sf).select("id_1", "id_2"), "id_1", "id_2", splits(spark, sf))


@query(
    "write_splits",
    ctes("gold", "vectors", extra=SPLIT_SQL) + "select id_1, id_2, split from gold join sp on id = id_1",
)
def write_splits(spark, sf):
    labelled = L.assign_pair_split(X.gold(spark, sf), "id_1", "id_2", splits(spark, sf)).select("id_1", "id_2", "split")
    path = scratch_path(spark, "splits")
    writers.write_splits(labelled, path)
    return spark.read.parquet(path).select("id_1", "id_2", "split")


@query(
    "fit_val_pairs",
    ctes("gold") + """select pair_id, case when row_number() over (order by md5('42|val|' || pair_id)) <=
        (select round_even(count(*) * cast(0.15 as double), 0) from gold) then 'val' else 'fit' end as part from gold""",
)
def fit_val_pairs(spark, sf):
    return L.fit_val_pairs(X.gold(spark, sf), ["pair_id"]).select("pair_id", "part")


@query(
    "fit_val_stratified",
    ctes("scored") + """select id_1, id_2, label, case when row_number() over (partition by label order by md5('42|val|' || id_1 || '|' || id_2)) <=
        round_even(count(*) over (partition by label) * cast(0.15 as double), 0) then 'val' else 'fit' end as part from scored""",
)
def fit_val_stratified(spark, sf):
    return L.fit_val_stratified(X.scored_pairs(spark, sf), ["id_1", "id_2"]).select("id_1", "id_2", "label", "part")


# --- similarity and ranks ------------------------------------------------------


@query(
    "cosine_pairs",
    ctes("gold", "vectors") + """select pair_id, round(list_cosine_similarity(a.v, b.v), 6) as score from gold
        join vectors a on a.id = id_1 join vectors b on b.id = id_2""",
)
def cosine_pairs(spark, sf):
    return r6(S.cosine_pairs(X.gold(spark, sf).select("pair_id", "id_1", "id_2"), "id_1", "id_2", X.vectors(spark, sf)), "score").select("pair_id", "score")


@query("bidirectional_queries", ctes("gold", extra=Q_SQL) + "select * from q")
def bidirectional_queries(spark, sf):
    return K.bidirectional_queries(X.gold(spark, sf))


@query(
    "directed_examples",
    ctes("gold") + "select pair_id, id_1 as input_id, id_2 as target_id from gold union all select pair_id, id_2, id_1 from gold",
)
def directed_examples(spark, sf):
    return K.directed_examples(X.gold(spark, sf))


@query("rank_target_desc", ctes("gold", "vectors", extra=RANKS) + "select pair_id, query_id, target_id, round(score, 6) as score, rank from r")
def rank_target_desc(spark, sf):
    r = ranked_queries(X.gold(spark, sf), X.vectors(spark, sf))
    return r6(r.select("pair_id", "query_id", "target_id", "score", "rank"), "score")


@query(
    "rank_target_asc",
    ctes("gold", "vectors", extra=f"{Q_SQL}, {W_SQL}, {rank_sql('rw', 'sw')}") + "select pair_id, query_id, target_id, round(-score, 6) as distance, rank from rw",
)
def rank_target_asc(spark, sf):
    r = ranked_queries(X.gold(spark, sf), weighted(X.vectors(spark, sf)), "euclidean")
    return r.select("pair_id", "query_id", "target_id", F.round(-F.col("score"), 6).alias("distance"), "rank")


_TOP = "select qid as query_id, cid as id, round({s}, 6) as score, rank from (select *, row_number() over (partition by qid order by s desc, cid) as rank from {t}) where rank <= {k}"


@query("topk_neighbors", ctes("vectors", extra=COS_SQL) + _TOP.format(s="s", t="s", k=10))
def topk_neighbors(spark, sf):
    v = X.vectors(spark, sf)
    return r6(S.top_neighbors(v.select(F.col("id").alias("query_id")), v, 10), "score").withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "cosine_all",
    ctes("vectors", extra=COS_SQL) + """select count(*) // 2 as n_pairs, (select count(*) from vectors) as n, round(avg(s), 6) as mean_cosine, round(max(s), 6) as max_cosine from s""",
)
def cosine_all(spark, sf):
    """All-against-all cosine, reduced: the mean has a closed form, the maximum is a nearest-neighbour search."""
    v = X.vectors(spark, sf)
    top = S.top_neighbors(v.select(F.col("id").alias("query_id")), v, 1).agg(F.max("score"))
    return S.mean_pair_cosine(v).select(
        "n_pairs", "n", F.round("mean_cosine", 6).alias("mean_cosine"), F.round(top.scalar(), 6).alias("max_cosine")
    )


@query("euclidean_all", ctes("vectors", extra=W_SQL) + _TOP.format(s="-s", t="sw", k=5).replace("as score", "as distance"))
def euclidean_all(spark, sf):
    v = weighted(X.vectors(spark, sf))
    top = S.top_neighbors(v.select(F.col("id").alias("query_id")), v, 5, "euclidean")
    return top.select("query_id", "id", F.round(-F.col("score"), 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


@query("hits_mrr", ctes("gold", "vectors", extra=RANKS) + f"select {METRICS} from r")
def hits_mrr(spark, sf):
    return r6(evaluate(X.gold(spark, sf), X.vectors(spark, sf)), *METRIC_COLS)


@query(
    "hits_mrr_by_family",
    ctes("gold", "vectors", extra=RANKS) + f"select query_family, {METRICS} from r group by 1",
)
def hits_mrr_by_family(spark, sf):
    r = ranked_queries(X.gold(spark, sf), X.vectors(spark, sf))
    return r6(K.hits_mrr(r, ["query_family"]), *METRIC_COLS)


GROUP = ["pair_id", "direction", "query_id", "target_id"]
#: Both methods' scores of every query with every other entity, then fused; ``fused_rank`` ranks the target by them.
POOL = """scored as (select s.qid, s.cid, s.s as cosine, sw.s as weighted from s join sw using (qid, cid))"""
FUSED_RANK = """select q.pair_id, q.direction, q.query_id, q.target_id, round(t.f, 6) as score,
        1 + count(*) filter (c.f > t.f or (c.f = t.f and c.cid < q.target_id)) as rank
        from q join fused t on t.qid = q.query_id and t.cid = q.target_id join fused c on c.qid = q.query_id and c.cid <> q.target_id
        group by pair_id, direction, query_id, target_id, t.f"""


def _methods(spark, sf):
    v = X.vectors(spark, sf)
    return [J.Method(v), J.Method(weighted(v), "euclidean")]


@query(
    "minmax_average",
    ctes("gold", "vectors", extra=f"{Q_SQL}, {COS_SQL}, {W_SQL}, {POOL}") + """, fused as (select qid, cid,
        round(((cosine - min(cosine) over g) / (max(cosine) over g - min(cosine) over g + 1e-12)
        + (weighted - min(weighted) over g) / (max(weighted) over g - min(weighted) over g + 1e-12)) / 2, 9) as f
        from scored window g as (partition by qid)) """ + FUSED_RANK,
)
def minmax_average(spark, sf):
    """The target among all entities by the mean of two min-max scaled scores."""
    q = K.bidirectional_queries(X.gold(spark, sf))
    return r6(J.rank_minmax(q, _methods(spark, sf)).select(*GROUP, "score", "rank"), "score")


@query(
    "rrf",
    ctes("gold", "vectors", extra=f"{Q_SQL}, {COS_SQL}, {W_SQL}, {POOL}") + """, ranked as (select *,
        row_number() over (partition by qid order by cosine desc, cid) as r0, row_number() over (partition by qid order by weighted desc, cid) as r1 from scored),
        fused as (select qid, cid, r0, r1, round(1.0 / (60 + r0) + 1.0 / (60 + r1), 11) as f from ranked) """
    + FUSED_RANK.replace("as score,", "as score, t.r0 as rank_0, t.r1 as rank_1,") + ", t.r0, t.r1",
)
def rrf(spark, sf):
    """The target among all entities by reciprocal-rank fusion of two methods."""
    q = K.bidirectional_queries(X.gold(spark, sf))
    return r6(J.rank_rrf(q, _methods(spark, sf)).select(*GROUP, "score", "rank_0", "rank_1", "rank"), "score")


_MM = "select 'cosine' as method, avg(1.0 / rank) as mrr from r union all select 'weighted', avg(1.0 / rank) from rw union all select 'empty', null"


@query(
    "best_method",
    ctes("gold", "vectors", extra=BOTH_RANKS) + f"""select method, round(mrr, 6) as mrr, coalesce(mrr > (select mrr from ({_MM}) where method = 'cosine'), false) as beats_baselines from ({_MM})""",
)
def best_method(spark, sf):
    m = _run_metrics(spark, sf).select("method", "mrr")
    none = spark.range(1).select(F.lit("empty").alias("method"), F.lit(float("nan")).alias("mrr"))
    return r6(K.best_method(m.unionByName(none), ["cosine"]), "mrr")


def _two_runs(spark, sf):
    gold, v = truncate_lineage(X.gold(spark, sf)), X.vectors(spark, sf)
    # a ranked run is read by several report steps: written once, then only read
    return tuple(truncate_lineage(ranked_queries(gold, *a)) for a in ((v,), (weighted(v), "euclidean")))


def _run_metrics(spark, sf):
    a, b = _two_runs(spark, sf)
    return K.hits_mrr(a).withColumn("method", F.lit("cosine")).unionByName(K.hits_mrr(b).withColumn("method", F.lit("weighted")))


def _paired(spark, sf):
    a, b = _two_runs(spark, sf)
    keys = ["pair_id", "direction", "query_id", "target_id", "query_family"]
    return a.select(*keys, F.col("rank").alias("cosine_rank")).join(
        b.select(*keys[:3], F.col("rank").alias("weighted_rank")), keys[:3]
    )


PAIRED = BOTH_RANKS + """, paired as (select r.pair_id, r.direction, r.query_id, r.target_id, r.query_family, r.rank as cosine_rank, rw.rank as weighted_rank
    from r join rw using (pair_id, direction, query_id))"""


@query(
    "two_method_retrieval",
    ctes("gold", "vectors", extra=PAIRED) + "select pair_id, direction, query_id, target_id, cosine_rank, weighted_rank from paired",
)
def two_method_retrieval(spark, sf):
    """Both methods rank the target among all entities."""
    return _paired(spark, sf).select("pair_id", "direction", "query_id", "target_id", "cosine_rank", "weighted_rank")


@query(
    "run_consistency",
    ctes("gold", "vectors", extra=BOTH_RANKS) + """select (select count(*) from r) as n_a, (select count(*) from rw) as n_b, count(*) as n_matched,
        bool_and(abs(r.rank - rw.rank) <= 1e-8 + 1e-5 * abs(rw.rank)) as consistent from r join rw using (pair_id, query_id)""",
)
def run_consistency(spark, sf):
    a, b = _two_runs(spark, sf)
    return R.run_consistency(a, b, ["pair_id", "query_id"], ["rank"])


# --- pair score tables ---------------------------------------------------------

PARTIAL = """partial as (select a.id as id_a, b.id as id_b, list_cosine_similarity(a.v, b.v) as s from vectors a join vectors b on b.id in (a.id + 1, a.id + 2)
    where a.family not in ('1', '2') and b.family not in ('1', '2'))"""


def _partial(spark, sf):
    v = X.vectors(spark, sf).filter(~F.col("family").isin("1", "2"))
    pairs = v.select(F.col("id").alias("id_a"), F.explode(F.array(F.col("id") + 1, F.col("id") + 2)).alias("id_b"))
    return S.cosine_pairs(pairs, "id_a", "id_b", v, out="s")


@query(
    "score_lookup",
    ctes("gold", "vectors", extra=PARTIAL) + """select pair_id, id_1, id_2, round(s, 6) as s from gold join partial on id_a = least(id_1, id_2) and id_b = greatest(id_1, id_2)""",
)
def score_lookup(spark, sf):
    swapped = X.gold(spark, sf).select("pair_id", F.col("id_2").alias("x"), F.col("id_1").alias("y"))
    r = R.score_lookup(swapped, "x", "y", _partial(spark, sf), ["s"])
    return r6(r.select("pair_id", F.col("y").alias("id_1"), F.col("x").alias("id_2"), "s"), "s")


@query(
    "score_lookup_default",
    ctes("gold", "vectors", extra=PARTIAL) + """select pair_id, id_1, id_2, round(coalesce(s, 0), 6) as s from gold left join partial on id_a = least(id_1, id_2) and id_b = greatest(id_1, id_2)""",
)
def score_lookup_default(spark, sf):
    r = R.score_lookup(X.gold(spark, sf).select("pair_id", "id_1", "id_2"), "id_1", "id_2", _partial(spark, sf), ["s"], default=0.0)
    return r6(r, "s")


@query(
    "symmetrize_scores",
    ctes("vectors", extra="near as (select a.id as id_a, b.id as id_b, list_cosine_similarity(a.v, b.v) as s from vectors a join vectors b on b.id in (a.id + 1, a.id + 2))")
    + "select id_a, id_b, round(s, 6) as s from near union all select id_b, id_a, round(s, 6) from near union all select id, id, 1.0 from vectors",
)
def symmetrize_scores(spark, sf):
    v = X.vectors(spark, sf)
    own = v.select(F.col("id").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("s"))
    pairs = v.select(F.col("id").alias("id_a"), F.explode(F.array(F.col("id") + 1, F.col("id") + 2)).alias("id_b"))
    return r6(R.symmetrize_scores(S.cosine_pairs(pairs, "id_a", "id_b", v, out="s"), ["s"], own), "s")


@query(
    "merge_folds",
    ctes("gold", "vectors", extra=PAIRED) + """select fold, n_queries, round(cosine_mrr, 6) as cosine_mrr, round(weighted_mrr, 6) as weighted_mrr from
        (select query_family as fold, count(*) as n_queries, avg(1.0 / cosine_rank) as cosine_mrr from paired group by 1)
        join (select query_family as fold, avg(1.0 / weighted_rank) as weighted_mrr from paired group by 1) using (fold)""",
)
def merge_folds(spark, sf):
    folds = _family_folds(spark, sf)
    left, right = folds.select("fold", "n_queries", "cosine_mrr"), folds.select("fold", "weighted_mrr")
    return r6(R.merge_folds(left, right), "cosine_mrr", "weighted_mrr")


def _family_folds(spark, sf):
    return P.fold_table(_paired(spark, sf).withColumnRenamed("query_family", "fold"), ["cosine", "weighted"])


_FOLDS = """, folds as (select query_family as fold, count(*) as n_queries, avg(1.0 / cosine_rank) as c, avg(1.0 / weighted_rank) as w from paired group by 1)"""


@query(
    "kfold_compare",
    ctes("gold", "vectors", extra=PAIRED + _FOLDS) + """select *, case when wins_vs_cosine >= n_folds - 1 and mean_delta > 0 then 'stable improvement'
        when wins_vs_cosine <= 1 and mean_delta < 0 then 'no improvement' else 'mixed' end as verdict from (
        select count(*) as n_folds, round(avg(w), 6) as weighted_mean, round(stddev_samp(w), 6) as weighted_std, round(avg(c), 6) as cosine_mean,
        round(stddev_samp(c), 6) as cosine_std, count(*) filter (w > c) as wins_vs_cosine, round(avg(w - c), 6) as mean_delta,
        round(stddev_samp(w - c), 6) as std_delta from folds)""",
)
def kfold_compare(spark, sf):
    out = P.kfold_compare(_family_folds(spark, sf), "weighted", "cosine")
    return r6(out, "weighted_mean", "weighted_std", "cosine_mean", "cosine_std", "mean_delta", "std_delta")


@query(
    "fold_models_compare",
    ctes("gold", "vectors", extra=PAIRED + _FOLDS) + """select 'cosine' as opponent, count(*) as n_folds, round(avg(w), 6) as new_mean, round(avg(c), 6) as opponent_mean,
        count(*) filter (w > c) as wins, round(avg(w - c), 6) as mean_delta, round(stddev_samp(w - c), 6) as std_delta from folds""",
)
def fold_models_compare(spark, sf):
    folds = _family_folds(spark, sf)
    out = P.fold_models_compare(folds.select("fold", "cosine_mrr"), folds.select("fold", "weighted_mrr"), "weighted", ["cosine"])
    return r6(out, "new_mean", "opponent_mean", "mean_delta", "std_delta")


@query(
    "loco_compare",
    ctes("gold", "vectors", extra=f"{CC_SQL}, {PAIRED}, folds as (select component as fold, count(*) as n_queries, avg(1.0 / cosine_rank) as c, avg(1.0 / weighted_rank) as w from paired join cc on cc.id = query_id group by 1)")
    + """select *, case when abs(mean_delta) > 2 * se_delta then 'distinguishable' else 'within noise' end as verdict from (
        select count(*) as n_folds, cast(sum(n_queries) as bigint) as n_queries, round(avg(c), 6) as cosine_macro, round(stddev_samp(c), 6) as cosine_std,
        round(stddev_samp(c) / sqrt(count(*)), 6) as cosine_se, round(sum(c * n_queries) / sum(n_queries), 6) as cosine_micro,
        round(avg(w), 6) as weighted_macro, round(stddev_samp(w), 6) as weighted_std, round(stddev_samp(w) / sqrt(count(*)), 6) as weighted_se,
        round(sum(w * n_queries) / sum(n_queries), 6) as weighted_micro, count(*) filter (w > c) as wins, round(avg(w - c), 6) as mean_delta,
        round(stddev_samp(w - c) / sqrt(count(*)), 6) as se_delta from folds)""",
)
def loco_compare(spark, sf):
    folds = L.split_loco(components(spark, sf)).select(F.col("id").alias("query_id"), "fold")
    out = P.loco_compare(_paired(spark, sf).join(folds, "query_id"), "cosine", "weighted")
    return r6(out, *[c for c in out.columns if c not in ("n_folds", "n_queries", "wins", "verdict")])


@query(
    "metric_delta",
    ctes("gold", "vectors", extra=BOTH_RANKS) + f""", m as (select 'a' as run, {METRICS} from r union all select 'b', {METRICS} from rw),
        u as (unpivot m on mrr, mean_rank, hits_at_1, hits_at_5, hits_at_10, hits_at_20 into name metric value value),
        j as (select x.metric, x.value as value_a, y.value as value_b, round(y.value - x.value, 5) as delta from u x join u y using (metric) where x.run = 'a' and y.run = 'b')
        select *, (select count(*) filter (delta > 0) || ' of ' || count(*) from j) as better from j""",
)
def metric_delta(spark, sf):
    a, b = _two_runs(spark, sf)
    out = P.metric_delta(*[P.unpivot_metrics(K.hits_mrr(x), METRIC_COLS) for x in (a, b)])
    return r6(out, "value_a", "value_b").withColumn("delta", F.round("delta", 5))


_DS = """, runs as (select 'cosine' as method, 'old' as dataset, avg(1.0 / rank) as mrr from r where query_family < '5' union all
    select 'cosine', 'new', avg(1.0 / rank) from r union all select 'weighted', 'new', avg(1.0 / rank) from rw)"""


@query(
    "dataset_compare",
    ctes("gold", "vectors", extra=BOTH_RANKS + _DS) + """select method, round(o, 6) as old_mrr, round(n, 6) as new_mrr, round(n - o, 6) as delta,
        case when o is null or n is null then 'not found' when n > o then 'IMPROVED' when n < o then 'WORSE' else 'UNCHANGED' end as verdict
        from (select method, max(mrr) filter (dataset = 'old') as o, max(mrr) filter (dataset = 'new') as n from runs group by 1)""",
)
def dataset_compare(spark, sf):
    a, b = _two_runs(spark, sf)

    def run(df, method):
        return K.hits_mrr(df).select(F.lit(method).alias("method"), "mrr")

    new = run(a, "cosine").unionByName(run(b, "weighted"))
    runs = P.union_runs(("old", run(a.filter("query_family < '5'"), "cosine")), ("new", new))
    return r6(P.dataset_compare(runs, "old", "new"), "old_mrr", "new_mrr", "delta")


# --- classifier metrics --------------------------------------------------------


@query(
    "confusion",
    ctes("scored") + """select count(*) filter (label <> 1 and score < 0.1) as tn, count(*) filter (label <> 1 and score >= 0.1) as fp,
        count(*) filter (label = 1 and score < 0.1) as fn, count(*) filter (label = 1 and score >= 0.1) as tp from scored""",
)
def confusion(spark, sf):
    return M.confusion(X.scored_pairs(spark, sf), threshold=0.1)


@query(
    "classification_metrics",
    ctes("scored", extra="""c as (select count(*) filter (label <> 1 and score < 0.1) as tn, count(*) filter (label <> 1 and score >= 0.1) as fp,
        count(*) filter (label = 1 and score < 0.1) as fn, count(*) filter (label = 1 and score >= 0.1) as tp from scored)""")
    + "select round((tp + tn) / (tp + tn + fp + fn), 6) as accuracy, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from c",
)
def classification_metrics(spark, sf):
    return r6(M.classification_metrics(M.confusion(X.scored_pairs(spark, sf), threshold=0.1)), "accuracy", "precision", "recall", "f1")


# Scores rounded to one decimal, so that ties matter.
_TIED = "tied as (select label, round(score, 1) as score from scored)"


def _tied(spark, sf):
    return X.scored_pairs(spark, sf).withColumn("score", F.round("score", 1))


@query(
    "roc_auc",
    ctes("scored", extra=_TIED) + """select round(sum(case when p.score > n.score then 1.0 when p.score = n.score then 0.5 else 0 end) / count(*), 6) as roc_auc
        from tied p join tied n on p.label = 1 and n.label = 0""",
)
def roc_auc(spark, sf):
    return r6(M.roc_auc(_tied(spark, sf)), "roc_auc")


@query(
    "average_precision",
    ctes("scored", extra=_TIED) + """, t as (select score, count(*) filter (label = 1) as p, count(*) as a from tied group by 1),
        c as (select p, sum(p) over (order by score desc) as cp, sum(a) over (order by score desc) as ca from t)
        select round(sum(p * cp / ca) / sum(p), 6) as average_precision from c""",
)
def average_precision(spark, sf):
    return r6(M.average_precision(_tied(spark, sf)), "average_precision")


@query(
    "welch_t",
    ctes("scored") + """select n_pos, round(mean_pos, 6) as mean_pos, round(std_pos, 6) as std_pos, n_neg, round(mean_neg, 6) as mean_neg,
        round(std_neg, 6) as std_neg, round((mean_pos - mean_neg) / sqrt(vp + vn), 6) as t,
        round((vp + vn) * (vp + vn) / (vp * vp / (n_pos - 1) + vn * vn / (n_neg - 1)), 6) as df from (
        select *, std_pos * std_pos / n_pos as vp, std_neg * std_neg / n_neg as vn from (
        select count(*) filter (label = 1) as n_pos, avg(score) filter (label = 1) as mean_pos, stddev_samp(score) filter (label = 1) as std_pos,
        count(*) filter (label = 0) as n_neg, avg(score) filter (label = 0) as mean_neg, stddev_samp(score) filter (label = 0) as std_neg from scored))""",
)
def welch_t(spark, sf):
    w = M.welch_t(X.scored_pairs(spark, sf))
    return r6(w, "mean_pos", "std_pos", "mean_neg", "std_neg", "t", "df").drop("p", "significant")


@query("welch_t_verdict")
def welch_t_verdict(spark, sf):
    """With the p-value, which the SQL engine has no function for."""
    return M.welch_t(X.scored_pairs(spark, sf)).select("t", "df", "p", "significant")

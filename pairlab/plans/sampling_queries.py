"""Negative sampling, mining, candidate samples, and the pair dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.operators import ranking as K
from pairlab.operators import rows as D
from pairlab.operators import sampling as N
from pairlab.plans.dataset import build_pair_dataset
from pairlab.plans.registry import query
from pairlab.plans.retrieval_queries import COS_SQL, Q_SQL, SPLIT_SQL, r6, splits
from pairlab.session import truncate_lineage
from pairlab.sources import fixtures as X
from pairlab.sources.fixtures import ctes

SEED = 42


def hex_draw(*parts: str) -> str:
    return "cast('0x' || substr(md5(" + " || '|' || ".join(parts) + "), 1, 15) as bigint)"


NUM_SQL = "num as (select id, row_number() over (order by md5('pool|' || id), id) as idx from vectors), cnt as (select count(*) as m, (select count(*) from gold) as p from vectors)"


def two(tag: str, draw: str, m: str) -> str:
    """Two different positions, as the operators draw them."""
    i = f"({hex_draw(chr(39) + str(SEED) + chr(39), tag, draw, chr(39) + '0' + chr(39))} % {m} + 1)"
    j = f"({hex_draw(chr(39) + str(SEED) + chr(39), tag, draw, chr(39) + '1' + chr(39))} % ({m} - 1) + 1)"
    return f"{i} as i, {j} + case when {j} >= {i} then 1 else 0 end as j"


def drawn_sql(name: str, tag: str, count: str) -> str:
    """All valid draws of ``count`` numbers: (draw, id_a, id_b)."""
    return f"""{name}_d as (select draw, {two(tag, 'draw', 'm')} from (select unnest(range({count})) as draw), cnt),
        {name} as (select draw, least(a.id, b.id) as id_a, greatest(a.id, b.id) as id_b from {name}_d join num a on a.idx = i join num b on b.idx = j
            where not exists (select 1 from gold g where least(g.id_1, g.id_2) = least(a.id, b.id) and greatest(g.id_1, g.id_2) = greatest(a.id, b.id)))"""


def _inputs(spark, sf):
    pool = X.vectors(spark, sf)
    gold = X.gold(spark, sf)
    positives = D.canonical_pair(gold, "id_1", "id_2").select("id_a", "id_b").distinct()
    return pool, gold, positives


@query(
    "neg_uniform",
    ctes("vectors", "gold", extra=NUM_SQL + ", " + drawn_sql("u", "'uniform|all'", "(select 30 * count(*) + 2000 from gold)"))
    + "select id_a, id_b from (select id_a, id_b, min(draw) as draw from u group by all) order by draw limit (select 10 * count(*) from gold)",
)
def neg_uniform(spark, sf):
    pool, gold, positives = _inputs(spark, sf)
    wanted = {"all": N.NEGATIVES_PER_POSITIVE * gold.count()}
    return N.neg_uniform(pool, positives, wanted, SEED).select("id_a", "id_b")


@query(
    "neg_uniform_by_split",
    ctes("vectors", "gold", extra=SPLIT_SQL + f""", num as (select id, split, row_number() over (partition by split order by md5('pool|' || id), id) as idx,
            count(*) over (partition by split) as m from sp),
        known as (select distinct least(id_1, id_2) as id_a, greatest(id_1, id_2) as id_b from gold),
        need as (select split, 10 * count(*) as want from known join sp on sp.id = id_a group by 1),
        dr as (select split, draw, want, {two("'uniform|' || split", 'draw', 'm')} from (select distinct split, m from num) join need using (split),
            lateral (select unnest(range(3 * want + 2000)) as draw)),
        dp as (select d.split, draw, want, least(a.id, b.id) as id_a, greatest(a.id, b.id) as id_b
            from dr d join num a on a.split = d.split and a.idx = i join num b on b.split = d.split and b.idx = j)""")
    + """select split, id_a, id_b from (select split, id_a, id_b, want, row_number() over (partition by split order by min(draw)) as rn
        from dp where not exists (select 1 from known k where k.id_a = dp.id_a and k.id_b = dp.id_b) group by split, id_a, id_b, want) where rn <= want""",
)
def neg_uniform_by_split(spark, sf):
    """Ends from the split's own pool, one plan for all splits."""
    _, _, positives = _inputs(spark, sf)
    sp = truncate_lineage(splits(spark, sf))
    counts = positives.join(sp.select(F.col("id").alias("id_a"), "split"), "id_a").groupBy("split").count().collect()
    wanted = {r["split"]: N.NEGATIVES_PER_POSITIVE * r["count"] for r in counts}
    return N.neg_uniform(sp, positives, wanted, SEED, "split").withColumnRenamed("grp", "split")


@query(
    "neg_random_baseline",
    ctes("vectors", "gold", extra=NUM_SQL + ", " + drawn_sql("u", "'baseline|all'", "(select 3 * count(*) + 2000 from gold)"))
    + "select draw, id_a, id_b from u order by draw limit (select count(*) from gold)",
)
def neg_random_baseline(spark, sf):
    pool, gold, positives = _inputs(spark, sf)
    return N.neg_random_baseline(pool.select("id"), positives, gold.count(), SEED)


@query(
    "neg_documented",
    ctes("vectors", "gold", "documented", extra=SPLIT_SQL) + """select split, pos.n as n_positive, coalesce(doc.n, 0) as n_documented,
        greatest(0, cast(round_even(pos.n * 5.0, 0) as bigint) - coalesce(doc.n, 0)) as n_mined
        from (select split, count(*) as n from gold join sp on sp.id = id_1 group by 1) pos
        left join (select x.split, count(*) as n from documented join sp x on x.id = id_1 join sp y on y.id = id_2 where x.split = y.split group by 1) doc using (split)""",
)
def neg_documented(spark, sf):
    from pairlab.operators.split import cross_split_drop

    sp = splits(spark, sf)
    pos = cross_split_drop(X.gold(spark, sf).select("id_1", "id_2"), "id_1", "id_2", sp)
    doc = cross_split_drop(X.documented_negatives(spark, sf), "id_1", "id_2", sp)
    need = N.documented_need(pos, doc, "split")
    mined = F.create_map(*[F.lit(x) for kv in need.items() for x in kv])
    n_pos, n_doc = (d.groupBy("split").agg(F.count("*").alias("n")) for d in (pos, doc))
    return n_pos.withColumnRenamed("n", "n_positive").join(n_doc.withColumnRenamed("n", "n_documented"), "split", "left").select(
        "split", "n_positive", F.coalesce("n_documented", F.lit(0)).alias("n_documented"), F.element_at(mined, F.col("split")).cast("bigint").alias("n_mined")
    )


def hard_sql(width: int, scored: bool) -> str:
    """Hard draws written out in SQL, on its own numbering of families and members."""
    h = "'" + f"{SEED}|hard|all|" + "' || draw || '|' || k || '|"

    def at(slot: int) -> str:
        return f"cast('0x' || substr(md5({h}{slot}'), 1, 15) as bigint)"

    best = "max_by((id_a, id_b), (s, -k))" if scored else "max_by((id_a, id_b), -k)"
    return f"""fs as (select family, count(*) as fsize from vectors group by 1),
        fam as (select family, fsize, row_number() over (order by md5('family|' || family)) as fidx, count(*) over () as nf from fs),
        mem as (select id, family, row_number() over (partition by family order by md5('member|' || id)) as midx from vectors),
        hd as (select draw, k, {at(0)} % nf + 1 as fi, {at(1)} % (nf - 1) + 1 as fj from
            (select unnest(range((select 5 * count(*) from gold))) as draw), (select unnest(range({width})) as k), (select max(nf) as nf from fam)),
        hf as (select draw, k, a.family as fa, b.family as fb, {at(2)} % a.fsize + 1 as ai, {at(3)} % b.fsize + 1 as bi
            from hd join fam a on a.fidx = fi join fam b on b.fidx = fj + case when fj >= fi then 1 else 0 end),
        hp as (select draw, k, least(a.id, b.id) as id_a, greatest(a.id, b.id) as id_b
            from hf join mem a on a.family = fa and a.midx = ai join mem b on b.family = fb and b.midx = bi),
        hv as (select hp.*, {'round(list_cosine_similarity(x.v, y.v), 12)' if scored else '0'} as s from hp join vectors x on x.id = id_a join vectors y on y.id = id_b
            where not exists (select 1 from gold g where least(g.id_1, g.id_2) = id_a and greatest(g.id_1, g.id_2) = id_b)),
        hb as (select draw, {best} as p from hv group by draw),
        hard as (select p[1] as id_a, p[2] as id_b, min(draw) as draw from hb group by all
            order by draw limit (select cast(floor(5 * count(*) * 0.3) as bigint) from gold))"""


@query(
    "neg_mixed",
    ctes("vectors", "gold", extra=f"{NUM_SQL}, {hard_sql(10, True)}, " + drawn_sql("e", chr(39) + "easy|all" + chr(39), "(select 30 * count(*) + 2000 from gold)"))
    + """select id_a, id_b, 'hard_cross_family_geometric' as pair_type from hard union all select id_a, id_b, 'easy_random' from
        (select id_a, id_b, min(draw) as draw from e where not exists (select 1 from hard h where h.id_a = e.id_a and h.id_b = e.id_b) group by all
         order by draw limit (select 5 * count(*) - (select count(*) from hard) from gold))""",
)
def neg_mixed(spark, sf):
    pool, gold, positives = _inputs(spark, sf)
    wanted = {"all": int(N.DATASET_RATIO * gold.count())}
    return N.neg_mixed(pool.select("id", "family"), positives, wanted, pool.select("id", "v"), SEED).drop("grp")


@query(
    "neg_family_only",
    ctes("vectors", "gold", extra=hard_sql(1, False)) + "select id_a, id_b, 'hard_cross_family' as pair_type from hard",
)
def neg_family_only(spark, sf):
    pool, gold, positives = _inputs(spark, sf)
    wanted = {"all": int(5 * gold.count() * N.HARD_FRACTION)}
    return N.neg_hard(pool.select("id", "family"), positives, wanted, None, SEED).drop("grp")


@query(
    "hard_negative_nearest",
    ctes("vectors", "gold", extra=COS_SQL) + """select pair_id, id_1, id_2, round(s, 6) as score, 'positive' as pair_type, 1 as label from gold join s on qid = id_1 and cid = id_2
        union all select pair_id, id_1, cid, round(s, 6), 'hard_negative', 0 from (select pair_id, id_1, cid, s, row_number() over (partition by pair_id order by s desc, cid) as rn
        from gold g join s on qid = id_1 where not exists (select 1 from gold k where (k.id_1 = qid and k.id_2 = cid) or (k.id_2 = qid and k.id_1 = cid))) where rn = 1""",
)
def hard_negative_nearest(spark, sf):
    return r6(N.hard_negative_nearest(X.gold(spark, sf), X.vectors(spark, sf)), "score")


def _directed(gold):
    q = K.bidirectional_queries(gold.select("pair_id", "id_1", "id_2"))
    return q.select("pair_id", F.col("query_id").alias("anchor"), F.col("target_id").alias("positive"))


DIRECTED = "dir as (select pair_id, id_1 as anchor, id_2 as positive from gold union all select pair_id, id_2, id_1 from gold)"
TRIPLET_SQL = f"""{DIRECTED}, valid as (select d.anchor, num.id, row_number() over (partition by d.anchor order by idx) as pos, count(*) over (partition by d.anchor) as free
        from (select distinct anchor from dir) d, num where num.id <> d.anchor and not exists (select 1 from dir x where x.anchor = d.anchor and x.positive = num.id)),
    rnd as (select d.*, v.id as negative from dir d join valid v on v.anchor = d.anchor and v.pos =
        {hex_draw("'42|triplet'", 'd.pair_id', 'd.anchor')} % v.free + 1)"""


@query("triplet_random", ctes("vectors", "gold", extra=f"{NUM_SQL}, {TRIPLET_SQL}") + "select * from rnd")
def triplet_random(spark, sf):
    pool, gold, positives = _inputs(spark, sf)
    return N.triplet_random(_directed(gold), pool, positives, SEED)


_T = "'42|triplet_hard|' || pair_id || '|' || anchor || '|' || k || '|"


@query(
    "triplet_hard",
    ctes("vectors", "gold", extra=f"""{NUM_SQL}, {TRIPLET_SQL}, fs as (select family, count(*) as fsize from vectors group by 1),
        fam as (select family, fsize, row_number() over (order by md5('family|' || family)) as fidx, count(*) over () as nf from fs),
        mem as (select id, family, row_number() over (partition by family order by md5('member|' || id)) as midx from vectors),
        td as (select d.*, k, fidx as own, cast('0x' || substr(md5({_T}0'), 1, 15) as bigint) % (nf - 1) + 1 as fi
            from dir d join vectors a on a.id = anchor join fam on fam.family = a.family, (select unnest(range(10)) as k)),
        tf as (select td.*, fam.family, cast('0x' || substr(md5({_T}1'), 1, 15) as bigint) % fsize + 1 as ni from td join fam on fidx = fi + case when fi >= own then 1 else 0 end),
        tm as (select tf.pair_id, tf.anchor, tf.positive, k, mem.id as negative from tf join mem on mem.family = tf.family and midx = ni where mem.id <> tf.positive
            and not exists (select 1 from dir x where x.anchor = tf.anchor and x.positive = mem.id)),
        hard as (select pair_id, anchor, positive, max_by(negative, (round(list_cosine_similarity(a.v, b.v), 12), -k)) as negative
            from tm join vectors a on a.id = anchor join vectors b on b.id = negative group by all)""")
    + """select *, 'hard_cross_family_geometric' as kind from hard union all
        select *, 'fallback_random' from rnd where not exists (select 1 from hard h where h.pair_id = rnd.pair_id and h.anchor = rnd.anchor)""",
)
def triplet_hard(spark, sf):
    pool, gold, positives = _inputs(spark, sf)
    return N.triplet_hard(_directed(gold), pool.select("id", "family"), positives, pool.select("id", "v"), SEED)


@query(
    "pu_bags",
    ctes("vectors", "gold", extra=f"""{NUM_SQL}, bd as (select bag, draw, {two("'bag'", "bag || '|' || draw", 'm')}
            from (select unnest(range(20)) as bag), (select unnest(range((select 30 * count(*) + 2000 from gold))) as draw), cnt),
        bp as (select bag, draw, least(a.id, b.id) as id_a, greatest(a.id, b.id) as id_b from bd join num a on a.idx = i join num b on b.idx = j),
        bv as (select bag, id_a, id_b, min(draw) as draw from bp where not exists (select 1 from gold g where least(g.id_1, g.id_2) = id_a and greatest(g.id_1, g.id_2) = id_b) group by all)""")
    + """select cast(bag as integer) as bag, id_a, id_b from (select *, row_number() over (partition by bag order by draw) as rn from bv)
        where rn <= (select 10 * count(*) from gold)""",
)
def pu_bags(spark, sf):
    pool, gold, positives = _inputs(spark, sf)
    return N.pu_bags(pool.select("id"), positives, N.NEGATIVES_PER_POSITIVE * gold.count(), 20, SEED)


def _keyed(spark, sf):
    q = K.bidirectional_queries(X.gold(spark, sf).select("pair_id", "id_1", "id_2"))
    return q.select(F.concat_ws("-", "pair_id", "direction").alias("key"), "query_id", "target_id")


CAND_SQL = f"""kq as (select pair_id || '-' || direction as key, query_id, target_id from q),
    kr as (select key, query_id, target_id, draw, least(a.idx, b.idx) as lo, greatest(a.idx, b.idx) as hi,
        {hex_draw("'42|candidate'", 'key', 'draw', "'0'")} % (m - 2) + 1 as r
        from kq join num a on a.id = query_id join num b on b.id = target_id, (select unnest(range(500)) as draw), cnt),
    ks as (select *, r + case when r >= lo then 1 else 0 end as r1 from kr),
    cand as (select key, query_id, target_id, draw, num.id from ks join num on idx = r1 + case when r1 >= hi then 1 else 0 end)"""


@query("sampled_candidates", ctes("vectors", "gold", extra=f"{Q_SQL}, {NUM_SQL}, {CAND_SQL}") + "select * from cand")
def sampled_candidates(spark, sf):
    r = N.sampled_candidates(_keyed(spark, sf), X.vectors(spark, sf), 500, SEED)
    return r.withColumn("draw", F.col("draw").cast("bigint"))


@query(
    "rank_sampled",
    ctes("vectors", "gold", extra=f"{Q_SQL}, {NUM_SQL}, {CAND_SQL}, {COS_SQL}") + """select key, 1 + count(*) filter (x.s > t.s) as rank from cand
        join s x on x.qid = query_id and x.cid = id join s t on t.qid = query_id and t.cid = target_id group by key""",
)
def rank_sampled(spark, sf):
    return N.rank_sampled(_keyed(spark, sf), X.vectors(spark, sf), 500, SEED)


@query("sample_pairs", ctes("raw_pairs") + "select pair_id, name_1, name_2 from raw_pairs order by md5('42|sample|' || pair_id) limit 1000")
def sample_pairs(spark, sf):
    return N.sample_pairs(X.raw_pairs(spark, sf).select("pair_id", "name_1", "name_2"), ["pair_id"])


@query(
    "query_subsample",
    ctes("gold", extra=Q_SQL) + "select pair_id, direction, query_id, target_id from q order by md5('42|sample|' || pair_id || '|' || direction) limit 200",
)
def query_subsample(spark, sf):
    q = K.bidirectional_queries(X.gold(spark, sf)).select("pair_id", "direction", "query_id", "target_id")
    return N.query_subsample(q, ["pair_id", "direction"])


@query("pair_dataset")
def pair_dataset(spark, sf):
    """The whole labelled dataset: positives, documented and mined negatives per split."""
    return build_pair_dataset(X.vectors(spark, sf), X.gold(spark, sf), X.documented_negatives(spark, sf))

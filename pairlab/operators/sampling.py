"""Negative sampling and mining by deterministic hashed draws.

A draw is a hash of (seed, tag, group, draw number, slot), turned into a position
in a numbered pool and joined to it. No driver loop, no shared generator: the
sample depends on its inputs only. Rounds of draws are made until the wanted count
is reached, duplicates and known pairs are removed, and the first ``n`` draws are
kept. Groups that ask for a large share of their valid pairs list all pairs instead.

Common contract: never a known positive in either order, both ends from the pool
of the group, no duplicates unless stated.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.functions import vectors as V
from pairlab.functions.hashing import DRAW_SPAN, draw_index, hash_draw, hash_key
from pairlab.operators.order import number_by_hash, running_by_value, take_first
from pairlab.operators.similarity import add_up, block_product, cosine_pairs, packed_blocks, top_neighbors
from pairlab.session import truncate_lineage

NEGATIVES_PER_POSITIVE = 10  # fixed value: ratio of the training jobs
DATASET_RATIO = 5.0  # fixed value: ratio of the dataset builder
HARD_FRACTION = 0.3  # fixed value
HARD_TRIES = 10  # fixed value: candidates per hard draw
HARD_ROUNDS = 6  # of draws, each twice the one before; the list fills the rest
BROADCAST_ROWS = 100_000  # look-up tables of (group, family) rows up to here are broadcast


def draws_needed(pool: int, n: int, known: int) -> int:
    """Draws that give ``n`` distinct unknown pairs of a pool with near certainty; more rounds follow if not."""
    pairs = pool * (pool - 1) // 2
    valid = max(pairs - known, 0)
    if n <= 0 or valid == 0:
        return 0
    expect = -pairs * math.log1p(-min(n / valid, 0.75))
    return math.ceil(expect * 1.1 + 8 * math.sqrt(expect) + 100)


class Groups:
    """Wanted counts and pool sizes of a few groups (splits, bags), as plan literals."""

    def __init__(self, rows: Sequence[tuple[str, int, int, int, int]]):
        self.rows = [r for r in rows if r[3] > 0]  # key, pool size, wanted, draws, number of the first draw

    def draws(self, spark, width: int = 1) -> DataFrame:
        """(grp, pool, want, draw, k): ``width`` candidates per draw."""
        starts, total = [], 0
        for _, _, _, d, _ in self.rows:
            starts.append(total)
            total += d * width
        at = F.size(F.filter(self._array(starts), lambda s: s <= F.col("id"))) - 1
        base = spark.range(total).withColumn("_g", at)
        local = F.col("id") - F.get(self._array(starts), F.col("_g"))
        return base.select(
            F.get(self._array([r[0] for r in self.rows], "string"), F.col("_g")).alias("grp"),
            F.get(self._array([r[1] for r in self.rows]), F.col("_g")).alias("pool"),
            F.get(self._array([r[2] for r in self.rows]), F.col("_g")).alias("want"),
            (F.get(self._array([r[4] for r in self.rows]), F.col("_g")) + F.floor(local / width)).cast("bigint").alias("draw"),
            (local % width).cast("int").alias("k"),
        )

    @staticmethod
    def _array(values, kind: str = "bigint") -> Column:
        return F.array(*[F.lit(v).cast(kind) for v in values]).cast(f"array<{kind}>")


def _canonical(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b")]


def _unknown(pairs: DataFrame, positives: DataFrame) -> DataFrame:
    return pairs.join(positives.select("id_a", "id_b"), ["id_a", "id_b"], "left_anti")


def _counts(df: DataFrame, group: str | None) -> dict[str, int]:
    """Rows per group; the caller groups by split or bag, a handful of values."""
    if group is None:
        return {"all": df.count()}
    return {str(r[group]): r["n"] for r in df.groupBy(group).agg(F.count("*").alias("n")).collect()}


def _two_distinct(pool: Column, *parts) -> tuple[Column, Column]:
    """Two different 1-based positions, without rejection."""
    i = draw_index(pool, *parts, 0)
    j = draw_index(pool - 1, *parts, 1)
    return i, j + (j >= i).cast("int")


def _numbered(pool: DataFrame, group: str | None, shared_pool: bool) -> DataFrame:
    """(id, grp, idx): positions in hash order, inside the group unless all groups share the pool."""
    keyed = pool.select("id", F.col(group).cast("string").alias("grp")) if group else pool.select("id", F.lit("all").alias("grp"))
    per_group = group is not None and not shared_pool
    return truncate_lineage(number_by_hash(keyed, "pool", ["id"], ["grp"] if per_group else ()))


def _uniform_pairs(numbered: DataFrame, groups: Groups, seed, tag: str, per_group: bool) -> DataFrame:
    """(grp, want, draw, id_a, id_b) of every draw, duplicates included."""
    draws = groups.draws(numbered.sparkSession)
    i, j = _two_distinct(F.col("pool"), seed, tag, F.col("grp"), F.col("draw"))
    placed = draws.withColumns({"i": i, "j": j})

    def side(pos: str, name: str) -> DataFrame:
        cols = [F.col("idx").alias(pos), F.col("id").alias(name)]
        return numbered.select(*(["grp"] if per_group else []), *cols)

    keys = ["grp"] if per_group else []
    out = placed.join(side("i", "_a"), [*keys, "i"]).join(side("j", "_b"), [*keys, "j"])
    return out.select("grp", "want", "draw", *_canonical("_a", "_b"))


def _first_distinct(pairs: DataFrame, span: dict[str, int]) -> DataFrame:
    """First draw of each pair, then the first ``want`` pairs of each group; ``span``: draws made."""
    once = pairs.groupBy("grp", "id_a", "id_b").agg(F.min("draw").alias("draw"), F.min("want").alias("want"))
    made = F.create_map(*[F.lit(x) for kv in span.items() for x in kv]).cast("map<string,bigint>")
    return take_first(once, F.col("draw"), F.element_at(made, F.col("grp")), F.col("want"), ["grp"])


def _rounds(groups: list[tuple[str, int, int, int]], draw, limit: int | None = None) -> DataFrame | None:
    """Rounds of draws until every group (key, pool, wanted, draws) has its wanted pairs.

    ``draw(Groups)`` gives the valid pairs of some draws. A round goes on where the last
    one ended, so the result is that of one long stream. The caller asks for no more
    pairs than exist, so the rounds end; with a ``limit`` they end after so many.
    """
    todo = [(*g, 0) for g in groups]
    found, span, made = None, {}, 0
    while todo and made != limit:
        made += 1
        new = truncate_lineage(draw(Groups(todo)))
        found = new if found is None else found.unionByName(new)
        span |= {g: first + d for g, _, _, d, first in todo}
        got = {r["grp"]: r["n"] for r in found.groupBy("grp").agg(F.count_distinct("id_a", "id_b").alias("n")).collect()}
        todo = [(g, size, n, 2 * d, first + d) for g, size, n, d, first in todo if got.get(g, 0) < n]
    return None if found is None else _first_distinct(found, span).select("grp", "id_a", "id_b")


def _every_pair(numbered: DataFrame, wanted: list[tuple[str, int]], per_group: bool) -> DataFrame:
    """(grp, want, id_a, id_b, ...): all pairs of the pools of the given groups, each once."""
    table = numbered.sparkSession.createDataFrame(wanted, "grp string, want long")
    if per_group:
        left = numbered.join(F.broadcast(table), "grp")  # a handful of groups
        size = numbered.groupBy("grp").agg(F.count("*").alias("_n"))
        left = left.join(F.broadcast(size), "grp")
    else:
        groups = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(n).cast("bigint").alias("want")) for g, n in wanted])
        left = numbered.drop("grp").withColumn("_n", F.lit(numbered.count())).withColumn("_g", F.explode(groups)).select("*", "_g.*").drop("_g")
    later = left.filter("idx < _n").withColumn("idx", F.explode(F.sequence(F.col("idx") + 1, F.col("_n"))))
    keys = ["grp", "idx"] if per_group else ["idx"]
    other = numbered.select(*keys, F.col("id").alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in numbered.columns if c not in ("id", "grp", "idx")])
    return later.withColumnRenamed("id", "_a").join(other, keys).select("*", *_canonical("_a", "_b"))


def _take_by_hash(pairs: DataFrame, seed, tag: str) -> DataFrame:
    order = F.shiftright(hash_draw(seed, tag, "every", F.col("grp"), F.col("id_a"), F.col("id_b")), 20)
    return take_first(pairs, order, F.lit(DRAW_SPAN >> 20), F.col("want"), ["grp"], ["id_a", "id_b"]).select("grp", "id_a", "id_b")


def _known_inside(positives: DataFrame, numbered: DataFrame, per_group: bool, extra: str | None = None) -> dict[str, int]:
    """Known pairs with both ends in the pool, per group; with ``extra``, only those whose ends differ in that column."""
    cols = [extra] if extra else []
    known = positives.select("id_a", "id_b").distinct()
    for side in ("id_a", "id_b"):
        known = known.join(numbered.select(F.col("id").alias(side), F.col("grp").alias(f"g_{side}"), *[F.col(c).alias(f"x_{side}") for c in cols]), side)
    known = known.filter(F.col("g_id_a") == F.col("g_id_b"))
    if extra:
        known = known.filter(F.col("x_id_a") != F.col("x_id_b"))
    return {str(r["g_id_a"]): r["n"] for r in known.groupBy("g_id_a").agg(F.count("*").alias("n")).collect()}


def _union(parts: list[DataFrame | None], like: DataFrame) -> DataFrame:
    parts = [p for p in parts if p is not None]
    if not parts:
        return like.sparkSession.createDataFrame([], f"grp string, id_a {like.schema['id'].dataType.simpleString()}, id_b {like.schema['id'].dataType.simpleString()}")
    return reduce(DataFrame.unionByName, parts)


def _uniform(pool: DataFrame, positives: DataFrame, wanted: dict[str, int], seed, tag: str, group: str | None, shared_pool: bool) -> DataFrame:
    """(grp, id_a, id_b): ``wanted`` distinct unknown pairs per group, or all there are.

    Where more than half of the valid pairs are wanted, all pairs are listed (at most twice
    the result and the known ones) and taken in hash order; else draws come in rounds.
    """
    per_group = group is not None and not shared_pool
    numbered = _numbered(pool, group, shared_pool)
    sizes = _counts(numbered, "grp" if per_group else None)
    known = _known_inside(positives, numbered, per_group)
    every, some = [], []
    for g, n in sorted(wanted.items()):
        at = g if per_group else "all"
        size, k = sizes.get(at, 0), known.get(at, 0)
        valid = size * (size - 1) // 2 - k
        n = min(n, valid)
        if n > 0 and 2 * n >= valid:
            every.append((g, n))
        elif n > 0:
            some.append((g, size, n, draws_needed(size, n, k)))
    parts = [_rounds(some, lambda groups: _unknown(_uniform_pairs(numbered, groups, seed, tag, per_group), positives))]
    if every:
        parts.append(_take_by_hash(_unknown(_every_pair(numbered, every, per_group).select("grp", "want", "id_a", "id_b"), positives), seed, tag))
    return _union(parts, pool)


def neg_uniform(
    pool: DataFrame,
    positives: DataFrame,
    wanted: dict[str, int],
    seed: int = 42,
    group: str | None = None,
    tag: str = "uniform",
) -> DataFrame:
    """(grp, id_a, id_b): ``wanted[g]`` distinct random unknown pairs per group.

    ``pool`` (id, group), ``positives`` canonical (id_a, id_b). Fewer come back
    only when the pool has fewer; compare the counts with ``shortfall``.
    """
    return _uniform(pool, positives, wanted, seed, tag, group, False)


def shortfall(sample: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """(grp, wanted, found) of the groups that got fewer pairs than wanted."""
    want = sample.sparkSession.createDataFrame(list(wanted.items()), "grp string, wanted long")
    got = sample.groupBy("grp").agg(F.count("*").alias("found"))
    j = want.join(got, "grp", "left").select("grp", "wanted", F.coalesce("found", F.lit(0)).alias("found"))
    return j.filter("found < wanted")


def neg_random_baseline(pool: DataFrame, positives: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(draw, id_a, id_b): ``n`` random unknown pairs, repeats allowed."""
    size, known = pool.count(), positives.count()
    valid = max(1, size * (size - 1) // 2 - known)
    span = math.ceil(n * (size * (size - 1) / 2) / valid * 1.1 + 8 * math.sqrt(n + 1) + 100)
    groups = Groups([("all", size, n, span, 0)])
    drawn = _unknown(_uniform_pairs(_numbered(pool, None, False), groups, seed, "baseline", False), positives)
    return take_first(drawn, F.col("draw"), F.lit(span), F.col("want")).select("draw", "id_a", "id_b")


def pu_bags(pool: DataFrame, positives: DataFrame, n: int, bags: int = 20, seed: int = 42) -> DataFrame:
    """(bag, id_a, id_b): independent unlabelled draws per bag, one job for all bags."""
    drawn = _uniform(pool.withColumn("bag", F.lit("all")), positives, {str(b): n for b in range(bags)}, seed, "bag", "bag", True)
    return drawn.select(F.col("grp").cast("int").alias("bag"), "id_a", "id_b")


def documented_need(
    positives: DataFrame, documented: DataFrame, group: str, ratio: float = DATASET_RATIO
) -> dict[str, int]:
    """Mined negatives still wanted per split: max(0, round(ratio * positives) - documented)."""
    pos, doc = _counts(positives, group), _counts(documented, group)
    return {g: max(0, round(n * ratio) - doc.get(g, 0)) for g, n in pos.items()}


# --- hard negatives ------------------------------------------------------------


class _Families:
    """Families and members numbered for drawing; members of a hot family are spread by hash."""

    def __init__(self, pool: DataFrame, group: str | None):
        known = pool.filter(F.coalesce(F.col("family"), F.lit("")) != "")
        grp = F.col(group).cast("string") if group else F.lit("all")
        self.pool = truncate_lineage(known.select("id", "family", grp.alias("grp")))
        sizes = self.pool.groupBy("grp", "family").agg(F.count("*").alias("fsize"))
        # every round of draws reads both
        self.table = truncate_lineage(number_by_hash(sizes, "family", ["family"], ["grp"], "fidx"))
        self.members = truncate_lineage(number_by_hash(self.pool, "member", ["id"], ["grp", "family"], "midx"))
        self.counts = {r["grp"]: r["n"] for r in sizes.groupBy("grp").agg(F.count("*").alias("n")).collect()}

    def look_up(self, draws: DataFrame, at: str, prefix: str) -> DataFrame:
        t = self.table.select(
            "grp", F.col("fidx").alias(at), F.col("family").alias(f"{prefix}_family"), F.col("fsize").alias(f"{prefix}_size")
        )
        small = sum(self.counts.values()) <= BROADCAST_ROWS
        return draws.join(F.broadcast(t) if small else t, ["grp", at])

    def member(self, draws: DataFrame, prefix: str, at: str) -> DataFrame:
        m = self.members.select(
            "grp", F.col("family").alias(f"{prefix}_family"), F.col("midx").alias(at), F.col("id").alias(prefix)
        )
        return draws.join(m, ["grp", f"{prefix}_family", at])


def neg_hard(
    pool: DataFrame,
    positives: DataFrame,
    wanted: dict[str, int],
    vectors: DataFrame | None,
    seed: int = 42,
    group: str | None = None,
    tries: int = HARD_TRIES,
) -> DataFrame:
    """(grp, id_a, id_b, pair_type): pairs of two different known families.

    With vectors each draw has ``tries`` candidates and keeps the most similar
    one, at every size; what ``HARD_ROUNDS`` rounds of draws leave open, because nearly all
    pairs are wanted, is filled from the list of the others in hash order. Without vectors the
    single candidate counts, and a large share of all pairs comes from the list.
    """
    if vectors is not None:
        pool = pool.join(vectors.select("id").distinct(), "id", "left_semi")  # others cannot be scored
    fam = _Families(pool, group)
    width = tries if vectors is not None else 1
    members = fam.pool.withColumn("idx", F.lit(0))
    squares = {
        r["grp"]: (r["n"], r["q"])
        for r in fam.table.groupBy("grp").agg(F.sum("fsize").alias("n"), F.sum(F.col("fsize") * F.col("fsize")).alias("q")).collect()
    }
    known = _known_inside(positives, members, group is not None, "family")
    every, some = [], []
    for g, n in sorted(wanted.items()):
        size, square = squares.get(g, (0, 0))
        valid = (size * size - square) // 2 - known.get(g, 0)
        n = min(n, valid)
        if n > 0 and vectors is None and 2 * n >= valid:
            every.append((g, n))
        elif n > 0:
            some.append((g, fam.counts[g], n, 3 * n + 200))

    def draw(groups: Groups) -> DataFrame:
        draws = groups.draws(pool.sparkSession, width)
        key = (seed, "hard", F.col("grp"), F.col("draw"), F.col("k"))
        fi, fj = _two_distinct(F.col("pool"), *key)
        d = draws.withColumns({"fi": fi, "fj": fj})
        d = fam.look_up(fam.look_up(d, "fi", "a"), "fj", "b")
        d = d.withColumns({"ai": draw_index(F.col("a_size"), *key, 2), "bi": draw_index(F.col("b_size"), *key, 3)})
        d = fam.member(fam.member(d, "a", "ai"), "b", "bi")
        d = _unknown(d.select("grp", "want", "draw", "k", *_canonical("a", "b")), positives)
        if vectors is None:
            return d.drop("k")
        d = cosine_pairs(d, "id_a", "id_b", vectors)
        best = d.groupBy("grp", "draw").agg(
            F.max_by(F.struct("id_a", "id_b"), F.struct("score", -F.col("k"))).alias("p"), F.min("want").alias("want")
        )
        return best.select("grp", "want", "draw", "p.id_a", "p.id_b")

    drawn = _rounds(some, draw, HARD_ROUNDS if vectors is not None else None)
    parts = [drawn]
    if vectors is not None and drawn is not None:
        drawn = truncate_lineage(drawn)
        parts, got = [drawn], _counts(drawn, "grp")
        every = [(g, n - got.get(g, 0)) for g, _, n, _ in some if got.get(g, 0) < n]
    if every:
        numbered = _numbered(fam.pool, "grp", False).join(fam.pool.select("id", "grp", "family"), ["id", "grp"])
        pairs = _every_pair(truncate_lineage(numbered), every, True).filter("family <> _b_family")
        pairs = _unknown(pairs.select("grp", "want", "id_a", "id_b"), positives)
        if drawn is not None:
            pairs = pairs.join(drawn, ["grp", "id_a", "id_b"], "left_anti")
        parts.append(_take_by_hash(pairs, seed, "hard"))
    kind = "hard_cross_family_geometric" if vectors is not None else "hard_cross_family"
    return _union(parts, pool).withColumn("pair_type", F.lit(kind))


def neg_mixed(
    pool: DataFrame,
    positives: DataFrame,
    wanted: dict[str, int],
    vectors: DataFrame | None,
    seed: int = 42,
    group: str | None = None,
    hard_fraction: float = HARD_FRACTION,
) -> DataFrame:
    """(grp, id_a, id_b, pair_type): floor(n * fraction) hard pairs, the rest uniform from the whole pool.

    A group short of hard pairs gets more uniform ones, so the total holds.
    """
    hard = truncate_lineage(neg_hard(pool, positives, {g: int(n * hard_fraction) for g, n in wanted.items()}, vectors, seed, group))
    found = _counts(hard, "grp")
    taken = positives.select("id_a", "id_b").unionByName(hard.select("id_a", "id_b")).distinct()
    rest = {g: n - found.get(g, 0) for g, n in wanted.items()}
    easy = neg_uniform(pool, taken, rest, seed, group, "easy").withColumn("pair_type", F.lit("easy_random"))
    return hard.unionByName(easy)


def hard_negative_nearest(pairs: DataFrame, vectors: DataFrame, metric: str = "cosine", **options) -> DataFrame:
    """Each pair and, per pair row, the nearest unknown neighbour of its first entity.

    Known partners, however many, are masked inside the blocks that hold them.
    (pair_id, id_1, id_2, score, pair_type, label)
    """
    clean = pairs.filter("id_1 <> id_2")
    known = clean.select(
        F.explode(
            F.array(
                F.struct(F.col("id_1").alias("query_id"), F.col("id_2").alias("id")),
                F.struct(F.col("id_2").alias("query_id"), F.col("id_1").alias("id")),
            )
        ).alias("p")
    ).select("p.*").distinct()
    anchors = clean.select(F.col("id_1").alias("query_id")).distinct()
    near = top_neighbors(anchors, vectors, 1, metric, exclude=known, **options)
    neg = clean.select("pair_id", F.col("id_1").alias("query_id")).join(near, "query_id").select(
        "pair_id", F.col("query_id").alias("id_1"), F.col("id").alias("id_2"), "score",
        F.lit("hard_negative").alias("pair_type"), F.lit(0).alias("label"),
    )
    pos = cosine_pairs(clean.select("pair_id", "id_1", "id_2"), "id_1", "id_2", vectors, metric).select(
        "pair_id", "id_1", "id_2", "score", F.lit("positive").alias("pair_type"), F.lit(1).alias("label")
    )
    return pos.unionByName(neg)


# --- triplets ------------------------------------------------------------------


def _partners(positives: DataFrame) -> DataFrame:
    """(anchor, other) in both directions."""
    both = F.explode(
        F.array(
            F.struct(F.col("id_a").alias("anchor"), F.col("id_b").alias("other")),
            F.struct(F.col("id_b").alias("anchor"), F.col("id_a").alias("other")),
        )
    )
    return positives.select(both.alias("p")).select("p.*")


def triplet_random(directed: DataFrame, pool: DataFrame, positives: DataFrame, seed: int = 42) -> DataFrame:
    """Add ``negative``: a random entity, neither anchor, positive nor known partner of the anchor.

    ``directed``: (pair_id, anchor, positive), one row per direction; the positive
    is a known partner. Draws r among the n - m valid positions of the pool and
    shifts it over the m invalid ones: position = r + count(e_i - i < r) for the
    invalid positions e_1 < e_2 < ... The count is a bucketed running sum, so an
    anchor with very many partners neither rejects draws nor fills one task. An
    anchor related to the whole pool has no row.
    """
    numbered = truncate_lineage(number_by_hash(pool.select("id"), "pool", ["id"]))
    size = numbered.count()
    anchors = directed.select("anchor").distinct()
    invalid = _partners(positives).unionByName(anchors.select("anchor", F.col("anchor").alias("other"))).distinct()
    invalid = truncate_lineage(invalid.join(anchors, "anchor", "left_semi").join(numbered.withColumnRenamed("id", "other"), "other"))
    ordered = running_by_value(invalid.select("anchor", "idx"), "idx", {"i": F.lit(1)}, ["anchor"])
    left = invalid.groupBy("anchor").agg((F.lit(size) - F.count("*")).alias("_free"))
    r = draw_index(F.col("_free"), seed, "triplet", F.col("pair_id"), F.col("anchor"))
    wanted = directed.join(left.filter("_free > 0"), "anchor").withColumn("_r", r)
    # one ordered stream per anchor: at equal values the draws come before the shifts
    shift = ordered.select("anchor", (F.col("idx") - F.col("i")).alias("x"), F.lit(1).alias("w"), F.col("idx").alias("tie"))
    draw = wanted.select("anchor", F.col("_r").alias("x"), F.lit(0).alias("w"), F.lit(0).cast("bigint").alias("tie")).distinct()
    count = running_by_value(shift.unionByName(draw), "x", {"below": F.col("w")}, ["anchor"], ties=["w", "tie"])
    at = count.filter("w = 0").select("anchor", F.col("x").alias("_r"), (F.col("x") + F.col("below")).alias("idx"))
    return wanted.join(at, ["anchor", "_r"]).join(numbered.withColumnRenamed("id", "negative"), "idx").select(
        *directed.columns, "negative"
    )


def _best_valid(drawn: DataFrame, directed: DataFrame, positives: DataFrame, pick: Column) -> DataFrame:
    ok = drawn.filter((F.col("negative") != F.col("anchor")) & (F.col("negative") != F.col("positive")))
    ok = _unknown(ok.select("*", *_canonical("anchor", "negative")), positives)
    return ok.groupBy(*directed.columns).agg(pick.alias("negative"))


def triplet_hard(
    directed: DataFrame,
    pool: DataFrame,
    positives: DataFrame,
    vectors: DataFrame,
    seed: int = 42,
    tries: int = HARD_TRIES,
) -> DataFrame:
    """Add ``negative`` and ``kind``: the hardest of ``tries`` draws from other known families.

    An anchor of unknown family, or without a valid draw, gets a random negative
    (kind ``fallback_random``).
    """
    fam = _Families(pool, None)
    n_fam = fam.counts.get("all", 0)
    fallback = triplet_random(directed, pool, positives, seed).withColumn("kind", F.lit("fallback_random"))
    if n_fam < 2:
        return fallback
    own = fam.pool.select(F.col("id").alias("anchor"), "family").join(fam.table.select("family", F.col("fidx").alias("own")), "family")
    key = (seed, "triplet_hard", F.col("pair_id"), F.col("anchor"), F.col("k"))
    d = directed.join(own.select("anchor", "own"), "anchor")
    d = d.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).withColumn("grp", F.lit("all"))
    other = draw_index(F.lit(n_fam - 1), *key, 0)
    d = d.withColumn("fi", other + (other >= F.col("own")).cast("int"))
    d = fam.look_up(d, "fi", "negative")
    d = fam.member(d.withColumn("ni", draw_index(F.col("negative_size"), *key, 1)), "negative", "ni")
    d = cosine_pairs(d, "anchor", "negative", vectors)
    hard = _best_valid(d, directed, positives, F.max_by("negative", F.struct("score", -F.col("k"))))
    hard = hard.withColumn("kind", F.lit("hard_cross_family_geometric"))
    rest = fallback.join(hard.select(*directed.columns), directed.columns, "left_anti")
    return hard.unionByName(rest)


# --- candidate and pair samples ------------------------------------------------


def sampled_candidates(queries: DataFrame, pool: DataFrame, n: int = 500, seed: int = 42) -> DataFrame:
    """(key, query_id, target_id, draw, id): ``n`` candidates with replacement, never query or target.

    ``queries``: (key, query_id, target_id), all in the pool. The two excluded
    positions are skipped by shifting, so no draw is rejected.
    """
    numbered = number_by_hash(pool.select("id"), "pool", ["id"])
    size = pool.count()
    q = queries.join(numbered.select(F.col("id").alias("query_id"), F.col("idx").alias("_q")), "query_id")
    q = q.join(numbered.select(F.col("id").alias("target_id"), F.col("idx").alias("_t")), "target_id")
    q = q.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    r = draw_index(F.lit(size - 2), seed, "candidate", F.col("key"), F.col("draw"), 0)
    lo, hi = F.least("_q", "_t"), F.greatest("_q", "_t")
    q = q.withColumn("_r", r).withColumn("_r", F.col("_r") + (F.col("_r") >= lo).cast("int"))
    q = q.withColumn("idx", F.col("_r") + (F.col("_r") >= hi).cast("int"))
    return q.join(numbered, "idx").select("key", "query_id", "target_id", "draw", "id")


PAIRS = 1 << 16  # listed pairs scored at once


def rank_sampled(queries: DataFrame, vectors: DataFrame, n: int = 500, seed: int = 42, metric: str = "cosine") -> DataFrame:
    """(key, rank): 1 + sampled candidates that score strictly better than the target.

    Candidates travel as lists of ids (``n`` for a query); vectors lie once in packed blocks and
    meet as a product, where a task scores the listed pairs only.
    """
    v = vectors.select("id", "v")
    ids = sampled_candidates(queries, vectors, n, seed).groupBy("key", "query_id").agg(F.collect_list("id").alias("ids"))
    target = cosine_pairs(queries, "query_id", "target_id", vectors, metric, "t").select("key", "t")
    rows = ids.join(target, "key").join(v.withColumnRenamed("id", "query_id"), "query_id")
    packed = packed_blocks(rows.select("key", "t", "ids", "v"), queries.count(), "key")
    blocks = packed_blocks(v.select(F.col("id").alias("c_id"), F.col("v").alias("c_v")), v.count(), "c_id")

    def kernel(q: pa.Table, c: pa.Table) -> pa.Table:
        lists, cid = q.column("ids").combine_chunks(), c.column("c_id").to_numpy()
        row = np.repeat(np.arange(q.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        wanted, order = lists.flatten().to_numpy(zero_copy_only=False), np.argsort(cid, kind="stable")
        at = np.minimum(np.searchsorted(cid, wanted, sorter=order), len(cid) - 1)
        here = np.flatnonzero(cid[order[at]] == wanted)
        i, j = row[here], order[at[here]]
        qm, cm, t = V.arrow_matrix(q.column("v")), V.arrow_matrix(c.column("c_v")), q.column("t").to_numpy()
        better = np.zeros(q.num_rows, np.int64)
        for k in range(0, len(i), PAIRS):
            x, y = i[k : k + PAIRS], j[k : k + PAIRS]
            better += np.bincount(x[V.pair_score(qm[x], cm[y], metric) > t[x]], minlength=q.num_rows)
        return pa.table({"key": q.column("key"), "better": pa.array(better)})

    kind = queries.schema["key"].dataType.simpleString()
    counted = block_product(packed, blocks, kernel, f"key {kind}, better long", add_up("better"))
    return counted.groupBy("key").agg((F.sum("better") + 1).alias("rank"))


def sample_pairs(pairs: DataFrame, keys: Sequence[str], n: int = 1000, seed: int = 42) -> DataFrame:
    """Up to ``n`` pairs without replacement, in hash order."""
    return pairs.orderBy(hash_key(seed, "sample", *[F.col(k) for k in keys])).limit(n)


def query_subsample(queries: DataFrame, keys: Sequence[str], n: int = 200, seed: int = 42) -> DataFrame:
    """A fixed sample of ``n`` queries, in their original order."""
    return sample_pairs(queries, keys, n, seed).orderBy(*keys)

"""Hard negatives by segment summaries.

Every vector is cut into segments; each segment keeps its mean and its deviation (the length of
what is left after the mean is taken off). The product over a segment of length l lies within
l * mean * mean -+ deviation * deviation, so the sums over all segments bound a score. Two
vectors are told apart by a few long segments first; the pairs these leave open are
looked at with shorter ones (``LEVELS``), and only what is still open is scored exactly
(as one matrix product where many pairs are).

Anchors and rows meet in tiles, an anchor block against a block of rows. A first pass finds
the positives of every anchor, a second one the rows whose score falls into the window
below each positive. A tile emits its best few rows for an anchor (or an anchor and
positive), never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlab.session import truncate_lineage

LEVELS = (4, 16)  # numbers of segments, coarse first
ANCHORS, ROWS = 1024, 4096  # rows of a tile
AT_ONCE = 256  # anchors whose bounds are held at once
DENSE = 0.1  # share of open pairs from which a level takes whole matrices
EXACT = 2.0**53
LONGEST = 2**63 - 1


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(flat.offsets.to_numpy())
    out = np.zeros((len(flat), max(width, 1)))
    out[np.repeat(np.arange(len(flat)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = flat.flatten().to_numpy(zero_copy_only=False)
    return out


class Summaries:
    """Means and deviations of the segments of some rows, level by level."""

    def __init__(self, rows: np.ndarray, levels: tuple[int, ...] = LEVELS) -> None:
        self.rows, self.levels = rows, []
        self.norm = np.sqrt((rows * rows).sum(1))
        for n in levels:
            cuts = np.linspace(0, rows.shape[1], min(n, rows.shape[1]) + 1).astype(int)
            size = np.diff(cuts)
            mean = np.add.reduceat(rows, cuts[:-1], axis=1) / size
            off = rows - np.repeat(mean, size, axis=1)
            deviation = np.sqrt(np.add.reduceat(off * off, cuts[:-1], axis=1))
            self.levels.append((mean * np.sqrt(size), deviation))  # so that the product of means is weighed by the length

    def part(self, rows: slice) -> Summaries:
        out = object.__new__(Summaries)
        out.rows, out.norm = self.rows[rows], self.norm[rows]
        out.levels = [(m[rows], d[rows]) for m, d in self.levels]
        return out


class Tile:
    """Bounds of the scores of some anchors with some rows, narrowed where asked."""

    def __init__(self, anchors: Summaries, rows: Summaries) -> None:
        self.a, self.c = anchors, rows
        shape = (len(anchors.rows), len(rows.rows))
        self.low, self.high = np.full(shape, -np.inf), np.full(shape, np.inf)
        self.slack = 1e-9 * np.outer(anchors.norm, rows.norm) + 1e-6  # rounding

    def narrow(self, level: int, open_: np.ndarray) -> None:
        """Bounds by the segments of ``level`` for the pairs in ``open_``."""
        (ma, da), (mc, dc) = self.a.levels[level], self.c.levels[level]
        if open_.mean() > DENSE:
            mid, off = ma @ mc.T, da @ dc.T + self.slack
            np.maximum(self.low, mid - off, out=self.low)
            np.minimum(self.high, mid + off, out=self.high)
            return
        i, j = np.nonzero(open_)
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            mid, off = np.einsum("ij,ij->i", ma[x], mc[y]), np.einsum("ij,ij->i", da[x], dc[y]) + self.slack[x, y]
            self.low[x, y] = np.maximum(self.low[x, y], mid - off)
            self.high[x, y] = np.minimum(self.high[x, y], mid + off)

    def settle(self, open_: np.ndarray) -> None:
        """Exact scores as both bounds of the pairs in ``open_``, or of all pairs where many are open."""
        a, c = self.a.rows, self.c.rows
        largest = np.abs(a).max(initial=0) * np.abs(c).max(initial=0) * a.shape[1]
        if open_.mean() > DENSE and largest < EXACT:
            self.low = self.high = a @ c.T
            return
        if largest >= EXACT:
            self.low, self.high = self.low.astype(object), self.high.astype(object)
        i, j = np.nonzero(open_)
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            self.low[x, y] = self.high[x, y] = whole_products(a[x], c[y])


def whole_products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row by row inner products of whole numbers; beyond 63 bits the nearest long."""
    if not len(a):
        return np.zeros(0, np.int64)
    if (np.abs(a).max(1) * np.abs(c).max(1)).max() * a.shape[1] < EXACT:
        return np.einsum("ij,ij->i", a, c).astype(np.int64)
    return np.array([max(-LONGEST - 1, min(LONGEST, sum(int(p) * int(q) for p, q in zip(x, y, strict=True)))) for x, y in zip(a, c, strict=True)], np.int64)


def kth_largest(x: np.ndarray, k: int) -> np.ndarray:
    """k-th largest of each row, minus infinity where a row has fewer columns."""
    return -np.partition(-x, k - 1, axis=1)[:, k - 1] if x.shape[1] >= k else np.full(len(x), -np.inf)


def first_of(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k`` of each owner: higher scores first, of equals the smaller id."""
    order = np.lexsort((ids, ~score, owner))  # ~x falls as x rises, without overflow
    o = owner[order]
    new = np.concatenate([[True], o[1:] != o[:-1]]) if len(o) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    place = np.arange(len(o)) - np.repeat(start, np.diff(np.append(start, len(o))))
    return order[place < k]


def best_rows(tile: Tile, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of pairs with the ``k`` best of every anchor among them."""
    open_ = allowed
    for level in range(len(tile.a.levels)):
        tile.narrow(level, open_)
        sure = kth_largest(np.where(allowed, tile.low, -np.inf), k)  # so much is reached k times
        open_ = allowed & (tile.high >= sure[:, None])
    tile.settle(open_)
    i, j = np.nonzero(open_)
    return i, j, tile.low[i, j].astype(np.int64)


def window_rows(tile: Tile, allowed: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of pairs with all scores between ``low`` and ``high`` of their anchor among them."""
    open_ = allowed
    for level in range(len(tile.a.levels)):
        tile.narrow(level, open_)
        open_ = open_ & (tile.high >= low[:, None]) & (tile.low <= high[:, None])
    tile.settle(open_)
    i, j = np.nonzero(open_ & (tile.high >= low[:, None]) & (tile.low <= high[:, None]))
    return i, j, tile.low[i, j].astype(np.int64)


def _tiles(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``kernel`` on every anchor block with every block of rows."""
    across, down = max(1, math.ceil(n_anchors / ANCHORS)), max(1, math.ceil(n_rows / ROWS))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select(place(across).alias("ab"), every(down).alias("rb"), *anchors.columns)
    right = rows.select(every(across).alias("c_ab"), place(down).alias("c_rb"), *[F.col(c).alias(f"c_{c}") for c in rows.columns])
    return left.groupBy("ab", "rb").cogroup(right.groupBy("c_ab", "c_rb")).applyInArrow(kernel, schema)


def usable(vectors: DataFrame, vec_id: str, label: str, vector: str) -> DataFrame:
    """(id, label, v) of the rows that take part, v as doubles; of rows with one id the one that sorts first.

    Rows with a null id, label, vector or component and those with a component that is not finite are left out.
    """
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    some = vectors.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{label}`").alias("label"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & fine)
    return some.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` (id, label, v) has unique long ids and whole numbers in v; ``anchors`` says which rows
    are anchors. A score is the inner product (vectors of unequal length: the missing
    components count as zero). Higher scores come first, of equal ones the smaller id. An
    anchor's positives are its first ``positives`` other rows of the same label; for each of
    them come the first ``negatives`` rows of other labels with a score between ``least`` and
    ``most`` hundredths of the positive's. Anchors without positives, positives without
    negatives and an empty table give no rows.
    """
    rows = truncate_lineage(rows.select(F.col("id").cast("bigint").alias("id"), "label", "v"))
    facts = rows.agg(F.count("*").alias("n"), F.count_if(anchors).alias("a"), F.max(F.size("v")).alias("w")).first()
    n_rows, n_anchors, width = facts["n"], facts["a"], facts["w"] or 0
    chosen = rows.filter(anchors)

    def blocks(q: pa.Table, c: pa.Table):
        """Tiles of at most ``AT_ONCE`` anchors with their first row, and who may pair: (same label, other row)."""
        left, right = Summaries(matrix(q.column("v"), width)), Summaries(matrix(c.column("c_v"), width))
        ql, cl = (np.asarray(t.column(n).to_pylist(), object) for t, n in ((q, "label"), (c, "c_label")))
        names, code = np.unique(np.concatenate([ql, cl]), return_inverse=True)
        code = code.ravel()
        qi, ci = q.column("id").to_numpy(), c.column("c_id").to_numpy()
        for at in range(0, len(qi), AT_ONCE):
            some = slice(at, min(at + AT_ONCE, len(qi)))
            same = code[: len(qi)][some][:, None] == code[len(qi) :][None, :]
            yield at, Tile(left.part(some), right), same, qi[some][:, None] != ci[None, :], ci

    first_schema = "anchor_id bigint, id bigint, score bigint"

    def first(q: pa.Table, c: pa.Table) -> pa.Table:
        out = [np.zeros((3, 0), np.int64)]
        for at, tile, same, other, ci in blocks(q, c) if q.num_rows and c.num_rows else ():
            i, j, score = best_rows(tile, same & other, positives)
            k = first_of(i, score, ci[j], positives)
            out.append(np.stack([q.column("id").to_numpy()[at + i[k]], ci[j[k]], score[k]]))
        return pa.table(dict(zip(["anchor_id", "id", "score"], np.concatenate(out, axis=1), strict=True)))

    found = _tiles(chosen, rows, n_anchors, n_rows, first, first_schema)
    w = W.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    top = truncate_lineage(found.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= positives))
    listed = top.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("k", "score"))).alias("p"))  # at most ``positives``
    asked = chosen.join(listed.select("id", F.col("p.score").alias("p")), "id")
    second_schema = "anchor_id bigint, k int, id bigint, score bigint"

    def second(q: pa.Table, c: pa.Table) -> pa.Table:
        out = [np.zeros((4, 0), np.int64)]
        for at, tile, same, other, ci in blocks(q, c) if q.num_rows and c.num_rows else ():
            given = q.column("p").slice(at, len(same)).to_pylist()
            low, high = np.full((len(given), positives), LONGEST, object), np.full((len(given), positives), -LONGEST, object)
            for r, scores in enumerate(given):  # whole numbers of any size
                for p, s in enumerate(scores):
                    low[r, p], high[r, p] = -(-least * s // 100), most * s // 100
            i, j, score = window_rows(tile, ~same & other, np.nextafter(low.min(1).astype(float), -np.inf), np.nextafter(high.max(1).astype(float), np.inf))
            for p in range(positives):
                ok = np.flatnonzero(((score >= low[i, p]) & (score <= high[i, p])).astype(bool))
                k = ok[first_of(i[ok], score[ok], ci[j[ok]], negatives)]
                out.append(np.stack([q.column("id").to_numpy()[at + i[k]], np.full(len(k), p + 1), ci[j[k]], score[k]]))
        cols = np.concatenate(out, axis=1)
        return pa.table({"anchor_id": cols[0], "k": cols[1].astype(np.int32), "id": cols[2], "score": cols[3]})

    hard = _tiles(asked, rows, n_anchors, n_rows, second, second_schema)
    w = W.partitionBy("anchor_id", "k").orderBy(F.desc("score"), "id")
    hard = hard.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= negatives)
    hard = hard.select("anchor_id", "k", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return hard.join(top.select("anchor_id", "k", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor_id", "k"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )

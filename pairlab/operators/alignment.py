"""Local alignment of listed pairs: identity and score, batched inside Spark tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.session import task_count

# BLOSUM62 for the 20 standard residues, lower triangle, one row per
# letter in the order of BLOSUM_LETTERS.
BLOSUM_LETTERS = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62 = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""
OPEN_GAP, EXTEND_GAP = -11, -1  # fixed values: first and further gap columns
BATCH_CELLS = 4_000_000  # cells of the padded scoring grids held at once


def scoring_matrix() -> np.ndarray:
    """Scores by letter code; the last code is padding that never aligns."""
    n = len(BLOSUM_LETTERS)
    m = np.full((n + 1, n + 1), -(10**6), dtype=np.int64)
    for i, row in enumerate(BLOSUM62.strip().splitlines()):
        for j, x in enumerate(row.split()):
            m[i, j] = m[j, i] = int(x)
    return m


def _codes(texts: list[str]) -> np.ndarray:
    table = np.full(256, len(BLOSUM_LETTERS), dtype=np.int64)
    table[np.frombuffer(BLOSUM_LETTERS.encode(), dtype=np.uint8)] = np.arange(len(BLOSUM_LETTERS))
    out = np.full((len(texts), max(map(len, texts), default=0)), len(BLOSUM_LETTERS), dtype=np.int64)
    for i, t in enumerate(texts):
        out[i, : len(t)] = table[np.frombuffer(t.encode("latin-1", "replace"), dtype=np.uint8)]
    return out


# A path state is one integer: score, then identical columns, then all columns.
# The larger integer is the better path; equal scores prefer more identical columns.
COLUMN_BITS = 20
COLUMN, IDENTICAL, SCORE = 1, 1 << COLUMN_BITS, 1 << (2 * COLUMN_BITS)


def align_batch(a: list[str], b: list[str], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each (a[i], b[i]) with affine gaps: identity %, score.

    Anti-diagonals of all pairs advance together. A state carries the identical
    and all columns of its path, so there is no trace-back and memory is linear
    in the text length.
    """
    ca, cb = _codes(a), _codes(b)
    n, la, lb = len(a), ca.shape[1], cb.shape[1]
    if not la or not lb:
        return np.zeros(n), np.zeros(n)
    if la + lb >= IDENTICAL:  # counts do not fit into one path state
        found = [align_long(x, y, matrix) for x, y in zip(a, b, strict=True)]
        return np.array([f[0] for f in found]), np.array([f[1] for f in found])
    # a column of residues x, y adds this much to a path
    step = (matrix * SCORE + np.eye(len(matrix), dtype=np.int64) * IDENTICAL + COLUMN).ravel()
    open_gap, extend_gap, none = OPEN_GAP * SCORE + COLUMN, EXTEND_GAP * SCORE + COLUMN, -(1 << 62)
    rows, cols = np.ascontiguousarray(ca.T * len(matrix)), np.ascontiguousarray(cb.T[::-1])
    # position i of diagonal d is the cell (i, d - i); row 0 and column 0 are borders. A diagonal only
    # reads what the two before it wrote, so three buffers take turns and nothing is cleared.
    h2, h1, h0 = np.zeros((3, la + 1, n), dtype=np.int64)
    e, f = np.full((2, la + 1, n), none, dtype=np.int64)
    pick, x, y = np.empty((3, la, n), dtype=np.int64)
    low = np.empty((la, n), dtype=bool)
    best = np.zeros(n, dtype=np.int64)
    for d in range(2, la + lb + 1):
        lo, hi = max(1, d - lb), min(la, d - 1)
        m, at, up = hi - lo + 1, slice(lo, hi + 1), slice(lo - 1, hi)
        h, left, over = h0[at], e[at], f[at]
        np.add(rows[up], cols[lb - d + lo : lb - d + hi + 1], out=pick[:m])
        np.take(step, pick[:m], out=h, mode="clip")
        np.add(h, h2[up], out=h)
        np.add(h1[up], open_gap, out=x[:m])
        np.add(f[up], extend_gap, out=y[:m])
        np.maximum(x[:m], y[:m], out=over)
        np.add(h1[at], open_gap, out=x[:m])
        np.add(left, extend_gap, out=left)
        np.maximum(left, x[:m], out=left)
        np.maximum(h, left, out=h)
        np.maximum(h, over, out=h)
        np.less(h, SCORE, out=low[:m])
        np.copyto(h, 0, where=low[:m])
        np.maximum(best, h.max(axis=0), out=best)
        h2, h1, h0 = h1, h0, h2
    columns = best % IDENTICAL
    same = best // IDENTICAL % IDENTICAL
    return np.where(columns > 0, 100.0 * same / np.maximum(columns, 1), 0.0), (best // SCORE).astype(float)


STRIPE = 8192  # letters of the first text that advance together
WIDE = 1 << 31  # in long texts a state is score and identical columns, with all columns beside it


def _better(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    take = (y[0] > x[0]) | ((y[0] == x[0]) & (y[1] > x[1]))
    return np.where(take, y[0], x[0]), np.where(take, y[1], x[1])


def align_long(a: str, b: str, matrix: np.ndarray, stripe: int = STRIPE) -> tuple[float, float]:
    """The same for one pair of any length, in stripes of the first text.

    A stripe runs over the whole second text by anti-diagonals; its last row (best state and
    best state in a gap) is carried to the next stripe. Memory is a stripe and two rows.
    """
    ca, cb = _codes([a])[0], _codes([b])[0]
    lb = len(cb)
    if not lb:
        return 0.0, 0.0
    step = matrix * WIDE + np.eye(len(matrix), dtype=np.int64)
    none = -(1 << 62)
    state = lambda n, fill=0: (np.full(n, fill, dtype=np.int64), np.zeros(n, dtype=np.int64))
    gap = lambda s, cost: (s[0] + cost * WIDE, s[1] + 1)
    cut = lambda s, k: (s[0][k], s[1][k])
    top_h, top_f = state(lb + 1), state(lb + 1, none)  # row above the stripe, by column
    best = (0, 0)
    for start in range(0, len(ca), stripe):
        rows = ca[start : start + stripe]
        n = len(rows)
        # position i of a diagonal d is the cell (i, d - i); row 0 is the carried row, column 0 a border
        h2, h1, e, f = state(n + 1), state(n + 1), state(n + 1, none), state(n + 1, none)
        next_h, next_f = state(lb + 1), state(lb + 1, none)
        for x, y in zip((h2, f), (top_h, top_f), strict=True):
            x[0][0], x[1][0] = y[0][0], y[1][0]
        h1[0][0], h1[1][0] = top_h[0][1], top_h[1][1]
        f[0][0], f[1][0] = top_f[0][1], top_f[1][1]
        for d in range(2, n + lb + 1):
            lo, hi = max(1, d - lb), min(n, d - 1)
            at, up = slice(lo, hi + 1), slice(lo - 1, hi)
            diag = (h2[0][up] + step[rows[lo - 1 : hi], cb[d - hi - 1 : d - lo][::-1]], h2[1][up] + 1)
            over = _better(gap(cut(h1, up), OPEN_GAP), gap(cut(f, up), EXTEND_GAP))
            left = _better(gap(cut(h1, at), OPEN_GAP), gap(cut(e, at), EXTEND_GAP))
            h = _better(_better(diag, left), over)
            low = h[0] < WIDE
            h[0][low], h[1][low] = 0, 0
            top = int(h[0].max())
            if top and top >= best[0]:
                best = max(best, (top, int(h[1][h[0] == top].max())))
            new = state(n + 1)
            new[0][at], new[1][at] = h
            e[0][at], e[1][at] = left
            f[0][at], f[1][at] = over
            if d <= lb:  # the carried row is row 0 of the next diagonals
                new[0][0], new[1][0] = top_h[0][d], top_h[1][d]
                f[0][0], f[1][0] = top_f[0][d], top_f[1][d]
            if hi == n:
                for x, y in ((next_h, h), (next_f, over)):
                    x[0][d - n], x[1][d - n] = y[0][-1], y[1][-1]
            h2, h1 = h1, new
        top_h, top_f = next_h, next_f
    same = best[0] % WIDE
    return (100.0 * same / best[1] if best[1] else 0.0), float(best[0] // WIDE)


def align_all(a: list[str], b: list[str], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of similar size are aligned together, a bounded number of cells at a time; the shorter text leads."""
    size = np.array([list(map(len, a)), list(map(len, b))]).reshape(2, -1)
    short, long = size.min(0), size.max(0)
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)]
    order = np.lexsort((long, np.ceil(np.log(short + 1.0) / np.log(1.2))))
    identity, score = np.zeros(len(a)), np.zeros(len(a))
    start = 0
    while start < len(order):
        first = order[start]
        end, widest = start + 1, short[first]
        while end < len(order):
            k = order[end]
            grown = max(widest, short[k])
            if grown > 1.2 * short[first] + 16 or long[k] > 1.2 * long[first] + 16 or short[k] < short[first] / 1.2 - 16:
                break
            if (end - start + 1) * 9 * (grown + 1) > BATCH_CELLS:
                break
            end, widest = end + 1, grown
        rows = order[start:end]
        identity[rows], score[rows] = align_batch([pairs[r][0] for r in rows], [pairs[r][1] for r in rows], matrix)
        start = end
    return identity, score


def alignment_scores(pairs: DataFrame, a: str, b: str, sequences: DataFrame, matrix: np.ndarray | None = None) -> DataFrame:
    """Canonical (id_a, id_b, identity, score) of the distinct listed pairs.

    Pairs are spread by hash over the shuffle partitions, and the texts of both
    sides joined to them; each task aligns its pairs in batches. Whole texts.
    """
    m = scoring_matrix() if matrix is None else matrix

    @F.pandas_udf("struct<identity:double,score:double>")
    def align(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        identity, score = align_all(list(x), list(y), m)
        return pd.DataFrame({"identity": identity, "score": score})

    wanted = pairs.select(F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b")).filter("id_a <> id_b").distinct()
    sa = sequences.select(F.col("id").alias("id_a"), F.col("seq").alias("_sa"))
    sb = sequences.select(F.col("id").alias("id_b"), F.col("seq").alias("_sb"))
    # the alignment is far more work than its input is data: spread it evenly
    joined = wanted.join(sa, "id_a").join(sb, "id_b").repartition(task_count(pairs.sparkSession, 2), "id_a", "id_b")
    return joined.select("id_a", "id_b", align("_sa", "_sb").alias("r")).select("id_a", "id_b", "r.identity", "r.score")


def score_summary(scores: DataFrame, column: str) -> DataFrame:
    """Mean and maximum off the diagonal of a canonical pair-score table."""
    off = scores.filter("id_a <> id_b")
    return off.agg(F.count("*").alias("n_pairs"), F.avg(column).alias("mean"), F.max(column).alias("max"))

"""Vector columns (``array<double>``) and the numpy kernels used inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12  # fixed value: denominator guard of the cosine feature


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine; 0 where either vector is zero."""
    denom = l2_norm(a) * l2_norm(b)
    return F.when(denom > 0, dot(a, b) / denom).otherwise(F.lit(0.0))


def euclidean(a: Column | str, b: Column | str) -> Column:
    sq = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, x: acc + x))


def abs_diff(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def is_unit(norm: Column, atol: float = 1e-3) -> Column:
    return F.abs(norm - 1.0) <= atol


# A vector column is ``array<double>``, or ``struct<i:array<int>,x:array<double>>``
# for sparse vectors; functions that read the latter take its ``width``.
SPARSE = "struct<i:array<int>,x:array<double>>"
BATCH_NUMBERS = 4_000_000  # numbers of a dense matrix held at once by the pair scorer


def arrow_matrix(column, width: int | None = None) -> np.ndarray:
    """Arrow vector column (no NULLs) to a float64 matrix without touching single rows."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(arr)
    if n == 0:
        return np.zeros((0, width or 0))
    if width is None:
        return arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, -1)
    at, x = pc.struct_field(arr, [0]), pc.struct_field(arr, [1])
    rows = np.repeat(np.arange(n), pc.list_value_length(at).to_numpy(zero_copy_only=False))
    m = np.zeros((n, width))
    m[rows, at.flatten().to_numpy(zero_copy_only=False)] = x.flatten().to_numpy(zero_copy_only=False)
    return m


def unit_rows(m: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.where(norms > 0, norms, 1.0)[:, None]


def pair_score(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Row-aligned score, larger is nearer. The only place that fixes last digits.

    Twelve decimals make equal pairs compare equal whatever the batch layout.
    """
    if metric == "cosine":
        s = np.einsum("ij,ij->i", unit_rows(a), unit_rows(b))
    elif metric == "euclidean":
        d = a - b
        s = -np.sqrt(np.einsum("ij,ij->i", d, d))
    else:
        raise ValueError(f"unknown metric {metric!r}")
    return np.round(s, 12)


def sparse_cosine(a: pa.Array, b: pa.Array, width: int) -> np.ndarray:
    """Row-aligned cosine of sparse vectors: look up the second side's entries in the first."""
    n = len(a)
    sides = []
    for side in (a, b):
        at, x = pc.struct_field(side, [0]), pc.struct_field(side, [1])
        rows = np.repeat(np.arange(n), pc.list_value_length(at).to_numpy(zero_copy_only=False))
        x = x.flatten().to_numpy(zero_copy_only=False)
        sides.append((rows, at.flatten().to_numpy(zero_copy_only=False), x, np.sqrt(np.bincount(rows, x * x, n))))
    (ra, ia, xa, na), (rb, ib, xb, nb) = sides
    dense = np.zeros((n, width))
    dense[ra, ia] = xa
    dot = np.bincount(rb, dense[rb, ib] * xb, n)
    norm = na * nb
    return np.round(np.where(norm > 0, dot / np.where(norm > 0, norm, 1.0), 0.0), 12)


def pair_score_udf(metric: str, width: int | None = None):
    """Arrow-batched scorer of two vector columns."""

    @F.arrow_udf("double")
    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        out, start = np.zeros(len(a)), 0
        step = max(1, BATCH_NUMBERS // width) if width else max(1, len(a))
        while start < len(a):
            part = slice(start, start + step)
            if width and metric == "cosine":
                out[part] = sparse_cosine(a[part], b[part], width)
            else:
                out[part] = pair_score(arrow_matrix(a[part], width), arrow_matrix(b[part], width), metric)
            start += step
        return pa.array(out, pa.float64())

    return score

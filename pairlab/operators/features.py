"""Pair features, k-mer profiles, token similarity, scaling and projections."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.functions import vectors as V
from pairlab.functions.text import STANDARD_RESIDUES
from pairlab.operators.similarity import cosine_pairs

KMER = 3  # fixed value: word length of the profiles
TOKEN_TOP_K = (5, 15, 30)  # fixed values: sizes of the token-level averages


# --- pair features -------------------------------------------------------------


def pair_vectors(pairs: DataFrame, a: str, b: str, vectors: DataFrame) -> DataFrame:
    """Attach ``va`` and ``vb``."""
    va = vectors.select(F.col("id").alias(a), F.col("v").alias("va"))
    vb = vectors.select(F.col("id").alias(b), F.col("v").alias("vb"))
    return pairs.join(va, a).join(vb, b)


def abs_diff_columns(va: Column | str, vb: Column | str) -> Column:
    """[|a - b| ..., cosine] as one array; the same for (a, b) and (b, a)."""
    cos = V.dot(va, vb) / (V.l2_norm(va) * V.l2_norm(vb) + V.EPS)
    return F.concat(V.abs_diff(va, vb), F.array(cos))


def abs_diff_features(pairs: DataFrame, a: str, b: str, vectors: DataFrame) -> DataFrame:
    """Pairs with ``features_array``."""
    joined = pair_vectors(pairs, a, b, vectors)
    return joined.select(*pairs.columns, abs_diff_columns("va", "vb").alias("features_array"))


def feature_matrix(labelled: DataFrame, a: str, b: str, vectors: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Labelled pairs with the ML vector ``features``; ``extra`` numeric columns are appended."""
    base = abs_diff_features(labelled, a, b, vectors).withColumn("_base", array_to_vector("features_array"))
    if not extra:
        return base.withColumnRenamed("_base", "features").drop("features_array")
    assembled = VectorAssembler(inputCols=["_base", *extra], outputCol="features", handleInvalid="error").transform(base)
    return assembled.drop("_base", "features_array")


def same_family_flag(family_1: Column | str, family_2: Column | str) -> Column:
    """1.0 when both families are known and equal. Close to the label itself, so off by default."""
    a, b = (F.nullif(F.trim(x), F.lit("")) for x in (family_1, family_2))
    return F.when(a == b, 1.0).otherwise(0.0)


# --- k-mers --------------------------------------------------------------------


KMER_WIDTH = len(STANDARD_RESIDUES) ** KMER


def kmer_vectors(sequences: DataFrame, seq: str = "seq") -> DataFrame:
    """(id, v): sparse word frequencies of each whole text, words numbered in letter order.

    Only words of the 20 standard letters count. A text is one row, so its words
    are counted inside the row: nothing is exploded and nothing is shuffled. An
    entity without such a word gets an empty vector (its similarity is 0).
    """
    code = np.full(256, -1, dtype=np.int64)
    code[np.frombuffer(STANDARD_RESIDUES.encode(), dtype=np.uint8)] = np.arange(len(STANDARD_RESIDUES))

    @F.arrow_udf(V.SPARSE)
    def count(texts: pa.Array) -> pa.Array:
        at, x, ends = [], [], [0]
        for t in texts.to_pylist():
            c = code[np.frombuffer((t or "").encode("ascii", "replace"), dtype=np.uint8)]
            word, known = np.zeros(max(len(c) - KMER + 1, 0), dtype=np.int64), np.ones(max(len(c) - KMER + 1, 0), dtype=bool)
            for i in range(KMER):
                part = c[i : i + len(word)]
                word, known = word * len(STANDARD_RESIDUES) + part, known & (part >= 0)
            n = np.bincount(word[known], minlength=KMER_WIDTH)
            hit = np.flatnonzero(n)
            at.append(hit)
            x.append(n[hit] / max(n.sum(), 1))
            ends.append(ends[-1] + len(hit))
        offsets = pa.array(ends, pa.int32())
        lists = [
            pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(v) if v else [], kind))
            for v, kind in ((at, pa.int32()), (x, pa.float64()))
        ]
        return pa.StructArray.from_arrays(lists, ["i", "x"])

    return sequences.select("id", count(seq).alias("v"))


def kmer_profile(sequences: DataFrame, seq: str = "seq") -> DataFrame:
    """(id, kmer, freq): share of each word among the counted words of the text."""
    letters, n = F.lit(STANDARD_RESIDUES), len(STANDARD_RESIDUES)
    long = kmer_vectors(sequences, seq).select("id", F.explode(F.arrays_zip("v.i", "v.x")).alias("w"))
    number = F.col("w.i")
    spelled = [F.substring(letters, (F.floor(number / n**k) % n + 1).cast("int"), F.lit(1)) for k in range(KMER - 1, -1, -1)]
    return long.select("id", F.concat(*spelled).alias("kmer"), F.col("w.x").alias("freq"))


def kmer_cosine(pairs: DataFrame, a: str, b: str, profiles: DataFrame, out: str = "kmer_cosine") -> DataFrame:
    """Cosine of the listed pairs' profiles (from ``kmer_vectors``); 0 without a common word."""
    scored = cosine_pairs(pairs.select(a, b).distinct(), a, b, profiles, out="_cos", width=KMER_WIDTH)
    return pairs.join(scored, [a, b], "left").select(*pairs.columns, F.coalesce("_cos", F.lit(0.0)).alias(out))


# --- token-level similarity ----------------------------------------------------


def token_topk_similarity(
    pairs: DataFrame, a: str, b: str, tokens: DataFrame, top_k: Sequence[int] = TOKEN_TOP_K, block: int = 16
) -> DataFrame:
    """Mean of the k largest token cosines of each listed pair, for every k at once.

    Entities are hashed into blocks of about ``block``. A task gets the pairs of
    one block pair and the token matrices of those entities: matrices are sent
    once per block pair they are needed in, not once per pair.
    """
    n = tokens.select("id").distinct().count()
    blocks = max(1, math.ceil(n / block))

    def home(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")

    keyed = pairs.select(a, b).distinct().select(F.col(a).alias("pa"), F.col(b).alias("pb"), home(a).alias("ba"), home(b).alias("bb"))
    members = keyed.select("ba", "bb", F.explode(F.array("pa", "pb")).alias("id")).distinct()
    sent = members.join(tokens, "id").select(
        F.col("ba").alias("ta"), F.col("bb").alias("tb"), F.col("id").alias("tid"), F.col("pos").alias("tpos"), F.col("v").alias("tv")
    )
    id_type = tokens.schema["id"].dataType.simpleString()
    names = [f"top_{k}" for k in top_k]
    schema = f"pa {id_type}, pb {id_type}, " + ", ".join(f"{c} double" for c in names)

    def kernel(p: pa.Table, t: pa.Table) -> pa.Table:
        rows_a, rows_b, values = [], [], {c: [] for c in names}
        if p.num_rows and t.num_rows:
            order = np.lexsort((t.column("tpos").to_numpy(), t.column("tid").to_numpy()))
            t = t.take(pa.array(order))
            ids, m = t.column("tid").to_numpy(), V.unit_rows(V.arrow_matrix(t.column("tv")))
            uniq, start = np.unique(ids, return_index=True)
            part = dict(zip(uniq.tolist(), np.split(m, start[1:])))
            for x, y in zip(p.column("pa").to_pylist(), p.column("pb").to_pylist()):
                if x not in part or y not in part:
                    continue
                s = (part[x] @ part[y].T).ravel()
                rows_a.append(x)
                rows_b.append(y)
                for k, c in zip(top_k, names):
                    kk = min(k, len(s))
                    values[c].append(float(np.partition(s, len(s) - kk)[len(s) - kk :].mean()))
        arrow = p.schema.field("pa").type
        cols = {"pa": pa.array(rows_a, arrow), "pb": pa.array(rows_b, arrow)}
        cols.update({c: pa.array(v, pa.float64()) for c, v in values.items()})
        return pa.table(cols)

    scored = keyed.groupBy("ba", "bb").cogroup(sent.groupBy("ta", "tb")).applyInArrow(kernel, schema)
    return pairs.join(scored.withColumnsRenamed({"pa": a, "pb": b}), [a, b])


# --- scaling and projections ---------------------------------------------------


def fit_scaler(vectors: DataFrame, tiny: float = 1e-8) -> DataFrame:
    """One row (mean, std): population std per dimension, below ``tiny`` counts as 1.

    Fit it on training rows only. The summarizer works on partial vectors.
    """
    s = vectors.agg(Summarizer.metrics("mean", "std", "count").summary(array_to_vector("v")).alias("s"))
    n = F.col("s.count").cast("double")
    pop = F.transform(vector_to_array("s.std"), lambda x: x * F.sqrt((n - 1) / n))
    std = F.transform(pop, lambda x: F.when(x < tiny, F.lit(1.0)).otherwise(x))
    return s.select(vector_to_array("s.mean").alias("mean"), std.alias("std"))


def scale(vectors: DataFrame, scaler: DataFrame, inverse: bool = False) -> DataFrame:
    """Standardise (or restore) the vectors with a fitted one-row scaler.

    The fitted row (two numbers per dimension) goes into the plan as literals.
    """
    row = scaler.first()
    mean, std = F.lit(list(row["mean"])), F.lit(list(row["std"]))
    if inverse:
        v = F.zip_with(F.zip_with("v", std, lambda x, s: x * s), mean, lambda x, m: x + m)
    else:
        v = F.zip_with(F.zip_with("v", mean, lambda x, m: x - m), std, lambda x, s: x / s)
    return vectors.withColumn("v", v)


def center(vectors: DataFrame) -> DataFrame:
    """Subtract the mean vector (one number per dimension reaches the driver)."""
    mean = vectors.agg(vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("m")).first()["m"]
    return vectors.withColumn("v", F.zip_with("v", F.lit(list(mean)), lambda x, m: x - m))


def pca_project(vectors: DataFrame, k: int = 128) -> tuple[DataFrame, float]:
    """Vectors projected on the first ``k`` components of the centred data, and the
    explained share of variance. Fits the model (one job; d x d on the driver)."""
    centred = center(vectors).withColumn("_x", array_to_vector("v"))
    model = PCA(k=k, inputCol="_x", outputCol="_y").fit(centred)
    out = model.transform(centred).withColumn("v", vector_to_array("_y")).drop("_x", "_y")
    return out, float(model.explainedVariance.toArray().sum())


def pca_2d(vectors: DataFrame, family: str = "family") -> DataFrame:
    """Plot table (id, x, y, family): standardised, two components, signs fixed.

    The sign of a component is arbitrary; it is chosen so that the coordinate of
    largest size along it is positive.
    """
    flat, _ = pca_project(scale(vectors, fit_scaler(vectors)), 2)
    label = F.coalesce(F.nullif(F.trim(family), F.lit("")), F.lit("Unknown"))
    xy = flat.select("id", F.get("v", F.lit(0)).alias("x"), F.get("v", F.lit(1)).alias("y"), label.alias("family"))
    sign_x = xy.agg(F.signum(F.max_by("x", F.abs("x")))).scalar()
    sign_y = xy.agg(F.signum(F.max_by("y", F.abs("y")))).scalar()
    return xy.select("id", (F.col("x") * sign_x).alias("x"), (F.col("y") * sign_y).alias("y"), "family")


# --- vector targets ------------------------------------------------------------


def identity_mse(pairs: DataFrame, a: str, b: str, vectors: DataFrame) -> DataFrame:
    """Mean squared error of "the partner is the entity itself"."""
    j = pair_vectors(pairs, a, b, vectors)
    sq = F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)
    return j.agg(F.count("*").alias("n"), F.avg(sq / F.size("va")).alias("mse"))


def triplet_metrics(
    triplets: DataFrame, vectors: DataFrame, margin: float = 0.3, predicted: DataFrame | None = None
) -> DataFrame:
    """Margin loss on cosine distance, share with d(pos) < d(neg), mean raw distance.

    ``predicted`` (id, v) replaces the anchors' vectors after a trained map.
    """
    t = cosine_pairs(triplets, "anchor", "positive", vectors, out="_p", left_vectors=predicted)
    t = cosine_pairs(t, "anchor", "negative", vectors, out="_n", left_vectors=predicted)
    dp, dn = 1 - F.col("_p"), 1 - F.col("_n")
    return t.agg(
        F.count("*").alias("n"),
        F.avg(F.greatest(dp - dn + margin, F.lit(0.0))).alias("loss"),
        F.avg((dp < dn).cast("int")).alias("accuracy"),
        F.avg(dp).alias("mean_distance"),
    )

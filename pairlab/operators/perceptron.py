"""A weighted multilayer perceptron whose gradients are summed by Spark.

Every pass over the training rows sends the current weights to the tasks and brings one
gradient back from each of a few merge groups: rows never move. The step is that of a
limited-memory quasi-Newton method. Features are scaled with the mean and deviation of the
rows that are fitted; a stratified part of the rows is kept back, and the weights with the
least loss on it are returned, after ``patience`` passes without a better one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.functions import vectors as V
from pairlab.operators.features import fit_scaler
from pairlab.operators.split import fit_val_stratified
from pairlab.session import truncate_lineage

MERGE_GROUPS = 16  # partial gradients that reach the driver in one pass
MEMORY = 10  # steps that shape the next direction
L2 = 1e-4


@dataclass(frozen=True)
class Perceptron:
    """Layer sizes, all weights in one vector, and the scaler of the inputs."""

    sizes: tuple[int, ...]
    weights: np.ndarray
    mean: np.ndarray
    std: np.ndarray

    def layers(self) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:], strict=False):
            out.append((self.weights[at : at + a * b].reshape(a, b), self.weights[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """Activations of every layer, the last one as log-odds."""
        out = [(x - self.mean) / self.std]
        layers = self.layers()
        for k, (w, b) in enumerate(layers):
            z = out[-1] @ w + b
            out.append(np.maximum(z, 0.0) if k < len(layers) - 1 else z)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        """P(label = 1) of feature rows."""
        return 1.0 / (1.0 + np.exp(-np.clip(self.forward(x)[-1][:, 0], -500, 500)))

    def loss(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, gradient: bool) -> tuple[float, np.ndarray]:
        """Sum of the weighted log losses, and its gradient."""
        acts = self.forward(x)
        z = acts[-1][:, 0]
        total = float((w * (np.maximum(z, 0) - y * z + np.log1p(np.exp(-np.abs(z))))).sum())
        if not gradient:
            return total, np.zeros(0)
        delta = (w * (1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))) - y))[:, None]
        parts = []
        layers = self.layers()
        for k in range(len(layers) - 1, -1, -1):
            parts[:0] = [(acts[k].T @ delta).ravel(), delta.sum(0)]
            if k:
                delta = (delta @ layers[k][0].T) * (acts[k] > 0)
        return total, np.concatenate(parts)


def start_weights(sizes: Sequence[int], seed: int) -> np.ndarray:
    r = np.random.default_rng(seed)
    return np.concatenate([x for a, b in zip(sizes, sizes[1:], strict=False) for x in (r.normal(0, np.sqrt(2 / a), a * b), np.zeros(b))])


def _sums(rows: DataFrame, model: Perceptron) -> tuple[float, np.ndarray, float]:
    """Weighted training loss and gradient (means), and the validation loss."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, val, g = np.zeros(2), np.zeros(2), np.zeros(len(model.weights))
        for b in batches:
            if not b.num_rows:
                continue
            x, y, w = V.arrow_matrix(b.column("x")), b.column("y").to_numpy(), b.column("w").to_numpy()
            held = b.column("val").to_numpy(zero_copy_only=False)
            loss, d = model.loss(x[~held], y[~held], w[~held], True)
            fit += (loss, w[~held].sum())
            g += d
            val += (model.loss(x[held], y[held], w[held], False)[0], w[held].sum())
        yield pa.RecordBatch.from_arrays([pa.array([fit.tobytes() + val.tobytes() + g.tobytes()], pa.binary())], ["s"])

    def merge(t: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(x.as_buffer()) for x in t.column("s"))
        return pa.table({"s": pa.array([whole.tobytes()], pa.binary())})

    sums = rows.mapInArrow(part, "s binary").withColumn("k", F.spark_partition_id() % MERGE_GROUPS)
    merged = sums.groupBy("k").applyInArrow(merge, "s binary")
    s = sum(np.frombuffer(bytes(r["s"])) for r in merged.collect())
    n = max(s[1], 1e-300)
    return s[0] / n + L2 / 2 * float(model.weights @ model.weights), s[4:] / n + L2 * model.weights, s[2] / s[3] if s[3] else s[0] / n


def _direction(g: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    q, kept = g.copy(), []
    for s, y in reversed(steps):
        a = (s @ q) / (y @ s)
        q -= a * y
        kept.append(a)
    if steps:
        s, y = steps[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(steps, reversed(kept), strict=True):
        q += (a - (y @ q) / (y @ s)) * s
    return -q


def fit_perceptron(
    train: DataFrame, weight: str | None, keys: Sequence[str], hidden: Sequence[int], max_iter: int = 60, seed: int = 42, validation: float = 0.15, patience: int = 10
) -> Perceptron:
    """Fit on (features, label, ``weight``); ``keys`` name a row for the validation draw.

    A row of weight w counts as w rows. Without validation rows the training loss stops the
    fit. Raises on an empty table.
    """
    columns = [vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w")]
    parts = fit_val_stratified(train, keys, seed=seed, fraction=validation) if validation else train.withColumn("part", F.lit("fit"))
    rows = truncate_lineage(parts.select(*columns, (F.col("part") == "val").alias("val")))
    fitted = rows.filter("not val").select(F.col("x").alias("v"))
    if fitted.isEmpty():
        raise ValueError("no training rows")
    scaler = fit_scaler(fitted).first()
    mean, std = np.array(scaler["mean"]), np.array(scaler["std"])
    sizes = (len(mean), *hidden, 1)
    model = Perceptron(sizes, start_weights(sizes, seed), mean, std)
    loss, g, held = _sums(rows, model)
    best, best_at, steps, step_size = (held, model), 0, [], 1.0
    for k in range(1, max_iter + 1):
        d = _direction(g, steps)
        if g @ d >= 0:
            steps, d = [], -g
        step_size = 1.0 if steps else min(1.0, 1.0 / np.abs(g).sum())
        for _ in range(12):  # halve until the loss falls enough
            tried = Perceptron(sizes, model.weights + step_size * d, mean, std)
            new_loss, new_g, new_held = _sums(rows, tried)
            if new_loss <= loss + 1e-4 * step_size * (g @ d):
                break
            step_size /= 2
        else:
            break
        s, y = tried.weights - model.weights, new_g - g
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-MEMORY:]
        model, loss, g, held = tried, new_loss, new_g, new_held
        if held < best[0]:
            best, best_at = (held, model), k
        elif k - best_at >= patience:
            break
        if np.abs(g).max() < 1e-6:
            break
    return best[1]


def predict_perceptron(model: Perceptron, rows: DataFrame, out: str = "score") -> DataFrame:
    """Add P(label = 1) from ``features``."""

    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        return pa.array(model.probability(V.arrow_matrix(x)) if len(x) else np.zeros(0))

    return rows.withColumn(out, score(vector_to_array("features")))

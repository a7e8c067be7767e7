"""Class-based bigram language model: exchange clustering, transitions and emissions.

P(text) is the product over tokens of P(class | class before) and P(word | class). Every
word has a unit: the ``n_frequent`` most frequent words are units of their own, all others
fall into ``SUFFIXES`` units by their last three bytes, the end of a text is one more. The
exchange algorithm sorts units into classes from their bigram counts over all training
tokens, so its input has a fixed size whatever the corpus has. Word counts stay exact: a
table of the ``TABLE_WORDS`` most frequent words travels to the tasks, rarer words are
joined with the full count table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.kernels import lower_table, slices, without
from pairlab.session import truncate_lineage

N_FREQUENT, SUFFIXES, N_CLASSES = 1000, 500, 60
TABLE_WORDS = 200_000
COUNTER_WORDS = 200_000  # distinct words that a task holds before it hands its counts on
SWEEPS = 4
BACKOFF = 5.0  # weight of the class frequencies in a transition
FOLD = lower_table()


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-case A-Z; words between white space."""
    return text.translate(FOLD).split() if text else []


def suffix_unit(word: bytes) -> int:
    return int.from_bytes(word[-3:], "big") * 2654435761 % (1 << 32) % SUFFIXES


class Units(dict):
    """Unit of each word, remembered for a bounded number of words."""

    def __init__(self, frequent: list[bytes]) -> None:
        super().__init__({w: k for k, w in enumerate(frequent)})
        self.frequent, self.shift = frequent, len(frequent)
        self.end = self.shift + SUFFIXES

    def __missing__(self, word: bytes) -> int:
        if len(self) > COUNTER_WORDS:
            self.clear()
            self.update({w: k for k, w in enumerate(self.frequent)})
            if word in self:
                return self[word]
        unit = self[word] = self.shift + suffix_unit(word)
        return unit


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) over all rows; words as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return got

        for whole in batches:
            for b in slices(whole, text, 1 << 20):
                for t in b.column(text).cast(pa.binary()).to_pylist():
                    counts.update(words_of(t))
                if len(counts) > COUNTER_WORDS:
                    yield out()
        yield out()

    return docs.select(text).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def unit_bigrams(docs: DataFrame, text: str, frequent: list[bytes]) -> np.ndarray:
    """Counts of neighbouring units; each text starts after an end and closes with one."""
    size = len(frequent) + SUFFIXES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(frequent)
        total = np.zeros(size * size, np.int64)
        for whole in batches:
            for b in slices(whole, text):
                ids = []
                for t in b.column(text).cast(pa.binary()).to_pylist():
                    ids.append(units.end)
                    ids.extend(map(units.__getitem__, words_of(t)))
                line = np.array([*ids, units.end], np.int64)
                total += np.bincount(line[:-1] * size + line[1:], minlength=size * size)
        rows = total.reshape(size, size)
        left = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int32()), pa.array([rows[k].tobytes() for k in left], pa.binary())], ["unit", "counts"])

    def add(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size, np.int64)
        for c in part["counts"]:
            total += np.frombuffer(c, np.int64)
        return pd.DataFrame({"unit": [key[0]], "counts": [total.tobytes()]})

    # one vector per task and unit: bounded for each task, summed in two steps so that no unit meets all tasks at once
    made = docs.select(text).mapInArrow(run, "unit int, counts binary")
    some = made.withColumn("lot", F.spark_partition_id() % 32).groupBy("unit", "lot").applyInPandas(lambda k, p: add(k, p), "unit int, counts binary")
    found = some.groupBy("unit").applyInPandas(add, "unit int, counts binary").collect()
    out = np.zeros((size, size))
    for r in found:
        out[r["unit"]] = np.frombuffer(bytes(r["counts"]), np.int64)
    return out


def _entropy(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, n_classes: int = N_CLASSES, sweeps: int = SWEEPS, fixed: int | None = None) -> np.ndarray:
    """Class of each unit: units move, one by one, to the class that raises the likelihood most.

    ``pairs`` are bigram counts. Units start in classes by frequency rank. ``fixed`` (the end
    of a text) stays alone in the last class. Stops when a sweep moves nothing.
    """
    size = len(pairs)
    movable = n_classes - (fixed is not None)
    weight = pairs.sum(0) + pairs.sum(1)
    cls = np.zeros(size, np.int64)
    order = [u for u in np.argsort(-weight, kind="stable").tolist() if u != fixed]
    for rank, u in enumerate(order):
        cls[u] = rank % movable
    if fixed is not None:
        cls[fixed] = n_classes - 1
    hot = np.zeros((size, n_classes))
    hot[np.arange(size), cls] = 1
    right = pairs @ hot  # unit before class
    left = pairs.T @ hot  # class before unit
    table = hot.T @ right
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not weight[u]:
                continue
            a, own = cls[u], pairs[u, u]
            r, q = right[u].copy(), left[u].copy()
            r[a] -= own
            q[a] -= own  # without the unit itself
            t = table.copy()
            t[a, :] -= r
            t[:, a] -= q
            t[a, a] -= own
            rows, cols = t.sum(1), t.sum(0)
            nr, nq = r.sum() + own, q.sum() + own
            # likelihood change of joining class b: row b, column b and their corner
            gain = (_entropy(t + r[None, :]) - _entropy(t)).sum(1) + (_entropy(t + q[:, None]) - _entropy(t)).sum(0)
            d = np.diag(t)
            gain += _entropy(d + r + q + own) - _entropy(d + r) - _entropy(d + q) + _entropy(d)
            gain -= _entropy(rows + nr) - _entropy(rows) + _entropy(cols + nq) - _entropy(cols)
            b = int(np.argmax(gain[:movable]))
            if b != a and gain[b] <= gain[a] + 1e-9:
                b = int(a)
            t[b, :] += r
            t[:, b] += q
            t[b, b] += own
            table = t
            if b != a:
                moved += 1
                cls[u] = b
                right[:, a] -= pairs[:, u]
                right[:, b] += pairs[:, u]
                left[:, a] -= pairs[u, :]
                left[:, b] += pairs[u, :]
        if not moved:
            break
    return cls


@dataclass
class ClassModel:
    frequent: list[bytes]
    table: list[tuple[bytes, int]]  # most frequent words and their counts
    counts: DataFrame  # all words
    unit_class: np.ndarray
    step: np.ndarray  # log10 P(class | class before)
    spread: np.ndarray  # log10 of each class's emission denominator
    tokens: int
    types: int
    texts: int


def fit(docs: DataFrame, text: str = "text", n_frequent: int = N_FREQUENT, n_classes: int = N_CLASSES) -> ClassModel:
    """The model of all rows of ``docs``. The driver holds counts of units (a fixed number) and the word table."""
    counts = truncate_lineage(word_counts(docs, text))
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    texts = docs.count()
    head = counts.orderBy(F.desc("n"), "word").limit(TABLE_WORDS).toArrow()
    table = list(zip(head.column("word").to_pylist(), head.column("n").to_pylist(), strict=True))
    frequent = [w for w, _ in table[:n_frequent]]
    pairs = unit_bigrams(docs, text, frequent)
    end = len(pairs) - 1
    cls = exchange(pairs, n_classes, fixed=end)
    hot = np.zeros((len(cls), n_classes))
    hot[np.arange(len(cls)), cls] = 1
    trans = hot.T @ pairs @ hot
    size = trans.sum(0)
    share = (size + 1) / (size.sum() + n_classes)
    step = (trans + BACKOFF * share[None, :]) / (trans.sum(1, keepdims=True) + BACKOFF)

    def types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = set(frequent), np.zeros(SUFFIXES, np.int64)
        for b in batches:
            for w in b.column("word").to_pylist():
                if w not in own:
                    seen[suffix_unit(w)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(SUFFIXES), pa.int32()), pa.array(seen)], ["k", "v"])

    kinds = np.zeros(len(cls))
    kinds[: len(frequent)] = 1
    kinds[end] = 1
    for r in counts.select("word").mapInArrow(types, "k int, v bigint").groupBy("k").agg(F.sum("v").alias("v")).collect():
        kinds[len(frequent) + r["k"]] = r["v"]
    spread = np.log10(size + hot.T @ kinds + 1)  # one unseen word for each class
    n_words = int(total["n"] or 0)
    return ClassModel(frequent, table, counts, cls, np.log10(step), spread, n_words + texts, int(total["v"]) + (texts > 0), texts)


def score(df: DataFrame, model: ClassModel, key: str, text: str = "text") -> DataFrame:
    """Adds n_tokens, n_known, base_score and score to each row; the text column goes.

    ``key`` is a column that is different in every row. Tokens are the words and one end. Null
    and empty texts are one end. Base: add-one unigram; score: log10 of the class model.
    """
    df = without(df, "n_tokens", "n_known", "base_score", "score")
    keep = [c for c in df.columns if c != text]
    frequent, table, cls, step, spread = model.frequent, model.table, model.unit_class, model.step, model.spread
    texts, known_end = model.texts, model.texts > 0
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("m", pa.int32())]))
    added = "_n bigint, _known bigint, _logs double, _path double, _rare array<struct<word:binary,m:int>>"
    schema = T.StructType([*[df.schema[c] for c in keep], *T.StructType.fromDDL(added).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(frequent)
        place = {w: k for k, (w, _) in enumerate(table)}
        logs = np.log10(np.array([n for _, n in table] + [0], np.float64) + 1)
        unit = np.array([units[w] for w, _ in table] + [0], np.int64)
        end_class, last = cls[units.end], len(table)
        end_log = np.log10(texts + 1.0)
        for whole in batches:
            for b in slices(whole, text):
                n, known, base, path, rare = [], [], [], [], []
                for t in b.column(text).cast(pa.binary()).to_pylist():
                    words = words_of(t)
                    at = np.fromiter((place.get(w, last) for w in words), np.int64, len(words))
                    u = unit[at]
                    out = np.flatnonzero(at == last).tolist()
                    odd = [words[k] for k in out]
                    if odd:
                        u[out] = [units[w] for w in odd]
                    c = np.concatenate([[end_class], cls[u], [end_class]])
                    sum_logs = float(logs[at].sum()) + end_log
                    n.append(len(words) + 1)
                    known.append(len(words) - len(odd) + known_end)
                    base.append(sum_logs)
                    path.append(float(step[c[:-1], c[1:]].sum() - spread[c[1:]].sum()))
                    rare.append([{"word": w, "m": m} for w, m in Counter(odd).items()])
                cols = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(path), pa.array(rare, rare_type)]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *cols], schema.names)

    # the scored rows without their texts are small; written once, they feed both sides of the join
    scored = truncate_lineage(df.mapInArrow(run, schema))
    rare = scored.select(F.col(key).alias("_key"), F.explode("_rare").alias("r")).select("_key", "r.word", "r.m")
    found = rare.join(model.counts, "word")  # words outside the table: none is frequent
    more = found.groupBy("_key").agg(F.sum(F.col("m") * F.log10(F.col("n") + 1.0)).alias("_more"), F.sum("m").alias("_seen"))
    whole = scored.join(more, F.col(key) == F.col("_key"), "left")
    logs = F.col("_logs") + F.coalesce("_more", F.lit(0.0))
    floor = float(np.log10(model.tokens + model.types + 1.0))
    return whole.select(
        *keep,
        F.col("_n").alias("n_tokens"),
        (F.col("_known") + F.coalesce("_seen", F.lit(0))).alias("n_known"),
        (logs - F.col("_n") * F.lit(floor)).alias("base_score"),
        (logs + F.col("_path")).alias("score"),
    )

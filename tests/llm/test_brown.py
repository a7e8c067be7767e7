import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pairlab.llm import brown, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + ["</>"]


def corpus():
    r = random.Random(6)
    voc = ["the", "The", "é", "ß x", "cat", "dog", "ran", "sat", *(f"w{k}" for k in range(300))]
    texts = [" ".join(r.choice(voc[: r.choice([8, 300])]) for _ in range(r.randrange(60))) for _ in range(80)]
    return [None, "", "\n", *texts, *texts[:5]]


@pytest.mark.parametrize("table,counter", [(200_000, 200_000), (20, 15)])
def test_base_against_brute_force(spark, folder, table, counter, monkeypatch):
    monkeypatch.setattr(brown, "TABLE_WORDS", table)
    monkeypatch.setattr(brown, "COUNTER_WORDS", counter)
    monkeypatch.setattr(brown, "N_FREQUENT", 10)
    texts = corpus()
    train = Counter(x for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2 for x in tokens(t))
    n, v = sum(train.values()), len(train)
    got = queries.op7_class_language_model(spark, folder(texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        words = tokens(texts[r["doc_id"]])
        base = sum(math.log10((train[x] + 1) / (n + v + 1)) for x in words)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2, len(words), sum(train[x] > 0 for x in words), n)
        assert abs(r["base_score"] - base) < 1e-6
        assert r["score"] < 0


def test_model_beats_the_base_on_held_out_text(spark):
    got = queries.op7_class_language_model(spark, "/root/testdata/sf0.01").filter("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum() + 0.02 * abs(got.base_score.sum())


def test_exchange_raises_the_likelihood_and_finds_classes():
    r = np.random.default_rng(3)
    true = np.arange(40) % 4
    pairs = np.zeros((40, 40))
    for _ in range(30000):
        a = int(r.integers(40))
        b = int(r.choice(np.flatnonzero(true == (true[a] + 1) % 4)))
        pairs[a, b] += 1
    cls = brown.exchange(pairs, 4, sweeps=10)
    assert len({(int(t), int(c)) for t, c in zip(true, cls)}) == 4


def test_empty_training(spark, docs):
    model = brown.fit(docs([]))
    rows = docs(["a b", None]).select("doc_id", "text")
    got = brown.score(rows, model, "doc_id").collect()
    assert sorted((r["n_tokens"], r["n_known"]) for r in got) == [(1, 0), (3, 0)]
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)

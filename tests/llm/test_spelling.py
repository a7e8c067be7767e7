import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.llm import queries, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute(counts):
    words = sorted(counts)
    form, n_near = {}, {}
    for w in words:
        found = [x for x in words if near(w, x)]
        n_near[w] = len(found)
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, counts[w], n_near[w], form[w], counts.get(form[w]), root))
    return out


def counted(rows):
    found = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def vocabulary(seed, n=150):
    r = random.Random(seed)
    words = set()
    while len(words) < n:
        w = "".join(r.choice("abÀé") for _ in range(r.randrange(5, 9))) if r.random() < 0.7 or not words else r.choice(sorted(words))
        k = r.randrange(len(w))
        words.add(r.choice([w, w[:k] + r.choice("abÿ") + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + "b" + w[k:]]))
    return {w: r.choice([3, 4, 7, 20, 50]) for w in words if len(w) >= 5} | {"x" * 3000: 9, "x" * 2999: 3, "x" * 3001: 30}


@pytest.mark.parametrize("seed,rows", [(1, 2048), (2, 10), (3, 3)])
def test_against_brute_force(spark, seed, rows):
    counts = vocabulary(seed)
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    got = spelling.group_variants(df, group_rows=rows).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted(tuple(r) for r in got) == brute(counts)


def test_query_on_odd_rows(spark, folder):
    r = random.Random(4)
    base = ["Thering", "therings", "thering", "therin", "ünder", "Ünder", "Under", "under×", "abc", "straße", "strasse", "ÀÀÀÀÀ", "日本語テキスト", "aaaaa", "aaaaaa"]
    texts = [" ".join(r.choice(base) for _ in range(r.randrange(30))) + r.choice(["", "1", "-", "\n"]) for _ in range(150)]
    texts += [None, "", " ", "thering " * 20000, "z" * 100000, "z" * 100000, "z" * 100000, *texts[:20]]
    rows = list(enumerate(texts)) + [(None, "thering therink therink therink"), (3, texts[3])]
    got = queries.op13_spelling_variants(spark, folder(rows)).collect()
    want = brute(counted(rows))
    assert len(want) > 15
    assert sorted(tuple(x) for x in got) == want


def test_position_index():
    counts = [w for w in vocabulary(9) if len(w) < 20]
    index = spelling.PositionIndex(counts)
    q0, w0, q1, w1 = index.near(np.arange(len(counts)), np.arange(len(counts)))
    got = {(counts[a], counts[b]) for a, b in [*zip(q0, w0, strict=True), *zip(q1, w1, strict=True)]}
    assert len(got) == len(q0) + len(q1)
    assert got == {(a, b) for a in counts for b in counts if near(a, b) and len(b) >= len(a)}


def test_empty_repeated_and_null_words(spark):
    schema = "word string, n long"
    assert spelling.group_variants(spark.createDataFrame([], schema)).count() == 0
    odd = spark.createDataFrame([(None, 3), ("", 4), ("a", None), ("b", 1), ("b", 1), ("c", 4), ("cd", 8)], schema)
    got = spelling.group_variants(odd.withColumn("form", F.lit(1))).select("word", "n", "n_near", "form", "root").collect()
    assert sorted(tuple(r) for r in got) == [("b", 2, 1, "c", "cd"), ("c", 4, 2, "cd", "cd"), ("cd", 8, 1, None, "cd")]

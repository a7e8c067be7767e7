import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairlab.llm import nearjoin

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for k in range(i):
            both = len(sets[i] & sets[k])
            if sets[i] and sets[k] and 100 * both >= 75 * len(sets[i] | sets[k]):
                up[top(i)] = top(k)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted((d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, families=25, copies=12):
    r = random.Random(seed)
    voc = [f"w{k}" for k in range(400)] + ["É", "the", "The"]
    passage = [r.choice(voc) for _ in range(60)]
    texts = []
    for f in range(families):
        base = [r.choice(voc) for _ in range(r.choice([3, 5, 8, 20, 60, 150, 400]))]
        if f % 3 == 0:
            base = base + passage  # shared by many
        for _ in range(r.randrange(1, copies)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4, len(w) // 30])):
                w[r.randrange(len(w))] = r.choice(voc)
            texts.append(r.choice([" ", "\n", " \t "]).join(w))
    texts += [None, "", "  ", "one", "One", "a b c d e", "a b c d e f", "a b c d e f"]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,frequent", [(1, 16), (2, 3), (3, 2)])
def test_against_brute_force(spark, docs, seed, frequent, monkeypatch):
    monkeypatch.setattr(nearjoin, "BLOCK", 4)
    rows = corpus(seed)
    got = nearjoin.near_components(docs(rows).select("doc_id", "text"), frequent=frequent).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows)


def test_signatures_meet_for_every_similar_pair():
    import numpy as np

    r = np.random.default_rng(5)
    for _ in range(300):
        n = int(r.integers(1, 300))
        a = r.integers(0, 2**63, n).astype(np.uint64)
        drop = int(r.integers(0, n // 4 + 1))
        b = np.concatenate([a[drop:], r.integers(0, 2**63, int(r.integers(0, max(1, (3 * n - 4 * drop) // 3 - (n - drop) + n // 8)))).astype(np.uint64)])
        same = len(np.intersect1d(a, b))
        if 100 * same < 75 * (len(a) + len(b) - same):
            continue
        value, offsets = np.concatenate([np.sort(a), np.sort(b)]), np.array([0, len(a), len(a) + len(b)])
        shared, spare = 0, {}
        for _j, rows, left, owner, sig, _ in nearjoin.signatures(value, offsets):
            if len(rows) == 2:
                common = len(np.intersect1d(sig[owner == 0], sig[owner == 1]))
                shared = max(shared, common - max(0, int(left.max())))
        assert shared >= 1


def kept_signatures(value, offsets, frequent):
    """What each set of a table keeps: the leave-out of ``near_components`` in plain Python."""
    kept = {}
    for j, rows, spare, owner, sig, _ in nearjoin.signatures(value, offsets):
        n = Counter(sig.tolist())
        for k, row in enumerate(rows.tolist()):
            mine = sig[owner == k].tolist()
            hot = sorted((s for s in mine if n[s] > frequent), key=lambda s: (-n[s], s))
            gone = set(hot[: max(0, int(spare[k]))])
            kept.setdefault(row, set()).update((j, s) for s in mine if s not in gone)
    return kept


def test_similar_short_sets_keep_a_common_signature():
    r = np.random.default_rng(11)
    for _ in range(60):
        for n in range(3, 17):  # texts of 7 to 20 words
            base = r.integers(0, 2**63, n).astype(np.uint64)
            sets = [base, *(np.append(base, x) for x in r.integers(0, 2**63, 50).astype(np.uint64))]
            value, offsets = np.concatenate([np.sort(s) for s in sets]), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            kept = kept_signatures(value, offsets, nearjoin.FREQUENT)
            assert all(kept[0] & kept[k] for k in range(1, len(sets))), n


def short_families():
    """One row of seven words whose shingles fall into one of three parts, and 60 longer by one word."""
    band = nearjoin.Band(1)
    for seed in range(1000):
        text = " ".join(f"t{seed}x{k}" for k in range(7))
        value, _ = nearjoin.shingle_sets(pa.record_batch({"text": [text]}), "text")
        part = (nearjoin.mix(value ^ nearjoin.SALT[0]) >> np.uint64(32)) * np.uint64(band.parts) >> np.uint64(32)
        if len(set(part.tolist())) == 1:
            return [(0, text), *((k, f"{text} v{k}") for k in range(1, 61))]


def test_many_variants_of_a_short_text(spark, docs):
    rows = short_families()
    got = nearjoin.near_components(docs(rows).select("doc_id", "text")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows)


def test_variants_of_templates_of_7_to_20_words(spark, docs):
    rows, want = [], []
    for n in range(7, 21):
        words = [f"n{n}x{k}" for k in range(n)]
        first = len(rows)
        mine = [(first, " ".join(words)), *((first + k, " ".join([*words, f"v{k}"])) for k in range(1, 56))]
        rows += mine
        want += brute(mine)
    got = nearjoin.near_components(docs(rows).select("doc_id", "text")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want


def test_groups_of_signatures_are_bounded(spark, docs, monkeypatch):
    monkeypatch.setattr(nearjoin, "GROUP_SIGNATURES", 1000)
    monkeypatch.setattr(nearjoin, "SLICE_BYTES", 4000)
    r = random.Random(8)
    head = [f"h{k}" for k in range(150)]  # frequent in every slice
    rows = [(i, " ".join([*head, *(f"w{r.randrange(9999)}" for _ in range(r.choice([100, 400])))])) for i in range(300)]
    table = docs(rows).select("doc_id", "text")
    splits = nearjoin.band_splits(nearjoin.describe(table, "text"))
    packed = nearjoin._signed(table, "text", splits, 2)
    groups = packed.groupBy("bucket", "lot").agg(F.sum(F.length("sigs") / 6).alias("n")).collect()
    assert len(splits) > 8 and max(splits) > 3
    assert max(g["n"] for g in groups) < 1500
    assert sum(g["n"] for g in groups) > 30_000


def test_split_ranges_against_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(nearjoin, "GROUP_SIGNATURES", 100)
    rows = corpus(4)
    got = nearjoin.near_components(docs(rows).select("doc_id", "text"), frequent=3).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows)


def test_empty_and_odd_tables(spark, docs):
    assert nearjoin.near_components(docs([])).count() == 0
    got = nearjoin.near_components(docs([(5, "a b c"), (5, "a b c"), (3, "A b c"), (None, "a b c"), (None, None), (8, "")])).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in got) == [(-1, 0, -1), (-1, 1, 3), (3, 1, 3), (5, 1, 3), (5, 1, 3), (8, 0, 8)]
    kept = nearjoin.one_of_each(docs([(1, "x y"), (2, "x y"), (3, None), (4, "z")]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def test_very_many_short_texts_in_one_slice(spark, docs):
    rows = [(i, f"w{i % 70000}") for i in range(70010)]
    got = nearjoin.near_components(docs(rows, partitions=1).select("doc_id", "text")).filter("component_id <> doc_id").collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(70000 + k, k) for k in range(10)]


def thue_morse(n):
    x = "a"
    for _ in range(n):
        x += x.translate(str.maketrans("ab", "ba"))
    return x


def test_words_that_collide_under_polynomials_stay_apart(spark, docs):
    a = thue_morse(10)
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(0, " ".join([a] * 8)), (1, " ".join([b] * 8)), (2, " ".join([a] * 8))]
    got = nearjoin.near_components(docs(rows).select("doc_id", "text")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(0, 0), (1, 1), (2, 0)]


def test_clashing_columns_and_repeated_ids(spark, docs):
    table = docs([(3, "a b"), (5, "a b"), (5, "other text"), (None, "a b"), (7, None)])
    clash = table.selectExpr("doc_id", "text", *[f"doc_id as `{c}`" for c in ("set_id", "component", "sketch", "one", "_row", "_group", "_least", "_user", "sig", "_line", "id")])
    found = nearjoin.near_components(clash)
    assert found.columns == [*[c for c in clash.columns if c != "text"], "n_shingles", "component_id"]
    assert sorted((r["_row"] or -1, r["component_id"] or -1) for r in found.collect()) == [(-1, 3), (3, 3), (5, 3), (5, 5), (7, 7)]
    kept = nearjoin.one_of_each(clash)
    assert kept.columns == clash.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == [(3, "a b"), (5, "other text"), (7, "")]
    again = nearjoin.one_of_each(docs([(5, "x"), (5, "x"), (None, "x")])).collect()
    assert [r["doc_id"] for r in again] == [5]


def test_a_family_with_outliers_is_contracted(spark, docs, monkeypatch):
    monkeypatch.setattr(nearjoin, "BLOCK", 8)
    r = random.Random(6)
    rows = []
    for f in range(3):
        base = [f"f{f}w{k}" for k in range(60)]
        for _ in range(50):
            w = list(base)
            for _ in range(r.choice([0, 1, 2, 3])):
                w[r.randrange(60)] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    got = nearjoin.near_components(docs(rows).select("doc_id", "text"), frequent=4).collect()
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == brute(rows)


def test_a_very_long_text(spark, docs):
    r = random.Random(2)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(400_000))
    got = nearjoin.near_components(docs([(2, long), (1, long + " end"), (3, "w1")]).select("doc_id", "text")).collect()
    assert sorted((x["doc_id"], x["component_id"]) for x in got) == [(1, 1), (2, 1), (3, 3)]


def test_a_member_takes_few_signatures_to_the_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(nearjoin, "LOWER_SIGS", 2, raising=False)
    seen, blocks = [], nearjoin._block_pairs
    monkeypatch.setattr(nearjoin, "_block_pairs", lambda m: seen.append(m.agg(F.max(F.size("sigs"))).first()[0]) or blocks(m))
    r = random.Random(9)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for n in range(60):  # half of the words are common to all: many frequent signatures, no links between families
        w = base[:100] + [f"f{n // 2}x{k}" for k in range(100)]
        w[150] = f"y{r.randrange(10**6)}"
        rows.append((n, " ".join(w)))
    got = nearjoin.near_components(docs(rows).select("doc_id", "text"), frequent=3).collect()
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == brute(rows)
    assert seen and max(seen) <= 2

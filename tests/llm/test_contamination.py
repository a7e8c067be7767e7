import hashlib
import random
import re

from pairlab.llm import contamination, queries

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(t):
    return WORD.findall((t or "").encode().translate(LOWER))


def brute(texts, items, window=10):
    wins = []
    for item, t in items:
        w = words(t)
        size = min(window, len(w))
        wins += [(item, w[k : k + size]) for k in range(len(w) - size + 1)] if size else []
    out = {}
    for i, t in enumerate(texts):
        d, hit, own = words(t), set(), set()
        for item, w in wins:
            for k in range(len(d) - len(w) + 1):
                if d[k : k + len(w)] == w:
                    hit |= set(range(k, k + len(w)))
                    own.add(item)
        out[i] = (len(d), len(hit), sorted(x for x in own if x is not None))
    return out


def case():
    r = random.Random(1)
    voc = ["a", "b", "The", "ß", "é9", "x_y", "zebra", "q"]
    say = lambda n: " ".join(r.choice(voc) for _ in range(n))
    items = [("i1", say(30)), ("i2", say(12)), ("i10", "zebra"), ("i3", "a a a a a a a a a a a a"), ("i4", None), ("i5", "..."), (None, say(15)), ("i2", say(11)), ("i6", "Q, zebra")]
    texts = [None, "", "...", say(5), say(300), items[0][1] + " x " + say(20), items[1][1].upper(), "a " * 40, items[6][1], "Zebra!", say(40) + " " + items[0][1][:40], "q_zebra"]
    return texts, items


def test_against_brute_force_in_any_number_of_blocks(spark, docs, monkeypatch):
    texts, items = case()
    want = brute(texts, items)
    table = spark.createDataFrame(items, "item_id string, text string")
    for size in (1 << 20, 60):
        real = contamination.blocks_of
        monkeypatch.setattr(contamination, "blocks_of", lambda *a, n=size, f=real: f(*a, n))
        got = contamination.contaminated(docs(texts), table).withColumn("n_hit", contamination.words_hit("hit_spans"))
        rows = {r["doc_id"]: (r["n_words"], r["n_hit"], r["hit_items"]) for r in got.collect()}
        monkeypatch.undo()
        assert rows == want
        assert {"doc_id", "text", "lang", "source", "n_chars"} < set(got.columns)


def test_query(spark, folder):
    texts, items = case()
    want = brute(texts, items)
    got = queries.op5_decontamination(spark, folder(texts, benchmark=spark.createDataFrame(items, "item_id string, text string"))).collect()
    assert len(got) == len(texts)
    for r in got:
        n, hit, own = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(own), hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(own).encode()).hexdigest()


def test_empty_tables_and_clashing_columns(spark, docs):
    none = spark.createDataFrame([], "item_id string, text string")
    got = contamination.contaminated(docs(["a b", None]).withColumnRenamed("source", "N_words"), none).collect()
    assert sorted((r["n_words"], r["hit_spans"], r["hit_items"]) for r in got) == [(0, [], []), (2, [], [])]
    assert contamination.contaminated(docs([]), none).count() == 0
    kept = contamination.without_contaminated(docs(["one two", "three"]), spark.createDataFrame([(1, "Two")], "item_id int, text string"))
    assert [r["text"] for r in kept.collect()] == ["three"]
    assert kept.columns == docs([]).columns

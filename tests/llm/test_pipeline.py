import random

import public_tokenizers
import sentencepiece

import corpus_pipeline
from pairlab.llm import langid
from tests.llm.test_contamination import words
from tests.llm.test_nearjoin import brute
from tests.llm.test_substrings import brute as repeated

EN = "the of and to in is that it for on was with as by at from this are be which have not".split()
DE = "der die und das von mit ist für auf den ein sich nicht dem auch zu im wird eine bei über straße".split()


def corpus():
    r = random.Random(8)
    made = lambda voc, n: " ".join(r.choice(voc) + r.choice(["", "er", "ing", "ed", "heit", "ly", ","]) for _ in range(n))
    base = [(made(EN, 80), "en") for _ in range(20)] + [(made(DE, 80), "de") for _ in range(20)]
    item = made(EN, 20)
    passage = made(EN, 60)
    rows = base + [base[3], (base[5][0] + " extra", "en"), (made(EN, 40) + " " + item + " x", "en"), ("12345 678 ...", "en"), ("", "de"), (None, "en")]
    rows += [(made(EN, 30) + "\n" + passage + "\n" + made(EN, 30), "en") for _ in range(2)]
    return [(i, t, k) for i, (t, k) in enumerate(rows)], item


def test_stages_against_brute_force(spark, docs, folder, tmp_path):
    rows, item = corpus()
    table = docs([(i, t) for i, t, _ in rows], [k for _, _, k in rows])
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("b1", item)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    judge = langid.Classifier(langid.learn(table))
    left = []
    for i, t, _ in rows:
        lang, score = judge.predict(t)
        if score >= langid.MIN_MARGIN and lang != "und":
            left.append((i, t, lang))
    assert {i for i, _, _ in rows} - {i for i, _, _ in left} >= {43, 44, 45}
    first = {d: c for d, _, c in brute([(i, t) for i, t, _ in left])}
    left = [x for x in left if first[x[0]] == x[0]]
    assert {40, 41}.isdisjoint(i for i, _, _ in left)
    texts = [t for _, t, _ in left]
    removed = repeated(texts)
    assert sum(n > 0 for _, n, _, _ in removed) == 2
    wins = [words(item)[k : k + 10] for k in range(len(words(item)) - 9)]
    has = lambda t: any(words(t)[k : k + 10] in wins for k in range(len(words(t))))
    want = {i for i, t, _ in left if not has(t)}
    assert set(got) == want and 42 not in got
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for (i, t, lang), (size, n, _, _) in zip(left, removed, strict=True):
        if i in got:
            assert got[i]["lang"] == lang
            if not n:
                assert got[i]["ids"] == sp.encode(t)
            else:
                assert len(sp.decode(got[i]["ids"]).encode()) == size - n


def test_stages_keep_the_columns_and_take_empty_tables(spark, docs, tmp_path):
    _, item = corpus()
    spark.createDataFrame([("b1", item)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    none = docs([])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none, str(tmp_path))
        assert out.columns == none.columns
        assert out.count() == 0

from pyspark.sql import functions as F

from pairlab.llm import langid, queries

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = queries.op4_language_id(spark, FOLDER)
    joined = got.filter("held_out").join(queries.table(spark, FOLDER, "documents").select("doc_id", "lang"), "doc_id")
    row = joined.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("acc"), F.avg(F.col("rejected").cast("int")).alias("out"), F.count("*").alias("n")).first()
    assert row["n"] > 250
    assert row["acc"] > 0.95
    assert row["out"] < 0.05


def test_odd_texts(spark, docs):
    train = docs(["the cat sat on the mat and ran", "der Hund und die Katze sind nicht da", None, ""], ["en", "de", "en", "de"])
    model = langid.learn(train)
    assert set(model) == {"en", "de"}
    texts = [None, "", "123 --", "the mat and the cat", "der Hund", "der Hund", "日本語", "the " * 30000]
    got = {r["doc_id"]: r for r in langid.identify(docs(texts), model).collect()}
    assert [got[i]["lang_pred"] for i in range(3)] == ["und"] * 3
    assert all(got[i]["rejected"] and got[i]["score"] == 0 for i in range(3))
    assert [got[i]["lang_pred"] for i in (3, 4, 5)] == ["en", "de", "de"]
    assert got[4]["score"] == got[5]["score"]
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "und") for r in got.values())


def test_no_training_rows(spark, docs):
    model = langid.learn(docs([None, "x"], [None, None]))
    assert model == {}
    assert {r["lang_pred"] for r in langid.identify(docs(["abc", None]), model).collect()} == {"und"}
    assert langid.identify(docs([]), model).count() == 0


def test_a_language_of_copies_has_its_dictionary(spark, docs):
    copies = ["der Hund und die Katze", "sie sind heute nicht da", "und wo ist die Maus"]
    texts = ["the cat sat on the mat"] + [copies[i % 3] for i in range(20_000)]
    model = langid.learn(docs(texts, ["en", *["de"] * 20_000]))
    assert list(model) == ["de", "en"]
    assert all(t.lower().encode() in model["de"] for t in copies)

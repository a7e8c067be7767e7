import zstandard
from pyspark.sql import functions as F

from pairlab.llm import quality, queries, quotes, sharding, warc
from pairlab.session import scratch_path

FOLDER = "/root/testdata/sf0.01"


def test_quality_agrees_with_labels(spark):
    labels = queries.table(spark, FOLDER, "labels").withColumnRenamed("quality", "label")
    row = queries.op1_quality_rules(spark, FOLDER).join(labels, "doc_id").agg(
        F.avg(F.when(F.col("label") == 1, (F.col("kept") | (F.col("n_words") < 20)).cast("int"))).alias("good_kept"),
        F.avg(F.when(F.col("label") == 0, F.col("kept").cast("int"))).alias("bad_kept"),
    ).first()
    assert row["good_kept"] > 0.97
    assert row["bad_kept"] < 0.35


def test_em_recovers_planted_accuracies(spark):
    import random

    r = random.Random(2)
    right = [(0.9, 0.8), (0.8, 0.9), (0.7, 0.95), (0.95, 0.6), (0.85, 0.85)]
    rows = []
    for _ in range(20000):
        y = r.random() < 0.75
        v = [0 if r.random() < 0.2 else ((1 if y else -1) * (1 if r.random() < (a if y else b) else -1)) for a, b in right]
        rows.append(tuple(v))
    names = [f"v{k}" for k in range(5)]
    patterns = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names)).groupBy(*names).count()
    model = quality.fit_label_model(patterns, names, "count", rounds=40)
    assert abs(model.good - 0.75) < 0.03
    assert all(abs(x - y) < 0.06 for got, want in zip(model.right, right) for x, y in zip(got, want))


def test_quality_of_an_empty_table(spark, docs):
    assert quality.judge(docs([])).count() == 0
    got = quality.judge(docs([None, ""]).withColumnRenamed("source", "n_words")).collect()
    assert [r["n_words"] for r in got] == [0, 0]


def test_reply_order(spark):
    rows = [(1, 0, "first point\nsecond point\n\nthird"), (1, 1, "> first point\n> second point\nagreed"), (1, 2, "> > first point\n> agreed\nnot me"), (1, 3, "> third\nme too"), (2, 0, "> agreed\nother conversation"), (None, 4, "> third"), (1, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    got = {(r["conv_id"], r["turn"]): (r["body"], r["parent_turn"], r["root_turn"], r["depth"], r["n_quotes"], r["n_linked"]) for r in quotes.thread(df).collect()}
    assert got == {
        (1, 0): ("first point\nsecond point\n\nthird", None, 0, 0, 0, 0),
        (1, 1): ("agreed", 0, 0, 1, 1, 1),
        (1, 2): ("not me", 1, 0, 2, 2, 2),
        (1, 3): ("me too", 0, 0, 1, 1, 1),
        (2, 0): ("other conversation", None, 0, 0, 1, 0),
        (None, 4): ("", None, 4, 0, 1, 0),
        (1, None): ("x", None, None, 0, 0, 0),
    }
    order = [r["turn"] for r in quotes.in_reply_order(quotes.thread(df.filter("conv_id = 1 and turn is not null"))).collect()]
    assert order == [0, 1, 3, 2]
    assert quotes.thread(df.limit(0)).count() == 0


def test_a_long_chain(spark):
    rows = [(1, 0, "word0 start")] + [(1, k, f"> word{k - 1} start\nword{k} start") for k in range(1, 40)]
    got = quotes.thread(spark.createDataFrame(rows, "conv_id long, turn long, text string"))
    assert sorted((r["turn"], r["depth"], r["root_turn"]) for r in got.collect()) == [(k, k, 0) for k in range(40)]


def test_bundle_is_seekable_and_plain_zstandard():
    writer = warc.BundleWriter(frame_bytes=300)
    data = {f"r{k}": bytes([65 + k]) * (50 + 37 * k) for k in range(20)}
    for k, v in data.items():
        writer.add(k, v)
    content, index = writer.close()
    frames = warc.seek_table(content)
    assert len(frames) > 3
    for x in index:
        frame = warc.read_frame(content, frames[x["frame"]])
        assert frame[x["offset"] : x["offset"] + x["length"]] == data[x["record_id"]]
    reader = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True)
    assert reader.read() == b"".join(data.values())


def test_records_by_id_and_from_files(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://x/{k}", "body" * (k % 7) * 20) for k in range(60)] + [(None, None, None)], "id long, url string, html string")
    path = scratch_path(spark, "warc")
    warc.write_bundles(warc.plan_records(pages, F.col("id"), F.col("url"), F.col("html")), path, frame_bytes=2000, bundle_bytes=9000)
    wanted = spark.createDataFrame([("5",), ("12",), ("none",)], "record_id string")
    got = {r["record_id"]: r for r in warc.read_record(spark, path, wanted).collect()}
    assert set(got) == {"5", "12"}
    assert bytes(got["5"]["payload"]) == b"body" * 100
    assert (got["12"]["record_type"], got["12"]["refers_to"], got["12"]["payload_bytes"]) == ("revisit", "5", 400)
    for r in spark.read.parquet(path).collect():
        (tmp_path / f"{r['bundle_id']}.warc.zst").write_bytes(r["content"])
    assert warc.read_files(spark, str(tmp_path)).count() == 61
    assert warc.read_bundles(spark, path).filter("record_id is null").count() == 1


def test_shards(spark, docs):
    rows = spark.createDataFrame([(k // 3 if k % 5 else None, 1 + (k * 7919) % 100) for k in range(3000)], "k long, size long").repartition(5)
    got = sharding.balanced_shards(rows, "size", ["k"], 7).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(got) == 3000 and len(sizes) == 7 and sizes.max() - sizes.min() <= 200
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    last = got.groupby("shard")["k"].agg(["min", "max"])
    assert all(last["max"].iloc[i] <= last["min"].iloc[i + 1] for i in range(6) if last["min"].notna().iloc[i])
    same = sharding.balanced_shards(spark.createDataFrame([(1, 5)] * 1000, "k long, size long"), "size", ["k"], 4)
    assert sorted(r["count"] for r in same.groupBy("shard").count().collect()) == [250] * 4
    assert sharding.balanced_shards(rows.limit(0), "size", ["k"], 7).count() == 0

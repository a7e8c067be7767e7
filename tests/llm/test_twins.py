"""Queries with a SQL twin on a fixture of odd rows."""

import random

import duckdb
import pytest

from pairlab.llm import queries
from tests.support import compare

R = random.Random(11)
VOCABULARY = ["the", "Of", "and", "é", "ß", "日本", "x", "zebra", "QUOTE", "a,b", "#%", "1.5", "_"]


def say(n):
    return "".join(R.choice(VOCABULARY) + R.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(n))


TEXTS = [None, "", " ", "\n\n", "one", "é" * 50, say(7), say(8), say(9), "a b c d e f g h " * 9, "x\x0by\x0cz\x1cq", "line one\nline one\n \n\nLINE\nline one", "word " * 6000, "ABC DEF!! " * 30]
TEXTS += [say(R.randrange(200)) for _ in range(40)]
TEXTS += TEXTS[:20]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    items = [(f"i{k}", say(R.randrange(25))) for k in range(12)] + [("i90", None), ("i91", TEXTS[30]), ("i91", TEXTS[30])]
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    pages = [(k, f"http://x/{k}\n", t) for k, t in enumerate(TEXTS)] + [(900 + k, None, TEXTS[13]) for k in range(5)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{d}/conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    return d, con


def conversations():
    rows = []
    for c in range(30):
        texts = []
        for turn in range(R.randrange(1, 9)):
            own = "\n".join(R.choice(["Yes.", "No, thanks", "see " + R.choice(VOCABULARY), "", say(5).replace("\n", " ")]) for _ in range(R.randrange(4)))
            if texts and R.random() < 0.8:
                old = R.choice(texts)
                quote = "\n".join(R.choice(["> ", ">", " > "]) + x for x in old.split("\n")[: R.randrange(1, 6)])
                own = R.choice(["", "On Monday, A wrote:\n"]) + quote.upper() + "\n" + own
            texts.append(own)
            rows.append((c, turn, "user", own))
    return [*rows, (99, 0, None, None), (99, 1, "user", ""), (99, 2, "user", "> > >"), (99, 3, "user", "> nothing like it")]


@pytest.mark.parametrize("name", ["op1_quality_rules", "op2_warc_bundles", "op3_quotation_links", "op5_decontamination", "op10_shards"])
def test_twin_on_odd_rows(spark, tables, name):
    folder, con = tables
    got = queries.QUERIES[name](spark, folder).toPandas()
    want = con.execute(queries.ORACLES[name]).fetchdf()
    assert len(got) > 50
    assert compare(got, want) is None
    if name.startswith("op3"):
        assert (got.depth > 1).any() and (got.n_linked > 1).any() and (got.n_linked < got.n_quotes).any()

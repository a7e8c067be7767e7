import hashlib
import random

import public_tokenizers
import pyarrow as pa
import sentencepiece

from pairlab.llm import pieces, queries

ODD = [None, "", " ", "  ", "a", " a", "a ", "  a  b   ", "\n", "a\n b", "▁", "a▁b ▁▁c", "  x", "日本 語", "\U0001f600 ́e", "a\x00b \x00", "x" * 3000, "ab " * 4000, "<s> </s> <unk> <0x41>", "tab\tend\r\n", "﻿z"]


def random_texts(n=150):
    r = random.Random(3)
    alphabet = ["the", "of", "and", " ", "  ", "\n", "é", "ß", "日", "▁", "1", "<s>", "Qu", "zz", "\t", ".", "\U0001f600"]
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(n)]


def test_ids_and_text_equal_the_library(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = ODD + random_texts() + ODD
    got = pieces.decode(pieces.encode(docs(texts))).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = sp.encode(texts[r["doc_id"]] or "")
        assert r["ids"] == ids
        assert r["decoded"] == sp.decode(ids)


def test_a_full_table_changes_nothing():
    small, large = (pieces.ChunkTable(pieces.model_bytes(), n) for n in (1, 10_000))
    for t in random_texts():
        a, b = (table.encode_all(pa.array([t, None, t])) for table in (small, large))
        assert all(x.tolist() == y.tolist() for x, y in zip(a, b, strict=True))
        assert small.decode_all(*a) == large.decode_all(*b)


def test_decode_of_any_ids(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(5)
    rows = [[r.randrange(32000) for _ in range(r.randrange(1, 30))] for _ in range(200)] + [[], [0], [1, 2], [200, 201]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "k int, ids array<int>")
    for x in pieces.decode(df).collect():
        assert x["decoded"] == sp.decode(rows[x["k"]])


def test_query_digests(spark, folder):
    texts = ODD + random_texts(20)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in queries.op6_pieces(spark, folder(texts)).collect():
        ids = sp.encode(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))


def test_empty_table(spark, docs):
    assert pieces.decode(pieces.encode(docs([]))).count() == 0

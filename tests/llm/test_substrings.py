import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pairlab.llm import queries, substrings


def brute(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(np.frombuffer(d, np.uint8)[~gone[1:-1]])
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    say = lambda n: "".join(r.choice("abcdé ßxyz\n") for _ in range(n))
    shared = [say(n) for n in (150, 210, 260, 400, 900)]
    texts = [None, "", "short", say(199), say(200), "ab" * 150, "ab" * 99, "x" * 2000, "x" * 199, "x" * 350]
    for _ in range(60):
        texts.append("".join(r.choice([r.choice(shared), say(r.randrange(120)), say(r.randrange(400))]) for _ in range(r.randrange(1, 6))))
    near = texts[-1] + say(500)
    texts += [near[:k] + "#" + near[k + 1 :] for k in (100, 150, 320, 333, 700) if k < len(near)]
    texts += [texts[4], texts[20], texts[20], say(50) + shared[3][13:390] + say(60), shared[1][:200], shared[1][5:204]]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,chunk,crowded", [(1, 500_000, 500_000), (2, 100, 150), (3, 1, 10**9)])
def test_query_against_brute_force(spark, folder, seed, chunk, crowded, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_WINDOWS", chunk)
    monkeypatch.setattr(substrings, "CROWDED_WINDOWS", crowded)
    texts = corpus(seed)
    want = brute(texts)
    got = queries.op8_suffix_dedup(spark, folder(texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]


def test_equal_windows():
    r = np.random.default_rng(1)
    data = r.integers(97, 99, 4000).astype(np.uint8)
    data[1000:1100] = data[3000:3100]
    at = np.arange(3900)
    got = substrings.equal_windows(data, at, np.zeros(len(at), np.int64), 20)
    seen = Counter(data[i : i + 20].tobytes() for i in at)
    assert got.tolist() == [seen[data[i : i + 20].tobytes()] > 1 for i in at]


def test_pipeline_form(spark, docs):
    r = random.Random(4)
    say = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = "é" * 3 + say(300) + "é" * 3
    texts = ["one " + passage + " end", "two\U0001f600" + passage + "\U0001f600 fin", passage, passage, None, "", "plain", say(500)]
    got = {x["doc_id"]: x for x in substrings.deduplicated(docs(texts)).collect()}
    assert sorted(got) == [0, 1, 4, 5, 6, 7]
    assert (got[0]["text"], got[1]["text"]) == ("one  end", "two\U0001f600\U0001f600 fin")
    assert got[4]["text"] is None and got[7]["text"] == texts[7] and got[0]["n_chars"] == 8
    assert substrings.deduplicated(docs([])).count() == 0

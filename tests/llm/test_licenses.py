import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pairlab.llm import licenses, queries
from pairlab.llm.license_rules import BASE, build_rules

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RULES = build_rules()
LINES = [
    "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "All rights reserved.", "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-2.0-or-later",
    "GNU Lesser General Public License v2.1", "cc by cc by", "Tous droits réservés", "http://creativecommons.org/licenses/by-sa/3.0/",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")",
    "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "Copyright (c) 1998, 2004 Someone", "public domain", "the mit of admit",
]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(text):
    """All rules on the whole text; every detection is held against all that stay."""
    w = words(text)
    base = [(label, k) for label, phrase in BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    line = (" " + " ".join(w) + " ").encode()
    at = lambda place: line[:place].count(b" ")
    kept = []
    for rule in RULES:
        for m in rule.pattern.finditer(line):
            if not any(s <= m.start() and m.end() <= e for s, e, *_ in kept):
                kept.append((m.start(), m.end(), rule.name(m), at(m.start()), at(m.end()), rule.weight))
    return len(w), base, sorted((label, s, e, weight) for _, _, label, s, e, weight in kept)


def corpus(seed=1):
    r = random.Random(seed)
    voc = ["the", "Of", "success", "mit", "é", "日本", "version", "license", "2", "v3", "gnu", "BSD", "creative commons", "copyright 2004"]
    say = lambda n: "".join(r.choice(voc) + r.choice([" ", "\n", "-", ". "]) for _ in range(n))
    texts = [None, "", " ", "...", *LINES, "x y " * 200_000 + LINES[0]]
    texts += [say(r.randrange(20)) + r.choice(LINES) + r.choice([" ", "\n", ""]) + r.choice(LINES) + say(r.randrange(20)) for _ in range(80)]
    return texts + texts[:12]


def test_query_against_brute_force(spark, folder):
    texts = corpus()
    got = queries.op11_license_scan(spark, folder(texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        n, base, found = brute(texts[r["doc_id"]])
        places = [k for _, k in base]
        assert (r["n_words"], r["n_base"]) == (n, len(base))
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for x, _ in base}))
        assert r["labels"] == ",".join(sorted({x for x, _ in base} | {x[0] for x in found}))
        assert r["score"] == max([x[3] for x in found], default=0.0)


def test_detections_and_clashing_columns(spark, docs):
    table = docs([LINES[4], None]).selectExpr("doc_id", "text", "1 as n_words", "2 as Detections", "lang")
    got = {r["doc_id"]: r for r in licenses.scan(table).collect()}
    assert licenses.scan(table).columns == ["doc_id", "lang", "n_words", "base_places", "detections"]
    assert [(d["label"], d["start"], d["end"]) for d in got[0]["detections"]] == [("license-reference", 3, 10), ("gpl-3.0", 6, 12)]
    assert got[1]["detections"] == [] and got[1]["n_words"] == 0
    assert licenses.scan(docs([])).count() == 0


def test_there_are_hundreds_of_rules():
    assert len(RULES) > 400 and len({r.label for r in RULES}) > 150


@settings(max_examples=900, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_keyword_is_part_of_every_match(data):
    rule = data.draw(st.sampled_from(RULES))
    source = rule.pattern.pattern.decode().replace("(?= )", "").replace("\\S+", "[a-z0-9]{1,3}").replace("\\d", "[0-9]")
    text = data.draw(st.from_regex(source, fullmatch=True))
    assert rule.keyword in text, rule.label


@pytest.mark.parametrize("seed", range(20))
def test_intervals(seed):
    r = random.Random(seed)
    kept, mine = [], licenses.Intervals()
    for _ in range(200):
        s = r.randrange(100)
        e = s + r.randrange(1, 30)
        inside = any(a <= s and e <= b for a, b in kept)
        assert mine.contain(s, e) == inside
        if not inside:
            kept.append((s, e))
            mine.add(s, e)

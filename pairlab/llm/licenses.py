"""License scan: ordered signature rules behind a keyword automaton.

Texts become lower-case words with one space between them. One pass of an Aho-Corasick
automaton over these finds which keywords occur; only rules whose keyword does are
searched. Detections overlap, so they are settled by priority: in the order of the rules, a
detection is dropped when an earlier one that stays contains its interval. The phrases of
``license_rules.BASE`` are counted apart, and their labels always stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pairlab.llm.kernels import slices, without
from pairlab.llm.license_rules import BASE, Rule, build_rules

SLICE_BYTES = 2 << 20
#: A-Z lower-cased; every other ASCII byte that is neither letter nor digit parts words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
FOUND = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("weight", T.DoubleType())]))
ADDED = {"n_words": T.LongType(), "base_places": T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.IntegerType())])), "detections": FOUND}


def normalise(text: bytes) -> tuple[bytes, int]:
    """Words with one space before, between and after, and their number."""
    words = text.translate(TABLE).split(b" ")
    words = [w for w in words if w]
    return b" " + b" ".join(words) + b" ", len(words)


class Scanner:
    """Compiled rules and their keyword automaton, made once for a worker."""

    def __init__(self, rules: list[Rule]) -> None:
        self.rules = rules
        self.base = [(label, re.compile(f" {phrase}(?= )".encode()), phrase) for label, phrase in BASE]
        self.gate = ahocorasick.Automaton()
        wanted: dict[str, list[int]] = {}
        for k, rule in enumerate(rules):
            wanted.setdefault(rule.keyword, []).append(k)
        for k, (_, _, phrase) in enumerate(self.base):
            wanted.setdefault(phrase, []).append(-1 - k)
        for word, numbers in wanted.items():
            # bytes are scanned as one character each, so places are those of the bytes
            self.gate.add_word(word.encode().decode("latin-1"), tuple(numbers))
        self.gate.make_automaton()

    def scan(self, words: bytes) -> tuple[list[tuple[str, int]], list[tuple[str, int, int, float]]]:
        """Places (label, first word) of the base phrases, and detections (label, first word, end, weight) that stay."""
        opened = {numbers for _, numbers in self.gate.iter(words.decode("latin-1"))}
        if not opened:
            return [], []
        numbers = sorted(k for group in opened for k in group)
        starts = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)  # word k begins after space k
        word = lambda at: int(np.searchsorted(starts, at))
        base = [(self.base[-1 - k][0], word(m.start())) for k in numbers if k < 0 for m in self.base[-1 - k][1].finditer(words)]
        kept = Intervals()
        out = []
        for k in numbers:
            if k < 0:
                continue
            rule = self.rules[k]
            for m in rule.pattern.finditer(words):
                if kept.contain(m.start(), m.end()):
                    continue
                kept.add(m.start(), m.end())
                out.append((rule.name(m), word(m.start()), word(m.end()), rule.weight))
        return base, sorted(out, key=lambda d: (d[1], -d[2], d[0]))


class Intervals:
    """Intervals none of which lies in another one; asks and adds by binary search."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []  # both rise

    def contain(self, start: int, end: int) -> bool:
        k = bisect_left(self.ends, end)  # the first that ends late enough starts earliest
        return k < len(self.ends) and self.starts[k] <= start

    def add(self, start: int, end: int) -> None:
        """An interval that none contains; the ones inside it need no place any more."""
        low = bisect_left(self.starts, start)
        high = low
        while high < len(self.starts) and self.ends[high] <= end:
            high += 1
        self.starts[low:high] = [start]
        self.ends[low:high] = [end]


@cache
def scanner() -> Scanner:
    return Scanner(build_rules())


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, base_places (label, start) and detections (label, start, end, weight) to every row, without the text.

    Places are word numbers from 0, ``end`` is one past the last. Null and empty texts have no
    words and empty lists; every row stays, repeated rows too; columns with the added names are
    replaced. Whole texts are scanned, a slice of rows at a time.
    """
    docs = without(docs, *ADDED)
    keep = [c for c in docs.columns if c != text]
    schema = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(n, t) for n, t in ADDED.items()]])
    base_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32())]))
    found_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, text, SLICE_BYTES):
                count, base, found = [], [], []
                for t in b.column(text).cast(pa.binary()).to_pylist():
                    words, n = normalise(t or b"")
                    places, detections = scanner().scan(words)
                    count.append(n)
                    base.append([{"label": x, "start": s} for x, s in places])
                    found.append([{"label": x, "start": s, "end": e, "weight": w} for x, s, e, w in detections])
                cols = [pa.array(count, pa.int64()), pa.array(base, base_type), pa.array(found, found_type)]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *cols], schema.names)

    return docs.select(*keep, text).mapInArrow(run, schema)

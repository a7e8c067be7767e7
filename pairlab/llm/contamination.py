"""Which documents hold passages of a benchmark: a prefix-filtered set join.

Every distinct window of an item is a set of word pairs (a single word where the window is
one word). Containment of a whole window needs all its pairs, so a prefix of one pair is
enough to look for: the one that is rarest over all documents. A document place with such
a pair is checked with the window's bounds (its start and end must lie in the document)
and then word by word.

The benchmark is cut into blocks of at most ``BLOCK_BYTES`` of text by a hash; each block is
collected, sent to the tasks and held against all documents in the same stage. Documents
are never shuffled. Only the counts of the block's own pairs move.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.kernels import lower_table, slices, without

WINDOW = 10
BLOCK_BYTES = 2 << 20
#: A-Z to a-z; digits, letters and all bytes from 0x80 are word bytes, the rest separates.
FOLD = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in lower_table())
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Windows:
    """Word numbers, distinct windows and their pairs of one block of items."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int) -> None:
        self.number: dict[bytes, int] = {}
        self.owners: dict[tuple[int, ...], set[str | None]] = defaultdict(set)
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            size = min(window, len(ids))
            for k in range(len(ids) - size + 1 if size else 0):
                self.owners[tuple(ids[k : k + size])].add(item)
        self.base = len(self.number) + 1

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """One code for each neighbouring pair; 0 where a word is not of the block."""
        a, b = ids[:-1], ids[1:]
        return np.where((a > 0) & (b > 0), a * self.base + b, 0)

    def parts(self, win: tuple[int, ...]) -> list[int]:
        """The set of a window: pair codes, or the negative word number of a single word."""
        return [a * self.base + b for a, b in zip(win, win[1:], strict=False)] or [-win[0]]

    def ids_of(self, words: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))


def _counts(docs: DataFrame, text: str, block: list, window: int) -> dict[int, int]:
    """Occurrences of the block's pairs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Windows(block, window)
        known = np.array(sorted({p for win in w.owners for p in w.parts(win)}), np.int64)
        total = np.zeros(len(known), np.int64)
        for whole in batches:
            for b in slices(whole, text):
                for t in b.column(text).cast(pa.binary()).to_pylist():
                    ids = w.ids_of(words_of(t))
                    for got in (w.codes(ids), -ids):
                        got = got[got != 0]
                        if len(got):
                            at = np.minimum(np.searchsorted(known, got), len(known) - 1)
                            total += np.bincount(at[known[at] == got], minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(total)], ["code", "n"])

    found = docs.select(text).mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    return {r["code"]: r["n"] for r in found.collect()}  # as many as the block has pairs


def _mark(docs: DataFrame, text: str, block: list, window: int) -> DataFrame:
    counts = _counts(docs, text, block, window)
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("_n", T.LongType()), T.StructField("_s", SPANS), T.StructField("_i", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Windows(block, window)
        prefix: dict[int, dict[tuple[int, int], dict[bytes, tuple]]] = defaultdict(lambda: defaultdict(dict))
        for win, owners in w.owners.items():
            parts = w.parts(win)
            k = min(range(len(parts)), key=lambda i: (counts.get(parts[i], 0), parts[i]))
            prefix[parts[k]][(k, len(win))][np.array(win, np.int64).tobytes()] = tuple(owners)
        needed = np.array(sorted(prefix), np.int64)
        for whole in batches:
            for b in slices(whole, text):
                n, spans, items = [], [], []
                for t in b.column(text).cast(pa.binary()).to_pylist():
                    ids = w.ids_of(words_of(t))
                    hit, owners = [], set()
                    if len(needed) and len(ids):
                        for got in (w.codes(ids), -ids):
                            if not len(got):
                                continue
                            at = np.minimum(np.searchsorted(needed, got), len(needed) - 1)
                            for p in np.flatnonzero((needed[at] == got) & (got != 0)).tolist():
                                for (k, size), wins in prefix[int(got[p])].items():
                                    start = p - k
                                    if start < 0 or start + size > len(ids):
                                        continue
                                    own = wins.get(ids[start : start + size].tobytes())
                                    if own is not None:
                                        hit.append((start, start + size))
                                        owners.update(own)
                    n.append(len(ids))
                    spans.append([{"start": s, "end": e} for s, e in _union(hit)])
                    items.append(sorted(x for x in owners if x is not None))
                added = [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*b.columns, *added], [*names, "_n", "_s", "_i"])

    return docs.mapInArrow(run, schema)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(set(spans)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def blocks_of(items: DataFrame, item_id: str, text: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items in blocks of about ``block_bytes`` of text, dealt by a hash."""
    some = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("binary").alias("t")).filter("octet_length(t) > 0").distinct()
    total = some.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-int(total) // block_bytes)
    for k in range(n):
        yield [(r["i"], bytes(r["t"])) for r in some.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()]


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Adds n_words, hit_spans (word positions, start and end) and hit_items (sorted ids) to every document.

    A window is ``window`` consecutive words of an item; a shorter item is one window, an item
    without words none. Null texts have no words. Repeated items count once; items without
    an id mark words but are not listed. Without items nothing is hit.
    """
    docs = without(docs, "n_words", "hit_spans", "hit_items")
    out, names = docs, docs.columns
    step = None
    for block in blocks_of(items, item_id, item_text):
        marked = _mark(out.select(*names), text, block, window) if step is None else None
        if step is not None:  # next block: the same rows once more, findings side by side
            kept = out.select(*names, "_n", "_s", "_i").withColumnsRenamed({"_n": "_n0", "_s": "_s0", "_i": "_i0"})
            marked = _mark(kept, text, block, window).select(
                *names, "_n", F.concat("_s0", "_s").alias("_s"), F.array_union("_i0", "_i").alias("_i")
            )
        out = step = marked
    if step is None:
        step = _mark(docs, text, [], window)
    return step.select(*names, F.col("_n").alias("n_words"), F.col("_s").alias("hit_spans"), F.array_sort("_i").alias("hit_items"))


def words_hit(spans) -> Column:
    """Words inside at least one of the spans (they may overlap when several blocks found them)."""
    state = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("int").alias("to"))
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["to"]), F.lit(0))).alias("n"), F.greatest(a["to"], s["end"]).alias("to")
    )
    return F.aggregate(F.array_sort(spans), state, step, lambda a: a["n"])


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Filter: documents without any hit, in their own columns."""
    return contaminated(docs, items).filter(F.size("hit_spans") == 0).select(*docs.columns)

"""Long repeated substrings: a sampled suffix array over all documents.

A byte goes when some ``LENGTH``-byte string over it also starts elsewhere. Sorting every
suffix would move the corpus many times over, so only sampled suffixes are sorted: each
window of ``LENGTH`` bytes is assigned to the suffix that starts at its anchor, the place of
its smallest hash of ``LEAD`` bytes (the leftmost of equals). The choice depends on the
window's bytes alone, so equal windows have equal anchors at equal offsets. Consecutive
windows with one anchor form its context, about 85 windows in 285 bytes.

1. Anchors are counted by the hash of their leading bytes; a suffix whose lead is unique
   repeats nothing. Contexts that agree as a whole are covered as a whole.
2. What differs (the ends of repeated passages) is fetched as bytes. Spark samples splitters
   and range-partitions these suffixes by their leading token; inside a bucket a multikey
   quicksort over 8-byte tokens finds the equal windows. One lead never crosses a bucket
   boundary, except leads with very many windows: these are compared across all buckets by
   counting 128-bit fingerprints of their windows, pre-aggregated before the shuffle.
3. Covered stretches go back to their documents.

Lead and context hashes have 64 bits each, of different kinds, and both must agree. Texts are
looked at in pieces of ``PIECE`` windows, so a long one takes no more memory than a short one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.kernels import K1, K2, eights, free_memory, mix, packed, range_hashes, slices, text_bytes, without
from pairlab.session import truncate_lineage

LENGTH, LEAD = 200, 48
SLICE_BYTES = 1 << 18
PIECE = 1 << 18  # windows of a long text that are looked at together
CHUNK_WINDOWS = 500_000  # windows sorted at once
BROADCAST_CONTEXTS = 1_000_000  # places of contexts, about 120 bytes each
CROWDED_WINDOWS = 500_000  # leads with more windows than that are compared across buckets
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def sliding_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of the ``width`` (8 or more) bytes from every place: windows of 8, 16, 32 ... are joined and mixed."""

    def join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = x * K1 + y
        z ^= z >> np.uint64(31)
        z *= K2
        return z

    with np.errstate(over="ignore"):
        parts = {8: join(eights(data)[: len(data) - 7], np.uint64(8))}
        span = 8
        while 2 * span <= width:
            parts[2 * span] = join(parts[span][:-span], parts[span][span:])
            span *= 2
        n = len(data) - width + 1
        out, done = parts[span][:n], span
        if done < width:  # the last bytes once more, in a window that overlaps
            rest = max(k for k in parts if k <= width - done) if width - done >= 8 else 8
            while done < width:
                at = min(done, width - rest)
                out = join(out, parts[rest][at : at + n])
                done = at + rest
        return mix(out)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def pieces_of(offsets: np.ndarray, length: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of stretches of at most ``piece`` windows that together hold every window of every row once."""
    windows = np.maximum(np.diff(offsets) - length + 1, 0)
    n = -(-windows // piece)
    rows = np.repeat(np.arange(len(n)), n)
    first = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * piece
    return rows, offsets[rows] + first, offsets[rows] + np.minimum(first + piece, windows[rows]) + length - 1


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, lead: int = LEAD, piece: int = PIECE) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, lead hash, context hash, first window, number of windows) of every anchor of the rows.

    Long rows come in pieces: a context that crosses the border of two is parted there, which
    only makes it differ from its equals as a whole.
    """
    rows, begin, end = pieces_of(offsets, length, piece)
    size = end - begin
    k = 0
    while k < len(rows):
        stop = max(k + 1, int(np.searchsorted(np.cumsum(size[k:]), piece + length, "right")) + k)
        at = np.repeat(begin[k:stop] - np.concatenate([[0], np.cumsum(size[k:stop])[:-1]]), size[k:stop]) + np.arange(size[k:stop].sum())
        local = np.concatenate([[0], np.cumsum(size[k:stop])])
        row, h, x, first, count = _anchors(data[at], local, length, lead)
        yield rows[k:stop][row], h, x, first + (begin - offsets[rows])[k:stop][row], count
        k = stop


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int, lead: int) -> tuple[np.ndarray, ...]:
    """The same for rows of at least ``length`` bytes that fit into memory together (fewer than 2^24 bytes)."""
    h = sliding_hashes(data, lead)
    place = np.uint64((1 << 24) - 1)
    key = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    anchor = (_sliding_min(key, length - lead + 1) & place).astype(np.int64)
    size = np.diff(offsets)
    p = np.arange(len(anchor))
    valid = p + length <= np.repeat(offsets[1:], size)[: len(anchor)]
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    first[offsets[:-1]] = True  # every row has a window
    starts = np.flatnonzero(first)
    count = np.add.reduceat(valid, starts)
    a = anchor[starts]
    x = range_hashes(data, starts, starts + count - 1 + length) ^ mix(((a - starts) * 65536 + count).astype(np.uint64))
    rows = np.searchsorted(offsets, starts, "right") - 1
    return rows, h[a], x, starts - offsets[rows], count


def equal_windows(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the ``length``-byte strings at ``at`` occur at least twice inside their ``group``.

    Multikey quicksort on tokens of eight bytes: each round sorts the strings that are still
    equal to others by their next token, and drops those that stand alone.
    """
    out = np.zeros(len(at), bool)
    live = np.arange(len(at))
    part = group
    depth = 0
    while len(live):
        if depth:
            lo = 8 * (depth - 1)
            token = np.zeros(len(live), np.uint64)
            for k in range(lo, min(lo + 8, length)):
                token = token << np.uint64(8) | data[at[live] + k]
            order = np.lexsort((token, part))
            live, part, token = live[order], part[order], token[order]
            new = np.concatenate([[True], (part[1:] != part[:-1]) | (token[1:] != token[:-1])])
        else:
            order = np.argsort(part, kind="stable")
            live, part = live[order], part[order]
            new = np.concatenate([[True], part[1:] != part[:-1]])
        number = np.cumsum(new) - 1
        many = np.bincount(number)[number] > 1
        live, part = live[many], number[many]
        if 8 * depth >= length:
            out[live] = True
            break
        depth += 1
    return out


def _anchor_rows(docs: DataFrame, text: str, length: int, lead: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, text, SLICE_BYTES):
                for rows, h, x, start, n in anchors(*text_bytes(b.column(text)), length, lead):
                    ids = b.column("_row").to_numpy()[rows]
                    cols = [ids, h.view(np.int64), x.view(np.int64), start.astype(np.int32), n.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["_row", "h", "x", "start", "n"])
        free_memory()

    return docs.select("_row", text).mapInArrow(run, "_row bigint, h bigint, x bigint, start int, n int")


CONTEXTS = "h bigint, copies bigint, _row bigint, start int, n int, bytes binary"


def _contexts(docs: DataFrame, wanted: DataFrame, text: str, length: int) -> DataFrame:
    """The bytes of the contexts in ``wanted`` (h, copies, _row, start, n)."""
    by_row = wanted.groupBy("_row").agg(F.collect_list(F.struct("h", "copies", "start", "n")).alias("c"))  # of one document
    if wanted.count() <= BROADCAST_CONTEXTS:  # else the texts are shuffled to them
        by_row = F.broadcast(by_row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CONTEXTS.split(", ")]
        for whole in batches:
            for b in slices(whole, text, SLICE_BYTES):
                out = []
                for row, t, c in zip(b.column("_row").to_pylist(), b.column(text).cast(pa.binary()).to_pylist(), b.column("c").to_pylist(), strict=True):
                    out += [(x["h"], x["copies"], row, x["start"], x["n"], t[x["start"] : x["start"] + x["n"] - 1 + length]) for x in c]
                cols = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return docs.select("_row", text).join(by_row, "_row").mapInArrow(run, CONTEXTS)


def _windows(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Bytes, window places, context of each window and its place in the document."""
    data, offsets = text_bytes(part.column("bytes"))
    n = part.column("n").to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    inside = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    return data, offsets[owner] + inside, owner, part.column("start").to_numpy().astype(np.int64)[owner] + inside


def _spans_of(rows: np.ndarray, places: np.ndarray, length: int) -> pa.RecordBatch:
    """Runs of neighbouring windows as (_row, start, end)."""
    if not len(rows):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int32())], ["_row", "start", "end"])
    order = np.lexsort((places, rows))
    rows, places = rows[order], places[order]
    new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (places[1:] > places[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows)) - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[first]), pa.array(places[first].astype(np.int32)), pa.array((places[last] + length).astype(np.int32))], ["_row", "start", "end"]
    )


FOUND = "_row bigint, start int, end int"


def _sorted_buckets(contexts: DataFrame, length: int) -> DataFrame:
    """Covered stretches of contexts that occur once, from buckets of whole leads."""

    def solve(part: pa.RecordBatch) -> pa.RecordBatch:
        data, at, owner, place = _windows(part)
        group = part.column("h").to_numpy()[owner]
        same = equal_windows(data, at, group, length)
        same |= part.column("copies").to_numpy()[owner] > 1
        once = same & (part.column("copies").to_numpy()[owner] == 1)
        return _spans_of(part.column("_row").to_numpy()[owner[once]], place[once], length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(pa.compute.sum(x.column("n")).as_py() or 0 for x in held) < CHUNK_WINDOWS:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            h = whole.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1], "left"))  # the last lead may go on in the next batch
            if cut:
                yield solve(whole.slice(0, cut))
            held = [whole.slice(cut)]
        if held and sum(b.num_rows for b in held):
            yield solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return contexts.repartitionByRange("h").sortWithinPartitions("h").mapInArrow(run, FOUND)


def _across_buckets(contexts: DataFrame, length: int) -> DataFrame:
    """The same for crowded leads: equal windows meet by fingerprint, counted before they move."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at_row in range(0, whole.num_rows, 2000):
                b = whole.slice(at_row, 2000)
                data, at, owner, place = _windows(b)
                f, g = (range_hashes(data, at, at + length, seed) for seed in (1, 2))
                cols = [b.column("h").to_numpy()[owner], f.view(np.int64), g.view(np.int64), b.column("copies").to_numpy()[owner], b.column("_row").to_numpy()[owner], place]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", "f", "g", "copies", "_row", "place"])

    made = contexts.mapInArrow(prints, "h bigint, f bigint, g bigint, copies bigint, _row bigint, place bigint")
    many = made.groupBy("h", "f", "g").agg(F.sum("copies").alias("all")).filter("all > 1").select("h", "f", "g")
    hit = made.filter("copies = 1").join(many, ["h", "f", "g"])
    return hit.select("_row", F.col("place").cast("int").alias("start"), (F.col("place") + length).cast("int").alias("end"))


def repeated(docs: DataFrame, text: str, length: int = LENGTH, lead: int = LEAD) -> DataFrame:
    """(_row, spans): the covered stretches of every row (column ``_row``) that has any; they may touch or overlap."""
    found = _anchor_rows(docs, text, length, lead)
    leads = found.groupBy("h").agg(F.count("*").alias("k"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    # written, so that the join below reads two plain shuffles and a hot lead can be split
    leads = truncate_lineage(leads.filter("k > 1").select("h", (F.col("lo") != F.col("hi")).alias("mixed")))
    again = truncate_lineage(found.join(leads, "h"))
    mixed = again.filter("mixed")
    contexts = mixed.groupBy("h", "x").agg(F.count("*").alias("copies"), F.min(F.struct("_row", "start", "n")).alias("one"))
    contexts = truncate_lineage(contexts)
    copied = mixed.join(contexts.filter("copies > 1").select("h", "x"), ["h", "x"])
    whole = again.filter("not mixed").select("_row", "start", "n").unionByName(copied.select("_row", "start", "n"))
    parts = [whole.select("_row", "start", (F.col("start") + F.col("n") - 1 + length).cast("int").alias("end"))]
    windows = contexts.groupBy("h").agg(F.sum("one.n").alias("w"))
    crowded = windows.filter(F.col("w") > CROWDED_WINDOWS).select("h")
    wanted = contexts.select("h", "copies", "one.*")
    texts = _contexts(docs, wanted, text, length)
    if crowded.isEmpty():
        parts.append(_sorted_buckets(texts, length))
    else:
        texts = truncate_lineage(texts)
        parts.append(_sorted_buckets(texts.join(crowded, "h", "left_anti"), length))
        parts.append(_across_buckets(texts.join(crowded, "h"), length))
    every = reduce(DataFrame.unionByName, parts)
    return truncate_lineage(every.groupBy("_row").agg(F.collect_list(F.struct("start", "end")).alias("spans")))  # of one document


def merge(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, lead: int = LEAD) -> DataFrame:
    """Adds removed_spans (byte positions, merged) and kept (the remaining bytes) to every row, without the text.

    Null texts are empty; texts shorter than ``length`` bytes stay whole; of equal texts that
    long nothing stays. ``docs`` must give the same rows in the same order each time it is
    read (a table, a checkpoint). Columns with the added names are replaced.
    """
    keep = without(docs, "removed_spans", "kept", text).columns
    docs = packed(docs.select(*[F.col(f"`{c}`") for c in keep], text), text).withColumn("_row", F.monotonically_increasing_id())
    joined = docs.join(repeated(docs.select("_row", text), text, length, lead), "_row", "left")
    schema = T.StructType([docs.schema["_user"], T.StructField("removed_spans", SPANS), T.StructField("kept", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for whole in batches:
            for b in slices(whole, text, SLICE_BYTES):
                gone, left = [], []
                for t, spans in zip(b.column(text).cast(pa.binary()).to_pylist(), b.column("spans").to_pylist(), strict=True):
                    t, cut = t or b"", merge(spans)
                    at = [0, *[x for s in cut for x in s], len(t)]
                    left.append(b"".join(t[at[k] : at[k + 1]] for k in range(0, len(at), 2)))
                    gone.append([{"start": s, "end": e} for s, e in cut])
                yield pa.RecordBatch.from_arrays([b.column("_user"), pa.array(gone, kind), pa.array(left, pa.binary())], schema.names)
        free_memory()

    return joined.select("_user", text, "spans").mapInArrow(run, schema).select("_user.*", "removed_spans", "kept")


def deduplicated(docs: DataFrame) -> DataFrame:
    """Pipeline form: documents with the remaining text, in their own columns.

    A cut inside a character takes the rest of the character along. Documents of which
    nothing but white space remains go, if something was removed; all others stay, repeated
    rows, null and empty texts too. ``n_chars`` follows the text where that column exists.
    """
    names = docs.columns
    found = remove_repeats(docs.select(F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("rest"), F.col("text").isNull().alias("none"), "text"))
    changed = F.size("removed_spans") > 0
    left = F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "\ufffd", "")
    whole = F.when(changed, left).when(~F.col("none"), F.col("kept").cast("string"))
    out = found.select("rest", whole.alias("now"), changed.alias("changed")).filter("not changed or trim(now) <> ''")
    size = {c: F.char_length("now").cast(docs.schema[c].dataType) for c in names if c == "n_chars"}
    return out.select(*[F.col("now").alias(c) if c == "text" else size.get(c, F.col("rest").getField(c)).alias(c) for c in names])

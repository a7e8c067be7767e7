"""Jaccard self-join of word-shingle sets by partition-and-enumerate signatures.

Two sets of sizes a and b with a similarity of 3/4 or more differ in at most (a + b) / 7
elements. Sizes fall into bands; for each band the shingle domain is cut by a hash into more
parts than two such sets can differ in, so they agree on whole parts. One part with its
elements is one signature (subsets of size one out of single parts: the form with the
fewest signatures for this threshold). A set just above a band's end also signs in the
band below.

A band has more parts than needed (``MARGIN``): similar sets agree on several, so a set may
leave out some signatures without losing a partner. All sets leave out in one order: empty
parts by number and then, most frequent first, the signatures that more than ``FREQUENT``
sets share (passages that many documents have), so the last one in this order that two
similar sets share is kept by both. For the frequent signatures that it must keep, a set is held
against the smallest member first. Then comes a contraction: in every signature with several
components, all members outside its largest component are held against a few members of
that component. What is left outside is compared with all members of other components in blocks. So a large
family of near copies costs two linear passes, and only its outliers meet it pair by pair.

Equal sets are one set throughout. Candidates are dropped when coarse counts of their
shingles prove too large a difference; the rest are verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.kernels import free_memory, lower_table, mix, packed, range_hashes, slices, text_bytes, without, word_spans
from pairlab.operators.graph import connected_components
from pairlab.session import truncate_lineage

WORDS = 5
MARGIN = 1.15
FREQUENT = 16
SKETCH = 64  # least number of classes
BLOCK = 512
PIVOTS = 8  # members that a signature's minor members are held against before the blocks
SLICE_BYTES = 1 << 20
RANGES = 8  # ranges of parts that a band's signatures are dealt to
GROUP_SIGNATURES = 1_000_000  # about the most signatures of one group: ranges are split by signature bits to get there
BROADCAST_ROWS = 500_000  # pairs of row number and set name, 16 bytes each
ROWS_PER_TASK = 20_000  # small tables of names are read in few partitions: every shuffle writes files for each
LOWER_SIGS = 16  # of a member's smaller signatures so many go along, to list a pair once
BLOCK_CLASSES = 256  # most classes of a sketch that goes to the blocks
LOWER = np.frombuffer(lower_table(), np.uint8)
IS_WORD = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
SALT = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)]


def shingle_sets(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every row and the offsets of the rows; sorted inside a row.

    A shingle is the hash of five consecutive words; a text of fewer words is one shingle.
    """
    data, offsets = text_bytes(batch.column(text))
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets, IS_WORD)
    n_rows = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n_rows + 1, np.int64)
    h = range_hashes(data, starts, ends)
    count = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(count)])
    length = np.minimum(WORDS, count)
    ok = (np.arange(len(h)) + length[rows]) <= first[rows + 1]
    at = np.flatnonzero(ok)
    value = length[rows[at]].astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WORDS):
            use = k < length[rows[at]]
            value = np.where(use, mix(value * SALT[0] + h[np.minimum(at + k, len(h) - 1)]), value)
    owner = rows[at]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_rows))])


def _sums(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(value, dtype=np.uint64)])
        return total[offsets[1:]] - total[offsets[:-1]]


def set_ids(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit name of each set: equal for equal sets."""
    size = np.diff(offsets).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mix(mix(_sums(mix(value ^ SALT[1]), offsets) + size) ^ _sums(mix(value ^ SALT[2]), offsets)).view(np.int64)


def sketches(value: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """How many shingles of each set fall into each of its classes, 255 at most.

    A set has a power of two of classes, one for two shingles at least; a longer sketch
    folds into a shorter one.
    """
    size = np.diff(offsets)
    width = 1 << np.ceil(np.log2(np.maximum(size / 2, SKETCH))).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(width)])
    at = np.repeat(base[:-1], size) + ((mix(value ^ SALT[3]) >> np.uint64(32)).astype(np.int64) & np.repeat(width - 1, size))
    count = np.minimum(np.bincount(at, minlength=base[-1]), 255).astype(np.uint8)
    return [count[x:y].tobytes() for x, y in zip(base[:-1], base[1:], strict=True)]


def fold(sketch: bytes, width: int) -> np.ndarray:
    return np.frombuffer(sketch, np.uint8).reshape(-1, width).sum(0, dtype=np.int32)


class Band:
    """Sizes [2^j, 2^(j+1)) and the larger sizes that can match them."""

    def __init__(self, j: int) -> None:
        self.j, self.low, top = j, 1 << j, (2 << j) - 1
        self.high = top * 4 // 3
        self.parts = int(MARGIN * ((top + self.high) // 7 + 1)) + 1

    def spare(self, size: np.ndarray) -> np.ndarray:
        """Signatures that a set may leave out: parts it shares with any partner, less one."""
        return self.parts - (size + np.minimum(size * 4 // 3, self.high)) // 7 - 1


def signatures(value: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each band: its number, rows and spare signatures of its sets, then owner (index into rows), signature and range of parts."""
    size = np.diff(offsets)
    own = np.full(len(size), -1)
    own[size > 0] = np.floor(np.log2(size[size > 0])).astype(int)
    for j in range(int(own.max(initial=-1)) + 1):
        band = Band(j)
        rows = np.flatnonzero((own == j) | ((own == j + 1) & (size <= band.high)))
        if not len(rows):
            continue
        n = size[rows]
        take = np.repeat(offsets[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        v, owner = value[take], np.repeat(np.arange(len(rows)), n)
        part = ((mix(v ^ SALT[0]) >> np.uint64(32)) * np.uint64(band.parts) >> np.uint64(32)).astype(np.int64)
        key = owner * band.parts + part
        order = np.argsort(key, kind="stable")
        key, v = key[order], v[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(mix(v), at)
        key = key[at]
        spare = band.spare(n)
        empty = band.parts - np.bincount(key // band.parts, minlength=len(rows))
        short = np.flatnonzero(empty > spare)
        if len(short):  # too many empty parts to leave out: the first ones use up the spare, the others sign as well
            every = (short[:, None] * band.parts + np.arange(band.parts)).ravel()
            every = every[~np.isin(every, key)]
            n_empty = empty[short]
            place = np.arange(len(every)) - np.repeat(np.cumsum(n_empty) - n_empty, n_empty)
            every = every[place >= np.repeat(spare[short], n_empty)]
            key, sums = np.concatenate([key, every]), np.concatenate([sums, np.zeros(len(every), np.uint64)])
            spare[short] = empty[short] = 0
        with np.errstate(over="ignore"):
            sig = mix(sums ^ mix((key % band.parts + (j << 32)).astype(np.uint64)))
        yield j, rows, spare - empty, key // band.parts, sig, key % band.parts * RANGES // band.parts


def describe(docs: DataFrame, text: str) -> DataFrame:
    """Every row with n_shingles, set_id (null without words) and sketch, without the text."""
    keep = [c for c in docs.columns if c != text]
    added = [T.StructField("n_shingles", T.LongType()), T.StructField("set_id", T.LongType()), T.StructField("sketch", T.BinaryType())]
    schema = T.StructType([*[docs.schema[c] for c in keep], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, text, SLICE_BYTES):
                value, offsets = shingle_sets(b, text)
                n = np.diff(offsets)
                cols = [pa.array(n), pa.array(set_ids(value, offsets), mask=n == 0), pa.array(sketches(value, offsets), pa.binary())]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *cols], schema.names)
        free_memory()

    return docs.mapInArrow(run, schema)


PACKED = "bucket int, sigs binary, owners binary, sets binary, sizes binary, spares binary, known binary"


def band_splits(table: DataFrame) -> list[int]:
    """For each band, the shares that its ranges are split into, from the counted sets of ``table``.

    A set has at most one signature for each part, so a share has about ``GROUP_SIGNATURES`` at most.
    """
    sets = table.filter("set_id is not null").select("n_shingles", (F.length(F.bin("n_shingles")) - 1).alias("j"))
    below = F.col("n_shingles") <= F.expr("(shiftleft(1L, j) - 1) * 4 div 3")  # also signs in the band below
    found = {r["j"]: r for r in sets.withColumn("below", below).groupBy("j").agg(F.count("*").alias("n"), F.count_if("below").alias("below")).collect()}
    out = []
    for j in range(max(found, default=-1) + 1):
        parts = Band(j).parts
        n = sum(found[k][c] for k, c in ((j, "n"), (j + 1, "below")) if k in found)
        out.append(1 + n * parts // (min(RANGES, parts) * GROUP_SIGNATURES))
    return out


def first_buckets(splits: list[int]) -> np.ndarray:
    """Number of each band's first bucket."""
    return RANGES * np.cumsum([0, *splits])[:-1]


def _signed(docs: DataFrame, text: str, splits: list[int], frequent: int) -> DataFrame:
    """Packed signatures by bucket: one row for each bucket of a slice.

    A bucket is a band, a range of its parts and one of the band's ``splits`` shares of the signatures.
    Signatures keep 48 bits (a chance agreement only adds a candidate). What one slice shows
    to be frequent goes to the buckets of negative numbers; their rows are dealt to as many
    lots as the band has shares, because one signature may have them all.
    """
    base = first_buckets(splits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, text, SLICE_BYTES):
                value, offsets = shingle_sets(b, text)
                ids, size = set_ids(value, offsets), np.diff(offsets)
                out = []
                for j, rows, spare, owner, sig, span in signatures(value, offsets):
                    _, one = np.unique(ids[rows], return_index=True)  # equal sets sign once
                    to = np.full(len(rows), -1)
                    to[one] = np.arange(len(one))
                    use = to[owner] >= 0
                    owner, sig, span = to[owner[use]], sig[use], span[use]
                    sets, sizes, spares = ids[rows[one]], size[rows[one]].astype(np.int32), spare[one].astype(np.int32)
                    bucket = base[j] + span * splits[j] + (sig >> np.uint64(32)).astype(np.int64) % splits[j]
                    sig = sig & np.uint64((1 << 48) - 1)
                    order = np.lexsort((sig, bucket))
                    owner, sig, bucket = owner[order], sig[order], bucket[order]
                    new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (bucket[1:] != bucket[:-1])])
                    number = np.cumsum(new) - 1
                    hot = np.bincount(number)[number] > frequent
                    buckets, at = np.unique(bucket, return_index=True)
                    for k, x, y in zip(buckets.tolist(), at.tolist(), [*at.tolist()[1:], len(bucket)], strict=True):
                        mine = np.arange(x, y)
                        known = np.unique(sig[x:y][hot[x:y]])
                        for name, some in ((k, mine[~hot[x:y]]), (-1 - k, mine[hot[x:y]])):
                            if not len(some) and not (name == k and len(known)):
                                continue
                            used, back = np.unique(owner[some], return_inverse=True)
                            short = sig[some].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                            out.append((name, short.tobytes(), back.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32).tobytes(), sets[used].tobytes(), sizes[used].tobytes(), spares[used].tobytes(), known.tobytes()))
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], [x.split()[0] for x in PACKED.split(", ")])
        free_memory()

    packed = docs.select(text).mapInArrow(run, PACKED)
    lot = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(splits, default=1)))
    return packed.withColumn("lot", F.when(F.col("bucket") < 0, lot).otherwise(0))


def _unpack(part: pd.DataFrame) -> tuple[np.ndarray, ...]:
    get = lambda c, t: [np.frombuffer(x, t) for x in part[c]]
    sets = get("sets", np.int64)
    base = np.cumsum([0, *map(len, sets)])
    wide = [np.uint16 if 3 * len(o) == len(x) else np.uint32 for o, x in zip(part["owners"], part["sigs"], strict=True)]
    owners = np.concatenate([np.frombuffer(o, t).astype(np.int64) + base[i] for i, (o, t) in enumerate(zip(part["owners"], wide, strict=True))])
    short = np.concatenate(get("sigs", np.uint8)).reshape(-1, 6)
    sigs = np.zeros((len(short), 8), np.uint8)
    sigs[:, :6] = short
    return sigs.view("<u8").ravel(), owners, np.concatenate(sets), *(np.concatenate(get(c, t)) for c, t in (("sizes", np.int32), ("spares", np.int32), ("known", np.uint64)))


PAIRS = "a bigint, b bigint, sa int, sb int, sig bigint, set_id bigint, size int, spare int, band int"


def _pair_rows(a, b, sa, sb) -> pd.DataFrame:
    low = a < b
    return pd.DataFrame({"a": np.where(low, a, b), "b": np.where(low, b, a), "sa": np.where(low, sa, sb), "sb": np.where(low, sb, sa)})


def _bucket_pairs(frequent: int, splits: list[int]):
    """Pairs of the small groups of one bucket, and the members of the frequent ones."""
    base = first_buckets(splits)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        names = [x.split()[0] for x in PAIRS.split(", ")]
        bucket = int(part["bucket"].iloc[0])
        sig, owner, sets, sizes, spares, known = _unpack(part)
        if bucket < 0:
            hot = np.ones(len(sig), bool)
            pairs = []
        else:
            ids = sets[owner]
            order = np.lexsort((ids, sig))
            sig, owner, ids = sig[order], owner[order], ids[order]
            fresh = np.ones(len(sig), bool)
            fresh[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])
            sig, owner, ids = sig[fresh], owner[fresh], ids[fresh]
            start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
            n = np.diff(np.append(start, len(sig)))
            many = (n > frequent) | np.isin(sig[start], known)
            hot = np.repeat(many, n)
            pairs, size = [], sizes[owner].astype(np.int64)
            group = np.repeat(np.where(many, -1 - np.arange(len(n)), np.arange(len(n))), n)
            for d in range(1, frequent):  # d places apart in one small group
                i = np.flatnonzero((group[d:] == group[:-d]) & (group[d:] >= 0))
                if not len(i):
                    break
                k = i + d
                near = 7 * np.abs(size[i] - size[k]) <= size[i] + size[k]
                pairs.append(_pair_rows(ids[i[near]], ids[k[near]], size[i[near]], size[k[near]]))
        found = pd.concat(pairs).drop_duplicates() if pairs else pd.DataFrame(columns=names[:4])
        o = owner[hot]
        place = bucket if bucket >= 0 else -1 - bucket
        name = mix(sig[hot] ^ mix(np.full(int(hot.sum()), place, np.uint64))).view(np.int64)  # alike in the buckets of either sign
        rest = pd.DataFrame({"sig": name, "set_id": sets[o], "size": sizes[o], "spare": spares[o], "band": int(np.searchsorted(base, place, "right")) - 1})
        free_memory()
        # nullable integers before the columns are filled up: 64-bit names must not pass through floats
        full = [x.astype("Int64").reindex(columns=names).astype("Int64") for x in (found, rest)]
        return pd.concat(full)

    return run


def _settled(names: DataFrame) -> DataFrame:
    """A checkpoint of narrow rows, read again in no more partitions than its rows need."""
    done = truncate_lineage(names)
    return done.coalesce(1 + done.count() // ROWS_PER_TASK)


def _plausible(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """The pairs (a, b, sa, sb) whose coarse counts do not rule out a similarity of 3/4."""
    sketch = facts.select(F.col("set_id").alias("k"), "sketch")
    coarse = pairs.join(sketch, F.col("a") == F.col("k")).drop("k").withColumnRenamed("sketch", "x")
    coarse = coarse.join(sketch, F.col("b") == F.col("k")).drop("k").withColumnRenamed("sketch", "y")

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = (b.column("sa").to_numpy().astype(np.int64) + b.column("sb").to_numpy()).tolist()
            ok = []
            for x, y, limit in zip(b.column("x"), b.column("y"), n, strict=True):
                x, y = x.as_buffer(), y.as_buffer()
                width = min(x.size, y.size)
                ok.append(7 * int(np.abs(fold(x, width) - fold(y, width)).sum()) <= limit)
            yield b.select(["a", "b", "sa", "sb"]).filter(pa.array(ok, pa.bool_()))

    return _settled(coarse.mapInArrow(differ, "a bigint, b bigint, sa int, sb int"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()


def _elements(wanted: DataFrame, facts: DataFrame, docs: DataFrame, row: str, text: str) -> DataFrame:
    """(k, elements): the whole sets named in ``wanted`` (set_id), each from one of its documents."""
    rows = _settled(facts.join(wanted, "set_id").select("set_id", F.col("one").alias(row)))
    if rows.count() <= BROADCAST_ROWS:  # else the texts are shuffled to them
        rows = F.broadcast(rows)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, text, SLICE_BYTES):
                value, offsets = shingle_sets(b, text)
                got = [value[s:e].tobytes() for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("set_id"), pa.array(got, pa.binary())], ["k", "elements"])
        free_memory()

    return truncate_lineage(docs.select(row, text).join(rows, row).select("set_id", text).mapInArrow(sets, "k bigint, elements binary"))


def _similar(pairs: DataFrame, side: DataFrame) -> DataFrame:
    """The pairs (a, b) with a similarity of 3/4 or more, on whole sets."""
    needed = _settled(_ends(pairs).select(F.col("set_id").alias("k")))
    if needed.count() <= BROADCAST_ROWS:  # else all sets are shuffled to their pairs
        side = side.join(F.broadcast(needed), "k", "left_semi")
    both = pairs.join(side, F.col("a") == F.col("k")).drop("k").withColumnRenamed("elements", "x")
    both = both.join(side, F.col("b") == F.col("k")).drop("k").withColumnRenamed("elements", "y")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                ok.append(100 * same >= 75 * (len(x) + len(y) - same))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return _settled(both.mapInArrow(similar, "a bigint, b bigint"))


def _merged(linked: DataFrame, links: DataFrame) -> DataFrame:
    """``linked`` (set_id, component) after further links (a, b): only the components between them are joined anew."""
    ends = _settled(_ends(links).join(linked, "set_id", "left").select("set_id", F.coalesce("component", "set_id").alias("component")))
    side = lambda k, c: ends.select(F.col("set_id").alias(k), F.col("component").alias(c))
    joined = connected_components(links.join(side("a", "x"), "a").join(side("b", "y"), "b"), "x", "y")
    joined = joined.select(F.col("id").alias("component"), F.col("component").alias("now"))
    every = linked.unionByName(ends.join(linked, "set_id", "left_anti"))
    return _settled(every.join(joined, "component", "left").select("set_id", F.coalesce("now", "component").alias("component")))


def _links(pairs: DataFrame, facts: DataFrame, docs: DataFrame, row: str, text: str) -> DataFrame:
    """(set_id, component) of the sets that the similar ones of ``pairs`` connect.

    First each set is held against its smallest partner; the pairs that are left between
    different components are then verified one and all.
    """
    maybe = _plausible(pairs, facts)
    side = _elements(_ends(maybe), facts, docs, row, text)
    near = _similar(maybe.groupBy("b").agg(F.min("a").alias("a")), side)
    linked = _settled(connected_components(near, "a", "b").withColumnRenamed("id", "set_id"))
    for end in ("a", "b"):
        maybe = maybe.join(linked.select(F.col("set_id").alias(end), F.col("component").alias(f"c_{end}")), end, "left")
    more = _similar(maybe.filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b"), side)
    return linked if more.isEmpty() else _merged(linked, more)


def _open(members: DataFrame, linked: DataFrame) -> DataFrame:
    """Members of signatures with several components; ``minor`` are those outside the largest one."""
    members = _settled(members.join(linked, "set_id", "left").withColumn("component", F.coalesce("component", "set_id")))
    parts = members.groupBy("sig", "component").agg(F.count("*").alias("n"))
    largest = parts.groupBy("sig").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("k")).filter("k > 1")
    marked = members.join(largest.select("sig", F.col("top.component").alias("major")), "sig")
    return _settled(marked.select("sig", "set_id", "size", "component", (F.col("component") != F.col("major")).alias("minor")))


def _pivot_pairs(open_: DataFrame) -> DataFrame:
    """Minor members with ``PIVOTS`` members of the largest component of their signature."""
    pick = F.struct(F.xxhash64("set_id", F.lit(1)).alias("h"), "set_id", "size")
    pivot = open_.filter("not minor").groupBy("sig", F.pmod(F.xxhash64("set_id"), F.lit(PIVOTS))).agg(F.min(pick).alias("p")).select("sig", "p")
    pairs = open_.filter("minor").join(pivot, "sig").filter("7 * abs(size - p.size) <= size + p.size")
    low = F.col("set_id") < F.col("p.set_id")
    end = lambda x, y: F.when(low, F.col(x)).otherwise(F.col(y))
    return pairs.select(end("set_id", "p.set_id").alias("a"), end("p.set_id", "set_id").alias("b"), end("size", "p.size").alias("sa"), end("p.size", "size").alias("sb")).distinct()


def _narrowed(sketches: DataFrame) -> DataFrame:
    """The sketches with ``BLOCK_CLASSES`` classes at most: they still prove differences, and fewer bytes go to the blocks."""

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            short = [np.minimum(fold(x, min(len(x), BLOCK_CLASSES)), 65535).astype("<u2").tobytes() for x in b.column("sketch").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("set_id"), pa.array(short, pa.binary())], ["set_id", "sketch"])

    return sketches.select("set_id", "sketch").mapInArrow(narrow, "set_id bigint, sketch binary")


def _block_pairs(members: DataFrame) -> DataFrame:
    """Minor members with all members of other components of their signature, in blocks of about ``BLOCK`` by ``BLOCK``.

    A pair that shares several signatures is listed in the smallest one, as far as the ``LOWER_SIGS`` smallest
    signatures of either member tell; what is listed again falls together at the end.
    """
    size = truncate_lineage(members.groupBy("sig").agg(F.count("*").alias("n"), F.count_if("minor").alias("m")))
    blocks = lambda n: F.ceil(F.col(n) / F.lit(BLOCK)).cast("int")
    placed = members.join(size, "sig").withColumns({"down": blocks("n"), "across": blocks("m"), "sigs": F.filter("sigs", lambda z: z < F.col("sig"))})
    at = lambda k: F.pmod(F.xxhash64("set_id"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    columns = ["sig", "sigs", "p", "q", "minor", "asks", "set_id", "size", "component", "sketch"]
    # a minor member meets its own block's candidates where it stands itself: there it is one row for both sides
    left = placed.filter("minor").withColumns({"p": at("across"), "asks": F.lit(True), "own": at("down")}).withColumn("q", every("down")).filter("q <> own")
    right = placed.withColumns({"q": at("down"), "own": at("across")}).withColumn("p", every("across")).withColumn("asks", F.expr("minor and p = own"))
    right = right.withColumn("stands", F.lit(True))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        left, right = part[part["asks"]], part[part["stands"]]
        width = int(part["sketch"].map(len).min()) // 2
        wide = lambda k: np.frombuffer(k, "<u2").reshape(-1, width).sum(0, dtype=np.int32)
        x, y = (np.array([wide(k) for k in s["sketch"]], np.int32).reshape(-1, width) for s in (left, right))
        x0, y0 = (k.reshape(-1, width // SKETCH, SKETCH).sum(1) for k in (x, y))
        sx, sy = (s["size"].to_numpy(np.int64) for s in (left, right))
        ix, iy, cx, cy = (s[c].to_numpy(np.int64) for c in ("set_id", "component") for s in (left, right))
        once = ~right["minor"].to_numpy(bool)  # two minor members meet twice
        lower = [{int(z) for z in k} for k in left["sigs"]], [[int(z) for z in k] for k in right["sigs"]]
        out = [_pair_rows(*[np.zeros(0, np.int64)] * 4)]
        for i in range(len(left)):
            ok = (cy != cx[i]) & (once | (iy > ix[i])) & (7 * np.abs(sy - sx[i]) <= sy + sx[i])
            for u, v in ((x0, y0), (x, y)):  # a coarse count first
                ok[ok] = 7 * np.abs(v[ok] - u[i]).sum(1) <= sy[ok] + sx[i]
            k = np.array([j for j in np.flatnonzero(ok).tolist() if lower[0][i].isdisjoint(lower[1][j])], np.int64)
            out.append(_pair_rows(np.full(len(k), ix[i]), iy[k], np.full(len(k), sx[i]), sy[k]))
        return pd.concat(out)

    both = left.withColumn("stands", F.lit(False)).select(*columns, "stands").unionByName(right.select(*columns, "stands"))
    return both.groupBy("sig", "p", "q").applyInPandas(run, "a bigint, b bigint, sa int, sb int").distinct()


def _contracted(members: DataFrame, linked: DataFrame, tried: DataFrame, facts: DataFrame, docs: DataFrame, row: str, text: str) -> DataFrame:
    """``linked`` with the links between members of frequent signatures that were in different components."""
    open_ = _open(members, linked)
    if open_.isEmpty():
        return linked
    sets = truncate_lineage(facts.join(open_.select("set_id").distinct(), "set_id"))
    side = _elements(sets.select("set_id"), sets, docs, row, text)
    near = _similar(_plausible(_pivot_pairs(open_), sets), side)
    if not near.isEmpty():
        linked = _merged(linked, near)
        open_ = _open(open_.select("sig", "set_id", "size"), linked)
    own = open_.groupBy("set_id").agg(F.slice(F.sort_array(F.collect_list("sig")), 1, LOWER_SIGS).alias("sigs"))  # the smallest signatures of one set
    more = _block_pairs(open_.join(_narrowed(sets).join(own, "set_id"), "set_id")).join(tried, ["a", "b"], "left_anti")
    near = _similar(_plausible(more, sets), side)
    return linked if near.isEmpty() else _merged(linked, near)


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """All columns but the text, with n_shingles and component_id.

    ``component_id`` is the smallest id that links lead to, the row's own included. Null and
    empty texts have no shingles and no links. Rows with equal texts are linked, whatever
    their ids; a row without an id counts, but never names a component with others. ``docs``
    must give the same rows in the same order each time it is read (a table, a checkpoint).
    """
    keep = without(docs, "n_shingles", "component_id", text).columns
    docs = packed(docs.select(*[F.col(f"`{c}`") for c in keep], text), text).withColumn("_row", F.monotonically_increasing_id())
    table = truncate_lineage(describe(docs, text))
    sets = table.filter("set_id is not null").groupBy("set_id")
    facts = sets.agg(F.min("_row").alias("one"), F.min_by("sketch", "_row").alias("sketch"))
    splits = band_splits(table)
    found = _settled(_signed(docs, text, splits, frequent).groupBy("bucket", "lot").applyInPandas(_bucket_pairs(frequent, splits), PAIRS))
    first = found.filter("a is not null").select("a", "b", "sa", "sb").distinct()
    hot = found.filter("sig is not null").select("sig", "set_id", "size", "spare", "band").distinct()
    # a set leaves out its most frequent signatures first; which ones follows from one order for all sets,
    # so of two similar sets both keep the rarest signature that they share
    often = hot.groupBy("sig").agg(F.count("*").alias("n"))
    order = W.partitionBy("set_id", "band").orderBy(F.desc("n"), "sig")  # the signatures of one set
    ranked = hot.join(often, "sig").withColumn("k", F.row_number().over(order))
    kept = _settled(ranked.filter("k > spare").select("sig", "set_id", "size"))
    # close copies share hundreds of signatures: one signature stands for all with the same members
    alike = kept.groupBy("sig").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("set_id")).alias("x"), F.bit_xor(F.xxhash64("set_id", F.lit(7))).alias("y")
    )
    alone = alike.filter("n > 1").groupBy("n", "x", "y").agg(F.min("sig").alias("sig")).select("sig")
    members = _settled(kept.join(alone, "sig"))
    pivot = members.groupBy("sig").agg(F.min(F.struct("set_id", "size")).alias("p"))
    star = members.join(pivot, "sig").filter("set_id <> p.set_id and 7 * abs(size - p.size) <= size + p.size")
    star = star.select(F.col("p.set_id").alias("a"), F.col("set_id").alias("b"), F.col("p.size").alias("sa"), F.col("size").alias("sb"))
    tried = _settled(first.unionByName(star).distinct())
    linked = _links(tried, facts, docs, "_row", text)
    if not members.isEmpty():
        linked = _contracted(members, linked, tried.select("a", "b"), facts, docs, "_row", text)
    named = F.col("_user").getField(doc_id)
    owned = table.drop("sketch").join(linked, "set_id", "left").withColumn("_group", F.coalesce("component", "set_id"))
    # a hot component is reduced before its smallest id goes back to its rows
    least = truncate_lineage(owned.filter("_group is not null").groupBy("_group").agg(F.min(named).alias("_least")))
    out = owned.join(least, "_group", "left")
    return out.select("_user.*", "n_shingles", F.coalesce("_least", named).alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Filter by row: of every component one row stays, in its own columns, and all texts without words.

    It is the row with the smallest id (rows without an id come last, of equal ids the first
    row of the table). Unrelated rows that share an id do not touch one another.
    """
    rows = docs.withColumn("_line", F.monotonically_increasing_id())
    found = near_components(rows.select("_line", F.col(doc_id).alias("id"), text), "_line", text)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_line")).alias("f")
    stays = truncate_lineage(found.groupBy("component_id").agg(first).select(F.col("f._line").alias("_line")))
    return rows.join(stays, "_line", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])

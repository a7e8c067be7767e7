"""Byte kernels on Arrow batches, shared by the operators of this folder."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20  # text handled at once by a numpy kernel
SPACES = b" \t\n\x0b\x0c\r"
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG = 1024  # bytes of a range that are hashed in step with others
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def lower_table() -> bytes:
    """A-Z to a-z, nothing else."""
    return bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offset of each row; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    if data is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have ``limit`` bytes together (one row at least)."""
    if batch.num_rows == 0:
        return
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixer of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; ``is_word`` says it for each byte value. Words end with their row."""
    inside = is_word[data]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(len(data) + 1, bool)
    edge[0] = True
    edge[offsets] = True  # a row break splits words
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    stop = np.zeros(len(data), bool)
    stop[-1] = inside[-1]
    stop[:-1] = inside[:-1] & (~inside[1:] | edge[1:-1])
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place as a number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte range: eight bytes at a time are mixed in, after its length.

    Ranges longer than ``LONG`` bytes are few and go through xxhash one by one.
    """
    out = mix((ends - starts).astype(np.uint64) + np.uint64(seed) * K2)
    at, left, live = starts.astype(np.int64), (ends - starts).astype(np.int64), np.flatnonzero(ends - starts <= LONG)
    view = eights(data)
    for k in np.flatnonzero(ends - starts > LONG).tolist():
        out[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]], seed)
    at, left = at[live], left[live]
    with np.errstate(over="ignore"):
        h = out[live]
        while len(live):
            more = left > 0
            if not more.all():
                out[live[~more]] = h[~more]
                live, at, left, h = live[more], at[more], left[more], h[more]
                if not len(live):
                    break
            eight = view[at] & MASKS[np.minimum(left, 8)]
            h = (h ^ eight) * K1
            h ^= h >> np.uint64(32)
            h *= K2
            h ^= h >> np.uint64(29)
            at, left = at + 8, left - 8
    return out


def free_memory() -> None:
    """Gives the memory of finished batches back: Python workers live on for other stages."""
    pa.default_memory_pool().release_unused()
    if TRIM is not None:
        TRIM(0)


def packed(docs: DataFrame, *apart: str) -> DataFrame:
    """``_user``: a struct of all columns but those in ``apart``, then these; no added name can clash with the user's."""
    keep = [c for c in docs.columns if c not in apart]
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_user"), *[F.col(f"`{c}`") for c in apart])


def without(df: DataFrame, *names: str) -> DataFrame:
    """The table without the columns that an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])

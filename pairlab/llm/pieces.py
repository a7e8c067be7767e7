"""SentencePiece encoding and decoding through tables of distinct chunks.

No piece of such a model has a white-space marker behind another character, so merges
never cross the place where a marker follows a word: the text falls into chunks (markers
and the word after them) that are segmented independently. The chunks of a slice of texts are
numbered (``dictionary_encode``), each distinct one is segmented once for a task, and the ids go
back to its places in the text through these numbers. The table of a task is bounded
(``TABLE_CHUNKS``): when it is full it starts anew, with the same results. A global table
would shuffle every word of the corpus to save the rest of the work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, chain, pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pairlab.llm.kernels import free_memory, slices, text_bytes, without

TABLE_CHUNKS = 300_000
SLICE_BYTES = 4 << 20
DECODED_IDS = 2_000_000  # ids decoded at once, or one row
MARK = "▁"
PIECES_MODEL = "piece_bpe_32k.model"


def model_bytes(path: str | None = None) -> bytes:
    """The model file; without a path the public one that is installed."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(PIECES_MODEL)
    return Path(path).read_bytes()


class Table:
    """Distinct keys (bytes) with an array of numbers each, all in one flat array."""

    def __init__(self, kind: type, limit: int) -> None:
        self.kind, self.limit = kind, limit
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = [np.zeros(0, self.kind)]
        self.ends = [np.zeros(1, np.int64)]

    def places(self, keys: list[bytes], make: Callable[[list[bytes]], list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, starts, ends) with the values of ``keys``, made for those that are new."""
        if len(self.known) > self.limit:
            self.clear()
        new = [k for k in keys if k not in self.known]
        if new:
            values = make(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            sizes = np.fromiter(map(len, values), np.int64, len(values))
            self.flat = [np.concatenate([*self.flat, np.fromiter(chain.from_iterable(values), self.kind, int(sizes.sum()))])]
            self.ends = [np.concatenate([*self.ends, self.ends[-1][-1] + np.cumsum(sizes)])]
        at = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))
        return self.flat[0], self.ends[0][at], self.ends[0][at + 1]


def gather(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` one after the other, and where each one begins (and the last ends)."""
    size = ends - starts
    to = np.concatenate([[0], np.cumsum(size)])
    return flat[np.repeat(starts - to[:-1], size) + np.arange(to[-1])], to


def distinct(data: np.ndarray, cuts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Distinct byte strings between neighbouring ``cuts``, and which of them each one is."""
    made = pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])
    coded = made.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


class ChunkTable:
    """Ids of each distinct chunk, and the text of each distinct run of ids."""

    def __init__(self, model: bytes, limit: int = TABLE_CHUNKS) -> None:
        from sentencepiece import SentencePieceProcessor

        self.sp = SentencePieceProcessor(model_proto=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        crossing = [p for p in pieces if MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces cross white space: {crossing[:3]}")
        self.opens = np.array([p.startswith(MARK) for p in pieces])
        self.all_marks = np.array([p.strip(MARK) == "" for p in pieces])
        self.lone = self.sp.piece_to_id(MARK)
        self.ids, self.texts = Table(np.int32, limit), Table(np.uint8, limit)

    def _segment(self, chunks: list[bytes]) -> list[list[int]]:
        # the library puts the first marker in front itself; alone it would be dropped
        found = self.sp.encode([c[1:].decode() for c in chunks], num_threads=1)
        return [ids if c != b" " else [self.lone] for c, ids in zip(chunks, found, strict=True)]

    def _say(self, runs: list[bytes]) -> list[bytes]:
        """The library's text of each run of ids, with its first marker as a space."""
        flat = np.frombuffer(b"".join(runs), np.int32).tolist()
        ends = list(accumulate((len(r) // 4 for r in runs), initial=0))
        return [b" " + t.encode() for t in self.sp.decode([flat[a:b] for a, b in pairwise(ends)])]

    def encode_all(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, and the offsets of the rows."""
        text = pc.replace_substring(column.cast(pa.large_string()).fill_null(""), MARK, " ")
        text = pc.if_else(pc.equal(pc.binary_length(text), 0), text, pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in (" ", text, ""))))
        data, offsets = text_bytes(text)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        space = data == 32
        opens = space.copy()
        opens[1:] &= ~space[:-1]
        opens[offsets[:-1][np.diff(offsets) > 0]] = True  # every row begins with a space
        starts = np.flatnonzero(opens)
        keys, code = distinct(data, np.append(starts, len(data)))
        flat, low, high = self.ids.places(keys, self._segment)
        ids, to = gather(flat, low[code], high[code])
        return ids, to[np.searchsorted(starts, offsets)]

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The library's decode() of every row.

        Ids are cut in front of pieces with a marker, and each distinct run is decoded once.
        """
        if not len(ids):
            return pa.array([""] * (len(offsets) - 1), pa.string())
        opens = self.opens[ids]
        opens[1:] &= ~self.all_marks[ids[:-1]]  # a run of markers stays with the word behind it
        begins = offsets[:-1][np.diff(offsets) > 0]
        opens[begins] = True
        starts = np.flatnonzero(opens)
        keys, code = distinct(np.ascontiguousarray(ids, np.int32).view(np.uint8), 4 * np.append(starts, len(ids)))
        flat, low, high = self.texts.places(keys, self._say)
        low = low[code]
        low[np.searchsorted(starts, begins)] += 1  # a row's own first space goes
        data, to = gather(flat, low, high[code])
        row = to[np.searchsorted(starts, offsets)]
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row) - 1, [None, pa.py_buffer(row), pa.py_buffer(data)]).cast(pa.binary())
        # not an encoding where the first run has no marker: such rows are decoded whole
        odd = np.flatnonzero((np.diff(offsets) > 0) & ~self.opens[ids[np.minimum(offsets[:-1], len(ids) - 1)]])
        if len(odd):
            mask = np.zeros(len(row) - 1, bool)
            mask[odd] = True
            whole = [self.sp.decode(ids[offsets[k] : offsets[k + 1]].tolist()).encode() for k in odd.tolist()]
            texts = pc.replace_with_mask(texts, pa.array(mask), pa.array(whole, pa.binary()))
        return texts.cast(pa.string())


def encode(df: DataFrame, text: str = "text", ids: str = "ids", model: bytes | None = None) -> DataFrame:
    """Adds the ids of each whole text: what the library's encode() gives, without begin and end.

    Null and empty texts have no ids. All other columns stay; a column of that name is replaced.
    """
    model = model or model_bytes()
    df = without(df, ids)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model)
        for whole in batches:
            for b in slices(whole, text, SLICE_BYTES):
                values, offsets = table.encode_all(b.column(text))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], schema.names)
        free_memory()

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", model: bytes | None = None) -> DataFrame:
    """Adds the library's decode() of each id list; a null list gives the empty text."""
    model = model or model_bytes()
    df = without(df, text)
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model)
        for b in batches:
            col = b.column(ids)
            size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(size)])
            values = col.drop_null().flatten().to_numpy(zero_copy_only=False)
            start = 0
            while start < b.num_rows:
                end = int(np.searchsorted(offsets, offsets[start] + DECODED_IDS, "right")) - 1
                end = min(max(end, start + 1), b.num_rows)
                said = table.decode_all(values[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
                yield pa.RecordBatch.from_arrays([*b.slice(start, end - start).columns, said], schema.names)
                start = end
        free_memory()

    return df.mapInArrow(run, schema)

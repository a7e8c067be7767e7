"""WARC records in seekable Zstandard bundles.

A bundle is a valid ``.warc.zst`` file: independent frames, each a run of whole records,
and a last skippable frame with the seek table of the public seekable format (compressed
and decompressed size of each frame). Beside it, the index maps every record id to its
frame and the offset inside that frame, so one record costs one frame.

Bundles travel as binary cells of a Parquet table under the shared folder: Spark's own
writer reaches every store, commits once per task and survives lost executors. Files that
others wrote are read through Spark's ``binaryFile`` source.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPABLE = 0x184D2A5E  # fixed values of the seekable format
FOOTER = 0x8F92EAB1
LEAST_REVISIT = 100  # shorter payloads are stored again
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
RECORD_SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, payload_bytes bigint, payload_digest string, payload binary"
)
BUNDLE_SCHEMA = "bundle_id string, content binary, index array<struct<record_id:string,frame:int,offset:int,length:int>>"


def _line(value: str | None) -> bytes:
    """A header value: one line of UTF-8."""
    return " ".join((value or "").split()).encode()


def format_record(rec: dict) -> bytes:
    """One WARC/1.1 record; a revisit has no payload but names the digest and size of the full one."""
    body = b"" if rec["record_type"] == "revisit" else rec["payload"]
    lines = [
        b"WARC/1.1",
        b"WARC-Type: " + rec["record_type"].encode(),
        b"WARC-Record-ID: <" + _line(rec["record_id"]) + b">",
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Target-URI: " + _line(rec["target_uri"]),
        b"WARC-Payload-Digest: sha256:" + rec["payload_digest"].encode(),
        b"X-Payload-Length: " + str(rec["payload_bytes"]).encode(),
    ]
    if rec["record_type"] == "revisit":
        lines.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(b"WARC-Refers-To: <" + _line(rec["refers_to"]) + b">")
    lines.append(b"Content-Length: " + str(len(body)).encode())
    return b"\r\n".join(lines) + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The record that ``data`` holds; a payload is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    head_of = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}
    body = rest[: int(head_of[b"content-length"])]
    bare = lambda k: head_of[k].strip(b"<>").decode() if k in head_of else None
    kind = head_of[b"warc-type"].decode()
    digest = head_of.get(b"warc-payload-digest", b"").decode().removeprefix("sha256:")
    if kind == "revisit":
        size = int(head_of.get(b"x-payload-length", b"0"))
    else:
        size, found = len(body), hashlib.sha256(body).hexdigest()
        if digest and digest != found:
            raise ValueError(f"payload of {bare(b'warc-record-id')} does not match its digest")
        digest = found
    return {
        "record_id": bare(b"warc-record-id"), "record_type": kind, "target_uri": bare(b"warc-target-uri"),
        "refers_to": bare(b"warc-refers-to"), "payload_bytes": size, "payload_digest": digest, "payload": body,
    }


class BundleWriter:
    """Collects records; ``close`` gives the file and its index."""

    def __init__(self, frame_bytes: int = FRAME_BYTES) -> None:
        self.pack = zstd.ZstdCompressor(level=3, write_content_size=True)
        self.limit, self.frames, self.table, self.index = frame_bytes, [], [], []
        self.open, self.size, self.total = [], 0, 0

    def add(self, record_id: str, data: bytes) -> None:
        self.index.append({"record_id": record_id, "frame": len(self.frames), "offset": self.size, "length": len(data)})
        self.open.append(data)
        self.size += len(data)
        self.total += len(data)
        if self.size >= self.limit:
            self._end_frame()

    def _end_frame(self) -> None:
        if self.open:
            frame = self.pack.compress(b"".join(self.open))
            self.frames.append(frame)
            self.table.append((len(frame), self.size))
            self.open, self.size = [], 0

    def close(self) -> tuple[bytes, list[dict]]:
        self._end_frame()
        entries = b"".join(struct.pack("<II", *x) for x in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, FOOTER)
        tail = struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer
        return b"".join(self.frames) + tail, self.index


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of every frame, from the end of the file."""
    n, flags, magic = struct.unpack_from("<IBI", content, len(content) - 9)
    if magic != FOOTER:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    at, start, out = len(content) - 9 - n * width, 0, []
    for k in range(n):
        packed, size = struct.unpack_from("<II", content, at + k * width)
        out.append((start, packed, size))
        start += packed
    return out


def read_frame(content: bytes, frame: tuple[int, int, int]) -> bytes:
    start, packed, size = frame
    return zstd.ZstdDecompressor().decompress(content[start : start + packed], max_output_size=size)


def _batches(records: Iterator[dict], schema: pa.Schema, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for r in records:
        rows.append(r)
        held += len(r.get("payload") or b"") + len(r.get("content") or b"")
        if held >= limit or len(rows) >= 5000:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def _arrow(df_schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(df_schema))


def plan_records(df: DataFrame, record_id: Column, uri: Column, payload: Column, least: int = LEAST_REVISIT) -> DataFrame:
    """Decides response or revisit: the first record id of each payload stays.

    ``record_id`` is any sortable value. A null payload is empty. Records that repeat both
    id and payload are all responses; a record without an id is a response and is never
    referred to. Only distinct digests with more than one record are joined back, and the
    rows of a frequent payload are split by the skew-join rule (its other side is one row).
    """
    data = F.coalesce(payload.cast("binary"), F.lit(b""))
    rows = df.select(record_id.alias("id"), uri.cast("string").alias("target_uri"), data.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").cast("bigint").alias("payload_bytes"))
    keyed = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest")
    keep = keyed.agg(F.min("id").alias("keep"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = F.coalesce(F.col("id") != F.col("keep"), F.lit(False))
    return rows.join(keep, "payload_digest", "left").select(
        F.col("id").cast("string").alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(again, F.col("keep").cast("string")).alias("refers_to"),
        "payload_bytes",
        "payload_digest",
        F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
    )


def write_bundles(records: DataFrame, path: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> None:
    """Writes every record into bundles of about ``bundle_bytes`` of records, with their index."""
    schema = _arrow(BUNDLE_SCHEMA)

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        import uuid

        writer = BundleWriter(frame_bytes)
        for b in batches:
            for rec in b.to_pylist():
                writer.add(rec["record_id"], format_record(rec))
                if writer.total >= bundle_bytes:
                    content, index = writer.close()
                    yield {"bundle_id": uuid.uuid4().hex, "content": content, "index": index}
                    writer = BundleWriter(frame_bytes)
        if writer.index:
            content, index = writer.close()
            yield {"bundle_id": uuid.uuid4().hex, "content": content, "index": index}

    records.mapInArrow(lambda it: _batches(bundles(it), schema), BUNDLE_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """All records of the bundles, through index and seek table; one frame is open at a time."""
    schema = _arrow(RECORD_SCHEMA)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for row in b.to_pylist():
                frames, at, data = seek_table(row["content"]), -1, b""
                for x in row["index"]:
                    if x["frame"] != at:
                        at, data = x["frame"], read_frame(row["content"], frames[x["frame"]])
                    yield parse_record(data[x["offset"] : x["offset"] + x["length"]]) | {"record_id": x["record_id"]}

    return spark.read.parquet(path).mapInArrow(lambda it: _batches(records(it), schema), RECORD_SCHEMA)


def read_record(spark: SparkSession, path: str, record_ids: DataFrame) -> DataFrame:
    """Only the records with an id in ``record_ids`` (column ``record_id``): one frame each is unpacked."""
    schema = _arrow(RECORD_SCHEMA)
    entries = spark.read.parquet(path).select("bundle_id", F.explode("index").alias("x")).select("bundle_id", "x.*")
    wanted = entries.join(record_ids.select("record_id").distinct(), "record_id", "left_semi")
    per_bundle = wanted.groupBy("bundle_id").agg(F.collect_list(F.struct("record_id", "frame", "offset", "length")).alias("index"))
    found = spark.read.parquet(path).drop("index").join(per_bundle, "bundle_id")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for row in b.to_pylist():
                frames = seek_table(row["content"])
                for x in row["index"]:
                    data = read_frame(row["content"], frames[x["frame"]])
                    yield parse_record(data[x["offset"] : x["offset"] + x["length"]]) | {"record_id": x["record_id"]}

    return found.select("content", "index").mapInArrow(lambda it: _batches(records(it), schema), RECORD_SCHEMA)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of ``.warc.zst`` files with a seek table, wherever Spark can read them."""
    schema = _arrow(RECORD_SCHEMA)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for content in b.column("content").to_pylist():
                for frame in seek_table(content):
                    data, at = read_frame(content, frame), 0
                    while at < len(data):
                        end = data.index(b"\r\n\r\n", at)
                        lines = data[at:end].lower().split(b"\r\n")
                        size = next(int(x.partition(b":")[2]) for x in lines if x.startswith(b"content-length:"))
                        yield parse_record(data[at : end + 4 + size])
                        at = end + 8 + size

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(
        lambda it: _batches(records(it), schema), RECORD_SCHEMA
    )

"""Language identification by compression.

For each language a raw-content Zstandard dictionary is cut from sampled training texts.
A text is compressed once per language, in blocks, and the language whose dictionary makes
it smallest wins. The margin between the best and the second size, as a share of the second,
is the score; a text with a narrow margin is rejected.

The sample is bounded: about ``SAMPLE_DOCS`` training texts per language, the ones with the
smallest hashes, and ``DICT_BYTES`` of them. Counting and prediction use all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.kernels import without

SAMPLE_DOCS = 200
DICT_BYTES = 96 << 10
BLOCK_BYTES = 8 << 10
LEVEL = 5
MIN_MARGIN = 0.005
UNDETERMINED = "und"
ASCII_LETTER = re.compile("[A-Za-z]")


def learn(training: DataFrame, text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """A dictionary per language, from rows with a text and a language.

    Every row of ``training`` is counted; of each language about the ``sample_docs`` texts with
    the smallest hashes are taken (all, when there are fewer). Texts enter in rounds of equal
    shares, so one very long text does not fill the dictionary. The driver holds the sample
    only: languages times ``sample_docs`` texts. The most frequent language comes first.
    """
    rows = training.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null and text <> ''")
    share = dict_bytes // sample_docs + 1
    rows = rows.withColumn("h", F.xxhash64("text"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("d")).collect()
    counts = {r["lang"]: r["n"] for r in sizes}
    if not counts:
        return {}
    # copies are one text: the threshold follows the distinct texts (a sketch; 4 times too many are let through)
    part = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, 4.0 * sample_docs / max(r["d"], 1))))])
    near = rows.filter((F.col("h") / F.lit(2.0**64) + 0.5) <= F.element_at(part, F.col("lang"))).dropDuplicates(["lang", "h"])
    first = near.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h"))).filter(F.col("k") <= sample_docs)
    texts: dict[str, list[bytes]] = {}
    for r in first.orderBy("lang", "h").collect():
        texts.setdefault(r["lang"], []).append(r["text"].lower().encode())
    out = {}
    for k, found in sorted(texts.items(), key=lambda x: (-counts[x[0]], x[0])):
        step, data = max(share, dict_bytes // len(found) + 1), b""
        for at in range(0, max(map(len, found)), step):
            data += b"\n".join(t[at : at + step] for t in found if len(t) > at)
            if len(data) >= dict_bytes:
                break
        out[k] = data[:dict_bytes]
    return out


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL) -> None:
        self.langs = list(dictionaries)
        self.packers = []
        for k in self.langs:
            d = zstd.ZstdCompressionDict(dictionaries[k], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            sized = {"source_size": BLOCK_BYTES, "dict_size": len(dictionaries[k])}
            params = zstd.ZstdCompressionParameters.from_level(level, write_content_size=0, write_checksum=0, write_dict_id=0, **sized)
            d.precompute_compress(compression_params=params)
            self.packers.append(zstd.ZstdCompressor(dict_data=d, compression_params=params))

    def sizes(self, text: str) -> list[int]:
        """Compressed bytes of the whole text under each language's dictionary."""
        data = text.lower().encode()
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        return [sum(len(p.compress(b)) for b in blocks) for p in self.packers]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not (ASCII_LETTER.search(text) or any(map(str.isalpha, text))):
            return UNDETERMINED, 0.0
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)  # the first of equals
        if len(sizes) == 1:
            return self.langs[0], 1.0
        return self.langs[best], 1.0 - sizes[best] / min(x for i, x in enumerate(sizes) if i != best)


def identify(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """Adds lang_pred, score (0 to 1) and rejected; columns of these names are replaced.

    Null texts, texts without a letter and everything under an empty model: ``und``, 0, rejected.
    Equal sizes go to the language with more training rows, with score 0.
    """
    df = without(df, "lang_pred", "score", "rejected")
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries)
        for b in batches:
            found = [model.predict(t) for t in b.column(text).to_pylist()]
            pred, score = [x[0] for x in found], [x[1] for x in found]
            rejected = [s < min_margin or p == UNDETERMINED for p, s in found]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*names, "lang_pred", "score", "rejected"]
            )

    return df.mapInArrow(run, schema)

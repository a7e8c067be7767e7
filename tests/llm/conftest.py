import pytest
from pyspark.sql import types as T

from pairlab.session import truncate_lineage

TEXTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def docs(spark):
    """Documents from a list of texts, or of (id, text)."""

    def make(texts, langs=None, partitions=3):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        langs = langs or ["en"] * len(rows)
        data = [(i, t, k, "s", None if t is None else len(t)) for (i, t), k in zip(rows, langs, strict=True)]
        return truncate_lineage(spark.createDataFrame(data, TEXTS).repartition(partitions))

    return make


@pytest.fixture
def folder(tmp_path, docs):
    """A table folder with the given documents."""

    def make(texts, **tables):
        docs(texts).write.parquet(str(tmp_path / "documents.parquet"))
        for name, df in tables.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return make

"""Corpus pipeline: five stages over whole documents, each written and reread as Parquet.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.llm import contamination, langid, nearjoin, pieces, substrings
from pairlab.session import scratch_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; others get their predicted language.

    Rejected are null and empty texts, texts without a letter and those whose two best
    languages are too close (equal sizes included). Repeated rows are judged alike; an empty
    table stays empty; all columns stay.
    """
    model = langid.learn(docs)
    found = langid.identify(docs, model).filter("not rejected")
    return found.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates stays.

    By row: rows without an id come last, of equal ids the first row of the table; rows that
    share an id but not their text do not touch one another. Texts without words (null, empty)
    all stay. All columns stay.
    """
    return nearjoin.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """200-byte strings that occur again are cut out.

    Null, empty and short texts stay as they are; of repeated rows that long nothing stays, and
    a document that is left empty goes. ``n_chars`` follows the text; other columns stay.
    """
    return substrings.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go; null and empty texts have none and stay. All columns stay."""
    return contamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document that is left: doc_id, lang, source, ids, n_tokens. Null and empty texts have no ids."""
    return pieces.encode(docs.select("doc_id", "text", "lang", "source")).select(
        "doc_id", "lang", "source", "ids", F.size("ids").cast("bigint").alias("n_tokens")
    )


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding", encode),
]

#: Compression, partition signatures and piece merges are not expressible; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

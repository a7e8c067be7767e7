"""Session helpers: where reliable checkpoints and hand-over tables live."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and hand-over tables, taken from the session.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may
    fall back to a temporary folder: on a cluster such a folder would not be
    visible to the other machines, so that is an error.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="spark-pairlab-")


def truncate_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; the caller writes it once."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def task_count(spark: SparkSession, per_slot: int = 1) -> int:
    """Tasks for a stage whose work is far larger than its data.

    Such a stage is repartitioned to a fixed number, since AQE would merge its
    small partitions into a few slow tasks.
    """
    slots = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return slots * per_slot


FIT_ROWS = 2048  # rows of a partition that a fit passes over, at least
FIT_MOST = 262_144  # and at most, about


def fit_task_count(spark: SparkSession, rows: int, at_once: int = 1) -> int:
    """Tasks for rows that a fit passes over hundreds of times: each pass pays for every task, and each task hands on
    statistics of all tree nodes that it works on, however few its rows. So there are no more than the slots of
    one of ``at_once`` fits, whatever the number of shuffle partitions, until partitions become large."""
    slots = math.ceil(spark.sparkContext.defaultParallelism / at_once)
    return max(1, min(task_count(spark), max(min(slots, math.ceil(rows / FIT_ROWS)), math.ceil(rows / FIT_MOST))))


def table_by(rows: DataFrame, key: str, values: int, *ids: str) -> DataFrame:
    """Rows written once as a table with a folder for each of about ``values`` values of ``key``: a filter on it reads
    no other rows. ``ids`` spread a value's rows over files of about ``FIT_ROWS``."""
    spark, rows = rows.sparkSession, truncate_lineage(rows)  # counted, then written
    n = fit_task_count(spark, rows.count())
    salt = F.pmod(F.xxhash64(*ids), F.lit(math.ceil(n / max(1, values))))
    path = scratch_path(spark, "rows")
    rows.repartition(max(n, min(values, task_count(spark))), key, salt).write.partitionBy(key).parquet(path)
    return spark.read.schema(rows.schema).parquet(path).select(*rows.columns)


def fit_rows(rows: DataFrame, at_once: int = 1) -> DataFrame:
    """The rows of one fit, written once in as few partitions as ``fit_task_count`` says."""
    return truncate_lineage(rows.repartition(fit_task_count(rows.sparkSession, rows.count(), at_once)))

"""Shared scratch tables: lineage is cut by writing and reading back."""

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_ROWS = 1_000_000


def scratch_folder(spark) -> str:
    """The folder of ``spark.checkpoint.dir``; a folder of our own only where that is unset and Spark runs in this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='airloom-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder}/airloom"


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the scratch folder."""
    path = f"{scratch_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """A written table with a broadcast hint if a count shows at most ``max_rows`` rows; else as it is, to be joined by shuffle."""
    return F.broadcast(df) if df.count() <= max_rows else df


def spread(df: DataFrame, rows: int, *keys) -> DataFrame:
    """``df`` by keys over partitions of at most about ``PART_ROWS`` of its ``rows``, which are not put together again, so a task's rows don't grow with the table."""
    n = -(-rows // PART_ROWS)
    return df.repartition(max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys) if n > 1 else df.repartition(*keys)

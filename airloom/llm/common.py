"""Tables, scratch space and small frames that the corpus operators share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: texts may be long, so batches stay small.
BATCH_ROWS = 500
BATCH_BYTES = 4 << 20


def session(df_or_spark) -> SparkSession:
    """The session, with Arrow batches small enough for long texts."""
    spark = df_or_spark.sparkSession if isinstance(df_or_spark, DataFrame) else df_or_spark
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder of ours only where it is unset and Spark runs in this process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='airloom-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder: lineage is cut, lost executors cost nothing,
    and Spark knows the table's true size when it picks a join."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/airloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes the files of ``written`` tables that no plan will read again."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.scratch)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """A written table with a broadcast hint if a count shows at most ``max_rows`` rows; else as it is, to be joined by shuffle."""
    return F.broadcast(df) if df.count() <= max_rows else df

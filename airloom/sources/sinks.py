"""Archives and statistics as partitioned tables and delimited text."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def archive(results: DataFrame, path: str) -> None:
    """Hourly results by day and variable; the partitions that the frame holds are replaced, others stay."""
    days = results.withColumn("day", F.to_date(F.timestamp_seconds(F.col("sys_hour") * 3600)))
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "var").parquet(path)


def statistics(rows: DataFrame, path: str) -> None:
    """Delimited text with a header."""
    rows.write.mode("overwrite").option("sep", ";").option("header", "true").csv(path)


def grid_series(cells: DataFrame, keys=("sys_hour",)) -> DataFrame:
    """``(*keys, h, w0, values)``: rows of grids as arrays from column ``w0`` on, for exchange formats; gaps are null. A row for each time and grid row, so no array spans a whole grid."""
    rows = cells.groupBy(*keys, "h").agg(F.min("w").alias("w0"), F.max("w").alias("w1"), F.map_from_entries(F.collect_list(F.struct("w", "value"))).alias("m"))
    return rows.select(*keys, "h", "w0", F.transform(F.sequence("w0", "w1"), lambda w: F.try_element_at("m", w)).alias("values"))


def saved_state(state: DataFrame, path: str, last_hour: int, keep_days: int = 93) -> None:
    """Learned state as one snapshot a day; snapshots older than ``keep_days`` before it are deleted."""
    day = last_hour // 24
    state.withColumn("snapshot_day", F.lit(day)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_day").parquet(path)
    delete_older(state.sparkSession, path, "snapshot_day", day - keep_days)


def delete_older(spark, path: str, partition: str, first_kept: int) -> None:
    """Deletes the folders ``partition=n`` of a table with n below ``first_kept``."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in files.listStatus(top):
        name, _, value = found.getPath().getName().partition("=")
        if name == partition and int(value) < first_kept:
            files.delete(found.getPath(), True)


def loaded_state(spark, path: str, day: int, back: int = 93) -> DataFrame:
    """The newest snapshot at or before a day, searched ``back`` days; partitions prune the scan."""
    found = spark.read.parquet(path).filter(F.col("snapshot_day").between(day - back, day))
    return found.join(found.agg(F.max("snapshot_day").alias("snapshot_day")), "snapshot_day")


def new_rows(rows: DataFrame, existing: DataFrame, keys) -> DataFrame:
    """Rows whose keys the table lacks, for appending."""
    return rows.join(existing.select(*keys), keys, "left_anti")

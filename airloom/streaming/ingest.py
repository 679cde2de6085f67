"""Streams of observations: file source, hourly slots with late data, persistent learning."""

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from airloom.operators import fusion, quality
from airloom.sources.store import written

OBSERVATION = "var string, source_id string, sec long, value double, maturity long"


def observation_stream(spark, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder, as they come."""
    return spark.readStream.schema(OBSERVATION).option("maxFilesPerTrigger", files_per_trigger).parquet(folder).withColumn("sys_hour", F.floor(F.col("sec") / 3600))


def merge_slots(batch: DataFrame, path: str, batch_id: str) -> None:
    """Merges a batch into hourly slots: lower maturity replaces, equal maturities are averaged over all batches.

    Only the days that the batch touches are read and rewritten; the table keeps each maturity class's sum and count, so
    data may come late and in any order. Each day keeps its newest batch apart from the sums of those before,
    so a batch that Spark delivers again (it promises at least once) replaces its own rows and counts once.
    """
    spark = batch.sparkSession
    keys = ["var", "source_id", "sys_hour", "maturity", "day"]
    sums = [F.sum("total").alias("total"), F.sum("n").alias("n")]
    slot = batch.withColumn("day", F.floor(F.col("sys_hour") / 24))
    new = slot.groupBy(*keys).agg(F.sum("value").alias("total"), F.count("value").alias("n")).withColumn("batch", F.lit(batch_id))
    days = [r.day for r in new.select("day").distinct().collect()]  # the days of one batch
    if not days:
        return
    try:
        old = spark.read.parquet(path).filter(F.col("day").isin(days) & (F.col("batch") != batch_id))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        old = None
    every = new if old is None else new.unionByName(old.groupBy(*keys).agg(*sums).withColumn("batch", F.lit("before")))
    written(every).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def slots(spark, path: str) -> DataFrame:
    """The slots' values now: the lowest maturity's mean."""
    classes = spark.read.parquet(path).groupBy("var", "source_id", "sys_hour", "maturity").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    best = classes.groupBy("var", "source_id", "sys_hour").agg(F.min(F.struct("maturity", "total", "n")).alias("b"))
    return best.select("var", "source_id", "sys_hour", F.col("b.maturity").alias("maturity"), (F.col("b.total") / F.col("b.n")).alias("value"), F.col("b.n").alias("n"))


def slot_stream(observations: DataFrame, path: str, checkpoint: str):
    """A query that keeps the slot table up to date."""
    return observations.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, k: merge_slots(df, path, f"{checkpoint}:{k}"))


def hourly_means(observations: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Means by hour windows of event time, append mode: an hour is final once the watermark has passed it."""
    ts = observations.withColumn("ts", F.timestamp_seconds("sec"))
    return ts.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "var", "source_id").agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def learned_stream(adjustments: DataFrame, wait_hours: int = 2) -> DataFrame:
    """Persistent learning over a stream of ``(var, cat, sys_hour, factor)``; state by variable and category.

    Hours are learned in order: one is held until another ``wait_hours`` later has come, whatever the order within and across
    batches. What comes later than that can't be learned any more and is counted in ``late``; an hour is learned once.
    """
    state = "master double, cells array<double>, last_hour long, hours array<long>, factors array<double>, late long"
    out = T.StructType([*fusion.LEARNED.fields, T.StructField("late", T.LongType())])

    def step(key, batches, group):
        *own, hours, factors, late = group.get if group.exists else (None, [], [], 0)
        held = fusion.Learned(key[1] == 0, tuple(own) if group.exists else None)
        waiting = list(zip(hours, factors))
        for pdf in batches:
            waiting += [(int(h), float(f)) for h, f in pdf[["sys_hour", "factor"]].itertuples(index=False)]
        late += sum(h <= held.last for h, _ in waiting)
        waiting = sorted(x for x in waiting if x[0] > held.last)
        ripe = waiting[-1][0] - wait_hours if waiting else held.last
        for h, f in waiting:
            if h <= ripe:
                held.update(h, f)
        rest = [x for x in waiting if x[0] > ripe]
        group.update((*held.state(), [h for h, _ in rest], [f for _, f in rest], late))
        yield pd.DataFrame([(*key, *held.state(), late)], columns=out.names)

    return adjustments.groupBy("var", "cat").applyInPandasWithState(step, out, state, "update", GroupStateTimeout.NoTimeout)


def accepted_stream(observations: DataFrame, lo: float, hi: float) -> DataFrame:
    return quality.accepted(observations, lo, hi).filter("accepted").drop("accepted")

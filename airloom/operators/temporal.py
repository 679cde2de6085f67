"""As-of joins, interpolation, smoothing and fills of hourly series.

As-of lookups try a short list of hour offsets: each target asks for its offsets' hours by equality, and the best
rank wins. Nothing is sorted and a long series is spread over all tasks by hour.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import SERIES


def nearest_first(steps: int):
    """0, -1, 1, -2, 2, ...: ties go backward."""
    return [0] + [s * k for k in range(1, steps) for s in (-1, 1)]


def asof(targets: DataFrame, series: DataFrame, offsets, name: str, by=None) -> DataFrame:
    """Adds ``name`` and ``name_hour``: the value at the first offset that the series has; null if none."""
    keys = by or SERIES
    asked = targets.select(*targets.columns, F.posexplode(F.array(*[F.lit(int(o)).cast("long") for o in offsets])).alias("_rank", "_offset"))
    have = series.select(*keys, F.col("sys_hour").alias("_at"), F.col("value").alias("_value"))
    hit = asked.withColumn("_at", F.col("sys_hour") + F.col("_offset")).join(have, [*keys, "_at"])
    best = hit.groupBy(*keys, "sys_hour").agg(F.min(F.struct("_rank", "_at", "_value")).alias("_b"))
    found = best.select(*keys, "sys_hour", F.col("_b._value").alias(name), F.col("_b._at").alias(f"{name}_hour"))
    return targets.join(found, [*keys, "sys_hour"], "left")


def spine(series: DataFrame, by=None) -> DataFrame:
    """Every hour from each series' first to its last."""
    keys = by or SERIES
    return series.groupBy(*keys).agg(F.min("sys_hour").alias("a"), F.max("sys_hour").alias("b")).select(*keys, F.explode(F.sequence("a", "b")).alias("sys_hour"))


def interpolated(series: DataFrame, by=None, reach: int = 2) -> DataFrame:
    """Each hour of the spine: between the values at most ``reach`` hours back and ahead; the value behind if none is ahead."""
    hours = spine(series, by)
    both = asof(asof(hours, series, [-k for k in range(reach + 1)], "back", by), series, range(1, reach + 1), "ahead", by)
    share = (F.col("sys_hour") - F.col("back_hour")) / (F.col("ahead_hour") - F.col("back_hour"))
    mixed = F.col("back") * (1 - share) + F.col("ahead") * share
    return both.select(*(by or SERIES), "sys_hour", F.when(F.col("ahead").isNull() | (F.col("sys_hour") == F.col("back_hour")), F.col("back")).otherwise(F.when(F.col("back").isNotNull(), mixed)).alias("value"))


def filled_between(series: DataFrame, by=None) -> DataFrame:
    """Each hour of the spine by distance-weighted neighbours, however far they are."""
    keys = by or SERIES
    w = Window.partitionBy(*keys).orderBy("sys_hour")
    rows = spine(series, by).join(series.select(*keys, "sys_hour", "value"), [*keys, "sys_hour"], "left")
    at = F.when(F.col("value").isNotNull(), F.struct("sys_hour", "value"))
    rows = rows.withColumn("b", F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    to_b, to_n = F.col("sys_hour") - F.col("b.sys_hour"), F.col("n.sys_hour") - F.col("sys_hour")
    return rows.select(*keys, "sys_hour", F.when(to_b + to_n == 0, F.col("value")).otherwise((F.col("b.value") * to_n + F.col("n.value") * to_b) / (to_b + to_n)).alias("value"))


def smoothed(series: DataFrame, by=None) -> DataFrame:
    """Three-hour smoothing on the spine: 0.25, 0.5, 0.25, or 0.3, 0.7 if the next hour is missing. The ends stay; a
    missing hour carries the value before it and is not smoothed."""
    keys = by or SERIES
    w = Window.partitionBy(*keys).orderBy("sys_hour")
    rows = spine(series, by).join(series.select(*keys, "sys_hour", "value"), [*keys, "sys_hour"], "left")
    rows = rows.withColumn("f", F.last("value", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"p": F.lag("f").over(w), "nx": F.lead("value").over(w), "edge": F.lag("sys_hour").over(w).isNull() | F.lead("sys_hour").over(w).isNull()})
    mid = F.when(F.col("nx").isNull(), 0.3 * F.col("p") + 0.7 * F.col("value")).otherwise(0.25 * F.col("p") + 0.5 * F.col("value") + 0.25 * F.col("nx"))
    return rows.select(*keys, "sys_hour", F.when(F.col("value").isNull(), F.col("f")).when(F.col("edge"), F.col("value")).otherwise(mid).alias("value"))


def forecast(values, hours, ahead):
    """``ahead`` hours after the last: a blend of the last value, the same hour of up to three days before (fills
    included) and the mean of the 47 hours before the last."""
    known = dict(zip(hours, values))
    last_hour, out = hours[-1], []
    recent = [known[h] for h in range(last_hour - 47, last_hour) if h in known]
    for k in range(1, ahead + 1):
        h = last_hour + k
        diurnal = [known[h - 24 * d] for d in (1, 2, 3) if h - 24 * d in known]
        lf = max(0.0, 1 - k / 12)
        df, pf = 0.4 * (1 - lf), 0.6 * (1 - lf)
        if not diurnal:
            pf += df
        value = values[-1] * lf + (np.mean(diurnal) * df if diurnal else 0.0) + (np.mean(recent) if recent else values[-1]) * pf
        known[h] = value
        out.append((h, float(value)))
    return out


def forecast_filled(series: DataFrame, ahead: int = 24, by=None) -> DataFrame:
    """``(keys, sys_hour, value)`` of the hours after each series' last; only its last 72 hours are read by Python."""
    keys = by or SERIES
    kind = T.StructType([*[series.schema[k] for k in keys], T.StructField("sys_hour", T.LongType()), T.StructField("value", T.DoubleType())])
    ends = series.groupBy(*keys).agg(F.max("sys_hour").alias("_end"))
    late = series.join(ends, keys).filter(F.col("sys_hour") > F.col("_end") - 72).select(*keys, "sys_hour", "value")

    def fill(key, pdf):
        pdf = pdf.sort_values("sys_hour")
        rows = forecast(pdf["value"].tolist(), pdf["sys_hour"].tolist(), ahead)
        return pd.DataFrame([(*key, *r) for r in rows], columns=kind.names)

    return late.groupBy(*keys).applyInPandas(fill, kind)


def quarter_share(minute: Column) -> Column:
    """Weight of the next hour at a minute of this hour."""
    return F.when(minute >= 45, 0.75).when(minute >= 30, 0.5).when(minute >= 15, 0.25).otherwise(0.0)


def bucket(sec: Column, minutes: int) -> Column:
    return F.floor(sec / (60 * minutes)) * (60 * minutes)


def half_hours(hourly: Column) -> Column:
    """48 slots from 24: each hour and its middle to the next; the last is held."""
    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(24)), lambda i: F.array(F.element_at(hourly, i), (F.element_at(hourly, i) + F.element_at(hourly, F.least(i + 1, F.lit(24)))) / 2)))

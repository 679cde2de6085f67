"""Acceptance, slot deduplication and series statistics of observations."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.sources.store import written

SERIES = ["var", "source_id"]


def accepted(obs: DataFrame, lo: float, hi: float) -> DataFrame:
    """Adds ``accepted``: negatives clamp to zero first, then the range decides; nulls and NaN are not accepted."""
    clamped = F.greatest(F.col("value"), F.lit(0.0))
    fine = F.col("value").isNotNull() & ~F.isnan("value") & (clamped >= lo) & (clamped <= hi)
    return obs.withColumns({"value": clamped, "accepted": F.coalesce(fine, F.lit(False))})


def slots(obs: DataFrame, by=None, slot: str = "sys_hour", value: str = "value") -> DataFrame:
    """One row a time slot: the lowest maturity wins; equal maturities are averaged. Two aggregations on one partitioning, no sort."""
    keys = [*(by or SERIES), slot]
    classes = obs.groupBy(*keys, "maturity").agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"))
    best = classes.groupBy(*keys).agg(F.min(F.struct("maturity", "_sum", "_n")).alias("b"))
    return best.select(*keys, F.col("b.maturity").alias("maturity"), (F.col("b._sum") / F.col("b._n")).alias("value"), F.col("b._n").alias("n"))


def first_of_slot(rows: DataFrame, keys, rank) -> DataFrame:
    """The row of smallest ``rank`` columns for each key, as a struct minimum (no window)."""
    rest = [c for c in rows.columns if c not in keys and c not in rank]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*rank, *rest)).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in [*rank, *rest]])


def shifted(series: DataFrame, hours: int, name: str = "other", by=None) -> DataFrame:
    """Inner join of each slot with the slot ``hours`` later in the same series; gaps stay gaps."""
    keys = by or SERIES
    later = series.select(*keys, (F.col("sys_hour") - hours).alias("sys_hour"), F.col("value").alias(name))
    return series.join(later, [*keys, "sys_hour"])


def hour_covariance(series: DataFrame, by=None) -> DataFrame:
    """``(keys, hour, covar)``: mean-square change to the next and from the previous hour by UTC hour; the smaller."""
    keys = by or SERIES
    pairs = shifted(series, 1, by=keys).withColumn("sq", F.pow(F.col("other") - F.col("value"), 2))
    ahead = pairs.select(*keys, F.pmod("sys_hour", F.lit(24)).alias("hour"), F.col("sq").alias("pos"), F.lit(None).cast("double").alias("neg"))
    back = pairs.select(*keys, F.pmod(F.col("sys_hour") + 1, F.lit(24)).alias("hour"), F.lit(None).cast("double").alias("pos"), F.col("sq").alias("neg"))
    g = ahead.union(back).groupBy(*keys, "hour").agg(*[(F.coalesce(F.sum(c), F.lit(0.0)) / (F.count(c) + 0.0001)).alias(c) for c in ("pos", "neg")], F.count("neg").alias("n_neg"))
    return g.select(*keys, "hour", F.when((F.col("n_neg") == 0) | (F.col("pos") < F.col("neg")), F.col("pos")).otherwise(F.col("neg")).alias("covar"))


def overall_covariance(series: DataFrame, by=None) -> DataFrame:
    keys = by or SERIES
    pairs = shifted(series, 1, by=keys)
    return pairs.groupBy(*keys).agg(F.avg(F.pow(F.col("other") - F.col("value"), 2)).alias("overall"))


def value_at(rows: DataFrame, place, value: str = "value"):
    """The value at the 0-based place ``place(n)`` of the n sorted values (None of none), found by counting values, not by sorting all rows in one task."""
    n = rows.agg(F.count(value)).first()[0]
    if not n:
        return None
    counts = rows.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    target, lo, hi, below = place(n), *rows.agg(F.min(value), F.max(value)).first(), 0
    while lo < hi:
        width = (hi - lo) / 1000
        bins = counts.filter((F.col("v") >= lo) & (F.col("v") <= hi)).groupBy(F.least(F.lit(999), F.floor((F.col("v") - lo) / width)).alias("bin"))
        for b in sorted(bins.agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect(), key=lambda b: b.bin):
            if below + b.n > target:
                lo, hi = b.lo, b.hi
                break
            below += b.n
    return lo


def capped_at_percentile(cells: DataFrame, p: float, value: str = "value") -> DataFrame:
    """Caps values at the ``floor(n p)``-th (from 0) of the sorted values."""
    top = value_at(cells, lambda n: int(n * p), value)
    return cells.withColumn("capped", F.col(value) if top is None else F.least(F.col(value), F.lit(top)))


def ranked(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Adds ``rank`` (from 0) and ``size`` of each group. Rows are cut into ranges of (by, order), ranked in each, and shifted by
    the ranges before, so a large group is spread over many tasks."""
    cut = written(rows.repartitionByRange(by, *order).withColumn("_range", F.spark_partition_id()))
    sizes = cut.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range and group
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "size": F.sum("_n").over(Window.partitionBy(by))}).drop("_n")
    own = F.row_number().over(Window.partitionBy(by, "_range").orderBy(*order)) - 1
    return cut.withColumn("_own", own).join(shift, [by, "_range"]).withColumn("rank", F.col("_own") + F.col("_before")).drop("_own", "_before", "_range")


def completeness(series: DataFrame, first_hour: int, last_hour: int, by=None) -> DataFrame:
    """Available and missing hours, range, mean and constant flag of each series within a span."""
    inside = series.filter(F.col("sys_hour").between(first_hour, last_hour))
    return inside.groupBy(*(by or SERIES)).agg(
        F.count("value").alias("available"),
        (F.lit(last_hour - first_hour + 1) - F.count("value")).alias("missing"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        F.avg("value").alias("mean"),
        ((F.count("value") > 10) & (F.min("value") == F.max("value"))).alias("constant"),
    )


def stationary(points: DataFrame, by: str = "source_id", limit: float = 0.001) -> DataFrame:
    spread = lambda c: F.max(c) - F.min(c)
    return points.groupBy(by).agg(((spread("lat") < limit) & (spread("lon") < limit)).alias("stationary"))


def with_share(rows: DataFrame, value: str, by, name: str = "share") -> DataFrame:
    """Each row's share of its group's total, by aggregate and join back (a hot group isn't sorted into one task)."""
    total = rows.groupBy(*by).agg(F.sum(value).alias("_total"))
    return rows.join(total, by).withColumn(name, F.col(value) / F.col("_total")).drop("_total")


def last_known(order: Column, by) -> Window:
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
